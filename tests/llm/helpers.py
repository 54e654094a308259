"""Running an oracle in DuckDB over DataFrames or the small tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def oracle(sql, sf=SF, **tables):
    con = duckdb.connect()
    for t in TABLES:
        if t not in tables:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for t, df in tables.items():
        con.register(f"_{t}", df.toArrow())
        con.execute(f"create view {t} as select * from _{t}")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted((tuple(r) for r in got.fetchall()), key=repr), names


def rows(df, names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def same(df, sql, sf=SF, **tables):
    want, names = oracle(sql, sf, **tables)
    assert set(names) == set(df.columns)
    got = rows(df, names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(a, b)), (a, b)


def edge_documents(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and extra columns with clashing names."""
    long = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
    data = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 0), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
        (None, "two words", None, "b", 9), (None, "two words", None, "b", 9), (5, long, "en", "a", len(long)), (6, long, "en", "b", len(long)),
        (7, "a b c d e f g h " * 8, "fr", "b", 1), (8, "line one is here\n" * 30, "fr", "c", 1), (9, "é ü 漢字 😀 " * 10, "fr", "", None),
    ]
    df = spark.createDataFrame(data, DOCS)
    df = df.repartition(3)  # else the optimizer itself works rows out, slowly, wherever they are projected
    return df.selectExpr("*", "doc_id as size", "text as h", "1 as n_words", "'x' as k", "'y' as _w", "2 as copies", "3 as target")
