"""Assets and imports of older libraries: image sizes, diagnostics as JSON, kinds by code, what a schema can do, boxes and pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import table


def png_size(data: Column) -> tuple[Column, Column]:
    """Width and height from the header of a PNG; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")
    fits = (F.octet_length(data) >= 24) & (F.hex(F.substring(data, 1, 4)) == "89504E47")
    return F.when(fits, number(17)), F.when(fits, number(21))


def _jpeg(data: bytes | None) -> dict | None:
    """Size in the first frame header; segments before it are stepped over by their lengths."""
    at = 2
    if not data or data[:2] != b"\xff\xd8":
        return None
    while at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return {"width": int.from_bytes(data[at + 7 : at + 9], "big"), "height": int.from_bytes(data[at + 5 : at + 7], "big")}
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def image_size(data: Column, mime: Column) -> Column:
    """struct<width, height> of PNG and JPEG bytes; null for what isn't one."""

    @F.pandas_udf("struct<width: bigint, height: bigint>")
    def jpeg(parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_jpeg(x) or {"width": None, "height": None} for x in parts], columns=["width", "height"]).astype("Int64")

    w, h = png_size(data)
    # Only the first bytes can matter to a header; files that are no JPEG don't go to Python.
    j = jpeg(F.when(mime == "image/jpeg", data))
    size = F.when(mime == "image/png", F.struct(w.alias("width"), h.alias("height"))).when(mime == "image/jpeg", F.struct(j["width"].alias("width"), j["height"].alias("height")))
    return F.when(size["width"].isNotNull(), size)


_TEXT = "if(schema_of_variant(try_variant_get(x, '$.{0}', 'variant')) = 'STRING', try_variant_get(x, '$.{0}', 'string'), null)"


def lenient_diagnostics(raw: str) -> Column:
    """The entries of diagnostics as JSON that have a message: array<struct<severity, message, line, file>>; broken JSON has none."""
    line = "if(schema_of_variant(try_variant_get(x, '$.line', 'variant')) in ('BIGINT', 'DOUBLE') or schema_of_variant(try_variant_get(x, '$.line', 'variant')) like 'DECIMAL%', try_variant_get(x, '$.line', 'double'), null)"
    entry = f"struct(coalesce({_TEXT.format('severity')}, 'info') as severity, {_TEXT.format('message')} as message, {line} as line, {_TEXT.format('file')} as file)"
    return F.expr(f"coalesce(filter(transform(try_variant_get(try_parse_json({raw}), '$', 'array<variant>'), x -> {entry}), e -> e.message is not null), array())")


def first_error(raw: str) -> Column:
    """``L{line}: message`` of the first error of diagnostics as JSON, without a line where it has none; null without an error."""
    e = F.get(F.filter(lenient_diagnostics(raw), lambda x: x["severity"] == "error"), F.lit(0))
    return F.when(e["line"].isNotNull(), F.concat(F.lit("L"), e["line"].cast("long").cast("string"), F.lit(": "), e["message"])).otherwise(e["message"])


def _diagnostics(s, d) -> DataFrame:
    """Events with diagnostics as JSON: whole, broken, no array, with entries that are no diagnostics."""
    n, k = F.col("event_id").cast("string"), (F.col("event_id") % 6 + 1).cast("int")
    good = F.concat(F.lit('[{"severity":"info","message":"box","line":'), n, F.lit('},{"severity":"error","message":"m'), n, F.lit('","line":'), n, F.lit(',"file":"a.tex"}]'))
    raw = F.element_at(F.array(good, F.lit('[{"message":'), F.lit('{"message":"x"}'), F.concat(F.lit('[5,null,"x",{"message":7},{"message":"only","line":"3"},{"severity":9,"message":"e'), n, F.lit('"}]')), F.concat(F.lit('[{"severity":"error","message":"no line '), n, F.lit('"}]')), F.lit("[]")), k)
    return table(s, d, "events").select("event_id", raw.alias("raw"))


#: Kinds of nodes by the negative codes of older libraries (fixed values of their format).
KINDS = {-10: "CHAPTER", -9: "SECTION", -8: "SUBSECTION", -7: "SUBSECTION", -1: "QUESTION_GROUP"}


def legacy_kind(code: Column, types: int) -> Column:
    """Kind of a node by its code: questions from 0 up to types; a code that nobody knows stops the import."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), code)
    return F.when(known.isNotNull(), known).when((code >= 0) & (code < types), "QUESTION").when(code.isNotNull(), F.raise_error(F.concat(F.lit("unknown code "), code.cast("string"))))


def capabilities(tables: list[str], migrations: list[str] | None, columns: list[str]) -> dict:
    """What an older library holds, by its tables, its list of migrations (None: no such table) and the columns of its questions.

    Columns decide; migrations only where no column is known. An unknown history counts as the oldest.
    """
    done = migrations or []
    later, images = (any(m.endswith(x) for m in done) for x in ("LatexComplemento", "ImagensCompleta"))
    complement = "LatexComplemento" in columns or (not columns and later)
    generation = "pre_migrations" if migrations is None else "latex_complemento" if complement or later else "imagens_completa" if images else "pre_migrations"
    return {"generation": generation, "complement": complement, "tags": "TagConhecimento" in tables, "migrations": migrations is not None}


def exportable(assets: DataFrame, kind: str = "kind") -> DataFrame:
    """Assets without those that a render made, which can be made anew."""
    return assets.where(~F.coalesce(F.col(kind).startswith("RENDER_"), F.lit(False)))


def pixels(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> tuple[Column, ...]:
    """A box in parts of a page as pixels x0, y0, x1, y1: rounded outward, within the page."""
    low = lambda a, n: F.greatest(F.lit(0), F.floor(a * n)).cast("long")
    high = lambda a, n: F.least(F.lit(n), F.ceil(a * n)).cast("long")
    return low(x, width), low(y, height), high(x + w, width), high(y + h, height)


def parts(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> tuple[Column, ...]:
    """Pixels as a box in parts of a page: x, y, w, h with six decimals."""
    six = lambda a: F.round(a, 6)
    return six(x0 / width), six(y0 / height), six((x1 - x0) / width), six((y1 - y0) / height)


def _rects(s, d):
    """Boxes of lines to pixels of a page and back: a box never shrinks."""
    x, y, w, h = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.col("l_quantity") / 80
    box = pixels(x, y, w, h, 1240, 1754)
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))])
    back = parts(*map(F.col, ("x0", "y0", "x1", "y1")), 1240, 1754)
    return df.select("*", *[c.alias(n) for c, n in zip(back, ("x", "y", "w", "h"))])


QUERIES = {
    "diagnostics_lenient": lambda s, d: _diagnostics(s, d).select("event_id", F.explode(lenient_diagnostics("raw")).alias("e")).select("event_id", "e.*"),
    "first_error": lambda s, d: _diagnostics(s, d).select("event_id", first_error("raw").alias("message")),
    "legacy_kinds": lambda s, d: table(s, d, "part").select("p_partkey", legacy_kind(F.element_at(F.array(*map(F.lit, (-10, -9, -8, -7, -1, 0, 2))), (F.col("p_size") % 7 + 1).cast("int")), 3).alias("kind")),
    "export_assets": lambda s, d: exportable(table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "RENDER_PDF").when(F.col("page_id") % 3 == 1, "FIGURE").alias("kind"))),
    "rect_roundtrip": _rects,
}

_RAW = """raw as (select event_id, case event_id % 6 when 0 then '[{"severity":"info","message":"box","line":' || event_id || '},{"severity":"error","message":"m' || event_id || '","line":' || event_id || ',"file":"a.tex"}]'
  when 3 then '[5,null,"x",{"message":7},{"message":"only","line":"3"},{"severity":9,"message":"e' || event_id || '"}]' when 4 then '[{"severity":"error","message":"no line ' || event_id || '"}]' else '[]' end as raw from events),
e as (select event_id, u.i as i, u.x as x from (select event_id, unnest(list_transform(range(0, cast(json_array_length(raw) as bigint)), lambda i: {'i': i, 'x': json_extract(raw, '$[' || i || ']')})) as u from raw)),
f as (select event_id, i, case when json_type(x, '$.severity') = 'VARCHAR' then json_extract_string(x, '$.severity') else 'info' end as severity, json_extract_string(x, '$.message') as message, case when json_type(x, '$.line') in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(json_extract(x, '$.line') as double) end as line, case when json_type(x, '$.file') = 'VARCHAR' then json_extract_string(x, '$.file') end as file from e where json_type(x, '$.message') = 'VARCHAR')"""
ORACLE_SQL = {
    "diagnostics_lenient": f"with {_RAW} select event_id, severity, message, line, file from f",
    "first_error": f"with {_RAW} select r.event_id, case when line is not null then 'L' || cast(line as bigint) || ': ' || message else message end as message from raw r left join (select * from f where severity = 'error' qualify row_number() over (partition by event_id order by i) = 1) g using (event_id)",
    "legacy_kinds": "select p_partkey, case p_size % 7 when 0 then 'CHAPTER' when 1 then 'SECTION' when 2 then 'SUBSECTION' when 3 then 'SUBSECTION' when 4 then 'QUESTION_GROUP' else 'QUESTION' end as kind from part",
    "export_assets": "select page_id, case when page_id % 3 = 1 then 'FIGURE' end as kind from pages where page_id % 3 <> 0",
    "rect_roundtrip": "with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(floor(l_discount * 1240) as bigint) as x0, cast(floor(l_tax * 1754) as bigint) as y0, cast(least(1240, ceil((l_discount + l_quantity / 100) * 1240)) as bigint) as x1, cast(least(1754, ceil((l_tax + l_quantity / 80) * 1754)) as bigint) as y1 from lineitem) select *, round(x0 / 1240, 6) as x, round(y0 / 1754, 6) as y, round((x1 - x0) / 1240, 6) as w, round((y1 - y0) / 1754, 6) as h from p",
}
