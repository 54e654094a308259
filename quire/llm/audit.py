"""How far the sources of a language diverge, and by which terms.

Terms are runs of letters and of characters beyond ASCII. A language keeps the terms that enough of its documents hold; each (lang, source)
and each language gives every kept term a smoothed share p, a whole number of billionths, and two of them differ on a term by
f(p, q) = floor((p - q)**2 / (p + q)). Reported are the sums of f between any two sources of a language, and for each source the terms that
stand out most against its language. All arithmetic is in whole numbers.

Most different terms are rare, and none of them needs to be shuffled. A first pass over the texts makes count-min sketches of document frequencies: tasks
count (lang, term) in all rows of a small table of counters, which are summed up to ``least``, slice by slice. A sketch never
underestimates. A second pass counts again, and of each task's sums only those of terms go on whose estimate reaches ``least``. They are
summed exactly, and what still is too rare goes. The sketch has DEPTH * WIDTH bytes whatever the data, and that much is collected and broadcast; a vocabulary
far above WIDTH fills it up, then more terms are shuffled, and the result is the same.

Sums over terms are sparse: a term that a source lacks has the source's least share. The sum for two sources is that of two least shares over
all terms, corrected by each one's own terms (through a histogram of shares) and by the terms that both hold. The last come from a table in order of
(lang, term); a task adds up its terms for all pairs of sources that meet in them and gives one row for each pair, so no pairs of rows are written or shuffled.

Defined cases: null text, lang and source read as ''; a group without terms has the least share of each kept term; a language that keeps no term
has values of 0 between its sources and no terms; a source alone in its language has no pairs; repeated rows count as often as they
occur; texts of any length are counted whole, and a document's terms once for its document frequency; other columns, also of clashing names, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import Numbers, portions
from quire.llm.common import batches_of, documents, give_back, light, written
from quire.llm.sets import mix

#: Documents of its language that must hold a term, and ranks of terms that are told.
LEAST, TOP = 10, 10
#: Counters of a row of the sketch, rows, and counters that travel together.
WIDTH, DEPTH, SLICE = 1 << 22, 3, 1 << 16
#: Terms that a task knows at once, sums that it holds apart, bytes of text at once, rows sent to it at once, and pairs at once.
KNOWN, HELD, BYTES, ROWS, PAIRS = 600_000, 4_000_000, 8_000_000, 1024, 2_000_000
MANY = (1 << 21) - 1
#: Bytes of terms, A-Z in lower case; all others stand for a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    return key[first], *[np.add.reduceat(v[order], first) if len(key) else v for v in values]


class Tally:
    """Counts of terms by group, and in how many documents of the group they are."""

    def __init__(self):
        self.groups = Numbers()
        self.clear()

    def clear(self) -> None:
        self.terms = Numbers()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows of (lang, source, text)."""
        group = [self.groups[x] for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        found = [x.as_buffer().to_pybytes().translate(TERM_BYTES).split() for x in batch.column(2)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        at = np.concatenate([np.fromiter(map(self.terms.__getitem__, w), np.int64, len(w)) for w in found])
        self.terms.new = []
        doc = np.repeat(np.arange(len(found)), lens)
        once, times = summed(doc << 32 | at, np.ones(len(at), np.int64))
        key = np.array(group, np.int64)[once >> 32] << 32 | once & 0xFFFFFFFF
        self.parts.append(summed(key, times, np.ones(len(key), np.int64)))
        self.held += len(self.parts[-1][0])
        if self.held > HELD:
            self.sums()

    @property
    def full(self) -> bool:
        return len(self.terms) > KNOWN or self.held > HELD

    def sums(self) -> tuple[np.ndarray, ...]:
        """Group << 32 | term, count and document frequency."""
        self.parts = [summed(*map(np.concatenate, zip(*self.parts)))] if self.parts else [tuple(np.zeros(0, np.int64) for _ in range(3))]
        self.held = len(self.parts[0][0])
        return self.parts[0]

    def by_lang(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and document frequency of each (lang, term), and for each of sums() the place of its (lang, term) among these."""
        key, _, df = self.sums()
        langs = Numbers()
        lang = np.array([langs[x] for x, _ in self.groups] or [0], np.int64)
        own = lang[key >> 32] << 32 | key & 0xFFFFFFFF
        distinct, at = np.unique(own, return_inverse=True)
        names, seeds = list(self.terms), [xxhash.xxh3_64_intdigest(x.encode()) for x in langs]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(names[t], seeds[g]) for g, t in zip((distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist())), np.uint64, len(distinct))
        return hashes, np.bincount(at, df, len(distinct)).astype(np.int64), at


class Sketch:
    """Count-min rows of counters that stop at ``least``."""

    def __init__(self, least: int, width: int = WIDTH, depth: int = DEPTH):
        self.least, self.width = least, width
        self.cells = np.zeros((depth, width), np.min_scalar_type(least))

    def places(self, row: int, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes + np.uint64(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(self.width)).astype(np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        for row, cells in enumerate(self.cells):
            at, n = summed(self.places(row, hashes), np.minimum(counts, self.least))
            cells[at] = np.minimum(cells[at] + n, self.least)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        """Counts up to ``least``, never below the true ones so far."""
        return np.min([cells[self.places(row, hashes)] for row, cells in enumerate(self.cells)], axis=0)


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])


def tallies(batches):
    """One tally after the other, each of as many documents as are held at once."""
    t = Tally()
    for b in batches:
        at = 0
        for take in portions(b.column(2), BYTES):
            t.add(b.slice(at, take))
            at += take
            if t.full:
                yield t
                t.clear()
    yield t


def sketched(docs: DataFrame, least: int, width: int = WIDTH, depth: int = DEPTH) -> Sketch:
    """The merged sketch of document frequencies by (lang, term)."""
    size = min(SLICE, width)
    kind = np.min_scalar_type(least)

    def rows(parts: dict[int, np.ndarray]):
        for k, cells in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zstandard.compress(cells.tobytes(), 1)], pa.binary())], ["slice", "cells"])

    def make(batches):
        s = Sketch(least, width, depth)
        for t in tallies(batches):
            hashes, df, _ = t.by_lang()
            s.add(hashes, df)
        cells = s.cells.reshape(-1, size)
        yield from rows({int(k): cells[k] for k in np.flatnonzero(cells.any(axis=1))})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                cells = np.frombuffer(zstandard.decompress(x.as_py()), kind).astype(np.int64)
                held[k] = np.minimum(held[k] + cells, least) if k in held else cells
        yield from rows({k: x.astype(kind) for k, x in held.items()})

    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = Sketch(least, width, depth)
    with batches_of(docs.sparkSession, ROWS):
        for r in docs.mapInArrow(light(make), "slice long, cells binary").repartition(buckets, "slice").mapInArrow(light(merge), "slice long, cells binary").toLocalIterator():
            out.cells.reshape(-1, size)[r.slice] = np.frombuffer(zstandard.decompress(bytes(r.cells)), kind)
    return out


def counted(docs: DataFrame, least: int, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, term, n (times it occurs there) and df (documents there with it) of all terms that the sketch doesn't rule out; each occurring (lang, source) has a row of no term."""
    docs = read(docs)
    sketch = docs.sparkSession.sparkContext.broadcast(sketched(docs, least, width, depth))

    def count(batches):
        groups = {}
        for t in tallies(batches):
            groups |= t.groups
            key, n, df = t.sums()
            hashes, _, at = t.by_lang()
            some = (sketch.value.estimate(hashes) >= least)[at]
            key, n, df = key[some], n[some], df[some]
            names, langs, sources = list(t.terms), [x for x, _ in t.groups], [x for _, x in t.groups]
            for k in range(0, len(key), 1 << 16):
                part = slice(k, k + (1 << 16))
                g, terms = (key[part] >> 32).tolist(), [names[x].decode("utf-8", "replace") for x in (key[part] & 0xFFFFFFFF).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([langs[x] for x in g], pa.string()), pa.array([sources[x] for x in g], pa.string()), pa.array(terms, pa.string()), pa.array(n[part]), pa.array(df[part])], ["lang", "source", "term", "n", "df"])
            del key, n, df, hashes, at
        if groups:
            zero = pa.array(np.zeros(len(groups), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in groups]), pa.array([x for _, x in groups]), pa.nulls(len(groups), pa.string()), zero, zero], ["lang", "source", "term", "n", "df"])
        give_back()

    with batches_of(docs.sparkSession, ROWS):
        rows = docs.mapInArrow(light(count), "lang string, source string, term string, n long, df long")
        return written(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "audit-counts")


def share(n: str, total: str, v: str) -> str:
    """1 + floor(10**9 * (n + 2) / (total + 2 * v)) by long division in thousands, since the product would pass 64 bits."""
    d = f"({total} + 2 * {v})"
    one, two = f"(({n} + 2) * 1000)", f"(({n} + 2) * 1000 % {d} * 1000)"
    return f"1 + {one} div {d} * 1000000 + {two} div {d} * 1000 + ({two} % {d} * 1000) div {d}"


def differ(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def together(cells: DataFrame) -> DataFrame:
    """cells (lang, term, source, p, base), each (lang, term) in one task, as (lang, a, b, value) with a < b: per pair of sources the
    correction of the sum over all terms by the terms that both hold; partial sums of each task."""

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def run(batches):
        names, langs = Numbers(), Numbers()
        total: dict[int, int] = {}

        def add(t: pa.Table):
            """Whole terms. A lang and two sources of it are one number, of 21 bits each."""
            lang, term, source = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
            own = [np.array([to[x] for x in c.dictionary.to_pylist()], np.int64)[c.indices.to_numpy()] for c, to in ((lang, langs), (source, names))]
            lang, source, term = own[0], own[1], term.indices.to_numpy()
            p, base = t.column("p").to_numpy(), t.column("base").to_numpy()
            new = np.concatenate(([True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])))
            end = np.append(np.flatnonzero(new)[1:], len(term))[np.cumsum(new) - 1]
            later = end - np.arange(len(term)) - 1
            stop = np.cumsum(later)
            for k in range(0, int(stop[-1]) if len(stop) else 0, PAIRS):
                i = np.arange(k, min(k + PAIRS, int(stop[-1])))
                a = np.searchsorted(stop, i, "right")
                b = a + 1 + i - (stop[a] - later[a])
                value = f(p[a], p[b]) - f(p[a], base[b]) - f(base[a], p[b]) + f(base[a], base[b])
                x, y = np.minimum(source[a], source[b]), np.maximum(source[a], source[b])
                key, value = summed(lang[a] << 42 | x << 21 | y, value)
                for i, v in zip(key.tolist(), value.tolist()):
                    total[i] = total.get(i, 0) + v

        def told():
            words, tongues = list(names), list(langs)
            rows = [(tongues[k >> 42], *sorted((words[k >> 21 & MANY], words[k & MANY])), v) for k, v in total.items()]
            for k in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + (1 << 16)])], ["lang", "a", "b", "value"])

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            last = (t.column("lang")[-1].as_py(), t.column("term")[-1].as_py())
            cut = t.num_rows
            while cut and (t.column("lang")[cut - 1].as_py(), t.column("term")[cut - 1].as_py()) == last:
                cut -= 1
            if cut:
                if max(len(names), len(langs)) + cut > MANY:  # numbers of sources would outgrow their bits
                    yield from told()
                    names, langs = Numbers(), Numbers()
                    total.clear()
                add(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            add(rest)
        yield from told()

    return cells.mapInArrow(run, "lang string, a string, b string, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (another source, or a term), value and rank."""
    counts = counted(docs, least, width, depth)
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least).drop("df")
    cells = written(terms.join(kept, ["lang", "term"]).select("lang", "term", "source", "n", "total"), "audit-cells")
    tongues = cells.groupBy("lang", "term").agg(F.max("total").alias("t")).groupBy("lang").agg(F.sum("t").alias("nl"), F.count("*").alias("v"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(tongues, "lang", "left")
    groups = groups.selectExpr("lang", "source", "coalesce(size, 0) as size", "nl", "coalesce(v, 0) as v")
    groups = written(groups.withColumn("base", F.expr(f"case when v > 0 then {share('0L', 'size', 'v')} end")), "audit-groups")
    # Two columns of numbers for each (lang, source); joins with it may be broadcast by its measured size, or split where one source is hot.
    cells = cells.join(groups, ["lang", "source"]).selectExpr("lang", "term", "source", "base", f"{share('n', 'size', 'v')} as p", f"{share('total', 'nl', 'v')} as q")
    cells = written(cells, "audit-shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = cells.where("p > q").selectExpr("lang", "source", "'term' as part", "term as item", f"{differ('p', 'q')} as value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    both = groups.selectExpr("lang", "source as a", "v", "base as base_a").join(groups.selectExpr("lang", "source as b", "base as base_b"), "lang").where("a <> b")
    both = both.withColumn("least", F.expr(f"coalesce({differ('base_a', 'base_b')}, 0)"))
    own = cells.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("k")).join(both, ["lang", "a"])
    own = own.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"k * ({differ('p', 'base_b')} - least)")).alias("value"))
    common = together(cells.select("lang", "term", "source", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term"))
    values = both.selectExpr("lang", "a", "b", "v * least as value").union(own).union(own.select("lang", F.col("b"), F.col("a"), "value"))
    values = values.union(common).union(common.select("lang", F.col("b"), F.col("a"), "value"))
    pairs = values.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).selectExpr("lang", "a as source", "'pair' as part", "b as item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).union(out)


def op11(spark, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


SQL = r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
occurs as (select r, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*) as total from occurs group by lang, term having count(distinct r) >= 10),
tongues as (select lang, count(*) as v, sum(total) as nl from kept group by lang),
cells as (select lang, source, term, count(*) as n from occurs join kept using (lang, term) group by lang, source, term),
groups as (select g.lang, g.source, coalesce(sum(n), 0) as size from (select distinct lang, source from docs) g left join cells c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
shares as (select g.lang, g.source, k.term, coalesce(n, 0) as n, cast(1 + 1000000000 * (coalesce(n, 0) + 2) // (size + 2 * v) as bigint) as p, cast(1 + 1000000000 * (total + 2) // (nl + 2 * v) as bigint) as q
  from groups g join tongues t using (lang) join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from shares where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 10"""
