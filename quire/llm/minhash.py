"""Near duplicates by MinHash: many universal hash minima with banding, and connected components.

A set of 3-word shingles has, for each of many universal hash functions h(x) = (a * x + b mod 2**64) >> 32, the shingle with the least hash; two sets
agree on a minimum with a chance of their Jaccard similarity. A signature keeps 16 bits of each minimum. Its minima are cut into bands, and sets
that agree on all minima of a band are candidates. With 32 bands of 5 a pair of similarity 0.85 is no candidate with a chance of 7e-9.

The candidates of a band may be many that aren't similar, or many that all are. Signatures sieve them: a pair goes on only if it agrees
on so many minima as a link does but for a chance of 1e-9. What goes on is tested exactly, on all shingles of the whole texts, as ``linking``
tells, and in the first of the bands that a pair shares; pairs of sets that are connected anyway aren't tested. Components are found by alternating large-star and small-star.

Equal sets are one node from the start, so any number of copies costs no pairs. Bands with equal members count as one. The least member of a band and its size are
partial aggregates, and its members come back by a join that can be split, so a band that most sets share isn't gathered.

Defined cases: null or blank text has an empty set and links with nothing; fewer than three words form one shingle; repeated rows are equal
sets; null doc_ids don't take part in the smallest id, and a component of null ids alone has a null id and keeps its rows; texts of any length are
hashed whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import documents, light, written
from quire.llm.linking import linked
from quire.llm.partenum import classes
from quire.llm.sets import mix, set_key, shingles

SHINGLE, SIMILAR = 3, 85
BANDS, ROWS = 32, 5
MINIMA, EVERY = BANDS * ROWS, (1 << BANDS) - 1
#: Chance that signatures sieve out a link.
MISS = 1e-9
#: Multipliers (odd) and addends of the hash functions, and shingles hashed at once.
A, B = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(1, MINIMA + 1, dtype=np.uint64) << np.uint64(32))
CHUNK = 512


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each minimum of a set of hashes that isn't empty."""
    keys = s >> np.uint64(32)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(keys), CHUNK):
        h = np.multiply.outer(A, keys[k : k + CHUNK])
        h += B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def band_hashes(sigs: np.ndarray) -> np.ndarray:
    """A hash of each band of rows of signatures."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32), (len(sigs), BANDS)).copy()
    for k in range(ROWS):
        acc = mix(acc + parts[:, :, k])
    return acc


@lru_cache(None)
def fewest(similar: int = SIMILAR) -> int:
    """Agreements below which a pair of this similarity stays with a chance of MISS at most."""
    p, chance = similar / 100, 0.0
    for k in range(MINIMA + 1):
        chance += comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k)
        if chance > MISS:
            return k
    return MINIMA


def matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, MINIMA)


def near(sigs: pa.Array, size: np.ndarray, mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima on which the sets at places a and b differ, and whether sizes and signatures let them be similar and the first band that they share is one of mask."""
    rows, d = matrix(sigs), np.full(len(a), MINIMA, np.int32)
    may = np.zeros(len(a), bool)
    fit = np.flatnonzero(100 * np.minimum(size[a], size[b]) >= SIMILAR * np.maximum(size[a], size[b]))
    for k in range(0, len(fit), 1 << 14):
        some = fit[k : k + (1 << 14)]
        same = rows[a[some]] == rows[b[some]]
        d[some] = MINIMA - np.count_nonzero(same, axis=1)
        close = d[some] <= MINIMA - fewest()
        first = same[close].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        may[some[close]] = (mask[a[some[close]]] >> first) & 1 > 0
    return d, may


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), size and key of each document's set; ref and sketch, the signature, where a task meets the set first."""

    def run(batches):
        base, seen, n = TaskContext.get().partitionId() << 32, set(), 0
        for b in batches:
            found = []
            for text in b.column(2):
                s = shingles(text.as_buffer().to_pybytes() if text.is_valid else None, SHINGLE)
                k = set_key(s)
                new = len(s) > 0 and k not in seen
                found.append((len(s), k, base + n if new else None, signature(s).tobytes() if new else None))
                if new:
                    n += 1
                    seen.add(k)
            if len(seen) > 1_000_000:
                seen.clear()
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.int64(), pa.binary()))]], ["doc_id", "t", "size", "key", "ref", "sketch"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("t"), docs["text"].alias("text"))
    return own.mapInArrow(light(run), "doc_id long, t long, size long, key binary, ref long, sketch binary")


def banded(held: DataFrame) -> DataFrame:
    """Rows (band, k, node), a band by its hash and its number."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                h = band_hashes(matrix(part.column(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(h))), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["band", "k", "node"])

    return held.select("node", "sketch").mapInArrow(light(run), "band long, k int, node long")


def members_of(bands: DataFrame) -> DataFrame:
    """(g, node, w, mask) of the groups of two nodes or more that share bands; groups with equal members are one, of weight w, the number of its bands, whose numbers are the bits of mask."""
    groups = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("k").alias("k")).where("n > 1")
    groups = groups.groupBy("n", "least", "x").agg(F.min("band").alias("g"), F.count("*").alias("w"), F.expr("bit_or(shiftleft(1L, k))").alias("mask")).select("g", "w", "mask")
    return bands.withColumnRenamed("band", "g").join(groups, "g").select("g", "node", "w", "mask")


def likely(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures and sizes let them be similar."""

    def run(batches):
        for b in batches:
            u, v, *sizes = (b.column(k).to_numpy() for k in range(4))
            n = len(u)
            _, may = near(pa.concat_arrays([b.column(4), b.column(5)]), np.concatenate(sizes), np.full(2 * n, EVERY), np.arange(n), np.arange(n) + n)
            yield b.select([0, 1]).filter(pa.array(may))

    of = lambda x: held.selectExpr(f"node as {x}", f"size as size_{x}", f"sketch as sketch_{x}")
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "size_u", "size_v", "sketch_u", "sketch_v")
    return both.mapInArrow(light(run), "u long, v long")


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, t, size, key) of docs, and comp (key, comp) of the keys that have links; comp is a key, too."""
    found = written(scanned(docs), "minima")
    # One row of equal sets stands for them.
    held = found.where("ref is not null").dropDuplicates(["key"])
    held = written(held.selectExpr("ref as node", "key", "size", "sketch", "t as rt", "doc_id as rd"), "held")
    members = written(members_of(banded(held)), "members")
    comp = linked(docs, members, held.drop("key"), near, lambda pairs: likely(pairs, held), SHINGLE, SIMILAR)
    keys = held.select("key", "node")
    comp = comp.join(keys, "node").drop("node").join(keys.selectExpr("key as c", "node as comp"), "comp")
    return found.select("doc_id", "t", "size", "key"), written(comp.selectExpr("key", "c as comp"), "comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: the size of its set, the smallest doc_id that links reach from it, and whether that is itself."""
    rows, comp = joined(docs)
    out = rows.join(classes(rows, comp), "key", "left")
    out = out.selectExpr("doc_id", "size as n_shingles", "case when size = 0 then doc_id else component_id end as component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def jaccard_sql(size: int, similar: int, more: str = "") -> str:
    """DuckDB: component_id of each document by links of shingle sets, all pairs that share a shingle."""
    leads = "".join(f" || ' ' || lead(w, {k}) over own" for k in range(1, size))
    return rf"""
with recursive docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
words as (select r, unnest(w) as w, generate_subscripts(w, 1) as i from docs where len(w) >= {size}),
parts as (select distinct r, s from (select r, w{leads} as s from words window own as (partition by r order by i)) where s is not null union all select r, array_to_string(w, ' ') from docs where len(w) between 1 and {size - 1}),
keys as (select r, count(*) as n, md5(string_agg(s, chr(10) order by s)) as key from parts group by r),
nodes as (select min(r) as k, key, any_value(n) as n from keys group by key),
held as (select k, n, s from nodes join parts on parts.r = k),
links as (select a.k as u, b.k as v from held a join held b on a.s = b.s and a.k < b.k group by a.k, b.k, a.n, b.n having 100 * count(*) >= {similar} * (a.n + b.n - count(*))),
both_ways as (select u, v from links union all select v, u from links),
reach as (select k as u, k as v from nodes union select reach.u, l.v from reach join both_ways l on l.u = reach.v),
ids as (select docs.doc_id, docs.r, k, keys.n from docs join keys using (r) join nodes using (key)),
least as (select u as k, min(doc_id) as component_id from reach join ids on ids.k = reach.v group by u),
told as (select docs.doc_id, cast(coalesce(ids.n, 0) as bigint) as n_shingles, case when ids.k is null then docs.doc_id else component_id end as component_id from docs left join ids using (r) left join least using (k))
select *{more} from told"""


SQL = jaccard_sql(SHINGLE, SIMILAR, ", doc_id is not distinct from component_id as kept")
