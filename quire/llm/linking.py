"""Links between similar sets, found from groups of sets that may be similar.

1. Stars: each set is tested with one other, the least set of the groups it is in that it meets in most of them. That connects most of what belongs together.
2. Cells: in groups that still hold several components, the sets outside the largest one meet the whole group, block by block. Sketches first tell
which sets have any partner left; the shingles of these alone are brought to the cells, whose tasks test their pairs exactly and give only links.

Pairs within a component are never formed, a pair is tested in one of its groups only, and no list of pairs leaves a task: a group of n sets of which m lie outside
its largest component costs at most m * n comparisons of sketches in tasks, and about 2 * m * n / BLOCK rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches_of, drop, light, sift, written
from quire.llm.graph import components
from quire.llm.sets import shingles

#: Members of a group on either side of a cell, and pairs of one set that one task tests.
BLOCK, TESTS = 512, 256
#: Bytes of sets that a task works on at once, where cells are small, and rows sent to it at once.
BYTES, ROWS = 8_000_000, 256

#: (sketches, sizes, masks, a, b) as (differences d, whether the sets at places a and b may be similar and are this group's to test).
Near = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
CELL = ["g", "i", "j", "node", "c", "other", "row", "col", "mask"]


def texts_of(docs: DataFrame, held: DataFrame) -> DataFrame:
    """node and text of the sets of held (node, rt, rd: hash of the text and id of a document that has it)."""
    texts = docs.select(F.xxhash64(docs["text"]).alias("t"), docs["doc_id"].cast("long").alias("d"), docs["text"].alias("text"))
    texts, _ = sift(texts, "t", held, "rt")
    return texts.join(held.select("node", "rt", "rd"), (F.col("t") == F.col("rt")) & F.col("d").eqNullSafe(F.col("rd"))).select("node", "text").dropDuplicates(["node"])


def tested(pairs: DataFrame, texts: DataFrame, n: int, similar: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= similar * union of their n-word shingles; texts has node and text of every set named in them.

    The text of v joins first; then rows meet the text of u in tasks by u and a salt, as many salts as the pairs of u ask for.
    """

    def compare(batches):
        last, x = None, None
        for b in batches:
            linked = []
            for u, s, t in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if u != last:
                    last, x = u, shingles(s.as_py(), n)
                y = shingles(t.as_py(), n)
                both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
                linked.append(100 * both >= similar * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    many = pairs.groupBy("u").agg(F.expr(f"cast(ceil(count(*) / {TESTS}) as int)").alias("salts"))
    left = pairs.join(many, "u").selectExpr("u", "v", "cast(pmod(xxhash64(v), salts) as int) as salt")
    right = many.select("u", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt")).join(texts.selectExpr("node as u", "text as x"), "u")
    left = left.join(texts.selectExpr("node as v", "text as y"), "v")
    return left.join(right, ["u", "salt"]).select("u", "v", "x", "y").mapInArrow(light(compare), "u long, v long")


def stars(members: DataFrame) -> DataFrame:
    """For each node of members (g, node, w) one pair (u, v), v below it: of the least nodes of its groups the one with the most groups, by weight."""
    least = members.groupBy("g").agg(F.min("node").alias("v"))
    met = members.join(least, "g").where("node > v").groupBy("node", "v").agg(F.sum("w").alias("w"))
    return met.groupBy("node").agg(F.max(F.struct("w", (-F.col("v")).alias("v"))).alias("b")).selectExpr("node as u", "-b.v as v")


def cells(members: DataFrame, comp: DataFrame, held: DataFrame, buckets: int) -> DataFrame:
    """Rows of CELL with size and sketch, cells (g, i, j) whole and in order within tasks.

    Groups of one component are left out. Of the others, each set outside the largest component (other) is in some row i of
    blocks, and every set in some column j; a cell holds the sets of its row and of its column.
    """
    df = members.select("g", "node", "mask").join(comp, "node", "left").select("g", "node", "mask", F.coalesce("comp", "node").alias("c"))
    sizes = df.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "c")).alias("b"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    sizes = sizes.selectExpr("g", "b.c as large", f"cast(ceil((n - b.n) / {BLOCK}) as int) as rows", f"cast(ceil(n / {BLOCK}) as int) as cols")
    df = df.join(sizes, "g").selectExpr("g", "node", "mask", "c", "c <> large as other", "cast(pmod(xxhash64(node), rows) as int) as row", "cast(pmod(xxhash64(node), cols) as int) as col", "rows", "cols")
    df = df.join(held.select("node", "size", "sketch"), "node")
    at = "transform(sequence(0, rows - 1), i -> struct(i, col as j))"
    at = f"case when other then array_distinct(concat(transform(sequence(0, cols - 1), j -> struct(row as i, j)), {at})) else {at} end"
    df = df.withColumn("at", F.explode(F.expr(at))).select("g", "at.i", "at.j", *CELL[3:], "size", "sketch")
    return in_cells(df, buckets)


def in_cells(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "g", "i", "j").sortWithinPartitions("g", "i", "j")


def whole_cells(batches) -> Iterator[pa.Table]:
    """Tables of whole cells of rows in order, of about BLOCK rows, or BYTES, where cells are small."""
    held, n, size = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        size += b.nbytes
        if n >= BLOCK or size >= BYTES:
            t = pa.Table.from_batches(held).combine_chunks()
            g, i, j = (t.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begin = 0
            for cut in new.tolist():  # the last cell may go on
                if cut - begin >= BLOCK or cut == new[-1]:
                    yield t.slice(begin, cut - begin).combine_chunks()
                    begin = cut
            rest = t.slice(begin).combine_chunks()
            held, n, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def one(c: pa.ChunkedArray) -> pa.Array:
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def pairs_of(t: pa.Table, near: Near) -> tuple[np.ndarray, ...]:
    """Places a, b of the pairs within cells that may be similar and are of different components, their differences d, and each row's cell."""
    g, i, j, node, c, other, row, col, mask, size = (t.column(k).to_numpy() for k in range(10))
    sketch = one(t.column(10))
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    cell = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(g))[cell]
    later = end - np.arange(len(g)) - 1
    stop = np.cumsum(later)
    at_row, at_col = other & (row == i), col == j
    out = []
    for k in range(0, int(stop[-1]), 1 << 20):
        x = np.arange(k, min(k + (1 << 20), int(stop[-1])))
        a = np.searchsorted(stop, x, "right")
        b = a + 1 + x - (stop[a] - later[a])
        # Of two sets outside the largest component, the lesser stands in the row: so the pair is met in one cell.
        met = at_row[a] & at_col[b] & (~other[b] | (node[a] < node[b])) | at_row[b] & at_col[a] & (~other[a] | (node[b] < node[a]))
        fit = met & (c[a] != c[b])
        a, b = a[fit], b[fit]
        d, may = near(sketch, size, mask, a, b)
        out.append((a[may], b[may], d[may]))
    a, b, d = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 3
    return a, b, d, cell


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs a, b that span all labels connected by pairs, the least ones that do: each label takes its least pair, until none is left."""
    taken = []
    while len(a):
        parent = np.arange(int(label.max()) + 1)
        la, lb = label[a], label[b]
        order = np.lexsort((np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), d))
        best = np.full(len(parent), len(a))
        rank = np.empty(len(a), np.int64)
        rank[order] = np.arange(len(a))
        np.minimum.at(best, la, rank)
        np.minimum.at(best, lb, rank)
        has = np.flatnonzero(best < len(a))
        pick = order[best[has]]
        taken.append(np.stack((a[pick], b[pick])))
        parent[has] = np.where(la[pick] == has, lb[pick], la[pick])
        mutual = (parent[parent] == np.arange(len(parent))) & (np.arange(len(parent)) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
        apart = label[a] != label[b]
        a, b, d = a[apart], b[apart], d[apart]
    return tuple(np.unique(np.concatenate(taken, axis=1), axis=1)) if taken else (np.zeros(0, np.int64),) * 2


def marked(rows: DataFrame, near: Near) -> DataFrame:
    """The rows of CELL of those sets that have some pair left in their cell."""
    names = [*CELL, "size", "sketch"]

    def run(batches):
        for t in whole_cells(batches):
            a, b, _, _ = pairs_of(t, near)
            if len(a):
                some = t.take(pa.array(np.union1d(a, b)))
                yield from some.select(names).combine_chunks().to_batches()

    return rows.select(*names).mapInArrow(light(run), rows.select(*names).schema)


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """node and the bytes of its set."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x.as_buffer().to_pybytes() if x.is_valid else None, n).tobytes() for x in part.column(1)], pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(light(run), "node long, hashes binary")


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at places a and b."""
    used = np.union1d(a, b)
    lens = np.array([len(sets[k]) for k in used])
    ids = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)[1].ravel()
    first = np.cumsum(lens) - lens
    a, b = np.searchsorted(used, a), np.searchsorted(used, b)
    out, held = np.empty(len(a), np.int64), np.zeros(int(ids.max()) + 1, np.int64)
    order = np.argsort(a, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        own = ids[first[a[part[0]]] :][: lens[a[part[0]]]]
        held[own] = 1
        for k in range(0, len(part), 512):
            some = part[k : k + 512]
            size = lens[b[some]]
            start = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(start, size) + np.repeat(first[b[some]], size)
            out[some] = np.add.reduceat(held[ids[at]], start)
        held[own] = 0
    return out


def links_within(rows: DataFrame, near: Near, similar: int) -> DataFrame:
    """Links (u, v), u above v, within cells of rows of CELL with size, sketch and hashes: as few as connect the components that links connect."""

    def run(batches):
        for t in whole_cells(batches):
            a, b, d, cell = pairs_of(t, near)
            if not len(a):
                continue
            node, c = t.column(3).to_numpy(), t.column(4).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column(11).to_pylist()]
            both, size = common(sets, a, b), t.column(9).to_numpy()
            ok = 100 * both >= similar * (size[a] + size[b] - both)
            a, b = forest(a[ok], b[ok], d[ok], node, np.unique(np.stack((cell, c), 1), axis=0, return_inverse=True)[1].ravel())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(f(node[a], node[b])) for f in (np.maximum, np.minimum)], ["u", "v"])

    return rows.select(*CELL, "size", "sketch", "hashes").mapInArrow(light(run), "u long, v long")


def linked(docs: DataFrame, members: DataFrame, held: DataFrame, near: Near, likely: Callable[[DataFrame], DataFrame], n: int, similar: int) -> DataFrame:
    """(node, comp) of all nodes with links. members: (g, node, w, mask) of the groups; held: (node, size, sketch, rt, rd); both are read several times, so
    pass written tables. likely() sieves the first pairs (u, v) by sketches; mask goes to near()."""
    with batches_of(docs.sparkSession, ROWS):  # texts and sets by the ten thousand are much memory
        return _linked(docs, members, held, near, likely, n, similar)


def _linked(docs: DataFrame, members: DataFrame, held: DataFrame, near: Near, likely: Callable[[DataFrame], DataFrame], n: int, similar: int) -> DataFrame:
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = written(likely(stars(members)), "pairs")
    wanted = lambda nodes: held.drop("sketch").join(nodes.distinct(), "node", "left_semi")
    texts = written(texts_of(docs, wanted(pairs.selectExpr("u as node").union(pairs.selectExpr("v as node")))), "texts")
    links = written(tested(pairs, texts, n, similar), "links")
    drop(texts)
    comp = components(links)
    rows = written(marked(cells(members, comp, held, buckets), near), "cells")
    if rows.isEmpty():
        return comp
    sets = written(sets_of(texts_of(docs, wanted(rows.select("node"))), n), "sets")
    more = written(links_within(in_cells(rows.join(sets, "node"), buckets), near, similar), "links")
    drop(sets)
    drop(rows)
    return comp if more.isEmpty() else components(links.union(more))
