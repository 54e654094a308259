"""Jaccard join of word shingles with PartEnum signatures.

Two sets of sizes a and b have a Jaccard similarity of 0.8 or more just if they differ in at most
(a + b) / 9 elements. Sizes fall into bands whose ends are a factor 1.25 apart, so partners lie in one
band or in two adjacent ones; level i serves band i and the one above, with the largest difference k
of such a pair. At a level the domain of shingle hashes is cut into ranges, and a set emits a
signature, the hash of its elements, for each enumerated subset of ranges:

- k of 15 or less: k + 2 (or, up to 3, k + 3) ranges and all subsets that leave out k of them;
- above: more than k / 2 parts of two ranges each and every single range; some part has one difference
  at most, and one of its ranges none.

So every pair of partners has a subset in which both are equal. Where it could be that such subsets
are empty in both, which each set can tell by its own empty ranges, the set also emits the signatures
of another cut of the domain.

A task packs its signatures by bucket into few binary rows, equal sets once. The task of a bucket
sorts them and gives the groups of sets that share a signature. Links are not sought between all
pairs of a group: each member is tested against the group's first set, exactly, on all shingles, unless
the profiles of both, counts in ranges of hashes, already show that they differ too much;
sets found connected need no test among each other, sets that have met all others leave the group, and
rounds with more first sets go on until no group holds two components.

Defined cases: null or blank text has an empty set and links with nothing; fewer than five words form
one shingle; equal sets are one node, so any number of copies costs no pairs; null doc_ids don't take
part in the smallest id, and a component of null ids alone has a null id; other columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import documents, drop, light, sift, written
from quire.llm.graph import components
from quire.llm.sets import MULTIPLIERS, mix, set_key
from quire.llm.sets import shingles as of_words

SHINGLE = 5
#: Similar: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
FAMILIES = 6
#: Members of a group that one task compares with each other, or with as many others.
BLOCK = 1024


def shingles(text: str | bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the 5-word shingles of a text."""
    return of_words(text, SHINGLE)


@lru_cache(None)
def band(size: int) -> int:
    """Index of the band of a size."""
    i, low = 0, 1
    while size > low * 5 // 4:
        i, low = i + 1, low * 5 // 4 + 1
    return i


@lru_cache(None)
def difference(level: int) -> int:
    """The largest difference of partners at a level."""
    low = 1
    for _ in range(level):
        low = low * 5 // 4 + 1
    top = low * 5 // 4
    return (top + top * 5 // 4) // 9


@lru_cache(None)
def subsets(k: int) -> tuple[int, np.ndarray, int]:
    """Number of ranges, the enumerated subsets, and the most empty ranges with which none can fail."""
    if k == 0:
        return 1, np.array([[0]]), 0
    if k <= 15:
        size = 3 if k <= 3 else 2
        return k + size, np.array(list(itertools.combinations(range(k + size), size))), size - 1
    spare = k // 16 + 3
    parts = k // 2 + 1 + spare
    return 2 * parts, np.arange(2 * parts)[:, None], spare


def signatures(s: np.ndarray) -> np.ndarray:
    """The signatures of a set of sorted hashes."""
    if not len(s):
        return s
    out = []
    i = band(len(s))
    for level in {max(i - 1, 0), i}:
        n, chosen, most = subsets(difference(level))
        for family in range(FAMILIES):
            x = s if family == 0 else np.sort(mix(s + np.uint64(family)))
            at = ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            sums = np.zeros(n, np.uint64)
            sums[at[first]] = np.add.reduceat(mix(x ^ np.uint64(level * FAMILIES + family + 1)), first)
            full = np.zeros(n, bool)
            full[at[first]] = True
            # With most or fewer empty ranges, a subset without differences isn't empty for some good choice.
            flagged = n - len(first) > most
            use = full[chosen].any(axis=1) if not flagged or family < FAMILIES - 1 else np.ones(len(chosen), bool)
            mixed = mix(sums[chosen].sum(axis=1, dtype=np.uint64) + np.arange(1, len(chosen) + 1, dtype=np.uint64) * MULTIPLIERS[0] + np.uint64(level * FAMILIES + family))
            out.append(mixed[use])
            if not flagged:
                break
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's hashes in ranges, of which there are 2 to 4 for each hash, 256 at least.

    Two sets differ in at least as many elements as these bits; one half of the bits xor the other are
    the bits of half as many ranges.
    """
    bits = max(256, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 256
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shared(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over the texts of docs: rows (kind 'row': doc_id, t, size, key, ref, sketch) and groups (kind 'member': g, ref).

    t is the hash of the text, to find it again. ref numbers the different sets that a task of the scan
    met, null where it met the set before; a group holds two or more of them that share a signature. g is
    a hash of the members, so equal groups have one g.
    """
    names = ["bucket", "blob", "doc_id", "t", "size", "key", "ref", "sketch"]
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def batch(**given):
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, types)], names)

    def pack(batches):
        base = TaskContext.get().partitionId() << 32
        lens, sigs, seen, held = [], [], set(), 0

        def blobs():
            sig = np.concatenate(sigs)
            who = np.repeat(np.arange(len(lens), dtype=np.uint32), lens)
            bucket = ((sig >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, who, bucket = sig[order], who[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            at, out = [], []
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                # Numbers ascend: their steps are small. Of a signature's 8 bytes 5 go.
                step = np.diff(who[cut[k] : cut[k + 1]], prepend=np.uint32(0))
                low = sig[cut[k] : cut[k + 1]].view(np.uint8).reshape(-1, 8)[:, :5]
                step = zstandard.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                out.append(np.array([base, len(low), len(step)], np.int64).tobytes() + step + low.tobytes())
                at.append(k)
            return batch(bucket=at, blob=out)

        for b in batches:
            found = []
            for text in b.column(2):
                s = shingles(text.as_py())
                k = set_key(s)
                new = len(s) > 0 and k not in seen
                found.append((len(s), k, base + len(lens) if new else None, sketch(s) if new else None))
                if new:
                    seen.add(k)
                    sigs.append(signatures(s))
                    lens.append(len(sigs[-1]))
                    held += lens[-1]
            if found:
                yield batch(doc_id=b.column(0), t=b.column(1), **{c: [x[i] for x in found] for i, c in enumerate(names[4:])})
            if held > 4_000_000:
                yield blobs()
                base += len(lens)
                lens, sigs, held = [], [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
        if lens:
            yield blobs()

    plain_names = names[2:]

    def groups(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            plain = b.filter(b.column(1).is_null())
            n = plain.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), pa.nulls(n, pa.int64()), *plain.columns[2:]], ["kind", "g", *plain_names])
            packed = b.filter(b.column(1).is_valid())
            for k, blob in zip(packed.column(0).to_pylist(), packed.column(1)):
                by.setdefault(k, []).append(blob.as_py())
        for k in list(by):
            g, ref = grouped(by.pop(k))
            n = len(g)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(["member"] * n), pa.array(g.view(np.int64)), *[pa.array(ref) if c == "ref" else pa.nulls(n, t) for c, t in zip(plain_names, types[2:])]], ["kind", "g", *plain_names])

    def grouped(blobs):
        sigs, refs = [], []
        for blob in blobs:
            base, n, length = np.frombuffer(blob, np.int64, 3).tolist()
            step = np.frombuffer(zstandard.decompress(blob[24 : 24 + length]), np.uint8).reshape(4, n)
            refs.append(base + np.cumsum(np.ascontiguousarray(step.T).view(np.uint32)[:, 0], dtype=np.int64))
            low = np.zeros((n, 8), np.uint8)
            low[:, :5] = np.frombuffer(blob, np.uint8, offset=24 + length).reshape(n, 5)
            sigs.append(low.view(np.uint64)[:, 0])
        sig, ref = np.concatenate(sigs), np.concatenate(refs)
        order = np.argsort(sig)
        sig, ref = sig[order], ref[order]
        same = sig[1:] == sig[:-1]
        inside = np.concatenate((same, [False])) | np.concatenate(([False], same))
        sig, ref = sig[inside], ref[inside]
        order = np.lexsort((ref, sig))
        sig, ref = sig[order], ref[order]
        once = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])))[: len(sig)]
        sig, ref = sig[once], ref[once]
        if not len(sig):
            return sig, ref
        begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(begin, len(sig)))
        name = np.add.reduceat(mix(ref.view(np.uint64) + np.uint64(1)), begin)
        keep = np.zeros(len(begin), bool)
        keep[np.unique(name, return_index=True)[1]] = True
        keep &= size > 1
        take = np.repeat(keep, size)
        return np.repeat(name, size)[take], ref[take]

    packed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("t"), docs["text"].alias("text"))
    columns = "doc_id long, t long, size long, key binary, ref long, sketch binary"
    packed = packed.mapInArrow(light(pack), f"bucket int, blob binary, {columns}")
    packed = packed.withColumn("bucket", F.coalesce("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, t), {buckets}) as int)")))
    return packed.repartition(buckets, "bucket").mapInArrow(light(groups), f"kind string, g long, {columns}")


def cells(groups: DataFrame, held: DataFrame, comp: DataFrame | None, buckets: int) -> DataFrame:
    """Rows of groups (g, node) with c, the component, size and sketch; cells (g, i, j) in order within tasks.

    Groups of one component are left out. A group of more than BLOCK members is cut into blocks, and its
    cell (i, j) holds blocks i and j, so no task meets a large group whole.
    """
    df = groups if comp is None else groups.join(comp, "node", "left")
    df = df.withColumn("c", F.col("node") if comp is None else F.coalesce("comp", "node"))
    sizes = df.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z")
    df = df.join(sizes.selectExpr("g", f"cast(ceil(n / {BLOCK}) as int) as blocks"), "g").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    df = df.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr("g", "least(block, other) as i", "greatest(block, other) as j", "block", "node", "c")
    df = df.join(held.select("node", "size", "sketch"), "node").select("g", "i", "j", "block", "node", "c", "size", "sketch")
    return df.repartition(buckets, "g", "i", "j").sortWithinPartitions("g", "i", "j")


def pairs_of(members: pa.Table) -> tuple[np.ndarray, ...]:
    """Places a, b of the pairs of a table of whole cells that may be similar and aren't connected, the least number of differences d, and the members' cells."""
    g, i, j, block, node, c, size = (members.column(k).to_numpy() for k in range(7))
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    cell = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(g))[cell]
    later = end - np.arange(len(g)) - 1
    a = np.repeat(np.arange(len(g)), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    fit = (c[a] != c[b]) & (9 * np.abs(size[a] - size[b]) <= size[a] + size[b]) & ((block[a] != block[b]) | (i[a] == j[a]))
    a, b = a[fit], b[fit]
    bits = members.column(7).combine_chunks()
    width = np.diff(np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1, bits.offset * 4))
    narrow = np.minimum(width[a], width[b])
    d = np.zeros(len(a), np.int32)
    for w in np.unique(narrow).tolist():
        own, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        x = np.frombuffer(b"".join(bits.take(pa.array(own)).to_pylist()), np.uint64).reshape(-1, w // 8)
        y = np.frombuffer(b"".join(bits.take(pa.array(twice)).to_pylist()), np.uint64).reshape(-1, w // 4)
        x = np.concatenate((x, y[:, : w // 8] ^ y[:, w // 8 :]))
        place = np.empty(len(width), np.int64)
        place[own], place[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
        at = np.flatnonzero(narrow == w)
        for k in range(0, len(at), step := max(1, (1 << 22) // w)):
            some = at[k : k + step]
            d[some] = np.bitwise_count(x[place[a[some]]] ^ x[place[b[some]]]).sum(axis=1)
    near = 9 * d <= size[a] + size[b]
    return a[near], b[near], d[near], cell


def nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member that is in a pair: its place and the number of its least pair."""
    rank = np.empty(len(a), np.int64)
    order = np.lexsort((np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), d))
    rank[order] = np.arange(len(a))
    best = np.full(len(node), len(a))
    np.minimum.at(best, a, rank)
    np.minimum.at(best, b, rank)
    has = np.flatnonzero(best < len(a))
    return has, order[best[has]]


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Numbers of pairs that span all labels connected by pairs, the least ones that do: each label takes its least pair, until none is left."""
    taken = []
    while len(a):
        parent = np.arange(int(label.max()) + 1)
        at = np.arange(len(a))
        la, lb = label[a], label[b]
        order = np.lexsort((np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), d))
        best = np.full(len(parent), len(a))
        rank = np.empty(len(a), np.int64)
        rank[order] = at
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
    return np.unique(np.concatenate(taken, axis=1), axis=1) if taken else np.zeros((2, 0), np.int64)


def candidates(rows: DataFrame, kind: str) -> DataFrame:
    """Pairs (g, u, v, d) within cells that may be similar: 'nearest': each member u with its nearest v; 'forest': as few as
    connect the components that pairs connect; 'all': all of different components."""

    def told(members):
        node, c = members.column(4).to_numpy(), members.column(5).to_numpy()
        a, b, d, cell = pairs_of(members)
        if kind == "nearest":
            u, at = nearest(a, b, d, node)
            a, b, d = u, np.where(a[at] == u, b[at], a[at]), d[at]
        elif kind == "forest":
            names = np.stack((cell, c), 1)
            label = np.unique(names, axis=0, return_inverse=True)[1].ravel()
            a, b = forest(a, b, d, node, label)
            d = np.zeros(len(a), np.int32)
        for k in range(0, len(a), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(members.column(0).to_numpy()[a[s]]), pa.array(node[a[s]]), pa.array(node[b[s]]), pa.array(d[s].astype(np.int32))], ["g", "u", "v", "d"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                t = pa.Table.from_batches(held)
                keys = [t.column(k).to_numpy() for k in range(3)]
                new = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
                # Whole cells of some members at a time; the last cell may go on.
                begin = 0
                for cut in new.tolist():
                    if cut - begin >= BLOCK // 2 or cut == new[-1]:
                        yield from told(t.slice(begin, cut - begin))
                        begin = cut
                rest = t.slice(begin)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield from told(pa.Table.from_batches(held))

    return rows.mapInArrow(light(run), "g long, u long, v long, d int")


def tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links, by their whole texts; texts has node and text of every set named in them.

    The text of v joins first; then rows meet the text of u in tasks by u and a salt, so that the pairs
    of one hot u are spread.
    """
    salts = 8

    def compare(batches):
        last, x = None, None
        for b in batches:
            linked = []
            for u, s, t in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if u != last:
                    last, x = u, shingles(s.as_py())
                y = shingles(t.as_py())
                both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
                linked.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    at = F.expr(f"pmod(xxhash64(v), {salts})")
    left = pairs.withColumn("salt", at).join(texts.selectExpr("node as v", "text as y"), "v")
    right = pairs.select("u", at.alias("salt")).distinct().join(texts.selectExpr("node as u", "text as x"), "u")
    return left.join(right, ["u", "salt"]).select("u", "v", "x", "y").mapInArrow(light(compare), "u long, v long")


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, t, size, key) of docs, and comp (key, comp) of the keys that have links; comp is a key, too.

    The pairs that may be similar are tested in three rounds, so that a group of many similar sets costs
    few tests: of each set its nearest one; of the components found then, in each group, as few pairs
    as connect them; and last all pairs that still are of different components and weren't tested.
    """
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = written(shared(docs, buckets), "shared")
    rows = found.where("kind = 'row'").select("doc_id", "t", "size", "key")
    refs = found.where("kind = 'row' and ref is not null").select("ref", "key", "t", "doc_id", "size", "sketch")
    # The least ref of equal sets stands for them.
    members = found.where("kind = 'member'").select("g", "ref")
    used = refs.select("ref", "key").join(members.select("ref").distinct(), "ref", "left_semi")
    nodes = written(used.join(used.groupBy("key").agg(F.min("ref").alias("node")), "key"), "nodes")
    groups = written(members.join(nodes.select("ref", "node"), "ref").select("g", "node").distinct(), "groups")
    held = refs.join(nodes.where("ref = node").select("ref"), "ref", "left_semi").withColumnRenamed("ref", "node")
    held = written(held.selectExpr("node", "size", "sketch", "t as rt", "doc_id as rd"), "held")
    near = written(candidates(cells(groups, held, None, buckets), "nearest"), "near")
    drop(groups)
    alive = held.drop("sketch").join(near.select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    texts = docs.select(F.xxhash64(docs["text"]).alias("t"), docs["doc_id"].cast("long").alias("d"), docs["text"].alias("text"))
    texts, _ = sift(texts, "t", alive, "rt")
    texts = written(texts.join(alive, (F.col("t") == F.col("rt")) & F.col("d").eqNullSafe(F.col("rd"))).select("node", "text").dropDuplicates(["node"]), "texts")
    pairs = near.groupBy("u").agg(F.min(F.struct("d", "v")).alias("b")).selectExpr("least(u, b.v) as u", "greatest(u, b.v) as v").distinct()
    groups = near.select("g", F.col("u").alias("node")).distinct()
    links = done = comp = None
    for kind in ("forest", "all", None):
        pairs = written(pairs, "pairs")
        new = written(tested(pairs, texts), "tested")
        done = pairs if done is None else done.union(pairs)
        links = new if links is None else links.union(new)
        if comp is None or not new.isEmpty():
            comp = components(links)
        if kind:
            pairs = candidates(cells(groups, held, comp, buckets), kind)
            pairs = pairs.selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct().join(done, ["u", "v"], "left_anti")
    keys = nodes.where("ref = node").select("key", "node")
    comp = comp.join(keys, "node").drop("node").join(keys.selectExpr("key as c", "node as comp"), "comp")
    return rows, written(comp.selectExpr("key", "c as comp"), "comp")


def classes(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """component_id of each key: the smallest doc_id of its component."""
    keys = rows.where("size > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(comp, "key", "left")
    keys = written(keys.withColumn("comp", F.coalesce("comp", "key")), "keys")
    return keys.join(keys.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("key", "component_id")


def similar(docs: DataFrame) -> DataFrame:
    """One row per document: the size of its set and the smallest doc_id that links reach from it."""
    rows, comp = joined(docs)
    out = rows.join(classes(rows, comp), "key", "left")
    return out.selectExpr("doc_id", "size as n_shingles", "case when size = 0 then doc_id else component_id end as component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with one of each component: that of the smallest doc_id, of equals the first text. Own columns only."""
    rows, comp = joined(docs)
    ids = rows.where("size > 0").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    best = ids.groupBy("comp").agg(F.min(F.struct(F.expr("doc_id is null"), "doc_id", "t")).alias("b"))
    best = written(best.selectExpr("b.doc_id as _d", "b.t as _t", "comp"), "best")
    empty = rows.where("size = 0").selectExpr("doc_id as _d", "t as _t").distinct()
    own = [f"c{i}" for i in range(len(docs.columns))]
    df = docs.toDF(*own)
    df = df.withColumns({"_d": F.col(own[docs.columns.index("doc_id")]).cast("long"), "_t": F.xxhash64(own[docs.columns.index("text")])})
    marks = best.select("_d", "_t", F.lit(True).alias("_one")).union(empty.withColumn("_one", F.lit(False)))
    marks = marks.selectExpr("_d as _md", "_t as _mt", "_one")
    hit = df.join(marks, df["_t"].eqNullSafe(marks["_mt"]) & df["_d"].eqNullSafe(marks["_md"]))
    every = hit.where("not _one").select(*own)
    # Rows that are equal in id and text: one of them stays.
    single = hit.where("_one").groupBy("_d", "_t").agg(*[F.first(c).alias(c) for c in own]).select(*own)
    return every.union(single).toDF(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir))
