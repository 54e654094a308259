"""Cross-entropy difference of two matched word bigram models.

The target model is trained on the documents labelled as good, the background model on all. Both use
one vocabulary, the words of all documents, and the same smoothing: a bigram's count is filled up with
BETA times the unigram probability, and a unigram's with ALPHA. The score of a document is the mean,
over its words, of target loss minus background loss in nats; low scores look like the target.

A task hashes the words of its documents and packs them into chunks of some million words. The
distinct unigrams and bigrams of a chunk, with their counts in both corpora, go as sorted binary rows
to the bucket of their hash, whose task adds up all chunks and answers each chunk with the corpus
counts of what it asked. Answers come in the order of the sorted grams, so a chunk reads them off
without a lookup table; no model is ever whole in one place. Every chunk asks every bucket, be it for
nothing, and tells it its words: so each bucket knows the words of both corpora, and each chunk learns
from its answers how many different words there are. Nothing is stored or collected in between. A gram that is in every document reaches
its bucket once per chunk. A chunk is named by its partition and its number there, so that chunks of
equal contents stay apart, and a task that is run again gives the same names.

Defined cases: null or blank text has no words and null losses and score; several labels of a document
count once, by the highest quality; null ids have no label; without any target document its model is
the uniform one; repeated rows count and are scored each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches_of, documents, give_back, light, sift, written
from quire.llm.sets import _WORDS, WORDS_KEPT, mix

ALPHA, BETA = 0.1, 5.0
CHUNK = 4_000_000
#: Asked grams that a bucket's task sorts at once, and words of which losses are worked out at once.
MET, SLICE = 400_000, 1 << 19
#: Rows that a task is sent at once.
ROWS = 256
#: Word before the first of a document.
START = np.uint64(0x5851F42D4C957F2D)
#: Hashes keep so many bits: at 10^12 grams, one in 300 equals another's. The last bit tells unigrams.
BITS = 48


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; sorted or small ones shrink well."""
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 3)


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(dtype)[:, 0] if data else np.zeros(0, dtype)


def steps(x: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    return packed(np.diff(x, prepend=np.zeros(1, x.dtype)))


def counted(distinct: np.ndarray, at: np.ndarray, lens: np.ndarray, target: np.ndarray | None) -> tuple:
    """The grams of a chunk in order, where each word's three grams are among them, and both counts if asked for.

    A chunk is documents of lens words laid end to end, each word as a place in distinct, the hashes of
    its different words. A word's grams are itself, the word before and both; only the last need sorting.
    """
    n, u = len(at), len(distinct)
    start = (np.cumsum(lens) - lens)[lens > 0]
    shift = np.uint64(64 - BITS)
    prior = np.empty(n, np.int32)  # place of the word before; u stands for the start of a document
    prior[1:] = at[:-1]
    prior[start] = u
    words = np.append(distinct, START)
    pair = np.empty(n, np.uint64)
    for a in range(0, n, SLICE):
        x = slice(a, a + SLICE)
        pair[x] = mix(words[prior[x]] * np.uint64(0x9E3779B97F4A7C15) + words[at[x]]) >> shift & ~np.uint64(1)
    order = np.argsort(pair)
    pair = pair[order]
    new = np.concatenate(([True], pair[1:] != pair[:-1]))
    pairs = pair[new]
    both = np.empty(n, np.int32)
    both[order] = np.cumsum(new, dtype=np.int32) - 1
    del pair, order, new
    found = np.concatenate((mix(words + np.uint64(1)) >> shift | np.uint64(1), pairs))
    order = np.argsort(found)
    place = np.empty(len(found), np.int32)
    place[order] = np.arange(len(found), dtype=np.int32)
    found = found[order]
    counts = []
    for some in () if target is None else (None, np.repeat(target, lens)):
        heads = len(start) if some is None else int(np.count_nonzero(some[start]))
        a, b = (at, both) if some is None else (at[some], both[some])
        counts.append(np.concatenate((np.bincount(a, minlength=u), [heads], np.bincount(b, minlength=len(pairs)))).astype(np.uint32)[order])
    return found, place[:u][at], place[prior], place[u + 1 :][both], *(counts or (None, None))


ROW = "kind string, bucket int, chunk long, n long, m long, v long, a binary, b binary, c binary, d binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]


def row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES)], NAMES)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and whether the document is of the target."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("_good"))
    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    some, none = sift(df, "doc_id", good, "_good")
    some = some.join(good, some["doc_id"] == good["_good"], "left").select("doc_id", "text", F.col("_good").isNotNull().alias("target"))
    return some.union(none.select("doc_id", "text", F.lit(False).alias("target")))


def exchanged(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of kind chunk (the documents as word hashes) and answer (the counts of its grams, by bucket).

    n and m are words and target words, of the chunk or, in an answer, of all; v is the bucket's different words.
    """

    def ask(batches):
        ids, lens, target, held, n = [], [], [], [], 0
        names = itertools.count(TaskContext.get().partitionId() << 32)

        def flush():
            words = np.concatenate(held)
            held.clear()
            distinct, at, times = np.unique(words, return_inverse=True, return_counts=True)
            del words
            # Frequent words first, in order of their hashes within a class: both arrays then pack well.
            order = np.lexsort((distinct, -np.frexp(times.astype(float))[1]))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            distinct, at = distinct[order], place[at]
            size, good = np.array(lens, np.int64), np.array(target, bool)
            found, _, _, _, both, goods = counted(distinct, at, size, good)
            name, own = next(names), int(size[good].sum())
            head = np.array([i if i is not None else 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes()
            yield row("chunk", int(mix(np.array([name], np.uint64))[0] % np.uint64(buckets)), name, n, own, None, zstandard.compress(head, 1), packed(size.astype("<u4")), packed(distinct), packed(at.astype("<u4")))
            bucket = (found >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                s = slice(cut[k], cut[k + 1])
                asked = (steps(found[s]), packed(both[s]), packed(goods[s])) if cut[k] < cut[k + 1] else (b"",) * 3
                yield row("ask", k, name, n, own, None, *asked, None)

        for b in batches:
            for doc, text, good in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                found = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if len(_WORDS) > WORDS_KEPT:
                    _WORDS.clear()
                ids.append(doc)
                lens.append(len(found))
                target.append(good)
                held.append(np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found)))
                n += len(found)
                if n > CHUNK:
                    yield from flush()
                    ids, lens, target, held, n = [], [], [], [], 0
                    give_back()
        if n:
            yield from flush()
        elif ids:  # documents without words alone
            yield row("blank", 0, 0, len(ids), 0, None, zstandard.compress(np.array([i if i is not None else 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes(), 1), None, None, None)

    def answer(batches):
        asked: dict[int, list[tuple]] = {}
        for b in batches:
            plain = pa.compute.not_equal(b.column(0), "ask")
            if b.filter(plain).num_rows:
                yield b.filter(plain)
            for x in b.filter(pa.compute.equal(b.column(0), "ask")).to_pylist():
                asked.setdefault(x["bucket"], []).append((x["chunk"], x["a"], x["b"], x["c"], x["n"], x["m"]))
        for k in list(asked):
            asks = asked.pop(k)
            parts = [np.cumsum(unpacked(a, "<u8")) for _, a, *_ in asks]
            counts = [[unpacked(x[i], "<u4") for x in asks] for i in (2, 3)]
            names_, size, good = [x[0] for x in asks], sum(x[4] for x in asks), sum(x[5] for x in asks)
            del asks
            # The bucket is answered stretch by stretch of hashes, each of about MET asked grams.
            low, high = min((int(p[0]) for p in parts if len(p)), default=0), max((int(p[-1]) for p in parts if len(p)), default=0)
            steps_ = sum(map(len, parts)) // MET + 1
            edges = [low + (high - low) * j // steps_ for j in range(1, steps_)]
            cuts = [np.concatenate(([0], np.searchsorted(p, np.array(edges, np.uint64)), [len(p)])) for p in parts]
            told = [[np.empty(len(p), "<u4") for p in parts] for _ in (0, 1)]
            different = 0
            for j in range(steps_):
                some = [slice(c[j], c[j + 1]) for c in cuts]
                found, at = np.unique(np.concatenate([p[x] for p, x in zip(parts, some)]), return_inverse=True)
                different += int((found & np.uint64(1)).sum())
                ends = np.cumsum([x.stop - x.start for x in some])
                for c, out in zip(counts, told):
                    total = np.bincount(at, weights=np.concatenate([y[x] for y, x in zip(c, some)]), minlength=len(found))
                    if len(total) and total.max() >= 1 << 32:
                        out[:] = [o.astype("<u8") for o in out]
                    total = total.astype("<u8")[at]
                    for o, x, e in zip(out, some, ends):
                        o[x] = total[e - (x.stop - x.start) : e]
            for chunk, both, goods in zip(names_, *told):
                yield row("answer", k, chunk, size, good, different, *(packed(x.astype("<u8")) if len(x) else b"" for x in (both, goods)), None, None)

    return df.mapInArrow(light(ask), ROW).repartition(buckets, "bucket").mapInArrow(light(answer), ROW)


def scored(rows: DataFrame, buckets: int) -> DataFrame:
    """Losses of each document of the chunks."""

    def run(batches):
        chunks: dict[int, dict] = {}
        answers: dict[int, dict[int, tuple]] = {}
        for b in batches:
            for x in b.to_pylist():
                if x["kind"] == "answer":
                    answers.setdefault(x["chunk"], {})[x["bucket"]] = (x["a"], x["b"], x["n"], x["m"], x["v"])
                elif x["kind"] == "chunk":
                    chunks[x["chunk"]] = x
                else:
                    head = np.frombuffer(zstandard.decompress(x["a"]), np.uint8)
                    yield table(head, x["n"], np.zeros(x["n"], np.int64), None)
        for name in list(chunks):
            x, got = chunks.pop(name), answers.pop(name)
            lens = unpacked(x["b"], "<u4").astype(np.int64)
            size, good = map(float, next(iter(got.values()))[2:4])
            vocabulary = sum(y[4] for y in got.values()) - 1  # without the start
            _, w, v, b, _, _ = counted(unpacked(x["c"], "<u8"), unpacked(x["d"], "<u4"), lens, None)
            losses = []
            for i, n in ((1, good), (0, size)):
                c = np.concatenate([unpacked(got[k][i], "<u8") for k in sorted(got)]).astype(np.float64)
                ends = np.zeros(len(w) + 1)
                for s in range(0, len(w), SLICE):
                    y = slice(s, s + SLICE)
                    p = (c[w[y]] + ALPHA) / (n + ALPHA * vocabulary)
                    ends[1:][y] = -np.log((c[b[y]] + BETA * p) / (c[v[y]] + BETA))
                np.cumsum(ends, out=ends)
                stop = np.cumsum(lens)
                losses.append(ends[stop] - ends[stop - lens])
            yield table(np.frombuffer(zstandard.decompress(x["a"]), np.uint8), len(lens), lens, losses)
            del w, v, b, c, ends, losses, got, x
            give_back()

    def table(head, n, lens, losses):
        ids = pa.array(head[: 8 * n].view("<i8"), mask=head[8 * n :] > 0)
        empty = lens == 0
        mean = [pa.array(np.zeros(n) if losses is None else x / np.maximum(lens, 1), mask=empty) for x in (losses or [None, None])]
        diff = pa.array(np.zeros(n) if losses is None else (losses[0] - losses[1]) / np.maximum(lens, 1), mask=empty)
        return pa.RecordBatch.from_arrays([ids, pa.array(lens, pa.int64()), *mean, diff], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return rows.repartition(buckets, "chunk").mapInArrow(light(run), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: words, mean target and background loss, and their difference, the score."""
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with batches_of(docs.sparkSession, ROWS):  # while the scores are made: packed rows by the ten thousand are much memory
        return written(scored(exchanged(labelled(docs, labels), buckets), buckets), "scores")


def op10(spark, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
