"""Token ids in Re-Pair compressed shards.

Documents are put in order of doc_id by range partitions; each task encodes its stretch and writes it
as shards. In a shard frequent pairs of neighbouring ids are replaced by nonterminals, round after
round: first within the distinct chunks of text, weighted by how often they occur, then along the
documents, until no pair is frequent or no symbol is left. A round takes the most frequent pairs at once
and replaces their occurrences from left to right. No nonterminal crosses the end of a document, so documents can be decoded by themselves.

A shard is a row of a Parquet table in the shared folder, its file format: ``docs`` and ``nulls``
(ids), ``tokens`` and ``symbols`` (their numbers per document), ``rules`` (the two symbols of each
nonterminal), ``lengths`` (ids that each expands to) and ``sequence``, symbols of two bytes. With the
lengths any stretch of ids is found and decoded without the rest.

Ids equal those of the tokenizers library (see bpe, whose encoder is used, since the library's own
takes most of the time allowed). Defined cases: null text is empty and has the end id alone; null
doc_ids come first; documents of one doc_id are ordered by the hash of their text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import BYTES, CHUNKS_KEPT, chunks_of, gathered, portions, vocabulary_path
from quire.llm.common import documents, light, written

END = 2
#: Symbols are two bytes: as many rules a shard as are left above the vocabulary.
SYMBOLS = 1 << 16
#: Ids a shard, about; new rules a round; least count of a pair.
SHARD = 6_000_000
RULES, LEAST = 4000, 8


def round_of(seq: np.ndarray, owner: np.ndarray, weight: np.ndarray | None, rules: list[np.ndarray], base: int, room: int):
    """One round: the most frequent pairs of neighbours with one owner become nonterminals."""
    if len(seq) < 2 or not room:
        return seq, owner
    key = seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:].astype(np.uint32)
    inside = owner[1:] == owner[:-1]
    if weight is None:
        found, count = np.unique(key[inside], return_counts=True)
    else:
        order = np.argsort(key[inside])
        k = key[inside][order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        found = k[first]
        count = np.add.reduceat(weight[owner[:-1][inside][order]], first) if len(k) else first
    often = count >= LEAST
    found, count = found[often], count[often]
    room = min(room, RULES)
    if len(found) > room:
        keep = np.argpartition(-count, room - 1)[:room]
        found = np.sort(found[keep])
    if not len(found):
        return seq, owner
    begins_, ends_ = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
    begins_[found >> np.uint32(16)] = True
    ends_[found & np.uint32(0xFFFF)] = True
    maybe = np.flatnonzero(inside & begins_[seq[:-1]] & ends_[seq[1:]])
    at = np.minimum(np.searchsorted(found, key[maybe]), len(found) - 1)
    same = found[at] == key[maybe]
    hit, rule = maybe[same], at[same]
    # Neighbouring hits overlap: of a run every second is taken.
    begins = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
    run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
    even = (np.arange(len(hit)) - run) % 2 == 0
    hit, rule = hit[even], rule[even]
    seq = seq.copy()
    seq[hit] = base + rule
    stay = np.ones(len(seq), bool)
    stay[hit + 1] = False
    rules.append(np.stack((found >> 16, found & 0xFFFF), 1).astype(np.uint16))
    return seq[stay], owner[stay]


def compress(flat: np.ndarray, sizes: np.ndarray, every: np.ndarray, lens: np.ndarray, terminals: int) -> dict:
    """A shard of documents of lens chunks each, all laid end to end; flat and sizes are the chunks' ids."""
    times = np.bincount(every, minlength=len(sizes))
    used = np.flatnonzero(times)
    place = np.zeros(len(sizes), np.int64)
    place[used] = np.arange(len(used))
    every, weight = place[every], times[used]
    seq, n = gathered(flat, sizes, used).astype(np.uint16), sizes[used]
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    tokens = np.bincount(doc, weights=n[every], minlength=len(lens)).astype(np.int64) + 1
    rules: list[np.ndarray] = []
    owner = np.repeat(np.arange(len(used)), n)
    made, room = 0, SYMBOLS - terminals
    # Rounds go on until no pair is frequent or no symbol is left; chunks leave about a quarter to the documents.
    while 10 * made < 7 * room:
        seq, owner = round_of(seq, owner, weight, rules, terminals + made, room - made)
        if made == (made := sum(map(len, rules))):
            break
    n = np.bincount(owner, minlength=len(used))
    seq, owner = gathered(seq, n, every), np.repeat(doc, n[every])
    while made < room:
        seq, owner = round_of(seq, owner, None, rules, terminals + made, room - made)
        if made == (made := sum(map(len, rules))):
            break
    symbols = np.bincount(owner, minlength=len(lens)).astype(np.int64)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    # The end id follows each document's symbols.
    seq = np.insert(seq, np.cumsum(symbols), END).astype("<u2")
    return {"tokens": tokens, "symbols": symbols + 1, "rules": table, "lengths": lengths(table, terminals)[terminals:], "sequence": seq, "terminals": terminals}


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each symbol expands to. A rule's parts come from earlier rounds."""
    out = np.zeros(terminals + len(rules), np.int64)
    out[:terminals] = 1
    todo = np.arange(len(rules))
    while len(todo):
        sums = out[rules[todo, 0]] * (out[rules[todo, 0]] > 0) + out[rules[todo, 1]]
        ready = (out[rules[todo, 0]] > 0) & (out[rules[todo, 1]] > 0)
        out[terminals + todo[ready]] = sums[ready]
        todo = todo[~ready]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of symbols. First the rules are opened, round after round, then all symbols at once."""
    n = np.concatenate((np.ones(terminals, np.int64), np.full(len(rules), 2)))
    body = np.concatenate((np.arange(terminals), rules.astype(np.int64).ravel()))
    while len(body) and body.max() >= terminals:
        owner = np.repeat(np.arange(len(n)), n)
        open_ = n[body]
        body, n = gathered(body, n, body), np.bincount(owner, weights=open_, minlength=len(n)).astype(np.int64)
    return gathered(body.astype(np.int32), n, seq.astype(np.int64))


def stretch(shard: dict, start: int, n: int) -> np.ndarray:
    """n ids of a shard from place start on, by the expansion lengths of its symbols alone."""
    size = np.concatenate((np.ones(shard["terminals"], np.int64), shard["lengths"]))[shard["sequence"]]
    ends = np.cumsum(size)
    a = int(np.searchsorted(ends, start, "right"))
    z = int(np.searchsorted(ends, start + n, "left")) + 1
    before = int(ends[a - 1]) if a else 0
    return expand(shard["sequence"][a:z], shard["rules"], shard["terminals"])[start - before : start - before + n]


SHARDS = "part int, piece int, n_tokens long, terminals int, docs binary, nulls binary, tokens binary, symbols binary, rules binary, lengths binary, sequence binary"


def shards(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The table of shards of docs, written to the shared folder and read back."""
    path = path or vocabulary_path()
    keys = ["doc", "t"]
    df = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["text"]).alias("t"), docs["text"].alias("text"))
    df = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "doc", "text")

    def run(batches):
        worker = chunks_of(path)
        terminals = len(worker.vocabulary.tokens)
        part, piece, held, counts, names, n = None, 0, [], [], [], 0

        def flush():
            flat, sizes = worker.table()
            s = compress(flat, sizes, np.concatenate(held), np.concatenate(counts), terminals)
            ids = np.array([d or 0 for d in names], "<i8")
            row = [part, piece, int(s["tokens"].sum()), terminals, ids.tobytes(), np.array([d is None for d in names], "u1").tobytes(), s["tokens"].astype("<u4").tobytes(), s["symbols"].astype("<u4").tobytes(), s["rules"].astype("<u2").tobytes(), s["lengths"].astype("<u4").tobytes(), s["sequence"].tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in SHARDS.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            at = 0
            for take in portions(b.column(2), BYTES):
                found, lens = worker.numbers(b.column(2).slice(at, take))
                held.append(found)
                counts.append(lens)
                names += b.column(1).slice(at, take).to_pylist()
                at += take
                n += len(found) * 5 // 2
                if n > SHARD:
                    yield flush()
                    piece, held, counts, names, n = piece + 1, [], [], [], 0
                    if len(worker.number) > CHUNKS_KEPT:
                        worker.clear()
        if names:
            yield flush()
        if len(worker.number) > CHUNKS_KEPT:
            worker.clear()

    return written(df.mapInArrow(light(run), SHARDS), "ids")


def shard_of(row: dict) -> dict:
    """The arrays of a row of the table of shards."""
    return {
        "terminals": row["terminals"], "docs": np.frombuffer(row["docs"], "<i8"), "nulls": np.frombuffer(row["nulls"], "u1"), "tokens": np.frombuffer(row["tokens"], "<u4").astype(np.int64),
        "symbols": np.frombuffer(row["symbols"], "<u4").astype(np.int64), "rules": np.frombuffer(row["rules"], "<u2").reshape(-1, 2), "lengths": np.frombuffer(row["lengths"], "<u4").astype(np.int64), "sequence": np.frombuffer(row["sequence"], "<u2"),
    }


def digest(table: DataFrame) -> DataFrame:
    """Per document of a table of shards: its first place, its number of ids and their crc32."""
    sizes = table.select("part", "piece", "n_tokens")
    # One row a shard of some million ids: the places of shards are summed in two steps, parts first.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = sizes.withColumn("own", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("piece")) - F.col("n_tokens")).join(parts, "part")
    df = table.drop("n_tokens").join(placed.selectExpr("part", "piece", "before + own as start"), ["part", "piece"])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = shard_of(row)
                ids = expand(s["sequence"], s["rules"], s["terminals"]).astype("<u4")
                ends = np.cumsum(s["tokens"])
                crc = [zlib.crc32(ids[a:z]) for a, z in zip((ends - s["tokens"]).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s["docs"], mask=s["nulls"] > 0), pa.array(ends - s["tokens"] + row["start"]), pa.array(s["tokens"]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(light(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(spark, sf_dir: str) -> DataFrame:
    return digest(shards(documents(spark, sf_dir)))
