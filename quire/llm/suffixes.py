"""Removing long repeats with a logarithmic family of suffix arrays.

A byte goes when a string of ``LONG`` bytes that covers it also starts anywhere else. The index holds
sampled suffixes: of every string of LONG bytes the suffix that begins at its least fingerprint of
GRAM bytes. Equal strings sample at equal offsets, so a suffix that shares its first GRAM bytes with no
other rules out all strings that sample it. A suffix array is the sampled suffixes of a batch in the
order of the fingerprint of those bytes, then of all bytes that its strings span.

What a text is made of is a ``Unit``: bytes, or words, whose strings are passages of so many words
whatever their bytes. Places are counted in units until a text is cut. One family holds the suffixes of
all units that are asked for, each entry with the number of its own.

A batch's suffix array is merge-scanned against every level of the family, and then becomes a level
itself; levels of equal size merge, so there are as many as the logarithm of the number of batches.
All is cut into buckets by fingerprint, which are scanned and merged by independent tasks. In a scan,

- suffixes that agree in all bytes that their strings span are repeats: their stretch goes, and one of
  them stays in the index for later batches. A task of the first pass already does this among its own
  documents, so that a passage in most documents reaches its bucket once per task;
- suffixes that agree in GRAM bytes but not in all are contested: their strings are hashed one by one
  in a second pass over the documents concerned, and meet by fingerprint and offset.

The result is exact (up to equal 64-bit hashes of different strings within one fingerprint and offset).

Defined cases: null text is empty; texts of fewer than LONG bytes lose nothing; repeated rows are
documents of their own, and so remove each other; texts of any length are worked on stretch by stretch,
whole; null ids are kept apart by the hash of the text;
other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, documents, drop, light, sift, written
from quire.llm.sets import _WORDS, WORDS_KEPT, mix

LONG = 400
GRAM = 200
#: Window starts handled at once; a task's suffixes before it packs them; batches that op3 adds.
STRETCH = 1 << 16
PACKED = 400_000
BATCHES = 4
OFFSETS = 16
SPACES = " \t\n\v\f\r"
#: Bytes of entries that a bucket is meant to hold; a text has about four tenths of its bytes.
BUCKET_BYTES = 32 << 20
BASE = 0x9E3779B97F4A7C15 | 1
ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("t", "<i8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("null", "u1"), ("many", "u1"), ("unit", "u1")])

_T = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass(frozen=True)
class Unit:
    """Strings of so many units, the units of their fingerprints, and the offsets whose strings travel together when contested."""

    long: int
    gram: int
    offsets: int
    words: bool = False

    def codes(self, text: pa.Scalar) -> np.ndarray:
        """Bytes, or hashes of words."""
        if not text.is_valid:
            return np.zeros(0, np.uint8)
        if not self.words:
            return np.frombuffer(text.as_buffer() or b"", np.uint8)
        found = text.as_buffer().to_pybytes().split()
        if len(_WORDS) > WORDS_KEPT:
            _WORDS.clear()
        return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))

    def in_bytes(self, data: bytes, a: list[dict] | None) -> list[dict]:
        """Spans of units as spans of bytes; that of a passage reaches to the next word, if there is one."""
        if not self.words or not a:
            return a or []
        at = [m.span() for m in re.finditer(WORD.encode(), data)]
        return [{"start": at[x["start"]][0], "stop": at[x["stop"]][0] if x["stop"] < len(at) else at[-1][1]} for x in a]


BYTES = Unit(LONG, GRAM, OFFSETS)
#: Passages of over 50 words, of which there are about as many samples as of BYTES.
PASSAGES = Unit(51, 20, 8, words=True)
_SPAN = STRETCH + LONG + 1
_UP = _powers(BASE, _SPAN)
_DOWN = _powers(pow(BASE, -1, 1 << 64), _SPAN)


class Hashes:
    """Hashes of all strings within a stretch of bytes or of hashed words."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_T[data] if data.dtype == np.uint8 else data) * _UP[: len(data)], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * _DOWN[begin])

    def every(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * _DOWN[:m])


def stretches(data: np.ndarray, long: int):
    """(first unit, units) of parts that hold every string of so many units once."""
    for at in range(0, len(data) - long + 1, STRETCH):
        yield at, data[at : at + STRETCH + long - 1]


def sampled(data: np.ndarray, unit: Unit = BYTES):
    """Of a text's units: fingerprint h, hash c, place, and first and last start of the strings of each sampled suffix."""
    out = []
    for at, part in stretches(data, unit.long):
        hashes = Hashes(part)
        grams = hashes.every(unit.gram)
        least = (grams & ~np.uint64(0x1FFFF)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        span = unit.long - unit.gram + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: width - span], least[span - width :])
        place = (least & np.uint64(0x1FFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        pos = place[first]
        c = hashes.of(first, last + unit.long) + ((pos - first) * 1009 + (pos - last)).astype(np.uint64) * np.uint64(BASE)
        # The least of many fingerprints is small: mixed anew, so that buckets are even.
        out.append((mix(grams[pos]), c, pos + at, first + at, last + at))
    if not out:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def entries(data: np.ndarray, doc: int | None, t: int, unit: Unit = BYTES, number: int = 0) -> np.ndarray:
    h, c, pos, first, last = sampled(data, unit)
    e = np.zeros(len(h), ENTRY)
    e["h"], e["c"], e["doc"], e["t"], e["pos"], e["null"], e["unit"] = h, c, doc or 0, t, pos, doc is None, number
    e["lo"], e["hi"] = pos - first, pos - last
    return e


def ordered(e: np.ndarray) -> np.ndarray:
    """Entries in the order of a suffix array."""
    return e[np.lexsort((e["c"], e["h"]))]


def merged_arrays(arrays: list[np.ndarray]) -> np.ndarray:
    """Suffix arrays merged into one: the stable sort joins runs that are in order, and only entries of one fingerprint are then sorted."""
    e = np.concatenate(arrays)
    e = e[np.argsort(e["h"], kind="stable")]
    same = e["h"][1:] == e["h"][:-1]
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same))) if len(e) else []
    if len(tied):
        e[tied] = ordered(e[tied])
    return e


def repeats(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a suffix array: the entries that are repeats, and the array with one of each kind of entries."""
    if not len(e):
        return e, e
    new = np.concatenate(([True], (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(e)))
    many = np.logical_or.reduceat(e["many"] > 0, first) | (size > 1)
    gone = e[np.repeat(many, size) & (e["many"] == 0)]
    one = e[first].copy()
    one["many"] = many
    return gone, one


def contested(one: np.ndarray) -> np.ndarray:
    """Of a suffix array without repeats: the entries that share their fingerprint with another."""
    same = one["h"][1:] == one["h"][:-1]
    return one[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(one) else one


#: Numbers before the hashes of strings of a contested entry.
HEAD = 9
ROW = "kind string, doc long, t long, start long, stop long, h long, hi int, many boolean, bucket int, blob binary, unit int"
NAMES = ["kind", "doc", "t", "start", "stop", "h", "hi", "many", "bucket", "blob", "unit"]
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int32()]


def rows(kind: str, n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, TYPES[0]) if c == "kind" else given[c].cast(t) if c in given else pa.nulls(n, t) for c, t in zip(NAMES, TYPES)], NAMES)


def ids(e: np.ndarray) -> pa.Array:
    return pa.array(e["doc"], pa.int64(), mask=e["null"] > 0)


def spans(e: np.ndarray, units: tuple[Unit, ...]) -> pa.RecordBatch:
    """The units that the strings of repeats cover; stretches of one document and unit that touch become one."""
    pos = e["pos"].astype(np.int64)
    start, stop = pos - e["lo"], pos - e["hi"] + np.array([u.long for u in units])[e["unit"]]
    order = np.lexsort((start, e["unit"], e["t"], e["doc"], e["null"]))
    e, start, stop = e[order], start[order], stop[order]
    apart = start[1:] > stop[:-1]
    for c in ("doc", "t", "null", "unit"):
        apart |= e[c][1:] != e[c][:-1]
    first = np.flatnonzero(np.concatenate(([True], apart)))
    e, start, stop = e[first], start[first], stop[np.append(first[1:], len(stop)) - 1]
    return rows("span", len(e), doc=ids(e), t=pa.array(e["t"]), start=pa.array(start), stop=pa.array(stop), unit=pa.array(e["unit"]))


def rivals(e: np.ndarray, bucket: int) -> pa.RecordBatch:
    """Contested entries: where their strings start, to be hashed one by one."""
    pos = e["pos"].astype(np.int64)
    return rows("rival", len(e), doc=ids(e), t=pa.array(e["t"]), start=pa.array(pos - e["lo"]), stop=pa.array(pos - e["hi"]), h=pa.array(e["h"].view(np.int64)), hi=pa.array(e["hi"].astype(np.int32)), many=pa.array(e["many"] > 0), unit=pa.array(e["unit"]))


class Family:
    """Levels of suffix arrays: rank -> table (bucket, blob), in the shared folder."""

    def __init__(self, spark, buckets: int | None = None, units: tuple[Unit, ...] = (BYTES,)):
        self.units = units
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: dict[int, DataFrame] = {}
        self.tables: list[DataFrame] = []

    def add(self, docs: DataFrame, store: bool = True) -> DataFrame:
        """Merge-scan docs (doc, t, text) as a batch; gives its table of spans and rivals.

        These include those of earlier batches that have met their like only now. store=False leaves
        the family as it was.
        """
        rank = 0
        while rank in self.levels:
            rank += 1
        merged = set(range(rank))
        buckets, units = self.buckets, self.units

        def pack(batches):
            held, n = [], 0

            def flush():
                gone, one = repeats(ordered(np.concatenate(held)))
                if len(gone):
                    yield spans(gone, units)
                at = ((one["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # h ascends, so does at
                cut = np.searchsorted(at, np.arange(buckets + 1))
                blobs = [(k, one[cut[k] : cut[k + 1]].tobytes()) for k in range(buckets) if cut[k] < cut[k + 1]]
                yield rows("run", len(blobs), bucket=pa.array([k for k, _ in blobs], pa.int32()), blob=pa.array([x for _, x in blobs], pa.binary()))

            for b in batches:
                for doc, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    for number, unit in enumerate(units):
                        data = unit.codes(text)
                        if len(data) >= unit.long:
                            held.append(entries(data, doc, t, unit, number))
                            n += len(held[-1])
                    if n > PACKED:
                        yield from flush()
                        held, n = [], 0
            if n:
                yield from flush()

        def scan(batches):
            runs: dict[int, list[bytes]] = {}
            old: dict[int, dict[int, list[bytes]]] = {}  # by rank
            for b in batches:
                plain = b.filter(b.column(9).is_null())
                if plain.num_rows:
                    yield plain
                b = b.filter(b.column(9).is_valid())
                for kind, k, blob in zip(b.column(0).to_pylist(), b.column(8).to_pylist(), b.column(9)):
                    of = runs if kind == "run" else old.setdefault(int(kind), {})
                    of.setdefault(k, []).append(blob.as_py())
            for k in set(runs).union(*old.values()):
                levels = {r: read(x.pop(k)) for r, x in old.items() if k in x}
                batch = merged_arrays([np.zeros(0, ENTRY), *(read([x]) for x in runs.pop(k, []))])
                gone, one = repeats(merged_arrays([batch, *levels.values()]))
                if len(gone):
                    yield spans(gone, units)
                # Rivals within a level were told when it came to be.
                new = np.isin(one["h"], batch["h"])
                c = contested(one[new])
                if len(c):
                    yield rivals(c, k)
                if store:
                    into = repeats(merged_arrays([batch, *(x for r, x in levels.items() if r in merged)]))[1]
                    yield rows("level", 1, bucket=pa.array([k], pa.int32()), blob=pa.array([into.tobytes()], pa.binary()))

        source = docs.select("doc", "t", "text").mapInArrow(light(pack), ROW)
        # A span may go anywhere: its bucket is free, and copies of a text go to different ones.
        source = source.withColumn("bucket", F.coalesce("bucket", F.expr(f"cast(pmod(xxhash64(doc, t, start), {buckets}) as int)")))
        for r, level in self.levels.items():
            source = source.unionByName(level.withColumn("kind", F.lit(str(r))), allowMissingColumns=True)
        out = written(source.repartition(buckets, "bucket").mapInArrow(light(scan), ROW), "scan")
        self.tables.append(out)
        if store:
            for r in merged:
                del self.levels[r]
            self.levels[rank] = out.where("kind = 'level'").select("bucket", "blob")
        return out


def read(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), ENTRY)


def settled(found: DataFrame, docs: DataFrame, buckets: int, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """Spans (doc, t, unit, start, stop) of contested suffixes: their strings are hashed one by one."""
    rivals_ = found.where("kind = 'rival'").groupBy("doc", "t").agg(F.collect_set(F.struct("unit", "start", "stop", "h", "hi", "many")).alias("a"))
    df = rivals_.withColumnRenamed("doc", "rd").withColumnRenamed("t", "rt")
    docs, _ = sift(docs, "t", df, "rt")
    one = docs.join(df, docs["t"].eqNullSafe(df["rt"]) & docs["doc"].eqNullSafe(df["rd"]))

    def hashes(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                yield from pack(b.slice(i, 256))

    def pack(b):
        by: dict[int, list[bytes]] = {}
        for doc, t, text, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            codes: dict[int, np.ndarray] = {}
            for x in a:
                if x["unit"] not in codes:
                    codes[x["unit"]] = units[x["unit"]].codes(text)
                data, unit = codes[x["unit"]], units[x["unit"]]
                first, last = x["start"], x["stop"]
                w = Hashes(data[first : last + unit.long]).every(unit.long)
                # Offsets ascend from the last string on; those of one block of offsets travel together.
                w = w[::-1]
                n = last - first + 1
                at = 0
                while at < n:
                    offset = x["hi"] + at
                    take = min(n - at, unit.offsets - offset % unit.offsets)
                    head = np.array([x["h"], offset, take, doc or 0, doc is None, t, last - at, x["many"], x["unit"]], np.int64)
                    k = int(mix(np.array([x["h"] & (1 << 64) - 1], np.uint64) + np.uint64(offset // unit.offsets))[0] >> np.uint64(40)) * buckets >> 24
                    by.setdefault(k, []).append(head.tobytes() + w[at : at + take].tobytes())
                    at += take
        if by:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([b"".join(v) for v in by.values()], pa.binary())], ["bucket", "blob"])

    long = np.array([u.long for u in units])

    def meet(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                by.setdefault(k, []).append(blob.as_py())
        for k in list(by):
            flat = np.frombuffer(b"".join(by.pop(k)), np.int64)
            at, places = 0, []
            while at < len(flat):
                places.append(at)
                at += HEAD + int(flat[at + 2])
            if not places:
                continue
            places = np.array(places)
            head = flat[places[:, None] + np.arange(HEAD)]
            take = head[:, 2]
            owner = np.repeat(np.arange(len(places)), take)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
            value = flat[places[owner] + HEAD + step].view(np.uint64)
            key = mix(head[owner, 0].view(np.uint64) + (head[owner, 1] + step).astype(np.uint64) * np.uint64(BASE))
            order = np.lexsort((value, key))
            same = (key[order][1:] == key[order][:-1]) & (value[order][1:] == value[order][:-1])
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            hit = order[twice]
            hit = np.sort(hit[head[owner[hit], 7] == 0])
            if len(hit):
                # Strings of one entry that follow each other make one span; starts descend as offsets ascend.
                new = np.flatnonzero(np.concatenate(([True], (owner[hit][1:] != owner[hit][:-1]) | (step[hit][1:] != step[hit][:-1] + 1))))
                end = np.append(new[1:], len(hit)) - 1
                o = head[owner[hit[new]]]
                yield pa.RecordBatch.from_arrays([pa.array(o[:, 3], mask=o[:, 4] > 0), pa.array(o[:, 5]), pa.array(o[:, 8], pa.int32()), pa.array(o[:, 6] - step[hit[end]]), pa.array(o[:, 6] - step[hit[new]] + long[o[:, 8]])], ["doc", "t", "unit", "start", "stop"])

    packed = one.select("doc", "t", "text", "a").mapInArrow(light(hashes), "bucket int, blob binary")
    return written(packed.repartition(buckets, "bucket").mapInArrow(light(meet), "doc long, t long, unit int, start long, stop long"), "settled")


def removals(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """doc, t and the spans (unit, start, stop) of each document that has any, as a table; docs: doc, t, text. The family's own tables go."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    family = Family(spark, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size * len(units) * 4 // 10 // BUCKET_BYTES), units)
    part = F.pmod(F.shiftright("t", 17), F.lit(BATCHES))
    found = None
    for k in range(BATCHES):
        got = family.add(docs.where(F.coalesce(part, F.lit(0)) == k), store=k < BATCHES - 1)
        found = got if found is None else found.unionByName(got)
    late = settled(found, docs, family.buckets, units)
    every = found.where("kind = 'span'").select("doc", "t", "unit", "start", "stop").union(late)
    out = written(every.groupBy("doc", "t").agg(F.array_sort(F.collect_set(F.struct("unit", "start", "stop"))).alias("spans")), "spans")
    for table in (*family.tables, late):
        drop(table)
    return out


def named(docs: DataFrame) -> DataFrame:
    """doc, t (hash of the text) and text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["text"]).alias("t"), docs["text"].alias("text"))


def stretched(a: list[list[int]]) -> list[list[int]]:
    """Stretches in order, those that touch as one."""
    out: list[list[int]] = []
    for start, stop in sorted(a):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def merged(a: list[dict] | None) -> list[list[int]]:
    return stretched([[x["start"], x["stop"]] for x in a or ()])


def left(data: bytes, cuts: list[list[int]]) -> bytes:
    at, parts = 0, []
    for a, z in cuts:
        parts.append(data[at:a])
        at = z
    return b"".join([*parts, data[at:]])


def with_spans(docs: DataFrame, extra: list[tuple[str, str]], units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """doc, t, text, the extra columns under their new names, and the spans of all units (null: none)."""
    names = ["doc", "t", "text", *(n for _, n in extra)]
    df = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["text"]).alias("t"), docs["text"].alias("text"), *[docs[c].alias(n) for c, n in extra])
    spans_ = removals(df.select("doc", "t", "text"), units).select(F.col("doc").alias("sd"), F.col("t").alias("st"), "spans")
    some, none = sift(df, "t", spans_, "st")
    some = some.join(spans_, some["t"].eqNullSafe(spans_["st"]) & some["doc"].eqNullSafe(spans_["sd"]), "left").select(*names, "spans")
    return some.unionByName(none.select(*names).withColumn("spans", F.lit(None).cast(spans_.schema["spans"].dataType)))


def cuts_of(data: bytes, a: list[dict] | None, units: tuple[Unit, ...]) -> list[list[list[int]]]:
    """Of each unit the stretches of bytes that its spans cover."""
    return [merged(u.in_bytes(data, [x for x in a or () if x["unit"] == k])) for k, u in enumerate(units)]


def digest(docs: DataFrame, passages: Unit | None = None) -> DataFrame:
    """Per document: its bytes, those removed by strings of LONG bytes and their runs, and the hash of what is left.

    With passages also the bytes and runs of those that repeat, and the hash of what both leave.
    """
    units = (BYTES, passages) if passages else (BYTES,)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passage_bytes", "n_passages", "left_sha256"] * bool(passages)
    types = [pa.int64()] * 3 + [pa.string()] + [pa.int64(), pa.int64(), pa.string()] * bool(passages)

    def run(batches):
        for b in batches:
            out = []
            for text, a in zip(b.column(1), b.column(2).to_pylist()):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                cuts, *more = cuts_of(data, a, units)
                kept = hashlib.sha256(left(data, cuts)).hexdigest()
                out.append((len(data), sum(z - a for a, z in cuts), len(cuts), kept))
                for said in more:
                    both = hashlib.sha256(left(data, stretched(cuts + said))).hexdigest() if said else kept
                    out[-1] += (sum(z - a for a, z in said), len(said), both)
            cols = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    schema = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return with_spans(docs, [], units).select("doc", "text", "spans").mapInArrow(light(run), schema)


def without_repeats(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """docs with the repeats of all units cut out of their texts, with their own columns; texts that were cut to nothing go.

    Repeats of each unit are judged on the whole input. Bytes of a character that is cut through are dropped.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = own[docs.columns.index("text")]
    void = SPACES if any(u.words for u in units) else ""

    def cut(batches):
        for b in batches:
            i, n = b.schema.get_field_index(at), len(own)
            texts, stay = [], []
            for text, a in zip(b.column(i), b.column(n).to_pylist()):
                if a:
                    data = text.as_buffer().to_pybytes()
                    texts.append(left(data, stretched(sum(cuts_of(data, a, units), []))).decode("utf-8", "ignore"))
                    stay.append(bool(texts[-1].strip(void) if void else texts[-1]))
                else:
                    texts.append(text.as_py())
                    stay.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == i else b.column(k) for k in range(n)], own).filter(pa.array(stay, pa.bool_()))

    df = with_spans(docs, list(zip(docs.columns, own)), units)
    return df.select(*own, "spans").mapInArrow(light(cut), df.select(*own).schema).toDF(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes, as the contract has it, and beside them passages of over 50 words, which mostly have fewer bytes."""
    return digest(documents(spark, sf_dir), PASSAGES)
