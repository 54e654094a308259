"""Fill-in-middle rearrangement of texts, cut at units.

A text is cut into units: up to ``width`` characters other than the breaks, closed early by a break
character, which belongs to the unit that it closes. Lines are units without a width, closed by a newline.
Two hashed numbers choose two places between units, and prefix, suffix and middle are put out in one
of two orders behind their sentinels.

One Aho-Corasick automaton finds the break characters and the sentinels in one pass over a text. Only these events
are kept. The gap between two events holds no break, so its number of units follows from its length
alone; sums of them rank the events, and the place after any number of units is found by binary
search among the ranks and division within a gap. Texts that hold a sentinel stay plain, so the same automaton finds in an
output just the three sentinels that were put there, and the exact text is rebuilt from output and form.

Each text is worked on where it lies; nothing is shuffled, and a task holds the events of one text.

Defined cases: null text is empty; an empty text, or one with a sentinel, is plain: the output is the text, and
prefix_chars and middle_chars are null; places may fall together, then parts are empty; very long texts are
one scan, their events one array; a null doc_id hashes as no digits; rows that repeat have equal
results; other columns are left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.bpe import column_strings, portions
from quire.llm.common import documents, light

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rearranged, and of 100 of these so many put the suffix first; salt of the hashed numbers.
RATE, SUFFIX_FIRST, SALT = 100, 50, "7"
#: Bytes of text that a task works on at once.
BYTES = 8_000_000


@dataclass(frozen=True)
class Units:
    """What ends a unit: break characters (ASCII), and after so many others its width (None: no bound)."""

    breaks: str = "\n"
    width: int | None = None

    def __post_init__(self):
        if not self.breaks.isascii() or self.width is not None and self.width < 1:
            raise ValueError("breaks are ASCII characters, and a width is 1 at least")


LINES = Units()


@lru_cache(None)
def automaton(breaks: str) -> ahocorasick.Automaton:
    """Finds break characters (value 0) and the sentinels (values 1 to 3)."""
    found = ahocorasick.Automaton()
    for b in breaks:
        found.add_word(b, 0)
    for i, s in enumerate((PREFIX, SUFFIX, MIDDLE), 1):
        found.add_word(s, i)
    found.make_automaton()
    return found


class Scan:
    """The events of a text, and its units by their ranks."""

    def __init__(self, text: str, units: Units = LINES):
        events = list(automaton(units.breaks).iter(text))
        self.sentinels = [(end - 2, kind) for end, kind in events if kind]
        breaks = np.array([end for end, kind in events if not kind], np.int64)
        self.width = units.width or len(text) + 1
        #: Starts of gaps, and units that end before each; the last gap has no break.
        self.start = np.concatenate(([0], breaks + 1))
        inside = np.diff(np.append(self.start, len(text)))
        closed = (inside[:-1] - 1) // self.width + 1
        self.before = np.concatenate(([0], np.cumsum(closed)))
        self.size = len(text)
        self.n = int(self.before[-1] + -(-inside[-1] // self.width))

    def after(self, k: int) -> int:
        """Characters of the first k units."""
        gap = int(np.searchsorted(self.before, k, "right")) - 1
        return int(min(self.start[gap] + (k - self.before[gap]) * self.width, self.size))


def numbers(doc_id: int | None, salt: str = SALT) -> list[int]:
    """The first four groups of 8 digits of a hash of the id."""
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: str, h: list[int], units: Units = LINES, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle, and output."""
    scan = Scan(text, units)
    if not text or scan.sentinels or h[2] % 100 >= rate:
        return scan.n, "plain", None, None, text
    a, b = sorted((scan.after(h[0] % (scan.n + 1)), scan.after(h[1] % (scan.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return scan.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return scan.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that was arranged."""
    if form == "plain":
        return output
    (_, _), (second, _), (third, _) = Scan(output).sentinels
    one, two, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    return one + middle + two if form == "psm" else two + middle + one


COLUMNS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def texts_of(batches, text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some bytes of text."""
    for b in batches:
        at = 0
        for take in portions(b.column(text), BYTES):
            yield b.slice(at, take)
            at += take


def rearrange(docs: DataFrame, units: Units = LINES, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> DataFrame:
    """Per document: n units, form, characters of prefix and middle, and the output text."""

    def run(batches):
        for b in texts_of(batches, 1):
            rows = [(d, *arranged(t or "", numbers(d, salt), units, rate, suffix_first)) for d, t in zip(b.column(0).to_pylist(), column_strings(b.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), COLUMNS)], [n for n, _ in COLUMNS])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return own.mapInArrow(light(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rearranged: DataFrame) -> DataFrame:
    """doc_id and text of rearranged rows (doc_id, form, output)."""

    def run(batches):
        for b in texts_of(batches, 2):
            texts = [restored(o, f) for f, o in zip(b.column(1).to_pylist(), column_strings(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rearranged.select("doc_id", "form", "output").mapInArrow(light(run), "doc_id long, text string")


def digest(docs: DataFrame, **options) -> DataFrame:
    """rearrange() with the hashes of the output and of the text rebuilt from output and form, in place of the output."""

    def run(batches):
        for b in texts_of(batches, 5):
            hashes = [[], []]
            for f, o in zip(b.column(2).to_pylist(), column_strings(b.column(5))):
                for to, x in zip(hashes, (o, restored(o, f))):
                    to.append(hashlib.sha256(x.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *map(pa.array, hashes)], [*[n for n, _ in COLUMNS[:5]], "output_sha256", "restored_sha256"])

    return rearrange(docs, **options).mapInArrow(light(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


SQL = r"""
with cut as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
places as (select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from cut),
forms as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from places),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from forms)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from parts"""
