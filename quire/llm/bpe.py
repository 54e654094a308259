"""BPE encoding and decoding in batched numpy merge rounds.

A vocabulary file of the tokenizers library with word ends is applied: special tokens are cut out,
text is split on white space into chunks, and each chunk that a task has not met before is normalised
(NFC, lower case) and split into words. The library itself only helps to split chunks with characters
beyond U+052F, whose classes differ between versions of Unicode. The symbols of all new words lie in one
flat array. A round looks up the rank of every adjacent pair by binary search over the sorted pair
keys, takes the lowest rank of each word, merges its occurrences from left to right, and closes the
gaps; words without a pair leave the array.

A pair's merge always ranks after the merges that make its two symbols (checked when the file is
read), so merging all occurrences of a word's lowest pair at once equals merging one by one.

Texts are encoded where they lie, nothing is shuffled. Each Python worker keeps the chunks it met,
up to a bound, and then starts anew, so memory is bounded; results never depend on it.

Defined cases: null text is empty and has no ids; texts of any length are cut into chunks, not
prefixes; repeated rows and null ids are encoded like others; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from quire.llm.common import documents, light

WORD_BPE = "word_bpe_49k.json"
#: Chunks that a worker keeps, and characters of text that it takes at once.
KEPT = 500_000
SLICE = 2_000_000
#: The same of workers that keep ids as numbers, and bytes of text they take at once.
CHUNKS_KEPT, BYTES = 400_000, 8_000_000
#: Chunks that encode() keeps from one task to the next.
BETWEEN = 100_000
#: White space of the file's normaliser; str.split() also splits at the four separators, which it does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Below these characters all versions of Unicode in use agree on letters and digits.
UNSTABLE = regex.compile("[\u0530-\U0010ffff]")
NONE = np.iinfo(np.int32).max
SHIFT = np.uint32(16)


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The merges of a file as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.uint32)
        self.last = np.array([vocab[c + end] for c in symbols], np.uint32)
        made = {}
        keys, ids = [], []
        if len(self.tokens) > 1 << 16:
            raise ValueError("pair keys hold ids of 16 bits")
        for rank, (a, b) in enumerate(model["merges"]):
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("a merge comes before its parts")
            made.setdefault(a + b, rank)
            keys.append(vocab[a] << 16 | vocab[b])
            ids.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.uint32), kind="stable")
        self.keys = np.array(keys, np.uint32)[order]
        self.ranks = order.astype(np.int32)
        self.ids = np.array(ids, np.uint32)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.lines = regex.compile(split + "|\\n")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(split), "removed", invert=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.marks = {s[:2] for s in self.special}

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each; no word is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.uint32), lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        same = word[1:] == word[:-1]
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that a symbol begins
        inside = np.flatnonzero(same)
        rank[inside] = self.rank(sym[inside] << SHIFT | sym[inside + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            open_ = least != NONE
            lowest = np.repeat(least, size)
            if not open_.all():
                active = np.repeat(open_, size)
                done_sym.append(sym[~active])
                done_word.append(word[~active])
                sym, word, rank, lowest = sym[active], word[active], rank[active], lowest[active]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == lowest)
            # Of occurrences that overlap, as in a run of one symbol, every second is merged.
            begins = np.concatenate(([True], at[1:] != at[:-1] + 1))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.ids[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # places after the gaps close: one gap for each merge before
            sym, word, rank = sym[stay], word[stay], rank[stay]
            # Only the pairs that a merged symbol begins or ends have changed.
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(touched)
            next_ = np.minimum(changed + 1, len(sym) - 1)
            pair = (word[changed] == word[next_]) & (next_ > changed)
            rank[changed] = NONE
            c = changed[pair]
            rank[c] = self.rank(sym[c] << SHIFT | sym[c + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def pieces(self, text: str) -> list[str]:
        """Chunks of a text and special tokens, in order; no chunk holds white space."""
        if any(m in text for m in self.marks):
            parts = self.cut.split(text)
        else:
            parts = [text]
        out: list[str] = []
        for p in parts:
            if p in self.special:
                out.append(p)
            elif any(c in p for c in SEPARATORS):
                out += [x for x in WHITE.split(p) if x]
            else:
                out += p.split()
        return out

    def split_words(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The normalised words of chunks without special tokens, and how many each chunk has."""
        joined = unicodedata.normalize("NFC", "\n".join(chunks))
        # Sigma stays medial at word ends, so it is lowered by itself.
        joined = joined.lower() if "\u03a3" not in joined else "".join([x.lower() for x in joined])
        found = np.array(self.lines.findall(joined), object)
        ends = np.flatnonzero(found == "\n")
        counts = np.diff(np.concatenate(([-1], ends, [len(found)]))) - 1
        return found[found != "\n"].tolist(), counts

    def encode_flat(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in one array, and the number of ids of each; special tokens may be within chunks."""
        words: list[str] = []
        special: list[int] = []  # which words are special tokens
        counts = np.zeros(len(chunks), np.int64)
        joined = "".join(chunks)
        if not any(m in joined for m in self.marks) and not UNSTABLE.search(joined):
            plain = range(len(chunks))
            if chunks:
                words, counts[:] = self.split_words(chunks)
        else:
            plain = [i for i, c in enumerate(chunks) if not any(m in c for m in self.marks) and not UNSTABLE.search(c)]
            if plain:
                words, counts[plain] = self.split_words([chunks[i] for i in plain])
        if len(plain) < len(chunks):  # others keep their place
            own = np.cumsum(counts) - counts
            parts, at = [], 0
            for i in sorted(set(range(len(chunks))).difference(plain)):
                c = chunks[i]
                parts += words[at : own[i]]
                at = own[i]
                for x in self.cut.split(c):
                    more = [x] if x in self.special else [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(x))] if x else []
                    special += [len(parts)] if x in self.special else []
                    parts += more
                    counts[i] += len(more)
            words = parts + words[at:]
        ids, sizes = self.encode_words([w.encode("utf-8", "replace") for w in words])
        if special:
            ids, sizes = self.with_special(words, special, ids, sizes)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return ids, edges[bounds[1:]] - edges[bounds[:-1]]

    def with_special(self, words: list[str], special: list[int], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of special tokens where their strings were encoded as words."""
        edges = np.concatenate(([0], np.cumsum(sizes)))
        parts, at, sizes = [], 0, sizes.copy()
        for w in special:
            parts += [ids[at : edges[w]], np.array([self.special[words[w]]], np.uint32)]
            at = edges[w + 1]
            sizes[w] = 1
        return np.concatenate([*parts, ids[at:]]), sizes

    def encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk or special token."""
        if not chunks:
            return []
        ids, sizes = self.encode_flat(chunks)
        return np.split(ids, np.cumsum(sizes)[:-1])

    def decode(self, ids) -> str:
        """The tokens joined by blanks, as the library does for a file without a decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


class Encoder:
    """A vocabulary with the chunks met so far and their ids as text."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.names = list(map(str, range(len(self.vocabulary.tokens))))
        self.token = dict(zip(self.names, self.vocabulary.tokens))
        self.ids: dict[str, str] = {}

    def learn(self, pieces: list[list[str]]) -> None:
        if len(self.ids) > KEPT:
            self.ids = {}
        new = list(set().union(*pieces).difference(self.ids))
        if not new:
            return
        flat, sizes = self.vocabulary.encode_flat(new)
        names = list(map(self.names.__getitem__, flat.tolist()))
        at = 0
        for chunk, n in zip(new, sizes.tolist()):
            self.ids[chunk] = " ".join(names[at : at + n])
            at += n

    def decode(self, ids: str) -> str:
        """The decoded text of ids joined by blanks."""
        return " ".join(map(self.token.__getitem__, ids.split()))

    def encode(self, texts: list[str | None]):
        """For each text its ids, joined by blanks."""
        for part in slices(texts):
            pieces = [self.vocabulary.pieces(t or "") for t in part]
            self.learn(pieces)
            for p in pieces:
                yield " ".join(map(self.ids.__getitem__, p))


def slices(texts: list[str | None]):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "") + 1
        if n > SLICE:
            yield part
            part, n = [], 0
    if part:
        yield part


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Numbers(dict):
    """Numbers of chunks in the order in which they were met; new: those met last."""

    new: list[str]

    def __init__(self):
        self.new = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Chunks:
    """Chunks of text met by a worker: their number, and the ids of each."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.parts = [np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64)]

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the chunks of texts, end to end, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        chunks = split.flatten()
        some = pc.not_equal(chunks, "").to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(some)))
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = chunks.filter(pa.array(some)).dictionary_encode()
        own = np.fromiter(map(self.number.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if self.number.new:
            ids, sizes = self.vocabulary.encode_flat(self.number.new)
            self.parts.append(ids.astype(np.int32))
            self.sizes.append(sizes)
            self.number.new = []
        at = coded.indices.to_numpy(zero_copy_only=False)
        return own[at] if len(at) else np.zeros(0, np.int64), np.diff(ends[offsets])

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts, self.sizes = [np.concatenate(self.parts)], [np.concatenate(self.sizes)]
        return self.parts[0], self.sizes[0]


def gathered(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The stretches of flat that rows name, one after the other."""
    first = np.cumsum(sizes) - sizes
    n = sizes[rows]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(first[rows], n) + step]


_CHUNKS: dict[str, Chunks] = {}


def chunks_of(path: str) -> Chunks:
    """One for each file and Python worker, kept from task to task."""
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path]


def portions(texts: pa.Array, most: int):
    """Numbers of rows that hold about so many bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        take = max(1, int(np.searchsorted(ends, before + most)) - at)
        yield min(take, len(sizes) - at)
        at += take


def column_strings(values: pa.Array) -> list[str | None]:
    """Texts of a column; bytes that are no UTF-8 are replaced."""
    return [v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") for v in values.to_pylist()]


def encode(docs: DataFrame, key: str = "doc_id", column: str = "text", path: str | None = None) -> DataFrame:
    """key and ids (array of int) of each row."""
    path = path or vocabulary_path()

    def run(batches):
        c = chunks_of(path)
        for b in batches:
            at = 0
            for take in portions(b.column(1), BYTES):
                if len(c.number) > CHUNKS_KEPT:
                    c.clear()
                found, lens = c.numbers(b.column(1).slice(at, take))
                flat, sizes = c.table()
                ends = np.concatenate(([0], np.cumsum(sizes[found])))[np.concatenate(([0], np.cumsum(lens)))]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gathered(flat, sizes, found), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, take), ids], [key, "ids"])
                at += take
        if len(c.number) > BETWEEN:
            c.clear()

    return docs.select(docs[key], docs[column]).mapInArrow(light(run), f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", column: str = "ids", path: str | None = None) -> DataFrame:
    """key and text (tokens joined by blanks) of each row of ids; null ids give null."""
    path = path or vocabulary_path()

    def run(batches):
        v = encoder(path).vocabulary
        for b in batches:
            text = [None if i is None else v.decode(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], [key, "text"])

    return encoded.select(encoded[key], encoded[column]).mapInArrow(light(run), f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, and hashes of the ids and of the text decoded from them."""
    path = path or vocabulary_path()

    def run(batches):
        e = encoder(path)
        for b in batches:
            at = 0
            for part in slices(column_strings(b.column(1))):
                rows = [(ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()) for ids in e.encode(part)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(part)

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(light(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
