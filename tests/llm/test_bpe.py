import hashlib

import public_tokenizers
import pytest
from helpers import SF, edge_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe

LIB = Tokenizer.from_file(public_tokenizers.path(bpe.WORD_BPE))
ENC = bpe.Encoder(bpe.vocabulary_path())


def check(texts):
    got = list(ENC.encode(texts))
    assert len(got) == len(texts)
    for t, ids in zip(texts, got):
        want = LIB.encode(t or "", add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), repr(t)
        assert ENC.decode(ids) == LIB.decode(want, skip_special_tokens=False), repr(t)


@pytest.mark.parametrize("text", [
    None, "", " \n", "Hello, World's end don't WE'LL 'S it'd", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|> c", "<|endoftext", "ΣΑΣ ΟΔΟΣ", "İstanbul Straße ǅ",
    "école Å Å ́start", "a\x1cb\x1d c\x85d\xa0e f​g﻿h᠎i", "12345 ½ Ⅷ ²", "漢字かな交じり文 😀👩‍👩‍👧 \U0001f1e6", "aaaa" * 50, "ab" * 999 + "a" * 10_001, "\x00\x01\x7f tab\tx", "---!!!...___", "the the THE thE", "각",
])
def test_against_library(text):
    check([text])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="abnotheri 'stdlvḿÉß1<|>\n", max_size=60), max_size=8))
def test_random_against_library(texts):
    check([t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)])


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_documents(spark).select("doc_id", "text"))
    got = sorted(map(tuple, bpe.digest(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = LIB.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    encoded = bpe.encode(docs)
    assert encoded.where("doc_id = 1").first().ids is not None
    assert bpe.decode(encoded).count() == docs.count()
    assert bpe.digest(docs.limit(0)).collect() == []
