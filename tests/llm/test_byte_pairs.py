"""Byte-level BPE against the library on whole texts, and exact round trips."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from postpulse.llm import byte_pairs
from postpulse.llm.catalog import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = st.text(st.sampled_from("aBé'st1²0 \n\t\x85  　.,。-😀\x00中ひк"), max_size=80)
TEXTS = [None, "", " ", "\n", "it's", "don't stop", "é😀 中文。文", "a" * 70_000,
         " " * 70_000 + "x", "x" + "\n" * 70_000, "word, " * 20_000, "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


@settings(max_examples=400, deadline=None)
@given(ODD, st.integers(1, 12))
def test_parts_have_the_ids_of_the_whole_text(library, text, longest):
    parts = list(byte_pairs.parts(text, longest))
    assert "".join(part for part, _ in parts) == text
    own = byte_pairs.text_ids(text, RANKS, public_tokenizers.PATTERN, longest)
    assert own.tolist() == library.encode_ordinary(text)


def test_white_space_on_which_the_library_runs_out_of_stack():
    text = "a" + " " * 1_500_000 + "b" + "\n" * 1_500_000
    ids = byte_pairs.text_ids(text, RANKS, public_tokenizers.PATTERN)
    coder = byte_pairs.coders(RANKS, public_tokenizers.PATTERN)[0]
    assert coder.decode_bytes(ids.tolist()) == text.encode()
    assert 0 < max(len(p) for p, one in byte_pairs.parts(text) if not one) <= byte_pairs.PART


def test_rows_of_every_kind(spark, library):
    rows = [(i, text, "old", 1) for i, text in enumerate(TEXTS)]
    rows += [rows[5], (None, "no key", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, decoded int")
    found = byte_pairs.decode(byte_pairs.encode(docs, RANKS), RANKS)
    assert found.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(map(tuple, found.collect()), key=repr)
    want = sorted(((key, text, library.encode_ordinary(text or ""), bytearray((text or "").encode()))
                   for key, text, *_ in rows), key=repr)
    assert got == want


def test_empty_table_and_ids_that_cut_characters(spark, library):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pairs.decode(byte_pairs.encode(none, RANKS), RANKS).count() == 0
    ids = library.encode_ordinary("𓀀")
    assert len(ids) > 1
    rows = [(ids[:1],), (ids,), ([],), (None,), ([ids[0], None],)]
    frame = spark.createDataFrame(rows, "ids array<int>")
    got = [bytes(row["decoded"]) for row in byte_pairs.decode(frame, RANKS).collect()]
    first = library.decode_bytes(ids[:1])
    assert sorted(got) == sorted([first, "𓀀".encode(), b"", b"", first])


def test_query_equals_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {row["doc_id"]: tuple(row)[1:] for row in
           QUERIES["op11_byte_pair_round_trip"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for row in docs:
        ids = library.encode_ordinary(row["text"] or "")
        assert got[row["doc_id"]] == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((row["text"] or "").encode()).hexdigest())
