from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import encode as E

PATH = E.vocabulary_path()


def library(text):
    return E.tokenizer(PATH).encode(text, add_special_tokens=False).ids


ALPHABET = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "B", "1", "²", "é", "日", ".", "!", " ", "ve", "'d", "\r", "😀", "́", "<|endoftext|>", "¿"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), min_size=1, max_size=4))
def test_equals_library(texts):
    ids, offsets = E.encoder(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_any_text(text):
    ids, offsets = E.encoder(PATH).encode(["x", text, ""])
    assert ids[offsets[1] : offsets[2]].tolist() == library(text)
    assert offsets[2] == offsets[3]


def test_table(spark):
    long = " ".join(random.Random(1).choices(["alpha", "beta's", "γάμμα", "42", "\n\n"], k=300_000))  # longer than a slice
    rows = [(1, "Hello world's <|endoftext|>"), (2, None), (3, ""), (4, " \n "), (5, long), (1, "again"), (None, "x")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = {(r.doc_id, len(r.ids)): r.ids for r in E.encode(df).collect()}
    assert len(got) == 7
    assert got[1, len(library("Hello world's <|endoftext|>"))] == library("Hello world's <|endoftext|>")
    assert got[2, 0] == [] and got[3, 0] == []
    assert got[5, len(library(long))] == library(long)
    assert E.encode(df.limit(0)).count() == 0


def test_round_trip_and_spans(spark):
    texts = ["naïve 日本語 👩🏽‍💻 end", "", "á b", "tab\tand  spaces "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = E.encode(df).select("doc_id", E.decode(F.col("ids")).alias("text"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
    for r in E.token_spans(df).collect():
        text, covered = texts[r.doc_id], set()
        for a, b in zip(r.starts, r.ends):
            assert 0 <= a < b <= len(text)
            covered |= set(range(a, b))
        assert covered == set(range(len(text)))
        assert len(r.starts) == len(library(text))


def test_decode_of_part_of_a_character(spark):
    ids = library("日")
    df = spark.createDataFrame([(ids[:1],), (ids,), (None,)], "ids array<int>")
    out = [r.t for r in df.select(E.decode(F.col("ids")).alias("t")).collect()]
    assert out[1] == "日" and "�" in out[0] and out[2] is None


@pytest.mark.parametrize("table", [E.byte_of_char()])
def test_byte_table(table):
    assert sorted(table.values()) == list(range(256))
