from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from docmill.llm.neardup import children_needed, common_tokens, near_duplicates, runs_needed, token_sets


def words(text):
    import re

    return re.findall(r"[^\W_]+", text.lower())


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, n, t):
    sets = {i: shingles(x, n) for i, x in docs.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if docs[a] != docs[b] and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed=3, base=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    frame = " ".join(rng.choices(vocabulary, k=30))  # one frame in every text: hot tokens
    docs = {}
    for b in range(base):
        text = rng.choices(vocabulary, k=120)
        for v in range(4):
            edited = list(text)
            for _ in range(v * 3):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            docs[f"d{b:03}_{v}"] = frame + " " + " ".join(edited)
    return docs


@pytest.mark.parametrize("bucket", [256, 12])
def test_against_brute_force(spark, bucket):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    got = near_duplicates(df, "id", "content", 0.6, 3, bucket=bucket, levels=2)
    pairs = {(r.a, r.b): r.similarity for r in got.pairs.collect()}
    assert set(pairs) == brute(docs, 3, 0.6)
    for (a, b), s in list(pairs.items())[:20]:
        x, y = shingles(docs[a], 3), shingles(docs[b], 3)
        assert s == pytest.approx(len(x & y) / len(x | y))


def test_copies_nulls_and_repeats(spark):
    docs = corpus(base=4)
    hot = "the same text again and again with more than thirty words in it " * 4
    rows = [(i, t) for i, t in docs.items()] + [(f"z{i:03}", hot) for i in range(80)] + [("z000", hot), ("n", None), (None, hot), ("e", ""), ("s", "too short")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, content string, n int, text string")
    got = near_duplicates(df, "id", "content", 0.6, 3, min_words=30)
    members = {r.id: r.rep for r in got.members.collect()}
    assert {members[f"z{i:03}"] for i in range(80)} == {"z000"}
    assert not {"n", "e", "s"} & set(members)
    assert {(r.a, r.b) for r in got.pairs.collect()} == brute(docs, 3, 0.6)
    empty = near_duplicates(df.limit(0), "id", "content")
    assert empty.pairs.count() == 0 and empty.members.count() == 0


def test_runs():
    assert runs_needed(0.6, 6, 0.999) == 2
    assert runs_needed(0.6, 6, 0.9999) == 3


def test_sets_that_share_only_hot_tokens(spark):
    """Pairs at the threshold, in a family of thousands in which every token is hot and few pairs are similar."""
    rng = random.Random(11)
    blocks = [" ".join(f"b{i}x{j}" for j in range(12)) for i in range(16)]  # each in about half of all texts
    docs = {}
    for i in range(2500):
        chosen = [b for b in blocks if rng.random() < 0.5] or blocks[:1]
        docs[f"d{i:05}"] = " ".join(chosen)
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    sets = {}
    for i, x in docs.items():
        sets.setdefault(x, i)  # one of exact copies
    shingled = {i: shingles(x, 3) for x, i in sets.items()}
    index = {}
    for i, s in shingled.items():
        for t in s:
            index.setdefault(t, len(index))
    held = np.zeros((len(shingled), len(index)), np.float32)
    for k, s in enumerate(shingled.values()):
        held[k, [index[t] for t in s]] = 1
    n, shared, ids = held.sum(axis=1), held @ held.T, list(shingled)
    a, b = np.nonzero(np.triu(5 * shared >= 3 * (n[:, None] + n[None, :] - shared), 1))
    want = {tuple(sorted((ids[i], ids[j]))) for i, j in zip(a, b, strict=True)}
    got = {(r.a, r.b) for r in near_duplicates(df, "id", "content", 0.6, 3, bucket=16).pairs.collect()}
    assert len(ids) > 2000 and got <= want
    assert len(got) >= 0.999 * len(want)


def test_children():
    """Paths of a pair at the threshold that lie in large buckets only, over four splits."""
    rng = np.random.default_rng(1)
    children = children_needed(0.6, 6, 2, 0.999)
    met = 0
    for _ in range(10_000):
        alive, spare = rng.poisson(2 * 6 * 0.6), rng.binomial(120, 24 / 200)
        for _ in range(4):
            alive = rng.binomial(spare, children / 24, min(alive, 200)).sum()
        met += alive > 0
    assert met >= 9975
    assert children_needed(0.6, 4, 2, 0.999) is None


@pytest.mark.parametrize("bucket", [256, 16])
def test_a_template_in_all_texts(spark, bucket):
    """Texts that are mostly a template: those with little else are similar by it alone, others by what they share besides."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    template = " ".join(rng.choices(vocabulary, k=112))
    docs = {}
    for i in range(160):
        own = rng.choices(vocabulary, k=(8, 25, 40, 62, 90)[i % 5])
        docs[f"d{i:03}"] = template + " " + " ".join(own)
        if i % 3 == 0:
            own[len(own) // 2] = "other"
            docs[f"e{i:03}"] = template + " " + " ".join(own)
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    got = near_duplicates(df, "id", "content", 0.6, 3, bucket=bucket)
    assert {(r.a, r.b) for r in got.pairs.collect()} == brute(docs, 3, 0.6)


@pytest.mark.parametrize(("parts", "block"), [(4, 1 << 21), (2, 2000), (40, 1 << 21)])
def test_common_tokens_are_counted_in_all_texts(spark, parts, block):
    """Tokens that just under, exactly and just over 1 % of 6,000 texts hold, neighbouring or scattered ones, in blocks of several sizes."""
    rng = random.Random(5)
    texts = [[f"u{i}x{j}" for j in range(4)] for i in range(6000)]
    for k, times in enumerate([*range(40, 81), 3000]):
        for i in range(k * 50, k * 50 + times) if k % 2 else rng.sample(range(6000), times):
            texts[i] += [f"p{k}", "of", "it"]
    docs = [" ".join(t) for t in texts]
    held = Counter(t for d in docs for t in shingles(d, 3))
    assert {59, 60, 61} <= set(held.values())
    want = {int(token_sets([" ".join(t)], 3)[0][0]) for t, n in held.items() if n >= 60}
    df = spark.createDataFrame(spark.sparkContext.parallelize([(d,) for d in docs], parts), "text string").selectExpr("xxhash64(text) AS h1", "text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = common_tokens(df, 3, block)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert list(got) == sorted(want)
