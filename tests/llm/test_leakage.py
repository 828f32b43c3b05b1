from __future__ import annotations

import random
import re

from docmill.llm import leakage as L


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, window=13):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, q in items:
            v = words(q)
            m = min(window, len(v))
            runs = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
            if any(tuple(w[k : k + m]) in runs for k in range(len(w) - m + 1)) and d is not None:
                out.add((d, i))
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([8, 9, 10, 11, 12, 13, 14, 40, 120, 3, 1])] + [(50, ""), (51, None), (52, " ".join(rng.choices(vocabulary, k=30)))]
    docs = []
    for d in range(300):
        w = rng.choices(vocabulary, k=rng.randrange(0, 200))
        i, text = rng.choice(items[:9])
        part = words(text)
        cut = rng.choice([part, part[: 13 + d % 3], part[-12:], part[5:18]])
        at = rng.randrange(len(w) + 1)
        docs.append((d, ", ".join(w[:at] + cut + w[at:])))
    return [*docs, (900, None), (901, ""), (902, items[8][1]), (902, items[8][1]), (None, items[8][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = fixture()
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in L.contained(df, bench, "doc_id", "text", "item_id", "text").collect()} == expected
    monkeypatch.setattr(L, "INDEX_WORDS", 60)  # several passes
    assert {(r.doc_id, r.item_id) for r in L.contained(df, bench, "doc_id", "text", "item_id", "text").collect()} == expected


def test_empty(spark):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert L.contained(df.limit(0), bench, "doc_id", "text", "item_id", "text").count() == 0
    assert L.contained(df, bench.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_partitions_cover_all_sizes():
    sizes = L.size_classes(13, 5)
    assert sorted(m for low, high, _ in sizes for m in range(low, high + 1)) == list(range(1, 14))
    assert all(s <= low for low, _, s in sizes)
