from __future__ import annotations

import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from docmill.llm.lines import SourceLines, host_of


def brute(rows, least=4, share=0.05):
    seen, docs, held, places = {}, {}, {}, {}
    for i, url, text in rows:
        if i is None or i in seen:
            continue
        seen[i] = 1
        m = re.search(r"://([^/:?#]*)", url or "")
        host = re.sub(r"^www\.", "", m[1].lower()) if m else ""
        if not host:
            continue
        docs[host] = docs.get(host, 0) + 1
        for n, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            key = re.sub(r"\s+", " ", re.sub("[0-9]+", "0", line.lower())).strip()
            if len(re.findall(r"[^\W_]+", key)) >= 3:
                held.setdefault((host, key), set()).add(i)
                places.setdefault((host, key), []).append((i, n))
    return {p for k, ids in held.items() if len(ids) >= least and len(ids) >= share * docs[k[0]] for p in places[k]}


def fixture():
    rows = []
    for i in range(120):  # one host with most of the rows
        name = "".join(chr(97 + int(c)) for c in str(i))
        lines = [f"Page {name} is about nothing else", "All rights reserved  by us 20" + str(i % 7), "two words", "Share this page with friends\r"]
        rows.append((f"a{i:03}", ["http://www.Hot.example/x", "HTTPS://hot.example:8080?q", "https://hot.example"][i % 3], "\n".join(lines if i % 2 else lines[:2])))
    rows += [(f"b{i}", "https://small.example/", "Only three pages hold this line\nbody number of page") for i in range(3)]
    rows += [("n1", None, "Share this page with friends"), ("n2", "", "x y z"), ("n3", "https://hot.example/", None), ("n4", "https://hot.example/", ""), ("a001", rows[1][1], rows[1][2]), (None, "https://hot.example/", "a b c")]
    return rows


def lines_of(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "id string, url string, content string, keys int")
    return SourceLines(df, "id", "content", host_of(F.col("url")))


def test_places(spark):
    rows = fixture()
    assert {(r.id, r.line_no) for r in lines_of(spark, rows).places().collect()} == brute(rows)


def test_by_shuffle(spark, monkeypatch):
    from docmill.llm import lines as module

    rows = fixture()
    found = lines_of(spark, rows)
    monkeypatch.setattr(module, "small_side", lambda df, n, limit=0: df)
    monkeypatch.setattr(module, "BROADCAST_VALUES", -1)
    monkeypatch.setattr(module, "PART_DOCS", 7)
    assert {(r.id, r.line_no) for r in found.places().collect()} == brute(rows)


def test_sequences_and_cleaned(spark):
    rows = fixture()
    found = lines_of(spark, rows)
    sequences = [(r.source, len(r.lines), r.support) for r in found.sequences().collect()]
    hot = sorted((n, s) for source, n, s in sequences if source == "hot.example")
    # two single lines (one of 120 pages, one of 60), and the one after the other
    assert hot == [(1, 60), (1, 120), (2, 60)]
    cleaned = {r.id: r.text for r in found.cleaned().collect()}
    assert cleaned["a000"] == "Page a is about nothing else"
    assert "rights" not in cleaned["a001"] and "two words" in cleaned["a001"]
    assert cleaned["n3"] is None and cleaned["n4"] == "" and "n1" not in cleaned


def test_empty(spark):
    found = lines_of(spark, fixture()[:0] or [("x", None, None)])
    assert found.places().count() == 0 and found.sequences().count() == 0 and found.cleaned().count() == 0


def test_lines_that_always_come_together_are_one_item(spark):
    notice = [f"line {c} of a notice that many pages hold" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(f"a{i}", "https://long.example/", "\n".join([f"Page {chr(97 + i)} is about nothing else", *notice])) for i in range(8)]
    found = lines_of(spark, rows)
    (only,) = found.sequences().collect()
    assert len(only.lines) == 26 and only.support == 8
    assert found.places().count() == 8 * 26


def test_sequences_of_any_length(spark):
    """Six lines in this order, each of which some pages lack: every frequent choice of them, in order."""
    notice = [f"line {c} of a notice that many pages hold" for c in "abcdef"]
    held = [[x for k, x in enumerate(notice) if k != i % 7] for i in range(28)]
    rows = [(f"a{i}", "https://long.example/", "\n".join([f"Page {chr(97 + i % 26)}{i // 26} is about", *lines])) for i, lines in enumerate(held)]
    found = lines_of(spark, rows).sequences().collect()
    want = Counter(c for lines in held for n in range(1, 7) for c in itertools.combinations(lines, n))
    assert sorted((len(r.lines), r.support) for r in found) == sorted((len(c), n) for c, n in want.items() if n >= 4)
