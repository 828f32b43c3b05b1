from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docmill.llm.boilerplate import frame_lines, main_body, page_lines, repeated_substrings
from docmill.llm.lines import host_of

NOUNS = [f"noun{a}{b}" for a in "bcdfgh" for b in "klmnprst"]


def page(rng, n, site):
    """(lines, numbers of the frame's lines)."""

    def sentence():
        return "The " + " ".join(rng.choices(NOUNS, k=9)) + " is here."

    def words():
        return " ".join(rng.choices(NOUNS, k=3)).capitalize()

    top = ["Skip to the content", f"Home | Docs | {site}", f"Updated {rng.randrange(1, 40)} days ago", f"Home » Docs » {words()}"]
    body = [f"# {words()}", sentence(), "", sentence() + " " + sentence(), "```", "x = 1", "```", f"## {words()}", sentence(), "| a | b |", "| --- | --- |", f"| `{n}` | 2 |"]
    promo = [f"Never miss a release of {site}, join the list today."]
    bottom = ["Was this page helpful? Yes No", f"Previous: {words()} | Next: {words()}", f"© 2024 {site} works. All rights reserved."]
    out, frame = [], set()
    for part, mine in ((top, True), (body[:3], False), (promo if n % 2 else [], True), (body[3:], False), (bottom, True)):
        for line in part:
            out.append(line)
            if mine:
                frame.add(len(out))
    return out, frame


def fixture():
    rng = random.Random(4)
    rows, want, n = [], set(), 0
    for site, pages in (("alpha", 60), ("beta", 12), ("gamma", 1)):
        for _ in range(pages):
            lines, frame = page(rng, n, site)
            rows.append((n, f"https://docs.{site}.example/p/{n}", "\n".join(lines)))
            want |= {(n, k) for k in frame}
            n += 1
    return rows, want


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, markdown string, block int")
    return {(r.page_id, r.line_no) for r in frame_lines(df, host=host_of(F.col("url")), **options).collect()}


def test_frames_are_found(spark):
    rows, want = fixture()
    got = found(spark, rows)
    large = {p for p, u, _ in rows if "gamma" not in u}
    assert {x for x in got if x[0] in large} == {x for x in want if x[0] in large}
    # a host with one page profits from what the others show
    one = next(p for p, u, _ in rows if "gamma" in u)
    assert {k for p, k in got if p == one} >= {k for p, k in want if p == one and k <= 4}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_blocks_change_nothing(spark, monkeypatch, limit):
    """Also where the names of repeated substrings are dealt to the blocks rather than broadcast."""
    rows, _ = fixture()
    whole = found(spark, rows)
    monkeypatch.setattr("docmill.llm.boilerplate.BROADCAST_ROWS", limit)
    for chars in (2_000, 15_000):
        assert found(spark, rows, block_chars=chars) == whole


def test_support_is_that_of_the_whole_host(spark):
    """A sentence in 5.4 % of a large host's pages is found in all of them, however the pages are dealt."""
    rng = random.Random(9)
    notice = "Try the hosted service free for thirty days"
    rows, want = [], set()
    for n in range(4000):
        lines = [f"# {' '.join(rng.choices(NOUNS, k=3))}"] + ["The " + " ".join(rng.choices(NOUNS, k=12)) + " is here." for _ in range(3)]
        if n < 216:
            lines.insert(2, notice)
            want.add((n, 3))
        rows.append((n, f"https://docs.large.example/p/{n}", "\n".join(lines)))
    rng.shuffle(rows)
    assert found(spark, rows, block_chars=20_000) == want == found(spark, rows)


def test_substrings_across_and_within_lines(spark):
    """A notice wrapped in other ways on each page, and one that makes up most of a line."""
    rng = random.Random(3)
    notice = "please note that every name on these pages is made up by the people who write them and that none of the products can be bought anywhere at all".split()
    rows, want = [], set()
    for n in range(60):
        top = [f"# {' '.join(rng.choices(NOUNS, k=3))}", "The " + " ".join(rng.choices(NOUNS, k=40)) + " is here.", ""]
        a = rng.randrange(8, 20)
        noted = [" ".join(notice[:a]), " ".join(notice[a:])] if n % 2 else [f"{rng.choice(NOUNS)} {rng.choice(NOUNS)}: " + " ".join(notice)]
        rest = ["", "The " + " ".join(rng.choices(NOUNS, k=40)) + " is here."]
        want |= {(n, 4 + k) for k in range(len(noted))}
        rows.append((n, "https://docs.one.example/p", "\n".join(top + noted + rest)))
    assert found(spark, rows) == want


def test_repeated_substrings_by_brute_force():
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choices("abcdefgh", weights=[9, 9, 9, 1, 1, 1, 1, 1], k=rng.randrange(1, 9))) for _ in range(6)) for _ in range(30)]
    x = page_lines(texts, "h")
    names, pages = repeated_substrings(x, 5, 3)
    grams = defaultdict(set)
    for k, t in enumerate(texts):
        tokens = "/" + "/".join("".join(line.split()) for line in t.split("\n")) + "/."
        for i in range(len(tokens) - 4):
            grams[tokens[i : i + 5]].add(k)
    lines = defaultdict(set)
    for k, t in enumerate(texts):
        for line in t.split("\n"):
            lines[line].add(k)
    even = sorted(p for n, p in zip(names.tolist(), pages.tolist(), strict=True) if not n & 1)
    odd = sorted(p for n, p in zip(names.tolist(), pages.tolist(), strict=True) if n & 1)
    assert even == sorted(len(v) for v in grams.values() if len(v) >= 3)
    assert odd == sorted(len(v) for v in lines.values() if len(v) >= 3)


def test_no_body_nulls_and_repeats(spark):
    rows, _ = fixture()
    menu = "Skip to the content\nHome | Docs | alpha\n\nWas this page helpful? Yes No"
    extra = [(1000, rows[0][1], menu), (1001, rows[0][1], None), (1002, rows[0][1], ""), (1003, rows[0][1], " \n\t"), (1004, None, "# T\n\nA text of its own, with no host at all, and nothing that comes again."), (None, rows[0][1], menu), rows[0]]
    got = found(spark, rows + extra)
    assert {k for p, k in got if p == 1000} == {1, 2, 4}
    assert not {p for p, _ in got} & {1001, 1002, 1003, 1004, None}
    assert found(spark, rows[:1])  # the part above the title
    df = spark.createDataFrame(rows[:0], "page_id long, url string, markdown string")
    assert frame_lines(df).count() == 0


def test_main_body(spark):
    rows, want = fixture()
    df = spark.createDataFrame(rows + [(5000, None, None)], "page_id long, url string, markdown string")
    body = {r.page_id: r.text for r in main_body(df, host=host_of(F.col("url"))).collect()}
    assert body[5000] is None
    lines = rows[0][2].split("\n")
    assert body[0] == "\n".join(x for k, x in enumerate(lines, 1) if (0, k) not in want)


def test_wrapped_paragraphs_are_text():
    x = page_lines(["The first line of a paragraph that is wrapped at some\nforty characters or so."], "h")
    assert x.goes_on.tolist() == [False, True]


def test_copies_and_repeats_count_once(spark):
    rows, _ = fixture()
    alone = found(spark, rows)
    alpha = [r for r in rows if "alpha" in r[1]]
    again = [rows[0], rows[0], rows[5], rows[65], rows[65]]  # the same pages again, of a large and of a small host
    copies = [(2000 + n, *rows[3][1:]) for n in range(len(alpha) // 2)] + [(3000, *rows[66][1:])]  # a third of the host
    got = found(spark, rows + again + copies)
    assert {x for x in got if x[0] < 2000} == alone
    assert {(p, k) for p, k in got if p >= 2000} == {(c, k) for c, o in [(r[0], 3) for r in copies[:-1]] + [(3000, 66)] for p, k in alone if p == o}
