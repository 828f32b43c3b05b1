from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm.split import balanced, boundaries, greedy, split_oversized

TEXT = st.lists(st.sampled_from(["# Head", "word ", "End. ", "\n", "\n\n", "```\n", "~~~\n", "x" * 30, "日本。", "? ", " ", "\t"]), max_size=120).map("".join)


def brute(text, limit, overlap):
    """The rule read literally, position by position."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    state, fence = [], None
    for at, line in lines:
        mark = line.strip()[:3] if line.strip()[:3] in ("```", "~~~") else None
        state.append((at, line, fence is not None or bool(mark), fence is None))
        if fence is None and mark:
            fence = mark
        elif fence is not None and mark == fence:
            fence = None
    kinds = {}
    for n, (at, line, inside, start_outside) in enumerate(state):
        if start_outside:
            kinds.setdefault(at, set()).add("c")
            hashes = len(line) - len(line.lstrip("#"))
            if 1 <= hashes <= 6 and line[hashes : hashes + 1] == " ":
                kinds[at].add("a")
            if line.strip() and n and not state[n - 1][1].strip():
                kinds[at].add("b")
        else:
            kinds.setdefault(at, set()).add("e")
        if not inside:
            for k, c in enumerate(line):
                if c in ".!?" and line[k + 1 : k + 2] == " ":
                    kinds.setdefault(at + k + 2, set()).add("d")
                if c in "。！？":
                    kinds.setdefault(at + k + 1, set()).add("d")
    for k, c in enumerate(text):
        if c in " \t\n":
            kinds.setdefault(k + 1, set()).add("f")
    s, out = 0, []
    while len(text) - s > limit:
        window = range(s + limit // 2 + 1, s + limit + 1)
        e = next((max(p for p in window if k in kinds.get(p, ())) for k in "abcdef" if any(k in kinds.get(p, ()) for p in window)), s + limit)
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(text))]


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(20, 80), st.integers(0, 9))
def test_greedy_is_the_rule(text, limit, overlap):
    assert greedy(text, limit, overlap) == brute(text, limit, overlap)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(20, 80), st.integers(0, 9))
def test_balanced_keeps_limits_and_loses_nothing(text, limit, overlap):
    got = balanced(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    assert all(c == b - overlap for (_, b), (c, _) in zip(got, got[1:]))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(20, 80), st.integers(0, 9))
def test_balanced_cuts_at_boundaries_within_reach(text, limit, overlap):
    places = {p for kind in boundaries(text) for p in kind}
    for s, e in balanced(text, limit, overlap)[:-1]:
        assert e in places or not any(s + overlap < p <= s + limit for p in places)


def test_balanced_is_linear_in_pieces():
    words = "Each sentence has a few words in it. " * 60_000
    got = balanced(words, 1000, 200)
    assert all(words[e - 1] == " " for _, e in got[:-1])
    assert len(got) <= 1.15 * (len(words) - 200) / 800


def test_balanced_pieces_are_even():
    got = balanced("word " * 1000, 1000, 100)
    sizes = [b - a for a, b in got]
    assert len(got) == 6 and max(sizes) - min(sizes) < 20


def test_overlap_of_half_the_limit_ends():
    assert greedy("ab " * 50, 10, 9)[-1][1] == 150
    assert balanced("x" * 100, 10, 50)[-1][1] == 100


def test_table(spark):
    long = "Sentence one is here. " * 20
    rows = [(1, long, "A", "Top"), (1, long, "A", "Top"), (2, None, "A", None), (3, "", "A", None), (4, "short", "A", None), (5, long, None, None), (6, long, "none such", None), (None, long, "A", None), (7, "x" * 5_000_000, "A", None)]
    df = spark.createDataFrame([(*r, 99) for r in rows], "chunk_id long, content string, strategy string, heading_context string, overlap int")
    limits = spark.createDataFrame([("A", 100, 10), ("B", 50, None), (None, 5, 1)], "strategy string, max_chars int, overlap_chars int")
    got = split_oversized(df, limits, "greedy").collect()
    assert {r.chunk_id for r in got} == {1, 7}
    assert sorted((r.start_char, r.end_char) for r in got if r.chunk_id == 1) == brute(long, 100, 10)
    out = split_oversized(df.filter("chunk_id = 1"), limits, context_col="heading_context", with_text=True).collect()
    assert all(r.heading_context == "Top" and r.piece == long[r.start_char : r.end_char] for r in out)
    assert split_oversized(df.limit(0), limits).count() == 0
    assert split_oversized(df, limits.limit(0)).count() == 0
