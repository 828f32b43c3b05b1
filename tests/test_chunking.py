from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.operators import chunking as C
from docmill.operators import dedup
from docmill.schema import CrawlChunks, FixedSize, HeadingBased, Semantic
from pyspark.sql import functions as F

TEXT = st.lists(st.sampled_from(["word ", "End. ", "\n", "\n\n", "# H\n", "日本", "! ", "x" * 9]), max_size=80).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(5, 60), st.integers(0, 30))
def test_fixed_covers_the_text(text, size, overlap):
    got = C.fixed_pieces(text, size, overlap)
    assert all(0 < b - a <= size and text[a:b] == t for a, b, t, *_ in got)
    covered = set().union(*(range(a, b) for a, b, *_ in got)) if got else set()
    assert covered == set(range(len(text)))


def test_fixed_cuts_after_sentences():
    assert [t for _, _, t, *_ in C.fixed_pieces("One. Two. Three is long", 12, 0)] == ["One. Two.", " Three is lo", "ng"]
    assert len(C.fixed_pieces("short", 50, 10)) == 1
    # a cut before the overlap creeps on by one character
    assert [a for a, *_ in C.fixed_pieces("a. " + "b" * 30, 10, 8)][:3] == [0, 1, 2]


def test_paragraphs():
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "c" * 5
    assert [t for _, _, t, *_ in C.paragraph_pieces(text, 50, 10)] == ["a" * 30, "b" * 30 + "\n\n" + "c" * 5]
    assert C.paragraph_pieces("tiny", 50, 10) == []
    assert [len(t) for _, _, t, *_ in C.paragraph_pieces("x" * 80 + "\n\n" + "y" * 20, 50, 10)] == [80, 20]


def test_headings():
    text = "# Top\n" + "text of the first section\n" * 2 + "## Sub\n" + "text of the second\n" * 3 + "# Next\nlast section of all here\n"
    got = C.heading_pieces(text, 500, 20)
    assert [(h, c) for *_, h, c in got] == [("Top", "Top"), ("Sub", "Top > Sub"), ("Next", "Next")]
    long = C.heading_pieces("# T\n" + "0123456789\n" * 20, 60, 20)
    assert long[0][3] == "T" and long[1][3] is None and all(p[4] == "T" for p in long)
    assert [h for *_, h, _ in C.heading_pieces("# Small\nx\n# Big\n" + "y" * 40, 100, 20)] == ["Big"]
    assert C.heading_pieces("# Small\nx\n# Big\n" + "y" * 40, 100, 20, keep_small=True)[0][2].startswith("# Small")
    assert C.heading_of("===") == (1, "") and C.heading_of("---") == (2, "")


def test_sections():
    text = "intro text\n# A\n" + "para one\n\n" * 3 + "## B\nend"
    assert [(p[2].strip().split("\n")[0], p[4]) for p in C.section_pieces(text, 100)] == [("intro text", None), ("# A", "A"), ("## B", "B")]
    big = C.section_pieces("# A\n\n" + "\n\n".join("p" * 40 for _ in range(6)), 25)
    assert len(big) > 2 and all(len(p[2]) <= 110 for p in big)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], "id string, content string, n int, heading string")


def test_chunk(spark):
    rows = [("a", "Same text.\n\nSame text.\n\nOther text."), ("b", "Same text."), ("n", None), ("e", ""), (None, "x"), ("w", " \n ")]
    df = frame(spark, rows)
    got = C.chunk(df, Semantic(5, 1)).collect()
    assert sorted((r.id, r.position, r.content) for r in got) == [("a", 0, "Same text."), ("a", 1, "Other text."), ("b", 0, "Same text.")]
    across = C.chunk(df, Semantic(5, 1), across=True).collect()
    assert sorted((r.id, r.position) for r in across) == [("a", 0), ("a", 1)]
    for strategy in (FixedSize(10, 2), HeadingBased(50, 2), CrawlChunks(), Semantic()):
        assert C.chunk(df.limit(0), strategy).count() == 0
        C.chunk(df, strategy).collect()


def test_crawl_chunks(spark):
    sentence = "This is a sentence with enough letters to be kept as a chunk of text here. "
    text = f"# One\n{sentence * 2}as in the following\n# Two\n{sentence * 2}more\n# Menu\n{sentence}menu toggle\n"
    df = frame(spark, [("p", text), ("q", text.upper()), ("long", ("para " * 400 + "\n\n") * 40)])
    got = {(r.id, r.position): r for r in C.crawl_chunks(df).collect()}
    one, two = got["p", 0], got["p", 1]
    assert one.heading_context == "One" and two.content.startswith("...# One")
    assert ("p", 2) not in got
    seen = C.crawl_chunks(df.filter("id = 'p'")).select(F.col("content_hash").alias("hash"))
    assert {r.id for r in C.crawl_chunks(df, seen=seen).collect()} <= {"long", "q"}
    assert all(r.end_char > r.start_char for r in got.values())


def test_overlap_window(spark):
    rows = [("a", 0, "first chunk, long enough to give context:"), ("a", 1, "line one\nline two of it\nline three\nline four"), ("b", 0, "!!! ??? ... !!! ??? ... !!!"), ("b", 1, "next")]
    df = spark.createDataFrame(rows, "doc string, n int, content string")
    got = {(r.doc, r.n): r.content for r in C.with_overlap(df, "doc", "n").collect()}
    assert got["a", 0].endswith(":\n\nline one\nline two of it\nline three...")
    assert got["a", 1].startswith("...first chunk, long enough to give context:\n\nline one")
    assert got["b", 1] == "next"


def test_dedup(spark):
    df = spark.createDataFrame([(3, "x"), (1, "X "), (2, "y"), (4, None)], "id int, content string")
    from docmill.functions.text import normalized_hash

    key = normalized_hash(F.col("content"))
    assert sorted(r.id for r in dedup.first_of_each(df, key, ["id"]).collect()) == [1, 2]
    assert dedup.duplicate_counts(df, key).first().copies == 2
    seen = df.filter("id = 2").select(key.alias("hash"))
    assert [r.id for r in dedup.unseen(df, key, seen, ["id"]).collect()] == [1]
