from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as X


def apply(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokenize(spark):
    got = apply(spark, X.tokenize, "C++ high-level  (Über) --", "", None, "日本 é")
    assert got == [["c", "high-level", "über"], [], None, ["日本", "e"]]


def test_headings(spark):
    lines = ["# A", "###### F ", "####### no", "#no", "===", "---", "--", "text", "=-="]
    assert apply(spark, X.heading_level, *lines) == [1, 6, 0, 0, 1, 2, 0, 0, 1]
    assert apply(spark, X.heading_text, "## Two words ", "---")[0] == "Two words"
    assert apply(spark, X.first_heading, "x\n### Third\r\ny", "#### deep", None) == ["Third", None, None]


def test_quality(spark):
    good = "This is a sentence with enough letters to be kept as a chunk of text, and some more words follow it here."
    assert apply(spark, X.is_quality, good, good[:60], good + " Skip to content", "1234567890 " * 20, "a!?;" * 40, None, "") == [True, False, False, False, False, None, False]
    repeated = "\n".join([good[:40]] * 9)
    assert apply(spark, X.is_quality, repeated) == [False]


def test_code_and_sizes(spark):
    assert apply(spark, X.contains_code, "a class of its own", "plain", "\tx", None) == [True, False, True, None]
    assert apply(spark, X.has_code, "    x", "a    b", "plain") == [False, True, False]
    assert apply(spark, X.estimate_tokens, "abcd", "日本", "") == [1, 1, 0]
    assert apply(spark, X.needs_next, "as in the following", "to be continued later", "end.") == [True, True, False]
    assert apply(spark, X.preview, "日" * 300) == ["日" * 200]


def test_hashes(spark):
    a, b, c = apply(spark, X.normalized_hash, " A\tb ", "a B", "a c")
    assert a == b != c
    x, y, z = apply(spark, X.content_hash, " a ", "a", "A")
    assert x == y != z


def test_detectors(spark):
    assert apply(spark, X.url_language, "https://x/py/", "https://x/javascript", "https://x/java", "https://x/go/", None, "https://x") == ["Python", "JavaScript", "Java", "Go", None, None]
    assert apply(spark, X.code_language, "fn main() {}", "import x", "SELECT 1", "type A = B", "nothing", None) == ["rust", "python", "sql", "typescript", None, None]
    assert apply(spark, lambda c: X.framework(F.lit("https://vuejs.org"), c), "x", None) == ["Vue", "Vue"]
    assert apply(spark, lambda c: X.framework(F.lit(None).cast("string"), c), "uses React.js") == ["React"]


def test_clean_markdown(spark):
    text = "Menu\n\n\n\nA good line of text.\n--\n```python\ndef f(): pass\n```\n\n!!! ???\nNavigation of a very long line that is kept because it is longer than fifty.\n"
    got = apply(spark, X.clean_markdown, text, None, "")
    assert got[0] == "A good line of text.\n```python\ndef f(): pass\n```\n\nNavigation of a very long line that is kept because it is longer than fifty."
    assert got[1] is None and got[2] == ""
    assert "\n\n" not in apply(spark, lambda c: X.clean_markdown(c, True), text)[0]


def test_splits(spark):
    assert apply(spark, X.split_headers, "pre\n# A\nx\n## B\ny", "  ", "none")[0] == ["pre\n", "# A\nx\n", "## B\ny"]
    assert apply(spark, X.split_paragraphs, "a\n\n \n\nb") == [["a", "b"]]
    assert apply(spark, X.code_spans, "x ```a\nb``` y ```c``` z") == [["```a\nb```", "```c```"]]


def test_names(spark):
    df = spark.range(1)
    got = df.select(X.chunk_id(F.lit("u"), F.lit(3)).alias("a"), X.chunk_id(F.lit("u"), F.lit(3), "service").alias("b"), X.chunk_tags(F.lit(True), F.lit(0), F.lit(2)).alias("c"), X.source_of(F.lit("")).alias("d")).first()
    assert tuple(got) == ("u_chunk_3", "u_3", ["has-code", "chunk-1-of-2"], "local")


@pytest.mark.parametrize("name", ["doc_tokenize", "vector_cosine", "chunk_fixed", "extract_html"])
def test_sql_functions(spark, name):
    from docmill.functions.register import register

    assert name in register(spark)
    sql = {
        "doc_tokenize": ("SELECT doc_tokenize('A, b')", ["a", "b"]),
        "vector_cosine": ("SELECT vector_cosine(array(1D, 0D), array(1D, 0D))", 1.0),
        "chunk_fixed": ("SELECT size(chunk_fixed('One. Two. Three.', 6, 0))", 4),
        "extract_html": ("SELECT extract_html('<title>T</title>', 'u').title", "T"),
    }
    text, want = sql[name]
    assert spark.sql(text).first()[0] == want
