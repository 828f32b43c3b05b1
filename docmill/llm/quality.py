"""Problem 8: text statistics that tell prose from lists, tables and junk.

The statistics of a batch of texts come from arrays over all of its characters and words; only lines are looked at one by
one. Over all texts a mergeable quantile sketch of each statistic and language is built (Spark's
``percentile_approx``, a Greenwald-Khanna summary that combines before the
shuffle). A text's values become robust z-scores against its language's sketch,
and the tails of the distributions are flagged: of the shares of item and of cell lines for lists and tables,
of the others for junk.

Common words are known for four languages; those of further ones are learnt from the texts that are tagged with them. A text
of a language with too few texts for that is judged by the words that it repeats itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.chars import NUMBER, SPACE, Words, codepoints, kinds, slices
from docmill.plans.lineage import cut

#: Common words of each language.
COMMON = {
    "en": "a an and are as at be because before but by can do each every for from has have if in into is it its most must no not note of on one only or our own so than that the their then there they this to up use was we when while who why will with without you your after until first never",
    "de": "aber alle als am auch auf aus bei bevor bis da dabei damit danach das dass dem den der des die durch ein eine einem einen einer eines er erst es für hat im in ist kann mit nach nicht noch nur ob oder sich sie sind so sollte solange über um und vom von vor warum wenn wer wie wieder wird zu zum zur seit",
    "fr": "à au aux avec c ce ces cette d dans de des du elle en est et il ils indique j l la le les leur mais n ne nous on ou par pas plus pour pourquoi puis qu quand que qui s sa sans se ses si son sont sur tant un une utile chaque cas après depuis ensuite été",
    "es": "a al antes aunque cada caso como con cuando de del desde después donde el ella en es ese esta esté este está la las lo los luego más mientras muy ni no o para pero por porque qué que se ser si sin sobre son su sus también tras un una uno uso y ya",
}
_COMMON = {lang: frozenset(words.split()) for lang, words in COMMON.items()}

_WHITE = "".join(chr(c) for c in range(0x3001) if kinds()[c] == SPACE)
_WORD = re.compile(r"[^\W_]+")
_BULLET = re.compile(r"\s*(?:[-*+•◦▪‣·–—○●■□]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|(?:[-*+] )?\[[ xX]\])\s+\S")
_LEADER = re.compile(r"(?:\.{3,}|…{2,}|(?: \.){3,})\s*\S{1,6}$")
_LINK = re.compile(r"^<?(?:\[[^\]]*\]\([^)]*\)|https?://\S+)>?$")
_PAIR = re.compile(r"^[^:=|,;]{2,40}(?::| =| -| –) ?[^:=|;]{1,50}$")
_CLEAN = re.compile(r"^[^\W\d_][\w'’.\-/` ]*$")
_RULE = re.compile(r"^[\s|+:=-]+$")
_GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_END = re.compile(r"[.!?:;。！？…]['\"”»)*_`]*$")

#: What UTF-8 looks like when it is read as Windows-1252, first and further characters.
_GARBLED_FIRST = np.array([0xC3, 0xC2, 0xE2], np.uint32)
_GARBLED_SECOND = np.array([*range(0x80, 0xC0), *map(ord, "\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2020\u2021\u2022\u2026\u2030\u2039\u203a\u20ac\u2122")], np.uint32)
_DIGITS = np.array([c for c in range(0x1FBFA) if chr(c).isdigit()], np.uint32)
_RULE_HEADS = frozenset("|+:=-")
#: Texts of a language from which its common words are learnt, and the share of them that hold such a word.
LEARN_TEXTS, LEARN_SHARE = 30, 0.25
#: Share of common words from which a text without a known tag is in the best fitting language, and below which the tag decides.
FITS, HARDLY_FITS = 0.25, 0.1

STATS = [
    "n_words",  # words
    "word_length",  # mean characters of a word
    "symbol_share",  # characters that are neither letter, digit nor white space
    "digit_share",  # digits among the characters that aren't white space
    "end_share",  # filled lines that end in punctuation
    "common_share",  # common words of the best fitting language (of Japanese: kana among its characters; of ``other``: short words that come again)
    "distinct_share",  # distinct words, of texts up to 100 words; else mean over windows of 100
    "single_share",  # words of one character
    "longest",  # logarithm of the longest run without white space
    "garbled_share",  # wrongly decoded characters
    "repeat_share",  # filled lines that occurred before
    "list_share",  # share of the lines (a long one counts as several) that are items or entries
    "table_share",  # the same, that are rows of cells
]


def _cells(line: str) -> int:
    """Cells of a line that looks like a row of a table; 0 if it doesn't."""
    if _RULE.match(line) and ("-" in line or "=" in line) and ("|" in line or "+" in line):
        return 2
    for mark in ("|", "\t", ";"):
        if mark not in line:
            continue
        parts = line.strip(mark + " ").split(mark)
        if len(parts) >= 2 + (mark != "|" or not line.startswith("|")) and max(map(len, parts)) <= 40:
            return len(parts)
    if line.count(",") >= 2 and ", " not in line:
        parts = line.split(",")
        if max(map(len, parts)) <= 30:
            return len(parts)
    gaps = len(_GAPS.findall(line)) if "  " in line or "\t" in line else 0
    return gaps + 1 if gaps >= 2 else 0


class Known(NamedTuple):
    """Hashes of the common words of each language, sorted."""

    langs: list[str]
    words: list[np.ndarray]


def _hashes(words: Sequence[str]) -> np.ndarray:
    return np.unique(Words([" ".join(words)]).hash)


def known_languages(learnt: dict[str, np.ndarray] | None = None) -> Known:
    langs = {k: _hashes(sorted(v)) for k, v in _COMMON.items()} | (learnt or {})
    return Known(sorted(langs), [langs[k] for k in sorted(langs)])


def language_tag(tagged: Column) -> Column:
    return F.substring(F.lower(F.trim(tagged)), 1, 2)


def common_words(rows: DataFrame) -> dict[str, np.ndarray]:
    """Hashes of the words that LEARN_SHARE of a language's texts hold, of the languages (by tag) without a list that have LEARN_TEXTS or more."""
    tag = language_tag(F.col("lang"))
    other = rows.select(tag.alias("tag"), "text").filter(~F.coalesce(tag, F.lit("un")).isin(*_COMMON, "ja", "un", ""))
    many = {r.tag: r.n for r in other.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEARN_TEXTS).collect()}  # a row a language
    if not many:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = b.column(0).dictionary_encode()
            for start, part in slices(b.column(1).to_pylist()):
                w = Words(part)
                code = tags.indices.to_numpy(zero_copy_only=False)[start : start + len(part)]
                held = pd.DataFrame({"tag": code[w.doc], "doc": w.doc, "word": w.hash.view(np.int64)}).drop_duplicates()
                n = held.groupby(["tag", "word"], sort=False).size().reset_index(name="n")
                yield pa.RecordBatch.from_arrays([tags.dictionary.take(pa.array(n["tag"].to_numpy())), pa.array(n["word"].to_numpy()), pa.array(n["n"].to_numpy(np.int64))], ["tag", "word", "n"])

    counts = other.filter(F.col("tag").isin(*many)).mapInArrow(run, "tag string, word long, n long").groupBy("tag", "word").agg(F.sum("n").alias("n"))
    least = F.create_map(*(F.lit(x) for k, v in many.items() for x in (k, LEARN_SHARE * v)))
    found = counts.filter(F.col("n") >= least[F.col("tag")]).select("tag", "word").toPandas()  # at most 1 / LEARN_SHARE texts' words a language
    return {k: np.sort(g["word"].to_numpy().view(np.uint64)) for k, g in found.groupby("tag")}


def _line_shares(text: str, known: frozenset[str]) -> tuple[float, float, float, float]:
    """Shares of a text's lines: that end in punctuation, that occurred before, that are items, that are rows of cells."""
    lines = [x for x in (y.strip(_WHITE) for y in text.split("\n")) if x]
    seen: set[str] = set()
    widths: Counter[int] = Counter()
    repeats = items = rows = ends = filled = 0
    for x in lines:
        key = x.lower()
        head, size = x[0], len(x)
        rule = head in _RULE_HEADS and bool(_RULE.match(x))
        if key in seen and not rule:
            repeats += 1
        seen.add(key)
        if head == "#":
            continue  # headings are neither
        # a long line counts as those of a hundred characters that it would take
        weight = max(1.0, size / 100)
        filled += weight
        end = bool(_END.search(x, max(0, size - 40)))
        ends += weight * end
        spaces = x.count(" ")
        if not (head.isalpha() and x[1:2] not in (".", ")", " ", "\t")) and (m := _BULLET.match(x)):
            rest = x[m.end() - 1 :]
            # a running text cut into items: lines that begin and end within a sentence
            cut_up = rest[0].islower() and rest.count(" ") >= 4 and not end and any(w in known for w in rest.split())
            items += 0 if cut_up else weight
        elif (("..." in x or "\u2026\u2026" in x or " . ." in x) and _LEADER.search(x)) or ((head in "<[" or x.startswith("http")) and _LINK.match(x)):
            items += weight
        elif cells := _cells(x):
            widths[cells] += 1
            rows += weight
        elif spaces < 8 and size <= 80 and not end and (_PAIR.match(x) or (spaces < 5 and size <= 48 and spaces and _CLEAN.match(x))):
            items += weight
    filled = max(1, filled)
    # rows of cells make a table if there are several, most of them of one width
    if widths.total() < 2 or max(widths.values()) < 0.5 * widths.total():
        rows = 0
    return ends / filled, repeats / max(1, len(lines)), items / filled, rows / filled


def batch_statistics(texts: list[str], tags: list[str | None], known: Known) -> tuple[list[str], np.ndarray]:
    """(languages, STATS as columns) of some texts. The language is that whose common words fit best; where hardly
    any fit, the tagged one; ``other`` if that is unknown."""
    n_texts = len(texts)
    w = Words(texts)
    doc, width = w.doc, w.end - w.start
    cp, bounds = codepoints(texts)
    owner = np.repeat(np.arange(n_texts), np.diff(bounds))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(flags, False), np.minimum(bounds[:-1], len(cp)), dtype=np.int64) * (np.diff(bounds) > 0)

    kind = kinds()[cp]
    n = np.bincount(doc, minlength=n_texts)
    letters = np.bincount(doc, width, n_texts)
    solid = per_text(kind != SPACE)
    digits = per_text((kind == NUMBER) & np.isin(cp, _DIGITS))
    kana = (cp >= 0x3040) & (cp <= 0x30FF)
    cjk, kanas = per_text(kana | (cp >= 0x4E00) & (cp <= 0x9FFF)), per_text(kana)
    # runs without white space, cut at the ends of texts
    gap = np.unique(np.concatenate([np.flatnonzero(kind == SPACE), bounds[1:] - 0.5, [-0.5]]))
    longest = np.zeros(n_texts, np.int64)
    if len(cp):
        stops = np.ceil(gap[1:]).astype(np.int64)
        starts = np.floor(gap[:-1]).astype(np.int64) + 1
        real = stops > starts
        # they ascend, so those of a text are side by side
        runs, of = stops[real] - starts[real], owner[starts[real]]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
        longest[of[first]] = np.maximum.reduceat(runs, first) if len(of) else 0
    garbled = per_text(cp == 0xFFFD)
    if len(cp) > 1:
        pair = np.isin(cp[:-1], _GARBLED_FIRST) & np.isin(cp[1:], _GARBLED_SECOND) & (owner[1:] == owner[:-1])
        garbled += np.bincount(owner[:-1][pair], minlength=n_texts)
    # languages
    hits = np.stack([np.bincount(doc[_among(w.hash, words)], minlength=n_texts) for words in known.words])
    best = hits.argmax(axis=0)
    common = hits[best, np.arange(n_texts)] / np.maximum(1, n)
    # words in windows of a hundred, distinct ones, and short ones that come again in the text
    nth = np.arange(len(doc)) - w.offsets[doc]
    window = np.where(n[doc] <= 100, 0, nth // 100)
    whole = (n[doc] <= 100) | (window < n[doc] // 100)
    order = np.lexsort((w.hash, doc))  # stable: the places of a word in a text ascend
    d, h, v, inside, short = doc[order], w.hash[order], window[order], whole[order], width[order] <= 4
    same = np.append(False, (d[1:] == d[:-1]) & (h[1:] == h[:-1]))[: len(d)]
    fresh = ~same | np.append(False, v[1:] != v[:-1])[: len(d)]
    distinct = np.bincount(d[fresh & inside], minlength=n_texts) / np.maximum(1, np.where(n <= 100, n, n // 100 * 100))
    again = same | np.append(same[1:], False)[: len(d)]
    own = np.bincount(d[again & short], minlength=n_texts) / np.maximum(1, n)
    langs, lines = [], []
    for i, (text, tagged) in enumerate(zip(texts, tags, strict=True)):
        if cjk[i] * 3 > solid[i]:
            lang, common[i] = "ja", kanas[i] / max(1, cjk[i])
        else:
            lang = known.langs[best[i]]
            tag = (tagged or "").strip().lower()[:2]
            if tag not in known.langs:  # related languages share some words
                if common[i] < FITS:
                    lang, common[i] = "other", own[i]
            elif common[i] < HARDLY_FITS:
                lang = tag
        langs.append(lang)
        lines.append(_line_shares(text, _COMMON.get(lang, frozenset())))
    ends, repeats, items, rows = np.array(lines, float).reshape(-1, 4).T
    single = np.bincount(doc[width == 1], minlength=n_texts)
    columns = [n, letters / np.maximum(1, n), (solid - letters) / np.maximum(1, solid), digits / np.maximum(1, solid), ends, common, distinct, single / np.maximum(1, n), np.log(1 + longest), 2 * garbled / np.maximum(1, solid), repeats, items, rows]
    return langs, np.stack([np.asarray(c, float) for c in columns])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def statistics(text: str, tagged: str | None = None) -> tuple[str, list[float]]:
    """(language, STATS) of one text."""
    langs, columns = batch_statistics([text], [tagged], known_languages())
    return langs[0], columns[:, 0].tolist()


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, fits, STATS...) of the rows whose text isn't null or blank. Repeated ids stay.

    A null id, null text or text of only white space takes no part; other columns aren't read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("id IS NOT NULL AND text IS NOT NULL")
    id_type = dict(rows.dtypes)["id"]

    shared = df.sparkSession.sparkContext.broadcast(known_languages(common_words(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = b.column(2).to_pylist()
            for start, part in slices(b.column(1).to_pylist()):
                keep = [i for i, t in enumerate(part) if t.strip(_WHITE)]
                langs, columns = batch_statistics([part[i] for i in keep], [tags[start + i] for i in keep], shared.value)
                ids = b.column(0).take(pa.array([start + i for i in keep], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), *map(pa.array, columns)], ["id", "fits", *STATS])

    return rows.mapInArrow(run, f"id {id_type}, fits string, " + ", ".join(f"{s} double" for s in STATS)).withColumnRenamed("id", id_col)


def sketches(stats: DataFrame, accuracy: int = 2000) -> DataFrame:
    """Quantiles 5, 25, 50, 75 and 95 % of each statistic and language, from mergeable sketches."""
    return stats.groupBy("fits").agg(F.count(F.lit(1)).alias("texts"), *(F.percentile_approx(s, [0.05, 0.25, 0.5, 0.75, 0.95], accuracy).alias(f"q_{s}") for s in STATS))


#: Least spread that a statistic is held to have, so that z-scores of constant ones stay finite.
FLOOR = {"n_words": 50.0, "word_length": 0.4, "symbol_share": 0.02, "digit_share": 0.02, "end_share": 0.1, "common_share": 0.04, "distinct_share": 0.04, "single_share": 0.03, "longest": 0.25, "garbled_share": 0.005, "repeat_share": 0.05, "list_share": 0.1, "table_share": 0.1}


#: Robust standard deviations from which the share of items or cells is a tail of its distribution.
TAIL = 5.0
#: Share of short words that come again from which a text of an unknown language is natural.
OTHER_SHARE = 0.1


def with_scores(stats: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Adds ``z_<statistic>``: distance from the language's median in robust standard deviations.

    The spread is the smaller of the two half ranges between quartiles: texts that aren't prose pull
    at one side of a distribution, and may be a quarter of a language's texts and more.
    One row of quantiles for each language, so it is broadcast.
    """
    q = F.broadcast(quantiles.drop("texts"))
    score = [((F.col(s) - F.col(f"q_{s}")[2]) / F.greatest(F.least(F.col(f"q_{s}")[3] - F.col(f"q_{s}")[2], F.col(f"q_{s}")[2] - F.col(f"q_{s}")[1]) / 0.6745, F.lit(FLOOR[s]))).alias(f"z_{s}") for s in STATS]
    return stats.join(q, "fits").select(*stats.columns, *score)


def kind_of() -> Column:
    """``list``, ``table``, ``junk`` or ``prose`` of a row of :func:`with_scores`."""
    c = F.col
    garbled = (c("z_garbled_share") > 4) | ((c("single_share") > 0.5) & (c("digit_share") < 0.3))
    repeats = (c("repeat_share") > 0.5) | (c("z_distinct_share") < -7)
    strange = F.when(c("fits") == "other", (c("common_share") < OTHER_SHARE) | (c("word_length") > 15)).otherwise(c("z_common_share") < -4)
    alien = strange | (c("z_single_share") > 8) | (c("z_symbol_share") > 15) | (c("z_longest") > 12)
    return (
        F.when(garbled, "junk")
        .when((c("z_table_share") > TAIL) & ~(c("repeat_share") > 0.5), "table")
        .when((c("z_list_share") > TAIL) & ~(c("repeat_share") > 0.5), "list")
        .when(repeats | alien, "junk")
        .otherwise("prose")
    )


def text_kinds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, kind) of every text that isn't null or blank; of a repeated id the first kind by name."""
    stats = cut(text_statistics(df, id_col, text_col, lang_col))
    scored = with_scores(stats, sketches(stats)).select(id_col, kind_of().alias("kind"))
    return scored.groupBy(id_col).agg(F.min("kind").alias("kind"))
