"""Problem 3: the site's frame around and between the main body of a page.

Pages of a host are laid end to end as one stream of tokens: words (a run of numbers is one
token, the site's own name another) and an end-of-line token between lines. The suffixes of the stream
are sorted by prefix doubling; suffixes that agree in ``least`` tokens stand side by side in the suffix array, and
such an interval that holds suffixes of enough distinct pages is a repeated substring, within a line or across
lines. A substring from line end to line end counts at any length. What the repeated substrings cover
belongs to the frame; the page's unique runs are kept, from its title to its last run that is
long or reads like the body.

A host of many pages is dealt into blocks, each with a suffix array of its own. A substring with
enough pages in the host has at least its share of them in some block, so the blocks' own
repeated substrings, counted anew over the whole host, are exactly those of the host, whatever
the size of a block. A substring of the frame on several hosts counts on all: small hosts repeat too little.

Short unique runs at the end of a page (titles of related pages, links to the previous and next one) are told from the body's
by a classifier of lines, fitted on lines that need no judgement: those above the titles, and those of long unique runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.chars import SPACE, Words, codepoints, kinds, lower_map, mix, run_hashes, slices
from docmill.plans.lineage import cut
from docmill.plans.sizing import BROADCAST_ROWS, small_side

#: Characters of one block of a host; larger hosts have several.
BLOCK_CHARS = 4_000_000
#: Tokens of a repeated substring that needn't be whole lines.
LEAST = 20
#: Share of a host's pages that must hold a substring within the body, and at the page's ends.
SHARE, EDGE_SHARE = 0.05, 0.01
#: Share of a line's words that repeated substrings must cover.
COVER = 0.75
#: Words of a unique run that is surely body below the title.
LONG_RUN = 60
#: Log odds from which a line's kind counts as sure.
SURE = 3.0
#: Pages, at most, whose lines the classifier is fitted on, and the number of its hashed features.
SAMPLE_PAGES, FEATURES = 2000, 4096

_WHITE = "".join(chr(c) for c in range(0x3001) if kinds()[c] == SPACE)
_NUMBER, _BRAND, _LINE_END, _PAGE_END = (np.uint64(x) for x in (3, 11, 7, 13))
BLANK, TEXT, TITLE, HEADING, FENCE, CODE, ROW = range(7)
NONE, WEAK, STRONG = range(3)


class Lines(NamedTuple):
    """The lines of some pages, end to end."""

    texts: list[str]
    page: np.ndarray
    kind: np.ndarray
    tied: np.ndarray  # whether a line stands directly below a long one that ends within a sentence
    goes_on: np.ndarray  # and begins in lower case: it goes on a paragraph
    words: np.ndarray
    start: np.ndarray  # place in the stream of its first token
    stream: np.ndarray
    counts: np.ndarray  # lines of each page


def _brand_tokens(host: str | None) -> np.ndarray:
    """Tokens of the words of the site's own name: of the label before the top-level one."""
    labels = (host or "").split(".")
    name = labels[-2] if len(labels) >= 2 else labels[0]
    return np.unique(Words([name]).hash)


def page_lines(texts: list[str], host: str | None) -> Lines:
    """Lines, their Markdown structure, and the stream of tokens of pages of one host."""
    split = [t.split("\n") for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = [x for lines in split for x in lines]
    n = len(flat)
    page = np.repeat(np.arange(len(texts)), counts)
    w = Words(flat)
    cp, bounds = codepoints(flat)
    # of each line the first and last character that isn't white space
    solid = np.flatnonzero(kinds()[cp] != SPACE)
    lo, hi = np.searchsorted(solid, bounds[:-1]), np.searchsorted(solid, bounds[1:])
    filled = hi > lo
    ends = solid if len(solid) else np.zeros(1, np.int64)
    at_first, at_last = ends[np.minimum(lo, len(ends) - 1)], ends[np.maximum(hi - 1, 0)]
    head = np.where(filled, cp[at_first] if len(cp) else 0, 0)
    tail = np.where(filled, cp[at_last] if len(cp) else 0, 0)
    kind = np.where(filled, TEXT, BLANK).astype(np.int8)
    for i in np.flatnonzero(head == ord("#")).tolist():
        marks = flat[i].lstrip(_WHITE)
        level = len(marks) - len(marks.lstrip("#"))
        if level <= 6 and marks[level : level + 1] == " ":
            kind[i] = TITLE if level == 1 else HEADING
    kind[head == ord("|")] = ROW
    fence, of = "", -1
    marked = {i: m for i in np.flatnonzero((head == ord("`")) | (head == ord("~"))).tolist() if (m := flat[i].lstrip(_WHITE)[:3]) in ("```", "~~~")}
    opened = 0
    for i, m in marked.items():
        if fence and of != page[i]:  # open to the end of its page
            stop = int(np.searchsorted(page, of, "right"))
            kind[opened + 1 : stop][kind[opened + 1 : stop] != BLANK] = CODE
            fence = ""
        if not fence:
            fence, of, opened = m, page[i], i
            kind[i] = FENCE
        elif m == fence:
            kind[opened + 1 : i] = CODE
            kind[i], fence = FENCE, ""
    if fence:
        stop = int(np.searchsorted(page, of, "right"))
        kind[opened + 1 : stop][kind[opened + 1 : stop] != BLANK] = CODE
    kind[(kind == CODE) & ~filled] = BLANK
    stops = np.isin(tail, np.array([ord(c) for c in ".!?:;,…。！？\"')*_`|"]))
    long = bounds[1:] - bounds[:-1] > 40
    lower = filled & (lower_map()[head] == head) & (kinds()[head] == 1)
    tied = np.zeros(n, bool)
    tied[1:] = (kind[1:] == TEXT) & (kind[:-1] == TEXT) & long[:-1] & ~stops[:-1] & (page[1:] == page[:-1])
    goes_on = tied & lower
    # tokens
    digits = np.concatenate([[0], np.cumsum(kinds()[cp] == 2)])
    word_line = w.doc
    start, end = w.start + bounds[word_line], w.end + bounds[word_line]
    number = digits[end] - digits[start] == end - start
    tokens = np.where(number, _NUMBER, w.hash)
    tokens[np.isin(tokens, _brand_tokens(host))] = _BRAND
    again = np.zeros(len(tokens), bool)
    again[1:] = (tokens[1:] == tokens[:-1]) & (number[1:] | (tokens[1:] == _BRAND)) & (word_line[1:] == word_line[:-1])
    tokens, word_line = tokens[~again], word_line[~again]
    bare = np.flatnonzero(filled & (np.bincount(word_line, minlength=n) == 0))  # lines of symbols only
    if len(bare):
        marks = mix(np.array([zlib.crc32(flat[i].strip(_WHITE).encode()) for i in bare.tolist()], np.uint64))
        tokens, word_line = np.concatenate([tokens, marks]), np.concatenate([word_line, bare])
        order = np.argsort(word_line, kind="stable")
        tokens, word_line = tokens[order], word_line[order]
    words = np.bincount(word_line, minlength=n)
    # an end-of-line token before each filled line that isn't tied to the one above, and one after the last of a page with a page end
    has = (words > 0) & ~tied
    last_of_page = np.zeros(n, bool)
    last_of_page[np.cumsum(counts) - 1] = True
    size = words + has + 2 * last_of_page
    first = np.cumsum(size) - size
    stream = np.full(int(size.sum()), _LINE_END, np.uint64)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(words) - words, words) + (first + has)[word_line]
    stream[place] = tokens
    stream[(first + size - 1)[last_of_page]] = _PAGE_END
    return Lines(flat, page, kind, tied, goes_on, words, first + has, stream, counts)


def _one_page(x: Lines, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the places have their next ``length`` tokens within one page (whose end may be the last of them)."""
    ends = np.cumsum(x.stream == _PAGE_END)
    before = ends[at] - (x.stream[at] == _PAGE_END)
    return ends[at + length - 2] == before if length > 1 else np.ones(len(at), bool)


def _within_page(x: Lines, length: int) -> np.ndarray:
    """Places whose next ``length`` tokens lie within one page."""
    at = np.arange(max(0, len(x.stream) - length + 1))
    return at[_one_page(x, at, length)]


def _stream_page(x: Lines) -> np.ndarray:
    return np.cumsum(x.stream == _PAGE_END) - (x.stream == _PAGE_END)


def line_names(x: Lines, usable: np.ndarray) -> np.ndarray:
    """A name of the substring from line end to line end of each usable line."""
    out = np.zeros(len(x.words), np.uint64)
    at = np.flatnonzero(usable)
    if not len(at):
        return out
    h = np.zeros(len(at), np.uint64)
    longest = int(x.words[at].max())
    todo, k = np.arange(len(at)), 0
    with np.errstate(over="ignore"):
        while len(todo) and k < longest:
            todo = todo[x.words[at[todo]] > k]
            h[todo] = h[todo] * np.uint64(0xC2B2AE3D27D4EB4F) + x.stream[x.start[at[todo]] + k]
            k += 1
        out[at] = mix(h + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return out


def gram_names(x: Lines, at: np.ndarray, least: int) -> np.ndarray:
    """Names of the substrings of ``least`` tokens at places of the stream; even, unlike those of lines."""
    return run_hashes(x.stream, at, least) & ~np.uint64(1)


def usable_lines(x: Lines) -> np.ndarray:
    return (x.words > 0) & ~x.goes_on & ((x.kind == TEXT) | (x.kind == TITLE) | (x.kind == HEADING))


def _pages_of(group: np.ndarray, n_groups: int, page: np.ndarray, n_pages: int) -> np.ndarray:
    """Number of distinct pages of each group."""
    pairs = np.unique(group.astype(np.int64) * n_pages + page)
    return np.bincount(pairs // n_pages, minlength=n_groups)


def repeated_substrings(x: Lines, least: int, support: float) -> tuple[np.ndarray, np.ndarray]:
    """(names, distinct pages) of the substrings of ``least`` tokens, and of the whole lines, that at least ``support`` pages hold.

    Prefix doubling: the ranks of all suffixes by 1, 2, 4, ... tokens, the last step overlapping, order the suffixes by
    ``least`` tokens; runs of one rank in that order are the intervals of the suffix array whose common prefix is as long.
    """
    n_pages = len(x.counts)
    names, pages = [], []
    if len(x.stream) >= least:
        rank = pd.factorize(x.stream, sort=True)[0].astype(np.int64)
        alive = np.flatnonzero(np.bincount(rank)[rank] >= support)
        width = 1
        while width < least and len(alive):
            step = min(width, least - width)
            held = np.zeros(len(rank) + step, bool)
            held[alive] = True
            at = alive[held[alive + step]]  # of a prefix that often, both halves come as often
            pair = rank[at] * np.int64(int(rank.max()) + 1) + rank[at + step]
            code, distinct = pd.factorize(pair, sort=True)
            often = np.bincount(code, minlength=len(distinct))[code] >= support
            alive = at[often]
            rank[alive] = code[often]
            width += step
        inside = alive[_one_page(x, alive, least)]
        order = inside[np.argsort(rank[inside], kind="stable")]  # the part of the suffix array whose prefixes come often enough
        r = rank[order]
        begins = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
        interval = np.cumsum(np.append(True, r[1:] != r[:-1])[: len(r)]) - 1
        size = np.diff(np.append(begins, len(r)))
        wide = size >= support
        keep = wide[interval] if len(r) else np.zeros(0, bool)
        held = _pages_of(interval[keep], len(begins), _stream_page(x)[order[keep]], n_pages)
        found = np.flatnonzero(held >= support)
        names.append(gram_names(x, order[begins[found]], least))
        pages.append(held[found])
    usable = usable_lines(x)
    name = line_names(x, usable)[usable]
    group, distinct = pd.factorize(name)
    held = _pages_of(group, len(distinct), x.page[usable], n_pages)
    names.append(distinct[held >= support])
    pages.append(held[held >= support])
    return np.concatenate(names), np.concatenate(pages)


def marks(x: Lines, weak: np.ndarray, strong: np.ndarray, least: int) -> np.ndarray:
    """NONE, WEAK or STRONG for each line: whether repeated substrings cover most of it. ``weak`` and ``strong`` are sorted names."""
    usable = usable_lines(x)
    text = usable | x.goes_on
    out = np.zeros(len(x.words), np.int8)
    inside = _within_page(x, least)
    grams, lines = gram_names(x, inside, least), line_names(x, usable)
    for mark, known in ((WEAK, weak), (STRONG, strong)):
        at = inside[_among(grams, known)]
        edge = np.bincount(at, minlength=len(x.stream) + 1) - np.bincount(at + least, minlength=len(x.stream) + 1)
        sums = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        covered = sums[np.minimum(x.start + x.words, len(x.stream))] - sums[np.minimum(x.start, len(x.stream))]
        out[text & (covered >= COVER * x.words)] = mark
        out[usable & _among(lines, known)] = mark
    return out


def _among(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(names), bool)
    return known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names


# unique runs


def line_features(line: str) -> list[int]:
    """Hashed features of a line: its symbols, its first and last characters, its first words, its length."""
    bare = line.strip(_WHITE)
    words = bare.split()
    symbols = [c for c in set(bare) if not c.isalnum() and c != " "]
    shape = [f"s{c}" for c in symbols] + [f"n{min(len(words), 12)}", f"l{min(len(bare), 160) // 20}"]
    ends = [f"f{'a' if bare[:1].isalpha() else '0' if bare[:1].isdigit() else bare[:1]}", f"e{'a' if bare[-1:].isalpha() else '0' if bare[-1:].isdigit() else bare[-1:]}", f"u{bare[:1].isupper()}"]
    opening = [f"w{words[0].lower()}", "v" + " ".join(words[:2]).lower()] if words else []
    return [zlib.crc32(f.encode()) % FEATURES for f in (*shape, *ends, *opening)]


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, line: str) -> float:
        """Log odds that the line is body."""
        return float(self.weights[line_features(line)].sum() + self.bias)


def fit_lines(lines: list[str], body: list[bool], rounds: int = 150) -> Model:
    """Logistic regression on hashed features; both kinds weigh the same. Without one of the kinds, all is body."""
    y = np.array(body, bool)
    if not y.any() or y.all():
        return Model(np.zeros(FEATURES), 1.0)
    feats = [line_features(t) for t in lines]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, bias = np.zeros(FEATURES), 0.0
    square, square_bias = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, w[flat], len(y)) + bias
        g = (1 / (1 + np.exp(-z)) - y) * weight
        grad = np.bincount(flat, g[owner], FEATURES) + 1e-5 * w
        square += grad**2
        square_bias += g.sum() ** 2
        w -= 0.3 * grad / np.sqrt(square)
        bias -= 0.3 * g.sum() / np.sqrt(square_bias)
    return Model(w, bias)


class Page(NamedTuple):
    kind: np.ndarray
    mark: np.ndarray
    words: np.ndarray
    tied: np.ndarray  # whether a line stands directly below a long one that ends within a sentence

    def runs(self) -> list[tuple[np.ndarray, int, bool]]:
        """(lines, words, holds code or a table) of each unique run: filled lines without repeated ones between them."""
        at = np.flatnonzero(self.kind != BLANK)
        inside = (self.kind[at] == FENCE) | (self.kind[at] == CODE) | (self.kind[at] == ROW)
        unique = inside | (self.mark[at] == NONE)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], unique, [False]]).astype(np.int8)))
        return [(at[a:b], int(self.words[at[a:b]].sum()), bool(inside[a:b].any())) for a, b in zip(edge[0::2], edge[1::2], strict=True)]

    def title(self) -> int:
        found = np.flatnonzero((self.kind == TITLE) & (self.mark != STRONG))
        return int(found[0]) if len(found) else -1


def examples(p: Page) -> tuple[np.ndarray, np.ndarray]:
    """(lines of the frame, lines of the body) that need no judgement: unique ones above the title and short
    runs between repeated lines below the last long run; and those of long runs below the title."""
    top, runs = p.title(), p.runs()
    if top < 0:
        return np.empty(0, int), np.empty(0, int)
    text = (p.kind == TEXT) | (p.kind == HEADING)
    long = [r for r in runs if r[0][0] >= top and (r[1] >= LONG_RUN // 2)]
    if not long:
        return np.empty(0, int), np.empty(0, int)
    last = long[-1][0][-1]
    after = [r[0] for r in runs if r[0][0] > last and r[1] < LONG_RUN // 2 and not r[2]]
    frame = np.concatenate([r[0][r[0] < top] for r in runs] + after)
    body = np.concatenate([r[0][r[0] > top] for r in long])
    return frame[text[frame]], body[text[body]]


def frame_of(p: Page, lines: list[str], model: Model) -> np.ndarray:
    """Which lines of a page belong to the frame."""
    n = len(p.kind)
    filled = p.kind != BLANK
    inside = (p.kind == FENCE) | (p.kind == CODE) | (p.kind == ROW)
    frame = np.zeros(n, bool)
    top, runs = p.title(), p.runs()
    if top < 0:
        long = [r for r in runs if r[1] >= LONG_RUN // 2 or r[2]]
        if not long:
            return filled  # no body at all
        top = int(long[0][0][0])
    last = top
    for at, words, _ in reversed(runs):
        at = at[at > top]
        if not len(at):
            break
        # from the end up: the lines of least sum are the frame's; the search ends where the body is sure
        end, total, least = len(at), 0.0, 0.0
        for k in range(len(at) - 1, -1, -1):
            score = SURE if inside[at[k]] or p.words[at[k]] >= LONG_RUN // 2 else model.score(lines[at[k]])
            if p.tied[at[k]] and k and at[k] == at[k - 1] + 1:  # the rest of a paragraph goes with it
                score = max(score, 0.0)
            total += score
            if total < least:
                end, least = k, total
            if total > least + 4 * SURE:
                break
        rest = total - least  # of the lines above the cut that were looked at
        if rest > SURE or (rest > 0 and least == 0) or words >= 2 * LONG_RUN:
            last = int(at[end - 1 if end else -1])
            break
    frame[:top] = filled[:top]
    frame[last + 1 :] = filled[last + 1 :]
    middle = slice(top + 1, last + 1)
    frame[middle] = (p.mark[middle] == STRONG) & ~inside[middle] & filled[middle]
    at = np.flatnonzero(filled)
    for k in range(len(at) - 2, -1, -1):  # a heading within the body only with what stands below it
        if p.kind[at[k]] == HEADING and top < at[k] <= last and not frame[at[k + 1]]:
            frame[at[k]] = False
    return frame


def _pages(x: Lines, mark: np.ndarray) -> Iterator[tuple[Page, list[str]]]:
    stop = 0
    for n in x.counts.tolist():
        here = slice(stop, stop + n)
        yield Page(x.kind[here], mark[here], x.words[here], x.tied[here]), x.texts[here]
        stop += n


# over tables


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Runs of rows with one host within batches (rows with column ``host``)."""
    for b in batches:
        if b.num_rows:
            codes = b.column("host").dictionary_encode()
            order = np.argsort(codes.indices.to_numpy(zero_copy_only=False), kind="stable")
            c = codes.indices.to_numpy(zero_copy_only=False)[order]
            starts = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                yield codes.dictionary[c[i]].as_py(), pa.Table.from_batches([b]).take(pa.array(order[i:j]))


def block_names(df: DataFrame, least: int, edge_share: float) -> DataFrame:
    """(host, block, total, text), whole blocks together -> the repeated substrings of each: host, name, pages.

    ``total`` is the host's number of pages; the support asked of a block is the host's in proportion to the block's pages.
    """

    def names(t: pa.Table) -> pa.RecordBatch:
        host, total = t.column("host")[0].as_py(), t.column("total")[0].as_py()
        x = page_lines([s or "" for s in t.column("text").to_pylist()], host)
        need = max(2.0, edge_share * total) * t.num_rows / total
        name, pages = repeated_substrings(x, least, max(need, 1.0 if t.num_rows < total else 2.0))
        return pa.RecordBatch.from_arrays([pa.array([host] * len(name), pa.string()), pa.array(name.view(np.int64)), pa.array(pages.astype(np.int64))], ["host", "name", "pages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            keys = t.select(["host", "block"]).to_pandas()
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                yield names(t.slice(lo, hi - lo))
            held = t.slice(starts[-1]).to_batches()
        if held:
            yield names(pa.Table.from_batches(held))

    return df.mapInArrow(run, "host string, name long, pages long")


def with_names(texts: DataFrame, names: DataFrame, n_names: int, work: Callable[[str, pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(host, rows, weak, strong)`` over rows (host, block, key, text) with the sorted names (host, name, strong) of their host.

    Names within the limit of a broadcast go to all workers; beyond it those of a host are dealt to all of its blocks.
    """
    spark = texts.sparkSession
    if n_names <= BROADCAST_ROWS:
        table = names.select("host", "name", "strong").toPandas()
        shared = spark.sparkContext.broadcast({h: _grades(g["name"].to_numpy(), g["strong"].to_numpy()) for h, g in table.groupby("host")})
        none = np.empty(0, np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for host, t in _by_host(batches):
                yield work(host, t, *shared.value.get(host, (none, none)))

        return texts.select("host", "key", "text").mapInArrow(run, schema)

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, name, strong = None, np.empty(0, np.int64), np.empty(0, bool)
        for b in batches:
            keys = pd.DataFrame({"host": b.column("host").to_pylist(), "block": b.column("block").to_numpy()})
            starts = np.append(np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()), len(keys))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                t = pa.Table.from_batches([b.slice(lo, hi - lo)])
                if of != tuple(keys.iloc[lo]):
                    of, name, strong = tuple(keys.iloc[lo]), np.empty(0, np.int64), np.empty(0, bool)
                mine = t.filter(t.column("name").is_valid())  # before the block's pages
                name, strong = np.append(name, mine.column("name").to_numpy()), np.append(strong, mine.column("strong").to_numpy().astype(bool))
                pages = t.filter(t.column("name").is_null())
                if pages.num_rows:
                    yield work(of[0], pages, *_grades(name, strong))

    dealt = names.join(texts.select("host", "block").distinct(), "host").select("host", "block", "name", "strong", F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("text"))
    both = dealt.unionByName(texts.select("host", "block", F.lit(None).cast("long").alias("name"), F.lit(None).cast("boolean").alias("strong"), "key", "text"))
    return both.repartition("host", "block").sortWithinPartitions("host", "block", F.col("name").asc_nulls_last()).mapInArrow(run_blocks, schema)


def _grades(name: np.ndarray, strong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name = name.view(np.uint64)
    return np.unique(name), np.unique(name[strong.astype(bool)])


def recount(texts: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """(host, name, pages) of the candidate names, over all pages of their hosts."""

    def counted(host: str, t: pa.Table, known: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        out_names, out_pages = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, part in slices(t.column("text").to_pylist() if len(known) else []):
            x = page_lines(part, host)
            inside, usable = _within_page(x, least), usable_lines(x)
            names = np.concatenate([gram_names(x, inside, least), line_names(x, usable)[usable]])
            page = np.concatenate([_stream_page(x)[inside], x.page[usable]])
            hit = _among(names, known)
            group, distinct = pd.factorize(names[hit])
            out_names.append(distinct)
            out_pages.append(_pages_of(group, len(distinct), page[hit], len(part)))
        name, pages = np.concatenate(out_names), np.concatenate(out_pages)
        return pa.RecordBatch.from_arrays([pa.array([host] * len(name), pa.string()), pa.array(name.view(np.int64)), pa.array(pages.astype(np.int64))], ["host", "name", "pages"])

    held = candidates.select("host", "name", F.lit(False).alias("strong"))
    rows = with_names(texts, held, held.count(), counted, "host string, name long, pages long")
    return rows.groupBy("host", "name").agg(F.sum("pages").alias("pages"))


def host_names(texts: DataFrame, least: int, share: float, edge_share: float, hosts_share: float = 0.01) -> tuple[DataFrame, np.ndarray]:
    """((host, name, strong) of the repeated substrings of each host, sorted names of those that hold everywhere).

    Everywhere hold those of two hosts that are at least ``hosts_share`` of all; these are at most
    ``1 / hosts_share`` times as many as a host has on average, so they may go to every worker.
    """
    together = texts.repartition("host", "block").sortWithinPartitions("host", "block", "key").select("host", "block", "total", "text")
    own = cut(block_names(together, least, edge_share))
    sizes = cut(texts.groupBy("host").agg(F.max("total").alias("total"), F.max("blocks").alias("blocks")))
    n_hosts = sizes.count()
    several = sizes.filter("blocks > 1").select("host")
    n_several = several.count()
    counted = own.join(small_side(several, n_several), "host", "left_anti")
    if n_several:
        candidates = own.join(small_side(several, n_several), "host", "left_semi").select("host", "name").distinct()
        counted = counted.unionByName(recount(texts.join(small_side(several, n_several), "host", "left_semi"), cut(candidates), least))
    held = counted.join(small_side(sizes.select("host", "total"), n_hosts), "host")
    names = held.select("host", "name", "pages", (F.col("pages") >= F.greatest(F.lit(2.0), F.col("total") * share)).alias("strong"), (F.col("pages") >= F.greatest(F.lit(2.0), F.col("total") * edge_share)).alias("weak"))
    names = cut(names.filter("weak").select("host", "name", "strong"))
    spread = names.groupBy("name").agg(F.count(F.lit(1)).alias("hosts")).filter(F.col("hosts") >= max(2.0, hosts_share * n_hosts)).select("name")
    everywhere = np.sort(spread.toPandas()["name"].to_numpy(np.int64).view(np.uint64))
    return names, everywhere


def frame_lines(
    df: DataFrame,
    id_col: str = "page_id",
    text_col: str = "markdown",
    host: Column | None = None,
    block_chars: int = BLOCK_CHARS,
    least: int = LEAST,
    share: float = SHARE,
    edge_share: float = EDGE_SHARE,
    sample_pages: int = SAMPLE_PAGES,
) -> DataFrame:
    """Distinct (id, line_no) of the lines that don't belong to their page's main body.

    Lines of only white space are never named. Pages without a host are taken as one host; a null id or
    text takes no part; an empty text has no lines; repeated rows of a page count once. A page without
    any body is all frame. Support counts the distinct texts of a host: of exact copies one is looked at, and
    its lines are those of all. The size of a block changes no result.
    """
    spark = df.sparkSession
    source = F.coalesce(host, F.lit("")) if host is not None else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), source.alias("host"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    keyed = rows.withColumn("key", F.xxhash64("host", F.xxhash64("text"), F.xxhash64(F.lit(71), F.col("text"))))
    several = cut(keyed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key", "id"))
    n_several = several.count()
    texts = keyed
    if n_several:
        held = keyed.drop("id").join(small_side(several, n_several), "key").groupBy("key").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("text").alias("text"))
        texts = keyed.join(small_side(several.select("key"), n_several), "key", "left_anti").select("key", "id", "host", "text").unionByName(held)
    sizes = cut(texts.groupBy("host").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.sum(F.length("text")) / block_chars).cast("int").alias("blocks")).withColumn("blocks", F.greatest("blocks", F.lit(1))))
    texts = texts.join(small_side(sizes, sizes.count()), "host").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("host", "block", "blocks", "total", "key", "text")
    names, everywhere = host_names(texts, least, share, edge_share)
    n_names = names.count()
    shared = spark.sparkContext.broadcast(everywhere)

    def marked(host: str, t: pa.Table, weak: np.ndarray, strong: np.ndarray) -> Iterator[tuple[int, Page, list[str]]]:
        weak, strong = np.union1d(weak, shared.value), np.union1d(strong, shared.value)
        for start, part in slices(t.column("text").to_pylist()):
            x = page_lines(part, host)
            for k, (p, lines) in enumerate(_pages(x, marks(x, weak, strong, least))):
                yield start + k, p, lines

    def learn(host: str, t: pa.Table, weak: np.ndarray, strong: np.ndarray) -> pa.RecordBatch:
        out, kind = [], []
        for _, p, lines in marked(host, t, weak, strong):
            frame, body = examples(p)
            out += [lines[i] for i in (*frame, *body)]
            kind += [False] * len(frame) + [True] * len(body)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(kind, pa.bool_())], ["line", "body"])

    total = texts.count()
    sampled = texts.filter(F.pmod(F.xxhash64(F.lit(5), F.col("key")), F.lit(1 << 30)) < int(min(1.0, 0.9 * sample_pages / max(1, total)) * (1 << 30)))
    known = with_names(sampled, names, n_names, learn, "line string, body boolean").limit(50 * sample_pages).toPandas().sort_values(["body", "line"])
    model = spark.sparkContext.broadcast(fit_lines(known["line"].tolist(), known["body"].tolist()))

    def decide(host: str, t: pa.Table, weak: np.ndarray, strong: np.ndarray) -> pa.RecordBatch:
        lines_of = [np.flatnonzero(frame_of(p, lines, model.value)) + 1 for _, p, lines in marked(host, t, weak, strong)]
        return pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(lines_of, pa.list_(pa.int64()))], ["key", "lines"])

    of_text = with_names(texts, names, n_names, decide, "key long, lines array<long>")
    return keyed.select("id", "key").join(of_text, "key").select("id", F.explode("lines").alias("line_no")).distinct().withColumnRenamed("id", id_col)


def main_body(df: DataFrame, id_col: str = "page_id", text_col: str = "markdown", host: Column | None = None) -> DataFrame:
    """(id, text): each page's text without its frame's lines; null stays null."""
    gone = frame_lines(df, id_col, text_col, host).groupBy(id_col).agg(F.collect_set("line_no").alias("_gone"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("long")))
    text = F.when(F.size("_gone") > 0, F.array_join(lines, "\n")).otherwise(F.col("_text"))
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).join(gone, id_col, "left").select(id_col, text.alias("text"))
