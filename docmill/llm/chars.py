"""Whole Arrow batches of text as code-point arrays: spans, words, hashes.

Texts of a batch are laid end to end in one ``uint32`` array, so that
segmentation and hashing are a fixed number of NumPy passes rather than a Python
step for each word. Hashes are 64-bit polynomial hashes taken from prefix sums
(every span in constant time) and mixed afterwards.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

#: Characters taken into one array at most (a longer single text comes alone).
SLICE_CHARS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LIMIT = 0x110000

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def mix1(x: int) -> int:
    """:func:`mix` of one number."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


@functools.lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point: letter (L*), number (N*), White_Space, or other."""
    out = np.zeros(_LIMIT, np.uint8)
    for c in range(0x32400):
        k = unicodedata.category(chr(c))[0]
        out[c] = LETTER if k == "L" else NUMBER if k == "N" else OTHER
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


@functools.lru_cache(1)
def word_chars() -> np.ndarray:
    """For each code point: whether it is a letter or a digit, that is, part of a word."""
    k = kinds()
    return (k == LETTER) | (k == NUMBER)


@functools.lru_cache(1)
def lower_map() -> np.ndarray:
    """Lower case of each code point whose lower case is one code point; else itself."""
    out = np.arange(_LIMIT, dtype=np.uint32)
    for c in range(0x32400):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


@functools.lru_cache(1)
def _scramble() -> np.ndarray:
    return mix(np.arange(1, _LIMIT + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_powers: list[np.ndarray] = []


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_CHARS + 1)
        with np.errstate(over="ignore"):
            for base in (_BASE, _BASE_INV):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _powers.append(np.multiply.accumulate(a))
        del _powers[:-2]
    return _powers[0], _powers[1]


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) for runs of texts of at most ``limit`` characters together."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points end to end, and the offsets of the texts (one more than texts)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``cp``; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # blocks of spans, so that prefix sums stay small for very long texts
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_CHARS, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_arrays(hi - lo + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_scramble()[cp[lo:hi]] * up[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """Words (longest runs of letters and digits, in lower case) of a list of texts.

    ``hash``: 64-bit hash of each word; ``doc``: the text that holds it; ``start`` and ``end``:
    its place in that text; ``offsets``: first word of each text (one more than texts).
    """

    def __init__(self, texts: list[str]):
        # two capital letters whose lower case depends on more than the character itself
        texts = [t.lower() if "İ" in t or "Σ" in t else t for t in texts]
        cp, bounds = codepoints(texts)
        inside = word_chars()[cp]
        edge = np.empty(len(cp) + 1, bool)
        edge[0], edge[-1] = len(cp) and inside[0], len(cp) and inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(cp))]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
        at = np.flatnonzero(edge[:-1] if not len(cp) or not inside[-1] else edge)
        if len(cuts):  # a text that ends in a word, before one that begins with a word
            at = np.sort(np.concatenate([at, cuts, cuts]))
        starts, ends = at[0::2], at[1::2]
        self.hash = span_hashes(lower_map()[cp], starts, ends)
        self.offsets = np.searchsorted(starts, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.start, self.end = starts - bounds[self.doc], ends - bounds[self.doc]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` consecutive words, and the offsets of each text's runs."""
        counts = np.maximum(0, np.diff(self.offsets) - n + 1)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if not offsets[-1]:
            return np.empty(0, np.uint64), offsets
        at = np.repeat(self.offsets[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
        return run_hashes(self.hash, at, n), offsets


def run_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` word hashes that begin at the places ``at``."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[at + k]
        return mix(out + np.uint64(n))


def ragged(values: np.ndarray, offsets: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``order`` of a ragged array: their values end to end, and their offsets."""
    lengths = (offsets[1:] - offsets[:-1])[order]
    out = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(offsets[:-1][order] - out[:-1], lengths) + np.arange(out[-1])
    return values[at], out
