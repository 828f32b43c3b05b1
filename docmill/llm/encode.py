"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

A byte-level BPE never merges across the pieces of its pre-tokenizer. Each Arrow
batch is therefore cut into pieces by array operations, and the tokenizers
library encodes each distinct piece once per Python worker; a batch's ids are then
gathered from those of its pieces. The result is that of the library on whole
texts, at a fraction of its cost.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.chars import LETTER, NUMBER, SPACE, codepoints, kinds, ragged, slices, span_hashes

#: Distinct pieces that a worker remembers before it starts afresh (some 100 bytes each).
REMEMBERED = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a vocabulary file: in $DOCMILL_TOKENIZERS, else of the installed package, else /opt/tokenizers."""
    if folder := os.environ.get("DOCMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


@functools.lru_cache(4)
def tokenizer(path: str):
    """The tokenizer of ``path``; strings of its special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def piece_bounds(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokenizer's pieces of texts laid end to end.

    A piece is, in this order of preference: a contraction ('s 't 're 've 'm 'll 'd); a run of
    letters, of numbers or of other characters, each with at most one space before it; white
    space (which leaves its last character to what follows).
    """
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = kinds()[cp]
    head = np.zeros(n + 1, bool)
    head[bounds] = True  # a text begins here
    tail = head[1:]  # a text ends here
    head = head[:-1]
    space = kind == SPACE
    same = np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    same &= ~head
    blank = cp == 0x20
    before = np.zeros(n, bool)  # a plain space of the same text comes before
    before[1:] = blank[:-1]
    before &= ~head
    start = ~same
    start &= ~(before & ~space)  # its space begins the piece
    last = space & ~tail
    last[:-1] &= ~space[1:]
    start |= last  # the last white space before something else
    tick = np.flatnonzero((cp == 0x27) & ~before & ~same & ~tail)
    if len(tick):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        one, two = pad[tick + 1], pad[tick + 2]
        fits = tick + 2 <= bounds[np.searchsorted(bounds, tick, "right")] - 1
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = fits & ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        hit = short | long
        tick, size = tick[hit], np.where(short, 2, 3)[hit]
        start[tick + 1] = False
        after = tick + size
        start[after[after < n]] = True  # what follows begins a piece of its own
        # a space that follows is decided as above, so only starts are added here
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


class Encoder:
    """Encodes lists of texts; remembers the ids of the pieces it has met."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        at = len(self.known)
        self.known.update(zip(hashes, range(at, at + len(hashes)), strict=True))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.int32, int(lengths.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the offsets of each text's ids."""
        cp, bounds = codepoints(texts)
        starts, ends = piece_bounds(cp, bounds)
        codes, distinct = pd.factorize(span_hashes(cp, starts, ends))
        if len(self.known) > REMEMBERED:
            self.forget()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            first = np.full(len(keys), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            spans = first[new]
            raw = cp.tobytes()
            self._learn([keys[i] for i in new], [raw[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
        which = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[codes]
        ids, offsets = ragged(self.ids, self.ends, which)
        return ids, offsets[np.searchsorted(starts, bounds)]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of each row by the byte-level BPE of ``path``, without special tokens.

    A null and an empty text give an empty list; text that looks like a special token is ordinary
    text; whole texts are encoded, however long. Repeated ids stay repeated rows; a null id stays null.
    Other columns are not read. No shuffle: one pass over Arrow batches.
    """
    path = path or vocabulary_path()
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for first, part in slices(texts):
                ids, offsets = enc.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), lists], ["id", "ids"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


@functools.lru_cache(1)
def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own byte, the other bytes
    for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    t, table = tokenizer(path), byte_of_char()
    out = []
    for i in range(t.get_vocab_size()):
        token = t.id_to_token(i) or ""
        out.append(bytes(table[c] for c in token) if all(c in table for c in token) else token.encode())
    return out


def token_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, starts, ends): the characters of the text that each token covers.

    A token that holds only part of a character's bytes covers that whole character, so tokens of a
    split character overlap. Null and empty texts give empty lists.
    """
    path = path or vocabulary_path()
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = np.fromiter(map(len, token_bytes(path)), np.int64)
        for b in batches:
            for first, part in slices(b.column(1).to_pylist()):
                ids, offsets = enc.encode(part)
                cp, bounds = codepoints(part)
                size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
                char_of_byte = np.repeat(np.arange(len(cp)), size)
                ends = np.cumsum(width[ids])
                doc = np.repeat(np.arange(len(part)), np.diff(offsets))
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((x - bounds[doc]).astype(np.int32)))
                    for x in (char_of_byte[ends - width[ids]], char_of_byte[ends - 1] + 1)
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), *lists], ["id", "starts", "ends"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", id_type), T.StructField("starts", ints), T.StructField("ends", ints)])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of a list of ids by reversing the byte table; bytes that end within a character become U+FFFD."""
    path = path or vocabulary_path()

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = token_bytes(path)
        for s in batches:
            yield s.map(lambda x: None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace"))

    return run(ids)
