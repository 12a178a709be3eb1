"""Byte-level BPE of a public tokenizer over whole columns.

Pre-tokens are encoded with a rank queue: one bucket of linked-list positions per merge rank, and a bitmap of two levels
over the ranks, so the next merge is a find-first-set and never a scan of the pre-token. Entries whose pair has changed are
skipped when they come up. Time is near linear in the length of a pre-token, however long it is. Encoded pre-tokens are
remembered per worker in a cache of bounded size.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Folder of the public tokenizers' vocabularies; always a parameter of the operators.
VOCABULARIES = "/opt/tokenizers"
#: Entries a worker remembers per generation; two generations are kept.
CACHE_ENTRIES = 200_000
# Fixed value: the contractions that the pre-tokenizer splits off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Fixed value: the Unicode White_Space characters.
WHITE = "\t-\r \x85\xa0  -     　"
#: Bits of a rank that the lower level of the bitmap resolves.
_BITS = 8
_MASK = (1 << _BITS) - 1


def _pattern(letters: str, numbers: str, white: str) -> re.Pattern:
    rest = f"[^{white}{letters}{numbers}]"
    return re.compile(f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?{rest}+|[{white}]+(?![^{white}])|[{white}]+")


@lru_cache
def _class(kind: str, top: int) -> str:
    """The characters up to ``top`` whose general category begins with ``kind``, as ranges of a character class."""
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache
def _splitter(top: int) -> re.Pattern:
    """Pre-token pattern for texts whose largest character is at most ``top``; smaller classes match faster."""
    if top < 128:
        return _pattern("A-Za-z", "0-9", "\t-\r ")
    return _pattern(_class("L", top), _class("N", top), WHITE if top > 0xFF else "\t-\r \x85\xa0")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, which joined give the text."""
    if text.isascii():
        return _splitter(127).findall(text)
    return _splitter(0xFFFF if max(text) <= "￿" else sys.maxunicode).findall(text)


def encode_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merges in order of rank, leftmost first among equals."""
    n = len(word)
    get = ranks.get
    ends = list(range(1, n + 2))  # where the part that begins here ends; 0: it was merged into the one before it
    before = list(range(-1, n))
    waiting: dict[int, list[int]] = {}
    words: dict[int, int] = {}  # the lower level: _FAN ranks to a word
    top = 0  # the upper level: a bit for each word that isn't 0
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            if r in waiting:
                waiting[r].append(i)  # ascending, hence a heap
            else:
                waiting[r] = [i]
                a = r >> _BITS
                words[a] = words.get(a, 0) | 1 << (r & _MASK)
                top |= 1 << a
    while top:
        a = (top & -top).bit_length() - 1
        x = words[a]
        r = a << _BITS | (x & -x).bit_length() - 1
        bucket = waiting[r]
        i = heappop(bucket)
        if not bucket:
            del waiting[r]
            words[a] = x = x & x - 1
            if not x:
                top &= top - 1
        j = ends[i]
        if not 0 < j < n:
            continue
        e = ends[j]
        if get(word[i:e]) != r:
            continue
        ends[i], ends[j] = e, 0
        before[e] = i
        p = before[i]
        if e < n:
            r = get(word[i : ends[e]])
            if r is not None:
                if r in waiting:
                    heappush(waiting[r], i)
                else:
                    waiting[r] = [i]
                    a = r >> _BITS
                    words[a] = words.get(a, 0) | 1 << (r & _MASK)
                    top |= 1 << a
        if p >= 0:
            r = get(word[p:e])
            if r is not None:
                if r in waiting:
                    heappush(waiting[r], p)
                else:
                    waiting[r] = [p]
                    a = r >> _BITS
                    words[a] = words.get(a, 0) | 1 << (r & _MASK)
                    top |= 1 << a
    out, i = [], 0
    while i < n:
        e = ends[i]
        out.append(ranks[word[i:e]])
        i = e
    return out


class Encoder(dict):
    """Pre-token -> ids, computed on first use; older entries are dropped a generation at a time."""

    def __init__(self, ranks: dict[bytes, int], entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.ranks, self.entries, self.old = ranks, entries, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            raw = word.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(encode_bytes(raw, self.ranks))
        if len(word) < 256:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty list for null and for the empty text."""
        return list(chain.from_iterable(map(self.__getitem__, pre_tokens(text)))) if text else []


@lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> Encoder:
    """The encoder of a ``.tiktoken`` vocabulary, one per worker process."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, ids): one row per row of ``docs``, whose text becomes its ids; no shuffle.

    Null and empty texts give an empty list; strings that look like special tokens are plain text. Repeated rows stay.
    """
    source = docs.select(f"`{id_column}`", f"`{text_column}`")
    kind = source.schema[0].dataType.simpleString()

    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(folder, vocabulary)
        for batch in batches:
            for part in _slices(batch):
                lists = [enc.encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(lists) + 1, np.int32)
                np.cumsum(np.fromiter(map(len, lists), np.int32, len(lists)), out=ends[1:])
                flat = pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "ids"])

    return source.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_column), "ids")


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, text): ids turned back to the text they stand for, the inverse of ``encode``; null ids give an empty text."""
    source = encoded.select(f"`{id_column}`", f"`{ids_column}`")
    kind = source.schema[0].dataType.simpleString()
    ship(encoded.sparkSession)

    def run(batches):
        pieces = {i: raw for raw, i in encoder(folder, vocabulary).ranks.items()}
        for batch in batches:
            texts = [b"".join(map(pieces.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_column), "text")


def _slices(batch: pa.RecordBatch, rows: int = 1000):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def token_counts(docs: DataFrame, keep: list[str], text_column: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``keep`` columns of ``docs`` and ``n_tokens`` of the text; null and empty texts have 0."""
    source = docs.select(*[f"`{c}`" for c in keep], f"`{text_column}`")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(folder, vocabulary)
        for batch in batches:
            for part in _slices(batch):
                counts = [sum(map(len, map(enc.__getitem__, pre_tokens(t)))) if t else 0 for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    return source.mapInArrow(run, f"{columns}, n_tokens bigint")
