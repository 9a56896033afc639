"""Encoding of a corpus with a public byte-level BPE vocabulary, offsets kept.

Pre-tokenisation works on arrays: every code point gets a class (letter, number, space, other, and
the letters of English contractions), and the boundaries come from scans over those classes that are
associative transition functions (a run goes on while class and predecessor agree; a trailing space
joins the run after it), evaluated with cumulative array operations over a whole batch of texts at
once. The slices are merged pair by pair by rank, each distinct slice once per task.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter, never copied.
TOKENIZERS = "/opt/tokenizers"
#: Ids of an empty text and of a NULL text: none, as a list, so that every row has ids.
EMPTY_IDS: list[int] = []

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
# Letters after the apostrophe of a contraction, one or two.
_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
_TWO = np.array([ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")], np.uint32)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories."""
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        k = unicodedata.category(c)
        if k[0] == "L":
            table[i] = LETTER
        elif k[0] == "N":
            table[i] = NUMBER
    # White_Space of Unicode; str.isspace() also counts the separators 1C-1F
    for i in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[i] = SPACE
    return table


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(joined text, start of each slice, text number of each slice) for a batch of non-empty texts.

    Texts are joined by one sentinel each, which is a slice of its own and dropped.
    """
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    k = classes()[cp].copy()
    k[ends] = END
    n = len(cp)
    prev = np.empty_like(k)
    prev[0], prev[1:] = END, k[:-1]
    nxt = np.empty_like(k)
    nxt[-1], nxt[:-1] = END, k[1:]
    start = k != prev  # a run ends where the class changes
    # white space before something else: the last white character leaves its run; a plain space joins
    # the run after it, any other white character is a slice of its own
    space = k == SPACE
    last = space & (nxt != SPACE) & (nxt != END)
    start[last] = True
    joins = last & (cp == 32)
    start[1:][joins[:-1]] = False
    # contractions: an apostrophe at a run start (no space before it) with its letters
    i = np.flatnonzero((cp == 39) & (k == OTHER) & start & ~np.r_[False, joins[:-1]])
    if len(i):
        padded = np.r_[cp, np.uint32(0), np.uint32(0)]  # a sentinel ends every text, so letters never come from the next
        first, second = padded[i + 1], padded[i + 2]
        two = np.isin(first * np.uint32(256) + second, _TWO) & (first < 128) & (second < 128)
        m = np.where(two, 2, np.where(np.isin(first, _ONE), 1, 0))
        i, m = i[m > 0], m[m > 0]
        start[i + 1] = False
        start[i[m == 2] + 2] = False
        start[i + 1 + m] = True
    at = np.flatnonzero(start)
    owner = np.searchsorted(ends, at)
    keep = k[at] != END
    return joined, at, owner, keep


class Merger:
    """Pair merging by rank with a cache of slices."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 500_000):
        self.ranks, self.size = ranks, cache_size
        self.cache: dict[str, list[int]] = {}

    def encode(self, piece: str) -> tuple[list[int], list[int]]:
        """(ids, code point that each token begins in) of a slice."""
        got = self.cache.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids, at = self.merge(raw)
            if len(raw) != len(piece) and at != [0]:
                b = np.frombuffer(raw, np.uint8)
                at = (np.cumsum((b & 0xC0) != 0x80) - 1)[at].tolist()
            got = ids, at
            if len(self.cache) < self.size and len(piece) <= 64:
                self.cache[piece] = got
        return got

    def merge(self, raw: bytes) -> tuple[list[int], list[int]]:
        """(ids, first bytes): lowest rank first, leftmost among equals; a heap keeps long slices near-linear."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]], [0]
        n = len(raw)
        nxt, prv, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, e = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != e or ranks.get(raw[i:e]) != r:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, e, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (x := ranks.get(raw[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (x, i, end[nxt[i]]))
            p = prv[i]
            if p >= 0 and (x := ranks.get(raw[p:e])) is not None:
                heapq.heappush(heap, (x, p, e))
        at = [i for i in range(n) if alive[i]]
        return [ranks[raw[i : end[i]]] for i in at], at


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_batch(texts: list[str], merger: Merger, offsets: bool = True) -> list[tuple[list[int], list[int]]]:
    """(ids, code-point offset that each token begins at) of each text; of a split character the offset of the character."""
    out: list = [([], []) for _ in texts]
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return out
    joined, at, owner, keep = boundaries([texts[i] for i in filled])
    stops = np.append(at[1:], len(joined))
    base = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in filled])]).tolist()
    encode = merger.encode
    for a, b, o in zip(at[keep].tolist(), stops[keep].tolist(), owner[keep].tolist()):
        got, rel = encode(joined[a:b])
        ids, offs = out[filled[o]]
        ids += got
        if offsets:
            a -= base[o]
            offs += [a] if len(rel) == 1 else [a + x for x in rel]
    return out


def encoded(documents: DataFrame, path: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, ids[, offsets]): the whole text of every document as token ids, without special tokens.

    An empty text and a NULL text have the empty list. Strings of special tokens are ordinary text.
    Texts of any length are encoded whole; repeated rows each get their row; nothing is shuffled.
    """
    path = path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

    def apply(batches):
        merger = Merger(load_ranks(path))
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                texts = [t if isinstance(t, str) else None for t in part.text]
                got = encode_batch([t or "" for t in texts], merger, offsets)
                d = pd.DataFrame({"doc_id": part.doc_id.to_numpy(),
                        "ids": [g[0] if t else EMPTY_IDS for t, g in zip(texts, got)]})
                if offsets:
                    d["offsets"] = [g[1] if t else EMPTY_IDS for t, g in zip(texts, got)]
                yield d

    return documents.select("doc_id", "text").mapInPandas(apply,
        "doc_id long, ids array<int>" + (", offsets array<int>" if offsets else ""))


def decode(ids: list[int], path: str | None = None) -> str:
    back = {v: k for k, v in load_ranks(path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")).items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")
