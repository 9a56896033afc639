"""Evaluation texts leaking into training text: size-partitioned MinHash containment, verified exactly.

The unit of the search is the window of RUN words, since a leak is that many words in a row however long
item and document are. The signature of a window is its SIGNATURE MinHashes: the least of its five-word
shingles under as many hash functions. Equal windows have equal signatures, so a document that holds a
run of an item always meets it: no link is lost. Items are partitioned by size; the longer the items of
a partition, the more of the signature makes up its lookup key (long items have more windows to meet by
chance). The containment that a partition asks for is one window of its longest item. Candidates are
verified by exact shingle containment, first by hash, then word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.session import maybe_broadcast, reliable

RUN = 12
SHINGLE = 5
SIGNATURE = 3
#: Up to this many characters of items the index is sent to every executor; more are joined on their MinHashes.
MAX_CHARS = 16 << 20
#: In the join, windows that stand in more documents than HOT are spread over SALTS keys.
HOT, SALTS = 100_000, 32
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ᪰-᫿⃐-⃿]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xFF51AFD7ED558CCD)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case and accents."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


class WordHashes:
    def __init__(self, limit: int = 1_000_000):
        self.seen: dict[str, int] = {}
        self.limit = limit

    def __call__(self, ws: list[str]) -> np.ndarray:
        seen, out = self.seen, np.empty(len(ws), np.uint64)
        for i, w in enumerate(ws):
            h = seen.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(seen) < self.limit:
                    seen[w] = h
            out[i] = h
        return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(m, np.uint64)
        for i in range(n):
            g = g * _P + h[i : i + m]
        g ^= g >> np.uint64(31)
        return g * _Q


def signatures(h: np.ndarray) -> np.ndarray:
    """Signature of each window of RUN words: its MinHashes over its shingles, one row a hash function."""
    s = grams(h, SHINGLE)
    m = len(h) - RUN + 1
    if m <= 0:
        return np.empty((SIGNATURE, 0), np.uint64)
    out = np.empty((SIGNATURE, m), np.uint64)
    n = RUN - SHINGLE + 1
    for k in range(SIGNATURE):
        with np.errstate(over="ignore"):
            x = (s ^ (np.uint64(k) * _P)) * _Q if k else s
        w = 1
        while 2 * w <= n:  # least of the next 2, 4, 8 ... shingles
            x = np.minimum(x[:-w], x[w:])
            w *= 2
        out[k] = x[:m] if w == n else np.minimum(x[:m], x[n - w : n - w + m])
    return out


def keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """Lookup key of each window: the first rows of its signature, mixed."""
    out = sig[0].copy()
    with np.errstate(over="ignore"):
        for k in range(1, rows):
            out = (out * _P) ^ sig[k]
            out ^= out >> np.uint64(29)
    return out


def size_class(n_words: int) -> int:
    """Partition of an item: powers of two from RUN words on."""
    return int(np.log2(n_words / RUN))


def rows_of(part: int) -> int:
    """How much of the signature is the key of a partition."""
    return min(1 + part, SIGNATURE)


class ItemIndex:
    """Keys of the items' windows by size partition, and the exact windows behind them."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes, parts = WordHashes(), defaultdict(set)
        self.exact: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.words: list[list[str]] = []
        self.ids: list[int] = []
        for item, text in items:  # items with one id stay apart: each is an entry
            ws = words(text)
            if len(ws) < RUN:
                continue
            h, p = hashes(ws), size_class(len(ws))
            parts[p].update(keys(signatures(h), rows_of(p)).tolist())
            for i, g in enumerate(grams(h, RUN).tolist()):
                self.exact[g].append((len(self.ids), i))
            self.words.append(ws)
            self.ids.append(item)
        self.parts = {p: np.array(sorted(x), np.uint64) for p, x in parts.items()}

    def candidates(self, sig: np.ndarray) -> np.ndarray:
        """Positions of the windows whose key stands in a size partition."""
        hit, by_rows = np.zeros(sig.shape[1], bool), {}
        for p, known in self.parts.items():
            r = rows_of(p)
            if r not in by_rows:
                by_rows[r] = keys(sig, r)
            at = np.minimum(np.searchsorted(known, by_rows[r]), len(known) - 1)
            hit |= known[at] == by_rows[r]
        return np.flatnonzero(hit)

    def found(self, ws: list[str], h: np.ndarray) -> set[int]:
        """Ids of the items of which a window stands in a text."""
        pos = self.candidates(signatures(h))
        if not len(pos):
            return set()
        g, out = grams(h, RUN), set()
        for i in pos.tolist():
            for k, j in self.exact.get(int(g[i]), ()):
                if self.ids[k] not in out and ws[i : i + RUN] == self.words[k][j : j + RUN]:
                    out.add(self.ids[k])
        return out


def leaks(documents: DataFrame, items: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, item_id): at least RUN consecutive words of the item stand consecutively in the document.

    NULL, empty and short texts give no rows, on either side; texts of any length are searched whole;
    a document that stands twice gives its rows twice, an item that stands twice its row once; no items
    give an empty result.
    """
    items = items.select("item_id", "text").where("text IS NOT NULL")
    if (items.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0) > max_chars:
        return _by_join(documents, items)
    shared = documents.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in items.collect()]))  # at most max_chars

    def search(batches):
        index, hashes = shared.value, WordHashes()
        for b in batches:
            out = []
            for doc, text in zip(b.doc_id, b.text):
                ws = words(text)
                if len(ws) >= RUN:
                    out += [(doc, i) for i in index.found(ws, hashes(ws))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return documents.select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long")


def _windows(df: DataFrame, key: str) -> DataFrame:
    """(key, w, g): every distinct window of a text: MinHash w and exact hash g."""

    def cut(batches):
        hashes = WordHashes()
        for b in batches:
            out = []
            for k, text in zip(b[key], b.text):
                ws = words(text)
                if len(ws) >= RUN:
                    h = hashes(ws)
                    w, g = keys(signatures(h), SIGNATURE).astype(np.int64), grams(h, RUN).astype(np.int64)
                    out += [(k, *x) for x in set(zip(w.tolist(), g.tolist()))]
            yield pd.DataFrame(out, columns=[key, "w", "g"])

    return df.select(key, "text").mapInPandas(cut, f"{key} long, w long, g long")


def _by_join(documents: DataFrame, items: DataFrame, hot: int = HOT) -> DataFrame:
    """The same for items of any number: windows meet on their signatures, pairs are verified on the texts.

    A window that stands in very many documents (a stock phrase) is split: its documents by their hash,
    its items repeated for every part.
    """
    documents, items = documents.select("doc_id", "text"), items.select("item_id", "text")
    mine = _windows(items, "item_id")
    theirs = reliable(_windows(documents, "doc_id").join(mine.select("w").distinct(), "w", "left_semi"))
    heavy = maybe_broadcast(theirs.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("w",
            F.lit(SALTS).alias("parts")))
    n = F.coalesce("parts", F.lit(1))
    left = theirs.join(heavy, "w", "left").select("doc_id", "w", "g", F.pmod(F.xxhash64("doc_id"), n).alias("part"))
    right = mine.join(heavy, "w", "left").select("item_id", "w", "g",
        F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("part"))
    pairs = left.join(right, ["w", "g", "part"]).select("doc_id", "item_id").distinct()
    both = pairs.join(documents.select("doc_id", F.col("text").alias("doc_text")),
        "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def verify(batches):
        hashes = WordHashes()
        for b in batches:
            out = []
            for d, i, x, y in zip(b.doc_id, b.item_id, b.doc_text, b.item_text):
                ws = words(x)
                if i in ItemIndex([(i, y)]).found(ws, hashes(ws)):
                    out.append((d, i))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return both.mapInPandas(verify, "doc_id long, item_id long")
