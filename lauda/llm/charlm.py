"""Character n-grams of a corpus: counted with arrays, kept as a table bounded by the alphabet."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters beyond these blocks share one symbol, so that the table has a bound of its own.
OTHER = 0xFFFE


def _codes(texts: list[str]) -> np.ndarray:
    a = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    a[(a < 32)] = 32
    a[(a >= 48) & (a <= 57)] = 48
    a[((a >= 0x2600) & (a < 0xFB00)) | (a > 0xFFFF)] = OTHER
    return a


def count_trigrams(texts: DataFrame, column: str) -> DataFrame:
    """(k, n): how often each character trigram stands in a text column; k packs three 16-bit codes.

    Digits count as 0, control characters as a space; every text has a space before and after it.
    NULL and empty texts count nothing. Counts are combined per partition before the shuffle.
    """

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            rows = [t for t in b[column] if t]
            for i in range(0, len(rows), 2000):
                a = _codes(rows[i : i + 2000])
                k, n = np.unique((a[:-2] << 32) | (a[1:-1] << 16) | a[2:], return_counts=True)
                total.update(dict(zip(k.tolist(), n.tolist())))
        yield pd.DataFrame({"k": list(total), "n": list(total.values())}, columns=["k", "n"]).astype("int64")

    return texts.select(column).mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated character trigram model (log probabilities) from packed counts."""

    def __init__(self, counts: dict[int, int]):
        self.tri, self.bi, self.ctx = {}, Counter(), Counter()
        self.uni: Counter = Counter()
        ctx2: Counter = Counter()
        for k, n in counts.items():
            a, b, c = chr(k >> 32), chr((k >> 16) & 0xFFFF), chr(k & 0xFFFF)
            self.tri[a + b + c] = n
            ctx2[a + b] += n
            self.bi[b + c] += n
            self.ctx[b] += n
            self.uni[c] += n
        self.ctx2 = ctx2
        self.total = sum(self.uni.values()) or 1
        self.size = len(self.uni) + 1
        self._b: dict = {}
        self._t: dict = {}

    @staticmethod
    def key(c: str) -> str:
        return " " if c < " " else "0" if c.isdigit() else chr(OTHER) if c > "￿" or "☀" <= c < "ﬀ" else c

    def p1(self, c: str) -> float:
        return (self.uni.get(c, 0) + 0.5) / (self.total + 0.5 * self.size)

    def bigram(self, b: str, c: str) -> float:
        """log P(c | b)."""
        x = self._b.get(b + c)
        if x is None:
            x = self._b[b + c] = math.log((self.bi.get(b + c, 0) + 2 * self.p1(c)) / (self.ctx.get(b, 0) + 2))
        return x

    def trigram(self, a: str, b: str, c: str) -> float:
        """log P(c | a, b)."""
        x = self._t.get(a + b + c)
        if x is None:
            x = self._t[a + b + c] = math.log((self.tri.get(a + b + c,
                        0) + 4 * math.exp(self.bigram(b, c))) / (self.ctx2.get(a + b, 0) + 4))
        return x

    def word(self, w: str) -> float:
        """log probability of a word between spaces, by bigrams."""
        s, prev = 0.0, " "
        for c in map(self.key, w):
            s += self.bigram(prev, c)
            prev = c
        return s + self.bigram(prev, " ")


def collect_model(*parts: DataFrame) -> dict[int, int]:
    """Counts on the driver: at most (alphabet size)^3 rows, in practice some ten thousand."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return {r["k"]: r["n"] for r in df.groupBy("k").agg(F.sum("n").alias("n")).collect()}
