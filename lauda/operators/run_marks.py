"""Marks of texts for exact similarity joins: prefix keys and parity bits of their sets of word runs.

A text's mark is about a hundred bytes however long it is, so the join over all texts moves marks only; texts are
read again for the few pairs that the marks let through. Runs are hashed to 64 bits in numpy over a whole batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that the right side's runs are counted in: the order of runs, a table of fixed size.
BUCKETS = 1 << 18
#: Parity bits of a set, in two longs.
BITS = 128
#: Texts that are hashed at once.
SLICE = 1000
MARK = "size int, bits0 long, bits1 long, keys array<int>"

_U = np.uint64
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=_U)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
_STEP = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_runs(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of k words [a-z0-9]+ of folded texts, sorted by row."""
    none = np.zeros(0, np.int64), np.zeros(0, _U)
    t = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    raw = np.frombuffer(t.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    word, edge = _WORD[raw], np.zeros(len(raw) + 1, bool)
    edge[at - at[0]] = True  # words end with their text
    first = word & (edge[:-1] | ~np.concatenate(([False], word[:-1])))
    i = np.flatnonzero(word)
    starts = np.flatnonzero(first[i])
    if len(starts) < k:
        return none
    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    powers = np.cumprod(np.full(place.max() + 1, _STEP))
    words = _mixed(np.add.reduceat(_BYTE[raw[i]] * powers[place], starts))
    row = np.searchsorted(at - at[0], i[starts], "right") - 1
    n = len(words) - k + 1
    h = words[:n]
    for j in range(1, k):
        h = _mixed(h * _STEP + words[j : n + j])
    whole = row[:n] == row[k - 1 :]
    row, h = row[:n][whole], h[whole]
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _runs(column: pa.Array, k: int):
    """(first row, rows, row, hash) of slices of a column of texts, or of arrays of hashes."""
    for at in range(0, len(column), SLICE):
        c = column.slice(at, SLICE)
        if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            sizes = pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield at, len(c), np.repeat(np.arange(len(c)), sizes), c.flatten().to_numpy(zero_copy_only=False).view(_U)
        else:
            yield at, len(c), *text_runs(c, k)


def run_counts(df: DataFrame, what: str, k: int = 0) -> np.ndarray:
    """How many of the rows hold a run of each bucket."""

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, _, h in _runs(b.column(0), k):
                n += np.bincount((h & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n[i])], ["i", "n"])

    got = df.select(what).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return out


def _marks(rows: int, row: np.ndarray, h: np.ndarray, threshold: float, counts: np.ndarray) -> list[pa.Array]:
    size = np.bincount(row, minlength=rows)
    bit = row * BITS + (h >> _U(57)).astype(np.int64)
    parity = (np.bincount(bit, minlength=rows * BITS) & 1).astype(np.uint8)
    bits = np.packbits(parity.reshape(rows, BITS), axis=1).view(np.int64)
    c = counts[(h & _U(BUCKETS - 1)).astype(np.int64)]
    o = np.lexsort((h, c, row))
    row, h, c = row[o], h[o], c[o]
    rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    n = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
    use = (rank < n[row]) & (c > 0)
    ends = np.cumsum(np.bincount(row[use], minlength=rows))
    keys = ((h[use] >> _U(20)) & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return [pa.array(size.astype(np.int32)), pa.array(bits[:, 0]), pa.array(bits[:, 1]),
        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(keys))]


def marked(df: DataFrame, what: str, threshold: float, counts: np.ndarray, k: int = 0) -> DataFrame:
    """df with the marks and the class (`cls`, equal texts) of its text column, or the marks of its array of hashes.

    Runs are ordered by their bucket's count on the right side, rarest first; a pair that reaches the threshold shares
    one of the first ones of both (prefix filter). Runs that the right side hasn't got come first and give no key,
    rows without any key reach nothing and are left out.
    """
    fields = [x for x in df.schema.fields if x.name != what]
    names, is_text = [x.name for x in fields], df.schema[what].dataType.typeName() == "string"

    def mark(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index(what))
            for at, rows, row, h in _runs(column, k):
                kept = b.slice(at, rows)
                out = [kept.column(kept.schema.get_field_index(x)) for x in names]
                if is_text:
                    out.append(pa.array([hashlib.sha256((x or "").encode()).digest()[:16] for x in kept.column(
                        kept.schema.get_field_index(what)).to_pylist()], pa.binary()))
                done = pa.RecordBatch.from_arrays(out + _marks(rows, row, h, threshold, counts),
                    [*names, *(["cls"] if is_text else []), "size", "bits0", "bits1", "keys"])
                yield done.filter(pc.greater(pc.list_value_length(done.column("keys")), 0))

    own = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in fields)
    return df.mapInArrow(mark, own + ("cls binary, " if is_text else "") + MARK)


def near_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of marked rows that may reach the threshold, each once: the columns of both beside their marks.

    Sets of sizes m and n that reach Jaccard t differ in (m + n)(1 - t)/(1 + t) runs at most, their parity bits in no
    more than these; tested inside the join, so a pair that shares a key by chance is never written. The keys are many
    times the rows whose size the optimizer sees, so it mayn't broadcast them from the driver.
    """
    mark = ("size", "bits0", "bits1", "keys")
    side = lambda df, p: df.select(*[c for c in df.columns if c not in mark],
        *[F.col(c).alias(p + c) for c in mark[:3]], F.explode("keys").alias("_key"))
    a, b = side(left, "_l"), side(right, "_r")
    apart: Column = sum(F.bit_count(F.col(f"_lbits{i}").bitwiseXOR(F.col(f"_rbits{i}"))) for i in (0, 1))
    fits = (F.least("_lsize", "_rsize") >= F.greatest("_lsize", "_rsize") * threshold - 1e-9) & (
        apart <= (F.col("_lsize") + F.col("_rsize")) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    return a.join(b.hint("merge"), (a["_key"] == b["_key"]) & fits).select(
        *[c for df in (left, right) for c in df.columns if c not in mark]).distinct()
