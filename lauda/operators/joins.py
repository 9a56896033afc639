"""Joins by position and by content: nearest earlier row, span exclusion, shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lauda.functions.text import let
from lauda.operators.range_scan import with_last_before
from lauda.operators.run_marks import marked, near_pairs, run_counts


def nearest_before(df: DataFrame, keys: list[str], order: list[str], mark: Column, what: list[str],
    prefix: str = "near_") -> DataFrame:
    """Each row beside the last earlier row of its group that `mark` holds for (an as-of join in one scan)."""
    x = with_last_before(df, keys, order, what, mark, "_n")
    return x.select(*df.columns, *[F.col("_n")[c].alias(prefix + c) for c in what])


def spans_of(t: Column, pattern: str) -> Column:
    """Spans of every match of a pattern: array of (start, end)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def walk(x):
        def step(acc, i):
            start = acc["at"] + F.length(F.element_at(x["parts"], i))
            end = start + F.length(F.element_at(x["hits"], i))
            return F.struct(end.alias("at"),
                F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

        n = F.size(x["hits"])
        return F.when(n > 0,
            F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(0).alias("at"), empty.alias("spans")),
                step)["spans"]).otherwise(empty)

    return let(F.struct(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias("hits"),
            F.split(t, pattern, -1).alias("parts")),
        walk)


def outside(spans: Column, taken: Column) -> Column:
    """Spans that overlap none of the taken ones."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda x: (s["start"] < x["end"]) & (x["start"] < s["end"])))


def similar_texts(left: DataFrame, right: DataFrame, lk: str, rk: str, threshold: float) -> DataFrame:
    """(lk, rk, n_common, jaccard) of pairs whose shingle sets reach a Jaccard similarity.

    left, right: (key, sh array of distinct shingles), one row per class of equal texts. Candidates come from a
    prefix filter and parity bits (`run_marks`), so neither a stock phrase nor a shared rare one brings sets
    together; verified exactly, no link is lost.
    """
    hashed = lambda df, key: df.select(key, F.transform("sh", lambda s: F.xxhash64(s)).alias("_h"))
    counts = run_counts(hashed(right, rk), "_h")
    pairs = near_pairs(marked(hashed(left, lk), "_h", threshold, counts), marked(hashed(right, rk), "_h", threshold, counts),
        threshold)
    return verified(pairs, left, right, lk, rk, threshold)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, lk: str, rk: str, threshold: float) -> DataFrame:
    """pairs that reach the Jaccard similarity of their shingle sets, with n_common and jaccard."""
    both = pairs.join(left.select(lk, F.col("sh").alias("_ls")).hint("merge"), lk).join(right.select(rk,
        F.col("sh").alias("_rs")).hint("merge"), rk)  # sets are many times their packed size: none is broadcast
    common = F.size(F.array_intersect("_ls", "_rs"))
    return both.select(*pairs.columns, common.alias("n_common"),
        (common / (F.size("_ls") + F.size("_rs") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
