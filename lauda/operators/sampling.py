"""Reproducible samples: hash ranks per stratum, allocations, splits. Ranks are exact at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lauda.operators.range_scan import PID, numbered, range_sorted, summaries
from lauda.operators.topk import hash_order, top_per_group


def stratified(df: DataFrame, strata: list[str], key: str, n: int | Column, seed: int = 42) -> DataFrame:
    """n rows of every stratum in hash order; strata with fewer rows give all of them. NULL strata form one."""
    return top_per_group(df.withColumn("_h", hash_order(seed, key)), strata, [F.col("_h"), F.col(key)], n, key, "pick").drop("_h")


def proportional(counts: DataFrame, total: int, floor: int = 1) -> DataFrame:
    """Allocation per stratum (a small table of counts): its share of total, at least floor, never more than it has."""
    w = Window.partitionBy(F.lit(1))
    share = F.bround(F.lit(float(total)) * F.col("n") / F.sum("n").over(w), 0).cast("int")
    return counts.withColumn("alloc", F.least(F.greatest(share, F.lit(floor)), F.col("n").cast("int")))


def split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Marks floor(n * ratio) rows, the first in hash order, as discovery and the rest as evaluation.

    The cut is exact without sorting in one task: ranks come from a range-sorted scan with the
    partitions' counts carried over.
    """
    rows = range_sorted(df.withColumn("_h", hash_order(seed, key)), ["_h", key])

    def count(batches):
        import pandas as pd

        pid, batches = numbered(batches)
        if pid is not None:
            yield pd.DataFrame({"pid": [pid], "n": [sum(map(len, batches))]})

    before, total = {}, 0
    for r in summaries(rows, count, "pid int, n long"):
        before[r["pid"]], total = total, total + r["n"]
    cut = int(total * ratio)

    def mark(batches):
        pid, batches = numbered(batches)
        at = before.get(pid, 0)
        for b in batches:
            b = b.drop(columns=["_h", PID])
            b["part"] = ["discovery" if at + i < cut else "evaluation" for i in range(len(b))]
            at += len(b)
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part string"
    return rows.mapInPandas(mark, schema)
