"""Range-sorted scans: order-dependent work over groups of any size without one task per group.

Rows are range-partitioned and sorted by (group keys, order keys) and written once to the shared
checkpoint folder, so that two passes see the same partitions. The first pass returns one small
summary per partition, the driver folds the summaries (their number is the number of partitions),
and the second pass starts every partition from its folded carry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lauda.session import reliable


#: Column with the number of a row's partition, stored with the row: a task's own number is another
#: one where the result is part of a union.
PID = "_pid"


def range_sorted(df: DataFrame, keys: list[str], then: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """df range-partitioned by keys, sorted by keys and `then`, materialised, with its partition numbers.

    Rows with equal keys share a partition; `then` only orders them inside it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reliable(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys, *(then or [])).withColumn(PID,
            F.spark_partition_id()))


def numbered(batches: Iterator[pd.DataFrame]) -> tuple[int | None, Iterator[pd.DataFrame]]:
    """(partition number, non-empty batches) of a range-sorted partition; no number for an empty one."""
    batches = iter(batches)
    first = next((b for b in batches if len(b)), None)
    if first is None:
        return None, iter(())
    return int(first[PID].iloc[0]), chain([first], (b for b in batches if len(b)))


def summaries(
    df: DataFrame, summarise: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str
) -> list:
    """Collected summaries of a range-sorted DataFrame, in partition order.

    `summarise` must yield a number of rows that depends on the number of partitions and of
    metadata (columns, loads), never on the number of rows.
    """
    rows = df.mapInPandas(summarise, schema).collect()
    return sorted(rows, key=lambda r: r["pid"])


def _carried(s: DataFrame, keys: list[str], part: Column, kind: T.DataType, fold: Callable) -> DataFrame:
    """s beside the carry of its partition's first group: `part` per (partition, group), folded in order.

    Only the first group of a partition can have begun before it, so the driver folds one row a partition.
    """
    k = F.struct(*keys)
    ends = s.groupBy(PID, *keys).agg(part.alias("_m")).groupBy(PID).agg(F.min(k).alias("first"), F.max(k).alias("last"),
        F.max_by("_m", k).alias("m")).collect()
    rows, key, state = [], None, None
    for r in sorted(ends, key=lambda r: r[PID]):
        goes_on = key is not None and r["first"] == key
        if goes_on:
            rows.append((r[PID], *r["first"], state))
        state = fold(state, r["m"]) if key is not None and r["last"] == key else r["m"]
        key = r["last"]
    schema = T.StructType([T.StructField("_p", T.IntegerType()),
            *[T.StructField(f"_k{i}", s.schema[c].dataType) for i, c in enumerate(keys)], T.StructField("_carry", kind)])
    carry = s.sparkSession.createDataFrame(rows, schema)  # at most one row a partition
    same = F.col(PID) == F.col("_p")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return s.join(F.broadcast(carry), same, "left").drop("_p", *[f"_k{i}" for i in range(len(keys))])


def with_last_before(df: DataFrame, keys: list[str], order: list[str], what: list[str], mark: Column | None = None,
    name: str = "prev") -> DataFrame:
    """Each row beside the struct `what` of the last earlier row of its group, of those that `mark` holds for.

    A window over (partition, group) on range-sorted rows, so a group of any size spreads over many
    tasks; `order` must be total. The first rows of a group have NULL.
    """
    s = range_sorted(df, [*keys, *order])
    row = F.struct(*what) if mark is None else F.when(mark, F.struct(*what))
    w = Window.partitionBy(PID, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order) if mark is None else F.when(mark, F.struct(*order))
    kind = T.StructType([s.schema[c] for c in what])
    x = _carried(s, keys, F.max_by(F.struct(*what), at), kind, lambda old, new: old if new is None else new)
    return x.withColumn(name, F.coalesce(F.last(row, ignorenulls=True).over(w), F.col("_carry"))).drop("_carry", PID)


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], n: str, name: str = "cum") -> DataFrame:
    """Running total of n in every group, in a total order, without a task per group."""
    s = range_sorted(df, [*keys, *order])
    w = Window.partitionBy(PID, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = _carried(s, keys, F.sum(n), T.LongType(), lambda old, new: (old or 0) + (new or 0))
    return x.withColumn(name, F.coalesce(F.col("_carry"), F.lit(0)) + F.sum(n).over(w)).drop("_carry", PID)
