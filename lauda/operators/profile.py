"""Column-level data quality profile: exact quantiles, distincts and drift between loads.

The values of all columns are unpivoted, pre-aggregated to (column, value, load, n) and range-sorted
by (column, value). Prefix counts per partition then give exact order statistics and distinct counts
without a per-column task, and the merged cumulative curves of consecutive loads give the exact
Kolmogorov-Smirnov distance.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lauda.operators.range_scan import numbered, range_sorted, summaries
from lauda.session import maybe_broadcast, reliable

QUANTILES = (0.25, 0.5, 0.75)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
RATE_TOLERANCE = 0.001
JUMP = 0.10
EPS = 1e-9


def _value(field: T.StructField, path: str) -> tuple[Column, Column, Column]:
    """(num, rest, txt) of a column, all NULL for none.

    A number is num, its double, and rest, what the double lacks of it: together they order and tell
    apart integers and decimals of any size; txt holds the digits where rest isn't 0. Text is txt alone.
    """
    c, none, null = F.col(path), F.lit(None).cast("double"), F.lit(None).cast("string")
    kind = field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double")), F.when(~F.isnan(c), 0.0), null
    if isinstance(kind, T.TimestampType):
        c, kind = F.unix_micros(c), T.LongType()
    if isinstance(kind, (T.LongType, T.DecimalType)):
        wide = f"decimal(38,{kind.scale if isinstance(kind, T.DecimalType) else 0})"
        num = c.cast("double")
        rest = F.coalesce((c.cast(wide) - num.try_cast(wide)).cast("double"), F.lit(0.0))
        return num, F.when(c.isNotNull(), rest), F.when(rest != 0, c.cast("string"))
    if isinstance(kind, NUMERIC):
        return c.cast("double"), F.when(c.isNotNull(), 0.0), null
    if isinstance(kind, T.StringType):
        return none, none, F.when(F.trim(c) != "", c)
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return none, none, F.to_json(c)
    return none, none, c.cast("string")


def _leaves(schema: T.StructType) -> list[tuple[str, T.StructField, str]]:
    """(label, field, path) of each top column and of each scalar inside a struct column."""
    out = []
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            out += [(f"{f.name}.{g.name}", g, f"`{f.name}`.`{g.name}`") for g in f.dataType]
        else:
            out.append((f.name, f, f"`{f.name}`"))
    return out


def unpivot_values(df: DataFrame, load: Column, table: str, columns: list[str] | None = None,
    rules: dict[str, Column] | None = None) -> DataFrame:
    """(tbl, col, load, num, rest, txt, n, bad): how often each value of each column stands in each load.

    rules: by label, true in a row where the column's value breaks its rule; bad counts these rows and
    is NULL for a column without a rule.
    """
    rules = rules or {}
    cells = []
    for label, field, path in _leaves(df.schema):
        if columns and label not in columns:
            continue
        num, rest, txt = _value(field, path)
        bad = F.coalesce(rules[label], F.lit(False)).cast("long") if label in rules else F.lit(None).cast("long")
        cells.append(F.struct(F.lit(label).alias("col"), num.alias("num"), rest.alias("rest"), txt.alias("txt"),
                bad.alias("bad")))
    long = df.select(load.alias("load"), F.explode(F.array(*cells)).alias("v"))
    return (
        long.groupBy(F.lit(table).alias("tbl"), F.col("v.col").alias("col"), "load", F.col("v.num").alias("num"),
            F.col("v.rest").alias("rest"), F.col("v.txt").alias("txt"))
        .agg(F.count("*").alias("n"), F.sum("v.bad").alias("bad"))
    )


SUMMARY = "pid int, tbl string, col string, load string, n long, d long"
PARTIAL = "tbl string, col string, load string, ks double, q25 double, q50 double, q75 double, q25s string, q50s string, q75s string"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, pd.DataFrame]]:
    """Chunks of one column, cut between values: (tbl, col, rows)."""
    rest = None
    for b in batches:
        if not len(b):
            continue
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = b.iloc[-1]
        same = (b.tbl == last.tbl) & (b.col == last.col)
        for k in ("num", "rest", "txt"):
            same &= (b[k] == last[k]) | (b[k].isna() & pd.isna(last[k]))
        rest, done = b[same], b[~same]
        for key, g in done.groupby(["tbl", "col"], sort=False):
            yield *key, g
    if rest is not None and len(rest):
        yield rest.tbl.iloc[0], rest.col.iloc[0], rest


def profile_columns(counts: DataFrame) -> DataFrame:
    """Profile per (tbl, col, load) of the output of unpivot_values (several tables may be unioned).

    Columns: n, nulls, null_rate, n_distinct, min/max/q25/q50/q75 as numbers (`*_num`) or text
    (`*_txt`), violations and violation_rate (rows that break the column's rule, NULL and NaN ones too
    where the rule says so; NULL without a rule), and ks: the exact Kolmogorov-Smirnov distance to the load before in which the column
    had values (NULL in its first). Integers and decimals are told apart to the last digit: where a double
    can't hold a number, its digits stand in `*_txt`. NULL, NaN and blank text count as nulls; a column without any
    value has NULL order statistics; an empty table gives no rows. Timestamps are profiled as
    microseconds. Repeated rows count each for itself; quantiles are the lower ones (disc).
    """
    counts = reliable(counts)  # read twice, and sampled by the range partitioning: the table itself is unpivoted once
    null = F.col("num").isNull() & F.col("txt").isNull()
    base = counts.groupBy("tbl", "col", "load").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(null, F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(null, 0).otherwise(1)).alias("n_distinct"), F.sum("bad").alias("violations"),
        F.min("num").alias("min_num"), F.max("num").alias("max_num"),
        F.coalesce(F.min_by("txt", F.when(F.col("num").isNotNull(), F.struct("num", "rest"))),
            F.min(F.when(F.col("num").isNull(), F.col("txt")))).alias("min_txt"),
        F.coalesce(F.max_by("txt", F.when(F.col("num").isNotNull(), F.struct("num", "rest"))),
            F.max(F.when(F.col("num").isNull(), F.col("txt")))).alias("max_txt"),
    )
    values = range_sorted(counts.where(~null).drop("bad").withColumn("load", F.coalesce("load", F.lit(""))),
        ["tbl", "col", "num", "rest", "txt"], ["load"])

    def summarise(batches):
        total: dict = defaultdict(lambda: [0, 0])
        pid, batches = numbered(batches)
        for b in batches:
            for key, n in b.groupby(["tbl", "col", "load"]).n.agg(["sum", "count"]).iterrows():
                total[key][0] += int(n["sum"])
                total[key][1] += int(n["count"])
        yield pd.DataFrame([(pid, *k, *v) for k, v in total.items()], columns=["pid", "tbl", "col", "load", "n", "d"])

    rows = summaries(values, summarise, SUMMARY)
    whole: dict = defaultdict(lambda: defaultdict(int))
    for r in rows:
        whole[(r["tbl"], r["col"])][r["load"]] += r["n"]
    whole = {k: dict(v) for k, v in whole.items()}
    running: dict = defaultdict(int)
    starts: dict = defaultdict(dict)  # of a partition: the prefix counts of the columns in it
    for pid, group in groupby(rows, key=lambda r: r["pid"]):
        group = list(group)
        for key in {(r["tbl"], r["col"]) for r in group}:
            starts[pid][key] = {load: running[(*key, load)] for load in whole[key]}
        for r in group:
            running[(r["tbl"], r["col"], r["load"])] += r["n"]
    starts = dict(starts)

    def curves(batches):
        out: dict = {}
        cum: dict = {}
        pid, batches = numbered(batches)
        for tbl, col, g in _runs(batches):
            key = (tbl, col)
            loads = sorted(whole[key])
            at = {x: i for i, x in enumerate(loads)}
            total = np.array([whole[key][x] for x in loads], float)
            if key not in cum:
                cum[key] = np.array([starts[pid][key][x] for x in loads], float)
            num, rest, txt = g.num.to_numpy(float), g.rest.fillna(0.0).to_numpy(float), g.txt.fillna("").to_numpy()
            new = np.r_[True,
                ((num[1:] != num[:-1]) & ~(np.isnan(num[1:]) & np.isnan(num[:-1]))) | (rest[1:] != rest[:-1]) | (txt[1:] != txt[:-1])]
            u = np.cumsum(new) - 1
            uniq = np.flatnonzero(new)
            for lo in range(0, len(uniq), 20_000):
                hi = min(lo + 20_000, len(uniq))
                pick = (u >= lo) & (u < hi)
                m = np.zeros((hi - lo, len(loads)))
                np.add.at(m, (u[pick] - lo, [at[x] for x in g.load.to_numpy()[pick]]), g.n.to_numpy()[pick])
                c = cum[key] + np.cumsum(m, axis=0)
                f = c / total
                ks = np.abs(np.diff(f, axis=1)).max(axis=0) if len(loads) > 1 else []
                for i, load in enumerate(loads):
                    o = out.setdefault((tbl, col, load), [0.0, *[None] * 3])
                    if i:
                        o[0] = max(o[0], float(ks[i - 1]))
                    for j, q in enumerate(QUANTILES):
                        need = max(1, math.ceil(q * total[i] - 1e-9))
                        if cum[key][i] < need <= c[-1, i]:
                            at_row = uniq[lo + int(np.searchsorted(c[:, i], need))]
                            o[1 + j] = (None if np.isnan(num[at_row]) else float(num[at_row]), txt[at_row] or None)
                cum[key] = c[-1]
        rows = []
        for (tbl, col, load), (ks, *qs) in out.items():
            rows.append((tbl, col, load, ks, *[q and q[0] for q in qs], *[q and q[1] for q in qs]))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTIAL.split(", ")])

    firsts = {(*k, min(v)) for k, v in whole.items()}
    part = values.mapInPandas(curves, PARTIAL).groupBy("tbl", "col", "load").agg(
        F.max("ks").alias("ks"), *[F.max(q).alias(q) for q in ("q25", "q50", "q75", "q25s", "q50s", "q75s")]
    )
    first = counts.sparkSession.createDataFrame(sorted(firsts) or [("", "", "")],
        "tbl string, col string, load string").withColumn("is_first", F.lit(True))
    part = part.join(maybe_broadcast(first), ["tbl", "col", "load"], "left")
    joined = base.withColumn("load", F.coalesce("load", F.lit(""))).join(part, ["tbl", "col", "load"], "left")
    return joined.select(
        "tbl", "col", "load", "n", "nulls", F.round(F.col("nulls") / F.col("n"), 6).alias("null_rate"), "n_distinct",
        "violations", F.round(F.col("violations") / F.col("n"), 6).alias("violation_rate"),
        "min_num", "max_num", F.col("q25").alias("q25_num"), F.col("q50").alias("q50_num"), F.col("q75").alias("q75_num"),
        "min_txt", "max_txt", F.col("q25s").alias("q25_txt"), F.col("q50s").alias("q50_txt"), F.col("q75s").alias("q75_txt"),
        F.round(F.when(F.col("is_first").isNull(), F.col("ks")), 6).alias("ks"),
    )


def measure_faults() -> dict[str, Column]:
    """Fault of each measure of a run row: true where the value can't be right, false where it passes,
    NULL where the field's condition (n_total > 0, n_both_filled > 0) doesn't apply."""
    d = lambda c: F.col(c).cast("double")
    bad_count = F.col("n_filled").isNull() | F.isnan(d("n_filled")) | (d("n_filled") < 0) | (d("n_filled") > d("n_total"))
    bad_count = F.coalesce(bad_count, F.lit(False))

    def rate(v: str, num: str, den: str, comparable: Column) -> Column:
        x = d(v)
        off = F.coalesce(comparable & (F.abs(x - d(num) / d(den)) > RATE_TOLERANCE + EPS), F.lit(False))
        bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1) | off
        return F.when(d(den) > 0, bad)

    return {
        "n_filled": bad_count,
        "fill_rate": rate("fill_rate", "n_filled", "n_total", ~bad_count),
        "agreement_surface": rate("agreement_surface", "n_agree_both", "n_both_filled", F.col("n_agree_both").isNotNull()),
    }


def measure_cells(runs: DataFrame) -> DataFrame:
    """Measures of run rows, unpivoted to one cell per (row, field), each with its fault."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("v"), fault.alias("fault")) for k,
            fault in measure_faults().items()])
    return runs.select("manifest_row_id", "contract_id", "variable", "started_at", F.explode(cells).alias("c")).select(
        "manifest_row_id", "contract_id", "variable", "started_at", "c.*"
    )


def faulty_measures(runs: DataFrame) -> DataFrame:
    """(manifest_row_id, field) of measures that can't be right or have jumped.

    A passing rate has jumped if it differs by more than JUMP from the passing rate of the latest
    earlier run of its contract and variable. The earlier value comes from a range-sorted scan over
    (field, contract, variable, started_at): a partition starts from the last row of the partition
    before it, so a contract of any size spreads over many tasks. Rows of one run (re-sent rows) are
    each compared with the run before; of those the last by manifest_row_id stands for its run. Rows
    without contract, variable or start time have no run before them and can't have jumped. Empty
    input gives an empty result; extra columns are ignored.
    """
    cells = measure_cells(runs)
    faults = cells.where("fault").select("manifest_row_id", "field")
    rates = cells.where((~F.col("fault")) & (F.col("field") != "n_filled")).dropna(subset=["contract_id", "variable",
            "started_at"])
    rates = rates.withColumn("t", F.unix_micros("started_at")).select("field", "contract_id", "variable", "t",
        "manifest_row_id", "v")
    keys = ["field", "contract_id", "variable"]
    ordered = range_sorted(rates, [*keys, "t"], ["manifest_row_id"])

    def tail(batches):
        last = None
        pid, batches = numbered(batches)
        for b in batches:
            last = b.iloc[-1]
        rows = [] if last is None else [(pid, last.field, last.contract_id, last.variable, float(last.v))]
        yield pd.DataFrame(rows, columns=["pid", "field", "contract_id", "variable", "v"])

    carry, ends = {}, summaries(ordered, tail, "pid int, field string, contract_id string, variable string, v double")
    for a, b in zip(ends, ends[1:]):
        carry[b["pid"]] = ((a["field"], a["contract_id"], a["variable"]), a["v"])

    def jumps(batches):
        key, before, now, t = None, None, None, None
        pid, batches = numbered(batches)
        if pid in carry:
            key, now = carry[pid]
        for b in batches:
            hit = []
            for f, c, var, bt, i, v in b[[*keys, "t", "manifest_row_id", "v"]].itertuples(index=False, name=None):
                if (f, c, var) != key:
                    key, before, now, t = (f, c, var), None, None, bt
                elif bt != t:
                    before, t = now, bt
                now = v
                if before is not None and abs(v - before) > JUMP + EPS:
                    hit.append((i, f))
            yield pd.DataFrame(hit, columns=["manifest_row_id", "field"])

    return faults.unionByName(ordered.mapInPandas(jumps, "manifest_row_id long, field string")).distinct()
