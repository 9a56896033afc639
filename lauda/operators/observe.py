"""Observability over the run history: drift between consecutive runs, new statuses, timelines, saturation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.operators.policy import drift_alert
from lauda.operators.range_scan import with_last_before
from lauda.operators.topk import top_per_group


PARTS = 16


def one_row_per_run(runs: DataFrame) -> DataFrame:
    """Re-sent rows of a run and variable count once: the greatest id stands."""
    cols = [c for c in runs.columns if c not in ("contract_id", "variable", "started_at", "run_id")]
    g = runs.groupBy("contract_id", "variable", "started_at",
        "run_id").agg(F.max_by(F.struct(*cols), "manifest_row_id").alias("r"))
    return g.select("contract_id", "variable", "started_at", "run_id", "r.*")


def drift(runs: DataFrame) -> DataFrame:
    """Change of the rates against the run before of the same contract and variable, and its alert."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    r = one_row_per_run(runs).select("contract_id", "variable", "started_at", "run_id", ok("fill_rate").alias("fill"),
        ok("agreement_surface").alias("agree"))
    r = with_last_before(r, ["contract_id", "variable"], ["started_at", "run_id"], ["fill", "agree"])
    r = r.withColumn("df", F.round(F.col("fill") - F.col("prev.fill"), 4)).withColumn("da",
        F.round(F.col("agree") - F.col("prev.agree"), 4))
    worst = F.greatest(*[F.when(drift_alert(F.coalesce(c, F.lit(0.0))) == "RED",
                2).when(drift_alert(F.coalesce(c, F.lit(0.0))) == "YELLOW", 1).otherwise(0) for c in (F.col("df"), F.col("da"))])
    return r.select("run_id", "variable", "df", "da",
        F.element_at(F.array(F.lit("GREEN"), F.lit("YELLOW"), F.lit("RED")), worst + 1).alias("alert"))


def new_statuses(runs: DataFrame) -> DataFrame:
    """Statuses of a run that the run before didn't have: (run_id, variable, status, n)."""
    r = one_row_per_run(runs).select("contract_id", "variable", "started_at", "run_id", "status_distribution")
    r = with_last_before(r, ["contract_id", "variable"], ["started_at", "run_id"],
        ["status_distribution"]).where("prev.status_distribution IS NOT NULL")
    fresh = F.map_filter("status_distribution", lambda k, _: ~F.array_contains(F.map_keys("prev.status_distribution"), k))
    return r.select("run_id", "variable", F.explode(fresh).alias("status", "n"))


def latest_runs(runs: DataFrame, k: int = 2) -> DataFrame:
    """The last k runs of every contract."""
    heads = runs.select("contract_id", "run_id", "started_at").distinct()
    return top_per_group(heads, ["contract_id"], [F.desc("started_at"), F.desc("run_id")], k, "run_id",
        "age").select("contract_id", "run_id", "age")


def timeline(runs: DataFrame) -> DataFrame:
    """Points per contract, variable and run, aligned over the contract's runs: NULL where a run lacks the variable.

    The runs of one contract are spread by their hash over PARTS keys and its variables, which are few,
    repeated for each, so that a contract with most of the runs isn't one task.
    """
    r = one_row_per_run(runs)
    at = r.select("contract_id", "run_id", "started_at").distinct().withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(PARTS)))
    wanted = r.select("contract_id", "variable").distinct().withColumn("part",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    points = r.select("contract_id", "variable", "run_id", F.round("fill_rate", 4).alias("fill_rate"))
    return wanted.join(at, ["contract_id", "part"]).join(points, ["contract_id", "variable", "run_id"],
        "left").select("contract_id", "variable", "run_id", "started_at", "fill_rate")


def last_known(runs: DataFrame) -> DataFrame:
    """The last fill rate that isn't missing, of every contract and variable."""
    r = one_row_per_run(runs).where(F.col("fill_rate").isNotNull() & ~F.isnan("fill_rate"))
    return r.groupBy("contract_id", "variable").agg(F.max_by("fill_rate", F.struct("started_at", "run_id")).alias("fill_rate"))


def saturation(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Has a comparison converged? cells: keys, agree, l1_wrong, l2_wrong, ambiguous (booleans)."""
    c = F.col
    g = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~c("agree")).alias("n_disagree"),
        F.count_if(c("l1_wrong")).alias("l1"), F.count_if(c("l2_wrong")).alias("l2"), F.count_if(c("ambiguous")).alias("amb"))
    conc, share = 100 * (c("n") - c("n_disagree")) / c("n"), F.when(c("n_disagree") > 0,
        100 * c("l2") / c("n_disagree")).otherwise(100.0)
    return g.select(*keys, "n", "n_disagree", F.bround(conc, 2).alias("concordance"),
        F.bround(100 * c("l1") / c("n"), 4).alias("l1_error"), F.bround(share, 1).alias("l2_share"),
        F.bround(100 * c("amb") / c("n"), 2).alias("residual"),
        ((c("l1") == 0) & (conc >= 95) & (share >= 85)).alias("saturated"))


def discovery(evidence: DataFrame, expected: dict[str, list[str]] | None = None, suspect: float = 0.5) -> DataFrame:
    """What is worth a look in each variable, in one aggregation: misses, their leading value, leaks, silence.

    evidence: (variable, value, ia, section, resolution), values already cleaned. expected names the sections
    of a variable; of one without names no value leaks. Ties of the leading value go to the lesser one.
    """
    c = F.col
    miss = c("value").isNull() & c("ia").isNotNull()
    places = F.create_map(*[x for k,
            v in (expected or {}).items() for x in (F.lit(k),
                F.array(*map(F.lit, v)))]) if expected else F.create_map().cast("map<string,array<string>>")
    leak = c("value").isNotNull() & c("section").isNotNull() & places[c("variable")].isNotNull() & ~F.array_contains(places[c("variable")],
        c("section"))
    x = evidence.select("variable", F.when(miss, c("ia")).alias("cluster"), miss.alias("miss"), leak.alias("leak"),
        F.coalesce(c("resolution").startswith("abstained"), F.lit(False)).alias("silent"))
    per = x.groupBy("variable", "cluster").agg(F.count("*").alias("n"), F.count_if("miss").alias("misses"),
        F.count_if("leak").alias("leaks"), F.count_if("silent").alias("silent"))
    top = F.max_by("cluster",
        F.struct(F.when(c("cluster").isNotNull(), c("n")), F.transform(F.split("cluster", ""), lambda ch: -F.ascii(ch))))
    g = per.groupBy("variable").agg(F.sum("n").alias("n"), F.sum("misses").alias("n_misses"),
        F.count("cluster").alias("n_clusters"), top.alias("top_value"),
        F.max(F.when(c("cluster").isNotNull(), c("n"))).alias("n_top"), F.sum("leaks").alias("n_leaks"),
        F.sum("silent").alias("n_silent"))
    return g.withColumn("silence_suspect", c("n_silent") / c("n") >= suspect)
