"""Sinks: tall results by variable, JSON lines, compaction, run manifests, reports."""

from __future__ import annotations

import hashlib
import html
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.operators.sampling import stratified
from lauda.session import ensure_checkpoint_dir
from lauda.sources.files import last_wins


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:12]}"


def write_results(df: DataFrame, folder: str, form: str = "parquet") -> None:
    """Tall results, one folder per variable; a rerun of the same variables replaces theirs only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variable").format(form).save(folder)


def append_lines(df: DataFrame, folder: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; nested columns as JSON, quotes doubled."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map",
            "array") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(folder, header=True, quote='"', escape='"', quoteAll=True, emptyValue="")


def compact(spark: SparkSession, lines: str, target: str, schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """Checkpoint lines reduced to the last row per key and written as a table."""
    last_wins(spark.read.schema(schema).json(lines), keys, order).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def run_manifest(runs: DataFrame) -> DataFrame:
    """One JSON document per run: hashes aside, the summaries of its variables."""
    v = F.struct(F.col("variable").alias("name"), "n_total", "n_filled", "fill_rate", "status_distribution", "agreement_surface")
    g = runs.groupBy("contract_id", "run_id", "started_at").agg(F.first("contract_version").alias("contract_version"),
        F.max("completed_at").alias("completed_at"),
        F.array_sort(F.collect_list(v.dropFields("status_distribution"))).alias("_k"), F.collect_list(v).alias("variables"))
    return g.select(F.to_json(F.struct("contract_id", "contract_version", "run_id", "started_at", "completed_at",
                "variables")).alias("value"),
        "contract_id")


def write_manifests(runs: DataFrame, folder: str) -> None:
    run_manifest(runs).write.mode("overwrite").partitionBy("contract_id").text(folder)
    # text files carry the JSON lines; readers take them by extension
    jvm, sc = runs.sparkSession._jvm, runs.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc.hadoopConfiguration())
    it = fs.listFiles(path, True)
    while it.hasNext():
        p = it.next().getPath()
        if p.getName().endswith(".txt"):
            fs.rename(p, jvm.org.apache.hadoop.fs.Path(p.getParent(), p.getName()[:-4] + ".json"))


def markdown_table(df: DataFrame, title: str, limit: int = 50) -> str:
    """A report table of the first rows of a result; says so where there are more."""
    rows = df.limit(limit + 1).collect()
    rest = f"\nFirst {limit} rows.\n" if len(rows) > limit else ""
    rows = rows[:limit]
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if x is None else str(x).replace("|",
                "\\|") for x in r) + " |" for r in rows) + "\n" + rest


def sparkline(values: list[float | None], width: int = 200, height: int = 30) -> str:
    """Inline SVG of a series; gaps break the line; a flat or empty series stays in the middle."""
    known = [v for v in values if v is not None]
    lo, hi = (min(known), max(known)) if known else (0.0, 1.0)
    x = lambda i: i * width / max(len(values) - 1, 1)
    y = lambda v: height / 2 if hi == lo else height - (v - lo) * height / (hi - lo)
    runs, cur = [], []
    for i, v in enumerate(values):
        if v is None:
            runs, cur = runs + [cur] * bool(cur), []
        else:
            cur.append(f"{x(i):.1f},{y(v):.1f}")
    runs += [cur] * bool(cur)
    return f'<svg width="{width}" height="{height}">' + "".join(f'<polyline fill="none" stroke="currentColor" points="{" ".join(r)}"/>' for r in runs) + "</svg>"


def bars(labels: list[str], values: list[float], width: int = 400, height: int = 120) -> str:
    """Inline SVG of bars with their labels as titles."""
    top, step = max(values, default=0) or 1, width / max(len(values), 1)
    return f'<svg width="{width}" height="{height}">' + "".join(f'<rect x="{i * step:.1f}" y="{height - v * height / top:.1f}" width="{step * 0.8:.1f}" height="{v * height / top:.1f}"><title>{html.escape(str(k))}: {v:g}</title></rect>' for i,
        (k, v) in enumerate(zip(labels, values))) + "</svg>"


def dashboard(points: DataFrame, title: str, contract: str) -> str:
    """HTML of the run timelines of one contract (points: the output of observe.timeline)."""
    rows = points.where(F.col("contract_id") == contract).orderBy("variable", "started_at", "run_id").collect()
    series: dict = {}
    for r in rows:
        v = r["fill_rate"]
        series.setdefault(r["variable"], []).append(None if v is None or v != v else v)
    body = "".join(f"<tr><td>{html.escape(k)}</td><td>{sum(x is not None for x in v)} of {len(v)}</td><td>{sparkline(v)}</td></tr>" for k,
        v in series.items())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{body}</table>"


def cards_jsonl(cards: list[dict]) -> str:
    return "".join(json.dumps(c, ensure_ascii=False, sort_keys=True) + "\n" for c in cards)


def write_audit(rows: DataFrame, strata: list[str], key: str, n: int, folder: str, seed: int = 42) -> None:
    """A stratified sample as JSON lines in folder/sample and its manifest in folder/manifest.

    The manifest names the seed, the size per stratum and how many rows each stratum had; strata without
    a name are to be filled in before.
    """
    stratified(rows, strata, key, n, seed).drop("pick").write.mode("overwrite").json(f"{folder}/sample")
    counts = rows.groupBy(*strata).agg(F.count("*").alias("available"))
    each = F.array_sort(F.collect_list(F.struct(*strata, "available")))
    counts.agg(F.lit(seed).alias("seed"), F.lit(n).alias("per_stratum"), each.alias("strata"),
        F.sum("available").alias("rows")).write.mode("overwrite").json(f"{folder}/manifest")


def read_audit(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sample, manifest) of an audit folder."""
    return spark.read.json(f"{folder}/sample"), spark.read.json(f"{folder}/manifest")


def discovery_markdown(report: DataFrame) -> str:
    """The discovery report (observe.discovery): one line a variable, those with most misses first."""
    return markdown_table(report.orderBy(F.desc("n_misses"), "variable").select("variable", "n", "n_misses", "top_value",
            "n_top", "n_leaks", "n_silent", "silence_suspect"),
        "Discovery", 1000)


def drift_markdown(report: DataFrame) -> str:
    """The drift of the last two runs, alerts first: RED, YELLOW, then GREEN."""
    order = F.when(F.col("alert") == "RED", 0).when(F.col("alert") == "YELLOW", 1).otherwise(2)
    return markdown_table(report.orderBy(order, *report.columns[:2]), "Drift", 1000)


def cards_markdown(cards: DataFrame, variable: str) -> str:
    """Rule cards of one variable by lane, the largest first, each under a heading of its own."""
    lane = F.when(F.col("lane") == "positive", 0).when(F.col("lane") == "multidim", 1).otherwise(2)
    rows = cards.where(F.col("variable") == variable).orderBy(lane, F.desc("n"), "family_id").limit(1001).collect()
    parts = [f"# Rule cards of {variable}\n"]
    for r in rows[:1000]:
        parts.append(f"\n## {r['family_id']} ({r['lane']})\n\n" + "".join(f"- {k}: {'' if r[k] is None else r[k]}\n" for k in r.asDict() if k not in ("variable",
                    "family_id", "lane")))
    return "".join(parts) + ("\nNo cards.\n" if not rows else "\nFirst 1000 cards.\n" if len(rows) > 1000 else "")


def source_hash(paths: list[str]) -> str:
    """SHA-256 over the files of the code that a run used, in the order of their names."""
    h = hashlib.sha256()
    for p in sorted(paths):
        h.update(Path(p).name.encode() + b"\0" + Path(p).read_bytes())
    return h.hexdigest()
