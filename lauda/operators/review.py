"""Human review as an append-only log of annotations: latest wins, pending first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_annotations(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last annotation of every record; a NULL label clears it."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("a"),
        F.count("*").alias("n_versions")).select(key, "a.*", "n_versions")


def review_state(sample: DataFrame, log: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """Records of a sample beside their current annotation; done where it has a label."""
    a = latest_annotations(log, key, order)
    return sample.join(a, key, "left").withColumn("done", F.col(label).isNotNull())


def progress(state: DataFrame, key: str) -> DataFrame:
    """Totals and the first pending record."""
    return state.agg(F.count("*").alias("total"), F.count_if("done").alias("done"),
        F.min(F.when(~F.col("done"), F.col(key))).alias("first_pending"))


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as NULL, for JSON."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c,
            t in df.dtypes])
