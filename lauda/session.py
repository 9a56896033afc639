"""Session helpers: shared checkpoints, bounded collects and size-checked broadcasts."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension is only sent to every executor below this many bytes (optimizer estimate).
BROADCAST_BYTES = 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a temporary folder only in one local process (tests).

    A cluster without the setting is an error: a folder of one machine would be lost with it.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="lauda-"))


def reliable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, cutting its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lauda_shipped", False):
        return
    root, buf = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    # the driver's own file, served by Spark; nothing is read from a local folder on the executors
    path = Path(tempfile.mkdtemp(prefix="lauda-")) / "lauda_package.zip"
    path.write_bytes(buf.getvalue())
    sc.addPyFile(str(path))
    sc._lauda_shipped = True


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when df is small; otherwise leave the join strategy to AQE."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def collect_bounded(df: DataFrame, max_rows: int):
    """Rows of a dimension, or None when it has more than max_rows (callers then use a join)."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than that; otherwise as it is.

    For work that costs far more than moving the rows (dozens of patterns over each text). A large table
    has more partitions than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
