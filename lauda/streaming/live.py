"""Structured Streaming: policy resolution of arriving evidence, resumable; windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.session import maybe_broadcast
from lauda.operators.policy import apply_policy, clean_value
from lauda.sources.sinks import shared_folder


def _glob(path: str) -> str:
    """The table as a glob, which a file source accepts for one file as for a folder."""
    return path[:-1] + f"[{path[-1]}]"


def stream_table(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A parquet table as a stream; its schema comes from the table."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(_glob(path))


def run_to_end(stream: DataFrame, target: str, each, mode: str = "append") -> None:
    """Process all that is there in micro-batches, with a checkpoint to resume from."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation",
        target + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def resolve_stream(spark: SparkSession, path: str, policies: DataFrame, target: str | None = None) -> DataFrame:
    """Evidence resolved as it arrives, then read back.

    A batch is keyed by its id, so that a batch run again after a failure replaces itself. With the
    target of an earlier run only what has arrived since is read.
    """
    target = target or shared_folder(spark, "resolved")
    s = stream_table(spark, path).select("evidence_id", "variable", clean_value(F.col("value")).alias("value"),
        "status").join(maybe_broadcast(policies), "variable", "left")
    s = s.select("evidence_id", "variable", apply_policy(F.col("value"), F.col("status")).alias("r")).select("evidence_id",
        "variable", "r.*")
    run_to_end(s, target, lambda b, i: b.write.mode("overwrite").parquet(f"{target}/batch={i}"))
    return spark.read.parquet(target).drop("batch")


def windowed_counts(spark: SparkSession, path: str, size: str = "1 day", late: str | None = None,
    target: str | None = None) -> DataFrame:
    """Events per window and type.

    Without `late` every micro-batch writes its own counts, keyed by its id, and they are added up when
    read: there is no state to grow, and a row counts however late it is. With `late` the engine keeps
    the windows itself (update mode) and drops what is later than the watermark, the state with it; a
    window's last batch holds its count. With the target of an earlier run only new files are read.
    """
    target = target or shared_folder(spark, "windows")
    s = stream_table(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    count = lambda x: x.groupBy(F.window("ts", size),
        "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")
    write = lambda b, i: b.write.mode("overwrite").parquet(f"{target}/batch={i}")
    if late is None:
        run_to_end(s, target, lambda b, i: write(count(b), i))
        total = F.sum("n")
    else:
        run_to_end(count(s.withWatermark("ts", late)), target, write, "update")
        total = F.max_by("n", "batch")
    return spark.read.schema("day timestamp, event_type string, n long, batch int").parquet(target).groupBy("day",
        "event_type").agg(total.alias("n"))
