"""File sources with explicit schemas: corpus CSV, JSON lines, regression sets, run manifests."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lauda.functions.text import nullify

NA = ("", "NA", "nan", "None")
KINDS = ("synthetic_canary", "synthetic_known_bug", "adjudicated_dev", "metamorphic_invariance", "metamorphic_expected_change")
CASE = "id string, kind string, text string, expected_value string, expected_status string, reference_text string, source string, note string"


def corpus_csv(spark: SparkSession, path: str, columns: list[str], limit: int | None = None, key: str | None = None) -> DataFrame:
    """Named columns of a CSV corpus, all text; the header gives their order. A row limit takes the least keys."""
    header = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in columns if c not in header]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"',
        enforceSchema=False).select(*columns)
    return df.orderBy(key or columns[0]).limit(limit) if limit is not None else df


def all_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as trimmed text, spellings of not available as NULL."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.select(*[nullify(F.col(f"`{c}`")).alias(c) for c in df.columns])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; malformed and blank lines are left out."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt IS NULL").select("r.*").drop("_corrupt")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def regression_set(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Regression cases and the SHA-256 of their file; anything unsound raises.

    Of a folder of files it is the SHA-256 of their own, in the order of their names.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path",
        F.sha2("content", 256).alias("sha")).orderBy("path").collect()  # one row a file
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", CASE + ", _corrupt string",
            {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    bad = (
        F.col("_corrupt").isNotNull() | F.col("id").isNull() | ~F.coalesce(F.col("kind"),
            F.lit("")).isin(*KINDS) | (F.trim(F.coalesce("text", F.lit(""))) == "")
        | ((F.col("kind") == "metamorphic_invariance") & F.col("reference_text").isNull())
    )
    n = lines.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_distinct("id").alias("ids")).first()
    if not n["n"] or n["bad"] or n["ids"] != n["n"]:
        raise ValueError(f"regression set {path}: {n['n']} cases, {n['bad']} unsound, {n['n'] - n['ids']} repeated ids")
    return lines.drop("_corrupt"), files[0]["sha"] if len(files) == 1 else hashlib.sha256("".join(r["sha"] for r in files).encode()).hexdigest()


VARIABLE = "array<struct<name:string,n_total:bigint,n_filled:bigint,fill_rate:double,status_distribution:map<string,bigint>,agreement_surface:double>>"
MANIFEST = f"contract_id string, contract_version string, run_id string, started_at timestamp, completed_at timestamp, variables {VARIABLE}"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Every run manifest below a folder with its path; unreadable files are left out."""
    df = spark.read.schema(MANIFEST + ", _corrupt string").option("recursiveFileLookup", True).option("pathGlobFilter",
        "*.json").option("columnNameOfCorruptRecord", "_corrupt").json(folder, multiLine=False)
    return df.withColumn("run_dir",
        F.col("_metadata.file_path")).where("_corrupt IS NULL AND contract_id IS NOT NULL").drop("_corrupt")


def manifest_variables(df: DataFrame) -> DataFrame:
    """One row per run and variable of the manifests."""
    return df.select("contract_id", "run_id", "started_at", F.explode("variables").alias("v")).select("contract_id", "run_id",
        "started_at", F.col("v.name").alias("variable"), "v.n_total", "v.n_filled", "v.fill_rate")
