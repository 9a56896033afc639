"""Queries of problem 4 (free-entered values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.llm.vocabulary import NONE, to_canonical
from lauda.sources.tables import table


def p4_found(spark, d):
    return to_canonical(table(spark, d, "cross_verdict"), table(spark, d, "ontology_spec"), table(spark, d, "policy_alias"))


def p4_misses(spark, d):
    """How often each unmatched value stands in each variable."""
    v = table(spark, d, "cross_verdict")
    return p4_found(spark, d).where(F.col("canonical") == NONE).join(v, "verdict_id").groupBy("variable",
        "value").agg(F.count("*").alias("n"))


QUERIES = {"p4_found": p4_found, "p4_misses": p4_misses}
ORACLE: dict = {}
