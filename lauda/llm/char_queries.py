"""Queries of problems 2 (look-alike characters) and 6 (wrong encodings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.llm.charlm import collect_model, count_trigrams
from lauda.llm.encodings import restored_texts, sound
from lauda.llm.lookalikes import with_consistent_form
from lauda.sources.tables import table


def language_counts(spark, d, evidence: bool = False) -> dict[int, int]:
    """Character trigrams of all sound reports, and of all sound evidence where that is read anyway."""
    parts = [("run_pilot", "laudo"), *([("evidence_record", "evidence")] if evidence else [])]
    return collect_model(*(count_trigrams(sound(table(spark, d, t), c), c) for t, c in parts))


def p6_restored(spark, d):
    """Garbled reports with their restored wording, the swap read and the number of letters that stay lost."""
    return restored_texts(table(spark, d, "run_pilot"), "pilot_id", "laudo", language_counts(spark, d))


def p6_found(spark, d):
    return p6_restored(spark, d).select("pilot_id")


def _forms(spark, d):
    counts = language_counts(spark, d, evidence=True)
    pilot, evidence = table(spark, d, "run_pilot"), table(spark, d, "evidence_record")
    a = with_consistent_form(pilot, "pilot_id", "laudo", counts).select(F.lit("run_pilot").alias("src"),
        F.col("pilot_id").alias("row_id"), "form", "stands_in")
    b = with_consistent_form(evidence, "evidence_id", "evidence", counts).select(F.lit("evidence_record").alias("src"),
        F.col("evidence_id").alias("row_id"), "form", "stands_in")
    garbled = restored_texts(pilot, "pilot_id", "laudo", counts).select(F.lit("run_pilot").alias("src"),
        F.col("pilot_id").alias("row_id"), "restored")
    return a.unionByName(b), garbled, pilot, evidence


def p2_found(spark, d):
    forms, garbled, _, _ = _forms(spark, d)
    return forms.where("stands_in").select("src", "row_id").join(garbled.select("src", "row_id"), ["src", "row_id"], "left_anti")


def p2_forms(spark, d):
    """Every text of both tables in its consistent form; garbled reports are restored first."""
    forms, garbled, pilot, evidence = _forms(spark, d)
    texts = pilot.select(F.lit("run_pilot").alias("src"), F.col("pilot_id").alias("row_id"),
        F.col("laudo").alias("text")).unionByName(
        evidence.select(F.lit("evidence_record").alias("src"), F.col("evidence_id").alias("row_id"),
            F.col("evidence").alias("text"))
    )
    changed = forms.where("stands_in").select("src", "row_id", "form").join(garbled, ["src", "row_id"], "full")
    return texts.join(changed, ["src", "row_id"], "left").select("src", "row_id",
        F.coalesce("restored", "form", "text").alias("form"))


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms, "p6_found": p6_found, "p6_restored": p6_restored}
ORACLE: dict = {}
