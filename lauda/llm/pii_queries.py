"""Queries of problem 1 (personal information in reports)."""

from __future__ import annotations

from lauda.llm.char_queries import language_counts
from lauda.llm.pii import found_items, redacted
from lauda.session import reliable
from lauda.sources.tables import table


def p1_found(spark, d):
    return found_items(table(spark, d, "run_pilot"), language_counts(spark, d)).select("pilot_id", "kind", "start_pos").distinct()


def p1_redacted(spark, d):
    """Every report with its personal items replaced by typed placeholders."""
    reports = table(spark, d, "run_pilot")
    return redacted(reports, reliable(found_items(reports, language_counts(spark, d))))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
ORACLE: dict = {}
