"""Queries over the core quality operators: column profiles (problem 3) and units (problem 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.functions.text import FALLBACK, SECTIONS, START
from lauda.operators.policy import clean_value, compliant
from lauda.operators.profile import faulty_measures, measure_faults, profile_columns, unpivot_values
from lauda.operators.units import foreign_units, unit_history
from lauda.session import maybe_broadcast
from lauda.sources.tables import table

# Codes of evidence_record, letter for letter.
VOCABULARY = {
    "section": (*(k for k, _ in SECTIONS), START, FALLBACK, "preparo"),
    "certainty": ("high", "medium", "low"),
    "evidence_class": ("literal", "lexical_alias", "ontology_alias", "bound", "silence_default"),
    "resolution": ("accepted_exact", "accepted_semantic", "accepted_cross_verified", "abstained_unsupported",
        "abstained_source_incomplete", "abstained_by_consensus", "escalated_case", "escalated_policy"),
}
CODE, KEY = r"^[a-z][a-z0-9_]*$", r"^[A-Z]+-\d+$"
PATTERNS = {"run_id": CODE, "variable": CODE, "id_registro": KEY, "clinica": KEY, "status": CODE,
    "scope_meta.detector_version": r"^v\d+(\.\d+)*$"}
#: Control, format and replacement characters; line ends and tabs are ordinary.
UNREADABLE = r"[\p{Cc}\p{Cf}\x{FFFD}&&[^\n\r\t]]"
FIRST_YEAR, LAST_YEAR = 2000, 2100


def evidence_rules():
    """Rule of each column of evidence_record beside its policy: true where a value breaks it.

    NULL and blank text break no rule, they are nulls of the profile; NaN does. A span of -1, -1 is none.
    """
    c, start, end = F.col, F.col("span_start"), F.col("span_end")
    filled = lambda x: F.when(F.trim(x) != "", x)
    half = (start.isNull() != end.isNull()) | ((start < 0) != (end < 0))
    num = c("value_num")
    rules = {k: ~filled(c(k)).isin(*words) for k, words in VOCABULARY.items()} | {k: ~filled(c(k)).rlike(p) for k,
        p in PATTERNS.items()}
    rules |= {k: c(k).rlike(UNREADABLE) for k in ("evidence", "reason")}
    rules |= {k: filled(c(k)).isNotNull() & clean_value(c(k)).isNotNull() & ~compliant(c(k)) for k in ("value", "ia",
            "normalized")}
    rules |= {f"scope_meta.{k}": c(f"scope_meta.{k}") < 0 for k in ("chars_scanned", "hits_total", "explicit_negative_hits",
            "historical_hits")}
    return rules | {
        "evidence_id": c("evidence_id") < 0,
        "stratum": ~F.coalesce(F.try_element_at("stratum", F.lit("ano")).rlike(r"^(19|20)\d\d$"),
            F.lit(True)) | (F.try_element_at("stratum", F.lit("clinica")) != c("clinica")),
        "value_num": F.isnan(num) | num.isin(float("inf"),
            float("-inf")) | (num < 0) | (c("onto_type").isin("integer", "float") & ~num.between(c("lo"), c("hi"))),
        "span_start": (start < -1) | half,
        "span_end": (end < start) | (end < -1) | half,
        "scope_meta.scope_complete": F.lit(False),
        "scope_meta.sections_scanned": F.exists("scope_meta.sections_scanned", lambda x: ~x.isin(*VOCABULARY["section"])),
        "scope_meta.pattern_families_run": F.exists("scope_meta.pattern_families_run", lambda x: ~x.rlike(CODE)),
        "written_at": ~F.year("written_at").between(FIRST_YEAR, LAST_YEAR),
    }


def p3_found(spark, d):
    return faulty_measures(table(spark, d, "run_variable"))


def p3_profile(spark, d):
    """Profile of the measures of run_variable and of every column of evidence_record, per month of load.

    Violations are faults of the measures themselves (as in p3_found, without jumps) and values of
    evidence_record that break the range, pattern or vocabulary of their column.
    """
    month = lambda c: F.date_format(c, "yyyy-MM")
    runs = unpivot_values(table(spark, d, "run_variable"), month("loaded_at"), "run_variable",
        ["fill_rate", "n_filled", "agreement_surface"], measure_faults())
    rules = evidence_rules()
    known = table(spark, d, "ontology_spec").groupBy("variable").agg(F.min("onto_type").alias("onto_type"),
        F.collect_set("canonical").alias("vals"), F.min("range_min").alias("lo"), F.max("range_max").alias("hi"))
    ev = unpivot_values(table(spark, d, "evidence_record").join(maybe_broadcast(known), "variable", "left"),
        month("written_at"), "evidence_record", list(rules), rules)
    return profile_columns(runs.unionByName(ev))


def p5_found(spark, d):
    return foreign_units(table(spark, d, "regression_case"), table(spark, d, "ontology_spec"))


def p5_segments(spark, d):
    """Every numeric record with its segment level and its value in the common unit (NULL unit: by level)."""
    h = unit_history(table(spark, d, "regression_case"), table(spark, d, "ontology_spec"))
    value = F.coalesce(F.col("milli"), F.round(F.col("num") * F.col("level_factor") * 1000).cast("long"))
    return h.select("case_no", "source", "variable", F.col("stated"), "level_factor", "segment_change",
        value.alias("value_milli"))


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p5_found": p5_found, "p5_segments": p5_segments}

_RATE = """
  SELECT *, CASE WHEN {den} > 0 THEN COALESCE({v} IS NULL OR isnan({v}) OR {v} < 0 OR {v} > 1
      OR (({cmp}) AND ABS({v} - {num}::DOUBLE / {den}) > 0.001000001), FALSE) END AS bad, {v} AS val, '{v}' AS field FROM r"""
_BAD_N = "n_filled IS NULL OR n_filled < 0 OR n_filled > n_total"

ORACLE = {
    "p3_found": f"""
WITH r AS (SELECT * FROM run_variable), c AS (
  {_RATE.format(v="fill_rate", num="n_filled", den="n_total", cmp=f"NOT ({_BAD_N})")}
  UNION ALL {_RATE.format(v="agreement_surface", num="n_agree_both", den="n_both_filled", cmp="n_agree_both IS NOT NULL")}),
runs AS (SELECT field, contract_id, variable, started_at, arg_max(val, manifest_row_id) AS v FROM c
  WHERE bad = FALSE GROUP BY ALL),
prev AS (SELECT *, LAG(v) OVER (PARTITION BY field, contract_id, variable ORDER BY started_at) AS pv FROM runs)
SELECT manifest_row_id, field FROM c WHERE bad
UNION SELECT manifest_row_id, 'n_filled' FROM r WHERE {_BAD_N}
UNION SELECT c.manifest_row_id, c.field FROM c JOIN prev USING (field, contract_id, variable, started_at)
  WHERE c.bad = FALSE AND ABS(c.val - prev.pv) > 0.100000001""",
}


# SQL of p3_profile: every cell as (tbl, col, load, num, txt, bad), then counts, order statistics and curves.
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_FILLED = lambda c: f"CASE WHEN trim({c}) <> '' THEN {c} END"
_CLEAN = "CASE WHEN {0} IS NOT NULL AND trim({0}) NOT IN ('', 'NA', 'nan', 'NaN', 'None') THEN {0} END"
_NUMBER = r"CASE WHEN regexp_matches({0}, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(trim({0}) AS DOUBLE) END"
_ALLOWED = "CASE WHEN onto_type = 'enum' THEN list_contains(vals, {0}) WHEN onto_type IN ('integer', 'float') THEN COALESCE(" + _NUMBER + " BETWEEN lo AND hi, FALSE) ELSE TRUE END"
_HALF = "((span_start IS NULL) <> (span_end IS NULL) OR (span_start < 0) <> (span_end < 0))"
_TEXT_RULES = (
    {k: f"{_FILLED(k)} NOT IN {_LIST(words)}" for k,
        words in VOCABULARY.items()} | {k: f"NOT regexp_matches({_FILLED(k)}, '{p}')" for k, p in PATTERNS.items()}
    | {k: f"regexp_matches({k}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\p{{Cf}}\\x{{FFFD}}]')" for k in ("evidence",
            "reason")}
    | {k: f"{_FILLED(k)} IS NOT NULL AND {_CLEAN.format(k)} IS NOT NULL AND NOT ({_ALLOWED.format(k)})" for k in ("value",
            "ia", "normalized")}
)
_NUMBER_RULES = {f"scope_meta.{k}": f"scope_meta.{k} < 0" for k in ("chars_scanned", "hits_total", "explicit_negative_hits",
        "historical_hits")} | {
    "evidence_id": "evidence_id < 0",
    "value_num": "isnan(value_num) OR isinf(value_num) OR value_num < 0 OR (onto_type IN ('integer', 'float') AND NOT (value_num BETWEEN lo AND hi))",
    "span_start": f"span_start < -1 OR {_HALF}", "span_end": f"span_end < span_start OR span_end < -1 OR {_HALF}",
}
_OTHER_RULES = {  # label: (num, txt, rule)
    "stratum": ("NULL", "CAST(to_json(stratum) AS VARCHAR)",
        r"(NOT COALESCE(regexp_matches(stratum['ano'], '^(19|20)\d\d$'), TRUE)) OR stratum['clinica'] <> clinica"),
    "scope_meta.scope_complete": ("NULL", "CAST(scope_meta.scope_complete AS VARCHAR)", "FALSE"),
    "scope_meta.sections_scanned": ("NULL", "CAST(to_json(scope_meta.sections_scanned) AS VARCHAR)",
        f"len(list_filter(scope_meta.sections_scanned, lambda x: x NOT IN {_LIST(VOCABULARY['section'])})) > 0"),
    "scope_meta.pattern_families_run": ("NULL", "CAST(to_json(scope_meta.pattern_families_run) AS VARCHAR)",
        f"len(list_filter(scope_meta.pattern_families_run, lambda x: NOT regexp_matches(x, '{CODE}'))) > 0"),
    "written_at": ("CAST(epoch_us(written_at) AS DOUBLE)", "NULL",
        f"NOT (year(written_at) BETWEEN {FIRST_YEAR} AND {LAST_YEAR})"),
}
_CELL = lambda tbl, col, num, txt, bad, load, src: f"SELECT '{tbl}' AS tbl, '{col}' AS col, COALESCE(strftime({load}, '%Y-%m'), '') AS load, CAST({num} AS DOUBLE) AS num, CAST({txt} AS VARCHAR) AS txt, CAST(COALESCE({bad}, FALSE) AS BIGINT) AS bad FROM {src}"
_CELLS = [_CELL("evidence_record", k, "NULL", _FILLED(k), q, "written_at", "ev") for k, q in _TEXT_RULES.items()]
_CELLS += [_CELL("evidence_record", k, f"CASE WHEN NOT isnan(CAST({k} AS DOUBLE)) THEN {k} END", "NULL", q, "written_at",
        "ev") for k,
    q in _NUMBER_RULES.items()]
_CELLS += [_CELL("evidence_record", k, *x, "written_at", "ev") for k, x in _OTHER_RULES.items()]
_MEASURE = {
    "n_filled": f"COALESCE({_BAD_N}, FALSE)",
    "fill_rate": f"CASE WHEN n_total > 0 THEN fill_rate IS NULL OR isnan(fill_rate) OR fill_rate < 0 OR fill_rate > 1 OR COALESCE(NOT COALESCE({_BAD_N}, FALSE) AND ABS(fill_rate - n_filled::DOUBLE / n_total) > 0.001000001, FALSE) END",
    "agreement_surface": "CASE WHEN n_both_filled > 0 THEN agreement_surface IS NULL OR isnan(agreement_surface) OR agreement_surface < 0 OR agreement_surface > 1 OR COALESCE(n_agree_both IS NOT NULL AND ABS(agreement_surface - n_agree_both::DOUBLE / n_both_filled) > 0.001000001, FALSE) END",
}
_CELLS += [_CELL("run_variable", k, f"CASE WHEN NOT isnan(CAST({k} AS DOUBLE)) THEN {k} END", "NULL", q, "loaded_at",
        "run_variable") for k,
    q in _MEASURE.items()]
_QS = ", ".join(f"min(num) FILTER (cum >= ceil({q} * total - 1e-9)) AS q{p}_num, min(txt) FILTER (num IS NULL AND cum >= ceil({q} * total - 1e-9)) AS q{p}_txt" for q,
    p in ((0.25, 25), (0.5, 50), (0.75, 75)))

ORACLE["p3_profile"] = f"""
WITH known AS (SELECT variable, min(onto_type) AS onto_type, list(DISTINCT canonical) FILTER (canonical IS NOT NULL) AS vals, min(range_min) AS lo, max(range_max) AS hi FROM ontology_spec GROUP BY 1),
ev AS MATERIALIZED (SELECT e.*, onto_type, vals, lo, hi FROM evidence_record e LEFT JOIN known USING (variable)),
v AS MATERIALIZED ({' UNION ALL '.join(_CELLS)}),
base AS (SELECT tbl, col, load, COUNT(*) AS n, COUNT(*) FILTER (num IS NULL AND txt IS NULL) AS nulls, COUNT(DISTINCT (num, txt)) FILTER (num IS NOT NULL OR txt IS NOT NULL) AS n_distinct, CAST(SUM(bad) AS BIGINT) AS violations,
  min(num) AS min_num, max(num) AS max_num, min(txt) AS min_txt, max(txt) AS max_txt FROM v GROUP BY ALL),
c AS MATERIALIZED (SELECT tbl, col, load, num, txt, COUNT(*) AS n FROM v WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, SUM(n) OVER (PARTITION BY tbl, col, load ORDER BY num, txt) AS cum, SUM(n) OVER (PARTITION BY tbl, col, load) AS total FROM c),
q AS (SELECT tbl, col, load, {_QS} FROM cum GROUP BY ALL),
t AS (SELECT tbl, col, load, SUM(n) AS total FROM c GROUP BY ALL), pairs AS (SELECT *, LAG(load) OVER w AS before, LAG(total) OVER w AS total_before FROM t WINDOW w AS (PARTITION BY tbl, col ORDER BY load)),
d AS (SELECT p.tbl, p.col, p.load, num, txt, n / p.total AS step FROM pairs p JOIN c USING (tbl, col, load) WHERE before IS NOT NULL
  UNION ALL SELECT p.tbl, p.col, p.load, num, txt, -n / p.total_before FROM pairs p JOIN c ON c.tbl = p.tbl AND c.col = p.col AND c.load = p.before),
s AS (SELECT tbl, col, load, num, txt, SUM(step) AS step FROM d GROUP BY ALL), k AS (SELECT tbl, col, load, ABS(SUM(step) OVER (PARTITION BY tbl, col, load ORDER BY num, txt)) AS gap FROM s), ks AS (SELECT tbl, col, load, round(max(gap), 6) AS ks FROM k GROUP BY ALL)
SELECT tbl, col, load, n, nulls, round(nulls / n, 6) AS null_rate, n_distinct, violations, round(violations / n, 6) AS violation_rate, min_num, max_num, q25_num, q50_num, q75_num, min_txt, max_txt, q25_txt, q50_txt, q75_txt, ks
FROM base LEFT JOIN q USING (tbl, col, load) LEFT JOIN ks USING (tbl, col, load)"""
