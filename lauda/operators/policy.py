"""Policy resolution: a decision table over ontology and alias dimensions, evidence checks, readers' rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lauda.functions.text import collapse, is_missing, occurrences
from lauda.session import maybe_broadcast

EXACT, SEMANTIC, UNSUPPORTED, INCOMPLETE, ESCALATED = "accepted_exact", "accepted_semantic", "abstained_unsupported", "abstained_source_incomplete", "escalated_case"
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def policy_dimension(specs: DataFrame, aliases: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per variable: type, values, range, alias map, silence settings, abstention statuses.

    settings: (variable, default_if_silent, implicit_negative, abstention_statuses). Repeated alias
    rows count once; of two targets of one alias the least counts. Variables without a setting have
    no default and no abstention statuses.
    """
    spec = specs.groupBy("variable").agg(F.min("onto_type").alias("onto_type"),
        F.array_sort(F.collect_set("canonical")).alias("vals"), F.min("range_min").alias("lo"), F.max("range_max").alias("hi"))
    one = aliases.where("alias IS NOT NULL AND canonical IS NOT NULL").groupBy("variable",
        "alias").agg(F.min("canonical").alias("canonical"))
    alias = one.groupBy("variable").agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical"))).alias("aliases"))
    return spec.join(alias, "variable", "left").join(settings, "variable", "left")


def apply_policy(value: Column, status: Column) -> Column:
    """struct(resolution, normalized, reason) from columns of policy_dimension beside value and status.

    In order: abstention status; silence (with default and implicit negative, or not); alias; enum
    member; number in range; anything else of another type. A value that isn't known to any ontology
    (no dimension row) is accepted by default, as text.
    """
    num = F.when(value.rlike(NUMERIC), value.try_cast("double"))
    row = lambda r, n, why: F.struct(F.lit(r).alias("resolution"), n.cast("string").alias("normalized"),
        F.lit(why).alias("reason"))
    none = F.lit(None).cast("string")
    alias = F.try_element_at(F.coalesce("aliases", F.create_map().cast("map<string,string>")), value)
    numeric = F.col("onto_type").isin("integer", "float")
    return (
        F.when(F.array_contains(F.coalesce("abstention_statuses", F.array().cast("array<string>")), status),
            row(UNSUPPORTED, none, "status"))
        .when(value.isNull() & F.col("default_if_silent").isNotNull() & F.coalesce("implicit_negative", F.lit(False)),
            row(EXACT, F.col("default_if_silent"), "silence_mapped_to_default"))
        .when(value.isNull() & F.col("default_if_silent").isNotNull(), row(INCOMPLETE, none, "silence_but_no_implicit_negative"))
        .when(value.isNull(), row(INCOMPLETE, none, "silence"))
        .when(alias.isNotNull(), row(SEMANTIC, alias, "alias"))
        .when((F.col("onto_type") == "enum") & F.array_contains("vals", value), row(EXACT, value, "enum_match"))
        .when(F.col("onto_type") == "enum", row(ESCALATED, value, "not_in_enum"))
        .when(numeric & num.isNull(), row(ESCALATED, value, "not_numeric"))
        .when(numeric & ((num < F.col("lo")) | (num > F.col("hi"))), row(ESCALATED, value, "out_of_range"))
        .when(numeric, row(EXACT, value, "numeric_match"))
        .otherwise(row(EXACT, value, "default"))
    )


def verify_evidence(value: Column, evidence: Column, certainty: Column, text: Column, start: Column, end: Column) -> Column:
    """struct(verified, support, reason, occurrences): does the text hold the evidence, and where?

    Offsets first (literal, then collapsed), then the text as a whole, then a 20-character prefix,
    which is never a verification.
    """
    ev = F.trim(F.coalesce(evidence, F.lit("")))
    core = F.regexp_replace(ev, r"^[. ]+|[. ]+$", "")
    strong = F.when(F.lower(F.trim(F.coalesce(certainty, F.lit("high")))).isin("high", "strong"), "strong").otherwise("weak")
    inside = (start >= 0) & (end > start) & (end <= F.length(text))
    frag = F.substring(text, start + 1, end - start)
    meets = lambda a, b: a.contains(b) | b.contains(a)
    row = lambda v, s, r, n: F.struct(F.lit(v).alias("verified"), s.alias("support"), F.lit(r).alias("reason"),
        n.cast("int").alias("occurrences"))
    none = F.lit("none")
    return (
        F.when(value.isNull() & (ev == ""), row(True, none, "silence", F.lit(0)))
        .when(ev == "", row(False, none, "value_without_evidence", F.lit(0)))
        .when(core == "", row(False, none, "empty_evidence", F.lit(0)))
        .when(inside & meets(frag, core), row(True, strong, "offset_exact", F.lit(1)))
        .when(inside & meets(collapse(frag), collapse(core)), row(True, strong, "offset_normalized", F.lit(1)))
        .when(text.contains(core), row(True, F.lit("weak"), "substring", occurrences(text, core)))
        .when(text.contains(F.substring(core, 1, 20)),
            row(False, F.lit("weak_candidate"), "prefix", occurrences(text, F.substring(core, 1, 20))))
        .otherwise(row(False, none, "evidence_not_in_text", F.lit(0)))
    )


def mode_c(status: Column, certainty: Column, evidence_class: Column, scope_complete: Column, has_scope: Column,
    silence: Column, base: Column, verdict: Column) -> Column:
    """struct(resolution, normalized, reason): evidence-first resolution over a policy and an evidence verdict.

    `silence` and `base` are apply_policy of the silent and of the stated value.
    """
    row = lambda r, n, why: F.struct(r.alias("resolution"), n.alias("normalized"), why.alias("reason"))
    none, ec = F.lit(None).cast("string"), F.lower(F.trim(F.coalesce(evidence_class, F.lit(""))))
    silent = (status == "no_match") & F.coalesce("implicit_negative", F.lit(False))
    semantic = F.when(base["resolution"] == EXACT, F.lit(SEMANTIC)).otherwise(base["resolution"])
    return (
        F.when(silent & ~has_scope, row(silence["resolution"], silence["normalized"], F.lit("silence_unaudited")))
        .when(silent & F.coalesce(scope_complete, F.lit(False)),
            row(silence["resolution"], silence["normalized"], F.lit("silence_audited")))
        .when(silent, row(F.lit(INCOMPLETE), none, F.lit("silence_without_scope")))
        .when(~verdict["verified"],
            row(F.lit(ESCALATED), base["normalized"], F.concat(F.lit("evidence_failed:"), verdict["reason"])))
        .when(ec.isin("literal", "lexical_alias") & (base["resolution"] == EXACT),
            row(base["resolution"], base["normalized"], F.concat(base["reason"], F.lit("+"), ec)))
        .when(ec.isin("ontology_alias", "bound", "qualitative") & (base["resolution"] == EXACT),
            row(F.lit(SEMANTIC), base["normalized"], F.concat(base["reason"], F.lit("+"), ec)))
        .when((ec != "") & (ec != "silence_default") & (F.lower(F.trim(certainty)) == "low"),
            row(F.lit(ESCALATED), base["normalized"], F.concat(F.lit("low_certainty+"), ec)))
        .when(verdict["support"] == "weak", row(semantic, base["normalized"], F.concat(base["reason"], F.lit("+weak"))))
        .otherwise(row(base["resolution"], base["normalized"], base["reason"]))
    )


def with_policy(evidence: DataFrame, policies: DataFrame) -> DataFrame:
    """evidence beside its variable's policy; the dimension is broadcast if it is small."""
    return evidence.join(maybe_broadcast(policies), "variable", "left")


def clean_value(c: Column) -> Column:
    """Blank and spelled-out missing values as NULL."""
    return F.when(~is_missing(c), c)


def compliant(value: Column) -> Column:
    """Is a value allowed by the ontology beside it?"""
    num = F.when(value.rlike(NUMERIC), value.try_cast("double"))
    return (
        F.when(value.isNull(), False).when(F.col("onto_type") == "enum", F.array_contains("vals", value))
        .when(F.col("onto_type").isin("integer", "float"),
            F.coalesce(num.between(F.col("lo"), F.col("hi")), F.lit(False))).otherwise(True)
    )


def two_readers(a: Column, b: Column, supported: Column) -> Column:
    """State of a cell read twice: agreement, textual support of the only answer, escalated, or no answer."""
    return (
        F.when(a.isNotNull() & b.isNotNull() & (a == b), "aceito_concordancia").when(a.isNotNull() & b.isNotNull(), "escalado")
        .when(a.isNull() & b.isNull(), "sem_resposta").when(a.isNull() & supported,
            "aceito_suporte_textual").otherwise("escalado")
    )


def canonical_value(c: Column) -> Column:
    """Comparable form: a number rounded to four places, else folded text."""
    num = F.when(F.replace(c, F.lit(","), F.lit(".")).rlike(NUMERIC),
        F.round(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"), 4))
    return F.coalesce(F.when(num.isNotNull(), F.format_string("%.4f", num)), F.lower(F.trim(c)))


def drift_alert(delta: Column, yellow: float = 0.03, red: float = 0.15) -> Column:
    """Only losses alert; amounts at a threshold count."""
    loss = -F.least(delta, F.lit(0.0))
    return F.when(loss >= red - 1e-12, "RED").when(loss >= yellow - 1e-12, "YELLOW").otherwise("GREEN")


def cast_by_ontology(value: Column, onto_type: Column) -> Column:
    """A number as its ontology wants it: integers are cut off, not rounded; other types and texts have none."""
    num = F.when(value.rlike(NUMERIC), value.try_cast("double"))
    return F.when(onto_type == "integer", num.cast("bigint").cast("double")).when(onto_type == "float", num)


def values_equal(a: Column, b: Column) -> Column:
    """Both missing, the same number, or the same text whatever its case."""
    return canonical_value(a).eqNullSafe(canonical_value(b))
