"""Second verification of escalated cells from stored verdicts: budget, consensus, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.functions.text import collapse
from lauda.operators.policy import clean_value
from lauda.operators.topk import top_per_group
from lauda.session import maybe_broadcast


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per case, variable and model: the last cached, then the greatest id."""
    g = verdicts.groupBy("id_key", "variable",
        "model").agg(F.max_by(F.struct("verdict_id", "accepted", clean_value(F.col("value")).alias("value")),
            F.struct("cached_at", "verdict_id")).alias("v"))
    return g.select("id_key", "variable", "model", "v.*")


def consensus(verdicts: DataFrame) -> DataFrame:
    """Per case and variable: all models accept one value, all reject, or they are split."""
    g = latest_verdicts(verdicts).groupBy("id_key", "variable").agg(
        F.count("*").alias("n_models"), F.bool_and(F.coalesce("accepted", F.lit(False))).alias("all_in"),
        F.bool_or(F.coalesce("accepted", F.lit(False))).alias("any_in"),
        F.count_distinct("value").alias("n_values"), F.min("value").alias("value"),
        F.count_if(F.col("value").isNull()).alias("blank"),
    )
    same = F.col("all_in") & (F.col("n_values") == 1) & (F.col("blank") == 0)
    state = F.when(same, "accepted_cross_verified").when(~F.col("any_in"), "abstained_by_consensus").otherwise("split")
    return g.select("id_key", "variable", "n_models", state.alias("state"), F.when(same, F.col("value")).alias("value"))


def apply_cascade(evidence: DataFrame, verdicts: DataFrame, budget: int) -> DataFrame:
    """Escalated cells in id order up to a budget per variable, with the state the verdicts give them."""
    cells = evidence.where("resolution = 'escalated_case'").select("evidence_id", "variable",
        F.col("id_registro").alias("id_key"))
    todo = top_per_group(cells, ["variable"], [F.col("evidence_id")], budget, "evidence_id")
    v = consensus(verdicts)
    done = todo.join(v, ["id_key", "variable"], "left")
    state = F.when(F.col("state").isNull(), "cache_miss").when(F.col("state") == "split",
        "escalated_case").otherwise(F.col("state"))
    return done.select("evidence_id", "variable", state.alias("resolution"), "value")


NOTHING = "nao_mencionado"


def null_verdicts(cells: DataFrame) -> DataFrame:
    """The verifier that decides nothing: every cell rejected for want of a verifier."""
    return cells.select("evidence_id", "variable", F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("value"),
        F.lit("no_verifier").alias("reason"))


def stored_verdicts(cells: DataFrame, verdicts: DataFrame, model: str | None = None) -> DataFrame:
    """The latest stored verdict of each cell (of one model, or of any); a cell without one is a cache miss."""
    v = verdicts if model is None else verdicts.where(F.col("model") == model)
    g = v.groupBy("id_key",
        "variable").agg(F.max_by(F.struct("accepted", clean_value(F.col("value")).alias("value"), "evidence"),
            F.struct("cached_at", "verdict_id")).alias("v"))
    x = cells.join(g, ["id_key", "variable"], "left")
    reason = F.when(F.col("v").isNull(), F.concat(F.lit("cache_miss:"), F.col("variable")))
    return x.select("evidence_id", "id_key", "variable", F.coalesce("v.accepted", F.lit(False)).alias("accepted"), "v.value",
        F.col("v.evidence").alias("quote"), reason.alias("reason"))


def validated(verdicts: DataFrame, texts: DataFrame, ontology: DataFrame) -> DataFrame:
    """Verdicts after the checks that every answer must pass, the first that fails gives the reason.

    verdicts: output of stored_verdicts; texts: (id_key, text), one row a case; ontology: (variable, vals).
    An answer that the text doesn't mention abstains; a value must be one of the variable's, where it has
    any; its quote must stand in the text, whatever the spacing and case.
    """
    c = F.col
    x = verdicts.join(texts, "id_key", "left").join(maybe_broadcast(ontology), "variable", "left")
    flat = lambda s: collapse(F.coalesce(s, F.lit("")))
    quoted = (F.trim(F.coalesce("quote", F.lit(""))) != "") & flat(c("text")).contains(flat(c("quote")))
    reason = (
        F.when(c("reason").isNotNull(), c("reason")).when(~c("accepted"), "rejected").when(F.lower("value") == NOTHING,
            "abstained")
        .when(c("value").isNull(), "no_value").when((F.size("vals") > 0) & ~F.array_contains("vals", c("value")),
            "not_in_ontology").when(~quoted, "quote_not_in_text").otherwise("ok")
    )
    x = x.withColumn("outcome", reason)
    return x.select("evidence_id", "variable", (c("outcome") == "ok").alias("accepted"),
        F.when(c("outcome") == "ok", c("value")).alias("value"), c("outcome").alias("reason"))


def verifier(kind: str, verdicts: DataFrame | None = None, model: str | None = None, texts: DataFrame | None = None,
    ontology: DataFrame | None = None):
    """Verifier by name: a function from cells (evidence_id, id_key, variable) to verdicts.

    none decides nothing, stub looks stored verdicts up, model looks one model's verdicts up and checks
    them (calls aren't made: a cell that isn't stored is a miss), consensus needs all models to agree.
    """
    if kind == "none":
        return null_verdicts
    if kind == "stub":
        return lambda cells: stored_verdicts(cells, verdicts).select("evidence_id", "variable", "accepted", "value", "reason")
    if kind == "model":
        return lambda cells: validated(stored_verdicts(cells, verdicts, model), texts, ontology)
    if kind == "consensus":
        state = consensus(verdicts)
        reason = F.coalesce("state", F.concat(F.lit("cache_miss:"), F.col("variable")))
        return lambda cells: cells.join(state, ["id_key", "variable"], "left").select("evidence_id", "variable",
            (F.coalesce("state", F.lit("")) == "accepted_cross_verified").alias("accepted"), "value", reason.alias("reason"))
    raise ValueError(f"unknown verifier {kind}")


def first_cells(evidence: DataFrame, budget: int | None) -> DataFrame:
    """Escalated cells of a run as a verifier takes them: the first `budget` by id over all variables, or all."""
    cells = evidence.where("resolution = 'escalated_case'").select("evidence_id", F.col("id_registro").alias("id_key"),
        "variable")
    return cells if budget is None else cells.orderBy("evidence_id").limit(budget)
