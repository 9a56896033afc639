"""Queries over contracts, connectors, rule discovery, review, readers' answers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.session import maybe_broadcast
from lauda.functions.stats import interval_column
from lauda.functions.text import normalize, sql_normalize
from lauda.operators import review as V
from lauda.operators import sandbox as B
from lauda.operators.policy import clean_value, drift_alert
from lauda.operators.range_scan import with_last_before
from lauda.operators.topk import top_per_group
from lauda.plans import contract as K
from lauda.plans.policy_queries import ORACLE as POLICY_SQL
from lauda.plans.policy_queries import pilot_summary, policies
from lauda.sources import files as S
from lauda.sources import sinks as W
from lauda.sources.tables import table
from lauda.streaming import live

# A contract of this project's tables, as a user would write it (JSON is YAML too).
CONTRACT = """
{"contract": {"id": "pilot_v1", "version": "1.2.0"},
 "corpus": {"id_column": "pilot_id", "text_column": "laudo", "strata_columns": ["clinica", "conjunto"], "extra_columns": ["recebido_em"]},
 "variables": [
  {"name": "resultado", "criticality": 8, "detector": "resultado", "comparison_column": "l2_resultado", "ontology_values": ["hsil", "lsil"], "canaries": [{"text": "nilm", "expected_value": "NILM"}]},
  {"name": "bethesda", "criticality": 7, "mode": "C", "detector": {"function": "bethesda", "evidence_field": "evidence", "certainty_field": "certainty"}, "comparison_column": "l2_bethesda"},
  {"name": "margem_extra", "criticality": 9, "detector": "margens"}, {"name": "hormonal", "criticality": 5, "detector": "hormonal"}, {"name": "observacao", "criticality": 2, "detector": "observacao"}],
 "output": {"dir": "runs", "format": "parquet"}}
"""


def _variables(spark):
    c = K.load_contract(CONTRACT)
    return spark.createDataFrame([(v.name, v.criticality, list(v.ontology)) for v in c.variables],
        "variable string, criticality int, ontology array<string>")


def contract_bands(spark, d):
    return _variables(spark).select("variable", "criticality", K.band_column(F.col("criticality")).alias("band"))


def contract_check(spark, d):
    p = policies(spark, d).select("variable", "onto_type", "vals")
    return K.cross_check(_variables(spark), p)


def corpus_scan(spark, d):
    """The contract's columns of the corpus, written as CSV and scanned again with their names only."""
    c = K.load_contract(CONTRACT)
    folder = W.shared_folder(spark, "corpus")
    W.write_csv(table(spark, d, "run_pilot"), folder)
    df = S.corpus_csv(spark, folder, c.columns())
    return df.select(F.col("pilot_id").cast("long").alias("pilot_id"),
        F.sha2(F.coalesce("laudo", F.lit("")), 256).alias("sha"), "clinica", "conjunto",
        F.coalesce("l2_resultado", F.lit("")).alias("l2"))


def text_csv_nulls(spark, d):
    """A CSV read as text only: spellings of not available are NULL."""
    folder = W.shared_folder(spark, "cases")
    W.write_csv(table(spark, d, "regression_case").select("case_no", "expected_value", "note"), folder)
    return S.all_text_csv(spark, folder).select(F.col("case_no").cast("long").alias("case_no"), "expected_value",
        F.col("note").isNull().alias("no_note"))


VERDICT = "verdict_id long, id_key string, variable string, model string, accepted boolean, value string, cached_at timestamp"


def lines_last_wins(spark, d):
    """Verdicts appended as JSON lines in two rounds, compacted to the last per case, variable and model."""
    v = table(spark, d, "cross_verdict").select(*[x.split()[0] for x in VERDICT.split(", ")])
    lines, target = W.shared_folder(spark, "lines"), W.shared_folder(spark, "compact")
    W.append_lines(v.where("verdict_id % 2 = 0"), lines)
    W.append_lines(v.where("verdict_id % 2 = 1"), lines)
    r = W.compact(spark, lines, target, VERDICT, ["id_key", "variable", "model"], ["cached_at", "verdict_id"])
    return r.select("id_key", "variable", "model", "verdict_id")


def regression_load(spark, d):
    """The last version of every case as a fail-closed set, counted by kind."""
    c = table(spark, d,
        "regression_case").groupBy("id").agg(F.max_by(F.struct("kind", "text", "expected_value", "expected_status",
                F.coalesce("reference_text", F.lit("")).alias("reference_text"), "source", "note"),
            "case_no").alias("r"))
    folder = W.shared_folder(spark, "cases")
    c.select("id", "r.*").where("trim(text) <> ''").write.json(folder)
    cases, _ = S.regression_set(spark, folder)
    return cases.groupBy("kind").agg(F.count("*").alias("n"))


def manifest_scan(spark, d):
    """Run manifests written as JSON documents below a folder, scanned recursively, unpivoted by variable."""
    folder = W.shared_folder(spark, "manifests")
    W.write_manifests(table(spark, d, "run_variable").dropDuplicates(["run_id", "variable"]), folder)
    return S.manifest_variables(S.manifests(spark, folder)).select("run_id", "variable", "n_total", "n_filled")


def results_by_variable(spark, d):
    """Tall results stored by variable; one variable is read back without touching the others."""
    folder = W.shared_folder(spark, "results")
    W.write_results(table(spark, d, "evidence_record").select("evidence_id", "variable", "value", "resolution"), folder)
    schema = "evidence_id long, value string, resolution string, variable string"  # also where no file was written
    return spark.read.schema(schema).parquet(folder).where("variable = 'bethesda'").select("evidence_id", "value", "resolution")


def exact_ci(spark, d):
    """Discordance of the accepted answers with its exact interval."""
    s = pilot_summary(spark, d).withColumn("ci", interval_column("discordant", "accepted"))
    return s.select("conjunto", "braco", "field", "accepted", "discordant", F.col("ci.low").alias("low"),
        F.col("ci.high").alias("high"))


def reader_answers(spark, d):
    """Second reader's raw answers parsed by schema; malformed ones count as such."""
    v = table(spark, d, "cross_verdict").select("model", "raw",
        F.from_json("raw", "tokens bigint", {"mode": "PERMISSIVE"}).alias("r"))
    return v.groupBy("model").agg(F.count("*").alias("n"), F.count("raw").alias("n_raw"), F.sum("r.tokens").alias("tokens"),
        F.max("r.tokens").alias("most"))


def identifier_lock(spark, d):
    """Texts that may not go to a model: they hold the form of an identity number or an address with @."""
    lock = F.coalesce(F.col("laudo").rlike(r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}\.\d{4}\.\d{4}\.\d{4}|\w@\w"), F.lit(False))
    return table(spark, d, "run_pilot").groupBy("conjunto").agg(F.count("*").alias("n"), F.count_if(lock).alias("locked"))


def _cases(spark, d):
    return table(spark, d, "regression_case").select("case_no", "kind", "variable", "source",
        clean_value(F.col("expected_value")).alias("expected_value"), normalize(F.col("text")).alias("T"),
        normalize(F.col("reference_text")).alias("R"))


RULES = (B.Proposal("mm_any", "tamanho", r"(\d+(?:[.,]\d+)?)\s*mm\b"),
    B.Proposal("mm_guarded", "tamanho", r"(\d+(?:[.,]\d+)?)\s*mm\b", forbidden="pinca|agulha|aparelho"))
BASE = r"medindo (\d+(?:[.,]\d+)?)\s*mm\b"


def _baseline(t):
    return F.when(F.col(t).rlike(BASE), B.to_double(F.regexp_extract(t, BASE, 1)))


def regression_gate(spark, d):
    """Cases of every variable by rule and bucket."""
    x = B.regression_buckets(_cases(spark, d), _baseline("T"), _baseline("R"), list(RULES), "T", "R", ("variable",))
    return x.groupBy("rule_id", "variable", "kind", "bucket").agg(F.count("*").alias("n"))


def rule_impact(spark, d):
    """What each rule would change in each variable: filled before and after, changed cases, share of the leading source.

    A rule that changes nothing has no site_share.
    """
    cells = [F.struct(F.lit(p.rule_id).alias("rule_id"), _baseline("T").alias("a"),
            B.overlay(F.col("T"), _baseline("T"), p).alias("b")) for p in RULES]
    x = _cases(spark, d).select("variable", "source", F.explode(F.array(*cells)).alias("c")).select("variable", "source", "c.*")
    per = x.groupBy("rule_id", "variable", "source").agg(F.count("*").alias("n"), F.count("a").alias("before"),
        F.count("b").alias("after"))
    g = per.groupBy("rule_id", "variable").agg(F.sum("n").alias("n"), F.sum("before").alias("filled_before"),
        F.sum("after").alias("filled_after"), F.max(F.col("after") - F.col("before")).alias("most"),
        F.sum(F.col("after") - F.col("before")).alias("changed"))
    return g.select("rule_id", "variable", "n", "filled_before", "filled_after", "changed",
        F.round(F.try_divide("most", "changed"), 6).alias("site_share"))


def skeleton_families(spark, d):
    """Families of the cases of every variable, by its common unit; without one no word is a unit."""
    units = table(spark, d, "ontology_spec").groupBy("variable").agg(F.min(normalize(F.col("unit"))).alias("unit"))
    c = _cases(spark, d).join(maybe_broadcast(units), "variable", "left")
    return B.families(c, "T", F.when(F.col("unit") != "", F.col("unit")).otherwise("-"), ("variable",))


def hard_negatives(spark, d):
    """Accepted cells whose evidence shares most words with the escalated cells of their variable: 20 each.

    Cells that share none are left out. Words are runs of letters and digits of any length. Matches are joined on the word and summed, so
    the words of a variable never stand in one row; an evidence text counts each word once.
    """
    words = F.array_distinct(F.regexp_extract_all(normalize(F.col("evidence")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    e = table(spark, d, "evidence_record").select("evidence_id", "variable", "resolution", F.explode(words).alias("word"))
    seed = e.where("resolution = 'escalated_case'").select("variable", "word").distinct()
    x = e.where("resolution LIKE 'accepted%'").join(maybe_broadcast(seed), ["variable", "word"]).groupBy("evidence_id",
        "variable").agg(F.count("*").cast("int").alias("overlap"))
    return top_per_group(x, ["variable"], [F.desc("overlap"), F.col("evidence_id")], 20, "evidence_id").select("evidence_id",
        "variable", "overlap")


def cluster_tags(spark, d):
    """Support and grounding of the second reader's values that the first one missed, and whether the ontology knows them."""
    e = table(spark, d, "evidence_record").select("variable", clean_value(F.col("value")).alias("v"),
        clean_value(F.col("ia")).alias("ia"),
        F.lower(F.coalesce("evidence", F.lit(""))).alias("t")).where("v IS NULL AND ia IS NOT NULL")
    g = e.groupBy("variable", "ia").agg(F.count("*").alias("n"),
        F.avg(F.col("t").contains(F.lower("ia")).cast("int")).alias("rate"))
    x = g.join(maybe_broadcast(policies(spark, d).select("variable", "onto_type", "vals", "lo", "hi")), "variable", "left")
    num = F.when(F.col("ia").rlike(r"^\d+(\.\d+)?$"), F.col("ia").try_cast("double"))
    known = F.when(F.col("onto_type") == "enum",
        F.when(F.array_contains("vals", F.col("ia")), "enum_member").otherwise("implausible")).when(F.col("onto_type").isNotNull(),
        F.when(num.between(F.col("lo"), F.col("hi")), "in_range").otherwise("implausible")).otherwise("unverified")
    return x.select("variable", "ia", "n", B.support_tag(F.col("n")).alias("support"),
        B.grounding_tag(F.col("rate")).alias("grounding"), known.alias("plausibility"))


def annotation_state(spark, d):
    """Documents by genre, last level a reader gave and whether one did; documents without genre are a group of their own."""
    docs = table(spark, d, "documents").select("doc_id", "genero")
    s = V.review_state(docs, table(spark, d, "reading_label"), "doc_id", "nivel", ["rotulado_em", "label_id"])
    return s.groupBy("genero", "nivel", "done").agg(F.count("*").alias("n"))


def annotation_progress(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return V.progress(V.review_state(docs, table(spark, d, "reading_label"), "doc_id", "nivel", ["rotulado_em", "label_id"]),
        "doc_id")


def sanitized_rates(spark, d):
    r = V.sanitize(table(spark, d, "run_variable").select("manifest_row_id", "fill_rate", "agreement_surface"))
    return r.agg(F.count("*").alias("n"), F.count("fill_rate").alias("n_fill"), F.count("agreement_surface").alias("n_agree"))


def drift_alerts(spark, d):
    """Alert bands of the change of fill rate from each run of a contract and variable to the next, over the whole history.

    Runs without a rate, contract, variable or start have no change; rows of one start are ordered by id.
    """
    r = table(spark, d, "run_variable").select("contract_id", "variable", F.unix_micros("started_at").alias("t"),
        "manifest_row_id", "fill_rate").where("fill_rate IS NOT NULL AND NOT isnan(fill_rate)").dropna()
    x = with_last_before(r, ["contract_id", "variable"], ["t", "manifest_row_id"], ["fill_rate"])
    x = x.where("prev IS NOT NULL").select("variable", drift_alert(F.col("fill_rate") - F.col("prev.fill_rate")).alias("alert"))
    return x.groupBy("variable", "alert").agg(F.count("*").alias("n"))


def streaming_resolution(spark, d):
    r = live.resolve_stream(spark, f"{d}/evidence_record.parquet", policies(spark, d))
    return r.groupBy("variable", "resolution").agg(F.count("*").alias("n"))


def streaming_windows(spark, d):
    w = live.windowed_counts(spark, f"{d}/events.parquet")
    return w.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


_FUNCS = (contract_bands, contract_check, corpus_scan, text_csv_nulls, lines_last_wins, regression_load, manifest_scan,
    results_by_variable, exact_ci, reader_answers, identifier_lock, regression_gate, rule_impact,
          skeleton_families, hard_negatives, cluster_tags, annotation_state, annotation_progress, sanitized_rates,
          drift_alerts, streaming_resolution, streaming_windows)
QUERIES = {f.__name__: f for f in _FUNCS}

_VARS = "(VALUES " + ", ".join(f"('{v.name}', {v.criticality}, [{', '.join(map(repr, v.ontology))}]::VARCHAR[])" for v in K.load_contract(CONTRACT).variables) + ") v(variable, criticality, ontology)"
_NULL = "CASE WHEN {0} IS NULL OR trim({0}) IN ('', 'NA', 'nan', 'NaN', 'None') THEN NULL ELSE trim({0}) END"
_CASES = f"""c AS MATERIALIZED (SELECT case_no, kind, source, variable, {_NULL.format('expected_value')} AS ev, {sql_normalize('text')} AS T, {sql_normalize('reference_text')} AS R FROM regression_case)"""
_B = lambda t: f"TRY_CAST(replace(NULLIF(regexp_extract({t}, 'medindo (\\d+(?:[.,]\\d+)?)\\s*mm\\b', 1), ''), ',', '.') AS DOUBLE)"
_P = lambda t, f: f"list_max(list_transform(flatten(list_transform({'list_filter(' if f else ''}string_split({t}, '. '){', lambda s: NOT regexp_matches(s, ' + repr(f) + '))' if f else ''}, lambda s: regexp_extract_all(s, '(\\d+(?:[.,]\\d+)?)\\s*mm\\b', 1))), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)))"
_RULED = " UNION ALL ".join(f"SELECT case_no, kind, source, variable, ev, '{p.rule_id}' AS rule_id, {_B('T')} AS a, {_B('R')} AS ar, COALESCE({_B('T')}, {_P('T', p.forbidden)}) AS b, COALESCE({_B('R')}, {_P('R', p.forbidden)}) AS br FROM c" for p in RULES)
_TOK = "list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(T, concat('(\\d)(', u, ')\\b'), '\\1 \\2', 'g'), '[^a-z0-9/]+', ' ', 'g')), ' '), lambda w: CASE WHEN regexp_matches(w, '^\\d+$') THEN 'N' WHEN w = u THEN 'UNIT' " + " ".join(f"WHEN w IN {tuple(words)!r} THEN '{n}'" for words,
    n in B.CLASSES) + f" WHEN w IN {tuple(B.KEPT)!r} THEN w END), lambda w: w IS NOT NULL)"

ORACLE = {
    "contract_bands": f"SELECT variable, criticality, CASE WHEN criticality >= 7 THEN 'CRITICA' WHEN criticality >= 5 THEN 'ALTA' WHEN criticality >= 3 THEN 'MEDIA' ELSE 'BAIXA' END AS band FROM {_VARS}",
    "contract_check": f"""WITH p AS (SELECT variable, min(onto_type) AS onto_type, list_sort(list(DISTINCT canonical) FILTER (canonical IS NOT NULL)) AS vals FROM ontology_spec GROUP BY 1), x AS (SELECT v.*, p.onto_type, p.vals,
      CASE WHEN p.variable IS NULL AND criticality >= 7 THEN 'error' WHEN p.variable IS NULL AND criticality >= 5 THEN 'warning' WHEN onto_type = 'enum' AND len(vals) = 0 THEN 'error' WHEN len(ontology) > 0 AND p.variable IS NOT NULL AND list_sort(ontology) <> vals THEN 'warning' END AS severity,
      CASE WHEN p.variable IS NULL THEN 'no policy' WHEN onto_type = 'enum' AND len(vals) = 0 THEN 'enum without values' ELSE 'ontologies differ' END AS message FROM {_VARS} LEFT JOIN p ON p.variable = v.variable) SELECT variable, severity, message FROM x WHERE severity IS NOT NULL""",
    "corpus_scan": "SELECT pilot_id, sha256(COALESCE(laudo, '')) AS sha, clinica, conjunto, COALESCE(l2_resultado, '') AS l2 FROM run_pilot",
    "text_csv_nulls": f"SELECT case_no, {_NULL.format('expected_value')} AS expected_value, ({_NULL.format('note')}) IS NULL AS no_note FROM regression_case",
    "lines_last_wins": "SELECT id_key, variable, model, arg_max(verdict_id, (cached_at, verdict_id)) AS verdict_id FROM cross_verdict GROUP BY ALL",
    "regression_load": "WITH l AS (SELECT id, arg_max(kind, case_no) AS kind, arg_max(text, case_no) AS text FROM regression_case GROUP BY 1) SELECT kind, COUNT(*) AS n FROM l WHERE trim(text) <> '' GROUP BY 1",
    "manifest_scan": "SELECT run_id, variable, max(n_total) AS n_total, max(n_filled) AS n_filled FROM run_variable GROUP BY ALL",
    "results_by_variable": "SELECT evidence_id, value, resolution FROM evidence_record WHERE variable = 'bethesda'",
    "reader_answers": "SELECT model, COUNT(*) AS n, COUNT(raw) AS n_raw, CAST(SUM(TRY_CAST(json_extract_string(raw, '$.tokens') AS BIGINT)) AS BIGINT) AS tokens, max(TRY_CAST(json_extract_string(raw, '$.tokens') AS BIGINT)) AS most FROM (SELECT model, CASE WHEN json_valid(raw) THEN raw END AS raw FROM cross_verdict) GROUP BY 1",
    "identifier_lock": r"SELECT conjunto, COUNT(*) AS n, COUNT(*) FILTER (COALESCE(regexp_matches(laudo, '\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}\.\d{4}\.\d{4}\.\d{4}|\w@\w'), FALSE)) AS locked FROM run_pilot GROUP BY 1",
    "regression_gate": f"""WITH {_CASES}, r AS ({_RULED}), x AS (SELECT *, CASE WHEN kind = 'metamorphic_invariance' THEN br ELSE TRY_CAST(replace(ev, ',', '.') AS DOUBLE) END AS want FROM r), y AS (SELECT *, CASE WHEN kind = 'metamorphic_invariance' THEN ar ELSE want END AS was FROM x),
      z AS (SELECT *, round(b, 4) IS NOT DISTINCT FROM round(want, 4) AS ok, round(a, 4) IS NOT DISTINCT FROM round(was, 4) AS bf FROM y)
      SELECT rule_id, variable, kind, CASE WHEN ok THEN 'conform' WHEN (kind = 'metamorphic_invariance' AND a IS NULL AND ar IS NULL) OR NOT bf THEN 'pre_existing' ELSE 'regressed' END AS bucket, COUNT(*) AS n FROM z GROUP BY ALL""",
    "rule_impact": f"""WITH {_CASES}, r AS ({_RULED}), p AS (SELECT rule_id, variable, source, COUNT(*) AS n, COUNT(a) AS b0, COUNT(b) AS b1 FROM r GROUP BY ALL)
      SELECT rule_id, variable, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(b0) AS BIGINT) AS filled_before, CAST(SUM(b1) AS BIGINT) AS filled_after, CAST(SUM(b1 - b0) AS BIGINT) AS changed, CASE WHEN SUM(b1 - b0) <> 0 THEN round(max(b1 - b0) / SUM(b1 - b0), 6) END AS site_share FROM p GROUP BY 1, 2""",
    "skeleton_families": f"""WITH {_CASES}, v AS (SELECT variable, min({sql_normalize('unit')}) AS unit FROM ontology_spec GROUP BY 1), cu AS (SELECT c.*, COALESCE(NULLIF(unit, ''), '-') AS u FROM c LEFT JOIN v USING (variable)),
      l AS (SELECT T, variable, {_TOK} AS k, CASE WHEN list_has_any(regexp_extract_all(T, '[a-z]+'), {B.NEGATIVE!r}) AND NOT list_has_any(regexp_extract_all(T, '[a-z]+'), ['polipo', 'polipos']) THEN 'negative' WHEN regexp_matches(T, '\\d+\\s*x\\s*\\d+') THEN 'multidim' ELSE 'positive' END AS lane FROM cu),
      m AS (SELECT *, COALESCE(NULLIF(COALESCE(list_position(list_transform(range(1, len(k)), lambda i: concat(k[i], ' ', k[i + 1])), 'N UNIT'), 0), 0), list_position(k, 'N'), 0) AS i FROM l),
      s AS (SELECT lane, variable, CASE WHEN lane = 'positive' AND i > 0 THEN array_to_string(k[greatest(i - 5, 1):i + 5], ' ') ELSE '' END AS skeleton FROM m)
      SELECT lane, variable, CASE WHEN lane <> 'positive' THEN concat('pf_', lane) WHEN skeleton = '' THEN 'pf_noanchor' ELSE concat('pf_', left(sha256(skeleton), 12)) END AS family_id, skeleton, COUNT(*) AS n FROM s GROUP BY ALL""",
    "hard_negatives": f"""WITH e AS MATERIALIZED (SELECT evidence_id, variable, resolution, unnest(list_distinct(regexp_extract_all({sql_normalize('evidence')}, '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM evidence_record), s AS (SELECT DISTINCT variable, word FROM e WHERE resolution = 'escalated_case'),
      x AS (SELECT evidence_id, variable, CAST(COUNT(*) AS INTEGER) AS overlap FROM e JOIN s USING (variable, word) WHERE resolution LIKE 'accepted%' GROUP BY ALL)
      SELECT evidence_id, variable, overlap FROM x QUALIFY row_number() OVER (PARTITION BY variable ORDER BY overlap DESC, evidence_id) <= 20""",
    "cluster_tags": f"""WITH e AS (SELECT variable, {_NULL.format('value')} AS v, CASE WHEN trim(ia) NOT IN ('', 'NA', 'nan', 'NaN', 'None') THEN ia END AS ia, lower(COALESCE(evidence, '')) AS t FROM evidence_record), g AS (SELECT variable, ia, COUNT(*) AS n, COUNT(*) FILTER (contains(t, lower(ia))) / COUNT(*) AS rate FROM e WHERE v IS NULL AND ia IS NOT NULL GROUP BY ALL),
      p AS (SELECT variable, min(onto_type) AS ot, list(DISTINCT canonical) AS vals, min(range_min) AS lo, max(range_max) AS hi FROM ontology_spec GROUP BY 1)
      SELECT variable, ia, n, CASE WHEN n < 10 THEN 'low_support' ELSE 'supported' END AS support, CASE WHEN rate >= 0.7 THEN 'grounded' WHEN rate >= 0.3 THEN 'partly_grounded' ELSE 'ungrounded' END AS grounding,
      CASE WHEN ot = 'enum' THEN CASE WHEN list_contains(vals, ia) THEN 'enum_member' ELSE 'implausible' END WHEN ot IS NOT NULL THEN CASE WHEN TRY_CAST(ia AS DOUBLE) BETWEEN lo AND hi THEN 'in_range' ELSE 'implausible' END ELSE 'unverified' END AS plausibility FROM g LEFT JOIN p USING (variable)""",
    "annotation_state": "WITH a AS (SELECT doc_id, nivel FROM reading_label QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rotulado_em DESC NULLS LAST, label_id DESC) = 1) SELECT genero, nivel, nivel IS NOT NULL AS done, COUNT(*) AS n FROM documents LEFT JOIN a USING (doc_id) GROUP BY ALL",
    "annotation_progress": "WITH a AS (SELECT doc_id, nivel FROM reading_label QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rotulado_em DESC NULLS LAST, label_id DESC) = 1) SELECT COUNT(*) AS total, COUNT(nivel) AS done, min(doc_id) FILTER (nivel IS NULL) AS first_pending FROM documents LEFT JOIN a USING (doc_id)",
    "sanitized_rates": "SELECT COUNT(*) AS n, COUNT(*) FILTER (fill_rate IS NOT NULL AND isfinite(fill_rate)) AS n_fill, COUNT(*) FILTER (agreement_surface IS NOT NULL AND isfinite(agreement_surface)) AS n_agree FROM run_variable",
    "drift_alerts": """WITH r AS (SELECT variable, fill_rate - lag(fill_rate) OVER (PARTITION BY contract_id, variable ORDER BY started_at, manifest_row_id) AS delta FROM run_variable
      WHERE fill_rate IS NOT NULL AND NOT isnan(fill_rate) AND contract_id IS NOT NULL AND variable IS NOT NULL AND started_at IS NOT NULL)
      SELECT variable, CASE WHEN -delta >= 0.15 - 1e-12 THEN 'RED' WHEN -delta >= 0.03 - 1e-12 THEN 'YELLOW' ELSE 'GREEN' END AS alert, COUNT(*) AS n FROM r WHERE delta IS NOT NULL GROUP BY ALL""",
    "streaming_resolution": POLICY_SQL["policy_histogram"],
    "streaming_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, COUNT(*) AS n FROM events GROUP BY ALL",
}
