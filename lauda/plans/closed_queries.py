"""Queries over the detector driver, verifiers, gate files, rule cards and further detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lauda.functions import derived as V
from lauda.functions import detectors as D
from lauda.functions.sectioned import DETECTORS
from lauda.functions.text import anchored_percent, grounding_pattern, normalize, sql_normalize, supported
from lauda.operators import cascade as C
from lauda.operators import driver as R
from lauda.operators import gates as G
from lauda.operators import observe as O
from lauda.operators import sandbox as B
from lauda.operators.policy import clean_value
from lauda.plans import contract as K
from lauda.plans import loop_queries as L
from lauda.plans import system_queries as Y
from lauda.plans.policy_queries import ORACLE as POLICY_SQL
from lauda.plans.policy_queries import confusion, pilot_summary
from lauda.plans.text_queries import SQL_REPORTS, _SPANS
from lauda.session import maybe_broadcast, spread
from lauda.sources import sinks as W
from lauda.sources.tables import table

CANARIES = """
{"contract": {"id": "canaries", "version": "1"}, "corpus": {"id_column": "pilot_id", "text_column": "laudo", "strata_columns": ["clinica", "conjunto"]},
 "variables": [
  {"name": "resultado", "detector": "resultado", "canaries": [{"text": "NILM", "expected_value": "NILM"}, {"text": "Lesão de alto grau", "expected_value": "HSIL"}, {"text": "nada a notar"}, {"text": "lsil", "expected_value": "HSIL"}]},
  {"name": "ki67", "detector": "ki67_pct", "canaries": [{"text": "Ki-67: positivo em 20%", "expected_value": "20.0"}, {"text": "ki-67 positivo em 10 a 21%", "expected_value": 15}]},
  {"name": "margens", "detector": "margens"},
  {"name": "medida", "detector": "lauda.operators.driver.first_measure", "canaries": [{"text": ""}, {"text": "lesão de 5 mm", "expected_value": "5"}]},
  {"name": "ausente", "detector": "lauda.operators.driver.no_such_rule", "canaries": [{"text": "x", "expected_value": "x"}]}]}
"""


def canary_run(spark, d):
    """Every canary of a contract: what its detector gave, and whether that is what was expected."""
    return R.run_canaries(spark, K.load_contract(CANARIES))


def detector_rows(spark, d):
    """Result rows of three variables of a contract over all reports, strata carried."""
    r = R.run_contract(spread(table(spark, d, "run_pilot").select("pilot_id", "laudo", "clinica", "conjunto")),
        K.load_contract(CANARIES), ["resultado", "ki67", "margens"])
    return r.select("pilot_id", "clinica", "conjunto", "variable", "value", "status")


def detector_errors(spark, d):
    """A user function over all reports: states of its rows; a text that it fails on is a row of its own."""
    c = K.load_contract(CANARIES)
    done = table(spark, d, "run_pilot").where("pilot_id % 10 = 0")  # an earlier run got so far
    late = R.run_variable(table(spark, d, "run_pilot"), c.variable("medida"), "pilot_id", "laudo", done=done)
    early = R.run_variable(done, c.variable("medida"), "pilot_id", "laudo")
    return early.unionByName(late).groupBy("status").agg(F.count("*").alias("n"), F.count("value").alias("n_values"),
        F.count_distinct("value").alias("n_distinct"))


def _texts(spark, d):
    return table(spark, d, "run_pilot").groupBy(F.col("caso").alias("id_key")).agg(F.max_by("laudo", "pilot_id").alias("text"))


def _allowed(spark, d):
    return table(spark, d,
        "ontology_spec").where("onto_type = 'enum'").groupBy("variable").agg(F.collect_set("canonical").alias("vals"))


def verifier_outcomes(spark, d):
    """Stored answers of one model to the first 2,000 escalated cells of the run, after the checks on every answer."""
    verify = C.verifier("model", table(spark, d, "cross_verdict"), "verif-a", _texts(spark, d), _allowed(spark, d))
    return verify(C.first_cells(table(spark, d, "evidence_record"), 2000)).groupBy("variable",
        F.regexp_replace("reason", ":.*", "").alias("reason"), "accepted").agg(F.count("*").alias("n"))


def verifier_kinds(spark, d):
    """Accepted and missing cells of all escalated ones, by verifier."""
    cells, v = C.first_cells(table(spark, d, "evidence_record"), None), table(spark, d, "cross_verdict")
    parts = [C.verifier(k, v)(cells).select(F.lit(k).alias("verifier"), "accepted", "reason") for k in ("none", "stub",
            "consensus")]
    x = reduce(lambda a, b: a.unionByName(b), parts)
    return x.groupBy("verifier").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"),
        F.count_if(F.col("reason").startswith("cache_miss")).alias("missing"))


def gate_files(spark, d):
    """Items of both gates, written as JSON lines and read back."""
    items = G.gate1_items(Y.contract_check(spark, d)).unionByName(G.gate2_items(table(spark, d, "evidence_record")))
    folder = W.shared_folder(spark, "gates")
    G.write_gates(items, folder)
    x = G.read_gates(spark, folder)
    return x.select("item_id", "gate", "variable", "kind", "key", "n", "blocking",
        F.size(F.coalesce("examples", F.array().cast("array<string>"))).alias("n_examples"))


def gate_top(spark, d):
    """The ten most frequent items of the second gate."""
    return G.gate_summary(G.gate2_items(table(spark, d, "evidence_record")))


def pair_keys(spark, d):
    """Every disagreement pair as the key of its item, and read back from it."""
    p = G.disagreements(table(spark, d, "evidence_record")).select("l1", "l2").distinct().withColumn("key",
        G.pair_key(F.col("l1"), F.col("l2")))
    return p.withColumn("p", G.parse_pair(F.col("key"))).select("key", F.col("p.l1").alias("l1"), F.col("p.l2").alias("l2"),
        ((F.col("p.l1") == F.col("l1")) & (F.col("p.l2") == F.col("l2"))).alias("whole"))


def _misses(spark, d):
    """Cells that only the second reader filled, with their evidence and the common unit of their variable."""
    e = table(spark, d, "evidence_record").select("evidence_id", "variable", "clinica",
        clean_value(F.col("value")).alias("v"), clean_value(F.col("ia")).alias("ia"), normalize(F.col("evidence")).alias("T"))
    unit = table(spark, d, "ontology_spec").groupBy("variable").agg(F.min(normalize(F.col("unit"))).alias("unit"))
    return e.where("v IS NULL AND ia IS NOT NULL").join(maybe_broadcast(unit), "variable", "left").withColumn("unit",
        F.when(F.col("unit") != "", F.col("unit")).otherwise("-"))


def family_cards(spark, d):
    return B.family_cards(_misses(spark, d), "T", F.col("unit"), "ia", "evidence_id")


def cluster_cards(spark, d):
    return B.cluster_cards(_misses(spark, d), "ia", "clinica", "evidence_id")


def grounded_misses(spark, d):
    """Share of the missed cells of each variable whose value stands beside its unit in the evidence."""
    m = _misses(spark, d)
    g = F.regexp_like("T", grounding_pattern(F.col("ia"), F.when(F.col("unit") != "-", F.col("unit"))))
    return m.groupBy("variable").agg(F.count("*").alias("n"), F.count(g).alias("n_known"), F.count_if(g).alias("n_grounded"))


def rule_evaluation(spark, d):
    """Barriers of each rule in each variable over the whole regression set: facts, first failed barrier, status."""
    facts = B.barrier_facts(Y._cases(spark, d), Y._baseline("T"), Y._baseline("R"), list(Y.RULES), "T", "R", ("variable",))
    return B.evaluated(facts, ("variable",)).drop("family_coverage", "high_risk")


def audit_files(spark, d):
    """An audit sample written as JSON lines with its manifest, and both read back: what was drawn of how many."""
    e = table(spark, d,
        "evidence_record").where("resolution LIKE 'abstained%' OR resolution = 'accepted_exact'").select("evidence_id",
        "variable", F.coalesce("clinica", F.lit("__missing__")).alias("clinica"), "resolution")
    folder = W.shared_folder(spark, "audit")
    W.write_audit(e, ["resolution", "clinica"], "evidence_id", 3, folder)
    sample, manifest = W.read_audit(spark, folder)
    n = sample.groupBy("resolution", "clinica").agg(F.count("*").alias("drawn"), F.min("evidence_id").alias("first"))
    return n.join(manifest.select(F.explode("strata").alias("s")).select("s.*"),
        ["resolution", "clinica"]).select("resolution", "clinica", "drawn", "first", "available")


# Sections that these variables are expected in.
EXPECTED = {"bethesda": ["conclusao"], "resultado": ["conclusao"], "margens": ["conclusao", "microscopia"]}


def discovery_report(spark, d):
    """Misses, leading missed value, values outside their sections and silence of every variable."""
    e = table(spark, d, "evidence_record").select("variable", clean_value(F.col("value")).alias("value"),
        clean_value(F.col("ia")).alias("ia"), "section", "resolution")
    return O.discovery(e, EXPECTED)


def endoscopy_findings(spark, d):
    """Preparation score, esophagitis grade and hiatal hernia of every report, read section by section."""
    r = spread(table(spark, d, "run_pilot").select("pilot_id", "laudo"))
    parts = [R.run_variable(r, K.Variable(k.removesuffix("_por_secao"), k), "pilot_id", "laudo") for k in DETECTORS]
    return reduce(lambda a, b: a.unionByName(b), parts).select("pilot_id", "variable", "value", "status", "section",
        "span_start", "span_end")


def tumour_sizes(spark, d):
    return table(spark, d, "run_pilot").select("pilot_id", F.round(V.tumour_size(normalize(F.col("laudo"))), 6).alias("mm"))


def polyp_words(spark, d):
    return table(spark, d, "run_pilot").select("pilot_id", V.polyp_size_words(normalize(F.col("laudo"))).alias("size"))


def breast_flags(spark, d):
    return table(spark, d, "run_pilot").select("pilot_id",
        V.receptor_flags(normalize(F.col("laudo"))).alias("f")).select("pilot_id", "f.*")


def invasion_records(spark, d):
    """Both kinds of invasion as records; a report without text mentions neither."""
    cells = F.array(*[F.struct(F.lit(x.name).alias("variable"),
                V.invasion_record(F.col("T"), x).alias("r")) for x in (D.INV_LINFOV, D.INV_PERIN)])
    r = table(spark, d, "run_pilot").select("pilot_id", normalize(F.col("laudo")).alias("T")).select("pilot_id",
        F.explode(cells).alias("c"))
    return r.select("pilot_id", "c.variable", "c.r.value", "c.r.status", "c.r.certainty",
        F.col("c.r.evidence").isNotNull().alias("has_evidence"))


def nottingham_guarded(spark, d):
    """Components of the grade, which an in-situ tumour doesn't have."""
    t = F.col("T")
    r = table(spark, d, "run_pilot").select("pilot_id", normalize(F.col("laudo")).alias("T")).withColumn("behavior",
        V.behavior_class(D.TIPO_HIST.column(t)["value"]))
    return r.select("pilot_id", "behavior", *[V.outside_in_situ(F.col("behavior"), x.column(t)).alias(x.name) for x in D.SCORES])


def evidence_support(spark, d):
    """Evidence of every cell that stands, whole or by its beginning, in the report of its case."""
    e = table(spark, d, "evidence_record").select("variable", F.col("id_registro").alias("id_key"),
        "evidence").join(_texts(spark, d), "id_key", "left")
    return e.groupBy("variable").agg(F.count("*").alias("n"),
        F.count_if(supported(F.col("evidence"), F.col("text"))).alias("n_supported"))


def marker_anchor(spark, d):
    """Second reader's proliferation percentages that the report itself gives."""
    p = table(spark, d, "run_pilot").select("conjunto", "laudo",
        F.when(F.col("l2_ki67").rlike(r"^\d{1,3}$"), F.col("l2_ki67").try_cast("double")).alias("v")).where("v IS NOT NULL")
    return p.groupBy("conjunto").agg(F.count("*").alias("n"),
        F.count_if(anchored_percent(F.col("laudo"), F.col("v"))).alias("n_anchored"))


def recount(spark, d):
    """Accepted and discordant answers of the pilot counted twice, by arm and pair by pair, compared per field and metric."""
    first = pilot_summary(spark, d).groupBy("field").agg(F.sum("accepted").alias("accepted"),
        F.sum("discordant").alias("discordant"))
    again = confusion(spark, d).groupBy("field").agg(F.sum("n").alias("accepted"),
        F.sum(F.when(F.col("value") != F.col("ref"), F.col("n")).otherwise(0)).alias("discordant"))
    long = lambda x: x.select("field",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                F.coalesce(F.col(m), F.lit(0)).cast("long").alias("v")) for m in ("accepted", "discordant")])).alias("c")).select("field",
        "c.*")
    j = long(first).alias("a").join(long(again).withColumnRenamed("v", "w").alias("b"), ["field", "metric"], "full")
    return j.select("field", "metric", "v", (F.coalesce("v", F.lit(0)) == F.coalesce("w", F.lit(0))).alias("equal"))


_FUNCS = (canary_run, detector_rows, detector_errors, verifier_outcomes, verifier_kinds, gate_files, gate_top, pair_keys,
    family_cards, cluster_cards, grounded_misses, rule_evaluation, audit_files,
          discovery_report, endoscopy_findings, tumour_sizes, polyp_words, breast_flags, invasion_records, nottingham_guarded,
          evidence_support, marker_anchor, recount)
QUERIES = {f.__name__: f for f in _FUNCS}

_CL, _DIS = L._CL, L._DIS
_T = lambda x: "(" + sql_normalize(x) + ")"
_CANARY = [("resultado", 0, "NILM", "NILM"), ("resultado", 1, "Lesão de alto grau", "HSIL"),
    ("resultado", 2, "nada a notar", None), ("resultado", 3, "lsil", "HSIL"), ("ki67", 0, "Ki-67: positivo em 20%", "20.0"),
    ("ki67", 1, "ki-67 positivo em 10 a 21%", "15")]
_LIT = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x + "'"
_CANARY_ROWS = " UNION ALL ".join(
    [f"SELECT '{v}' AS variable, {i} AS canary, {_LIT(e)} AS expected, CAST({D.RESULTADO.sql('T')[0] if v == 'resultado' else D.KI67.sql('T')} AS VARCHAR) AS got FROM (SELECT {sql_normalize(_LIT(t))} AS T)" for v,
        i, t, e in _CANARY]
)
_LATEST_TEXT = "tx AS (SELECT caso AS id_key, arg_max(laudo, pilot_id) FILTER (laudo IS NOT NULL) AS lt, max(pilot_id) AS m FROM run_pilot GROUP BY 1), texts AS (SELECT p.caso AS id_key, p.laudo AS text FROM run_pilot p JOIN tx ON tx.id_key = p.caso AND tx.m = p.pilot_id)"
_FLAT = lambda x: f"lower(trim(regexp_replace(COALESCE({x}, ''), '\\s+', ' ', 'g')))"
_ESC = "cells AS (SELECT evidence_id, id_registro AS id_key, variable FROM evidence_record WHERE resolution = 'escalated_case')"
_STORED = lambda where: f"sv AS (SELECT id_key, variable, COALESCE(accepted, FALSE) AS accepted, {_CL.format('value')} AS value, evidence FROM cross_verdict {where} QUALIFY row_number() OVER (PARTITION BY id_key, variable ORDER BY cached_at DESC NULLS LAST, verdict_id DESC) = 1)"
_QUOTE = "CASE WHEN {0} IS NULL THEN 'None' ELSE concat('''', replace({0}, '''', '\\'''), '''') END"
_KEY = f"concat('L1=', {_QUOTE.format('l1')}, ' vs IA=', {_QUOTE.format('l2')})"
_ITEMS = f"""{_DIS}, esc AS (SELECT variable, COALESCE(status, 'None') AS status, COUNT(*) AS n FROM evidence_record WHERE resolution = 'escalated_case' GROUP BY ALL),
  prs AS (SELECT * FROM (SELECT variable, l1, l2, COUNT(*) AS n FROM dis GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY variable ORDER BY n DESC, l1, l2) <= 10),
  g1 AS ({Y.ORACLE['contract_check']}),
  items AS (SELECT 1 AS gate, variable, severity AS kind, message AS key, CAST(1 AS BIGINT) AS n, severity = 'error' AS blocking, 0 AS n_examples FROM g1
    UNION ALL SELECT 2, variable, 'escalated', status, n, FALSE, CAST(least(n, 3) AS INTEGER) FROM esc UNION ALL SELECT 2, variable, 'disagreement', {_KEY}, n, FALSE, CAST(least(n, 3) AS INTEGER) FROM prs)"""
_MISS = f"""v0 AS (SELECT variable, min({sql_normalize('unit')}) AS unit FROM ontology_spec GROUP BY 1), m0 AS MATERIALIZED (SELECT evidence_id, variable, clinica, {_CL.format('value')} AS v, {_CL.format('ia')} AS ia, {sql_normalize('evidence')} AS T FROM evidence_record),
  miss AS (SELECT m0.*, COALESCE(NULLIF(unit, ''), '-') AS u FROM m0 LEFT JOIN v0 USING (variable) WHERE v IS NULL AND ia IS NOT NULL)"""
_PART = "CAST(concat('0x', left(sha256(CAST(evidence_id AS VARCHAR)), 8)) AS BIGINT) % 1000 < 700"
_TIME = "list_max(list_transform(regexp_extract_all({0}, '\\d+(?:[,.]\\d+)?'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE))) * CASE WHEN regexp_matches({0}, 'mm|milimetro') THEN 1.0 ELSE 10.0 END"
_MMS = lambda pat: f"list_max(list_transform(regexp_extract_all(T, '{pat}', 1), lambda h: {_TIME.format('h')}))"
_AGAIN = r"=\s*" + D.TUMOUR_MEASURE
_R = f"r AS MATERIALIZED {SQL_REPORTS}"
_SCORES = ", ".join(f"CASE WHEN COALESCE(behavior = 'in_situ', FALSE) THEN NULL ELSE {x.sql('T')} END AS {x.name}" for x in D.SCORES)
_IN = lambda xs: "(" + ", ".join(map(repr, xs)) + ")"
_BEH = f"CASE WHEN tipo IN {_IN(D.INVASIVE)} THEN 'invasivo' WHEN tipo IN {_IN(D.IN_SITU)} THEN 'in_situ' WHEN tipo IN {_IN(D.BENIGN)} THEN 'benigno' END"
_RE_EVIDENCE = "CASE " + " ".join(f"WHEN regexp_matches(T, '{r.pattern}') THEN left(regexp_extract(T, '{r.pattern}', 0), 80)" for r in D.RE.rules) + " END"
_WORD_CASE = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{label}'" for p,
    label in D.SIZE_WORDS) + f" WHEN regexp_matches(w, '{D.SIZE_BOUND}') THEN CASE WHEN b <= 5 THEN 'qualitative_diminuto' WHEN b <= 10 THEN 'qualitative_subcm' ELSE 'qualitative_large' END END"

ORACLE = {
    "canary_run": f"""WITH g AS ({_CANARY_ROWS} UNION ALL SELECT 'medida', 1, '5', '5'), f AS (SELECT *, CASE WHEN variable = 'medida' THEN NULL WHEN got IS NULL THEN 'no_match' ELSE 'detected' END AS status, got IS NOT DISTINCT FROM expected AS passed,
      COALESCE(printf('%.4f', TRY_CAST(got AS DOUBLE)), lower(got)) IS NOT DISTINCT FROM COALESCE(printf('%.4f', TRY_CAST(expected AS DOUBLE)), lower(expected)) AS passed_as_number FROM g)
      SELECT * FROM f UNION ALL SELECT 'medida', 0, NULL, NULL, 'ERROR:ValueError', FALSE, FALSE UNION ALL SELECT 'ausente', 0, 'x', NULL, 'ERROR:AttributeError', FALSE, FALSE""",
    "detector_rows": f"WITH r AS MATERIALIZED (SELECT pilot_id, clinica, conjunto, {sql_normalize('laudo')} AS T FROM run_pilot), v AS (" + " UNION ALL ".join(f"SELECT pilot_id, clinica, conjunto, '{n}' AS variable, CAST({q} AS VARCHAR) AS value FROM r" for n,
        q in (("resultado", D.RESULTADO.sql("T")[0]), ("ki67", D.KI67.sql("T")),
            ("margens",
                D.MARGENS.sql("T")[0]))) + ") SELECT *, CASE WHEN value IS NULL THEN 'no_match' ELSE 'detected' END AS status FROM v",
    "detector_errors": r"""WITH x AS (SELECT CASE WHEN NOT regexp_matches(COALESCE(laudo, ''), '\S') THEN 'ERROR:ValueError' END AS status, replace(NULLIF(regexp_extract(laudo, '(\d+(?:[.,]\d+)?)\s*mm\b', 1), ''), ',', '.') AS v FROM run_pilot)
      SELECT status, COUNT(*) AS n, COUNT(v) AS n_values, COUNT(DISTINCT v) AS n_distinct FROM x GROUP BY 1""",
    "verifier_outcomes": f"""WITH {_LATEST_TEXT}, {_STORED("WHERE model = 'verif-a'")}, {_ESC}, f AS (SELECT * FROM cells ORDER BY evidence_id LIMIT 2000), o AS (SELECT variable, list(DISTINCT canonical) AS vals FROM ontology_spec WHERE onto_type = 'enum' AND canonical IS NOT NULL GROUP BY 1),
      x AS (SELECT f.variable, CASE WHEN sv.id_key IS NULL THEN 'cache_miss' WHEN NOT sv.accepted THEN 'rejected' WHEN lower(value) = 'nao_mencionado' THEN 'abstained' WHEN value IS NULL THEN 'no_value' WHEN len(vals) > 0 AND NOT list_contains(vals, value) THEN 'not_in_ontology'
        WHEN NOT (trim(COALESCE(evidence, '')) <> '' AND contains({_FLAT('text')}, {_FLAT('evidence')})) THEN 'quote_not_in_text' ELSE 'ok' END AS reason FROM f LEFT JOIN sv ON sv.id_key = f.id_key AND sv.variable = f.variable LEFT JOIN texts t ON t.id_key = f.id_key LEFT JOIN o ON o.variable = f.variable)
      SELECT variable, reason, reason = 'ok' AS accepted, COUNT(*) AS n FROM x GROUP BY ALL""",
    "verifier_kinds": f"""WITH {L._CONS}, {_STORED('')}, {_ESC}, s AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (sv.accepted) AS accepted, COUNT(*) FILTER (sv.id_key IS NULL) AS missing FROM cells LEFT JOIN sv USING (id_key, variable)),
      k AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (state = 'accepted_cross_verified') AS accepted, COUNT(*) FILTER (state IS NULL) AS missing FROM cells LEFT JOIN cons USING (id_key, variable))
      SELECT 'none' AS verifier, COUNT(*) AS n, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS missing FROM cells UNION ALL SELECT 'stub', * FROM s UNION ALL SELECT 'consensus', * FROM k""",
    "gate_files": f"WITH {_ITEMS} SELECT left(sha256(concat_ws('|', CAST(gate AS VARCHAR), variable, kind, key)), 12) AS item_id, gate, variable, kind, key, n, blocking, n_examples FROM items",
    "gate_top": f"WITH {_ITEMS} SELECT variable, kind, key, n FROM items WHERE gate = 2 ORDER BY n DESC, variable, kind, key LIMIT 10",
    "pair_keys": f"WITH {_DIS}, p AS (SELECT DISTINCT l1, l2 FROM dis) SELECT {_KEY} AS key, l1, l2, TRUE AS whole FROM p",
    "family_cards": f"""WITH {_MISS}, l AS (SELECT evidence_id, variable, ia, {Y._TOK} AS k, CASE WHEN list_has_any(regexp_extract_all(T, '[a-z]+'), {B.NEGATIVE!r}) AND NOT list_has_any(regexp_extract_all(T, '[a-z]+'), ['polipo', 'polipos']) THEN 'negative' WHEN regexp_matches(T, '\\d+\\s*x\\s*\\d+') THEN 'multidim' ELSE 'positive' END AS lane FROM miss),
      m AS (SELECT *, COALESCE(NULLIF(COALESCE(list_position(list_transform(range(1, len(k)), lambda i: concat(k[i], ' ', k[i + 1])), 'N UNIT'), 0), 0), list_position(k, 'N'), 0) AS i FROM l),
      s AS (SELECT variable, ia, lane, evidence_id, CASE WHEN lane = 'positive' AND i > 0 THEN array_to_string(k[greatest(i - 5, 1):i + 5], ' ') ELSE '' END AS skeleton FROM m),
      c AS (SELECT variable, ia, lane, skeleton, CASE WHEN lane <> 'positive' THEN concat('pf_', lane) WHEN skeleton = '' THEN 'pf_noanchor' ELSE concat('pf_', left(sha256(skeleton), 12)) END AS family_id, COUNT(*) AS n, COUNT(*) FILTER ({_PART}) AS nd FROM s GROUP BY ALL),
      t AS (SELECT variable, ia, SUM(n) AS total, COUNT(*) AS fams FROM c GROUP BY ALL)
      SELECT variable, family_id, lane, skeleton, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(nd) AS BIGINT) AS n_discovery, CAST(SUM(n) - SUM(nd) AS BIGINT) AS n_evaluation, COUNT(*) AS n_clusters, max(fams) AS n_families, round(SUM(n) / SUM(total), 6) AS coverage,
      lane = 'positive' AND family_id <> 'pf_noanchor' AND SUM(n) >= 10 AS usable FROM c JOIN t USING (variable, ia) GROUP BY variable, family_id, lane, skeleton""",
    "cluster_cards": f"""WITH {_MISS}, x AS (SELECT variable, ia AS cluster, COALESCE(clinica, '__missing__') AS site, COUNT(*) AS m, COUNT(*) FILTER ({_PART}) AS d FROM miss GROUP BY ALL)
      SELECT variable, cluster, CAST(SUM(m) AS BIGINT) AS n, CAST(SUM(d) AS BIGINT) AS n_discovery, CAST(SUM(m) - SUM(d) AS BIGINT) AS n_evaluation, COUNT(*) AS n_sites, round(max(m) / SUM(m), 6) AS site_share, SUM(m) >= 10 AS usable FROM x GROUP BY ALL""",
    "grounded_misses": f"""WITH {_MISS}, p AS (SELECT variable, T, CASE WHEN u <> '-' AND regexp_matches(ia, '^\\s*[+-]?\\d+(\\.\\d*)?\\s*$') THEN concat('(?i)\\b', CASE WHEN TRY_CAST(ia AS DOUBLE) = floor(TRY_CAST(ia AS DOUBLE)) THEN CAST(CAST(TRY_CAST(ia AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE regexp_escape(regexp_replace(regexp_replace(trim(ia), '0+$', ''), '\\.$', '')) END, '\\s*(?:[.,]\\s*\\d+)?\\s*', regexp_escape(u), '\\b') END AS pat FROM miss)
      SELECT variable, COUNT(*) AS n, COUNT(pat) AS n_known, COUNT(*) FILTER (pat IS NOT NULL AND regexp_matches(T, pat)) AS n_grounded FROM p GROUP BY 1""",
    "rule_evaluation": f"""WITH {Y._CASES}, r AS ({Y._RULED}), y AS (SELECT *, TRY_CAST(replace(ev, ',', '.') AS DOUBLE) AS ex, CASE WHEN kind = 'metamorphic_invariance' THEN br ELSE TRY_CAST(replace(ev, ',', '.') AS DOUBLE) END AS want, CASE WHEN kind = 'metamorphic_invariance' THEN ar ELSE TRY_CAST(replace(ev, ',', '.') AS DOUBLE) END AS was FROM r),
      z AS (SELECT *, b IS DISTINCT FROM a AS moved, round(b, 4) IS NOT DISTINCT FROM round(ex, 4) AS hit, round(b, 4) IS NOT DISTINCT FROM round(want, 4) AS ok, round(a, 4) IS NOT DISTINCT FROM round(was, 4) AS bf FROM y),
      s AS (SELECT rule_id, variable, source, COUNT(*) AS n, COUNT(*) FILTER (moved) AS moved, COUNT(*) FILTER (a IS NULL AND ex IS NOT NULL) AS target, COUNT(*) FILTER (a IS NULL AND ex IS NOT NULL AND hit) AS hits, COUNT(*) FILTER (kind = 'synthetic_canary' AND NOT hit AND round(a, 4) IS NOT DISTINCT FROM round(ex, 4)) AS lost,
        COUNT(*) FILTER (ex IS NULL AND moved) AS near, COUNT(*) FILTER (NOT ok AND bf AND NOT (kind = 'metamorphic_invariance' AND a IS NULL AND ar IS NULL)) AS reg FROM z GROUP BY ALL),
      f AS (SELECT rule_id, variable, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(lost) AS BIGINT) AS canaries_failed, CAST(SUM(target) AS BIGINT) AS target, CASE WHEN SUM(target) > 0 THEN round(SUM(hits) / SUM(target), 6) END AS target_rate, CAST(SUM(near) AS BIGINT) AS near_miss_changed, CAST(SUM(reg) AS BIGINT) AS regressed,
        CAST(SUM(moved) AS BIGINT) AS changed, CASE WHEN SUM(moved) > 0 THEN round(max(moved) / SUM(moved), 6) END AS site_share FROM s GROUP BY ALL),
      g AS (SELECT *, CASE WHEN canaries_failed <> 0 THEN 'B1_canaries' WHEN NOT COALESCE(target_rate >= 0.8, FALSE) THEN 'B2_target' WHEN near_miss_changed <> 0 THEN 'B3_near_miss' WHEN regressed <> 0 THEN 'B4_regression' END AS failed FROM f)
      SELECT *, CASE WHEN failed IS NULL THEN 'approved_for_review' WHEN failed = 'B2_target' AND target_rate >= 0.6 THEN 'refine' ELSE 'rejected' END AS status, COALESCE(site_share > 0.8, FALSE) AS skewed FROM g""",
    "audit_files": f"""WITH e AS (SELECT evidence_id, COALESCE(clinica, '__missing__') AS clinica, resolution FROM evidence_record WHERE resolution LIKE 'abstained%' OR resolution = 'accepted_exact'), n AS (SELECT resolution, clinica, COUNT(*) AS available FROM e GROUP BY ALL),
      p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY resolution, clinica ORDER BY {L._H(42, 'evidence_id')}, evidence_id) <= 3) SELECT resolution, clinica, COUNT(*) AS drawn, min(evidence_id) AS first, max(available) AS available FROM p JOIN n USING (resolution, clinica) GROUP BY ALL""",
    "discovery_report": f"""WITH x AS (SELECT variable, {_CL.format('value')} AS v, {_CL.format('ia')} AS ia, section, resolution FROM evidence_record), y AS (SELECT variable, v IS NULL AND ia IS NOT NULL AS miss, CASE WHEN v IS NULL AND ia IS NOT NULL THEN ia END AS cluster, COALESCE(v IS NOT NULL AND section IS NOT NULL AND (CASE variable {' '.join(f"WHEN '{k}' THEN section NOT IN {_IN(x) if len(x) > 1 else "('" + x[0] + "')"}" for k, x in EXPECTED.items())} ELSE FALSE END), FALSE) AS leak, COALESCE(resolution LIKE 'abstained%', FALSE) AS silent FROM x),
      c AS (SELECT variable, cluster, COUNT(*) AS n FROM y WHERE miss GROUP BY ALL), t AS (SELECT variable, cluster AS top_value, n AS n_top FROM c QUALIFY row_number() OVER (PARTITION BY variable ORDER BY n DESC, cluster) = 1), k AS (SELECT variable, COUNT(*) AS n_clusters FROM c GROUP BY 1),
      g AS (SELECT variable, COUNT(*) AS n, COUNT(*) FILTER (miss) AS n_misses, COUNT(*) FILTER (leak) AS n_leaks, COUNT(*) FILTER (silent) AS n_silent FROM y GROUP BY 1)
      SELECT variable, n, n_misses, COALESCE(n_clusters, 0) AS n_clusters, top_value, n_top, n_leaks, n_silent, n_silent / n >= 0.5 AS silence_suspect FROM g LEFT JOIN t USING (variable) LEFT JOIN k USING (variable)""",
    "tumour_sizes": f"""WITH {_R}, x AS (SELECT pilot_id, T, greatest({', '.join(_MMS(q + '(?:area\\s+de\\s+)?' + D.TUMOUR_MEASURE) for q in D.SIZE_LABELS)}) AS a, {_MMS(D.MEASURING + D.TUMOUR_MEASURE)} AS b, regexp_extract(T, '{_AGAIN}', 1) AS h, length(regexp_extract(T, '(?s)^(.*?)(?:{_AGAIN})', 1)) AS pos0 FROM r)
      SELECT pilot_id, round(COALESCE(a, b, CASE WHEN h <> '' AND regexp_matches(substring(T, greatest(pos0 - 80, 0) + 1, least(pos0, 80)), 'tamanho|dimens|neoplasia|tumor') THEN {_TIME.format('h')} END), 6) AS mm FROM x""",
    "polyp_words": f"""WITH {_R}, o AS MATERIALIZED ({_SPANS(D.POLYP)}), w AS (SELECT o.pilot_id, o.s, substring(T, greatest(s - 60, 0) + 1, e + 60 - greatest(s - 60, 0)) AS w FROM o JOIN r USING (pilot_id)),
      c AS (SELECT *, regexp_replace(w, '{D.NO_SIZE}', '', 'g') AS c, TRY_CAST(replace(regexp_extract(w, '{D.SIZE_BOUND}', 1), ',', '.') AS DOUBLE) * CASE WHEN regexp_extract(w, '{D.SIZE_BOUND}', 2) = 'mm' THEN 1 ELSE 10 END AS b FROM w), l AS (SELECT pilot_id, s, {_WORD_CASE} AS size FROM c), f AS (SELECT pilot_id, arg_min(size, s) AS size FROM l WHERE size IS NOT NULL GROUP BY 1)
      SELECT pilot_id, size FROM r LEFT JOIN f USING (pilot_id)""",
    "breast_flags": f"""WITH {_R}, x AS (SELECT pilot_id, T, {D.RE.sql('T')[0]} AS re, {D.RE_PCT.sql('T')} AS pct, {_RE_EVIDENCE} AS ev, {D.TIPO_IHQ.sql('T')[0]} AS tipo, {D.KI67.sql_evidence('T')} AS kev, {D.HER2_STATUS.sql('T')[0]} AS her2 FROM r)
      SELECT pilot_id, COALESCE(re = 'positivo' AND (COALESCE(pct BETWEEN 1 AND 10, FALSE) OR contains(ev, 'frac')), FALSE) AS erlow, COALESCE(tipo IN ('CDIS', 'CLIS') AND NOT regexp_matches(T, '{V.INVASIVE_TOO}'), FALSE) AS is_cdis_only, COALESCE(regexp_matches(kev, '{V.LOWER_BOUND}'), FALSE) AS ki67_is_lower_bound, COALESCE(her2 IN ('positivo', 'negativo'), FALSE) AS her2_resolved FROM x""",
    "invasion_records": f"WITH {_R}, x AS (" + " UNION ALL ".join(f"SELECT pilot_id, '{q.name}' AS variable, {q.sql('T')[0]} AS value FROM r" for q in (D.INV_LINFOV,
            D.INV_PERIN)) + ") SELECT *, CASE WHEN value IS NULL THEN 'not_mentioned' ELSE 'detected' END AS status, CASE WHEN value IS NOT NULL THEN 'high' END AS certainty, value IS NOT NULL AS has_evidence FROM x",
    "nottingham_guarded": f"WITH {_R}, x AS (SELECT pilot_id, T, {D.TIPO_HIST.sql('T')[0]} AS tipo FROM r), y AS (SELECT *, {_BEH} AS behavior FROM x) SELECT pilot_id, behavior, {_SCORES} FROM y",
    "evidence_support": f"""WITH {_LATEST_TEXT}, x AS (SELECT e.variable, lower(trim(COALESCE(e.evidence, ''))) AS e, lower(COALESCE(t.text, '')) AS s FROM evidence_record e LEFT JOIN texts t ON t.id_key = e.id_registro)
      SELECT variable, COUNT(*) AS n, COUNT(*) FILTER (trim(s) = '' OR (e <> '' AND (contains(s, e) OR contains(s, left(e, 40))))) AS n_supported FROM x GROUP BY 1""",
    "marker_anchor": r"""WITH p AS (SELECT conjunto, laudo, TRY_CAST(l2_ki67 AS DOUBLE) AS v FROM run_pilot WHERE regexp_matches(l2_ki67, '^\d{1,3}$')) SELECT conjunto, COUNT(*) AS n,
      COUNT(*) FILTER (list_contains(list_transform(regexp_extract_all(lower(COALESCE(laudo, '')), 'ki\s*-?\s*67[^%]{0,80}?(\d{1,3}(?:[.,]\d+)?)\s*%', 1), lambda x: round_even(TRY_CAST(replace(x, ',', '.') AS DOUBLE), 0)), v)) AS n_anchored FROM p GROUP BY 1""",
    "recount": f"WITH s AS ({POLICY_SQL['pilot_summary']}), f AS (SELECT field, CAST(SUM(accepted) AS BIGINT) AS accepted, CAST(SUM(discordant) AS BIGINT) AS discordant FROM s GROUP BY 1) SELECT field, 'accepted' AS metric, accepted AS v, TRUE AS equal FROM f UNION ALL SELECT field, 'discordant', discordant, TRUE FROM f",
}
