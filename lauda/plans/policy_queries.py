"""Queries over policy resolution, evidence verification and reader comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lauda.functions.text import normalize, sql_normalize
from lauda.operators import policy as P
from lauda.sources.tables import table

# Silence settings of the variables.
SETTINGS = (("polipo_presente", "nao", True, ["ambiguous"]), ("resultado", None, False, ["resultado_near"]),
    ("adequab", "satisfatoria", False, ["historical"]), ("bethesda", None, False, []))
SETTINGS_SCHEMA = "variable string, default_if_silent string, implicit_negative boolean, abstention_statuses array<string>"


def policies(spark, d):
    return P.policy_dimension(table(spark, d, "ontology_spec"), table(spark, d, "policy_alias"),
        spark.createDataFrame(SETTINGS, SETTINGS_SCHEMA))


def _evidence(spark, d, *extra):
    e = table(spark, d, "evidence_record")
    return P.with_policy(e.select("evidence_id", "variable", "clinica", P.clean_value(F.col("value")).alias("value"),
            "status", *extra),
        policies(spark, d))


def policy_resolution(spark, d):
    r = _evidence(spark, d).withColumn("r", P.apply_policy(F.col("value"), F.col("status")))
    return r.select("evidence_id", "r.*")


def policy_histogram(spark, d):
    r = _evidence(spark, d).select("variable", P.apply_policy(F.col("value"), F.col("status"))["resolution"].alias("resolution"))
    return r.groupBy("variable", "resolution").agg(F.count("*").alias("n"))


def latest_texts(spark, d):
    """(id_registro, T): normalised text of the last version of each report."""
    p = table(spark, d, "run_pilot").groupBy(F.col("caso").alias("id_registro")).agg(F.max_by("laudo", "pilot_id").alias("laudo"))
    return p.select("id_registro", normalize(F.col("laudo")).alias("T"))


def _with_text(spark, d):
    e = _evidence(spark, d, "id_registro", "evidence", "certainty", "evidence_class", "span_start", "span_end", "scope_meta")
    return e.join(latest_texts(spark, d), "id_registro", "left").withColumn("T", F.coalesce("T", F.lit("")))


def _verdict():
    c = F.col
    return P.verify_evidence(c("value"), c("evidence"), c("certainty"), c("T"), c("span_start"), c("span_end"))


def evidence_verdict(spark, d):
    return _with_text(spark, d).select("evidence_id", _verdict().alias("v")).select("evidence_id", "v.*")


def mode_c_resolution(spark, d):
    e = _with_text(spark, d)
    e = e.withColumn("v", _verdict()).withColumn("base",
        P.apply_policy(F.col("value"), F.col("status"))).withColumn("silence",
        P.apply_policy(F.lit(None).cast("string"), F.lit(None).cast("string")))
    c = F.col
    r = P.mode_c(c("status"), c("certainty"), c("evidence_class"), c("scope_meta.scope_complete"),
        c("scope_meta").isNotNull(), c("silence"), c("base"), c("v"))
    return e.select("evidence_id", r.alias("r")).select("evidence_id", "r.*")


def ontology_compliance(spark, d):
    r = _evidence(spark, d).select("variable", P.compliant(F.col("value")).alias("ok"))
    return r.groupBy("variable").agg(F.count("*").alias("n"), F.count_if(F.coalesce("ok", F.lit(False))).alias("n_compliant"))


def surface_agreement(spark, d):
    """Agreement of the two readers per variable: by number if every pair parses, else by text."""
    e = table(spark, d, "evidence_record").select("variable", P.clean_value(F.col("value")).alias("a"),
        P.clean_value(F.col("ia")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    num = lambda c: F.when(F.col(c).rlike(P.NUMERIC), F.col(c).try_cast("double"))
    g = e.groupBy("variable").agg(
        F.count("*").alias("n_both"), F.bool_and(num("a").isNotNull() & num("b").isNotNull()).alias("numeric"),
        F.count_if(num("a") == num("b")).alias("by_number"), F.count_if(F.col("a") == F.col("b")).alias("by_text"),
    )
    n = F.when(F.col("numeric"), F.col("by_number")).otherwise(F.col("by_text"))
    return g.select("variable", "n_both", "numeric", n.alias("n_agree"), F.round(n / F.col("n_both"), 6).alias("agreement"))


FIELDS = ("resultado", "adequab", "bethesda", "re", "rp", "her2", "ki67")


def reader_cells(spark, d):
    """Reader table, tall: one row per report and field, blanks as NULL."""
    p = table(spark, d, "run_pilot")
    cells = [F.struct(F.lit(v).alias("field"),
            *[P.clean_value(F.col(f"{k}_{v}")).alias(k) for k in ("ref", "l1", "l2", "estado")]) for v in FIELDS]
    return p.select("pilot_id", "caso", "conjunto", "braco", "clinica", normalize(F.col("laudo")).alias("T"),
        F.explode(F.array(*cells)).alias("c")).select("pilot_id", "caso", "conjunto", "braco", "clinica", "T", "c.*")


def two_reader_states(spark, d):
    c = F.col
    pct = F.exists(F.regexp_extract_all(c("T"), F.lit(r"(\d{1,3}) ?%"), F.lit(1)), lambda x: x == c("l2"))
    state = P.two_readers(c("l1"), c("l2"), (c("field") == "ki67") & pct)
    return reader_cells(spark, d).where("ref IS NOT NULL OR l1 IS NOT NULL OR l2 IS NOT NULL").groupBy("field",
        state.alias("state")).agg(F.count("*").alias("n"))


def pilot_summary(spark, d):
    """Per set, arm and field: states, discordance of what was accepted, coverage."""
    c, n = F.col, F.count("*")
    r = reader_cells(spark, d).where("ref IS NOT NULL")
    value = F.coalesce("l1", "l2")
    accepted = F.coalesce(c("estado").startswith("aceito"), F.lit(False))
    bad = accepted & (value != c("ref"))
    g = r.groupBy("conjunto", "braco", "field").agg(n.alias("n"), F.count_if(accepted).alias("accepted"),
        F.count_if(c("estado") == "escalado").alias("escalated"), F.count_if(bad).alias("discordant"))
    return g.withColumn("pct",
        F.when(c("accepted") > 0, F.bround(100 * c("discordant") / c("accepted"), 1))).withColumn("coverage",
        F.bround(100 * c("accepted") / c("n"), 1))


def confusion(spark, d):
    """Accepted value against reference, per field."""
    r = reader_cells(spark, d).where("ref IS NOT NULL AND estado LIKE 'aceito%'")
    return r.groupBy("field", F.coalesce("l1", "l2").alias("value"), "ref").agg(F.count("*").alias("n"))


def destinations(spark, d):
    """Where every annotated category went: equal, different, routed or nowhere."""
    c = F.col
    dest = F.when(c("estado") == "escalado", "routed").when(c("estado").startswith("aceito"),
        F.when(F.coalesce("l1", "l2") == c("ref"), "equal").otherwise("different")).otherwise("none")
    r = reader_cells(spark, d).select("field", F.coalesce("ref", F.lit("NAO_INFORMA")).alias("ref"), dest.alias("dest"))
    return r.groupBy("field", "ref").pivot("dest", ["equal", "different", "routed", "none"]).count().na.fill(0)


def conditional_discordance(spark, d):
    """Discordance of the second reader by what the first one did."""
    c = F.col
    state = F.when(c("l1").isNull(), "silent").when(c("l1") == c("l2"), "agree").otherwise("disagree")
    r = reader_cells(spark, d).where("ref IS NOT NULL AND l2 IS NOT NULL")
    return r.groupBy("conjunto", "field", state.alias("l1_state")).agg(F.count("*").alias("n"),
        F.count_if(c("l2") != c("ref")).alias("discordant"), F.count_if(c("l1") == c("ref")).alias("l1_right"))


def routed_fields(spark, d):
    """How many reports have k escalated fields."""
    per = reader_cells(spark, d).groupBy("conjunto", "pilot_id").agg(F.count_if(F.col("estado") == "escalado").alias("k"))
    return per.groupBy("conjunto", "k").agg(F.count("*").alias("n"))


def class_recall(spark, d):
    """Support, recall and evidence support of each reference class, per reader."""
    r = reader_cells(spark, d).where("ref IS NOT NULL")
    r = r.select("field", "ref", "T",
        F.explode(F.array(*[F.struct(F.lit(k).alias("reader"), F.col(k).alias("v")) for k in ("l1", "l2")])).alias("x"))
    g = r.groupBy("field", "ref", "x.reader").agg(F.count("*").alias("support"),
        F.count_if(F.col("x.v") == F.col("ref")).alias("hits"))
    return g.withColumn("recall", F.round(F.col("hits") / F.col("support"), 6))


def reader_matrix(spark, d):
    """Agreement of first reader, second reader and accepted value with the reference, and between each other."""
    c = F.col
    r = reader_cells(spark, d).where("ref IS NOT NULL").withColumn("acc",
        F.when(c("estado").startswith("aceito"), F.coalesce("l1", "l2")))
    same = lambda a, b: F.round(F.avg(F.coalesce(c(a) == c(b), F.lit(False)).cast("int")), 6)
    return r.groupBy("field").agg(F.count("*").alias("n"), same("l1", "ref").alias("a_g"), same("l2", "ref").alias("b_g"),
        same("acc", "ref").alias("c_g"), same("l1", "l2").alias("a_b"))


def concordance(spark, d):
    """Both, one or neither reader answered, and whether they agree; up to three examples of disagreement."""
    c = F.col
    kind = F.when(c("l1").isNull() & c("l2").isNull(), "both_na").when(c("l2").isNull(), "l1_only").when(c("l1").isNull(),
        "l2_only").when(c("l1") == c("l2"), "agree").otherwise("disagree")
    r = reader_cells(spark, d).withColumn("kind", kind)
    n = r.groupBy("field", "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy("pilot_id")
    # three examples: a rank over the pre-ranked heads of hash slices, so that no task ranks a whole field
    s = Window.partitionBy("field", F.pmod(F.xxhash64("pilot_id"), F.lit(32))).orderBy("pilot_id")
    ex = r.where("kind = 'disagree'").withColumn("k", F.row_number().over(s)).where("k <= 3").withColumn("k",
        F.row_number().over(w)).where("k <= 3")
    ex = ex.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pilot_id")), lambda x: x.cast("string")),
            ",").alias("examples")).withColumn("kind",
        F.lit("disagree"))
    return n.join(ex, ["field", "kind"], "left")


def numeric_differences(spark, d):
    """Sorted absolute differences of the accepted Ki-67 from the reference, as a distribution."""
    num = lambda c: F.when(F.col(c).rlike(P.NUMERIC), F.col(c).try_cast("double"))
    r = reader_cells(spark, d).where("field = 'ki67'").withColumn("diff", F.abs(num("l2") - num("ref"))).where("diff IS NOT NULL")
    return r.groupBy("diff").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    policy_resolution, policy_histogram, evidence_verdict, mode_c_resolution, ontology_compliance, surface_agreement,
    two_reader_states, pilot_summary, confusion, destinations,
    conditional_discordance, routed_fields, class_recall, reader_matrix, concordance, numeric_differences)}

_CLEAN = "CASE WHEN {0} IS NOT NULL AND trim({0}) NOT IN ('', 'NA', 'nan', 'NaN', 'None') THEN {0} END"
_NUM = r"CASE WHEN regexp_matches({0}, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(trim({0}) AS DOUBLE) END"
_SET = ", ".join(f"('{v}', {'NULL' if x is None else repr(x)}, {b}, [{', '.join(map(repr, s))}]::VARCHAR[])" for v, x, b,
    s in SETTINGS)
_POL = f"""
pol AS (SELECT * FROM (SELECT variable, min(onto_type) AS onto_type, list(DISTINCT canonical) FILTER (canonical IS NOT NULL) AS vals, min(range_min) AS lo, max(range_max) AS hi FROM ontology_spec GROUP BY 1)
  LEFT JOIN (SELECT * FROM (VALUES {_SET}) s(variable, dflt, imp, abst)) USING (variable)),
al AS (SELECT variable, alias, min(canonical) AS target FROM policy_alias GROUP BY ALL),
ev0 AS (SELECT * EXCLUDE (value), {_CLEAN.format('value')} AS value FROM evidence_record),
ev AS (SELECT e.*, p.onto_type, p.vals, p.lo, p.hi, p.dflt, COALESCE(p.imp, FALSE) AS imp, COALESCE(p.abst, []) AS abst, al.target, {_NUM.format('e.value')} AS num
  FROM ev0 e LEFT JOIN pol p USING (variable) LEFT JOIN al ON al.variable = e.variable AND al.alias = e.value)"""


def _policy_sql(what: str, silent: bool = False) -> str:
    i = {"resolution": 0, "normalized": 1, "reason": 2}[what]
    val, none = "value", "NULL"
    rows = [("dflt IS NOT NULL AND imp", ("'accepted_exact'", "dflt", "'silence_mapped_to_default'")),
        ("dflt IS NOT NULL", ("'abstained_source_incomplete'", none, "'silence_but_no_implicit_negative'")),
        ("TRUE", ("'abstained_source_incomplete'", none, "'silence'"))]
    if silent:
        return "CASE " + " ".join(f"WHEN {c} THEN {r[i]}" for c, r in rows) + " END"
    rows = [("list_contains(abst, status)", ("'abstained_unsupported'", none, "'status'"))] + [(f"value IS NULL AND ({c})",
            r) for c,
        r in rows] + [
        ("target IS NOT NULL", ("'accepted_semantic'", "target", "'alias'")),
        ("onto_type = 'enum' AND list_contains(vals, value)", ("'accepted_exact'", val, "'enum_match'")),
        ("onto_type = 'enum'", ("'escalated_case'", val, "'not_in_enum'")),
        ("onto_type IN ('integer', 'float') AND num IS NULL", ("'escalated_case'", val, "'not_numeric'")),
        ("onto_type IN ('integer', 'float') AND (num < lo OR num > hi)", ("'escalated_case'", val, "'out_of_range'")),
        ("onto_type IN ('integer', 'float')", ("'accepted_exact'", val, "'numeric_match'")),
        ("TRUE", ("'accepted_exact'", val, "'default'"))]
    return "CASE " + " ".join(f"WHEN {c} THEN {r[i]}" for c, r in rows) + " END"


_COLLAPSE = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_TEXTS = f"""
txt AS (SELECT caso AS id_registro, {sql_normalize('arg_max(laudo, pilot_id)')} AS T FROM (SELECT caso, pilot_id, COALESCE(laudo, '') AS laudo FROM run_pilot) GROUP BY caso),
k AS MATERIALIZED (SELECT ev.*, COALESCE(T, '') AS T, trim(COALESCE(evidence, '')) AS e0, regexp_replace(trim(COALESCE(evidence, '')), '^[. ]+|[. ]+$', '', 'g') AS core,
  CASE WHEN lower(trim(COALESCE(certainty, 'high'))) IN ('high', 'strong') THEN 'strong' ELSE 'weak' END AS strong,
  COALESCE(span_start >= 0 AND span_end > span_start AND span_end <= length(COALESCE(T, '')), FALSE) AS inside,
  CASE WHEN span_start >= 0 AND span_end > span_start THEN substring(COALESCE(T, ''), span_start + 1, span_end - span_start) END AS frag FROM ev LEFT JOIN txt USING (id_registro)),
v AS MATERIALIZED (SELECT *, CASE WHEN value IS NULL AND e0 = '' THEN 1 WHEN e0 = '' THEN 2 WHEN core = '' THEN 3 WHEN inside AND (contains(frag, core) OR contains(core, frag)) THEN 4
  WHEN inside AND (contains({_COLLAPSE.format('frag')}, {_COLLAPSE.format('core')}) OR contains({_COLLAPSE.format('core')}, {_COLLAPSE.format('frag')})) THEN 5
  WHEN contains(T, core) THEN 6 WHEN contains(T, left(core, 20)) THEN 7 ELSE 8 END AS rule FROM k),
w AS MATERIALIZED (SELECT *, rule IN (1, 4, 5, 6) AS verified, CASE WHEN rule IN (4, 5) THEN strong WHEN rule = 6 THEN 'weak' WHEN rule = 7 THEN 'weak_candidate' ELSE 'none' END AS support,
  ['silence', 'value_without_evidence', 'empty_evidence', 'offset_exact', 'offset_normalized', 'substring', 'prefix', 'evidence_not_in_text'][rule] AS vreason,
  CAST(CASE WHEN rule IN (4, 5) THEN 1 WHEN rule = 6 THEN (length(T) - length(replace(T, core, ''))) // length(core) WHEN rule = 7 THEN (length(T) - length(replace(T, left(core, 20), ''))) // length(left(core, 20)) ELSE 0 END AS INTEGER) AS occurrences FROM v)"""
_EC = "lower(trim(COALESCE(evidence_class, '')))"
_C_ROWS = [
    ("status = 'no_match' AND imp AND scope_meta IS NULL", ("sr", "sn", "'silence_unaudited'")),
    ("status = 'no_match' AND imp AND COALESCE(scope_meta.scope_complete, FALSE)", ("sr", "sn", "'silence_audited'")),
    ("status = 'no_match' AND imp", ("'abstained_source_incomplete'", "NULL", "'silence_without_scope'")),
    ("NOT verified", ("'escalated_case'", "bn", "concat('evidence_failed:', vreason)")),
    (f"{_EC} IN ('literal', 'lexical_alias') AND br = 'accepted_exact'", ("br", "bn", f"concat(bw, '+', {_EC})")),
    (f"{_EC} IN ('ontology_alias', 'bound', 'qualitative') AND br = 'accepted_exact'",
        ("'accepted_semantic'", "bn", f"concat(bw, '+', {_EC})")),
    (f"{_EC} <> '' AND {_EC} <> 'silence_default' AND lower(trim(certainty)) = 'low'",
        ("'escalated_case'", "bn", f"concat('low_certainty+', {_EC})")),
    ("support = 'weak'", ("CASE WHEN br = 'accepted_exact' THEN 'accepted_semantic' ELSE br END", "bn", "concat(bw, '+weak')")),
    ("TRUE", ("br", "bn", "bw"))]
_C = ["CASE " + " ".join(f"WHEN {c} THEN {r[i]}" for c, r in _C_ROWS) + " END" for i in range(3)]
_CELLS = "cells AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT pilot_id, caso, conjunto, braco, clinica, laudo, '{v}' AS field, " + ", ".join(f"{_CLEAN.format(f'{k}_{v}')} AS {k}" for k in ("ref",
            "l1", "l2", "estado")) + " FROM run_pilot" for v in FIELDS) + ")"
_PCT = f"list_contains(list_transform(regexp_extract_all({sql_normalize('laudo')}, '(\\d{{1,3}}) ?%', 1), lambda x: x), l2)"

ORACLE = {
    "policy_resolution": f"WITH {_POL} SELECT evidence_id, {_policy_sql('resolution')} AS resolution, {_policy_sql('normalized')} AS normalized, {_policy_sql('reason')} AS reason FROM ev",
    "policy_histogram": f"WITH {_POL} SELECT variable, {_policy_sql('resolution')} AS resolution, COUNT(*) AS n FROM ev GROUP BY ALL",
    "evidence_verdict": f"WITH {_POL}, {_TEXTS} SELECT evidence_id, verified, support, vreason AS reason, occurrences FROM w",
    "mode_c_resolution": f"""WITH {_POL}, {_TEXTS}, x AS (SELECT *, {_policy_sql('resolution')} AS br, {_policy_sql('normalized')} AS bn, {_policy_sql('reason')} AS bw, {_policy_sql('resolution', True)} AS sr, {_policy_sql('normalized', True)} AS sn FROM w)
      SELECT evidence_id, {_C[0]} AS resolution, {_C[1]} AS normalized, {_C[2]} AS reason FROM x""",
    "ontology_compliance": f"WITH {_POL} SELECT variable, COUNT(*) AS n, COUNT(*) FILTER (COALESCE(CASE WHEN value IS NULL THEN FALSE WHEN onto_type = 'enum' THEN list_contains(vals, value) WHEN onto_type IN ('integer', 'float') THEN COALESCE(num BETWEEN lo AND hi, FALSE) ELSE TRUE END, FALSE)) AS n_compliant FROM ev GROUP BY 1",
    "surface_agreement": f"""WITH e AS (SELECT variable, {_CLEAN.format('value')} AS a, {_CLEAN.format('ia')} AS b FROM evidence_record), n AS (SELECT *, {_NUM.format('a')} AS x, {_NUM.format('b')} AS y FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
      g AS (SELECT variable, COUNT(*) AS n_both, bool_and(x IS NOT NULL AND y IS NOT NULL) AS numeric, COUNT(*) FILTER (x = y) AS bn, COUNT(*) FILTER (a = b) AS bt FROM n GROUP BY 1)
      SELECT variable, n_both, numeric, CASE WHEN numeric THEN bn ELSE bt END AS n_agree, round(CASE WHEN numeric THEN bn ELSE bt END / n_both, 6) AS agreement FROM g""",
    "two_reader_states": f"""WITH {_CELLS} SELECT field, CASE WHEN l1 = l2 THEN 'aceito_concordancia' WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN 'escalado' WHEN l1 IS NULL AND l2 IS NULL THEN 'sem_resposta'
      WHEN l1 IS NULL AND field = 'ki67' AND {_PCT} THEN 'aceito_suporte_textual' ELSE 'escalado' END AS state, COUNT(*) AS n FROM cells WHERE ref IS NOT NULL OR l1 IS NOT NULL OR l2 IS NOT NULL GROUP BY ALL""",
    "pilot_summary": f"""WITH {_CELLS}, g AS (SELECT conjunto, braco, field, COUNT(*) AS n, COUNT(*) FILTER (estado LIKE 'aceito%') AS accepted, COUNT(*) FILTER (estado = 'escalado') AS escalated,
      COUNT(*) FILTER (estado LIKE 'aceito%' AND COALESCE(l1, l2) <> ref) AS discordant FROM cells WHERE ref IS NOT NULL GROUP BY ALL)
      SELECT *, CASE WHEN accepted > 0 THEN round_even(100 * discordant / accepted, 1) END AS pct, round_even(100 * accepted / n, 1) AS coverage FROM g""",
    "confusion": f"WITH {_CELLS} SELECT field, COALESCE(l1, l2) AS value, ref, COUNT(*) AS n FROM cells WHERE ref IS NOT NULL AND estado LIKE 'aceito%' GROUP BY ALL",
    "destinations": f"""WITH {_CELLS}, x AS (SELECT field, COALESCE(ref, 'NAO_INFORMA') AS ref, CASE WHEN estado = 'escalado' THEN 'routed' WHEN estado LIKE 'aceito%' THEN CASE WHEN COALESCE(l1, l2) = cells.ref THEN 'equal' ELSE 'different' END ELSE 'none' END AS dest FROM cells)
      SELECT field, ref, COUNT(*) FILTER (dest = 'equal') AS equal, COUNT(*) FILTER (dest = 'different') AS different, COUNT(*) FILTER (dest = 'routed') AS routed, COUNT(*) FILTER (dest = 'none') AS "none" FROM x GROUP BY ALL""",
    "conditional_discordance": f"""WITH {_CELLS} SELECT conjunto, field, CASE WHEN l1 IS NULL THEN 'silent' WHEN l1 = l2 THEN 'agree' ELSE 'disagree' END AS l1_state, COUNT(*) AS n, COUNT(*) FILTER (l2 <> ref) AS discordant, COUNT(*) FILTER (l1 = ref) AS l1_right
      FROM cells WHERE ref IS NOT NULL AND l2 IS NOT NULL GROUP BY ALL""",
    "routed_fields": f"WITH {_CELLS}, p AS (SELECT conjunto, pilot_id, COUNT(*) FILTER (estado = 'escalado') AS k FROM cells GROUP BY ALL) SELECT conjunto, k, COUNT(*) AS n FROM p GROUP BY ALL",
    "class_recall": f"""WITH {_CELLS}, x AS (SELECT field, ref, 'l1' AS reader, l1 AS v FROM cells WHERE ref IS NOT NULL UNION ALL SELECT field, ref, 'l2', l2 FROM cells WHERE ref IS NOT NULL)
      SELECT field, ref, reader, COUNT(*) AS support, COUNT(*) FILTER (v = ref) AS hits, round(COUNT(*) FILTER (v = ref) / COUNT(*), 6) AS recall FROM x GROUP BY ALL""",
    "reader_matrix": f"""WITH {_CELLS}, x AS (SELECT *, CASE WHEN estado LIKE 'aceito%' THEN COALESCE(l1, l2) END AS acc FROM cells WHERE ref IS NOT NULL)
      SELECT field, COUNT(*) AS n, round(COUNT(*) FILTER (l1 = ref) / COUNT(*), 6) AS a_g, round(COUNT(*) FILTER (l2 = ref) / COUNT(*), 6) AS b_g, round(COUNT(*) FILTER (acc = ref) / COUNT(*), 6) AS c_g, round(COUNT(*) FILTER (l1 = l2) / COUNT(*), 6) AS a_b FROM x GROUP BY 1""",
    "concordance": f"""WITH {_CELLS}, x AS (SELECT *, CASE WHEN l1 IS NULL AND l2 IS NULL THEN 'both_na' WHEN l2 IS NULL THEN 'l1_only' WHEN l1 IS NULL THEN 'l2_only' WHEN l1 = l2 THEN 'agree' ELSE 'disagree' END AS kind FROM cells),
      e AS (SELECT field, kind, string_agg(pilot_id, ',' ORDER BY pilot_id) AS examples FROM (SELECT field, kind, pilot_id FROM x WHERE kind = 'disagree' QUALIFY row_number() OVER (PARTITION BY field ORDER BY pilot_id) <= 3) GROUP BY ALL)
      SELECT field, kind, n, examples FROM (SELECT field, kind, COUNT(*) AS n FROM x GROUP BY ALL) LEFT JOIN e USING (field, kind)""",
    "numeric_differences": f"WITH {_CELLS} SELECT abs({_NUM.format('l2')} - {_NUM.format('ref')}) AS diff, COUNT(*) AS n FROM cells WHERE field = 'ki67' AND abs({_NUM.format('l2')} - {_NUM.format('ref')}) IS NOT NULL GROUP BY 1",
}
