"""Queries over review queues, cascade, sampling, run history, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.session import collect_bounded, maybe_broadcast, reliable, spread
from lauda.functions.text import normalize, shingles, sql_normalize
from lauda.operators import cascade as C
from lauda.operators import gates as G
from lauda.operators import joins as J
from lauda.operators import observe as O
from lauda.operators import run_marks as M
from lauda.operators import sampling as S
from lauda.operators.policy import clean_value
from lauda.operators.range_scan import prefix_sums
from lauda.plans.policy_queries import reader_cells
from lauda.sources.tables import table

# Taxonomy tags of the variables.
TAXONOMY = (("bbps", ["NUM-C", "ORD-E"]), ("polipo_tamanho_max_mm", ["MEAS-N", "NUM-C"]), ("ki67_pct", ["NUM-C"]),
    ("bethesda", ["ORD-E"]), ("her2_score", ["ORD-E"]), ("resultado", ["CAT"]), ("adequab", ["CAT"]))


def _ev(spark, d):
    return table(spark, d, "evidence_record")


def variable_summary(spark, d):
    """Rows, filled, fill rate and second reader's counts of every variable."""
    e = _ev(spark, d).select("variable", clean_value(F.col("value")).alias("a"), clean_value(F.col("ia")).alias("b"))
    return e.groupBy("variable").agg(F.count("*").alias("n"), F.count("a").alias("n_filled"),
        F.bround(F.count("a") / F.count("*"), 4).alias("fill_rate"), F.count("b").alias("ia_fill"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"),
        F.count_if(F.col("a") == F.col("b")).alias("n_agree"))


def status_distribution(spark, d):
    return _ev(spark, d).groupBy("variable", F.coalesce("status", F.lit("None")).alias("status")).agg(F.count("*").alias("n"))


def status_by_clinic(spark, d):
    """Cross table of status by clinic over all rows, in long form; missing ones of either are a bucket of their own."""
    named = lambda c: F.coalesce(clean_value(F.col(c)), F.lit("None")).alias(c)
    return _ev(spark, d).select(named("status"), named("clinica")).groupBy("status", "clinica").agg(F.count("*").alias("n"))


def resolution_by_year(spark, d):
    """Cross table of resolution by year of the stratum map over all rows, in long form."""
    ano = F.coalesce(F.try_element_at("stratum", F.lit("ano")), F.lit("None")).alias("ano")
    return _ev(spark, d).select("resolution", ano).groupBy("resolution", "ano").agg(F.count("*").alias("n"))


def numeric_ranges(spark, d):
    """Range, upper median and distinct values of numeric variables."""
    e = _ev(spark, d).where(F.col("value_num").isNotNull() & ~F.isnan("value_num"))
    c = e.groupBy("variable", "value_num").agg(F.count("*").alias("m"))
    total = c.groupBy("variable").agg(F.sum("m").alias("total"))
    r = prefix_sums(c, ["variable"], ["value_num"], "m").join(maybe_broadcast(total), "variable")
    return r.groupBy("variable").agg(F.min("value_num").alias("lo"), F.max("value_num").alias("hi"),
        F.count("*").alias("n_distinct"),
        F.min(F.when(F.col("cum") > F.floor(F.col("total") / 2), F.col("value_num"))).alias("upper_median"))


def gate_escalated(spark, d):
    """Escalated cells by variable and status, with examples."""
    e = _ev(spark, d).where("resolution = 'escalated_case'").withColumn("status", F.coalesce("status", F.lit("None")))
    n = e.groupBy("variable", "status").agg(F.count("*").alias("n"))
    return n.join(G.with_examples(e.select("evidence_id", "variable", "status"), ["variable", "status"]), ["variable", "status"])


def gate_pairs(spark, d):
    """Top disagreement pairs with examples."""
    keys = ["variable", "l1", "l2"]
    top = G.pair_items(_ev(spark, d))
    ex = G.with_examples(G.disagreements(_ev(spark, d)).join(maybe_broadcast(top.select(*keys)), keys, "left_semi"), keys)
    return top.join(ex, keys).select(*keys, "n", F.col("rank").cast("int").alias("rank"), "examples")


def gate_strata(spark, d):
    return G.stratum_shares(G.disagreements(_ev(spark, d)), ["variable", "l1", "l2"], ["clinica"])


def auto_adjudicate(spark, d):
    items = G.pairs_with_share(G.disagreements(_ev(spark, d)), "clinica")
    members = table(spark, d,
        "ontology_spec").where("onto_type = 'enum'").groupBy("variable").agg(F.collect_set("canonical").alias("vals"))
    return G.adjudicate(items, members, spark.createDataFrame(TAXONOMY, "variable string, tags array<string>"))


def alias_patch_rerun(spark, d):
    """Disagreements left in each variable once the safe aliases are applied."""
    new = G.new_aliases(auto_adjudicate(spark, d), table(spark, d, "policy_alias"))
    x = G.disagreements(_ev(spark, d)).join(maybe_broadcast(new.select("variable", F.col("alias").alias("l2"), "canonical")),
        ["variable", "l2"], "left")
    return x.groupBy("variable").agg(F.count("*").alias("before"),
        F.count_if(F.coalesce("canonical", "l2") != F.col("l1")).alias("after"))


def verdict_latest(spark, d):
    return C.latest_verdicts(table(spark, d, "cross_verdict")).select("id_key", "variable", "model", "verdict_id")


def cascade_consensus(spark, d):
    return C.consensus(table(spark, d, "cross_verdict"))


def cascade_apply(spark, d):
    return C.apply_cascade(_ev(spark, d), table(spark, d, "cross_verdict"), 50)


def silence_suspects(spark, d):
    e = _ev(spark, d).groupBy("variable").agg(F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(F.col("resolution").startswith("abstained"), F.lit(False)).cast("int")), 6).alias("share"))
    return e.withColumn("suspect", F.col("share") >= 0.3)


def scope_leaks(spark, d):
    """Values found outside the sections a variable is expected in, by folded section."""
    s = F.regexp_replace(F.lower(F.trim("section")), "ã", "a")
    e = _ev(spark, d).select("variable", clean_value(F.col("value")).alias("v"),
        s.alias("s")).where("v IS NOT NULL AND s IS NOT NULL AND s <> 'conclusao'")
    return e.groupBy("variable", "s").agg(F.count("*").alias("n"))


def miss_clusters(spark, d):
    """Cells that only the second reader filled, by its value: count, first example, share grounded in the evidence."""
    e = _ev(spark, d).select("evidence_id", "variable", clean_value(F.col("value")).alias("v"),
        clean_value(F.col("ia")).alias("ia"),
        F.lower(F.coalesce("evidence", F.lit(""))).alias("t")).where("v IS NULL AND ia IS NOT NULL")
    g = F.col("t").contains(F.lower("ia"))
    return e.groupBy("variable", "ia").agg(F.count("*").alias("n"), F.min("evidence_id").alias("example"),
        F.round(F.avg(g.cast("int")), 6).alias("grounded"))


def saturation(spark, d):
    c = F.col
    r = reader_cells(spark, d).where("ref IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL")
    r = r.select("field", (c("l1") == c("l2")).alias("agree"),
        ((c("l1") != c("l2")) & (c("l1") != c("ref"))).alias("l1_wrong"),
        ((c("l1") != c("l2")) & (c("l1") == c("ref"))).alias("l2_wrong"),
        ((c("l1") != c("l2")) & (c("l1") != c("ref")) & (c("l2") != c("ref"))).alias("ambiguous"))
    return O.saturation(r, ["field"])


def audit_sample(spark, d):
    e = _ev(spark, d).where("resolution LIKE 'abstained%' OR resolution = 'accepted_exact'").select("evidence_id", "variable",
        "clinica", "resolution")
    return S.stratified(e, ["resolution", "clinica"], "evidence_id", 3).select("evidence_id", "resolution", "clinica",
        F.col("pick").cast("int").alias("pick"))


def disagreement_sample(spark, d):
    """Both directions: readers that differ, and cells that only the second one filled."""
    e = _ev(spark, d).select("evidence_id", "clinica", clean_value(F.col("value")).alias("a"),
        clean_value(F.col("ia")).alias("b"))
    kind = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "only_second").when(F.col("a") != F.col("b"), "differ")
    e = S.stratified(e.withColumn("kind", kind).where("kind IS NOT NULL"), ["kind", "clinica"], "evidence_id", 5)
    top = S.stratified(e.drop("pick"), ["kind"], "evidence_id", 40)
    return top.select("evidence_id", "kind", "clinica")


def proportional_sample(spark, d):
    p = table(spark, d, "run_pilot").select("pilot_id", "conjunto", "clinica")
    alloc = S.proportional(p.groupBy("conjunto").agg(F.count("*").alias("n")), 100)
    return S.stratified(p.join(maybe_broadcast(alloc.select("conjunto", "alloc")), "conjunto"), ["conjunto"], "pilot_id",
        F.col("alloc")).select("pilot_id", "conjunto")


def fixed_sample(spark, d):
    alloc = spark.createDataFrame([("cervical", 40), ("tireoide", 30), ("mama_ihq", 20)], "conjunto string, alloc int")
    p = table(spark, d, "run_pilot").select("pilot_id", "conjunto").join(maybe_broadcast(alloc), "conjunto")
    return S.stratified(p, ["conjunto"], "pilot_id", F.col("alloc"), seed=7).select("pilot_id", "conjunto")


def split_70_30(spark, d):
    return S.split(table(spark, d, "regression_case").select("case_no"), "case_no", 0.7)


def fill_rate_drift(spark, d):
    return O.drift(table(spark, d, "run_variable"))


def new_statuses(spark, d):
    return O.new_statuses(table(spark, d, "run_variable"))


def latest_runs(spark, d):
    return O.latest_runs(table(spark, d, "run_variable")).select("contract_id", "run_id", F.col("age").cast("int").alias("age"))


def run_timeline(spark, d):
    return O.timeline(table(spark, d, "run_variable")).select("contract_id", "variable", "run_id",
        F.unix_micros("started_at").alias("started_us"), "fill_rate")


def last_known_fill(spark, d):
    return O.last_known(table(spark, d, "run_variable"))


def runs_by_prefix(spark, d):
    """Runs of the contracts with a prefix, rolled up by contract and variable."""
    r = table(spark, d, "run_variable").where(F.col("contract_id").startswith("mama_ihq"))
    return r.rollup("contract_id", "variable").agg(F.count("*").alias("n"), F.sum("n_total").alias("n_total"))


def left_join_texts(spark, d):
    e = _ev(spark, d).select("evidence_id", "id_registro")
    p = table(spark, d, "run_pilot").groupBy(F.col("caso").alias("id_registro")).agg(F.max("pilot_id").alias("pilot_id"),
        F.count("*").alias("versions"))
    return e.join(p, "id_registro", "left").select("evidence_id", "pilot_id", "versions")


def semi_join_cases(spark, d):
    dev = table(spark, d, "run_pilot").where("no_desenvolvimento").select(F.col("caso").alias("id_registro"))
    return _ev(spark, d).join(dev, "id_registro", "left_semi").groupBy("variable").agg(F.count("*").alias("n"))


def resume_anti_join(spark, d):
    """Cells still to be verified: no verdict stands for their case and variable."""
    done = table(spark, d, "cross_verdict").select(F.col("id_key").alias("id_registro"), "variable").distinct()
    return _ev(spark, d).select("evidence_id", "id_registro", "variable").join(done, ["id_registro", "variable"],
        "left_anti").select("evidence_id")


def orphan_counts(spark, d):
    """Cases and verdicts without each other, per variable."""
    a = _ev(spark, d).select("variable", F.col("id_registro").alias("k")).distinct().withColumn("l", F.lit(1))
    b = table(spark, d, "cross_verdict").select("variable", F.col("id_key").alias("k")).distinct().withColumn("r", F.lit(1))
    return a.join(b, ["variable", "k"], "full").groupBy("variable").agg(F.count_if(F.col("r").isNull()).alias("only_cells"),
        F.count_if(F.col("l").isNull()).alias("only_verdicts"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))


def nearest_earlier_event(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return J.nearest_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click",
        ["event_id"]).select("event_id", "near_event_id")


MEASURE, TAKEN = r"\d+ mm", r"\d+ x \d+ x \d+ mm"


def span_exclusion(spark, d):
    """Measures of a report outside its three-dimensional ones."""
    r = table(spark, d, "run_pilot").select("pilot_id", normalize(F.col("laudo")).alias("T"))
    one = J.outside(J.spans_of(F.col("T"), MEASURE), J.spans_of(F.col("T"), TAKEN))
    return r.select("pilot_id", F.explode(one).alias("s")).select("pilot_id", F.col("s.start").alias("start_at"),
        F.col("s.end").alias("end_at"))


def development_overlap(spark, d, most=20_000):
    """Test reports whose five-word shingles are those of a development report, by 0.8 or more: best and number of links.

    Equal texts are one class; links are counted for its members and found once. The texts are read once for their
    marks and once more for the candidates, up to `most` of which are looked up by a broadcast. Every other join is a
    merge: by the files' sizes the optimizer takes the texts for a few MB and would broadcast them from the driver.
    """
    r = table(spark, d, "run_pilot").select("pilot_id", F.coalesce("no_desenvolvimento", F.lit(False)).alias("dev"), "laudo")
    p = spread(r).select("pilot_id", "dev", normalize(F.col("laudo")).alias("T"))
    x = reliable(M.marked(p, "T", 0.8, M.run_counts(p.where("dev"), "T", 5), 5))
    classes = x.groupBy("cls").agg(F.min("pilot_id").alias("id"), F.count_if("dev").alias("n_dev"),
        F.bool_or(~F.col("dev")).alias("has_test"), F.first(F.struct("size", "bits0", "bits1", "keys")).alias("m"))
    pairs = reliable(M.near_pairs(classes.where("has_test").select(F.col("id").alias("a"), "m.*"),
        classes.where("n_dev > 0").select(F.col("id").alias("b"), "n_dev", "m.*"), 0.8))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("pilot_id")).distinct()
    few = collect_bounded(ids, most)
    looked_up = ids.hint("merge") if few is None else F.broadcast(spark.createDataFrame(few, ids.schema))
    sets = r.join(looked_up, "pilot_id").select("pilot_id", shingles(normalize(F.col("laudo")), 5).alias("sh"))
    links = J.verified(pairs, sets.withColumnRenamed("pilot_id", "a"), sets.withColumnRenamed("pilot_id", "b"), "a", "b", 0.8)
    per = links.groupBy("a").agg(F.sum("n_dev").alias("n_links"), F.round(F.max("jaccard"), 6).alias("best"))
    per = per.join(x.select(F.col("pilot_id").alias("a"), "cls").hint("merge"), "a")
    return x.where("NOT dev").join(per.hint("merge"), "cls").select("pilot_id", "n_links", "best")


def set_difference(spark, d):
    a = table(spark, d, "run_pilot").select(F.col("caso").alias("k"))
    b = table(spark, d, "cross_verdict").select(F.col("id_key").alias("k"))
    return a.distinct().exceptAll(b.distinct())


def set_union_sizes(spark, d):
    """Sizes of the union and the intersection of two readers' case sets."""
    a = table(spark, d, "cross_verdict").where("model = 'verif-a'").select("id_key").distinct()
    b = table(spark, d, "cross_verdict").where("model = 'verif-b'").select("id_key").distinct()
    n = a.union(b).groupBy("id_key").agg(F.count("*").alias("c"))
    return n.agg(F.count("*").alias("n_union"), F.count_if(F.col("c") == 2).alias("n_common"))


def checkpoint_last_wins(spark, d):
    """The last record of every report and variable by its write time, then its id."""
    e = _ev(spark, d)
    g = e.groupBy("id_registro",
        "variable").agg(F.max_by(F.struct("evidence_id", "resolution"), F.struct("written_at", "evidence_id")).alias("r"),
        F.count("*").alias("n"))
    return g.select("id_registro", "variable", "r.evidence_id", "r.resolution", "n")


_SKIP = {"normalize", "shingles", "sql_normalize", "clean_value", "reader_cells", "table"}
QUERIES = {k: f for k,
    f in list(globals().items()) if callable(f) and getattr(f, "__module__",
        "") == __name__ and not k.startswith("_") and k not in _SKIP}

_CL = "CASE WHEN {0} IS NOT NULL AND trim({0}) NOT IN ('', 'NA', 'nan', 'NaN', 'None') THEN {0} END"
_AB = f"ab AS (SELECT *, {_CL.format('value')} AS a, {_CL.format('ia')} AS b FROM evidence_record)"
_DIS = f"{_AB}, dis AS MATERIALIZED (SELECT evidence_id, variable, clinica, a AS l1, b AS l2 FROM ab WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND COALESCE(resolution, '') NOT IN ('accepted_cross_verified', 'abstained_by_consensus'))"
_TAX = ", ".join(f"('{v}', [{', '.join(map(repr, t))}])" for v, t in TAXONOMY)
_SHARE = "sh AS (SELECT variable, l1, l2, 'clinica' AS stratum, COALESCE(clinica, '__missing__') AS bucket, COUNT(*) AS n FROM dis GROUP BY ALL), shr AS (SELECT *, round(n / SUM(n) OVER (PARTITION BY variable, l1, l2), 6) AS share FROM sh)"
_ADJ = f"""{_DIS}, {_SHARE}, items AS (SELECT variable, l1, l2, COUNT(*) AS n FROM dis GROUP BY ALL), mem AS (SELECT variable, list(DISTINCT canonical) AS vals FROM ontology_spec WHERE onto_type = 'enum' GROUP BY 1),
 tax AS (SELECT * FROM (VALUES {_TAX}) t(variable, tags)), mx AS (SELECT variable, l1, l2, max(share) AS share FROM shr GROUP BY ALL),
 adj AS (SELECT variable, l1, l2, n, CASE WHEN n < 10 THEN 'count_below_threshold' WHEN list_contains(vals, l1) AND list_contains(vals, l2) THEN 'canonical_value_inversion' WHEN variable IN {G.BINARY!r} THEN 'canonical_binary_inversion'
  WHEN list_has_any(tags, {list(G.NUMERIC_TAXONOMIES)!r}) THEN 'numeric_variable' WHEN share >= 0.7 THEN 'skew' END AS reason FROM items LEFT JOIN mem USING (variable) LEFT JOIN tax USING (variable) LEFT JOIN mx USING (variable, l1, l2))"""
_LATEST = f"lv AS (SELECT id_key, variable, model, verdict_id, accepted, {_CL.format('value')} AS value FROM cross_verdict QUALIFY row_number() OVER (PARTITION BY id_key, variable, model ORDER BY cached_at DESC NULLS LAST, verdict_id DESC) = 1)"
_CONS = f"""{_LATEST}, cg AS (SELECT id_key, variable, COUNT(*) AS n_models, bool_and(COALESCE(accepted, FALSE)) AS ai, bool_or(COALESCE(accepted, FALSE)) AS oi, COUNT(DISTINCT value) AS nv, min(value) AS v, COUNT(*) FILTER (value IS NULL) AS bl FROM lv GROUP BY ALL),
 cons AS (SELECT id_key, variable, n_models, CASE WHEN ai AND nv = 1 AND bl = 0 THEN 'accepted_cross_verified' WHEN NOT oi THEN 'abstained_by_consensus' ELSE 'split' END AS state, CASE WHEN ai AND nv = 1 AND bl = 0 THEN v END AS value FROM cg)"""
_RUN = "rr AS (SELECT * FROM run_variable QUALIFY row_number() OVER (PARTITION BY contract_id, variable, started_at, run_id ORDER BY manifest_row_id DESC) = 1)"
_W = "OVER (PARTITION BY contract_id, variable ORDER BY started_at, run_id)"
_CELLS3 = " UNION ALL ".join(f"SELECT '{v}' AS field, {_CL.format('ref_' + v)} AS ref, {_CL.format('l1_' + v)} AS l1, {_CL.format('l2_' + v)} AS l2 FROM run_pilot" for v in ("resultado",
        "adequab", "bethesda", "re", "rp", "her2", "ki67"))
_H = lambda seed, key: f"sha256(concat('{seed}|', {key}))"
_SH = lambda t, k: f"SELECT {k}, list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) AS sh FROM (SELECT {k}, regexp_extract_all({sql_normalize('text')}, '[a-z0-9]+') AS w FROM {t}) WHERE len(w) >= 5"
_SPANS = lambda p: f"SELECT pilot_id, CAST(e - length(h) AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM (SELECT pilot_id, i, h, SUM(length(p) + length(h)) OVER (PARTITION BY pilot_id ORDER BY i) AS e FROM (SELECT pilot_id, unnest(hs) AS h, unnest(ps[1:len(hs)]) AS p, generate_subscripts(hs, 1) AS i FROM (SELECT pilot_id, regexp_extract_all(T, '{p}') AS hs, regexp_split_to_array(T, '{p}') AS ps FROM t)))"

ORACLE = {
    "variable_summary": f"WITH {_AB} SELECT variable, COUNT(*) AS n, COUNT(a) AS n_filled, round_even(COUNT(a) / COUNT(*), 4) AS fill_rate, COUNT(b) AS ia_fill, COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, COUNT(*) FILTER (a = b) AS n_agree FROM ab GROUP BY 1",
    "status_distribution": "SELECT variable, COALESCE(status, 'None') AS status, COUNT(*) AS n FROM evidence_record GROUP BY ALL",
    "status_by_clinic": f"SELECT COALESCE({_CL.format('status')}, 'None') AS status, COALESCE({_CL.format('clinica')}, 'None') AS clinica, COUNT(*) AS n FROM evidence_record GROUP BY ALL",
    "resolution_by_year": "SELECT resolution, COALESCE(stratum['ano'], 'None') AS ano, COUNT(*) AS n FROM evidence_record GROUP BY ALL",
    "numeric_ranges": "WITH v AS (SELECT variable, value_num AS x FROM evidence_record WHERE value_num IS NOT NULL AND NOT isnan(value_num)) SELECT variable, min(x) AS lo, max(x) AS hi, COUNT(DISTINCT x) AS n_distinct, list_sort(list(x))[CAST(COUNT(*) // 2 + 1 AS INTEGER)] AS upper_median FROM v GROUP BY 1",
    "gate_escalated": "WITH e AS (SELECT evidence_id, variable, COALESCE(status, 'None') AS status FROM evidence_record WHERE resolution = 'escalated_case'), r AS (SELECT *, row_number() OVER (PARTITION BY variable, status ORDER BY evidence_id) AS k FROM e) SELECT variable, status, COUNT(*) AS n, string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (k <= 3) AS examples FROM r GROUP BY ALL",
    "gate_pairs": f"""WITH {_DIS}, p AS (SELECT variable, l1, l2, COUNT(*) AS n FROM dis GROUP BY ALL), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY variable ORDER BY n DESC, l1, l2) AS INTEGER) AS rank FROM p QUALIFY rank <= 10),
      x AS (SELECT *, row_number() OVER (PARTITION BY variable, l1, l2 ORDER BY evidence_id) AS k FROM dis) SELECT variable, l1, l2, n, rank, string_agg(evidence_id, ',' ORDER BY evidence_id) AS examples FROM t JOIN x USING (variable, l1, l2) WHERE k <= 3 GROUP BY ALL""",
    "gate_strata": f"WITH {_DIS}, {_SHARE} SELECT variable, l1, l2, stratum, bucket, n, share FROM shr",
    "auto_adjudicate": f"WITH {_ADJ} SELECT variable, l1, l2, n, CASE WHEN reason IS NULL THEN 'apply' ELSE 'escalate' END AS decision, reason FROM adj",
    "alias_patch_rerun": f"""WITH {_ADJ}, na AS (SELECT variable, l2, arg_max(l1, (n, l1)) AS canonical FROM adj WHERE reason IS NULL AND (variable, l2) NOT IN (SELECT variable, alias FROM policy_alias WHERE alias IS NOT NULL) GROUP BY ALL)
      SELECT variable, COUNT(*) AS before, COUNT(*) FILTER (COALESCE(canonical, l2) <> l1) AS after FROM dis LEFT JOIN na USING (variable, l2) GROUP BY 1""",
    "verdict_latest": f"WITH {_LATEST} SELECT id_key, variable, model, verdict_id FROM lv",
    "cascade_consensus": f"WITH {_CONS} SELECT * FROM cons",
    "cascade_apply": f"""WITH {_CONS}, t AS (SELECT evidence_id, variable, id_registro AS id_key FROM evidence_record WHERE resolution = 'escalated_case' QUALIFY row_number() OVER (PARTITION BY variable ORDER BY evidence_id) <= 50)
      SELECT evidence_id, variable, CASE WHEN state IS NULL THEN 'cache_miss' WHEN state = 'split' THEN 'escalated_case' ELSE state END AS resolution, value FROM t LEFT JOIN cons USING (id_key, variable)""",
    "silence_suspects": "SELECT variable, COUNT(*) AS n, round(COUNT(*) FILTER (resolution LIKE 'abstained%') / COUNT(*), 6) AS share, round(COUNT(*) FILTER (resolution LIKE 'abstained%') / COUNT(*), 6) >= 0.3 AS suspect FROM evidence_record GROUP BY 1",
    "scope_leaks": f"WITH {_AB}, s AS (SELECT variable, replace(lower(trim(section)), 'ã', 'a') AS s FROM ab WHERE a IS NOT NULL) SELECT variable, s, COUNT(*) AS n FROM s WHERE s <> 'conclusao' GROUP BY ALL",
    "miss_clusters": f"WITH {_AB} SELECT variable, b AS ia, COUNT(*) AS n, min(evidence_id) AS example, round(COUNT(*) FILTER (contains(lower(COALESCE(evidence, '')), lower(b))) / COUNT(*), 6) AS grounded FROM ab WHERE a IS NULL AND b IS NOT NULL GROUP BY ALL",
    "saturation": f"""WITH c AS ({_CELLS3}), g AS (SELECT field, COUNT(*) AS n, COUNT(*) FILTER (l1 <> l2) AS n_disagree, COUNT(*) FILTER (l1 <> l2 AND l1 <> ref) AS e1, COUNT(*) FILTER (l1 <> l2 AND l1 = ref) AS e2, COUNT(*) FILTER (l1 <> l2 AND l1 <> ref AND l2 <> ref) AS am FROM c WHERE ref IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL GROUP BY 1),
      h AS (SELECT *, 100 * (n - n_disagree) / n AS conc, CASE WHEN n_disagree > 0 THEN 100 * e2 / n_disagree ELSE 100.0 END AS sh FROM g)
      SELECT field, n, n_disagree, round_even(conc, 2) AS concordance, round_even(100 * e1 / n, 4) AS l1_error, round_even(sh, 1) AS l2_share, round_even(100 * am / n, 2) AS residual, e1 = 0 AND conc >= 95 AND sh >= 85 AS saturated FROM h""",
    "audit_sample": f"SELECT evidence_id, resolution, clinica, CAST(row_number() OVER (PARTITION BY resolution, clinica ORDER BY {_H(42, 'evidence_id')}, evidence_id) AS INTEGER) AS pick FROM evidence_record WHERE resolution LIKE 'abstained%' OR resolution = 'accepted_exact' QUALIFY pick <= 3",
    "disagreement_sample": f"""WITH {_AB}, k AS (SELECT evidence_id, clinica, CASE WHEN a IS NULL AND b IS NOT NULL THEN 'only_second' WHEN a <> b THEN 'differ' END AS kind, {_H(42, 'evidence_id')} AS h FROM ab),
      s AS (SELECT * FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind, clinica ORDER BY h, evidence_id) <= 5) SELECT evidence_id, kind, clinica FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY h, evidence_id) <= 40""",
    "proportional_sample": f"""WITH c AS (SELECT conjunto, COUNT(*) AS n FROM run_pilot GROUP BY 1), a AS (SELECT conjunto, least(greatest(CAST(round_even(100.0 * n / SUM(n) OVER (), 0) AS INTEGER), 1), n) AS alloc FROM c)
      SELECT pilot_id, conjunto FROM run_pilot JOIN a USING (conjunto) QUALIFY row_number() OVER (PARTITION BY conjunto ORDER BY {_H(42, 'pilot_id')}, pilot_id) <= alloc""",
    "fixed_sample": f"SELECT pilot_id, conjunto FROM run_pilot JOIN (VALUES ('cervical', 40), ('tireoide', 30), ('mama_ihq', 20)) a(conjunto, alloc) USING (conjunto) QUALIFY row_number() OVER (PARTITION BY conjunto ORDER BY {_H(7, 'pilot_id')}, pilot_id) <= alloc",
    "split_70_30": f"SELECT case_no, CASE WHEN row_number() OVER (ORDER BY {_H(42, 'case_no')}, case_no) <= floor(COUNT(*) OVER () * 0.7) THEN 'discovery' ELSE 'evaluation' END AS part FROM regression_case",
    "fill_rate_drift": f"""WITH {_RUN}, x AS (SELECT *, CASE WHEN NOT isnan(fill_rate) THEN fill_rate END AS f, CASE WHEN NOT isnan(agreement_surface) THEN agreement_surface END AS g FROM rr),
      y AS (SELECT run_id, variable, round(f - LAG(f) {_W}, 4) AS df, round(g - LAG(g) {_W}, 4) AS da FROM x), z AS (SELECT *, greatest(-least(COALESCE(df, 0), 0), -least(COALESCE(da, 0), 0)) AS loss FROM y)
      SELECT run_id, variable, df, da, CASE WHEN loss >= 0.15 - 1e-12 THEN 'RED' WHEN loss >= 0.03 - 1e-12 THEN 'YELLOW' ELSE 'GREEN' END AS alert FROM z""",
    "new_statuses": f"""WITH {_RUN}, x AS (SELECT run_id, variable, status_distribution AS s, LAG(status_distribution) {_W} AS b FROM rr), u AS (SELECT run_id, variable, b, unnest(map_entries(s)) AS e FROM x WHERE b IS NOT NULL)
      SELECT run_id, variable, e.key AS status, e.value AS n FROM u WHERE NOT list_contains(map_keys(b), e.key)""",
    "latest_runs": "SELECT contract_id, run_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY started_at DESC, run_id DESC) AS INTEGER) AS age FROM (SELECT DISTINCT contract_id, run_id, started_at FROM run_variable) QUALIFY age <= 2",
    "run_timeline": f"""WITH {_RUN}, a AS (SELECT DISTINCT contract_id, run_id, started_at FROM rr), v AS (SELECT DISTINCT contract_id, variable FROM rr)
      SELECT v.contract_id, v.variable, a.run_id, epoch_us(a.started_at) AS started_us, round(r.fill_rate, 4) AS fill_rate FROM v JOIN a USING (contract_id) LEFT JOIN rr r ON r.contract_id = v.contract_id AND r.variable = v.variable AND r.run_id = a.run_id""",
    "last_known_fill": f"WITH {_RUN} SELECT contract_id, variable, arg_max(fill_rate, (started_at, run_id)) AS fill_rate FROM rr WHERE fill_rate IS NOT NULL AND NOT isnan(fill_rate) GROUP BY ALL",
    "runs_by_prefix": "SELECT contract_id, variable, COUNT(*) AS n, CAST(SUM(n_total) AS BIGINT) AS n_total FROM run_variable WHERE contract_id LIKE 'mama_ihq%' GROUP BY ROLLUP (contract_id, variable)",
    "left_join_texts": "SELECT evidence_id, p.pilot_id, p.versions FROM evidence_record e LEFT JOIN (SELECT caso, max(pilot_id) AS pilot_id, COUNT(*) AS versions FROM run_pilot GROUP BY 1) p ON p.caso = e.id_registro",
    "semi_join_cases": "SELECT variable, COUNT(*) AS n FROM evidence_record WHERE id_registro IN (SELECT caso FROM run_pilot WHERE no_desenvolvimento) GROUP BY 1",
    "resume_anti_join": "SELECT evidence_id FROM evidence_record e WHERE NOT EXISTS (SELECT 1 FROM cross_verdict v WHERE v.id_key = e.id_registro AND v.variable = e.variable)",
    "orphan_counts": "WITH a AS (SELECT DISTINCT variable, id_registro AS k FROM evidence_record), b AS (SELECT DISTINCT variable, id_key AS k FROM cross_verdict) SELECT COALESCE(a.variable, b.variable) AS variable, COUNT(*) FILTER (b.k IS NULL) AS only_cells, COUNT(*) FILTER (a.k IS NULL) AS only_verdicts, COUNT(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM a FULL JOIN b ON a.variable = b.variable AND a.k = b.k GROUP BY 1",
    "nearest_earlier_event": "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near_event_id FROM events",
    "span_exclusion": f"WITH t AS MATERIALIZED (SELECT pilot_id, {sql_normalize('laudo')} AS T FROM run_pilot), a AS ({_SPANS(MEASURE)}), b AS ({_SPANS(TAKEN)}) SELECT pilot_id, s AS start_at, e AS end_at FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pilot_id = a.pilot_id AND a.s < b.e AND b.s < a.e)",
    "development_overlap": f"""WITH x AS MATERIALIZED ({_SH('(SELECT pilot_id, laudo AS text FROM run_pilot)', 'pilot_id')}), f AS (SELECT pilot_id, COALESCE(no_desenvolvimento, FALSE) AS dev FROM run_pilot), a AS (SELECT x.* FROM x JOIN f USING (pilot_id) WHERE NOT dev), b AS (SELECT x.* FROM x JOIN f USING (pilot_id) WHERE dev),
      p AS (SELECT a.pilot_id, len(list_intersect(a.sh, b.sh)) AS c, len(a.sh) + len(b.sh) AS t FROM a, b) SELECT pilot_id, COUNT(*) AS n_links, round(max(c / (t - c)), 6) AS best FROM p WHERE c / (t - c) >= 0.8 GROUP BY 1""",
    "set_difference": "SELECT DISTINCT caso AS k FROM run_pilot EXCEPT SELECT DISTINCT id_key FROM cross_verdict",
    "set_union_sizes": "WITH a AS (SELECT DISTINCT id_key FROM cross_verdict WHERE model = 'verif-a'), b AS (SELECT DISTINCT id_key FROM cross_verdict WHERE model = 'verif-b') SELECT (SELECT COUNT(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_union, (SELECT COUNT(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_common",
    "checkpoint_last_wins": "SELECT id_registro, variable, arg_max(evidence_id, (written_at, evidence_id)) AS evidence_id, arg_max(resolution, (written_at, evidence_id)) AS resolution, COUNT(*) AS n FROM evidence_record GROUP BY ALL",
}
