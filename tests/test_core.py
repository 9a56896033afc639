"""Golden rows and brute force for text primitives, detectors, policy, joins, samples, sources and the sandbox."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lauda.functions import derived as V2
from lauda.functions import detectors as D
from lauda.functions import text as X
from lauda.functions.rules import Cascade
from lauda.functions.stats import exact_interval
from lauda.operators import gates as G
from lauda.operators import joins as J
from lauda.operators import policy as P
from lauda.operators import review as V
from lauda.operators import sampling as S
from lauda.operators import sandbox as B
from lauda.operators.range_scan import prefix_sums, with_last_before
from lauda.operators.topk import top_per_group
from lauda.plans import contract as K
from lauda.sources import files, sinks


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())],
        ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k,
            v in cols.items())).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [("Les&atilde;o||de\r\n\tRETO", "lesao . de reto"), ("ÇÃO\u00a0 Ü", "cao u"), (None, ""), ("", ""),
        ("a&#13;&#10;b", "a b"), ("A<br>B&nbsp;C", "a b c"), ("º ª", "o a")],
)
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize(F.col("t")), t=raw).rstrip() == want


def test_sections(spark):
    t = "dor. [conclusao] polipo. comentarios: nada"
    got = one(spark, X.sections(F.col("t")), t=t)
    assert [(b["section"], t[b["start"] : b["end"]]) for b in got] == [("inicio", "dor. "), ("conclusao", " polipo. "),
        ("comentarios", " nada")]
    assert [b["section"] for b in one(spark, X.sections(F.col("t")), t="sem nada")] == ["corpo"]
    assert one(spark, X.in_priority(X.sections(F.col("t")), ("conclusao", "inicio")), t=t)["section"] == "conclusao"


def test_windows_sentences_and_numbers(spark):
    t = "Um. Nao ha polipo em reto. Fim"
    s = X.first_start(F.col("t"), "polipo")
    assert one(spark, s, t=t) == 11 and one(spark, X.window(F.col("t"), s, F.lit(6), 4), t=t) == "ha polipo em"
    assert one(spark, X.sentence(F.col("t"), s, F.lit(6)), t=t) == "Nao ha polipo em reto"
    assert one(spark, X.all_starts(F.col("t"), F.lit("aa")), t="aaaa") == [0, 1, 2] and one(spark,
        X.occurrences(F.col("t"), F.lit("aa")), t="aaaa") == 2
    assert one(spark, X.number_of(F.col("t")), t="vinte") == 20 and one(spark, X.number_of(F.col("t")),
        t="7 linfonodos") == 7 and one(spark, X.number_of(F.col("t")), t="x") is None
    assert one(spark, X.measure_mm(F.col("t")), t="1,5 x 2 cm") == 20.0 and one(spark, X.measure_mm(F.col("t")),
        t="15 mm") == 15.0
    assert [one(spark, X.interval_label(F.col("n"), F.col("u")), n=n, u=u) for n,
        u in ((2, "semanas"), (36, "horas"), (1, "ano"), (6, "meses"), (3, "luas"))] == ["14_dias", "2_dias", "1_ano", "6_meses",
        None]
    assert one(spark, X.cut_commentary(F.col("t")), t="a nota: b comentarios c") == "a nota: b "


@pytest.mark.parametrize(
    "det, text, want",
    [
        (D.BETHESDA, "citologia classificada como bethesda categoria iv", "IV"),
        (D.BETHESDA, "categoria ii do sistema bethesda", "II"), (D.BETHESDA, "bethesda 3, puncao", "III"),
        (D.BETHESDA, "sem categoria", None),
        (D.RESULTADO, "lesao intraepitelial escamosa de alto grau", "HSIL"),
        (D.RESULTADO, "nao se pode excluir lesao de alto grau; celulas escamosas atipicas de significado indeterminado", "ASC_H"),
        (D.RESULTADO, "negativo para lesao intraepitelial", "NILM"),
        (D.ADEQUAB, "amostra insatisfatoria", "insatisfatoria"),
        (D.ADEQUAB, "satisfatoria, porem limitada", "satisfatoria_limitada"),
        (D.RE, "receptor de estrogenio negativo", "negativo"), (D.RP, "rp (pgr): forte positivo", "positivo"),
        (D.HER2_SCORE, "her2 com escore 2+, controle", "2+"), (D.HER2_STATUS, "her2 com escore 0, controle", "negativo"),
        (D.MARGENS, "margens livres", "livres"), (D.MARGENS, "margens comprometidas, margens livres", "comprometidas"),
        (D.POLIPO, "polipo sessil em ceco", "sim"), (D.POLIPO, "ausencia de polipos", "nao"),
        (D.LA_GRAU, "esofagite grau b de los angeles", "B"), (D.LA_GRAU, "sem sinais de esofagite", "sem_esofagite"),
        (D.HERNIA, "sem evidencia de hernia hiatal", "nao"),
        (D.INTERVALO, "recomenda-se novo exame em 6 meses", "6_meses"), (D.NECROSE, "infiltrado, sem necrose", "nao"),
        (D.INV_LINFOV, "invasao angiolinfatica presente", "sim"), (D.METAPLASIA, "ausencia de metaplasia intestinal", "nao"),
        (D.OLGA, "olga ii", "II"),
    ],
)
def test_cascades(spark, det, text, want):
    got = one(spark, det.column(F.col("t")), t=text)
    assert got["value"] == want and (got["span_start"] is None or text[got["span_start"] :])


def test_numbers_and_labels(spark):
    assert one(spark, D.KI67.column(F.col("t")), t="ki-67 em cerca de 78% das celulas") == 78 and one(spark,
        D.KI67.column(F.col("t")), t="ki67: 10 a 21%") == 15
    assert one(spark, D.RE_PCT.column(F.col("t")), t="re (6f11): positivo em 30% e 50%") == 40 and one(spark,
        D.RE_PCT.column(F.col("t")), t="re: negativo") == 0
    assert one(spark, D.BBPS.column(F.col("t")), t="preparo bom, boston 7.") == 7 and one(spark,
        D.RE_ALLRED.column(F.col("t")), t="re: positivo. allred: 11") is None
    assert one(spark, D.ORGANISMOS.column(F.col("t")), t="flora mista com candida e lactobacilos") == "lactobacilos;candida"
    assert all(isinstance(x, (Cascade,)) or x.name for s in D.SETS.values() for x in s)


POLICY = "value string, status string, onto_type string, vals array<string>, lo double, hi double, aliases map<string,string>, default_if_silent string, implicit_negative boolean, abstention_statuses array<string>"


@pytest.mark.parametrize(
    "value, status, pol, want",
    [
        ("sim", None, ("enum", ["sim", "nao"], None, None, {"s": "sim"}, "nao", True, ["amb"]), ("accepted_exact", "sim")),
        ("s", None, ("enum", ["sim", "nao"], None, None, {"s": "sim"}, "nao", True, ["amb"]), ("accepted_semantic", "sim")),
        ("talvez", None, ("enum", ["sim"], None, None, None, None, None, None), ("escalated_case", "talvez")),
        (None, None, ("enum", ["sim"], None, None, None, "nao", True, None), ("accepted_exact", "nao")),
        (None, None, ("enum", ["sim"], None, None, None, "nao", False, None), ("abstained_source_incomplete", None)),
        ("sim", "amb", ("enum", ["sim"], None, None, None, None, None, ["amb"]), ("abstained_unsupported", None)),
        ("5.0", None, ("float", [], 0.1, 100.0, None, None, None, None), ("accepted_exact", "5.0")),
        ("500", None, ("float", [], 0.1, 100.0, None, None, None, None), ("escalated_case", "500")),
        ("nan", None, ("float", [], 0.1, 1.0, None, None, None, None), ("escalated_case", "nan")),
        ("x", None, (None, None, None, None, None, None, None, None), ("accepted_exact", "x")),
    ],
)
def test_policy_table(spark, value, status, pol, want):
    r = spark.createDataFrame([(value, status, *pol)],
        POLICY).select(P.apply_policy(F.col("value"), F.col("status")).alias("r")).first()["r"]
    assert (r["resolution"], r["normalized"]) == want


@pytest.mark.parametrize(
    "value, ev, s, e, want",
    [
        ("4", "mede 4 mm.", 2, 11, "offset_exact"), ("4", "MEDE  4 mm", 2, 11, "offset_normalized"),
        ("4", "mede", -1, -1, "substring"), ("4", "a mede 4 mm no reto e mais", -1, -1, "prefix"),
        ("4", "outra coisa", 0, 3, "evidence_not_in_text"),
        ("4", None, None, None, "value_without_evidence"), (None, None, None, None, "silence"),
        ("4", " . ", 0, 1, "empty_evidence"),
    ],
)
def test_evidence(spark, value, ev, s, e, want):
    df = spark.createDataFrame([(value, ev, "high", "a mede 4 mm no reto e ceco", s, e)],
        "v string, ev string, c string, t string, s int, e int")
    assert df.select(P.verify_evidence(F.col("v"), F.col("ev"), F.col("c"), F.col("t"), F.col("s"),
            F.col("e")).alias("r")).first()["r"]["reason"] == want


def test_ranks_and_samples_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(50)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, x int")
    got = {(r["g"], r["rank"], r["id"]) for r in top_per_group(df, ["g"], [F.desc("x"), F.col("id")], 4, "id").collect()}
    want = set()
    for g, rs in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]):
        want |= {(g, k + 1, r[0]) for k, r in enumerate(sorted(rs, key=lambda r: (-r[2], r[0]))[:4])}
    assert got == want
    parts = S.split(df, "id", 0.7).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"discovery": 420, "evaluation": 180}
    assert S.split(df.where("false"), "id", 0.7).count() == 0
    assert {r["id"] for r in S.stratified(df, ["g"], "id", 2,
            seed=1).collect()} == {r["id"] for r in S.stratified(df.orderBy("x"), ["g"], "id", 2, seed=1).collect()}


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefgh") * 3 for _ in range(40)] for _ in range(12)]
    texts = []
    for i in range(90):
        w = list(base[i % 12])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(40)] = "zzz"
        texts.append((i, " ".join(w)))
    texts += [(200, ""), (201, "so tres palavras")]
    df = spark.createDataFrame(texts, "id long, t string").select("id", X.shingles(F.col("t"), 5).alias("sh"))
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in J.similar_texts(df.select(F.col("id").alias("a"), "sh"),
            df.select(F.col("id").alias("b"), "sh"), "a", "b", 0.8).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]),
            9) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 90


def test_spans_and_nearest(spark):
    t = "5 mm e 12 x 4 x 3 mm, 7 mm"
    r = one(spark, J.outside(J.spans_of(F.col("t"), r"\d+ mm"), J.spans_of(F.col("t"), r"\d+ x \d+ x \d+ mm")), t=t)
    assert [t[s["start"] : s["end"]] for s in r] == ["5 mm", "7 mm"]
    df = spark.createDataFrame([(1, "u", 1, "a"), (2, "u", 2, "b"), (3, "u", 3, "a"), (4, "v", 1, "b")],
        "id long, u string, ts int, k string")
    assert {r["id"]: r["near_id"] for r in J.nearest_before(df, ["u"], ["ts", "id"], F.col("k") == "a",
            ["id"]).collect()} == {1: None,
        2: 1, 3: 1, 4: None}


def test_guards_of_adjudication(spark):
    items = spark.createDataFrame([("v", "a", "b", 20, 0.1), ("v", "a", "x", 9, 0.1), ("v", "a", "y", 20, 0.71),
            ("polipo_presente", "p", "q", 50, 0.1), ("n", "1", "2", 50, 0.1), ("v", "a", "z", 40, 0.3)],
        "variable string, l1 string, l2 string, n long, share double")
    members = spark.createDataFrame([("v", ["a", "b"])], "variable string, vals array<string>")
    tags = spark.createDataFrame([("n", ["NUM-C"])], "variable string, tags array<string>")
    got = {(r["variable"], r["l2"]): r["reason"] for r in G.adjudicate(items, members, tags).collect()}
    assert got == {("v", "b"): "canonical_value_inversion", ("v", "x"): "count_below_threshold", ("v", "y"): "skew",
        ("polipo_presente", "q"): "canonical_binary_inversion", ("n", "2"): "numeric_variable", ("v", "z"): None}


def test_exact_intervals():
    assert exact_interval(4, 189) == (0.6, 5.3) and exact_interval(0, 100) == (0.0, 3.6) and exact_interval(11, 130) == (4.3,
        14.6) and exact_interval(5, 5)[1] == 100.0 and exact_interval(0, 0) == (None, None)


def test_contract_checks():
    good = json.dumps({"contract": {"id": "c"},
            "corpus": {"id_column": "id", "text_column": "t", "strata_columns": ["s", "id"]},
            "variables": [{"name": "a", "criticality": 7, "comparison_column": "z"}]})
    c = K.load_contract(good)
    assert c.columns() == ["id", "t", "s",
        "z"] and c.variable("a").criticality == 7 and K.band(7) == "CRITICA" and len(c.hash) == 64 and "mode A" in c.summary()
    for bad in ({"variables": []}, {"variables": [{"name": "a"}, {"name": "a"}]},
        {"variables": [{"name": "a", "criticality": 11}]}, {"variables": [{"name": "a", "mode": "C"}]},
        {"corpus": {"id_column": "x"}}):
        with pytest.raises(ValueError):
            K.load_contract(json.dumps(json.loads(good) | bad))
    with pytest.raises(KeyError):
        c.variable("zz")


def test_registry(spark):
    text = json.dumps({"policies": {"v": {"ontology": {"type": "range", "min": 0, "max": 8}},
                "b": {"output_ontology": {"type": "enum", "values": ["I", "II"]}, "vocabulary_aliases": {"1": "I"}}}})
    rows = {r["variable"]: r for r in K.registry_table(spark, K.load_registry(text)).collect()}
    assert (rows["v"]["onto_type"], rows["v"]["hi"]) == ("float", 8.0) and rows["b"]["aliases"] == {"1": "I"}
    with pytest.raises(ValueError):
        K.load_registry(json.dumps({"policies": {"v": {}}}))


def test_sources_fail_closed(spark, tmp_path):
    case = {"id": "a", "kind": "synthetic_canary", "text": "x"}
    f = tmp_path / "cases.jsonl"
    f.write_text(json.dumps(case) + "\n\n")
    df, sha = files.regression_set(spark, str(f))
    assert df.count() == 1 and len(sha) == 64
    for bad in ("{nope", json.dumps(case) + "\n" + json.dumps(case), json.dumps(case | {"kind": "x"}),
        json.dumps(case | {"text": " "}), json.dumps(case | {"kind": "metamorphic_invariance"}), ""):
        f.write_text(bad + "\n")
        with pytest.raises(ValueError):
            files.regression_set(spark, str(f)) if bad else files.regression_set(spark, str(f))
    f.write_text('{"k": 1, "v": "a"}\nbroken\n{"k": 1, "v": "b"}\n')
    lines = files.json_lines(spark, str(f), "k long, v string")
    assert lines.count() == 2 and files.last_wins(lines.withColumn("n", F.monotonically_increasing_id()), ["k"],
        ["n"]).first()["v"] == "b"
    (tmp_path / "c.csv").write_text('id,t,x\n1,"a ""q""\nb",\n2,c,NA\n')
    assert [tuple(r) for r in files.corpus_csv(spark, str(tmp_path / "c.csv"), ["id", "t"], limit=1).collect()] == [("1",
            'a "q"\nb')]
    assert files.all_text_csv(spark, str(tmp_path / "c.csv")).where("x IS NULL").count() == 2
    with pytest.raises(ValueError):
        files.corpus_csv(spark, str(tmp_path / "c.csv"), ["id", "zz"])


def test_reports():
    svg = sinks.sparkline([1.0, None, 2.0, 3.0])
    assert svg.count("<polyline") == 2 and sinks.sparkline([]).startswith("<svg") and sinks.bars(["a<b"], [2]).count("&lt;") == 1
    assert sinks.cards_jsonl([{"b": 1, "a": "é"}]) == '{"a": "é", "b": 1}\n'


def test_sandbox(spark):
    r = B.rule_of("SUBJ de N UNIT", "mm")
    assert one(spark, B.skeleton(B.skeleton_tokens(F.col("t"), "mm")),
        t="polipo sessil medindo cerca de 5mm em reto") == "SUBJ SUBJ MEASURE CIRCA de N UNIT em"
    assert one(spark, F.regexp_extract(F.col("t"), r, 1), t="polipo de 12 mm") == "12" and one(spark, B.lane(F.col("t")),
        t="ulcera de 5 mm") == "negative" and one(spark, B.lane(F.col("t")), t="polipo 3 x 4 mm") == "multidim"
    p = B.Proposal("r", "v", r"(\d+) mm", forbidden="pinca")
    assert one(spark, B.overlay(F.col("t"), F.lit(None).cast("double"), p),
        t="lesao de 5 mm. pinca de 9 mm. outra 7 mm") == 7.0 and one(spark, B.overlay(F.col("t"), F.lit(3.0), p), t="5 mm") == 3.0
    ok = dict(rule_id="r", family_coverage=None, high_risk=False, canaries_failed=0, target_rate=0.85, near_miss_changed=0,
        regressed=0, site_share=0.9)
    rows = [ok, ok | {"target_rate": 0.7}, ok | {"regressed": 1}, ok | {"high_risk": True}, ok | {"family_coverage": 0.05},
        ok | {"target_rate": None, "site_share": None}, ok | {"canaries_failed": 2, "target_rate": 0.7}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows],
        "rule_id string, family_coverage double, high_risk boolean, canaries_failed int, target_rate double, near_miss_changed int, regressed int, site_share double")
    got = [(r["status"], r["failed"], r["skewed"]) for r in B.evaluated(df).collect()]
    assert got == [("approved_for_review", None, True), ("refine", "B2_target", True), ("rejected", "B4_regression", True),
        ("refine", "B2_target", True), ("rejected", "B0_family", True), ("rejected", "B2_target", False),
        ("rejected", "B1_canaries", True)]
    assert B.jaccard_families(["polipo sessil reto", "polipo sessil ceco", "nada igual aqui"]) == 2


def test_review_log(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, 10, "a", t), (2, 10, None, t + dt.timedelta(1)), (3, 11, "b", t), (4, 11, "c", t)],
        "label_id long, doc_id long, lab string, at timestamp")
    sample = spark.createDataFrame([(10,), (11,), (12,)], "doc_id long")
    s = V.review_state(sample, log, "doc_id", "lab", ["at", "label_id"])
    assert {r["doc_id"]: (r["lab"], r["done"]) for r in s.collect()} == {10: (None, False), 11: ("c", True), 12: (None, False)}
    assert tuple(V.progress(s, "doc_id").first()) == (3, 1, 10)


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_range_scans_equal_brute_force(spark, parts):
    """Also inside a union, where a task's number isn't its partition's."""
    rng = random.Random(11)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(200), rng.choice([0, 0, 0, 1])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, t int, m int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    near = with_last_before(df, ["g"], ["t", "id"], ["id"], F.col("m") == 1).select("id", F.col("prev.id").alias("p"))
    cum = prefix_sums(df, ["g"], ["t", "id"], "m").select("id", F.col("cum").alias("p"))
    got = {(r["k"], r["id"]): r["p"] for r in near.withColumn("k",
            F.lit("near")).unionByName(cum.withColumn("k", F.lit("cum"))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    last, total, want = {}, {}, {}
    for i, g, t, m in sorted(rows, key=lambda r: (r[1] or "", r[2], r[0])):
        want[("near", i)], total[g] = last.get(g), total.get(g, 0) + m
        want[("cum", i)] = total[g]
        if m:
            last[g] = i
    assert got == want
    assert with_last_before(df.where("false"), ["g"], ["t", "id"], ["id"]).count() == 0


def test_dashboard(spark):
    t = dt.datetime(2024, 1, 1)
    pts = spark.createDataFrame([("c", "v", "r1", t, 0.5), ("c", "v", "r2", t + dt.timedelta(1), None), ("d", "v", "r3", t, 0.1)],
        "contract_id string, variable string, run_id string, started_at timestamp, fill_rate double")
    html = sinks.dashboard(pts, "T<", "c")
    assert "1 of 2" in html and "T&lt;" in html


@pytest.mark.parametrize(
    "text, want",
    [
        ("polipo sessil de 5 mm em reto", 5.0), ("polipo de 5 mm e outro polipo de 1,2 cm", 12.0),
        ("ulcera de 20 mm. polipo medindo 4 mm", 4.0), ("3 mm, polipo em ceco", 3.0), ("tumor de 30 mm", None),
        ("polipo menor que 5 mm", None),
        ("polipo com 7 x 5 x 3 mm", 7.0), ("polipo a 15 cm da borda anal", None), ("polipo de 900 mm", None), ("", None),
        ("sem medidas", None), ("polipo " + "x" * 300 + " 8 mm", None),
    ],
)
def test_polyp_size(spark, text, want):
    assert one(spark, V2.polyp_size(F.col("t")), t=text) == want


def test_molecular_table(spark):
    rows = [("positivo", None, "negativo", 19, "luminal_a"), ("negativo", "positivo", "negativo", 20, "luminal_b_her2neg"),
        ("positivo", "positivo", "positivo", 1, "luminal_b_her2pos"), ("positivo", None, "negativo", None, "luminal"),
            ("negativo", "negativo", "positivo", 1, "her2_enriched"),
            ("negativo", "negativo", "negativo", 1, "triplo_negativo"), (None, None, "negativo", 1, None),
            ("positivo", None, "equivoco", 1, None), ("negativo", None, "negativo", 1, None)]
    df = spark.createDataFrame(rows, "a string, b string, h string, k int, want string")
    assert df.where(~V2.molecular_subtype(F.col("a"), F.col("b"), F.col("h"), F.col("k")).eqNullSafe(F.col("want"))).count() == 0
    t = spark.createDataFrame([("CDIS", "in_situ", "nao", "sim"), ("CLI", "invasivo", "sim", "sim"),
            ("fibroadenoma", "benigno", "nao", "nao"), (None, None, None, None)],
        "t string, b string, i string, m string")
    c = F.col("t")
    assert t.where(V2.behavior_class(c).eqNullSafe(F.col("b")) & V2.invasive_malignancy(c).eqNullSafe(F.col("i")) & V2.malignancy_any(c).eqNullSafe(F.col("m"))).count() == 4


def test_stream_resumes_where_it_ended(spark, tmp_path):
    from lauda.streaming.live import resolve_stream

    pol = spark.createDataFrame([("v", "enum", ["a"], None, None, None, None, None, None)],
        "variable string, onto_type string, vals array<string>, lo double, hi double, aliases map<string,string>, default_if_silent string, implicit_negative boolean, abstention_statuses array<string>")
    put = lambda ids: spark.createDataFrame([(i, "v", "a" if i % 2 else "z", None) for i in ids],
        "evidence_id long, variable string, value string, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(range(5))
    first = resolve_stream(spark, str(tmp_path / "in"), pol, str(tmp_path / "out")).count()
    put(range(5, 9))
    for _ in range(2):  # the second time nothing has arrived
        rows = resolve_stream(spark, str(tmp_path / "in"), pol, str(tmp_path / "out")).collect()
    assert first == 5 and sorted(r["evidence_id"] for r in rows) == list(range(9))
    assert {r["evidence_id"]: r["resolution"] for r in rows}[7] == "accepted_exact" and {r["evidence_id"]: r["resolution"] for r in rows}[8] == "escalated_case"
