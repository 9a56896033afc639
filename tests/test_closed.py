"""Detector driver, verifiers, gate files, registry, rule cards and further detectors on awkward rows."""

import dataclasses
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lauda.functions import derived as V
from lauda.functions import detectors as D
from lauda.functions import text as X
from lauda.operators import cascade as C
from lauda.operators import driver as R
from lauda.operators import gates as G
from lauda.operators import sandbox as B
from lauda.operators.policy import canonical_value
from lauda.plans import contract as K


def value(spark, col, **cells):
    df = spark.createDataFrame([tuple(cells.values())],
        ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in cells.items()))
    return df.select(col.alias("x")).first()["x"]


def var(name="v", detector="first", **more):
    return K.Variable(name, detector, **more)


@dataclasses.dataclass
class Found:
    score: float
    span_start: int
    state: str = "ok"


def test_whatever_a_function_returns_is_one_row():
    assert R.adapt(None) == dict.fromkeys(R.FIELDS)
    assert R.adapt(("a", "x" * 500, "corpo")) == dict.fromkeys(R.FIELDS) | {"value": "a", "evidence": "x" * 200,
        "section": "corpo"}
    assert R.adapt({"value": 3, "span_end": 7, "other": 1})["value"] == "3" and R.adapt({"value": 3,
            "span_end": 7})["span_end"] == 7
    got = R.adapt(Found(2.5, 4), var(value_field="score", status_field="state"))
    assert (got["value"], got["status"], got["span_start"]) == ("2.5", "ok", 4)
    assert R.adapt(float("nan"))["value"] is None and R.adapt("sim")["value"] == "sim" and R.adapt((None, None))["value"] is None


def test_user_functions_over_a_corpus(spark):
    def picky(t):
        if "!" in t:
            raise OSError(t)
        return {"value": t.upper(), "status": "seen"} if t else None

    rows = [(1, "a", "x", "k"), (2, "no!", "x", "k"), (3, None, None, "k"), (3, None, None, "k"), (4, "b" * 100_000, "y", "k")]
    df = spark.createDataFrame(rows, "id long, text string, clinica string, value string")
    got = [tuple(r) for r in R.run_variable(df, var(), "id", "text", ("clinica",), function=picky).select("id", "clinica",
            "variable", "status", F.length("value")).collect()]
    assert sorted(got,
        key=str) == sorted([(1, "x", "v", "seen", 1), (2, "x", "v", "ERROR:OSError", None), (3, None, "v", None, None),
            (3, None, "v", None, None), (4, "y", "v", "seen", 100_000)],
        key=str)
    done = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    assert {r["id"] for r in R.run_variable(df, var(), "id", "text", done=done, function=picky).collect()} == {2, 4}
    assert R.run_variable(df.where("false"), var(), "id", "text", function=picky).count() == 0
    # a rule gives the same form of row; so does a name that nothing stands behind
    one = R.run_variable(df.withColumn("text", F.lit("NILM")), var("r", "resultado"), "id", "text", ("clinica",))
    assert one.columns == R.run_variable(df, var(), "id", "text", ("clinica",),
        function=picky).columns and {r["value"] for r in one.collect()} == {"NILM"}
    assert {r["status"] for r in R.run_variable(df, var("r", "nothing"), "id", "text").collect()} == {"ERROR:KeyError"}


def test_canaries_and_missing_variables(spark):
    c = K.load_contract(json.dumps({"contract": {"id": "c"}, "corpus": {"id_column": "id", "text_column": "t"}, "variables": [
        {"name": "k", "detector": "ki67_pct",
            "canaries": [{"text": "Ki-67: 20%", "expected_value": "20,0"}, {"text": None, "expected_value": None},
                {"text": "Ki-67: 30%", "expected_value": 20}]},
        {"name": "n", "detector": "resultado"}]}))
    got = {r["canary"]: (r["got"], r["passed"], r["passed_as_number"]) for r in R.run_canaries(spark, c).collect()}
    assert got == {0: ("20", False, True), 1: (None, True, True), 2: ("30", False, False)}
    assert R.missing_variables(c, ["x", "k", "y", "x"]) == ["x", "y"]
    with pytest.raises(KeyError, match="x"):
        R.run_contract(spark.createDataFrame([(1, "a")], "id int, t string"), c, ["x"])
    assert R.run_canaries(spark, dataclasses.replace(c, variables=c.variables[1:])).count() == 0
    assert value(spark, canonical_value(F.col("a")), a="HSIL") == "hsil" and value(spark, canonical_value(F.col("a")),
        a="5,00") == value(spark, canonical_value(F.col("a")), a="5")


def test_answers_are_checked(spark):
    t = dt.datetime(2024, 1, 1)
    v = [("c1", "v", "m", True, "sim", "Pólipo  sessil", t, 1), ("c2", "v", "m", True, "talvez", "x", t, 2),
        ("c3", "v", "m", True, "sim", "nunca dito", t, 3), ("c4", "v", "m", False, "sim", "x", t, 4),
         ("c5", "v", "m", True, "nao_mencionado", None, t, 5), ("c6", "v", "m", True, " ", None, t, 6),
         ("c7", "v", "other", True, "sim", "x", t, 7), ("c1", "v", "m", False, "nao", "old", t - dt.timedelta(1), 8),
         ("c8", "w", "m", True, "livre", "texto", t, 9), ("c9", "v", "m", True, "sim", "", t, 10)]
    verdicts = spark.createDataFrame(v,
        "id_key string, variable string, model string, accepted boolean, value string, evidence string, cached_at timestamp, verdict_id long")
    cells = spark.createDataFrame([(i, f"c{i}", "w" if i == 8 else "v") for i in range(1, 10)],
        "evidence_id long, id_key string, variable string")
    texts = spark.createDataFrame([(f"c{i}", "Um pólipo sessil. Texto x." if i != 9 else None) for i in range(1, 10)],
        "id_key string, text string")
    onto = spark.createDataFrame([("v", ["sim", "nao"])], "variable string, vals array<string>")
    got = {r["evidence_id"]: (r["accepted"], r["value"], r["reason"]) for r in C.verifier("model", verdicts, "m", texts,
            onto)(cells).collect()}
    assert got == {1: (True, "sim", "ok"), 2: (False, None, "not_in_ontology"), 3: (False, None, "quote_not_in_text"),
        4: (False, None, "rejected"), 5: (False, None, "abstained"), 6: (False, None, "no_value"),
        7: (False, None, "cache_miss:v"), 8: (True, "livre", "ok"), 9: (False, None, "quote_not_in_text")}
    assert {r["reason"] for r in C.verifier("none")(cells).collect()} == {"no_verifier"}
    assert {r["evidence_id"]: r["accepted"] for r in C.verifier("stub", verdicts)(cells).collect()}[7]
    assert {r["evidence_id"] for r in C.verifier("consensus", verdicts)(cells).where("accepted").collect()} == {1, 2, 3, 5, 7,
        8, 9}
    with pytest.raises(ValueError, match="magic"):
        C.verifier("magic")
    ev = spark.createDataFrame([(i, "escalated_case" if i % 2 else "ok", "c", "v") for i in range(9, 0, -1)],
        "evidence_id long, resolution string, id_registro string, variable string")
    assert [r["evidence_id"] for r in C.first_cells(ev, 3).collect()] == [1, 3, 5] and C.first_cells(ev, None).count() == 5


def test_pair_keys_with_quotes(spark):
    pairs = [("a", "b"), ("it's", "x"), ('"q"', "y"), ("both ' and \"", "z"), (None, "b"), ("", "vs IA='x'"), ("a\nb", "c")]
    df = spark.createDataFrame(pairs, "l1 string, l2 string").withColumn("k",
        G.pair_key(F.col("l1"), F.col("l2"))).withColumn("p", G.parse_pair(F.col("k")))
    for r in df.collect():
        assert (r["p"]["l1"] or None, r["p"]["l2"]) == (r["l1"] or None, r["l2"]), r
    assert value(spark, G.pair_key(F.col("a"), F.col("b")), a="x", b="y") == "L1='x' vs IA='y'"
    assert tuple(value(spark, G.parse_pair(F.col("a")), a="nonsense")) == (None, None)


def test_gate_files_and_registry(spark, tmp_path):
    checks = spark.createDataFrame([("a", "error", "no policy"), ("b", "warning", "ontologies differ")],
        "variable string, severity string, message string")
    ev = spark.createDataFrame([(i, "v", "c", "x" if i < 5 else "y", "z" if i != 9 else None, "escalated_case",
                None if i % 2 else "s") for i in range(10)],
        "evidence_id long, variable string, clinica string, value string, ia string, resolution string, status string")
    items = G.gate1_items(checks).unionByName(G.gate2_items(ev))
    assert G.write_gates(items, str(tmp_path / "g")) == {"gate1": 2, "gate2": 4, "blocking": 1}
    back = G.read_gates(spark, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in back.select("item_id", "key",
            "n").collect()) == sorted(tuple(r) for r in items.select("item_id", "key", "n").collect())
    assert [tuple(r) for r in G.gate_summary(items, 2).collect()] == [("v", "disagreement", "L1='x' vs IA='z'", 5),
        ("v", "escalated", "None", 5)]
    assert G.write_gates(items.where("false"), str(tmp_path / "none")) == {"gate1": 0, "gate2": 0, "blocking": 0}
    registry = json.dumps({"policies": {"v": {"ontology": {"type": "enum", "values": ["x"]}, "vocabulary_aliases": {"k": "x"}}}})
    path = tmp_path / "registry.json"
    path.write_text(registry)
    assert G.rewrite_registry(spark, str(path), [("v", "z", "x"), ("v", "k", "other")], [("v", "silent")],
        [("v", "x"), ("v", "y")]) == 3
    new = K.load_registry(path.read_text())[0]
    assert new["aliases"] == {"k": "x", "z": "x"} and new["vals"] == ["x", "y"] and new["abstention_statuses"] == ["silent"]
    assert (tmp_path / "registry.json.bak").read_text() == registry
    assert G.rewrite_registry(spark, str(path), [("v", "z", "x")]) == 0
    with pytest.raises(KeyError):
        G.patch_registry(registry, [("nope", "a", "b")])


def test_cards(spark):
    rows = [(i, "v", "A" if i % 4 else "B", "5", "polipo medindo 5 mm", "mm") for i in range(12)] + [(20, "v", None, "5",
            "nada", "mm"),
        (21, "v", None, "6", "ulcera de 6 mm", "mm"), (22, "v", None, "6", "polipo 3 x 6 mm", "mm")]
    m = spark.createDataFrame(rows, "evidence_id long, variable string, clinica string, ia string, T string, unit string")
    got = {(r["lane"], r["skeleton"]): r for r in B.family_cards(m, "T", F.col("unit"), "ia", "evidence_id").collect()}
    card = got[("positive", "SUBJ MEASURE N UNIT")]
    assert card["n"] == 12 and card["coverage"] == round(12 / 13,
        6) and card["n_families"] == 2 and card["usable"] and card["n_discovery"] + card["n_evaluation"] == 12
    assert got[("positive", "")]["family_id"] == "pf_noanchor" and not got[("positive",
            "")]["usable"] and not got[("negative", "")]["usable"] and len(got) == 4
    c = {r["cluster"]: r for r in B.cluster_cards(m, "ia", "clinica", "evidence_id").collect()}
    assert (c["5"]["n"], c["5"]["n_sites"], c["5"]["site_share"], c["5"]["usable"]) == (13, 3, round(9 / 13, 6),
        True) and not c["6"]["usable"]


def test_text_primitives(spark):
    t = F.col("t")
    assert value(spark, X.plus_minus(t), t="5 +/- 2 e 3 +- 1") == "5  PLUSMINUS  2 e 3  PLUSMINUS  1"
    assert [value(spark, X.digit_of(t), t=x) for x in ("o", "3", "O", "x")] == [0, 3, 0, None]
    assert value(spark, t.rlike(X.HISTORY), t="controle de polipectomia") and value(spark, t.rlike(X.OTHER_SCALE),
        t="bi-rads 4") and value(spark, t.rlike(X.DENYING_PLACE), t="jec coincidente com o pincamento")
    g = X.grounding_pattern(F.col("v"), F.col("u"))
    for v, u, text, want in (("5", "mm", "lesao de 5,0mm", True), ("5", "mm", "15 mm", False), ("5.50", "mm", "5.5 mm", True),
        ("5.5", "mm", "575 mm", False), ("5.0", "mm", "5 MM", True), ("x", "mm", "x mm", None), ("5", None, "5 mm", None)):
        df = spark.createDataFrame([(v, u, text)], "v string, u string, t string")
        assert df.select(F.regexp_like("t", g).alias("x")).first()["x"] == want, (v, u, text)
    s = "lemma_positive"
    hits = F.array(*[F.struct(F.lit(a).alias("tier"), F.struct(F.lit(b).alias("v")).alias("record")) for a,
            b in (("measurement_positive", 1), (s, 2), (s, 3), ("other", 4))])
    assert value(spark, X.strongest(hits)["v"], t="") == 2
    for e, src, want in (("abc", "xx ABC yy", True), ("a" * 40 + "zzz", "a" * 40, True), ("abc", "", True),
        (None, "x", False), ("q", "x", False)):
        assert value(spark, X.supported(F.col("e"), F.col("s")), e=e or "", s=src) == want
    assert value(spark, X.anchored_percent(t, F.lit(20.0)), t="Ki-67: 19,5 %") and not value(spark,
        X.anchored_percent(t, F.lit(21.0)), t="ki 67 em 20%") and value(spark, X.upper_value(t), t=" a ") == "A"
    df = spark.createDataFrame([("v", "e" * 300)],
        "a string, b string").select(*X.evidence_fields(F.col("a"), F.col("b"), {"n": F.lit(1)}))
    assert df.columns == ["value", "evidence", "meta_n"] and len(df.first()["evidence"]) == 200


@pytest.mark.parametrize(
    "text, mm",
    [("tamanho do tumor: 12 mm. medindo 3,0 x 2,5 cm", 12.0), ("tamanho: 1,5 x 2,2 cm", 22.0),
        ("mede 2 milimetros e medindo 1,0 cm", 10.0), ("tumor 1,3 = 13,0 mm", 13.0), ("x = 13,0 mm", None), ("", None),
        (None, None)],
)
def test_tumour_size(spark, text, mm):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(V.tumour_size(F.col("t")).alias("x")).first()["x"] == mm


@pytest.mark.parametrize(
    "text, want",
    [("polipo diminuto", "qualitative_diminuto"), ("polipo em grande quantidade", None),
        ("grande polipo", "qualitative_large"), ("polipos menores que 5 mm", "qualitative_diminuto"),
        ("polipos menores que 0,8 cm", "qualitative_subcm"), ("polipo" + " x" * 60 + " diminuto", None), ("diminuto", None),
        ("", None)],
)
def test_polyp_size_in_words(spark, text, want):
    assert value(spark, V.polyp_size_words(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("ki-67 / mib-1 (30-9): positivo em 10 a 21%", 15), ("indice de proliferacao celular ao ki67 de ate 10%", 10),
        ("ki67 positivo em mais de 30%", 30), ("ki-67 positivo entre 10 e 15%", 12), ("ki67 variando de 5% a 10%", 7),
        ("15 a 20% ao ki-67", 17), ("ki67 (25%)", 25), ("ki-67 ausente", None)],
)
def test_proliferation_index(spark, text, want):
    assert value(spark, D.KI67.column(F.col("t")), t=text) == want


def test_flags_and_guards(spark):
    f = V.receptor_flags(F.col("t"))
    assert tuple(value(spark, f, t="re: positivo em 5%. ki-67 positivo em mais de 30%. her2 3+")) == (True, False, True, True)
    assert tuple(value(spark, f, t="carcinoma ductal in situ. re negativo")) == (False, True, False,
        False) and tuple(value(spark, f, t="")) == (False,) * 4
    assert value(spark, V.outside_in_situ(F.col("b"), F.lit(2)), b="in_situ") is None and value(spark,
        V.outside_in_situ(F.col("b"), F.lit(2)), b="x") == 2
    r = V.invasion_record(F.col("t"), D.INV_PERIN)
    assert tuple(value(spark, r, t="invasao perineural: ausente"))[:3] == ("nao", "detected",
        "high") and tuple(value(spark, r, t="")) == (None, "not_mentioned", None, None)
    assert value(spark, D.BETHESDA_DESC.column(F.col("t")),
        t="bethesda - benigno (categoria ii)") == "benigno" and value(spark, D.BETHESDA_DESC.column(F.col("t")),
        t="bethesda ii") is None


def test_windows_of_late_files(spark, tmp_path):
    """Files that arrive out of order, over two runs: all rows count without a watermark; with one the late ones don't."""
    from lauda.streaming import live

    def file(k, days):
        rows = [(dt.datetime(2024, 1, d), "a") for d in days]
        spark.createDataFrame(rows,
            "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))

    kept, cut = str(tmp_path / "kept"), str(tmp_path / "cut")
    for k, days in enumerate(([10, 10, 11], [10, 12], [1, 12])):
        file(k, days)
        all_rows = live.windowed_counts(spark, str(tmp_path / "events.parquet"), target=kept)
        in_time = live.windowed_counts(spark, str(tmp_path / "events.parquet"), late="2 days", target=cut)
    count = lambda x: {(r["day"].day, r["n"]) for r in x.collect()}
    assert count(all_rows) == {(10, 3), (11, 1), (12, 2), (1, 1)}
    assert count(in_time) == {(10, 3), (11, 1), (12, 2)}


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as N

    from lauda.session import ensure_checkpoint_dir

    def session(master):
        jsc = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
        made = []
        return N(sparkContext=N(_jsc=jsc, master=master, setCheckpointDir=made.append), conf=N(get=lambda k, d: d)), made

    for master in ("local", "local[4]", "local[*]"):
        s, made = session(master)
        ensure_checkpoint_dir(s)
        assert made
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session(master)[0])


SECTIONED = [
    ("bbps_por_secao", "Preparo: 2+3+3 = 8", ("8", "bbps_soma_3seg", "preparo")),
    ("bbps_por_secao", "preparo: 2+3+3 = 7", ("8", "bbps_soma_3seg_arith_inc", "preparo")),
    ("bbps_por_secao", "descrição: Boston 2 + 2 + 3 (7/9)", ("7", "bbps_soma_3seg", "descricao")),
    ("bbps_por_secao", "descricao: 2 + 2 + 3", (None, "no_match", None)),
    ("bbps_por_secao", "preparo: cd: 2, ct: 3, ce: o", ("5", "bbps_labeled_seg", "preparo")),
    ("bbps_por_secao", "descricao: escala de boston 9/9", ("9", "bbps_sobre_9", "descricao")),
    ("bbps_por_secao", "boston = o. fim", ("0", "bbps_total_near", "corpo")),
    ("bbps_por_secao", "bbps: 10", (None, "no_match", None)), ("bbps_por_secao", "bbps 8", ("8", "bbps_total", "corpo")),
    ("bbps_por_secao", "descricao: boston 7. preparo: 3+3+3", ("9", "bbps_soma_3seg", "preparo")),
    ("la_grau_por_secao", "conclusao: esofagite erosiva grau B de Los Angeles", ("B", "LA_explicit", "conclusao")),
    ("la_grau_por_secao", "descricao: grau a. conclusao: los angeles c", ("C", "LA_explicit", "conclusao")),
    ("la_grau_por_secao", "conclusao: grau a/b", (None, "LA_ambiguous", "conclusao")),
    ("la_grau_por_secao", "conclusao: controle de esofagite grau b de los angeles", (None, "LA_historical", "conclusao")),
    ("la_grau_por_secao", "esofagite de refluxo grau c", ("C", "LA_implicit", "corpo")),
    ("la_grau_por_secao", "esofagite grau d", ("D", "LA_implicit_bare", "corpo")),
    ("la_grau_por_secao", "conclusao: sem sinais de esofagite", ("sem_esofagite", "LA_negative", "conclusao")),
    ("la_grau_por_secao", "indicacao: esofagite grau a de los angeles", (None, "no_match", None)),
    ("la_grau_por_secao", "", (None, "empty", None)), ("la_grau_por_secao", None, (None, "empty", None)),
    ("hernia_por_secao", "conclusão: hérnia hiatal", ("sim", "hh_lemma", "conclusao")),
    ("hernia_por_secao", "conclusao: ausencia de hernia hiatal", ("nao", "hh_negative", "conclusao")),
    ("hernia_por_secao", "descricao: transicao 3,0 cm acima do pincamento", ("sim", "hh_geometric", "descricao")),
    ("hernia_por_secao", "descricao: transicao 1,0 cm acima do pincamento", ("nao_mencionada", "no_match", None)),
    ("hernia_por_secao", "esofago: jec coincidente com o pincamento. conclusao: hernia de hiato",
        ("sim", "hh_lemma", "conclusao")),
    ("hernia_por_secao", "hiato alargado", ("nao", "hh_dilated_only", "corpo")),
    ("hernia_por_secao", "antecedente de hernia hiatal", ("nao_mencionada", "no_match", None)),
    ("hernia_por_secao", "transicao 3 cm acima do pincamento, sem hernia hiatal", ("nao", "hh_negative", "corpo")),
    ("hernia_por_secao", "indicacao: hernia hiatal", ("nao_mencionada", "no_match", None)),
]


def test_detectors_by_section(spark):
    for name in sorted({x[0] for x in SECTIONED}):
        rows = [(i, text) for i, (k, text, _) in enumerate(SECTIONED) if k == name] + [(900, "x " * 40_000)]
        got = {r["id"]: r for r in R.run_variable(spark.createDataFrame(rows, "id long, text string"), var(name, name), "id",
                "text").collect()}
        for i, (k, text, want) in enumerate(SECTIONED):
            if k == name:
                assert (got[i]["value"], got[i]["status"], got[i]["section"]) == want, (k, text, tuple(got[i]))
        assert got[900]["section"] is None


PROMPT = """## Main

```text
KEYS AND ALLOWED VALUES:
idx: (copy from input)
polipo: "sim"/"nao"/"nao_mencionado" — "sim" only if seen
numero: integer (0 if none, 99 if "muitos")
boston: integer 0-9 or null
local: segments with ";" or "nao_aplicavel"
2. "zt": "presente" | "ausente" | null (component)
- "peso": number or null
NOTES:
- "X" means y
```
"""


def test_answers_by_the_schema_of_their_prompt(spark):
    from lauda.plans import reader_schemas as S

    fields = S.prompt_fields(S.prompt_block(PROMPT, "Main"))
    assert [(f.name, f.kind, f.allowed) for f in fields] == [("idx", "text", ()),
        ("polipo", "text", ("sim", "nao", "nao_mencionado")), ("numero", "integer", ()), ("boston", "integer", ()),
        ("local", "text", ()), ("zt", "text", ("presente", "ausente")), ("peso", "number", ())]
    assert (fields[3].low, fields[3].high) == (0.0, 9.0) and len(S.prompt_sha(PROMPT)) == 64
    with pytest.raises(KeyError):
        S.prompt_block(PROMPT, "Other")
    rows = [(1, '{"polipo": "sim", "boston": 7, "zt": "null", "peso": 1.5, "extra": 1}', "p"),
        (2, '{"polipo": "talvez", "boston": 12}', "p"), (3, "no json", "p"), (4, None, "p"), (5, "{}", "p"), (6, "", "p")]
    got = {r["id"]: r for r in S.parsed_answers(spark.createDataFrame(rows, "id long, a string, polipo string"), "a",
            fields).collect()}
    assert (got[1]["parsed"]["boston"], got[1]["parsed"]["zt"], got[1]["outside"], got[1]["malformed"]) == (7, None, [], False)
    assert got[2]["outside"] == ["polipo",
        "boston"] and got[3]["malformed"] and not got[4]["malformed"] and got[5]["outside"] == [] and got[4]["parsed"]["polipo"] is None


def test_review_over_http(spark, tmp_path):
    import urllib.error
    import urllib.request

    from lauda.sources import review_server as H

    sample = spark.createDataFrame([("v", "c1", float("nan")), ("v", "c2", 1.0), ("w", "c1", 2.0)],
        "variable string, id_registro string, score double")
    texts = spark.createDataFrame([("c1", "laudo um"), ("c9", "other")], "id_registro string, text string")
    path = str(tmp_path / "sample.jsonl")
    assert H.export_sample(sample, path, texts) == 3
    with pytest.raises(ValueError):
        H.export_sample(sample, path, most=2)
    with open(path, "a") as f:
        f.write("\nbroken\n[1]\n")
    server, _ = H.serve(H.ReviewStore(path, legend={"v": "what v is"}), 0)
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(where, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + where,
                    None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()),
                timeout=10) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert json.loads(call("/api/state")[1]) == {"total": 3, "done": 0, "first_pending": 0}
        first = next(i for i in range(3) if json.loads(call(f"/api/record/{i}")[1])["id_registro"] == "c2")
        assert json.loads(call("/api/annotate",
                {"index": first, "human_label": "sim", "human_note": "á"})[1])["human_note"] == "á"
        assert json.loads(call("/api/state")[1])["done"] == 1 and call("/api/record/9")[0] == 404 and call("/api/annotate",
            {"index": "x"})[0] == 400 and call("/api/annotate", b"{")[0] == 400 and call("/nothing")[0] == 404
        assert call("/")[0] == 200 and {r["score"] for r in json.loads(call("/api/export")[1])} == {None, 1.0, 2.0}
        again = H.ReviewStore(path)  # another session goes on
        assert again.state()["done"] == 1 and again.record(first)["human_label"] == "sim"
        assert json.loads(call("/api/clear",
                {"index": first})[1])["human_label"] is None and H.ReviewStore(path).state()["done"] == 0
    finally:
        server.shutdown()
        server.server_close()


def test_reports_and_small_operators(spark):
    from lauda.operators import observe as O
    from lauda.operators.policy import cast_by_ontology, values_equal
    from lauda.sources import sinks as W

    rows = [("v", None, "a", "s", "abstained_x"), ("v", None, "b", "s", "abstained_y"), ("v", "1", None, "s", "ok"),
        ("v", "1", None, "t", None), ("w", None, None, None, None)]
    e = spark.createDataFrame(rows, "variable string, value string, ia string, section string, resolution string")
    got = {r["variable"]: r for r in O.discovery(e, {"v": ["s"]}).collect()}
    assert tuple(got["v"])[1:] == (4, 2, 2, "a", 1, 1, 2, True) and tuple(got["w"])[1:] == (1, 0, 0, None, None, 0, 0, False)
    assert {r["n_leaks"] for r in O.discovery(e).collect()} == {0} and O.discovery(e.where("false"), {"v": ["s"]}).count() == 0
    assert W.discovery_markdown(O.discovery(e)).splitlines()[4].startswith("| v | 4 | 2 | a |")
    d = spark.createDataFrame([("c", "x", "GREEN"), ("c", "y", "RED")], "contract string, variable string, alert string")
    assert W.drift_markdown(d).index("RED") < W.drift_markdown(d).index("GREEN")
    cards = spark.createDataFrame([("v", "f1", "negative", 9), ("v", "f2", "positive", 3), ("w", "f3", "positive", 3)],
        "variable string, family_id string, lane string, n int")
    text = W.cards_markdown(cards, "v")
    assert text.index("f2") < text.index("f1") and "f3" not in text and "No cards" in W.cards_markdown(cards, "z")
    assert len(W.markdown_table(cards, "t", 2).splitlines()) == 8 and "First 2 rows." in W.markdown_table(cards, "t", 2)
    assert W.source_hash([R.__file__, B.__file__]) == W.source_hash([B.__file__, R.__file__])
    assert value(spark, cast_by_ontology(F.col("a"), F.lit("integer")), a="5.9") == 5.0 and value(spark,
        cast_by_ontology(F.col("a"), F.lit("float")), a="x") is None and value(spark, cast_by_ontology(F.col("a"), F.lit("enum")),
        a="5") is None
    assert value(spark, values_equal(F.col("a"), F.col("b")), a="5", b="5.0") and value(spark,
        values_equal(F.col("a"), F.lit(None).cast("string")), a="5") is False
    assert K.policy_of([{"variable": "v"}], "x") is None and len(K.registry_hash("x")) == 64


def test_a_stream_goes_on_after_a_crash(spark, tmp_path):
    """A batch that fails after it has written is run again under its id and replaces itself."""
    from lauda.streaming import live

    source, target = str(tmp_path / "rows.parquet"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(k, i) for i in range(5)], "k int, i int").coalesce(1).write.mode("append").parquet(source)
    calls = []

    def each(b, i):
        b.write.mode("overwrite").parquet(f"{target}/batch={i}")
        calls.append(i)
        if calls == [0, 1]:
            raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        live.run_to_end(live.stream_table(spark, source, 1), target, each)
    live.run_to_end(live.stream_table(spark, source, 1), target, each)
    assert calls == [0, 1, 1, 2]
    assert sorted((r["k"], r["i"]) for r in spark.read.parquet(target).collect()) == [(k, i) for k in range(3) for i in range(5)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("margens cirurgicas: livres de neoplasia", "livres"), ("margens cirurgicas (tinta): comprometidas", "comprometidas"), ("margens cirurgicas: livres. 2) pele: comprometida", "livres"),
        ("margem anterior: livre; margem posterior: exigua", "exiguas"), ("margem anterior: livre; margem lateral: comprometida", "comprometidas"), ("neoplasia compromete a margem profunda", "comprometidas"),
        ("margens livres, a margem cirurgica mais proxima dista 2 mm", "exiguas"), ("margens livres de neoplasia; margem mais proxima: 2 mm", "livres"), ("margem profunda encontra-se exigua", "exiguas"), ("margens cirurgicas nao comprometidas", "livres"),
        ("margem superior tangenciada", "exiguas"), ("linfonodos comprometidos", None), ("", None),
    ],
)
def test_worst_margin_counts(spark, text, want):
    assert value(spark, D.MARGENS.column(F.col("t"))["value"], t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("grau histologico: grau ii de nottingham", "2"), ("grau 1 mbr. novo grau histologico final: grau 3 mbr", "3"), ("escore 3+2+1=6", "2"), ("3 + 3 + 3 = 9", "3"), ("1+1+1=12", None), ("nottingham grau iii", "3"), ("grau nuclear 2", None), ("", None)],
)
def test_histological_grade(spark, text, want):
    assert value(spark, D.GRAU_NOTT.column(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "rule, text, want",
    [("PT", "estadiamento: ypt1c(m); pn0", "ypt1c(m)"), ("PT", "ptis", "ptis"), ("PT", "nada", None), ("PN", "estadiamento: pt2; pn1a (sn)", "pn1a (sn)"), ("PN", "pn0", "pn0"), ("PN", "pno(ls)", "pn0 (ls)"), ("PN", "ypno", "ypn0"),
     ("PN", "estadiamento: pt2 n0 mx", "pn0"), ("PN", "estadiamento: ypt1c; yn1", "ypn1"), ("PN", "n0", None), ("PN", "", None)],
)
def test_stage(spark, rule, text, want):
    assert (value(spark, getattr(D, rule).column(F.col("t")), t=text) or "").strip() == (want or "")


@pytest.mark.parametrize(
    "text, exam, pos",
    [("linfonodos examinados: 17. linfonodos comprometidos: 3", 17, 3), ("2/15 linfonodos", 15, 2), ("axila: isolados 12, comprometidos: 1", None, 1), ("macrometastases (>2mm): 4", None, 4), ("linfonodos livres", None, 0), ("linfonodos: 1/9", 9, 1), ("", None, None)],
)
def test_lymph_nodes(spark, text, exam, pos):
    assert (value(spark, D.LN_EXAM.column(F.col("t")), t=text), value(spark, D.LN_POS.column(F.col("t")), t=text)) == (exam, pos)


@pytest.mark.parametrize(
    "text, want",
    [
        ("carcinoma lobular invasivo e carcinoma ductal invasivo da mama", "misto"), ("carcinoma lobular infiltrante", "CLI"), ("neoplasia com componente micropapilar", "micropapilar"), ("componente micropapilar", None),
        ("areas de diferenciacao mucinosa em carcinoma invasivo", "CDI_SOE"), ("carcinoma ductal in situ", "CDIS"), ("carcinoma ductal in situ, ausencia de carcinoma invasivo", "CDIS"), ("cdis com microinvasao", "CDI_SOE"), ("carcinoma lobular in situ", "CLIS"),
        ("adenocarcinoma", "outro_maligno"), ("fibroadenoma", "fibroadenoma"), ("cistos e adenose", "fibrocistico"), ("adenose", "outro_benigno"), ("tumor phyllodes com fibroadenoma", "outro_benigno"), ("", None),
    ],
)
def test_histological_type(spark, text, want):
    assert value(spark, D.TIPO_HIST.column(F.col("t"))["value"], t=text) == want
