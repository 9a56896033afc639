"""Queries that look at the whole of their tables, on small tables written for them."""

import datetime as dt

from lauda.plans import catalogue


def folder(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows_of(spark, query, d):
    return sorted(tuple(r) for r in catalogue.QUERIES[query](spark, d).collect())


def test_status_by_clinic_counts_every_row(spark, tmp_path):
    rows = [("ok", "C1", {"ano": "2019"}), ("ok", "C1", {"ano": "2022"}), ("ok", "C2", {}), (None, "C2", None),
        ("ok", None, {"ano": "2025"}), ("ok", "", {"ano": None})]
    d = folder(spark, tmp_path, "evidence_record", rows, "status string, clinica string, stratum map<string,string>")
    assert rows_of(spark, "status_by_clinic", d) == [("None", "C2", 1), ("ok", "C1", 2), ("ok", "C2", 1), ("ok", "None", 2)]


def test_hard_negatives_take_every_seed_word(spark, tmp_path):
    words = [f"palavra{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    common = [(i, "v", "escalated_case", " ".join(words[:40])) for i in range(3)]
    rows = [*common, (3, "v", "escalated_case", " ".join(words[40:]) + " 12 cm"),
        (4, "v", "accepted_exact", " ".join(words[40:])), (5, "v", "accepted_semantic", f"{words[0]} {words[0]} 12 cm"),
        (6, "v", "accepted_exact", "nada igual"), (7, "v", "accepted_exact", None), (8, "w", "accepted_exact", words[0])]
    d = folder(spark, tmp_path, "evidence_record", rows, "evidence_id long, variable string, resolution string, evidence string")
    assert rows_of(spark, "hard_negatives", d) == [(4, "v", 20), (5, "v", 3)]


RUNS = "manifest_row_id long, contract_id string, variable string, started_at timestamp, loaded_at timestamp, n_total long, n_filled long, fill_rate double, n_both_filled long, n_agree_both long, agreement_surface double"
SCOPE = "struct<detector_version:string,scope_complete:boolean,sections_scanned:array<string>,chars_scanned:int,pattern_families_run:array<string>,hits_total:int,explicit_negative_hits:int,historical_hits:int>"
EVIDENCE = f"evidence_id long, run_id string, variable string, id_registro string, clinica string, stratum map<string,string>, value string, value_num double, status string, section string, span_start int, span_end int, evidence string, certainty string, evidence_class string, scope_meta {SCOPE}, ia string, resolution string, normalized string, reason string, written_at timestamp"


def test_profile_counts_violations(spark, tmp_path):
    t, nan = dt.datetime(2024, 1, 5), float("nan")
    runs = [(1, "c", "v", t, t, 10, 5, 0.5, 4, 2, 0.5), (2, "c", "v", t, t, 10, -1, nan, 4, 2, 1.5),
        (3, "c", "v", t, t, 10, None, None, 0, 0, nan), (4, "c", "v", t, t, 0, 0, nan, None, None, None)]
    folder(spark, tmp_path, "run_variable", runs, RUNS)
    scope = ("v4.1", True, ["conclusao"], 10, ["literal"], 1, 0, 0)
    good = dict(zip([x.split()[0] for x in EVIDENCE.split(", ")],
            (1, "run_1", "size", "CASE-1", "CLI-001", {"ano": "2024", "clinica": "CLI-001"}, "5.0", 5.0, "no_match", "conclusao", 0,
                4, "5 mm", "high", "literal", scope, "5.0", "accepted_exact", "5.0", None, t)))
    blank = {"value": "", "value_num": None, "section": None, "certainty": " ", "span_start": -1, "span_end": -1,
        "evidence": None, "scope_meta": None, "ia": None, "normalized": None, "stratum": None}
    bad = {"run_id": "Run 1", "id_registro": "case1", "clinica": "cli 1", "value": "900", "value_num": nan,
        "status": "No match", "section": "Conclusão", "span_start": 9, "span_end": 4, "evidence": "5​mm", "certainty": " low",
        "evidence_class": "x", "resolution": "ok", "ia": "cinco",
           "scope_meta": ("4", True, ["Conclusão"], -1, ["Literal"], -1, -1, -1), "stratum": {"ano": "24"}}
    rows = [good, good | blank, good | bad, good | {"span_end": -1, "value_num": 900.0},
        good | {"variable": "kind", "value": "sim", "ia": "talvez", "normalized": "nao", "value_num": -1.0}]
    folder(spark, tmp_path, "evidence_record", [tuple(r.values()) for r in rows], EVIDENCE)
    folder(spark, tmp_path, "ontology_spec",
        [("size", "float", None, 0.1, 150.0), ("kind", "enum", "sim", None, None), ("kind", "enum", "nao", None, None)],
        "variable string, onto_type string, canonical string, range_min double, range_max double")
    d = folder(spark, tmp_path, "policy_alias", [], "variable string, alias string, canonical string")
    got = {(r["tbl"], r["col"]): r for r in catalogue.QUERIES["p3_profile"](spark, d).collect()}
    assert all(r["violations"] is not None and r["violation_rate"] == round(r["violations"] / r["n"],
            6) for r in got.values()) and len(got) == 31
    one = {"run_id", "id_registro", "clinica", "value", "status", "section", "evidence", "certainty", "evidence_class",
        "resolution", "stratum",
        "span_start"} | {f"scope_meta.{x.split(':')[0]}" for x in SCOPE[7:-1].split(",")} - {"scope_meta.scope_complete"}
    want = dict.fromkeys(one, 1) | {"value_num": 3, "span_start": 1, "span_end": 2, "ia": 2}
    assert {c: r["violations"] for (tbl, c), r in got.items() if tbl == "evidence_record" and r["violations"]} == want
    assert {c: r["violations"] for (tbl, c), r in got.items() if tbl == "run_variable"} == {"n_filled": 2, "fill_rate": 2,
        "agreement_surface": 1}


def test_rules_see_the_cases_of_every_variable(spark, tmp_path):
    rows = [(1, "synthetic_canary", "polipo_tamanho_max_mm", "LAB", "5", "polipo medindo 5 mm", None),
        (2, "synthetic_canary", "peca_peso_g", "LAB", None, "peca com margem de 3 mm", None),
        (3, "synthetic_canary", "peca_peso_g", "LAB", "20", "peca de 20g", None),
        (4, "synthetic_canary", None, "LAB", None, "nada", None)]
    folder(spark, tmp_path, "regression_case", rows,
        "case_no long, kind string, variable string, source string, expected_value string, text string, reference_text string")
    d = folder(spark, tmp_path, "ontology_spec", [("polipo_tamanho_max_mm", "mm"), ("peca_peso_g", "g")],
        "variable string, unit string")
    got = [r for r in catalogue.QUERIES["regression_gate"](spark, d).collect() if r["rule_id"] == "mm_any"]
    assert {(r["variable"], r["bucket"]): r["n"] for r in got} == {("polipo_tamanho_max_mm", "conform"): 1,
        ("peca_peso_g", "regressed"): 1, ("peca_peso_g", "pre_existing"): 1, (None, "conform"): 1}
    got = {r["variable"]: tuple(r)[2:] for r in catalogue.QUERIES["rule_impact"](spark, d).collect() if r["rule_id"] == "mm_any"}
    assert got == {"polipo_tamanho_max_mm": (1, 1, 1, 0, None), "peca_peso_g": (2, 0, 1, 1, 1.0), None: (1, 0, 0, 0, None)}
    got = {(r["variable"], r["skeleton"]) for r in catalogue.QUERIES["skeleton_families"](spark, d).collect()}
    assert got == {("polipo_tamanho_max_mm", "SUBJ MEASURE N UNIT"), ("peca_peso_g", "com margem de N"),
        ("peca_peso_g", "de N UNIT"), (None, "")}
