"""Column profiles and unit histories against brute force on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lauda.operators.profile import faulty_measures, profile_columns, unpivot_values
from lauda.operators.units import foreign_units, measures, number, read_case, unit_history

RUNS = "manifest_row_id long, contract_id string, variable string, started_at timestamp, n_total long, n_filled long, fill_rate double, n_both_filled long, n_agree_both long, agreement_surface double, v string, t string, field string"


def run(i, day, fill, agree=None, n=100, filled=None, contract="c", variable="x", both=10, agreed=None):
    t = None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    filled = filled if filled is not None else (None if fill is None else round(n * fill))
    agreed = agreed if agreed is not None else (None if agree is None else round(both * agree))
    return (i, contract, variable, t, n, filled, fill, both if agree is not None else None, agreed, agree, "extra", "extra",
        "extra")


def found(spark, rows):
    return {tuple(r) for r in faulty_measures(spark.createDataFrame(rows, RUNS)).collect()}


def test_jump_against_the_latest_passing_run(spark):
    rows = [run(1, 0, 0.5), run(2, 1, 7.0, filled=50), run(3, 2, 0.55), run(4, 3, 0.7), run(5, 3, 0.7), run(6, 4, 0.71)]
    assert found(spark, rows) == {(2, "fill_rate"), (4, "fill_rate"), (5, "fill_rate")}


def test_faults_of_counts_and_rates(spark):
    rows = [
        run(1, 0, 0.5, filled=None), (2, "c", "y", dt.datetime(2024, 1, 1), 10, None, 0.5, None, None, None, "", "", ""),
        (3, "c", "z", dt.datetime(2024, 1, 1), 10, -1, 0.5, None, None, None, "", "", ""),
        (4, "c", "w", dt.datetime(2024, 1, 1), 10, 5, float("nan"), 4, 2, None, "", "", ""),
        (5, "c", "u", dt.datetime(2024, 1, 1), 0, 0, None, 0, 0, None, "", "", ""),
        (6, "c", "q", dt.datetime(2024, 1, 1), 10, 5, 0.502, 4, 2, 0.5, "", "", ""),
    ]
    assert found(spark, rows) == {(2, "n_filled"), (3, "n_filled"), (4, "fill_rate"), (4, "agreement_surface"), (6, "fill_rate")}


def test_no_order_no_jump_and_empty(spark):
    assert found(spark,
        [run(1, None, 0.1), run(2, 0, 0.9), run(3, 1, 0.1, contract=None), run(4, 2, 0.9, contract=None)]) == set()
    assert found(spark, []) == set()


def test_jump_scan_equals_brute_force_over_partitions(spark):
    rng = random.Random(3)
    rows = [run(i, rng.randrange(60), rng.choice([0.2, 0.25, 0.29, 0.4, 0.9]), variable=rng.choice("xxxxy")) for i in range(400)]
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        by.setdefault(r[2], {}).setdefault(r[3], []).append(r)
    want = set()
    for days in by.values():
        before = None
        for t in sorted(days):
            want |= {(r[0], "fill_rate") for r in days[t] if before is not None and abs(r[6] - before) > 0.1 + 1e-9}
            before = days[t][-1][6]
    assert found(spark, rows) == want


def test_profile_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "b", "c", "dd"]), rng.choice([None, float("nan"), *map(float, range(6))]),
            rng.choice(["2024-01", "2024-02", "2024-03"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s string, x double, load_month string")
    got = {(r["col"], r["load"]): r for r in profile_columns(unpivot_values(df, F.col("load_month"), "t", ["s", "x"])).collect()}
    for col, k in (("s", 1), ("x", 2)):
        cells, loads = {}, ["2024-01", "2024-02", "2024-03"]
        for r in rows:
            v = r[k] if r[k] not in (None, "") and r[k] == r[k] else None
            cells.setdefault(r[3], []).append(v)
        known = {m: sorted(v for v in cells[m] if v is not None) for m in loads}
        for i, m in enumerate(loads):
            r, vals = got[(col, m)], known[m]
            assert (r["n"], r["nulls"], r["n_distinct"]) == (len(cells[m]), len(cells[m]) - len(vals), len(set(vals)))
            q = lambda p: vals[max(1, -(-int(p * 4) * len(vals) // 4)) - 1]
            form = "txt" if col == "s" else "num"
            assert [r[f"q{p}_{form}"] for p in (25, 50, 75)] == [q(0.25), q(0.5), q(0.75)]
            if i == 0:
                assert r["ks"] is None
            else:
                prev = known[loads[i - 1]]
                cdf = lambda v, xs: sum(x <= v for x in xs) / len(xs)
                assert r["ks"] == pytest.approx(max(abs(cdf(v, vals) - cdf(v, prev)) for v in set(vals) | set(prev)), abs=1e-6)


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "s string, m string")
    assert profile_columns(unpivot_values(df, F.col("m"), "t", ["s"])).count() == 0


@pytest.mark.parametrize(
    "value, text, want",
    [
        ("2", "pólipo de 2 centímetros.", (20000, "text")), ("2,0", "tumor dista 2 cm da margem.", (20000, "text")),
        ("5", "massa de 0,5 cm. Aparelho introduzido por 37 cm.", (5000, "converted")),
        ("29", "neoplasia com 29 x 20.3 x 11.6MM", (29000, "text")), ("0.25", "0.25 polegada(s)", (6350, "text")),
        ("5558 micrômetros", "x", (5558, "value")), ("2 x 1,4 x 0,8 cm", "", (20000, "value")),
        ("7", "pinça de 7 mm utilizada", None), ("", "2 cm", None), (None, "2 cm", None), ("???", "2 cm", None),
        ("1,5", None, None),
    ],
)
def test_reading_of_one_case(value, text, want):
    n, fs, where = read_case(value, text, "mm")
    assert (None if not fs else (int(n * fs[0] * 1000), where)) == want


def test_numbers_and_measures():
    assert [float(number(x)) for x in ("1,5", "1.5", "12", "1.234,5")] == [1.5, 1.5, 12.0, 1234.5]
    assert measures('3" e 4 kg', "length")[0][1:3] == ("in", number("25.4"))
    assert measures("23 G e 30 ml", "volume")[1][1] == "ml"


CASES = "case_no long, source string, variable string, added_at timestamp, expected_value string, text string, unit string, num string"
SPECS = "variable string, unit string, canonical string"


def cases(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, s, "v", t0 + dt.timedelta(hours=i), e, t, "clash", "clash") for i, s, e, t in rows], CASES)


def test_foreign_units_and_level_shift(spark):
    specs = spark.createDataFrame([("v", "mm", None), ("w", None, "a")], SPECS)
    rows = [(i, "A", "12", "mede 12 mm") for i in range(20)] + [(i, "A", "1.2", "mede 1.2 cm") for i in range(20, 40)] + [(40,
            "A", "1.2", None),
        (41, "A", "1.3", "mede 1.3 cm"), (42, None, None, "3 cm"), (43, "B", "3", "3 cm"), (44, "B", "3", "3 cm")]
    df = cases(spark, rows)
    assert {tuple(r) for r in foreign_units(df, specs).collect()} == {(i, 12000) for i in range(20, 40)} | {(41, 13000),
        (43, 30000), (44, 30000)}
    h = {r["case_no"]: r for r in unit_history(df, specs).collect()}
    assert h[40]["stated"] is None and h[40]["level_factor"] == 10.0  # its history tells the unit
    assert h[20]["segment_change"] and not h[21]["segment_change"]
    assert foreign_units(cases(spark, []), specs).count() == 0
    assert foreign_units(df, spark.createDataFrame([], SPECS)).count() == 0


def test_history_is_the_same_for_any_partitioning(spark):
    specs = spark.createDataFrame([("v", "mm", None)], SPECS)
    rng = random.Random(1)
    rows = [(i, "A", str(rng.choice([1.2, 12, 15, 1.5])), rng.choice([None, "mede 1.2 cm", "mede 12 mm"])) for i in range(300)]
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r["case_no"]: (r["level_factor"], r["segment_change"]) for r in unit_history(cases(spark, rows),
                    specs).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_factors_of_any_size_and_zero(spark):
    specs = spark.createDataFrame([("v", "cm", None), ("w", "kg", None), ("z", "g", None)], SPECS)
    rows = [(i, "A", f"{5 + i} cm", None) for i in range(9)] + [(9, "A", "500 micra", None), (10, "A", "0 mm", None),
        (11, "A", "0", "0 mm"), (12, "A", "0", None)]
    got = {tuple(r) for r in foreign_units(cases(spark, rows), specs).collect()}
    assert got == {(9, 50), (10, 0), (11, 0)}
    rows = [(i, "A", f"{1 + i} kg", None) for i in range(9)] + [(9, "A", "700000 mg", None), (10, "A", "3 mcg", None),
        (11, "A", "0 mg", None)]
    df = cases(spark, rows).withColumn("variable", F.lit("w"))
    assert {tuple(r) for r in foreign_units(df, specs).collect()} == {(9, 700), (10, 0), (11, 0)}


def test_search_decides_between_units_of_the_text(spark):
    """The same number with two units: the neighbours' level wins; without penalties the choice is another."""
    specs = spark.createDataFrame([("v", "mm", None)], SPECS)
    both = "margem de 3 mm, tumor de 3 cm"
    rows = [(i, "A", "3", "mede 3 mm") for i in range(8)] + [(8, "A", "3", both)] + [(i, "B", "3",
            "mede 3 cm") for i in range(9, 17)] + [(17, "B", "3", both)]
    got = {tuple(r) for r in foreign_units(cases(spark, rows), specs).collect()}
    assert got == {(i, 30000) for i in [*range(9, 18)]}  # 8 stays in millimetres, 17 is in centimetres
    assert {tuple(r) for r in foreign_units(cases(spark, rows), specs, penalty=0.0).collect()} != got


def test_paths_are_those_of_the_whole_search():
    """Matrices by halving, and paths settled on the way, against one search over all records at once."""
    import numpy as np
    import pandas as pd

    from lauda.operators.units import SHIFT_PENALTY, Levels, Tracer, joined, min_plus

    rng = random.Random(4)
    levels = Levels([0.001, 1.0, 10.0, 25.4], 1.0, 0.4)
    nums = [rng.choice([0.0, 0.5, 1.5, 15.0, 150.0, 15000.0]) for _ in range(200)]
    stated = [rng.choice([[], [], [], [10.0], [1.0], [1.0, 10.0]]) for _ in nums]
    costs = levels.costs(nums, stated)
    shift = SHIFT_PENALTY * (1 - np.eye(4))
    m = np.where(np.eye(4) > 0, costs[0], np.inf)
    for c in costs[1:]:
        m = (m[:, :, None] + shift[None]).min(axis=1) + c[None]
    assert np.allclose(joined(min_plus(costs[:77]), min_plus(costs[77:])), m)
    rows = pd.DataFrame({"case_no": range(200), "source": "A", "variable": "v", "num": nums, "factors": stated,
            "millis": [[int(1000 * f) for f in fs] for fs in stated], "stated": None})
    t = Tracer(levels, None)
    got = pd.concat([d for i in range(0, 200, 30) for d in t.add(rows.iloc[i : i + 30])] + list(t.end(None)), ignore_index=True)
    at = [levels.at[f] for f in got.level_factor]
    path = sum(costs[i, a] for i, a in enumerate(at)) + SHIFT_PENALTY * sum(a != b for a, b in zip(at, at[1:]))
    assert got.case_no.tolist() == list(range(200)) and abs(path - m.min()) < 1e-6


def test_numbers_beyond_a_double_stay_apart(spark):
    from decimal import Decimal

    big = [2**60 + i for i in (0, 1, 2, 3)] + [-(2**60) - i for i in (0, 1)] + [7, None]
    dec = [Decimal("12345678901234567890.000001"), Decimal("12345678901234567890.000002"), Decimal("1.5"), Decimal("1.5"),
        None, None, None, None]
    df = spark.createDataFrame([(b, d, "a" if i % 2 else "b") for i, (b, d) in enumerate(zip(big, dec))],
        "b long, d decimal(38,6), m string")
    got = {(r["col"], r["load"]): r for r in profile_columns(unpivot_values(df, F.lit("x"), "t", ["b", "d"])).collect()}
    b, d = got[("b", "x")], got[("d", "x")]
    assert (b["n_distinct"], b["nulls"], b["min_txt"], b["max_txt"], b["q75_txt"]) == (7, 1, str(-(2**60) - 1),
        str(2**60 + 3), str(2**60 + 2))
    assert b["q50_txt"] == str(2**60) or (b["q50_num"] == float(2**60) and b["q50_txt"] is None)
    assert (d["n_distinct"], d["max_txt"], d["min_num"]) == (3, "12345678901234567890.000002", 1.5)
    two = {(r["col"], r["load"]): r for r in profile_columns(unpivot_values(df, F.col("m"), "t", ["b"])).collect()}
    assert two[("b", "b")]["ks"] > 0  # the loads hold different integers of the same double
