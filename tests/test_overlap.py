"""Development overlap: links against SQL, hashed word runs, and what the join moves."""

import random
import re
import time

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from lauda.operators.run_marks import text_runs
from lauda.plans.loop_queries import development_overlap


def _report(rng, variants=12):
    """Thirty sentences of four words, each one of a few of its place."""
    return ". ".join(f"achado{i} com grau{rng.randrange(variants)} em{i}" for i in range(30))


def _save(spark, rows, folder):
    spark.createDataFrame(rows, "pilot_id long, no_desenvolvimento boolean, laudo string").write.parquet(f"{folder}/run_pilot.parquet")
    return str(folder)


@pytest.mark.parametrize("most", [20_000, 0])
def test_development_overlap_equals_sql(spark, tmp_path, most):
    rng = random.Random(4)
    texts = [_report(rng) for _ in range(40)] + ["um dois três", "Só  quatro || palavras", "a b c d e", "", None]
    for t in texts[:20]:
        for n in (1, 1, 2, 3):  # near copies: some words changed, or an end cut off or added
            w = t.split()
            for _ in range(n):
                w[rng.randrange(len(w))] = f"outro{rng.randrange(9)}"
            texts.append(" ".join(w[: len(w) - rng.choice((0, 0, 6, 20, 24))] + ["mais"] * rng.choice((0, 4))).upper())
    rows = [(i, rng.choice((True, False, None)), rng.choice(texts)) for i in range(600)]
    d = _save(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW run_pilot AS SELECT * FROM '{d}/run_pilot.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["development_overlap"]).fetchall()
    got = [tuple(r) for r in development_overlap(spark, d, most).collect()]
    assert sorted(got) == sorted(want) and len({r[2] for r in want}) > 8


def test_development_overlap_moves_no_texts_of_unrelated_reports(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i % 20 == 0, _report(rng)) for i in range(1500)]
    d = _save(spark, rows, tmp_path)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        time.sleep(0.5)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert development_overlap(spark, d).collect() == []
    # nearly all pairs share a run of the rarest ones; what moves follows the reports, not the pairs
    assert written() - before < 2 * sum(len(t) for _, _, t in rows)


def test_development_overlap_broadcasts_no_texts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i % 3 == 0, _report(rng)) for i in range(30)]
    d = _save(spark, [*rows, (90, False, rows[0][2])], tmp_path)
    plan = development_overlap(spark, d, 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # however small the files make the optimizer take them for


def test_text_runs():
    texts = ["aa bb cc aa bb cc", "x", "", None, "um dois; três-quatro", "aa bb cc", "cc" * 900 + " b a", "ab b cc"]
    row, h = text_runs(pa.array(["não"] + texts).slice(1), 3)
    want = []
    for i, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", t or "")
        want += [(i, r) for r in {tuple(w[j : j + 3]) for j in range(len(w) - 2)}]
    assert sorted(row.tolist()) == sorted(i for i, _ in want)
    assert len(set(h.tolist())) == len({r for _, r in want})
    assert len(text_runs(pa.array(["a b", None]), 3)[0]) == len(text_runs(pa.array([], pa.string()), 3)[0]) == 0
