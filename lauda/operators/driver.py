"""Detector driver: rules and user detectors over a corpus, uniform result rows, resumption, canaries.

A detector is the name of a catalogued rule (a Column), `module.function` of any importable function, or a
function itself. Functions run in Arrow batches, one text at a time; whatever they return (a value, a
tuple, a dict, an object with fields) becomes the same row, and whatever they raise becomes a row with the
status `ERROR:<Type>`, so that no text fails a run.
"""

from __future__ import annotations

import dataclasses
import importlib
import re
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lauda.functions import detectors as D
from lauda.functions.rules import Cascade
from lauda.functions.sectioned import DETECTORS
from lauda.functions.text import let, normalize
from lauda.operators.policy import canonical_value
from lauda.plans.contract import Contract, Variable

RULES = {x.name: x for rules in D.SETS.values() for x in rules}
FIELDS = ("value", "status", "evidence", "section", "certainty", "span_start", "span_end")
RESULT = [T.StructField(k, T.IntegerType() if k.startswith("span") else T.StringType()) for k in FIELDS]
#: Evidence is cut to this many characters in result rows.
EVIDENCE = 200


def resolve(detector: str | Callable) -> Callable:
    """The function of a dotted name; a function stays itself."""
    if callable(detector):
        return detector
    module, _, name = detector.rpartition(".")
    if not module:
        raise KeyError(f"no rule and no module.function: {detector}")
    return getattr(importlib.import_module(module), name)


def adapt(raw: Any, v: Variable | None = None) -> dict:
    """Result fields of what a detector returned.

    A tuple is value and evidence, then section; a mapping or an object has the fields that the contract
    names (value, status, evidence and certainty fields), under their own names by default.
    """
    names = {k: (getattr(v, f"{k}_field", None) if v else None) or k for k in FIELDS}
    if raw is None:
        got: dict = {}
    elif isinstance(raw, Mapping):
        got = {k: raw.get(n) for k, n in names.items()}
    elif isinstance(raw, tuple) and not hasattr(raw, "_fields"):
        got = dict(zip(("value", "evidence", "section"), raw))
    elif dataclasses.is_dataclass(raw) or hasattr(raw, "_fields") or hasattr(raw, names["value"]):
        got = {k: getattr(raw, n, None) for k, n in names.items()}
    else:
        got = {"value": raw}
    out = {}
    for k in FIELDS:
        x = got.get(k)
        missing = x is None or (isinstance(x, float) and x != x)
        out[k] = None if missing else int(x) if k.startswith("span") else str(x)
    if out["evidence"]:
        out["evidence"] = out["evidence"][:EVIDENCE]
    return out


def rule_result(detector: str, t: Column) -> Column:
    """Result struct of a catalogued rule over a normalised text."""
    none = lambda k: F.lit(None).cast("int" if k.startswith("span") else "string")
    fields = lambda got: F.struct(*[got.get(k, none(k)).alias(k) for k in FIELDS])
    state = lambda v: F.when(v.isNull(), "no_match").otherwise("detected")
    rule = RULES.get(detector)
    if rule is None:
        return let(DETECTORS[detector](t),
            lambda r: fields({k: r[k] for k in ("value", "evidence", "section", "span_start", "span_end", "status")}))
    if isinstance(rule, Cascade):
        return let(rule.column(t),
            lambda r: fields({"value": r["value"], "status": state(r["value"]), "evidence": r["evidence"],
                    "span_start": r["span_start"], "span_end": r["span_start"] + F.length(r["evidence"])}))
    return let(rule.column(t).cast("string"), lambda v: fields({"value": v, "status": state(v)}))


def run_variable(df: DataFrame, v: Variable, key: str, text: str, carry: tuple[str, ...] = (), done: DataFrame | None = None,
    function: Callable | None = None) -> DataFrame:
    """(key, carried columns, variable, result fields) of one variable over a corpus.

    done: rows of an earlier run, whose keys are left out. NULL texts reach a function as ''. Repeated
    keys each get their row; an empty corpus gives no row; other columns of any name are left out.
    """
    todo = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    keep = [key, *carry]
    if function is None and (v.detector in RULES or v.detector in DETECTORS):
        r = todo.select(*keep,
            let(normalize(F.col(text)),
                lambda t: rule_result(v.detector, t)).alias("_r"))  # in a lambda the text is computed once, and the code stays small
        return r.select(*keep, F.lit(v.name).alias("variable"), "_r.*")
    schema = T.StructType([*[todo.schema[c] for c in keep], T.StructField("variable", T.StringType()), *RESULT])
    detector = function or v.detector

    def run(batches):
        for b in batches:
            rows = []
            for x in b["_text"]:
                try:
                    rows.append(adapt(resolve(detector)(x), v))
                except Exception as e:  # noqa: BLE001  any failure is a result row
                    rows.append(dict.fromkeys(FIELDS) | {"status": f"ERROR:{type(e).__name__}"})
            r = pd.DataFrame(rows, columns=list(FIELDS), index=b.index)
            for k in ("span_start", "span_end"):
                r[k] = r[k].astype("Int32")
            yield pd.concat([b[keep], r.assign(variable=v.name)], axis=1)[[f.name for f in schema]]

    return todo.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(run, schema)


def run_contract(df: DataFrame, c: Contract, only: list[str] | None = None) -> DataFrame:
    """Every variable of a contract (or the named ones) over its corpus, strata carried."""
    unknown = missing_variables(c, only or [])
    if unknown:
        raise KeyError(f"unknown variables: {', '.join(unknown)}")
    wanted = [v for v in c.variables if not only or v.name in only]
    parts = [run_variable(df, v, c.corpus["id_column"], c.corpus["text_column"],
            tuple(c.corpus.get("strata_columns", ()))) for v in wanted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_variables(c: Contract, wanted: list[str]) -> list[str]:
    """Requested variables that a contract lacks, in the order asked for."""
    known = {v.name for v in c.variables}
    return [w for w in dict.fromkeys(wanted) if w not in known]


def run_canaries(spark: SparkSession, c: Contract) -> DataFrame:
    """(variable, canary, expected, got, status, passed, passed_as_number) of every canary of a contract.

    passed compares letter for letter, passed_as_number by the canonical form ('5' is '5.0'); a canary
    whose detector fails has not passed. A canary may expect no value.
    """
    out = None
    for v in c.variables:
        if not v.canaries:
            continue
        rows = [(i, str(x.get("text") or ""), None if x.get("expected_value") is None else str(x["expected_value"])) for i,
            x in enumerate(v.canaries)]
        df = spark.createDataFrame(rows, "canary int, text string, expected string")
        r = run_variable(df, v, "canary", "text", ("expected",))
        out = r if out is None else out.unionByName(r)
    if out is None:
        return spark.createDataFrame([],
            "variable string, canary int, expected string, got string, status string, passed boolean, passed_as_number boolean")
    ok = ~F.coalesce(F.col("status").startswith("ERROR"), F.lit(False))
    same = F.col("value").eqNullSafe(F.col("expected"))
    alike = canonical_value(F.col("value")).eqNullSafe(canonical_value(F.col("expected")))
    return out.select("variable", "canary", "expected", F.col("value").alias("got"), "status", (ok & same).alias("passed"),
        (ok & alike).alias("passed_as_number"))


_FIRST = re.compile(r"(\d+(?:[.,]\d+)?)\s*mm\b", re.ASCII)


def first_measure(text: str) -> tuple[str | None, str | None]:
    """A user detector as an example: the first measure in millimetres; an empty text is an error."""
    if not text.strip():
        raise ValueError("empty text")
    m = _FIRST.search(text)
    return (m[1].replace(",", "."), m[0]) if m else (None, None)
