"""Answer schemas of model readers, read from their prompts, and stored answers checked against them.

A prompt lists its keys one a line (`key: "a"/"b" or null`, `2. "key": "a" | "b" | null`, `key: integer
0-9`). From that follow the JSON schema and the closed vocabulary of each key; no list is kept here.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = re.compile(r"^\s*(?:\d+[.)]\s*|[-*]\s*)?[\"`]?([a-z][a-z0-9_]*)[\"`]?\s*:\s+(\S.*)$")
_OPTION = re.compile(r"\"([^\"]+)\"(?=\s*(?:/|\||,|or\b|$|\s*\(|\s*[—–-]))")
_RANGE = re.compile(r"\b(?:integer|number|float)\b[^0-9]{0,8}(-?\d+)\s*[-–]\s*(\d+)")


@dataclass(frozen=True)
class Field:
    """One key of an answer: text, integer or number; allowed values (empty: free) or range."""

    name: str
    kind: str
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


def prompt_block(document: str, title: str) -> str:
    """The text of the first fenced block after a heading that holds `title`."""
    at = document.find(title)
    m = re.compile(r"```\w*\n(.*?)```", re.S).search(document, at) if at >= 0 else None
    if m is None:
        raise KeyError(f"no prompt {title}")
    return m[1]


def prompt_sha(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


def prompt_fields(prompt: str) -> list[Field]:
    """Keys of a prompt in its order; a key that is explained again keeps its first line."""
    out: dict[str, Field] = {}
    for line in prompt.splitlines():
        m = _LINE.match(line)
        if not m or m[1] in out:
            continue
        name, rest = m[1], m[2]
        number = re.match(r"(integer|number|float)\b", rest)
        options = tuple(dict.fromkeys(_OPTION.findall(rest.split(" — ")[0].split("(")[0])))
        if number:
            r = _RANGE.search(rest)
            out[name] = Field(name, "integer" if number[1] == "integer" else "number", (),
                *((float(r[1]), float(r[2])) if r else (None, None)))
        elif options or re.search(r"\bnull\b|\btext\b|\bstring\b|\bcopy\b|;", rest):
            several = ";" in rest.split("(")[0]
            out[name] = Field(name, "text", () if several else options)
    return list(out.values())


def answer_schema(fields: list[Field]) -> T.StructType:
    kinds = {"text": T.StringType(), "integer": T.LongType(), "number": T.DoubleType()}
    return T.StructType([T.StructField(f.name, kinds[f.kind]) for f in fields])


def parsed_answers(df: DataFrame, answer: str, fields: list[Field]) -> DataFrame:
    """df with `parsed` (struct of the fields), `malformed` and `outside`: names of fields beyond their vocabulary or range.

    A malformed or NULL answer has NULL fields; 'null' as a text is NULL; extra keys are left out.
    """
    schema = T.StructType([*answer_schema(fields), T.StructField("_bad", T.StringType())])
    x = df.withColumn("_a", F.from_json(answer, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    value = {f.name: F.col("_a")[f.name] if f.kind != "text" else F.when(F.lower(F.col("_a")[f.name]) != "null",
            F.col("_a")[f.name]) for f in fields}
    checks = []
    for f in fields:
        v = value[f.name]
        bad = ~v.isin(*f.allowed) if f.allowed else ~v.between(f.low, f.high) if f.low is not None else F.lit(False)
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f.name)))
    parsed = F.struct(*[value[f.name].alias(f.name) for f in fields])
    return x.select(*df.columns, parsed.alias("parsed"),
        (F.col(answer).isNotNull() & (F.col("_a").isNull() | F.col("_a._bad").isNotNull())).alias("malformed"),
        F.array_compact(F.array(*checks)).alias("outside"))
