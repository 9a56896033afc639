"""Detectors as data: one declaration gives the Spark Column and the equivalent SQL.

Three combinators cover the extraction rules: a first-match cascade (with guards), a multi-label
collection, and a number taken from the first pattern that matches. Patterns have no lookaround, so
that both regex engines read them alike; guards look at a bounded prefix instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lauda.functions.text import first_start


@dataclass(frozen=True)
class Rule:
    """A label for texts that hold a pattern; unless `unless` stands in the `reach` characters before its first match, or `without` inside it.

    `also` must stand somewhere too; `absent` must not, once what `ignoring` matches is taken out; of
    `features` at least two must.
    """

    pattern: str
    label: str
    unless: str | None = None
    reach: int = 40
    without: str | None = None
    also: str | None = None
    absent: str | None = None
    ignoring: str = "^x^"
    features: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cascade:
    """The label of the first rule that holds; `default` (or NULL) if none does."""

    name: str
    rules: tuple[Rule, ...]
    default: str | None = None
    #: Literals of which every rule's match holds one: texts with none of them skip all patterns.
    anchors: tuple[str, ...] = ()

    def _holds(self, t: Column, r: Rule) -> Column:
        hit = t.rlike(r.pattern)
        if r.unless:
            start = F.regexp_instr(t, F.lit(r.pattern)) - 1
            lo = F.greatest(start - r.reach, F.lit(0))
            hit = hit & ~F.substring(t, lo + 1, start - lo).rlike(r.unless)
        if r.without:
            hit = hit & ~F.regexp_extract(t, r.pattern, 0).rlike(r.without)
        if r.also:
            hit = hit & t.rlike(r.also)
        if r.absent:
            hit = hit & ~F.regexp_replace(t, r.ignoring, "").rlike(r.absent)
        if r.features:
            hit = hit & (reduce(add, [t.rlike(p).cast("int") for p in r.features]) >= 2)
        return hit

    def column(self, t: Column) -> Column:
        """(value, span_start, evidence) of a normalised text."""
        none = out = F.struct(F.lit(self.default).cast("string").alias("value"), F.lit(None).cast("int").alias("span_start"),
            F.lit(None).cast("string").alias("evidence"))
        for r in reversed(self.rules):
            got = F.struct(F.lit(r.label).alias("value"), first_start(t, r.pattern).alias("span_start"),
                F.substring(F.regexp_extract(t, r.pattern, 0), 1, 80).alias("evidence"))
            out = F.when(self._holds(t, r), got).otherwise(out)
        if not self.anchors:
            return out
        return F.when(reduce(or_, [t.contains(a) for a in self.anchors]), out).otherwise(none)

    def sql(self, t: str) -> tuple[str, str]:
        """SQL of value and span_start."""
        value, start = [], []
        for r in self.rules:
            cond = f"regexp_matches({t}, '{r.pattern}')"
            at = f"length(regexp_extract({t}, '(?s)^(.*?)(?:{r.pattern})', 1))"
            if r.unless:
                lo = f"greatest({at} - {r.reach}, 0)"
                cond += f" AND NOT regexp_matches(substring({t}, {lo} + 1, {at} - {lo}), '{r.unless}')"
            if r.without:
                cond += f" AND NOT regexp_matches(regexp_extract({t}, '{r.pattern}', 0), '{r.without}')"
            if r.also:
                cond += f" AND regexp_matches({t}, '{r.also}')"
            if r.absent:
                cond += f" AND NOT regexp_matches(regexp_replace({t}, '{r.ignoring}', '', 'g'), '{r.absent}')"
            if r.features:
                cond += " AND (" + " + ".join(f"CAST(regexp_matches({t}, '{p}') AS INTEGER)" for p in r.features) + ") >= 2"
            value.append(f"WHEN {cond} THEN '{r.label}'")
            start.append(f"WHEN {cond} THEN {at}")
        default = f"'{self.default}'" if self.default is not None else "NULL"
        return f"CASE {' '.join(value)} ELSE {default} END", f"CASE {' '.join(start)} END"


@dataclass(frozen=True)
class MultiLabel:
    """All labels whose pattern stands in the text, joined in fixed order; NULL if none does."""

    name: str
    rules: tuple[Rule, ...]

    def column(self, t: Column) -> Column:
        labels = F.array_compact(F.array(*[F.when(t.rlike(r.pattern), F.lit(r.label)) for r in self.rules]))
        return F.when(F.size(labels) > 0, F.array_join(labels, ";"))

    def sql(self, t: str) -> str:
        return "NULLIF(concat_ws(';', " + ", ".join(f"CASE WHEN regexp_matches({t}, '{r.pattern}') THEN '{r.label}' END" for r in self.rules) + "), '')"


@dataclass(frozen=True)
class Number:
    """A number from the first pattern that matches: a group, the floored midpoint of two (`any`: of one or two), or a constant."""

    name: str
    rules: tuple[tuple, ...] = field(default_factory=tuple)  # (pattern, 'one' | 'mid' | 'any' | int)
    low: int = 0
    high: int = 100

    def column(self, t: Column) -> Column:
        out = F.lit(None).cast("int")
        for p, how in reversed(self.rules):
            n = lambda g, p=p: F.regexp_extract(t, p, g).try_cast("int")
            v = n(1) if how == "one" else F.floor((n(1) + n(2)) / 2).cast("int") if how == "mid" else F.coalesce(F.floor((n(1) + n(2)) / 2).cast("int"),
                n(1)) if how == "any" else F.lit(int(how))
            out = F.when(t.rlike(p), v).otherwise(out)
        return F.when(out.between(self.low, self.high), out)

    def evidence(self, t: Column) -> Column:
        """The text of the pattern that gives the number, at most 80 characters."""
        out = F.lit(None).cast("string")
        for p, _ in reversed(self.rules):
            out = F.when(t.rlike(p), F.substring(F.trim(F.regexp_extract(t, p, 0)), 1, 80)).otherwise(out)
        return out

    def sql_evidence(self, t: str) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN left(trim(regexp_extract({t}, '{p}', 0)), 80)" for p,
            _ in self.rules) + " END"

    def sql(self, t: str) -> str:
        parts = []
        for p, how in self.rules:
            n = lambda g, p=p: f"TRY_CAST(regexp_extract({t}, '{p}', {g}) AS INTEGER)"
            v = n(1) if how == "one" else f"({n(1)} + {n(2)}) // 2" if how == "mid" else f"COALESCE(({n(1)} + TRY_CAST(NULLIF(regexp_extract({t}, '{p}', 2), '') AS INTEGER)) // 2, {n(1)})" if how == "any" else str(int(how))
            parts.append(f"WHEN regexp_matches({t}, '{p}') THEN {v}")
        case = f"CASE {' '.join(parts)} END"
        return f"CASE WHEN {case} BETWEEN {self.low} AND {self.high} THEN {case} END"


@dataclass(frozen=True)
class Extract:
    """The text of a pattern's group, without what follows the first match of `cut`; NULL if nothing is left."""

    name: str
    pattern: str
    cut: str

    def column(self, t: Column) -> Column:
        x = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, self.pattern, 1)), f"(?s){self.cut}", ""))
        return F.when(x != "", x)

    def sql(self, t: str) -> str:
        return f"NULLIF(trim(regexp_replace(trim(regexp_extract({t}, '{self.pattern}', 1)), '(?s){self.cut}', '')), '')"


@dataclass(frozen=True)
class Mapped:
    """The label of what the first pattern's group holds; a pattern whose group has no label leaves it to the next."""

    name: str
    rules: tuple[tuple[str, tuple[tuple[str, str], ...]], ...]

    def column(self, t: Column) -> Column:
        def one(p, labels):
            g, out = F.regexp_extract(t, p, 1), F.lit(None).cast("string")
            for k, v in labels:
                out = F.when(g == k, v).otherwise(out)
            return out

        return F.coalesce(*[one(p, labels) for p, labels in self.rules])

    def sql(self, t: str) -> str:
        case = lambda p, labels: f"CASE regexp_extract({t}, '{p}', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels) + " END"
        return "COALESCE(" + ", ".join(case(p, labels) for p, labels in self.rules) + ")"


@dataclass(frozen=True)
class Repaired:
    """The text of the first pattern's group, trimmed, with a replacement that mends how it was written."""

    name: str
    rules: tuple[tuple[str, str, str], ...]  # (pattern, find, replacement with \\1)

    def column(self, t: Column) -> Column:
        x = lambda p: F.trim(F.regexp_extract(t, p, 1))
        return F.coalesce(*[F.when(x(p) != "", F.trim(F.regexp_replace(x(p), find, to.replace("\\", "$")))) for p, find, to in self.rules])

    def sql(self, t: str) -> str:
        return "COALESCE(" + ", ".join(f"trim(regexp_replace(NULLIF(trim(regexp_extract({t}, '{p}', 1)), ''), '{find}', '{to}'))" for p, find, to in self.rules) + ")"
