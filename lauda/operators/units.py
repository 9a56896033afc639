"""Quantities recorded in different units, brought to the common unit of their variable.

Per history (source, variable), ordered by time, every record is a point on a log scale. The units a
variable may be written in give a few known log factors, so the exact penalised changepoint search
is a shortest path over those levels: a stated unit fixes the level of its record, a bare number
costs its robust distance from the variable's usual log value, and every level shift costs a
penalty. Levels other than zero mark unit changes, which are reversed. The search is a min-plus
matrix product, which is associative: partitions of one long history are reduced to one small matrix
each, joined on the driver, and traced back in parallel.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.operators.range_scan import numbered, range_sorted, summaries
from lauda.session import maybe_broadcast, reliable

# Spellings of units (accents and case folded) with dimension and size in mm, g or mL.
UNITS = {
    "mm": ("length", "1"), "milimetro": ("length", "1"), "milimetros": ("length", "1"), "millimeter": ("length", "1"),
    "millimeters": ("length", "1"),
    "cm": ("length", "10"), "cms": ("length", "10"), "centimetro": ("length", "10"), "centimetros": ("length", "10"),
    "dm": ("length", "100"), "m": ("length", "1000"), "metro": ("length", "1000"), "metros": ("length", "1000"),
    "um": ("length", "0.001"), "μm": ("length", "0.001"), "micra": ("length", "0.001"), "micras": ("length", "0.001"),
    "micron": ("length", "0.001"),
    "microns": ("length", "0.001"), "micrometro": ("length", "0.001"), "micrometros": ("length", "0.001"),
    "pol": ("length", "25.4"), "polegada": ("length", "25.4"), "polegadas": ("length", "25.4"), "in": ("length", "25.4"),
    "inch": ("length", "25.4"), "inches": ("length", "25.4"),
    "g": ("mass", "1"), "gr": ("mass", "1"), "grs": ("mass", "1"), "grama": ("mass", "1"), "gramas": ("mass", "1"),
    "kg": ("mass", "1000"), "kgs": ("mass", "1000"), "quilo": ("mass", "1000"), "quilos": ("mass", "1000"),
    "quilograma": ("mass", "1000"), "quilogramas": ("mass", "1000"),
    "mg": ("mass", "0.001"), "miligrama": ("mass", "0.001"), "miligramas": ("mass", "0.001"), "ug": ("mass", "0.000001"),
    "μg": ("mass", "0.000001"), "mcg": ("mass", "0.000001"),
    "ml": ("volume", "1"), "mililitro": ("volume", "1"), "mililitros": ("volume", "1"), "cc": ("volume", "1"),
    "cm3": ("volume", "1"),
    "l": ("volume", "1000"), "lt": ("volume", "1000"), "litro": ("volume", "1000"), "litros": ("volume", "1000"),
    "dl": ("volume", "100"), "decilitro": ("volume", "100"), "decilitros": ("volume", "100"), "cl": ("volume", "10"),
    "centilitro": ("volume", "10"), "centilitros": ("volume", "10"),
    "ul": ("volume", "0.001"), "μl": ("volume", "0.001"), "microlitro": ("volume", "0.001"), "microlitros": ("volume", "0.001"),
    "%": ("share", "1"),
}
# Words before a measure that belongs to an instrument or a procedure.
FOREIGN = re.compile(r"(introduzid[oa] (?:por|ate)|calibre(?: de)?|pinca de|fixad[oa] por|agulha (?:de )?|aparelho de|lamina de)\s*$")
_NUM = r"\d+(?:[.,]\d+)*"
MEASURE = re.compile(rf"(?<![\w.,])({_NUM}(?:\s*[x×]\s*{_NUM})*)\s*(?:([^\W\d_]+3?|[%])(?:\([a-z]+\))?\.?|[\"”″])?", re.I)
#: Penalty of a level shift and cost of contradicting a stated unit, in squared robust deviations.
SHIFT_PENALTY = 12.0
STATED = 1e6
#: The squared deviation is truncated here (a robust loss): one odd value can't outweigh the penalty alone.
BARE_CAP = 9.0


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def number(s: str) -> Decimal:
    """A decimal with either mark; of several marks the last is the decimal one."""
    parts = re.split(r"[.,]", s)
    return Decimal(parts[0]) if len(parts) == 1 else Decimal("".join(parts[:-1]) + "." + parts[-1])


def measures(s: str, dimension: str) -> list[tuple[list[Decimal], str | None, Decimal | None, str]]:
    """(numbers, unit, factor, text before) of each measure; unit is None if none of the dimension follows."""
    s, out = fold(s), []
    for m in MEASURE.finditer(s):
        unit = m[2] if m[2] else ("in" if m[0][-1:] in '"”″' else None)
        known = UNITS.get(unit) if unit else None
        ok = known is not None and known[0] == dimension
        nums = [number(x) for x in re.split(r"\s*[x×]\s*", m[1])]
        out.append((nums, unit if ok else None, Decimal(known[1]) if ok else None, s[max(0, m.start() - 24) : m.start()]))
    return out


def read_case(value: str | None, text: str | None, unit: str | None) -> tuple[Decimal | None, list[Decimal], str | None]:
    """(number, factors, where) of one record: the factors to the common unit it may have been stated with.

    where is 'value', 'text' (measures of the text hold the same number, in one unit or in several) or
    'converted' (the text holds the same quantity in another unit, so the number is in the common one).
    A bare number has no factor. Blank values, values without a number and variables without a known
    unit give (None, [], None). Zero is a quantity as any other.
    """
    if not value or not value.strip() or not unit or fold(unit) not in UNITS:
        return None, [], None
    dimension, base = UNITS[fold(unit)]
    base = Decimal(base)
    own = measures(value, dimension)
    if not own:
        return None, [], None
    stated = [m for m in own if m[2] is not None]
    if stated:
        best = max(stated, key=lambda m: max(m[0]) * m[2])
        return max(best[0]), [best[2] / base], "value"
    n = max(x for m in own for x in m[0])
    seen = [m for m in measures(text or "", dimension) if m[2] is not None and not FOREIGN.search(m[3])]
    same = {m[2] / base for m in seen if n in m[0]}
    if same:
        return n, sorted(same, reverse=True), "text"
    if any(x * m[2] / base == n for m in seen for x in m[0]):
        return n, [Decimal(1)], "converted"
    return n, [], None


CASES = "case_no long, source string, variable string, t long, num double, factors array<double>, millis array<long>, stated string"


def parse_cases(cases: DataFrame, specs: DataFrame) -> DataFrame:
    """Records with their number, the factors they may be stated with and the thousandths of the common unit by each."""
    units = specs.where(F.col("unit").isNotNull()).groupBy("variable").agg(F.min("unit").alias("unit"))
    long = cases.select("case_no", "source", "variable", F.unix_micros("added_at").alias("t"), "expected_value", "text").join(
        maybe_broadcast(units), "variable"
    )

    def parse(batches):
        for b in batches:
            rows = []
            for c, s, v, t, value, text, unit in b[["case_no", "source", "variable", "t", "expected_value", "text",
                    "unit"]].itertuples(index=False,
                name=None):
                n, fs, where = read_case(value, text, unit)
                if n is not None:
                    millis = [int((n * f * 1000).to_integral_value("ROUND_HALF_UP")) for f in fs]
                    rows.append((c, s, v, None if pd.isna(t) else int(t), float(n), [float(f) for f in fs], millis, where))
            d = pd.DataFrame(rows, columns=["case_no", "source", "variable", "t", "num", "factors", "millis", "stated"])
            d["t"] = d.t.astype("Int64")
            yield d

    # units has one row per variable of the ontology: a vocabulary, not data
    return long.mapInPandas(parse, CASES)


def levels_of(unit: str) -> list[float]:
    """Factors to the common unit of every unit of its dimension, whatever their size."""
    dimension, base = UNITS[fold(unit)]
    return sorted({float(Decimal(f) / Decimal(base)) for d, f in UNITS.values() if d == dimension})


class Levels:
    """Costs of a variable's levels for its records."""

    def __init__(self, factors: list[float], mu: float, sd: float, penalty: float = SHIFT_PENALTY):
        self.factors, self.mu, self.sd, self.penalty = np.array(factors), mu, sd, penalty
        self.logs, self.at = np.log10(self.factors), {f: i for i, f in enumerate(factors)}

    def costs(self, nums: list[float], stated: list) -> np.ndarray:
        """One row per record: the truncated squared robust deviation of the quantity that each level makes of it.

        A stated unit leaves its level only; of several the search decides. A bare number is in the
        common unit unless its history says otherwise. A zero tells nothing of its level.
        """
        x = np.asarray(nums, float)
        with np.errstate(divide="ignore"):
            c = np.minimum(((np.log10(x)[:, None] + self.logs - self.mu) / self.sd) ** 2, BARE_CAP)
        c[x == 0] = 0.0
        for i, fs in enumerate(stated):
            if len(fs):
                keep = [self.at[f] for f in fs]
                own = c[i, keep] if len(keep) > 1 else 0.0
                c[i] = STATED
                c[i, keep] = own
            else:
                c[i] += self.factors != 1.0
        return c


def min_plus(costs: np.ndarray, penalty: float = SHIFT_PENALTY) -> np.ndarray:
    """Min-plus matrix of a stretch of records (state at its first record, state at its last), by halving."""
    n, k = costs.shape
    eye = np.eye(k) > 0
    m = np.where(eye[None], costs[:, None, :], np.inf)
    shift = np.where(eye, 0.0, penalty)
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        a, b = m[0 : len(m) - len(odd) : 2], m[1 : len(m) : 2][: len(m) // 2]
        a = (a[:, :, :, None] + shift[None, None]).min(axis=2)
        m = np.concatenate([(a[:, :, :, None] + b[:, None]).min(axis=2), odd])
    return m[0]


def joined(a: np.ndarray | None, b: np.ndarray, penalty: float = SHIFT_PENALTY) -> np.ndarray:
    """Matrix of two stretches of one history, one after the other."""
    if a is None:
        return b
    a = (a[:, :, None] + np.where(np.eye(len(b)) > 0, 0.0, penalty)[None]).min(axis=1)
    return (a[:, :, None] + b[None]).min(axis=1)


def pieces(batches):
    """(key, rows) of each stretch of one history inside one batch; long histories come in several pieces."""
    for b in batches:
        key = b.source.fillna("\0").to_numpy() + "\1" + b.variable.to_numpy()  # NULL sources are one history
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(b)]
        for i, j in zip(cut, cut[1:]):
            yield key[i], b.iloc[i:j]


class Tracer:
    """Cheapest path through one history's part of a partition, record by record.

    Only back-pointers and the rows they decide are held: as soon as all states come from one state, the
    path up to there is settled and its rows are passed on.
    """

    def __init__(self, levels: Levels, begin: int | None, before: int | None = None):
        self.levels, self.alpha = levels, None
        self.last = None if before is None else levels.factors[before]
        self.begin, self.back, self.held = begin, [], []

    def add(self, rows: pd.DataFrame):
        costs = self.levels.costs(rows.num.to_list(), rows.factors.to_list())
        self.held.append(rows)
        for c in costs:
            if self.alpha is None:
                self.alpha = c.copy()
                if self.begin is not None:
                    self.alpha[np.arange(len(c)) != self.begin] = np.inf
                continue
            best = int(self.alpha.argmin())
            move = self.alpha[best] + self.levels.penalty < self.alpha
            self.back.append(np.where(move, best, np.arange(len(c))))
            self.alpha = np.where(move, self.alpha[best] + self.levels.penalty, self.alpha) + c
        for i in range(len(self.back) - 1, -1, -1):  # the latest record at which all paths meet
            if (self.back[i] == self.back[i][0]).all():
                yield self._settle(i + 1, int(self.back[i][0]))
                break

    def _settle(self, n: int, state: int) -> pd.DataFrame:
        """The first n held records, of which the last is in the given state."""
        path = [state]
        for b in reversed(self.back[: n - 1]):
            path.append(int(b[path[-1]]))
        rows = pd.concat(self.held, ignore_index=True) if len(self.held) > 1 else self.held[0]
        self.held, self.back = [rows.iloc[n:]], self.back[n:]
        d, level = rows.iloc[:n].copy(), self.levels.factors[path[::-1]]
        before = np.r_[level[0] if self.last is None else self.last, level[:-1]]
        self.last = level[-1]
        pick = [list(fs).index(f) if f in fs else None for fs, f in zip(d.factors, level)]
        d["milli"] = pd.array([None if i is None else ms[i] for i, ms in zip(pick, d.millis)], "Int64")
        d["factor"] = [None if i is None else f for i, f in zip(pick, level)]
        d["level_factor"], d["segment_change"] = level, level != before
        return d[[x.split()[0] for x in TRACED.split(", ")]]

    def end(self, state: int | None):
        n = sum(map(len, self.held))
        if n:
            yield self._settle(n, int(self.alpha.argmin()) if state is None else state)


TRACED = "case_no long, source string, variable string, num double, factor double, stated string, milli long, level_factor double, segment_change boolean"


def fixed_states(ends: list, sizes: dict[str, int], penalty: float = SHIFT_PENALTY) -> dict:
    """(partition, 0 first or 1 last history) -> (state at its first record, at its last, before it) of histories cut by partitions."""
    fixed, chain = {}, []
    for r in [*ends, None]:
        if chain and (r is None or r["key"] != chain[0]["key"]):
            k = sizes[chain[0]["variable"]]
            s, ms = np.where(np.eye(k) > 0, 0.0, penalty), [np.array(x["m"]).reshape(k, k) for x in chain]
            alpha, back = ms[0].min(axis=0), []
            for m in ms[1:]:
                step = (alpha[:, None] + s).min(axis=0)[:, None] + m  # by the state the next part begins in
                back.append((alpha, step))
                alpha = step.min(axis=0)
            end = int(alpha.argmin())
            for i in range(len(ms) - 1, -1, -1):
                begin = int((back[i - 1][1][:, end] if i else ms[0][:, end]).argmin())
                before = int((back[i - 1][0] + s[:, begin]).argmin()) if i else None
                fixed[(chain[i]["pid"], chain[i]["pos"])] = (begin, end, before)
                end = before
            chain = []
        if r is not None:
            chain.append(r)
    return fixed


def unit_history(cases: DataFrame, specs: DataFrame, penalty: float = SHIFT_PENALTY) -> DataFrame:
    """Records with the level of their segment.

    Columns: case_no, source, variable, num, factor (stated, or NULL; where the text states several for
    the same number, the one of the segment), stated, milli, level_factor (the factor that the segment's
    level stands for), segment_change (true where the level differs from that of the record before in
    the same history).
    Records without a number or with a variable without unit are left out, zeros are kept; NULL sources
    form a history of their own; records without time come first; ties are ordered by case_no. Repeated
    records stay, each a point of its history. Empty input gives an empty result.
    """
    parsed = reliable(parse_cases(cases, specs))
    spec_rows = specs.where(F.col("unit").isNotNull()).groupBy("variable").agg(F.min("unit").alias("unit")).collect()
    factors = {r["variable"]: levels_of(r["unit"]) for r in spec_rows if fold(r["unit"]) in UNITS}
    sure = F.when(F.size("millis") == 1, F.col("millis")[0])
    usual = parsed.where(sure > 0).groupBy("variable").agg(F.avg(F.log10(sure / 1000)).alias("mu"),
        F.stddev(F.log10(sure / 1000)).alias("sd"))
    stats = {r["variable"]: (r["mu"], max(r["sd"] or 0.0, 0.15)) for r in usual.collect()}  # one row per variable
    levels = {v: Levels(fs, *stats.get(v, (0.0, 10.0)), penalty) for v, fs in factors.items()}
    ordered = range_sorted(parsed, ["source", "variable", "t", "case_no"])

    def summarise(batches):
        """Matrices of the first and the last history of a partition; only these can go on in another one."""
        pid, batches = numbered(batches)
        ends, m, key, variable = [], None, None, None
        for k, rows in pieces(batches):
            if k != key:
                if key is not None and not ends:
                    ends.append((pid, 0, key, variable, m.ravel().tolist()))
                m, key, variable = None, k, rows.variable.iloc[0]
            m = joined(m, min_plus(levels[variable].costs(rows.num.to_list(), rows.factors.to_list()), penalty), penalty)
        if key is not None:
            ends.append((pid, len(ends), key, variable, m.ravel().tolist()))
        yield pd.DataFrame(ends, columns=["pid", "pos", "key", "variable", "m"])

    ends = sorted(summaries(ordered, summarise, "pid int, pos int, key string, variable string, m array<double>"),
        key=lambda r: (r["pid"], r["pos"]))
    fixed, last = fixed_states(ends, {v: len(fs) for v, fs in factors.items()}, penalty), {r["pid"]: r["key"] for r in ends}

    def trace(batches):
        pid, batches = numbered(batches)
        at, key, cur = 0, None, None
        known = lambda: fixed.get((pid, 0)) if at == 0 else fixed.get((pid, 1)) if key == last[pid] else None
        for k, rows in pieces(batches):
            if k != key:
                if cur is not None:
                    yield from cur.end(known()[1] if known() else None)
                    at += 1
                key = k
                cur = Tracer(levels[rows.variable.iloc[0]], known()[0] if known() else None, known()[2] if known() else None)
            yield from cur.add(rows)
        if cur is not None:
            yield from cur.end(known()[1] if known() else None)

    return ordered.mapInPandas(trace, TRACED)


def foreign_units(cases: DataFrame, specs: DataFrame, penalty: float = SHIFT_PENALTY) -> DataFrame:
    """(case_no, value_milli) of records in another unit than their variable's common one.

    A record is one if the level of its segment isn't the common unit and its unit is stated, in the
    value or with the same number in the text; by TESTDATA a number whose unit only its neighbours tell
    is no case. Where the text gives the number with several units, the search decides between them.
    """
    h = unit_history(cases, specs, penalty)
    return h.where((F.abs(F.col("level_factor") - 1) > 1e-9) & F.col("factor").isNotNull()).select("case_no",
        F.col("milli").alias("value_milli"))
