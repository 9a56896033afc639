"""Visually identical text: one consistent form by a Viterbi search over look-alike lattices."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.llm.chars import LOOKALIKES, SECOND, SUSPECT, simple_form
from lauda.llm.charlm import CharModel

_HAS = re.compile("[" + "".join(LOOKALIKES) + "]")
_WORD = re.compile(r"\S+")
#: log cost of a change of script between neighbouring letters.
MIXED = 6.0
#: Lead of a Greek letter that stands alone before a hyphen (a name such as α-actin), against few counts.
SYMBOL = 8.0


def _script(c: str) -> str:
    return "" if not c.isalpha() else "x" if c in LOOKALIKES else "l"


def best_reading(left: str, word: str, right: str, lm: CharModel) -> str:
    """The most probable reading of a word whose letters may be look-alikes.

    Every letter of another script may be itself or its Latin look-alikes; paths are scored by
    character trigrams with the neighbours in view and a cost for each change of script.
    """
    beams = {left[-2:].rjust(2): (0.0, "")}
    for at, c in enumerate(word + right[:2].ljust(2)):
        symbol = "α" <= c <= "ω" and word[at + 1 : at + 2] == "-" and not word[at - 1 : at].isalpha()
        options = [c, LOOKALIKES[c]] + ([SECOND[c]] if c in SECOND else []) if c in LOOKALIKES else [c]
        nxt: dict = {}
        for ctx, (score, path) in beams.items():
            for o in options:
                k = lm.key(o)
                s = score + lm.trigram(lm.key(ctx[0]), lm.key(ctx[1]), k)
                a, b = _script(ctx[1]), _script(o)
                if a and b and a != b:
                    s -= MIXED
                if symbol and o == c:
                    s += SYMBOL
                state = ctx[1] + o
                if state not in nxt or s > nxt[state][0]:
                    nxt[state] = (s, path + o)
        beams = nxt
    return max(beams.values())[1][: len(word)]


def consistent_form(text: str | None, lm: CharModel) -> str | None:
    """The one consistent form of a text; NULL and empty texts stay as they are."""
    if not text:
        return text
    t = simple_form(text)
    if not _HAS.search(t):
        return t
    out, at = [], 0
    for m in _WORD.finditer(t):
        if _HAS.search(m[0]):
            w = best_reading("".join(out)[-2:] + t[at : m.start()] if at < m.start() else t[: m.start()], m[0],
                t[m.end() : m.end() + 2], lm)
            out += [t[at : m.start()], w]
            at = m.end()
    return "".join(out) + t[at:]


def needs_search(column: str):
    """JVM test: does a text hold any character that may stand in for another?"""
    return F.coalesce(F.col(column).rlike(SUSPECT), F.lit(False))


def with_consistent_form(texts: DataFrame, key: str, column: str, counts: dict[int, int]) -> DataFrame:
    """(key, form, stands_in) of the rows that needs_search keeps; all other rows are in form already.

    stands_in is true where the form differs from the stored text. NULL and empty texts aren't
    suspect; texts of any length are processed whole; repeated rows each get their row.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def apply(batches):
        lm, cache = CharModel(shared.value), {}
        for b in batches:
            forms = []
            for t in b[column]:
                f = cache.get(t)
                if f is None:
                    f = consistent_form(t, lm)
                    if len(cache) < 20_000:
                        cache[t] = f
                forms.append(f)
            yield pd.DataFrame({key: b[key], "form": forms, "stands_in": [f != t for f, t in zip(forms, b[column])]})

    return texts.where(needs_search(column)).select(key, column).mapInPandas(apply, f"{key} long, form string, stands_in boolean")
