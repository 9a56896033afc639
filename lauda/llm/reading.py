"""Reading level of documents: a familiar-word formula on corpus document frequencies.

A word is familiar if it stands among the most widespread words of its language, counted in documents
over the whole corpus; nested lists of several lengths tell degrees of familiarity. The level is a
linear formula of the shares of words outside the lists and the average sentence length; its weights
are fitted to readers' levels by ridge regression on moments over all labelled rows, with one formula at
any number of labels.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lauda.session import reliable

#: Lengths of the nested lists of familiar words per language; bounded, whatever the corpus.
LISTS = (25, 50, 100, 150, 200, 300, 450)
FAMILIAR = LISTS[-1]
#: The list that the reported share and the published formula use.
MAIN = 150
LANGUAGES = ("pt", "es", "en")
#: Published weights of the familiar-word formula (share in percent, words a sentence), and the grades that
#: its tables call easiest and hardest: used for `grade`, and for `level` without labels.
BASE, SCALE = (0.1579, 0.0496, 3.6365), (4.9, 9.9)
#: Ridge penalties to choose from, in labelled rows.
PENALTIES = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)
# Function words that tell the language of a text.
FUNCTION_WORDS = {
    "pt": frozenset("que nao de do da em um uma os as com para por se no na ao dos das e foi sao mais como".split()),
    "es": frozenset("que no de del la en un una los las con para por se el al es fue son mas como y".split()),
    "en": frozenset("the of and to in a is that for it with was on are be this by not or from as".split()),
}
_BEYOND = re.compile(r"[^\x00-\x7f]")


@lru_cache(maxsize=65_536)
def _base(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def folded(text: str) -> str:
    """Without accents and case; each distinct character beyond ASCII is replaced once."""
    if not text.isascii():
        for c in set(_BEYOND.findall(text)):
            text = text.replace(c, _base(c))
    return text.lower()


_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PLAIN = re.compile(r"[a-z]+(?:['-][a-z]+)*")  # the same where all is ASCII
_TELLS = [(w, [k for k in LANGUAGES if w in FUNCTION_WORDS[k]]) for w in sorted(set().union(*FUNCTION_WORDS.values()))]
_LETTER = re.compile(r"[^\W\d_]")
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|\n+")
#: Distinct (language, word) pairs that a task counts before it passes them on.
FLUSH = 200_000


def read_words(text: str | None) -> tuple[str | None, Counter]:
    """(language, word counts) of a text: words without case and accents, so that accent-free texts read alike.

    The language is the one whose function words are most frequent; ties go to pt, es, en in turn.
    """
    if not isinstance(text, str):
        return None, Counter()
    text = folded(text)
    ws = Counter((_PLAIN if text.isascii() else _WORD).findall(text))
    if not ws:
        return None, ws
    n, count = dict.fromkeys(LANGUAGES, 0), ws.get
    for w, languages in _TELLS:
        if c := count(w):
            for k in languages:
                n[k] += c
    return max(LANGUAGES, key=n.get), ws


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(language, word, df): in how many documents each word stands, over the whole corpus."""

    def rows(count):
        return pd.DataFrame([(*k, n) for k, n in count.items()], columns=["language", "word", "df"])

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for text in b.text:
                lang, ws = read_words(text)
                c.update((lang, w) for w in ws)
                if len(c) > FLUSH:
                    yield rows(c)
                    c = Counter()
        yield rows(c)

    return documents.select("text").mapInPandas(count, "language string, word string, df long").groupBy("language",
        "word").agg(F.sum("df").alias("df"))


def familiar_words(documents: DataFrame) -> DataFrame:
    """(language, word, df, r): the FAMILIAR most widespread words of each language.

    The rank first runs within slices of the vocabulary, so that no task sees all words.
    """
    cut = document_frequencies(documents).withColumn("p", F.pmod(F.xxhash64("word"), F.lit(64)))
    by = Window.partitionBy("language", "p").orderBy(F.desc("df"), "word")
    top = cut.withColumn("r", F.row_number().over(by)).where(F.col("r") <= FAMILIAR)
    by = Window.partitionBy("language").orderBy(F.desc("df"), "word")
    return top.withColumn("r", F.row_number().over(by)).where(F.col("r") <= FAMILIAR).select("language", "word", "df", "r")


MEASURES = "doc_id long, language string, n_words int, n_sentences int, unfamiliar array<double>, asl double"


def measures(documents: DataFrame) -> DataFrame:
    """Words, sentences, shares of words outside the lists and average sentence length of every document.

    NULL, empty and wordless texts have 0 words and NULL measures.
    """
    rows = familiar_words(documents).collect()  # at most FAMILIAR words a language
    shared = documents.sparkSession.sparkContext.broadcast({k: {r["word"]: bisect_left(LISTS,
                r["r"]) for r in rows if r["language"] == k} for k in LANGUAGES})

    def apply(batches):
        for b in batches:
            out = []
            for doc, text in zip(b.doc_id, b.text):
                lang, ws = read_words(text)
                if not ws:
                    out.append((doc, None, 0, 0, None, None))
                    continue
                known, total = shared.value[lang], ws.total()
                hits = [0] * len(LISTS)
                for w, n in ws.items():
                    r = known.get(w)
                    if r is not None:
                        hits[r] += n
                shares = (1 - np.cumsum(hits) / total).tolist()
                n = max(1, sum(1 for x in _SENTENCE.split(text) if _LETTER.search(x)))
                out.append((doc, lang, total, n, shares, total / n))
            yield pd.DataFrame(out, columns=["doc_id", "language", "n_words", "n_sentences", "unfamiliar", "asl"])

    return documents.select("doc_id", "text").mapInPandas(apply, MEASURES)


def _terms() -> list:
    """The formula's terms: logarithm of the average sentence length, its square, shares outside the lists, their products."""
    s, u = F.log(F.col("asl") + 1), [F.col("unfamiliar")[i] for i in range(len(LISTS))]
    return [s, s * s, *u, *(x * s for x in u)]


def ridge(n: float, mean: np.ndarray, cov: np.ndarray, y: float, cross: np.ndarray, var: float) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a ridge formula from the moments of its terms and of the labels.

    Terms are scaled to unit variance; the penalty is the one of PENALTIES with the least generalised
    cross-validation error, so few labels give smooth formulas and one label its own level for all.
    """
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    use = sd > 1e-9
    w = np.zeros(len(sd))
    if use.any() and var > 1e-12:
        sd = sd[use]
        e, q = np.linalg.eigh(cov[np.ix_(use, use)] / np.outer(sd, sd))
        e, c = np.maximum(e, 0), q.T @ (cross[use] / sd)
        best = np.inf
        for p in PENALTIES:
            b = c / (e + p / n)
            rest, free = var - 2 * b @ c + (b * b) @ e, n - 1 - (e / (e + p / n)).sum()
            error = max(rest, 0.0) / max(free, 1e-3) ** 2
            if error < best:
                best, w[use] = error, (q @ b) / sd
    return float(y - w @ mean), w


def fit(measured: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray] | None:
    """(intercept, weights of the terms) fitted to all labelled rows, of any number; None without any."""
    rows = measured.where("n_words > 0").join(labels.where("nivel IS NOT NULL").select("doc_id",
            F.col("nivel").cast("double").alias("y")),
        "doc_id")
    x = [F.lit(1.0), *_terms(), F.col("y")]
    n = len(x)

    def products(batches):
        total = np.zeros((n, n))
        for b in batches:
            v = b.to_numpy(float)
            total += v.T @ v
        yield pd.DataFrame({"i": range(n * n), "v": total.ravel()})

    # one row per pair of terms and partition, combined before the driver sees them
    sums = rows.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).mapInPandas(products,
        "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(n * n)
    for r in sums:
        m[r["i"]] = r["v"]
    m = m.reshape(n, n)
    count = m[0, 0]
    if not count:
        return None
    mean = m[0, 1:] / count
    cov = m[1:, 1:] / count - np.outer(mean, mean)
    return ridge(count, mean[:-1], cov[:-1, :-1], mean[-1], cov[:-1, -1], cov[-1, -1])


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, language, n_words, unfamiliar, asl, grade, level) of every document.

    grade is the familiar-word formula with its published weights, level the estimate on the readers'
    scale, 1 (easiest) to 5, NULL only for texts without words. One formula serves any number of labels;
    without any, level is the grade brought to the scale. Repeated rows each get their row.
    """
    m = reliable(measures(documents))
    fitted = fit(m, labels)
    u = F.col("unfamiliar")[LISTS.index(MAIN)]
    grade = 100 * BASE[0] * u + BASE[1] * F.col("asl") + F.when(u > 0.05, BASE[2]).otherwise(0.0)
    if fitted is None:
        level = 1 + 4 * (grade - SCALE[0]) / (SCALE[1] - SCALE[0])
    else:
        level = sum((F.lit(float(c)) * t for c, t in zip(fitted[1], _terms())), F.lit(fitted[0]))
    level = F.when(F.col("n_words") > 0, F.least(F.lit(5.0), F.greatest(F.lit(1.0), level)))
    return m.select("doc_id", "language", "n_words", F.round(u, 6).alias("unfamiliar"), F.round("asl", 4).alias("asl"),
        F.round(grade, 4).alias("grade"), F.round(level, 3).alias("level"))
