"""Queries of problems 7 (token ids), 8 (leaked evaluation texts) and 9 (reading level)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.functions.text import FOLD_FROM, FOLD_TO
from lauda.llm.leakage import leaks
from lauda.llm.reading import BASE, FAMILIAR, FUNCTION_WORDS, MAIN, familiar_words, reading_levels
from lauda.llm.tokenizer import encoded
from lauda.sources.tables import table


def p7_ids(spark, d):
    return encoded(table(spark, d, "documents"))


def p7_offsets(spark, d):
    """Token ids with the code-point offset of the slice each token belongs to."""
    return encoded(table(spark, d, "documents"), offsets=True)


def p8_found(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_items(spark, d):
    """Leaked items with the number of documents that carry them."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p9_levels(spark, d):
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_label"))


def p9_grades(spark, d):
    """Language, length and the published familiar-word grade of every document."""
    return p9_levels(spark, d).select("doc_id", "language", "n_words", "unfamiliar", "asl", "grade")


def p9_familiar(spark, d):
    return familiar_words(table(spark, d, "documents"))


QUERIES = {"p7_ids": p7_ids, "p7_offsets": p7_offsets, "p8_found": p8_found, "p8_items": p8_items, "p9_levels": p9_levels,
    "p9_grades": p9_grades, "p9_familiar": p9_familiar}

_RUNS = """SELECT {k}, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT {k}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {k}, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}) WHERE len(w) >= 12)"""
_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_RUNS.format(k='doc_id', t='documents')}) JOIN (SELECT DISTINCT item_id, r FROM ({_RUNS.format(k='item_id', t='eval_item')})) USING (r)"
_FOLDED = f"lower(regexp_replace(translate(text, '{FOLD_FROM}', '{FOLD_TO}'), '\\p{{M}}+', '', 'g'))"
_COUNT = {k: f"len(list_filter(w, lambda x: list_contains({sorted(v)!r}, x)))" for k, v in FUNCTION_WORDS.items()}

ORACLE = {
    "p8_found": _LEAKS,
    "p8_items": f"SELECT item_id, COUNT(*) AS n_documents FROM ({_LEAKS}) GROUP BY 1",
    "p9_familiar": f"""WITH t AS (SELECT regexp_extract_all({_FOLDED}, '\\p{{L}}+(?:[''’-]\\p{{L}}+)*') AS w FROM documents), l AS (SELECT w, {_COUNT['pt']} AS pt, {_COUNT['es']} AS es, {_COUNT['en']} AS en FROM t WHERE len(w) > 0),
      u AS (SELECT CASE WHEN pt >= es AND pt >= en THEN 'pt' WHEN es >= en THEN 'es' ELSE 'en' END AS language, unnest(list_distinct(w)) AS word FROM l), c AS (SELECT language, word, COUNT(*) AS df FROM u GROUP BY ALL)
      SELECT language, word, df, CAST(row_number() OVER (PARTITION BY language ORDER BY df DESC, word) AS INTEGER) AS r FROM c QUALIFY r <= {FAMILIAR}""",
}
_FAMILIAR = ORACLE["p9_familiar"].split("SELECT language, word, df, CAST")[0]
# white space ends a sentence's mark with it: a part without letters is no sentence either way
_MARK = r"[.!?…]+(?:[\s\p{Z}\x{1C}-\x{1F}\x{85}]|$)|\n+"
ORACLE["p9_grades"] = f"""{_FAMILIAR}, top AS (SELECT language, word FROM c QUALIFY row_number() OVER (PARTITION BY language ORDER BY df DESC, word) <= {MAIN}),
  d AS (SELECT doc_id, text, regexp_extract_all({_FOLDED}, '\\p{{L}}+(?:[''’-]\\p{{L}}+)*') AS w FROM documents), e AS (SELECT doc_id, text, w, len(w) AS n, {_COUNT['pt']} AS pt, {_COUNT['es']} AS es, {_COUNT['en']} AS en FROM d),
  f AS (SELECT doc_id, w, COALESCE(n, 0) AS n_words, CASE WHEN n > 0 THEN CASE WHEN pt >= es AND pt >= en THEN 'pt' WHEN es >= en THEN 'es' ELSE 'en' END END AS language, greatest(1, len(list_filter(regexp_split_to_array(text, '{_MARK}'), lambda x: regexp_matches(x, '\\p{{L}}')))) AS ns FROM e),
  tok AS (SELECT doc_id, language, unnest(w) AS word FROM f), k AS (SELECT doc_id, COUNT(top.word) AS hits FROM tok LEFT JOIN top USING (language, word) GROUP BY 1),
  g AS (SELECT doc_id, language, CAST(n_words AS INTEGER) AS n_words, CASE WHEN n_words > 0 THEN 1 - hits / n_words END AS u, CASE WHEN n_words > 0 THEN n_words / ns END AS asl FROM f LEFT JOIN k USING (doc_id))
  SELECT doc_id, language, n_words, round(u, 6) AS unfamiliar, round(asl, 4) AS asl, round({100 * BASE[0]} * u + {BASE[1]} * asl + CASE WHEN u > 0.05 THEN {BASE[2]} ELSE 0 END, 4) AS grade FROM g"""
