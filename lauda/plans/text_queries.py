"""Queries over text primitives, document profiles and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.functions import derived as V
from lauda.functions import detectors as D
from lauda.functions import text as X
from lauda.functions.rules import Cascade
from lauda.session import spread
from lauda.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


def _reports(spark, d):
    """Reports with their normalised text T."""
    return spread(table(spark, d, "run_pilot").select("pilot_id", "caso", "conjunto", "laudo")).select("pilot_id", "caso",
        "conjunto", "laudo", X.normalize(F.col("laudo")).alias("T"))


SQL_REPORTS = f"(SELECT pilot_id, caso, conjunto, laudo, {X.sql_normalize('laudo')} AS T FROM run_pilot)"
SQL_DOCS = f"(SELECT doc_id, text, source, {X.sql_normalize('text')} AS T FROM documents)"


def normalize_text(spark, d):
    t = X.normalize(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("sha"))


def fold_variants(spark, d):
    t = X.fold_lower(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("sha"))


def cut_commentary(spark, d):
    return _reports(spark, d).select("pilot_id", F.sha2(X.cut_commentary(F.col("T")), 256).alias("sha"))


def section_segments(spark, d):
    r = _reports(spark, d).select("pilot_id", F.explode(X.sections(F.col("T"))).alias("b"))
    return r.select("pilot_id", "b.section", F.col("b.start").alias("start_at"), F.col("b.end").alias("end_at"))


PRIORITY = ("conclusao", "descricao", "microscopia", "macroscopia", "corpo", "inicio")


def section_pick(spark, d):
    b = _reports(spark, d).select("pilot_id", X.in_priority(X.sections(F.col("T")), PRIORITY).alias("b"))
    return b.select("pilot_id", "b.section", F.col("b.start").alias("start_at"), F.col("b.end").alias("end_at"))


def evidence_window(spark, d):
    r = _reports(spark, d).withColumn("s", X.first_start(F.col("T"), r"medindo"))
    return r.where("s IS NOT NULL").select("pilot_id", F.col("s").alias("start_at"),
        X.window(F.col("T"), F.col("s"), F.lit(7), 30).alias("evidence"))


def sentence_negation(spark, d):
    r = _reports(spark, d).withColumn("s", X.first_start(F.col("T"), "comprometimento"))
    s = X.sentence(F.col("T"), F.col("s"), F.lit(len("comprometimento")))
    return r.where("s IS NOT NULL").select("pilot_id", s.alias("sentence"), s.rlike(r"\b(?:nao|sem|ausencia)\b").alias("negated"))


def evidence_occurrences(spark, d):
    n = F.size(X.all_starts(F.col("T"), F.lit("mm")))
    return _reports(spark, d).select("pilot_id", n.alias("n"), X.occurrences(F.col("T"), F.lit("mm")).alias("n_disjoint"))


ENTITY = r"\b(?:[Pp]e[cç]a|PE[CÇ]A|[Ff]ragmento|[Aa]mostra|[Ee]sp[eé]cime|[Ll][aâ]mina|[Rr]ecipiente)\s*\d+"
HEADER = r"(?:^|\n)\s*[A-ZÇÁÉÍÓÚÂÊÔÃÕÀ][A-ZÇÁÉÍÓÚÂÊÔÃÕÀ /]{3,40}\s*:"
BULLET = r"(?:^|\n)\s*[-–—*•]\s+\S"


def document_profile(spark, d):
    """Complexity and format of reports; a report without text has the profile of the empty text."""
    t = F.coalesce(F.col("laudo"), F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)))
    lines = F.size(F.split(t, "\n", -1))
    p = table(spark, d, "run_pilot").select(
        "pilot_id", F.length(t).alias("char_count"), (F.length(t) > 5000).alias("long_report"),
        count(ENTITY).alias("entity_count"), count(r"\b[Bb]locos?\s*\d+").alias("specimen_count"),
        (count(HEADER) >= 3).alias("cap_style"), (count(r"\|\|") >= 3).alias("table_like"), count(BULLET).alias("bullets"),
        lines.alias("lines"),
        t.rlike(r"[^\n]{150,}").alias("long_paragraph"),
        F.size(F.regexp_extract_all(t, F.lit(r"(\S+)"), F.lit(1))).alias("tokens"),
    )
    bullet = (F.col("bullets") >= 5) | (F.col("bullets") / F.greatest("lines", F.lit(1)) >= 0.05)
    narrative = ~(F.col("cap_style") | F.col("table_like") | bullet) & (F.col("long_paragraph") | ((F.col("char_count") >= 80) & (F.col("tokens") >= 15)))
    return p.select("pilot_id", "char_count", "long_report", "entity_count", "specimen_count",
        (F.col("entity_count") >= 10).alias("long_multi_entity"), "cap_style", "table_like", bullet.alias("bullet_list"),
        narrative.alias("narrative"))


def count_words(spark, d):
    """Scalar number primitives over the normalised reports."""
    t = F.col("T")
    m = F.regexp_extract(t, r"medindo ((?:\d+(?:[.,]\d+)?\s*x?\s*)+(?:mm|cm))", 1)
    return _reports(spark, d).select(
        "pilot_id", X.number_of(F.regexp_extract(t, r"(\w+) fragmentos", 1)).alias("n_fragments"),
        F.when(m != "", X.measure_mm(m)).alias("mm"),
        X.interval_label(F.regexp_extract(t, r"ha (\d+) (?:meses|semanas|anos|dias)", 1).try_cast("int"),
            F.regexp_extract(t, r"ha \d+ (meses|semanas|anos|dias)", 1)).alias("interval"),
    )


def _detect(name):
    def run(spark, d):
        """One row per report and variable of the set: value, and where the rule has one its start.

        The rules run inside one lambda over the normalised text, which is so computed once, and whose
        body doesn't count towards the size of the generated code.
        """

        def cell(x, t):
            v, s = (x.column(t)["value"], x.column(t)["span_start"]) if isinstance(x,
                Cascade) else (x.column(t).cast("string"), F.lit(None).cast("int"))
            return F.struct(F.lit(x.name).alias("variable"), v.alias("value"), s.alias("span_start"))

        cells = F.flatten(F.transform(F.array("T"), lambda t: F.array(*[cell(x, t) for x in D.SETS[name]])))
        return _reports(spark, d).select("pilot_id", F.explode(cells).alias("c")).select("pilot_id", "c.*")

    return run


def breast_derived(spark, d):
    """Behaviour of the histological type, features of a fibrocystic pattern and molecular subtype of breast reports."""
    t, num = F.col("T"), F.regexp_extract("l1_ki67", r"^(\d{1,3})$", 1).try_cast("int")
    r = spread(table(spark, d, "run_pilot").select("pilot_id", "laudo", "l1_re", "l1_rp", "l1_her2",
            "l1_ki67")).select("pilot_id",
        X.normalize(F.col("laudo")).alias("T"), "l1_re", "l1_rp", V.her2_of_score(F.col("l1_her2")).alias("h"), num.alias("k"))
    r = r.withColumn("tipo", X.let(t, lambda t: D.TIPO_HIST.column(t)["value"]))
    tipo = F.col("tipo")
    return r.select(
        "pilot_id", "tipo", V.behavior_class(tipo).alias("behavior"), V.invasive_malignancy(tipo).alias("invasive"),
        V.malignancy_any(tipo).alias("malignant"), V.cystic_features(t).alias("cystic"),
        V.molecular_subtype(F.col("l1_re"), F.col("l1_rp"), F.col("h"), F.col("k")).alias("subtype"),
    )


def polyp_sizes(spark, d):
    return _reports(spark, d).select("pilot_id", V.polyp_size(F.col("T")).alias("mm"))


def _detect_sql(name):
    parts = []
    for x in D.SETS[name]:
        v, s = x.sql("T") if isinstance(x, Cascade) else (f"CAST({x.sql('T')} AS VARCHAR)", "CAST(NULL AS INTEGER)")
        parts.append(f"SELECT pilot_id, '{x.name}' AS variable, {v} AS value, CAST({s} AS INTEGER) AS span_start FROM r")
    return f"WITH r AS MATERIALIZED {SQL_REPORTS} " + " UNION ALL ".join(parts)


_SECTION_CASE = "CASE " + " ".join(f"WHEN regexp_full_match(h, '{p}') THEN '{k}'" for k, p in X.SECTIONS) + " END"
_HEAD = "|".join(p for _, p in X.SECTIONS)
_BLOCKS = f"""
WITH r AS MATERIALIZED {SQL_REPORTS},
p AS (SELECT pilot_id, T, regexp_extract_all(T, '({_HEAD})') AS hs, regexp_split_to_array(T, '{_HEAD}') AS ps FROM r),
u AS (SELECT pilot_id, generate_subscripts(ps, 1) AS i, hs, ps FROM p WHERE len(hs) > 0),
l AS (SELECT pilot_id, i, CASE WHEN i > 1 THEN hs[i - 1] END AS h, length(ps[i]) AS n FROM u),
o AS (SELECT *, SUM(n + COALESCE(length(h), 0)) OVER (PARTITION BY pilot_id ORDER BY i) AS e FROM l),
b AS (SELECT pilot_id, CASE WHEN i = 1 THEN 'inicio' ELSE {_SECTION_CASE} END AS section, CAST(e - n AS INTEGER) AS start_at, CAST(e AS INTEGER) AS end_at FROM o WHERE i > 1 OR n > 0
  UNION ALL SELECT pilot_id, 'corpo', 0, CAST(length(T) AS INTEGER) FROM p WHERE len(hs) = 0)
"""
_RANK = "CASE section " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY)} END"
_CUT = "T"
for _m in reversed(X.MARKERS):
    _CUT = f"CASE WHEN strpos(T, '{_m}') > 0 THEN split_part(T, '{_m}', 1) ELSE {_CUT} END"
_T = "COALESCE(laudo, '')"
_WORDS_CASE = "CASE " + " ".join(f"WHEN regexp_matches(w, '\\b{w}\\b') THEN {n}" for w, n in X.NUMBER_WORDS) + " END"

_SPANS = lambda p: f"SELECT pilot_id, CAST(e - length(h) AS INTEGER) AS s, CAST(e AS INTEGER) AS e, h FROM (SELECT pilot_id, i, h, SUM(length(p) + length(h)) OVER (PARTITION BY pilot_id ORDER BY i) AS e FROM (SELECT pilot_id, unnest(hs) AS h, unnest(ps[1:len(hs)]) AS p, generate_subscripts(hs, 1) AS i FROM (SELECT pilot_id, regexp_extract_all(T, '{p}') AS hs, regexp_split_to_array(T, '{p}') AS ps FROM r)))"
_MM = "list_max(list_transform(regexp_extract_all(h, '\\d+(?:[.,]\\d+)?'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE))) * CASE WHEN contains(h, 'mm') THEN 1.0 ELSE 10.0 END"
_NEAR = lambda k: f"(SELECT max({k}.s) FROM {k} WHERE {k}.pilot_id = m.pilot_id AND {k}.s < m.s AND {k}.s >= m.s - 200)"
_IN = lambda xs: "(" + ", ".join(map(repr, xs)) + ")"

QUERIES = {
    "normalize_text": normalize_text, "fold_variants": fold_variants, "cut_commentary": cut_commentary,
    "section_segments": section_segments, "section_pick": section_pick,
    "evidence_window": evidence_window, "sentence_negation": sentence_negation, "evidence_occurrences": evidence_occurrences,
    "document_profile": document_profile, "count_words": count_words,
    **{f"detect_{k}": _detect(k) for k in D.SETS}, "breast_derived": breast_derived, "polyp_sizes": polyp_sizes,
}

ORACLE = {
    "normalize_text": f"SELECT doc_id, CAST(length(T) AS INTEGER) AS n, sha256(T) AS sha FROM {SQL_DOCS}",
    "fold_variants": f"""SELECT doc_id, CAST(length(t) AS INTEGER) AS n, sha256(t) AS sha FROM (SELECT doc_id,
      regexp_replace(lower(regexp_replace(translate(COALESCE(text, ''), '{X.FOLD_FROM}', '{X.FOLD_TO}'), '\\p{{M}}+', '', 'g')), '[�´¸ˆ]', '', 'g') AS t FROM documents)""",
    "cut_commentary": f"SELECT pilot_id, sha256({_CUT}) AS sha FROM {SQL_REPORTS}",
    "section_segments": _BLOCKS + "SELECT * FROM b",
    "section_pick": _BLOCKS + f"SELECT pilot_id, section, start_at, end_at FROM b QUALIFY row_number() OVER (PARTITION BY pilot_id ORDER BY {_RANK}, start_at) = 1",
    "evidence_window": f"SELECT pilot_id, CAST(strpos(T, 'medindo') - 1 AS INTEGER) AS start_at, trim(substring(T, greatest(strpos(T, 'medindo') - 31, 0) + 1, strpos(T, 'medindo') + 36 - greatest(strpos(T, 'medindo') - 31, 0))) AS evidence FROM {SQL_REPORTS} WHERE strpos(T, 'medindo') > 0",
    "sentence_negation": f"""SELECT pilot_id, s AS sentence, regexp_matches(s, '\\b(?:nao|sem|ausencia)\\b') AS negated FROM (SELECT pilot_id,
      trim(concat(split_part(left(T, strpos(T, 'comprometimento') - 1), '.', -1), 'comprometimento', split_part(substring(T, strpos(T, 'comprometimento') + 15), '.', 1))) AS s FROM {SQL_REPORTS} WHERE strpos(T, 'comprometimento') > 0)""",
    "evidence_occurrences": f"SELECT pilot_id, CAST(len(list_filter(range(1, length(T) + 1), lambda i: substring(T, i, 2) = 'mm')) AS INTEGER) AS n, CAST((length(T) - length(replace(T, 'mm', ''))) / 2 AS INTEGER) AS n_disjoint FROM {SQL_REPORTS}",
    "document_profile": f"""WITH p AS (SELECT pilot_id, length({_T}) AS char_count, length({_T}) > 5000 AS long_report, len(regexp_extract_all({_T}, '{ENTITY}')) AS entity_count,
      len(regexp_extract_all({_T}, '\\b[Bb]locos?\\s*\\d+')) AS specimen_count, len(regexp_extract_all({_T}, '{HEADER}')) >= 3 AS cap_style, len(regexp_extract_all({_T}, '\\|\\|')) >= 3 AS table_like,
      len(regexp_extract_all({_T}, '{BULLET}')) AS bullets, len(string_split({_T}, chr(10))) AS lines, regexp_matches({_T}, '[^\\n]{{150,}}') AS lp, len(regexp_extract_all({_T}, '\\S+')) AS tokens FROM run_pilot),
      q AS (SELECT *, bullets >= 5 OR bullets / greatest(lines, 1) >= 0.05 AS bullet_list FROM p)
      SELECT pilot_id, char_count, long_report, entity_count, specimen_count, entity_count >= 10 AS long_multi_entity, cap_style, table_like, bullet_list,
      NOT (cap_style OR table_like OR bullet_list) AND (lp OR (char_count >= 80 AND tokens >= 15)) AS narrative FROM q""",
    "count_words": f"""WITH r AS (SELECT pilot_id, T, regexp_extract(T, '(\\w+) fragmentos', 1) AS w, regexp_extract(T, 'medindo ((?:\\d+(?:[.,]\\d+)?\\s*x?\\s*)+(?:mm|cm))', 1) AS m,
      TRY_CAST(regexp_extract(T, 'ha (\\d+) (?:meses|semanas|anos|dias)', 1) AS INTEGER) AS i, regexp_extract(T, 'ha \\d+ (meses|semanas|anos|dias)', 1) AS u FROM {SQL_REPORTS})
      SELECT pilot_id, COALESCE(TRY_CAST(NULLIF(regexp_extract(w, '(\\d{{1,9}})', 1), '') AS INTEGER), {_WORDS_CASE}) AS n_fragments,
      CASE WHEN m <> '' THEN list_max(list_transform(regexp_extract_all(m, '\\d+(?:[.,]\\d+)?'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE))) * CASE WHEN contains(m, 'mm') THEN 1.0 ELSE 10.0 END END AS mm,
      CASE WHEN u = 'semanas' THEN concat(i * 7, '_dias') WHEN u = 'dias' THEN concat(i, '_dias') WHEN u = 'meses' THEN concat(i, CASE WHEN i = 1 THEN '_mes' ELSE '_meses' END) WHEN u = 'anos' THEN concat(i, CASE WHEN i = 1 THEN '_ano' ELSE '_anos' END) END AS "interval" FROM r""",
    **{f"detect_{k}": _detect_sql(k) for k in D.SETS},
    "breast_derived": f"""WITH r AS MATERIALIZED (SELECT pilot_id, {X.sql_normalize('laudo')} AS T, l1_re, l1_rp, CASE WHEN l1_her2 IN ('3', '3+') THEN 'positivo' WHEN l1_her2 IN ('2', '2+') THEN 'equivoco' WHEN l1_her2 IN ('0', '0+', '1', '1+') THEN 'negativo' END AS h,
      TRY_CAST(NULLIF(regexp_extract(l1_ki67, '^(\\d{{1,3}})$', 1), '') AS INTEGER) AS k FROM run_pilot), x AS (SELECT *, {D.TIPO_HIST.sql('T')[0]} AS tipo, COALESCE(l1_re = 'positivo' OR l1_rp = 'positivo', FALSE) AS pos, COALESCE(l1_re = 'negativo' AND l1_rp = 'negativo', FALSE) AS neg FROM r)
      SELECT pilot_id, tipo, CASE WHEN tipo IN {_IN(D.INVASIVE)} THEN 'invasivo' WHEN tipo IN {_IN(D.IN_SITU)} THEN 'in_situ' WHEN tipo IN {_IN(D.BENIGN)} THEN 'benigno' END AS behavior,
      CASE WHEN tipo IS NOT NULL THEN CASE WHEN tipo IN {_IN(D.INVASIVE)} THEN 'sim' ELSE 'nao' END END AS invasive, CASE WHEN tipo IS NOT NULL THEN CASE WHEN tipo IN {_IN(D.INVASIVE + D.IN_SITU)} THEN 'sim' ELSE 'nao' END END AS malignant,
      {' + '.join(f"CAST(regexp_matches(T, '{p}') AS INTEGER)" for p in D.CYSTIC)} AS cystic, CASE WHEN pos AND h = 'positivo' THEN 'luminal_b_her2pos' WHEN pos AND h = 'negativo' THEN CASE WHEN k < 20 THEN 'luminal_a' WHEN k >= 20 THEN 'luminal_b_her2neg' ELSE 'luminal' END
      WHEN neg AND h = 'positivo' THEN 'her2_enriched' WHEN neg AND h = 'negativo' THEN 'triplo_negativo' END AS subtype FROM x""",
    "polyp_sizes": f"""WITH r AS MATERIALIZED {SQL_REPORTS}, m AS MATERIALIZED ({_SPANS(D.SIZE)}), own AS MATERIALIZED ({_SPANS(D.POLYP)}), oth AS MATERIALIZED ({_SPANS(D.OTHER)}),
      k AS (SELECT m.pilot_id, {_MM} AS mm, COALESCE({_NEAR('own')}, -1) AS a, COALESCE({_NEAR('oth')}, -1) AS b, EXISTS (SELECT 1 FROM own WHERE own.pilot_id = m.pilot_id AND own.s >= m.e AND own.e <= m.e + 100) AS f,
        substring(T, greatest(m.s - 30, 0) + 1, least(m.s, 30)) AS l30, substring(T, greatest(m.s - 15, 0) + 1, least(m.s, 15)) AS l15, substring(T, m.e + 1, 30) AS r30 FROM m JOIN r USING (pilot_id)),
      g AS (SELECT pilot_id, max(mm) AS mm FROM k WHERE CASE WHEN a >= 0 OR b >= 0 THEN a > b ELSE f END AND NOT regexp_matches(l30, '{D.BOUND}') AND NOT regexp_matches(l15, '{D.NOISE}') AND NOT regexp_matches(r30, '{D.DISTANCE}') AND mm BETWEEN 0.5 AND 200 GROUP BY 1)
      SELECT pilot_id, mm FROM r LEFT JOIN g USING (pilot_id)""",
}
