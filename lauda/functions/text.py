"""Text primitives as Column builders: normalisation, sections, windows, sentences, numbers.

Every builder is a composition of built-in functions, so whole projections stay in generated code.
Offsets are 0-based code points. NULL texts normalise to the empty string, as silence.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered replacements of markup before normalisation (an earlier one wins).
ENTITIES = (
    ("&#13;", " "), ("&#10;", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
    ("<br>", " "), ("<br/>", " "), ("<br />", " "), ("&ccedil;", "c"), ("&atilde;", "a"), ("&aacute;", "a"), ("&eacute;", "e"),
    ("&iacute;", "i"), ("&oacute;", "o"), ("&uacute;", "u"),
)
# Section headers of normalised endoscopy and pathology reports.
SECTIONS = (
    ("indicacao", r"\[indicac(?:ao|oes)\]|\bindicac(?:ao|oes)\s*:|\[informacao clinica\]|\bdados clinicos\s*:"),
    ("macroscopia", r"\[material\]|\[macroscopia\]|\bmacroscopia\s*:|\bdescricao macroscopica\s*:"),
    ("microscopia", r"\[microscopia\]|\bmicroscopia\s*:|\bdescricao microscopica\s*:"),
    ("descricao", r"\[achados\]|\bachados\s*:|\[descricao\]|\bdescricao\s*:"),
    ("conclusao", r"\[conclus(?:ao|oes)\]|\bconclus(?:ao|oes)\s*:|\[diagnostico\]|\bdiagnosticos?\s*:|\bimpressao\s*:"),
    ("comentarios", r"\[comentarios\]|\bcomentarios\s*:|\[observacoes\]|\bobservacoes\s*:|\bnota\s*:"),
)
# Markers that cut commentary; the first listed one that stands in a text counts.
MARKERS = ("comentarios", "referencias", "nota:", "observacao:", "observacoes:")
START, FALLBACK = "inicio", "corpo"


def _fold_table() -> tuple[str, str]:
    src, dst = [], []
    for i in range(0xA0, 0x250):
        d = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(d) == 1 and d != chr(i):
            src.append(chr(i))
            dst.append(d)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition of the Latin blocks without combining marks."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{M}+", "")


def normalize(c: Column) -> Column:
    """Lower-case ASCII-like text: entities replaced, accents stripped, '||' a full stop, one space."""
    t = F.coalesce(c, F.lit(""))
    for k, v in ENTITIES:
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.replace(F.lower(strip_accents(t)), F.lit("||"), F.lit(" . "))
    return F.trim(F.regexp_replace(t, r"[\s]+", " "))


def sql_normalize(col: str) -> str:
    """The same in DuckDB SQL."""
    t = f"COALESCE({col}, '')"
    for k, v in ENTITIES:
        t = f"replace({t}, '{k}', '{v}')"
    t = f"regexp_replace(translate({t}, '{FOLD_FROM}', '{FOLD_TO}'), '\\p{{M}}+', '', 'g')"
    return f"trim(regexp_replace(replace(lower({t}), '||', ' . '), '\\s+', ' ', 'g'))"


def fold_lower(c: Column) -> Column:
    """The short variant: lower case and stripped accents only, marks of encoding loss dropped."""
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "[�´¸ˆ]", "")


def is_missing(c: Column) -> Column:
    """NULL, blank, or one of the spellings of not available."""
    return c.isNull() | F.trim(c.cast("string")).isin("", "NA", "nan", "NaN", "None")


def nullify(c: Column) -> Column:
    return F.when(~is_missing(c), F.trim(c))


def cut_commentary(t: Column) -> Column:
    """Text before the first listed marker that it holds (in the order of the list, not of the text)."""
    out = t
    for m in reversed(MARKERS):
        out = F.when(F.instr(t, m) > 0, F.substring_index(t, m, 1)).otherwise(out)
    return out


def first_start(t: Column, pattern: str) -> Column:
    """0-based start of the first match, NULL without one."""
    i = F.regexp_instr(t, F.lit(pattern))
    return F.when(i > 0, i - 1)


def first_match(t: Column, pattern: str, group: int = 0) -> Column:
    """Text of the first match (or of a group of it), NULL without one."""
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def window(t: Column, start: Column, length: Column, n: int = 50) -> Column:
    """Evidence window of n characters on both sides, clipped and trimmed."""
    lo = F.greatest(start - n, F.lit(0))
    return F.trim(F.substring(t, lo + 1, start + length + n - lo))


def sentence(t: Column, start: Column, length: Column) -> Column:
    """The sentence around a span: from the full stop before it to the one after it."""
    left = F.substring_index(F.substring(t, F.lit(1), start), ".", -1)
    right = F.substring_index(F.substring(t, start + length + 1, F.length(t)), ".", 1)
    return F.trim(F.concat(left, F.substring(t, start + 1, length), right))


def all_starts(t: Column, needle: Column) -> Column:
    """Starts of every (also overlapping) occurrence of a literal."""
    n = F.length(needle)
    return let(t,
        lambda t: F.when(n > 0,
            F.filter(F.sequence(F.lit(0), F.greatest(F.length(t) - n, F.lit(0))), lambda i: F.substring(t, i + 1, n) == needle)))


def collapse(c: Column) -> Column:
    """Form for offset comparison: trimmed, one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def occurrences(t: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return F.when(F.length(needle) > 0,
        ((F.length(t) - F.length(F.replace(t, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def sections(t: Column, config: tuple = SECTIONS) -> Column:
    """Blocks of a normalised text: array of (section, start, end), in text order; config: (section, header pattern).

    Text before the first header is `inicio`; a text without headers is one block `corpo`.
    """
    header = "|".join(p for _, p in config)
    name = lambda h: F.coalesce(*[F.when(h.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in config])
    empty = F.array().cast("array<struct<section:string,start:int,end:int>>")

    def walk(x):
        heads, parts, n = x["heads"], x["parts"], F.size(x["heads"])

        def step(acc, i):
            # acc.at: end of the block before; the header i stands there, its block follows
            start = acc["at"] + F.length(F.element_at(heads, i))
            end = start + F.length(F.element_at(parts, i + 1))
            block = F.struct(name(F.element_at(heads, i)).alias("section"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(acc["blocks"], F.array(block)).alias("blocks"))

        first = F.length(F.element_at(parts, 1))
        opening = F.when(first > 0,
            F.array(F.struct(F.lit(START).alias("section"), F.lit(0).alias("start"), first.alias("end")))).otherwise(empty)
        walked = F.aggregate(F.sequence(F.lit(1), n), F.struct(first.alias("at"), opening.alias("blocks")), step)["blocks"]
        whole = F.array(F.struct(F.lit(FALLBACK).alias("section"), F.lit(0).alias("start"), x["n"].alias("end")))
        return F.when(n > 0, walked).otherwise(whole)

    cut = F.struct(F.regexp_extract_all(t, F.lit(f"({header})"), F.lit(1)).alias("heads"),
        F.split(t, header, -1).alias("parts"), F.length(t).alias("n"))
    return let(cut, walk)


def in_priority(blocks: Column, order: tuple[str, ...]) -> Column:
    """The first block by a priority of sections, then by position."""
    rank = lambda s: F.coalesce(*[F.when(s == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))
    keyed = F.transform(blocks,
        lambda b: F.struct(rank(b["section"]).alias("r"), b["start"].alias("start"), b["end"].alias("end"),
            b["section"].alias("section")))
    return F.array_min(keyed)


def shingles(t: Column, k: int) -> Column:
    """Distinct runs of k words of a folded text; texts of fewer words have none."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)),
        lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    cut = lambda w: F.when(F.size(w) >= k, F.array_distinct(runs(w))).otherwise(F.array().cast("array<string>"))
    return let(F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), F.lit(1)), cut)


# Numbers in words, longest phrase first.
NUMBER_WORDS = (
    ("nenhum", 0), ("zero", 0), ("quatorze", 14), ("catorze", 14), ("quinze", 15), ("quatro", 4), ("cinco", 5), ("treze", 13),
    ("doze", 12), ("onze", 11),
    ("vinte", 20), ("trinta", 30), ("dois", 2), ("duas", 2), ("tres", 3), ("seis", 6), ("sete", 7), ("oito", 8), ("nove", 9),
    ("dez", 10), ("uma", 1), ("um", 1),
)


def number_of(t: Column) -> Column:
    """A count in digits or words."""
    out = F.lit(None).cast("int")
    for w, n in reversed(NUMBER_WORDS):
        out = F.when(t.rlike(rf"\b{w}\b"), n).otherwise(out)
    return F.coalesce(F.regexp_extract(t, r"(\d{1,9})", 1).try_cast("int"), out)


def to_double(s: Column) -> Column:
    """Decimal with either mark, NULL if it isn't one."""
    return F.replace(s, F.lit(","), F.lit(".")).try_cast("double")


def measure_mm(s: Column) -> Column:
    """Largest number of a measure in mm: in cm unless mm is written."""
    nums = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), to_double)
    return F.array_max(nums) * F.when(F.lower(s).rlike("mm|milimetro"), 1.0).otherwise(10.0)


def interval_label(n: Column, unit: Column) -> Column:
    """Canonical interval: weeks in days, hours in days (rounded up), months and years as they are, in the singular for 1."""
    i = n.cast("int")
    u = F.lower(unit)
    days = F.when(u.startswith("semana"), i * 7).when(u.startswith("hora"), F.ceil(i / 24)).when(u.startswith("dia"), i)
    name = F.when(days.isNotNull(), F.when(days == 1, "dia").otherwise("dias")).when(u.startswith("mes"),
        F.when(i == 1, "mes").otherwise("meses")).when(u.startswith("ano"), F.when(i == 1, "ano").otherwise("anos"))
    return F.when(name.isNotNull(), F.concat_ws("_", F.coalesce(days, i).cast("string"), name))


# Markers of history, of other scales, and of a place that denies a finding; order of evidence where words and measures disagree.
HISTORY = r"\bprevi[oa]\b|\bprevias?\b|\bpos[-\s]?tratamento\b|\bpos[-\s]?cirurgia\b|\bcontrole\s+(?:de|tardio|pos)\b|\bem\s+controle\s+de\b|\brelato\s+de\b|\bhistoria\s+de\b|\bantecedente\s+de\b|\banteriormente\b|\bha\s+\d+\s+(?:anos?|meses?)\b|\bja\s+(?:tratada?|tratado)\b|\bvigilancia\s+pos\b|\bcontrole\s+de\s+(?:polipectomia|mucosectomia)\b"
OTHER_SCALE = r"\bforrest\b|\bsakita\b|\bsavary\b|\bmiller\b|\bpraga\b|\bbarrett\s*c\d|\bparis\b|\bbormann\b|\bbethesda\b|\bbi[-\s]?rads\b|\bvienna\b|\bnice\b|\blsts?[-\s]?(?:g|ng)\b|\bdica\s*\d\b"
DENYING_PLACE = r"\bao\s+nivel\s+do\b|\bcoincidente\s+(?:com|ao|a)\b|\bjunto\s+(?:ao|do|a)\b|\bvist[ao]s?\s+no\b|\blocalizad[ao]s?\s+no\s+nivel\b|\btopic[ao]\b|\bajustado\s+ao\b|\bjusto\s+ao\b"
TIERS = ("lemma_negative", "lemma_positive", "measurement_positive", "measurement_negative", "borderline_meta")


def plus_minus(t: Column) -> Column:
    """'+/-' and '+-' of a normalised text as a token of its own, in capitals as nothing else is."""
    return F.regexp_replace(t, r"\+\s*/?\s*-", " PLUSMINUS ")


def digit_of(g: Column) -> Column:
    """A digit that may be typed as the letter o."""
    return F.when(F.lower(g) == "o", 0).otherwise(g.try_cast("int"))


def strongest(hits: Column) -> Column:
    """The record of the strongest tier of an array of (tier, record): words beat measures, of one tier the first counts."""
    rank = F.create_map(*[x for i, k in enumerate(TIERS) for x in (F.lit(k), F.lit(i))])
    ranked = F.transform(hits, lambda h,
        i: F.struct(F.coalesce(rank[h["tier"]], F.lit(len(TIERS))).alias("r"), i.alias("i"), h["record"].alias("record")))
    return F.array_min(F.transform(ranked, lambda x: F.struct(x["r"], x["i"], x["record"])))["record"]


def evidence_fields(value: Column, evidence: Column, meta: dict[str, Column]) -> list[Column]:
    """Columns of an evidence record: value, evidence cut to 200 characters, other fields under meta_."""
    return [value.alias("value"), F.substring(evidence, 1, 200).alias("evidence"),
        *[c.alias(f"meta_{k}") for k, c in meta.items()]]


def grounding_pattern(value: Column, unit: Column) -> Column:
    """Pattern of a value beside its unit, NULL without a number or a unit: 5 is grounded by '5 mm' as by '5,0mm'."""
    num = F.when(value.rlike(r"^\s*[+-]?\d+(\.\d*)?\s*$"), value.try_cast("double"))
    quoted = lambda c: F.regexp_replace(c, r"([.+*?^$()\[\]{}|\\%-])", r"\\$1")
    whole = num.cast("bigint").cast("string")
    digits = F.when(num == F.floor(num), whole).when(num.isNotNull(),
        quoted(F.regexp_replace(F.regexp_replace(F.trim(value), "0+$", ""), r"\.$", "")))
    return F.concat(F.lit(r"(?i)\b"), digits, F.lit(r"\s*(?:[.,]\s*\d+)?\s*"), quoted(unit), F.lit(r"\b"))


def anchored_percent(text: Column, value: Column) -> Column:
    """Does a text give this whole percentage for the proliferation marker? Shares are rounded half to even."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
        F.lit(r"ki\s*-?\s*67[^%]{0,80}?(\d{1,3}(?:[.,]\d+)?)\s*%"), F.lit(1))
    return F.exists(found, lambda x: F.bround(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"), 0) == value)


def supported(evidence: Column, source: Column) -> Column:
    """Does evidence, or its first 40 characters, stand in the source? No source is no objection, no evidence is none."""
    e, s = F.lower(F.trim(F.coalesce(evidence, F.lit("")))), F.lower(F.coalesce(source, F.lit("")))
    return (F.trim(s) == "") | ((e != "") & (s.contains(e) | s.contains(F.substring(e, 1, 40))))


def upper_value(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))
