"""Endoscopy detectors that look through a report section by section.

Each gives one struct (value, status, section, span_start, span_end, evidence): the first section, in the
detector's own order of sections, with a definite finding decides. All is done inside lambdas over the
blocks of a text, without a row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lauda.functions.text import HISTORY, OTHER_SCALE, let, sections, to_double
from lauda.functions.text import window as evidence_window
from lauda.operators.joins import spans_of

# Section headers of normalised endoscopy reports.
ENDOSCOPY = (
    ("indicacao",
        r"\[indicacao\]|\[indicacoes\]|\bindicacao\s*:|\bindicacoes\s*:|\bhipotese\s+diagnostica\b|\bmotivo\s+do\s+exame\b|\bhistoria\s+clinica\b"),
    ("sedacao", r"\[sedacao\]|\bsedacao\s*:|\banestesia\s*:"),
    ("preparo", r"\[preparo\]|\bpreparo\s*(?:do\s+colon|intestinal)?\s*:"),
    ("esofago", r"\[esofago\]|\besofago\s*:"),
    ("estomago", r"\[estomago\]|\bestomago\s*:"),
    ("duodeno", r"\[duodeno\]|\bduodeno\s*:"),
    ("descricao", r"\[descricao\]|\bdescricao\s*:|\[exame\s+endoscopico\]|\[achados\]|\bachados\s*:"),
    ("biopsia", r"\[biopsia\]|\bbiopsia\s*:|\bbiopsias\s*:"),
    ("conclusao",
        r"\[conclusao\]|\[conclusoes\]|\bconclusao\s*:|\bimpressao\s*:|\bimpressao\s+endoscopica\s*:|\bdiagnostico\s*:|\bdiagnosticos\s*:|\bdiagnostico\s+endoscopico\s*:"),
)
# Bowel preparation score.
BBPS_ORDER = ("preparo", "sedacao", "inicio", "descricao", "corpo")
BOSTON = r"\b(?:bbps|boston)\b"
THREE = r"\b([0-3])\s*\+\s*([0-3])\s*\+\s*([0-3])\b"
LABELLED = (r"\bcd\s*:?\s*([0-3o])\b[^.]{0,30}?\bct\s*:?\s*([0-3o])\b[^.]{0,30}?\bce\s*:?\s*([0-3o])\b",
    r"colon\s+direito\s*:?\s*([0-3o])\b[^.]{0,40}?colon\s+transverso\s*:?\s*([0-3o])\b[^.]{0,40}?colon\s+esquerdo\s*:?\s*([0-3o])\b")
OF_NINE, NEAR_BOSTON, TOTAL = r"\b(\d)\s*/\s*9\b", r"\bboston\b[^.]{0,30}?[\s:=\(\-]\s*0?(\d|10|o)\b", r"\bbbps\b[\s:=\-]*\s*0?(\d|10|o)\b"
# Grade of esophagitis.
LA_ORDER = ("conclusao", "esofago", "descricao", "corpo")
LA_TERM, GRADE = r"l[o]s?\s*[a]n+g[el]{1,4}s?", r"\bgrau\s*([abcd])\b"
LA_EXPLICIT = rf"(?:{GRADE}\s*(?:de|do|da|na|-|,|:|\(|\)|\s)*\s*{LA_TERM}|{LA_TERM}\s*[-,:]?\s*(?:grau\s*)?([abcd])\b)"
LA_SEVERAL = r"\bgrau\s*([abcd])\s*[/-]\s*([abcd])\b"
EROSIVE = r"esofagite erosiva|esofagite de refluxo|esofagite por refluxo|esofagite-de refluxo|esofagite refluxo|doenca do refluxo|esofagite de refluxo erosiva|esofagite erosiva-grau"
NO_ESOPHAGITIS = (
    r"esofagite\s+nao[-\s]?erosiva|sem\s+esofagite\s+erosiva|sem\s+sinais\s+de\s+esofagite|ausencia\s+de\s+esofagite|ausencia\s+de\s+sinais\s+de\s+esofagite|nao\s+ha\s+sinais\s+de\s+esofagite|nao\s+evidenciado\s+esofagite|nao\s+evidencia\s+esofagite"
    r"|esofagite\s+leve\s+nao\s+erosiva|sinais\s+(?:leves|discretos)\s+de\s+esofagite\s+nao\s+erosiva|esofago\s+(?:de\s+)?aspecto\s+normal|mucosa\s+esofagica\s+(?:de\s+aspecto\s+)?(?:normal|preservada|habitual)|esofago\s+sem\s+alteracoes|esofago\s+normal"
)
# Hiatal hernia in the strict sense.
HERNIA_ORDER = ("conclusao", "estomago", "esofago", "descricao", "corpo", "sedacao", "preparo", "inicio")
HERNIA = r"\bh[ée]?rnia(?:l)?\s+(?:hiatal|de\s+hiato)\b|\bh[ée]?rnia\s+para(?:esofagic[ao]|diafragmatic[ao])\b|\bhh\b"
NO_HERNIA = (
    r"\bausencia\s+de\s+h[ée]?rnia(?:l)?\s+(?:hiatal|de\s+hiato)\b|\bsem\s+h[ée]?rnia(?:l)?\s+(?:hiatal|de\s+hiato)\b|\bsem\s+(?:evidencias?|sinais|sinal|indicios?)\s+(?:de\s+)?h[ée]?rnia(?:l)?\s+(?:hiatal|de\s+hiato)\b"
    r"|\bnao\s+(?:caracterizando|caracteriza|ha|configurando)\s+h[ée]?rnia(?:l)?\s+(?:hiatal|de\s+hiato)\b|\bnao\s+(?:foram|forma)\s+(?:identificad|caracterizad|observad)\w*\s+(?:sinais\s+de\s+)?h[ée]?rnia\b"
)
OLD_HERNIA = r"\bantecedente\s+de\s+h[ée]?rnia\b|\bhistoria\s+de\s+h[ée]?rnia\b|\bcontrole\s+de\s+h[ée]?rnia\b|\bpos[-\s]?(?:operatorio|cirurgia|nissen|fundoplicat)\b"
_JUNCTION = r"(?:juncao|jec|jeg|transicao|linha\s+z)[^.]{0,80}?"
ABOVE = (
    rf"(?:{_JUNCTION}(?:acima|cerca\s+de|aproximadamente|aproxim[ai]\w*)\s+(?:do\s+)?(?:pincamento|hiato)?[^.]{{0,40}}?(\d+[,.]?\d*)\s*cm)"
    rf"|(?:{_JUNCTION}(\d+[,.]?\d*)\s*cm[^.]{{0,40}}?acima\s+(?:do\s+)?pincamento)|(?:{_JUNCTION}acima\s+do\s+pincamento[^.]{{0,40}}?cerca\s+de\s+(\d+[,.]?\d*)\s*cm)"
)
IN_PLACE = (
    rf"{_JUNCTION}(?:ao\s+nivel\s+do\s+pincamento|coincidente\s+com\s+(?:o\s+)?pincamento|junto\s+(?:ao|do)\s+pincamento|vista\s+(?:no|junto\s+ao)\s+pincamento|no\s+pincamento\s+diafragmatico|coincide\s+com\s+(?:o\s+)?pincamento|localizada\s+(?:junto|ao\s+nivel|no\s+nivel|coincidente))"
    r"|pouco\s+acima\s+do\s+pincamento"
    r"|\bhiato\s+(?:diafragmatico\s+)?(?:ajustado|justo)\s+(?:ao\s+)?(?:aparelho|endoscopio)\b|\baparelho\s+ajustado\s+ao\s+hiato\b|\bhiato\s+(?:diafragmatico\s+)?normal\b|\bhiato\s+(?:diafragmatico\s+)?de\s+aspecto\s+normal\b"
)
WIDENED = r"\b(?:hiato\s+(?:diafragmatico\s+)?|orificio\s+hiatal\s*|anel\s+hiat(?:al|ico)\s*)(?:levemente\s+|discretamente\s+|levem[\s.]+)?(?:alargado|dilatado|aumentado|ampliado)|\borificio\s+hiatal\s+com\s+diametro\s+aumentado\b"
#: Least height of the junction above the pinch, in cm, that makes a hernia.
LEAST_CM = 2.0


def _around(c: Column, s: Column, n: int) -> Column:
    """The text within n characters of a span."""
    lo = F.greatest(s["start"] - n, F.lit(0))
    return F.substring(c, lo + 1, s["end"] + n - lo)


def _cut(c: Column, s: Column) -> Column:
    return F.substring(c, s["start"] + 1, s["end"] - s["start"])


def _hit(value, status, s: Column, tier: int = 0) -> Column:
    as_text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(F.lit(tier).alias("tier"), s["start"].alias("at"), s["end"].alias("to"), as_text(value).alias("value"),
        as_text(status).alias("status"))


def _first(spans: Column) -> Column:
    return F.get(spans, F.lit(0))


def by_section(t: Column, order: tuple[str, ...], scan: Callable[[Column, Column], Column], needs: str,
    default: str | None = None) -> Column:
    """The finding of the first section that has one: within a section the lowest tier, then the first place.

    scan: (content, section) -> array of hits. A text without any has status no_match (empty for an empty
    text) and the default value. needs: a pattern of which every hit holds a match; texts and sections
    without one are passed by.
    """
    rank = lambda s: F.coalesce(*[F.when(s == k, F.lit(i)) for i, k in enumerate(order)])

    def look(x):
        def block(b):
            c = F.substring(x["t"], b["start"] + 1, b["end"] - b["start"])
            hits = let(c,
                lambda c: F.transform(F.when(c.rlike(needs), scan(c, b["section"])),
                    lambda h: h.withField("evidence", evidence_window(c, h["at"], h["to"] - h["at"]))))
            return F.transform(hits,
                lambda h: F.struct(rank(b["section"]).alias("rank"), h["tier"].alias("tier"),
                    (b["start"] + h["at"]).alias("start"), (b["start"] + h["to"]).alias("end"), h["value"].alias("value"),
                    h["status"].alias("status"), b["section"].alias("section"), h["evidence"].alias("evidence")))

        wanted = F.filter(x["blocks"], lambda b: rank(b["section"]).isNotNull())
        return let(F.array_min(F.flatten(F.array_compact(F.transform(wanted, block)))), lambda h: F.struct(
            F.coalesce(h["value"], F.when(h.isNull(), F.lit(default))).alias("value"),
            F.coalesce(h["status"], F.when(x["t"] == "", "empty").otherwise("no_match")).alias("status"),
            h["section"].alias("section"),
            h["start"].alias("span_start"), h["end"].alias("span_end"), h["evidence"].alias("evidence"),
        ))

    blocks = lambda t: F.when(t.rlike(needs),
        sections(t, ENDOSCOPY)).otherwise(F.array().cast("array<struct<section:string,start:int,end:int>>"))
    return let(t, lambda t: let(F.struct(t.alias("t"), blocks(t).alias("blocks")), look))


def bowel_preparation(t: Column) -> Column:
    """Boston score 0-9: sum of three segments, labelled segments, N/9, a total near the name of the scale.

    Outside the section on preparation the scale must be named. Status ends in _arith_inc where the total
    that the report states isn't the sum.
    """

    def scan(c, section):
        inside = section == "preparo"
        digit = lambda x: F.when(x == "o", 0).otherwise(x.try_cast("int"))
        three = _first(F.filter(F.slice(spans_of(c, THREE), 1, 1), lambda s: inside | _around(c, s, 60).rlike(BOSTON)))
        part = lambda s, i, p=THREE: digit(F.regexp_extract(_cut(c, s), p, i))
        total = lambda s, p=THREE: part(s, 1, p) + part(s, 2, p) + part(s, 3, p)

        def summed(s):
            tail = F.substring(c, s["end"] + 1, F.lit(30))
            stated = F.coalesce(*[F.regexp_extract(tail, p, 1).try_cast("int") for p in (r"^\s*=\s*0?(\d|10)\b",
                        r"^\s*=?\s*0?(\d|10)\s*/\s*9\b")])
            return _hit(total(s),
                F.when(stated.isNotNull() & (stated != total(s)), "bbps_soma_3seg_arith_inc").otherwise("bbps_soma_3seg"), s)

        named = lambda p: let(_first(spans_of(c, p)),
            lambda s: F.when(s.isNotNull(), _hit(total(s, p), "bbps_labeled_seg", s)))
        nine = _first(F.filter(spans_of(c, OF_NINE), lambda s: _around(c, s, 60).rlike(BOSTON)))
        one = lambda p, status: let(_first(spans_of(c, p)),
            lambda s: F.when(s.isNotNull() & part(s, 1, p).between(0, 9), _hit(part(s, 1, p), status, s)))
        found = F.coalesce(
            let(three, lambda s: F.when(s.isNotNull(), summed(s))), *map(named, LABELLED),
            let(nine, lambda s: F.when(s.isNotNull(), _hit(part(s, 1, OF_NINE), "bbps_sobre_9", s))),
            one(NEAR_BOSTON, "bbps_total_near"), one(TOTAL, "bbps_total"),
        )
        return F.array_compact(F.array(F.when(inside | c.rlike(BOSTON), found)))

    return by_section(t, BBPS_ORDER, scan, r"boston|bbps|[0-3o]\s*\+|\bcd\b|colon\s+direito|/\s*9\b")


def esophagitis_grade(t: Column) -> Column:
    """Los Angeles grade A-D or sem_esofagite; historical and ambiguous mentions have a status and no value."""

    def scan(c, section):
        past = lambda s: _around(c, s, 60).rlike(HISTORY)
        other = lambda s: _around(c, s, 60).rlike(OTHER_SCALE)
        letter = lambda s, p: F.upper(F.concat(F.regexp_extract(_cut(c, s), p, 1),
                F.regexp_extract(_cut(c, s), p, 2) if p == LA_EXPLICIT else F.lit("")))
        none = F.lit(None).cast("string")
        if_any = lambda spans, hit: let(_first(spans), lambda s: F.when(s.isNotNull(), hit(s)))
        several = if_any(spans_of(c, LA_SEVERAL),
            lambda s: _hit(none, F.when(past(s), "LA_historical").otherwise("LA_ambiguous"), s))
        explicit = if_any(F.filter(spans_of(c, LA_EXPLICIT), lambda s: ~other(s)),
            lambda s: _hit(F.when(~past(s), letter(s, LA_EXPLICIT)), F.when(past(s), "LA_historical").otherwise("LA_explicit"), s))
        near = F.filter(spans_of(c, GRADE), lambda s: ~other(s) & _around(c, s, 100).rlike(r"\besofagite\b"))
        sure = if_any(F.filter(near, lambda s: past(s) | _around(c, s, 100).rlike(EROSIVE)),
            lambda s: _hit(F.when(~past(s), letter(s, GRADE)), F.when(past(s), "LA_historical").otherwise("LA_implicit"), s))
        absent = if_any(spans_of(c, NO_ESOPHAGITIS), lambda s: _hit("sem_esofagite", "LA_negative", s))
        bare = if_any(near, lambda s: _hit(letter(s, GRADE), "LA_implicit_bare", s))
        return F.array_compact(F.array(F.coalesce(several, explicit, sure, absent, bare)))

    return by_section(t, LA_ORDER, scan, r"esof|\bgrau\b|lo?s?\s*an+g")


def hiatal_hernia(t: Column) -> Column:
    """sim, nao or nao_mencionada: in a section the named hernia beats its denial, that the measured height, that a widened hiatus."""

    def scan(c, section):
        def denied(s):
            lo = F.greatest(s["start"] - 250, F.lit(0))
            left = F.substring_index(F.substring(c, lo + 1, s["start"] - lo), ".", -1)
            rest = F.substring(c, s["end"] + 1, F.length(c))
            right = F.when(rest.contains("."), F.substring_index(rest, ".", 1)).otherwise(F.substring(rest, 1, 100))
            return F.concat(left, _cut(c, s), right).rlike(NO_HERNIA)

        def old(s):
            lo = F.greatest(s["start"] - 60, F.lit(0))
            return F.substring(c, lo + 1, s["end"] - lo).rlike(OLD_HERNIA)

        named = F.transform(F.filter(spans_of(c, HERNIA), lambda s: ~old(s)),
            lambda s: F.when(denied(s), _hit("nao", "hh_negative", s, 2)).otherwise(_hit("sim", "hh_lemma", s, 1)))
        cm = lambda s: to_double(F.concat(*[F.regexp_extract(_cut(c, s), ABOVE, i) for i in (1, 2, 3)]))
        measured = F.transform(spans_of(c, ABOVE),
            lambda s: F.when(denied(s), _hit("nao", "hh_negative", s, 2)).when(cm(s) >= LEAST_CM, _hit("sim", "hh_geometric", s, 3)))
        placed = F.transform(spans_of(c, IN_PLACE), lambda s: _hit("nao", "hh_negative", s, 2))
        wide = F.transform(spans_of(c, WIDENED), lambda s: _hit("nao", "hh_dilated_only", s, 4))
        return F.array_compact(F.concat(named, measured, placed, wide))

    return by_section(t, HERNIA_ORDER, scan, r"rnia|\bhh\b|pincamento|hiat|juncao|jec|jeg|transicao|linha\s+z", "nao_mencionada")


DETECTORS = {"bbps_por_secao": bowel_preparation, "la_grau_por_secao": esophagitis_grade, "hernia_por_secao": hiatal_hernia}
