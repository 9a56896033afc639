"""Variables derived from detected ones, and the polyp size with its nearest noun."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from lauda.functions import detectors as D
from lauda.functions.text import let, measure_mm
from lauda.operators.joins import spans_of


def behavior_class(tipo: Column) -> Column:
    return F.when(tipo.isin(*D.INVASIVE), "invasivo").when(tipo.isin(*D.IN_SITU), "in_situ").when(tipo.isin(*D.BENIGN), "benigno")


def invasive_malignancy(tipo: Column) -> Column:
    return F.when(tipo.isNotNull(), F.when(tipo.isin(*D.INVASIVE), "sim").otherwise("nao"))


def malignancy_any(tipo: Column) -> Column:
    return F.when(tipo.isNotNull(), F.when(tipo.isin(*D.INVASIVE, *D.IN_SITU), "sim").otherwise("nao"))


def cystic_features(t: Column) -> Column:
    """How many features of a fibrocystic pattern a text holds."""
    return reduce(add, [t.rlike(p).cast("int") for p in D.CYSTIC])


def her2_of_score(score: Column) -> Column:
    s = F.rtrim(score)
    return F.when(s.isin("3", "3+"), "positivo").when(s.isin("2", "2+"), "equivoco").when(s.isin("0", "0+", "1", "1+"),
        "negativo")


def molecular_subtype(re: Column, rp: Column, her2: Column, ki67: Column) -> Column:
    """Receptor and HER2 truth table, Ki-67 cut at 20; NULL where a needed marker is missing or equivocal."""
    pos = F.coalesce((re == "positivo") | (rp == "positivo"), F.lit(False))
    neg = F.coalesce((re == "negativo") & (rp == "negativo"), F.lit(False))
    return (
        F.when(pos & (her2 == "positivo"), "luminal_b_her2pos").when(pos & (her2 == "negativo"),
            F.when(ki67 < 20, "luminal_a").when(ki67 >= 20, "luminal_b_her2neg").otherwise("luminal"))
        .when(neg & (her2 == "positivo"), "her2_enriched").when(neg & (her2 == "negativo"), "triplo_negativo")
    )


def polyp_size(t: Column) -> Column:
    """Greatest measure in mm (0.5 to 200) whose nearest noun is a polyp, without bounds, scores and distances.

    The nearest noun is the last one within 200 characters on the left, else the first within 100 on
    the right, polyp nouns before others.
    """

    def size(x):
        t = x["t"]

        def belongs(m):
            near = lambda spans: F.array_max(F.transform(F.filter(spans,
                        lambda s: (s["start"] < m["start"]) & (s["start"] >= m["start"] - 200)),
                    lambda s: s["start"]))
            after = lambda spans: F.exists(spans, lambda s: (s["start"] >= m["end"]) & (s["end"] <= m["end"] + 100))
            own, other = F.coalesce(near(x["own"]), F.lit(-1)), F.coalesce(near(x["other"]), F.lit(-1))
            back = lambda n: F.substring(t, F.greatest(m["start"] - n, F.lit(0)) + 1, F.least(m["start"], F.lit(n)))
            noun = F.when((own >= 0) | (other >= 0), own > other).otherwise(after(x["own"]))
            return noun & ~back(30).rlike(D.BOUND) & ~back(15).rlike(D.NOISE) & ~F.substring(t, m["end"] + 1,
                F.lit(30)).rlike(D.DISTANCE)

        mm = F.transform(F.filter(x["sizes"], belongs),
            lambda m: measure_mm(F.substring(t, m["start"] + 1, m["end"] - m["start"])))
        return F.array_max(F.filter(mm, lambda v: (v >= 0.5) & (v <= 200)))

    return let(F.struct(t.alias("t"), spans_of(t, D.SIZE).alias("sizes"), spans_of(t, D.POLYP).alias("own"),
            spans_of(t, D.OTHER).alias("other")),
        size)


def tumour_size(t: Column) -> Column:
    """Greatest measure in mm behind a size label, else after 'medindo', else after '=' where size was spoken of."""
    mm = lambda xs: F.array_max(F.transform(xs, measure_mm))

    def size(t):
        labelled = F.concat(*[F.regexp_extract_all(t, F.lit(p + r"(?:area\s+de\s+)?" + D.TUMOUR_MEASURE),
                    F.lit(1)) for p in D.SIZE_LABELS])
        again = r"=\s*" + D.TUMOUR_MEASURE
        at = F.regexp_instr(t, F.lit(again)) - 1
        near = F.substring(t, F.greatest(at - 80, F.lit(0)) + 1, F.least(at, F.lit(80))).rlike("tamanho|dimens|neoplasia|tumor")
        return F.coalesce(mm(labelled), mm(F.regexp_extract_all(t, F.lit(D.MEASURING + D.TUMOUR_MEASURE), F.lit(1))),
            F.when((at >= 0) & near, measure_mm(F.regexp_extract(t, again, 1))))

    return let(t, size)


def polyp_size_words(t: Column) -> Column:
    """Size of the first polyp that words or a bound ('menores que 5 mm') tell, NULL if none do."""

    def size(x):
        def one(s):
            w = F.substring(x["t"], F.greatest(s["start"] - 60, F.lit(0)) + 1,
                s["end"] + 60 - F.greatest(s["start"] - 60, F.lit(0)))
            clean = F.regexp_replace(w, D.NO_SIZE, "")
            mm = measure_mm(F.concat(F.regexp_extract(w, D.SIZE_BOUND, 1), F.regexp_extract(w, D.SIZE_BOUND, 2)))
            out = F.when(w.rlike(D.SIZE_BOUND),
                F.when(mm <= 5, "qualitative_diminuto").when(mm <= 10, "qualitative_subcm").otherwise("qualitative_large"))
            for p, label in reversed(D.SIZE_WORDS):
                out = F.when(clean.rlike(p), label).otherwise(out)
            return out

        return F.get(F.array_compact(F.transform(x["own"], one)), F.lit(0))

    return let(F.struct(t.alias("t"), spans_of(t, D.POLYP).alias("own")), size)


def outside_in_situ(behavior: Column, c: Column) -> Column:
    """A component that an in-situ tumour doesn't have."""
    return F.when(~F.coalesce(behavior == "in_situ", F.lit(False)), c)


# Invasive component beside an in-situ type; words of a bound beside a percentage.
INVASIVE_TOO, LOWER_BOUND = r"(?:carcinoma|neoplasia).{0,40}(?:invasiv|infiltrant)", r"(?:mais|menos)\s+(?:de|que)|\bate\s+\d|<\s*\d|cerca\s+de\s+\d"


def receptor_flags(t: Column) -> Column:
    """(erlow, is_cdis_only, ki67_is_lower_bound, her2_resolved) of a breast immunohistochemistry report."""

    def flags(t):
        re_, pct, tipo = D.RE.column(t), D.RE_PCT.column(t), D.TIPO_IHQ.column(t)["value"]
        low = (re_["value"] == "positivo") & F.coalesce(pct.between(1,
                10) | (pct.isNull() | ~pct.between(1, 10)) & re_["evidence"].contains("frac"),
            F.lit(False))
        return F.struct(
            F.coalesce(low, F.lit(False)).alias("erlow"),
            F.coalesce(tipo.isin("CDIS", "CLIS") & ~t.rlike(INVASIVE_TOO), F.lit(False)).alias("is_cdis_only"),
            F.coalesce(D.KI67.evidence(t).rlike(LOWER_BOUND), F.lit(False)).alias("ki67_is_lower_bound"),
            F.coalesce(D.HER2_STATUS.column(t)["value"].isin("positivo", "negativo"), F.lit(False)).alias("her2_resolved"),
        )

    return let(t, flags)


def invasion_record(t: Column, rule) -> Column:
    """(value, status, certainty, evidence) of an invasion rule; a text that doesn't mention it has status not_mentioned."""
    r = rule.column(t)
    seen = r["value"].isNotNull()
    return F.struct(r["value"].alias("value"), F.when(seen, "detected").otherwise("not_mentioned").alias("status"),
        F.when(seen, "high").alias("certainty"), r["evidence"].alias("evidence"))
