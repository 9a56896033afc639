"""Rule discovery and sandbox: window skeletons, families, overlay rules, barriers, regression gate."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lauda.functions.text import let, to_double
from lauda.operators.policy import canonical_value

# Word classes of window skeletons.
SUBJECT = "polipo polipos polipoide polipoides polipectomia sessil sesseis pediculado pediculada".split()
LESION = "lesao lesoes plano plana elevada elevado neoplasia neoplasias massa tumor tumoral".split()
NEGATIVE = "papilofibroma papilofibromas hemorroida hemorroidas fissura fissuras corpo diverticulo diverticulos ulcera ulceras tatuagem pediculo".split()
SHOW = "exibia apresentava apresenta apresentou visualizada visualizado identificada identificado presenca presente presentes".split()
MEASURE = "medindo mede medida medem mediu".split()
CIRCA = "cerca aproximadamente aprox".split()
KEPT = "superficie regular irregular padrao vascular margem de com em".split()
CLASSES = ((SUBJECT, "SUBJ"), (LESION, "LESION"), (SHOW, "SHOW"), (MEASURE, "MEASURE"), (CIRCA, "CIRCA"))


def skeleton_tokens(t: Column, unit: str | Column) -> Column:
    """Classes of the words of a normalised window: N for numbers, UNIT, word classes; other words are dropped."""
    u = F.lit(unit) if isinstance(unit, str) else unit
    spaced = F.regexp_replace(F.regexp_replace(t, F.concat(F.lit(r"(\d)("), u, F.lit(r")\b")), F.lit("$1 $2")),
        r"[^a-z0-9/]+", " ")

    def cls(w):
        out = F.when(w.rlike(r"^\d+$"), "N").when(w == u, "UNIT")
        for words, name in CLASSES:
            out = out.when(w.isin(words), name)
        return out.when(w.isin(KEPT), w)

    return F.array_compact(F.transform(F.split(F.trim(spaced), " "), cls))


def skeleton(tokens: Column, radius: int = 5) -> Column:
    """Tokens around the first `N UNIT` (else the first N), joined; '' without a number."""

    def cut(x):
        i = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))),
                lambda k: F.when(F.size(x) > 1, F.concat_ws(" ", F.slice(x, k, F.lit(2)))).otherwise("")),
            F.lit("N UNIT"))
        i = F.when(i > 0, i).otherwise(F.array_position(x, F.lit("N"))).cast("int")
        lo = F.greatest(i - radius, F.lit(1))
        return F.when(i > 0, F.array_join(F.slice(x, lo, i + radius + 1 - lo), " ")).otherwise("")

    return let(tokens, cut)


def lane(t: Column) -> Column:
    """negative: another subject and no polyp; multidim: N x N; else positive."""
    words = F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1))
    other = F.arrays_overlap(words, F.array(*map(F.lit, NEGATIVE))) & ~F.arrays_overlap(words,
        F.array(F.lit("polipo"), F.lit("polipos")))
    return F.when(other, "negative").when(t.rlike(r"\d+\s*x\s*\d+"), "multidim").otherwise("positive")


def families(windows: DataFrame, text: str, unit: str | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lane, family_id, skeleton, n) of windows with normalised text; the unit may be a column."""
    s = skeleton(skeleton_tokens(F.col(text), unit))
    x = windows.withColumn("lane", lane(F.col(text))).withColumn("skeleton", F.when(F.col("lane") == "positive", s).otherwise(""))
    fid = F.when(F.col("lane") != "positive", F.concat(F.lit("pf_"), "lane")).when(F.col("skeleton") == "",
        "pf_noanchor").otherwise(F.concat(F.lit("pf_"), F.substring(F.sha2("skeleton", 256), 1, 12)))
    return x.withColumn("family_id", fid).groupBy(*keys, "lane", "family_id", "skeleton").agg(F.count("*").alias("n"))


def rule_of(skel: str, unit: str = "mm") -> str:
    """A regular expression for a family: its anchors before the number, if it has any."""
    names = {"SUBJ": SUBJECT, "LESION": LESION, "MEASURE": MEASURE, "CIRCA": CIRCA, "SHOW": SHOW}
    words = skel.split()
    before = words[: words.index("N")] if "N" in words else []
    anchors = [names[w] for w in before if w in names][-2:]
    head = "".join(rf"\b(?:{'|'.join(a)})\b.{{0,40}}?" for a in anchors)
    return rf"{head}(\d+(?:[.,]\d+)?)\s*{unit}\b"


@dataclass(frozen=True)
class Proposal:
    """A candidate rule: a pattern with one group, and words that forbid a sentence."""

    rule_id: str
    variable: str
    pattern: str
    forbidden: str | None = None
    family_coverage: float | None = None
    high_risk: bool = False

    @property
    def card_id(self) -> str:
        return hashlib.sha256(f"{self.variable}|{self.pattern}|{self.rule_id}".encode()).hexdigest()[:12]


def proposed(t: Column, p: Proposal) -> Column:
    """Greatest number the rule reads in the sentences it may look at."""
    parts = F.split(t, r"\. |\n")
    if p.forbidden:
        parts = F.filter(parts, lambda s: ~s.rlike(p.forbidden))
    return F.array_max(F.flatten(F.transform(parts,
                lambda s: F.transform(F.regexp_extract_all(s, F.lit(p.pattern), F.lit(1)), to_double))))


def overlay(t: Column, baseline: Column, p: Proposal) -> Column:
    """The rule acts only where the detector is silent."""
    return F.coalesce(baseline, proposed(t, p))


def regression_buckets(cases: DataFrame, baseline: Column, reference: Column, proposals: list[Proposal], text: str, ref: str,
    keys: tuple[str, ...] = ()) -> DataFrame:
    """(case, keys, rule_id, bucket): conform, pre_existing (wrong before too) or regressed, for every rule.

    For invariance cases the expectation is the same rule's answer on the reference text; where both
    texts were silent before and only one answers now, the case counts as pre_existing and `gap` marks it.
    """
    cells = []
    for p in proposals:
        now = overlay(F.col(text), baseline, p)
        want = F.when(F.col("kind") == "metamorphic_invariance",
            overlay(F.col(ref), reference, p)).otherwise(F.replace("expected_value", F.lit(","), F.lit(".")).try_cast("double"))
        was = F.when(F.col("kind") == "metamorphic_invariance", reference).otherwise(want)
        ok, before = F.round(now, 4).eqNullSafe(F.round(want, 4)), F.round(baseline, 4).eqNullSafe(F.round(was, 4))
        gap = (F.col("kind") == "metamorphic_invariance") & baseline.isNull() & reference.isNull() & ~ok
        bucket = F.when(ok, "conform").when(gap | ~before, "pre_existing").otherwise("regressed")
        cells.append(F.struct(F.lit(p.rule_id).alias("rule_id"), bucket.alias("bucket"), gap.alias("gap")))
    return cases.select("case_no", "kind", *keys, F.explode(F.array(*cells)).alias("c")).select("case_no", "kind", *keys, "c.*")


BARRIERS = ("B0_family", "B1_canaries", "B2_target", "B3_near_miss", "B4_regression")


def barrier_facts(cases: DataFrame, baseline: Column, reference: Column, proposals: list[Proposal], text: str, ref: str,
    keys: tuple[str, ...] = ()) -> DataFrame:
    """What the barriers ask of each rule, in one pass over all cases: (rule_id, keys, facts).

    Cases are the regression set: canaries are its synthetic ones, targets the cases with an expected
    number on which the detector is silent, near misses those without one. site_share is the leading
    source's share of the changed cases.
    """
    per = []
    want = F.replace("expected_value", F.lit(","), F.lit(".")).try_cast("double")
    for p in proposals:
        now = overlay(F.col(text), baseline, p)
        moved = ~now.eqNullSafe(baseline)
        hit = F.round(now, 4).eqNullSafe(F.round(want, 4))
        per.append(F.struct(
            F.lit(p.rule_id).alias("rule_id"), moved.alias("moved"), (baseline.isNull() & want.isNotNull()).alias("target"),
            (baseline.isNull() & want.isNotNull() & hit).alias("hit"),
            ((F.col("kind") == "synthetic_canary") & ~hit & (F.round(baseline,
                        4).eqNullSafe(F.round(want, 4)))).alias("canary_lost"),
            (want.isNull() & moved).alias("near_miss"),
        ))
    x = cases.select(*keys, "source", F.explode(F.array(*per)).alias("c")).select(*keys, "source", "c.*")
    by_site = x.groupBy("rule_id", *keys, "source").agg(F.count("*").alias("n"),
        *[F.count_if(c).alias(c) for c in ("moved", "target", "hit", "canary_lost", "near_miss")])
    g = by_site.groupBy("rule_id", *keys).agg(F.sum("n").alias("n"),
        *[F.sum(c).alias(c) for c in ("moved", "target", "hit", "canary_lost", "near_miss")], F.max("moved").alias("most"))
    b = regression_buckets(cases, baseline, reference, proposals, text, ref, keys).groupBy("rule_id",
        *keys).agg(F.count_if(F.col("bucket") == "regressed").alias("regressed"))
    same = F.lit(True)
    for k in ("rule_id", *keys):
        same = same & g[k].eqNullSafe(b[k])
    cover = F.create_map(*[z for p in proposals for z in (F.lit(p.rule_id), F.lit(p.family_coverage).cast("double"))])
    risk = F.create_map(*[z for p in proposals for z in (F.lit(p.rule_id), F.lit(p.high_risk))])
    return g.join(b, same, "left").select(
        g["rule_id"], *[g[k] for k in keys], "n", cover[g["rule_id"]].alias("family_coverage"),
        risk[g["rule_id"]].alias("high_risk"), F.col("canary_lost").alias("canaries_failed"),
        "target", F.round(F.try_divide("hit", "target"), 6).alias("target_rate"),
        F.col("near_miss").alias("near_miss_changed"), F.coalesce("regressed", F.lit(0)).alias("regressed"),
        F.col("moved").alias("changed"), F.round(F.try_divide("most", "moved"), 6).alias("site_share"),
    )


def evaluated(facts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """facts beside the first barrier that fails (NULL if none), the rule's status and the warning of a skewed site.

    A target rate from 0.60 up to the bar asks for refinement; without targets the second barrier can't
    pass. status: approved_for_review, refine or rejected.
    """
    c = F.col
    passed = (
        c("family_coverage").isNull() | (c("family_coverage") >= 0.10), c("canaries_failed") == 0,
        F.coalesce(c("target_rate") >= F.when(c("high_risk"), 0.90).otherwise(0.80), F.lit(False)),
        c("near_miss_changed") == 0, c("regressed") == 0,
    )
    failed = F.coalesce(*[F.when(~ok, name) for name, ok in zip(BARRIERS, passed)])
    status = F.when(c("failed").isNull(),
        "approved_for_review").when((c("failed") == "B2_target") & (c("target_rate") >= 0.60), "refine").otherwise("rejected")
    return facts.withColumn("failed", failed).withColumn("status", status).withColumn("skewed",
        F.coalesce(c("site_share") > 0.8, F.lit(False)))


def family_cards(misses: DataFrame, text: str, unit: str | Column, value: str, key: str, ratio: float = 0.7,
    least: int = 10) -> DataFrame:
    """Cards of the families of missed cells: (variable, family_id, lane, skeleton, counts, coverage, split sizes).

    A miss belongs to the family of its text and the cluster of the value that the other reader gave.
    coverage is the share that the family claims of the clusters it touches, n_families how many families
    those clusters fall into. Cases are split between discovery and evaluation by a hash of their key.
    Families below `least` cases and of other lanes than positive are marked, not dropped.
    """
    s = skeleton(skeleton_tokens(F.col(text), unit))
    x = misses.withColumn("lane", lane(F.col(text))).withColumn("skeleton", F.when(F.col("lane") == "positive", s).otherwise(""))
    fid = F.when(F.col("lane") != "positive", F.concat(F.lit("pf_"), "lane")).when(F.col("skeleton") == "",
        "pf_noanchor").otherwise(F.concat(F.lit("pf_"), F.substring(F.sha2("skeleton", 256), 1, 12)))
    part = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % 1000 < int(ratio * 1000)
    x = x.select("variable", F.col(value).alias("cluster"), "lane", "skeleton", fid.alias("family_id"), part.alias("discovery"))
    cell = x.groupBy("variable", "cluster", "lane", "skeleton", "family_id").agg(F.count("*").alias("n"),
        F.count_if("discovery").alias("n_discovery"))
    total = cell.groupBy("variable", "cluster").agg(F.sum("n").alias("total"), F.count("*").alias("families"))
    g = cell.join(total, ["variable", "cluster"]).groupBy("variable", "lane", "skeleton", "family_id").agg(
        F.sum("n").alias("n"), F.sum("n_discovery").alias("n_discovery"), F.count("*").alias("n_clusters"),
        F.round(F.sum("n") / F.sum("total"), 6).alias("coverage"), F.max("families").alias("n_families"),
    )
    usable = (F.col("lane") == "positive") & (F.col("family_id") != "pf_noanchor") & (F.col("n") >= least)
    return g.select("variable", "family_id", "lane", "skeleton", "n", "n_discovery",
        (F.col("n") - F.col("n_discovery")).alias("n_evaluation"), "n_clusters", "n_families", "coverage", usable.alias("usable"))


def cluster_cards(misses: DataFrame, value: str, site: str, key: str, ratio: float = 0.7, least: int = 10) -> DataFrame:
    """Cards of the clusters of missed cells: (variable, cluster, n, split sizes, sites, leading site's share, usable)."""
    part = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % 1000 < int(ratio * 1000)
    x = misses.groupBy("variable", F.col(value).alias("cluster"),
        F.coalesce(site, F.lit("__missing__")).alias("site")).agg(F.count("*").alias("m"), F.count_if(part).alias("d"))
    g = x.groupBy("variable", "cluster").agg(F.sum("m").alias("n"), F.sum("d").alias("n_discovery"),
        F.count("*").alias("n_sites"), F.round(F.max("m") / F.sum("m"), 6).alias("site_share"))
    return g.select("variable", "cluster", "n", "n_discovery", (F.col("n") - F.col("n_discovery")).alias("n_evaluation"),
        "n_sites", "site_share", (F.col("n") >= least).alias("usable"))


def support_tag(n: Column) -> Column:
    return F.when(n < 10, "low_support").otherwise("supported")


def grounding_tag(rate: Column) -> Column:
    return F.when(rate.isNull(), "unknown").when(rate >= 0.7, "grounded").when(rate >= 0.3,
        "partly_grounded").otherwise("ungrounded")


def jaccard_families(windows: list[str], threshold: float = 0.3) -> int:
    """Greedy number of word families of a few windows."""
    heads: list[set] = []
    for w in windows:
        s = set(re.findall(r"[a-z]{3,}", w.lower()))
        if not any(s and h and len(s & h) / len(s | h) >= threshold for h in heads):
            heads.append(s)
    return len(heads)


__all__ = ["Proposal", "canonical_value", "evaluated", "families", "regression_buckets", "rule_of"]
