"""Free-entered values mapped to a canonical list: symmetric-delete lookup, weighted Damerau-Levenshtein.

A dictionary of spellings (canonical entries, aliases, known synonyms) is indexed by all strings left
after deleting up to two characters; a typed value meets every spelling within two edits through its
own deletions. Candidates are ranked by a weighted edit distance and, between equals, by how often
their canonical entry stands in the data; values without a clear winner are reported as unmatched.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lauda.llm.chars import LOOKALIKES, simple_form
from lauda.operators.units import fold
from lauda.session import collect_bounded, maybe_broadcast, reliable

NONE = "(none)"
EDITS = 2
#: Up to this many spellings the dictionary is sent to every executor; a larger one is joined.
MAX_SPELLINGS = 50_000
#: Least lead of the best entry over another one.
LEAD = 0.05
#: Weight of the decimal logarithm of an entry's frequency against the distance.
RANK = 0.1

# Domain synonyms and abbreviations by variable and canonical entry, beside the registry's
# aliases. Endings, numbers, grades and durations aren't listed: the edits and rule_spellings() cover them.
SYNONYMS = {
    "bethesda": {
        "I": "nao diagnostico; insatisfatorio", "II": "benigno",
        "III": "aus; flus; aus/flus; atipia de significado indeterminado; atipias de significado indeterminado",
        "IV": "suspeito para neoplasia folicular; neoplasia folicular",
        "V": "suspeito para malignidade; suspeito de malignidade", "VI": "maligno",
    },
    "resultado": {
        "negativo_para_malignidade": "nilm; ausencia de malignidade; neg. p/ malignidade; negativo p/ malignidade; negativo p/ lesao intraepitelial ou malignidade; negativo para lesao intraepitelial ou malignidade",
        "asc_us": "celulas escamosas atipicas de significado indeterminado",
        "asc_h": "celulas escamosas atipicas, nao excluir alto grau; celulas escamosas atipicas, nao se pode excluir lesao de alto grau",
        "lsil": "liebg; nic 1; nic i; lesao de baixo grau; lesao intraepitelial escamosa de baixo grau; lesao intraepitelial de baixo grau",
        "hsil": "lieag; nic 2; nic 3; nic ii; nic iii; lesao de alto grau; lesao intraepitelial escamosa de alto grau; lesao intraepitelial de alto grau",
        "agc": "atipia glandular; celulas glandulares atipicas; agus",
        "carcinoma_escamoso": "ca escamoso; carcinoma epidermoide; ca epidermoide; carcinoma de celulas escamosas; cec",
        "adenocarcinoma": "adenoca; adenocarcinoma endocervical; adenocarcinoma invasor",
    },
    "adequab": {
        "satisfatoria": "adequada; amostra satisfatoria; amostra adequada",
        "satisfatoria_limitada": "satisfat. limitada; satisfatoria mas limitada; satisfatoria porem limitada; satisfatoria, limitada por sangue; satisfatoria com limitacoes; limitada",
        "insatisfatoria": "insatisf; insatisf.; inadequada; amostra insatisfatoria; amostra inadequada",
    },
    "tipo_histologico": {
        "carcinoma_ductal_invasivo": "ca ductal inv.; ca ductal invasivo; ca ductal invasor; carcinoma ductal invasor; carcinoma ductal infiltrante; ductal infiltrante; ductal invasivo; carcinoma mamario invasivo tipo ductal; cdi; carcinoma invasivo de tipo nao especial",
        "carcinoma_ductal_in_situ": "ca ductal in situ; ductal in situ; carcinoma intraductal; cdis",
        "carcinoma_lobular_invasivo": "ca lobular inv.; ca lobular invasivo; ca lobular invasor; carcinoma lobular invasor; carcinoma lobular infiltrante; lobular infiltrante; lobular invasivo; cli",
        "carcinoma_mucinoso": "ca mucinoso; carcinoma coloide; ca coloide; mucinoso",
        "carcinoma_tubular": "ca tubular; tubular; tubular, bem diferenciado",
        "carcinoma_metaplasico": "ca metaplasico; metaplasico",
        "fibroadenoma": "fibroadenoma mamario",
        "tumor_filoide": "tumor phyllodes; filoide; phyllodes",
        "papiloma_intraductal": "papiloma ductal; papiloma",
    },
    "intervalo_controle": {"sem_recomendacao": "sem necessidade de controle; dispensa controle; nao recomendado; sem controle; nao se aplica controle"},
    "segmento": {
        "ceco": "no ceco; fundo cecal; cecal; em ceco",
        "colon_ascendente": "ascendente; colo ascendente; colon direito (ascendente); colon direito; colon asc.",
        "flexura_hepatica": "angulo hepatico; flex. hepatica; flexura direita",
        "colon_transverso": "transverso; colo transverso; colon transv.",
        "flexura_esplenica": "angulo esplenico; flex. esplenica; flexura esquerda",
        "colon_descendente": "descendente; colo descendente; colon desc.; colon esquerdo (descendente)",
        "sigmoide": "sigma; colon sigmoide; colo sigmoide; alca sigmoide",
        "reto": "reto distal; reto medio; reto proximal; ampola retal; retal",
    },
    "procedimento": {
        "biopsia_agulha_grossa": "bx agulha grossa; biopsia por agulha grossa; biopsia com agulha grossa; biopsia de fragmento; core biopsy; core",
        "puncao_aspirativa": "paaf; puncao por agulha fina; puncao aspirativa por agulha fina; puncao",
        "mastectomia_total": "mastect. total; mastectomia simples",
        "quadrantectomia": "quadrantectomia mamaria; resseccao de quadrante",
        "setorectomia": "setorectomia mamaria; setor mamario; resseccao setorial",
        "polipectomia": "polipectomia com alca; polipectomia endoscopica; resseccao de polipo",
        "mucosectomia": "emr; mucosectomia endoscopica; resseccao endoscopica da mucosa; resseccao endoscopica de mucosa",
    },
    "margens": {
        "livres": "margens livres; negativas; margens negativas; nao comprometidas; margens nao comprometidas",
        "exiguas": "margens exiguas; margens proximas; proximas; tangenciadas",
        "comprometidas": "margens comprometidas; positivas; margens positivas; acometidas",
    },
}
# Numbers in words, and adjectives of periods in months.
WORDS = {1: "um", 2: "dois", 3: "tres", 4: "quatro", 5: "cinco", 6: "seis", 7: "sete", 8: "oito", 9: "nove", 10: "dez",
    12: "doze", 18: "dezoito", 24: "vinte e quatro"}
PERIODS = {1: "mensal", 2: "bimestral", 3: "trimestral", 6: "semestral", 12: "anual", 24: "bienal", 36: "trienal",
    60: "quinquenal", 120: "decenal"}
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6}


def rule_spellings(variable: str, canonical: str) -> set[str]:
    """Spellings that follow from the form of an entry: numerals, grades of a score, signs of a status, durations."""
    out, name = set(), variable.split("_")[0]
    if canonical in ROMAN:
        for n in (canonical.lower(), str(ROMAN[canonical])):
            out |= {n, *(f"{x} {n}" for x in ("cat.", "cat", "categoria", "classe", "grupo", variable, variable[0])),
                f"{variable[0]}{n}"}
    if m := re.fullmatch(r"([0-3])\+?", canonical):
        n = int(m[1])
        plus, word = "+" * n, ("nenhuma", "uma", "duas", "tres")[n]
        grades = {m[1], f"{n}+", plus} - {""}
        out |= grades | {f"+{n}", f"{n}/3+", f"{n}+/3+", f"{plus}/3+",
            f"{word} cruz" if n == 1 else f"{word} cruzes"} | ({"zero"} if not n else set())
        out |= {f"{x}{sep}{g}" for g in (grades | {"zero"} if not n else grades) for x in ("score", "escore",
                name) for sep in (" ", ": ", " (")}
    if canonical in ("positivo", "negativo"):
        sign, what = ("+", ("reagente", "presente")) if canonical == "positivo" else ("-", ("nao reagente", "ausente"))
        out |= {canonical[:3], f"{name}{sign}", f"{name} {sign}", *what, f"receptor {canonical}", f"expressao {what[1]}"}
    if m := re.fullmatch(r"(\d+)_(mes|meses|ano|anos)", canonical):
        months = int(m[1]) * (12 if m[2].startswith("ano") else 1)
        spans = [(months,
                ("meses" if months > 1 else "mes", "m"))] + ([(months // 12,
                    ("anos" if months > 12 else "ano", "a"))] if months % 12 == 0 else [])
        for n, (unit, short) in spans:
            for k in {str(n), WORDS.get(n, str(n))}:
                out |= {f"{pre}{k} {unit}" for pre in ("", "em ", "a cada ", "apos ")}
            out |= {f"{n}{short}", f"{n} {short}"}
        out |= {f"{d} dias" for d in ({30 * months} if months % 12 else {30 * months,
                    365 * months // 12})} | ({f"{4 * months} semanas"} if months < 12 else {f"{52 * months // 12} semanas"})
        out |= {PERIODS[months]} if months in PERIODS else set()
    return out


_DROP = re.compile(r"^\s*(?:resultado|valor|resposta|conclusao)\s*[:=]\s*|\(\s*(?:ver|vide|conforme)\s+laudo\s*\)|[\"'“”‘’`´]")


def key_form(value: str) -> str:
    """Comparable form: folded, look-alikes plain, wrappers dropped, punctuation but + - / % out, one space."""
    s = fold("".join(LOOKALIKES.get(c, c) for c in simple_form(value)))
    s = _DROP.sub(" ", s)
    s = re.sub(r"[^a-z0-9+/%\-]+", " ", s)
    s = re.sub(r"(?<=[a-z])-(?=[a-z])", "", s)
    return re.sub(r"\s+", " ", s).strip(" -")


def keep_sign(value: str) -> str:
    """key_form that keeps a final minus, which is a result ('RE-')."""
    s = fold(value).strip(" .;,\"'")
    k = key_form(value)
    return k + "-" if re.fullmatch(r"(?:.*\W)?r[ep]\s*-(?:\s*\(.*\))?", s) else k


@lru_cache(maxsize=200_000)
def deletes(s: str) -> frozenset:
    """The string and what is left of it after one or two deletions; one for strings that allow one edit only."""
    out, edits = {s}, 0 if len(s) < 3 else 1 if len(s) <= 4 else EDITS
    for n in range(1, min(edits, max(0, len(s) - 1)) + 1):
        out |= {"".join(c for i, c in enumerate(s) if i not in drop) for drop in map(set, combinations(range(len(s)), n))}
    return frozenset(out)


def distance(typed: str, entry: str) -> tuple[int, float]:
    """(plain, weighted) Damerau-Levenshtein distance, both along the cheapest weighted path.

    A doubled letter costs 0.7, a swap 0.8, a lost letter 1.0, another letter 1.1, an extra letter
    that doubles none 1.6; an edit at the first letter costs half as much again.
    """
    n, m = len(typed), len(entry)
    d = [[(0.0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        d[i][0] = (d[i - 1][0][0] + 1.6, i)
    for j in range(1, m + 1):
        d[0][j] = (d[0][j - 1][0] + 1.5, j)
    for i in range(1, n + 1):
        a = typed[i - 1]
        for j in range(1, m + 1):
            b = entry[j - 1]
            first = 1.5 if j == 1 else 1.0
            x = d[i - 1][j - 1]
            best = x if a == b else (x[0] + 1.1 * first, x[1] + 1)
            x = d[i - 1][j]
            twin = i > 1 and typed[i - 2] == a or i < n and typed[i] == a
            best = min(best, (x[0] + (0.7 if twin else 1.6), x[1] + 1))
            x = d[i][j - 1]
            best = min(best, (x[0] + 1.0 * first, x[1] + 1))
            if i > 1 and j > 1 and a == entry[j - 2] and typed[i - 2] == b:
                x = d[i - 2][j - 2]
                best = min(best, (x[0] + 0.8, x[1] + 1))
            if i > 1 and j > 2 and a == entry[j - 3] and typed[i - 2] == b:  # a swap over a lost letter
                x = d[i - 2][j - 3]
                best = min(best, (x[0] + 1.8, x[1] + 2))
            if i > 2 and j > 1 and a == entry[j - 2] and typed[i - 3] == b:  # a swap over an extra letter
                x = d[i - 3][j - 2]
                best = min(best, (x[0] + 2.4, x[1] + 2))
            d[i][j] = best
    return d[n][m][1], d[n][m][0]


_EXACT = re.compile(r"\d+|(?<![a-z])[ivx]+(?![a-z])|[+%/]+|-$")


def allowed(typed: str, entry: str) -> bool:
    """Numbers, Roman numerals and signs must agree; short values aren't corrected, mid-length ones by one edit."""
    if _EXACT.findall(typed) != _EXACT.findall(entry):
        return False
    n = min(len(typed), len(entry))
    return n >= 4 or (n == 3 and max(len(typed), len(entry)) >= 4)


def most_edits(typed: str, entry: str) -> int:
    return 1 if max(len(typed), len(entry)) <= 6 else EDITS


def decide(scored: list[tuple[float, str]], frequency: dict[str, float]) -> str:
    """The canonical entry of the best spelling; NONE without a spelling or a clear lead over another entry."""
    best: dict[str, float] = {}
    for w, canonical in scored:
        rank = round(w - RANK * frequency.get(canonical, 0.0), 9)
        best[canonical] = min(best.get(canonical, 9e9), rank)
    order = sorted(best.items(), key=lambda x: (x[1], x[0]))
    if not order or (len(order) > 1 and order[1][1] - order[0][1] < LEAD):
        return NONE
    return order[0][0]


class Dictionary:
    """Spellings per variable with their symmetric-delete index, and the canonical entries' frequencies."""

    def __init__(self, spellings: list[tuple[str, str, str]], frequency: dict[tuple[str, str], int]):
        self.exact: dict = defaultdict(set)
        self.index: dict = defaultdict(set)
        for variable, form, canonical in spellings:
            self.exact[(variable, form)].add(canonical)
            if len(form) >= 3:
                for x in deletes(form):
                    self.index[(variable, x)].add(form)
        self.frequency = defaultdict(dict)
        for (v, c), n in frequency.items():
            self.frequency[v][c] = math.log10(1 + n)
        self.cache: dict = {}

    def lookup(self, variable: str, value: str) -> str:
        form = keep_sign(value)
        got = self.cache.get((variable, form))
        if got is None:
            exact = self.exact.get((variable, form))
            if exact:
                got = next(iter(exact)) if len(exact) == 1 else NONE
            else:
                near = {e for x in deletes(form) for e in self.index.get((variable, x), ())} if len(form) >= 3 else ()
                got = decide([(w, c) for e in near for w, c in score(form, e, self.exact[(variable, e)])],
                    self.frequency[variable])
            if len(self.cache) < 500_000:
                self.cache[(variable, form)] = got
        return got


def score(form: str, entry: str, canonicals) -> list[tuple[float, str]]:
    if not allowed(form, entry):
        return []
    n, w = distance(form, entry)
    return [(w, c) for c in canonicals] if n <= most_edits(form, entry) else []


def spellings(ontology: DataFrame, aliases: DataFrame) -> DataFrame:
    """(variable, form, canonical) of canonical entries, registry aliases and known synonyms, without repeats."""
    enum = ontology.where("onto_type = 'enum' AND canonical IS NOT NULL").select("variable", "canonical").distinct()
    alias = aliases.where("alias IS NOT NULL AND trim(alias) <> ''").select("variable", F.col("alias").alias("spelling"),
        "canonical")
    alias = alias.join(enum, ["variable", "canonical"], "left_semi")
    raw = enum.select("variable", F.lit(None).cast("string").alias("spelling"),
        "canonical").unionByName(alias.select("variable", "spelling", "canonical"))

    def forms(batches):
        for b in batches:
            out = set()
            for v, spelling, c in zip(b.variable, b.spelling, b.canonical):
                own = [spelling] if isinstance(spelling, str) else [c, *rule_spellings(v, c),
                    *SYNONYMS.get(v, {}).get(c, "").split(";")]
                out |= {(v, form, c) for form in map(keep_sign, own) if form}
            yield pd.DataFrame(sorted(out), columns=["variable", "form", "canonical"])

    return raw.mapInPandas(forms, "variable string, form string, canonical string").distinct()


def to_canonical(verdicts: DataFrame, ontology: DataFrame, aliases: DataFrame, max_spellings: int = MAX_SPELLINGS) -> DataFrame:
    """(verdict_id, canonical) of values of enum variables that aren't blank nor canonical already.

    NULL and blank values and values of other variables give no row; values without a clear entry give
    '(none)'. Every row is mapped where it stands, without a shuffle; values of any length are read
    whole; repeated rows each get their row; an empty ontology gives an empty result. More spellings
    than max_spellings are joined, with the same result.
    """
    enum = ontology.where("onto_type = 'enum' AND canonical IS NOT NULL").select("variable", "canonical").distinct()
    typed = verdicts.where("value IS NOT NULL AND trim(value) <> ''").select("verdict_id", "variable", "value")
    counted = typed.join(maybe_broadcast(enum.withColumnRenamed("canonical", "value")), ["variable", "value"],
        "left_semi").groupBy("variable", F.col("value").alias("canonical")).count()
    words = spellings(ontology, aliases)
    rows, entries = collect_bounded(words, max_spellings), collect_bounded(enum, max_spellings)
    if rows is None or entries is None:
        return _by_join(typed, enum, words, counted)
    known = {(r["variable"], r["canonical"]) for r in entries}
    frequency = {(r["variable"], r["canonical"]): r["count"] for r in counted.collect()}  # at most one row per entry
    shared = verdicts.sparkSession.sparkContext.broadcast(([tuple(r) for r in rows], frequency, known))

    def apply(batches):
        words, freq, known = shared.value
        d, variables = Dictionary(words, freq), {v for v, _ in known}
        for b in batches:
            out = [(i, d.lookup(v, x)) for i, v,
                x in zip(b.verdict_id, b.variable, b.value) if v in variables and (v, x) not in known and x.strip()]
            yield pd.DataFrame(out, columns=["verdict_id", "canonical"])

    return typed.mapInPandas(apply, "verdict_id long, canonical string")


def _cuts(df: DataFrame, form: str, keep: list[str]) -> DataFrame:
    """df with one row per string left of `form` after deletions."""

    def cut(batches):
        for b in batches:
            rows = [(*r, x) for r in b[keep].itertuples(index=False, name=None) for x in deletes(r[keep.index(form)])]
            yield pd.DataFrame(rows, columns=[*keep, "cut"])

    return df.select(*keep).mapInPandas(cut, ", ".join(f"{c} string" for c in [*keep, "cut"]))


def _by_join(typed: DataFrame, enum: DataFrame, words: DataFrame, counted: DataFrame) -> DataFrame:
    """The same mapping for a dictionary of any size: distinct forms meet spellings on their deletions.

    Short strings allow one deletion, so every key has three letters or more. Ranks as decide() does.
    """
    rows = typed.join(enum.select("variable").distinct(), "variable", "left_semi").join(
        enum.withColumnRenamed("canonical", "value"), ["variable", "value"], "left_anti"
    )

    def formed(batches):
        cache: dict = {}
        for b in batches:
            b = b[b.value.map(lambda x: bool(x.strip()))]
            out = []
            for x in b.value:
                f = cache.get(x)
                if f is None:
                    f = keep_sign(x)
                    if len(cache) < 200_000:
                        cache[x] = f
                out.append(f)
            yield b.assign(form=out)[["verdict_id", "variable", "form"]]

    rows = reliable(rows.select("verdict_id", "variable", "value").mapInPandas(formed,
            "verdict_id long, variable string, form string"))
    left = _cuts(rows.select("variable", "form").distinct(), "form", ["variable", "form"])
    right = _cuts(words.withColumnRenamed("form", "entry"), "entry", ["variable", "entry", "canonical"])
    pairs = left.join(right, ["variable", "cut"]).select("variable", "form", "entry", "canonical").distinct()

    def near(batches):
        for b in batches:
            w = [0.0 if f == e else next((x for x, _ in score(f, e, [""])), None) for f, e in zip(b.form, b.entry)]
            d = b.assign(w=pd.array(w, "Float64"), exact=b.form == b.entry)[["variable", "form", "canonical", "w", "exact"]]
            yield d[d.w.notna()]

    scored = pairs.mapInPandas(near, "variable string, form string, canonical string, w double, exact boolean")
    best = scored.groupBy("variable", "form", "canonical").agg(F.min("w").alias("w"), F.bool_or("exact").alias("exact"))
    best = best.join(counted, ["variable", "canonical"], "left").withColumn("w",
        F.round(F.col("w") - RANK * F.log10(1 + F.coalesce("count", F.lit(0))), 9))
    # a spelling of its own beats every other; of one form there are as many rows as entries within two edits
    by = Window.partitionBy("variable", "form").orderBy(F.desc("exact"), "w", "canonical")
    best = best.withColumn("r", F.row_number().over(by)).withColumn("n_exact",
        F.count_if("exact").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("next",
        F.lead("w").over(by)).where("r = 1")
    none = F.when(F.col("exact"), F.col("n_exact") > 1).otherwise(F.col("next") - F.col("w") < LEAD)
    best = best.select("variable", "form", F.when(none, NONE).otherwise(F.col("canonical")).alias("canonical"))
    return rows.join(best, ["variable", "form"], "left").select("verdict_id",
        F.coalesce("canonical", F.lit(NONE)).alias("canonical"))
