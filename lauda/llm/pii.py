"""Personal information in free text: weak labelers, expectation-maximisation and a span classifier.

Candidate spans come from broad patterns. Labelers of three kinds (regex shapes, gazetteers, context
words) vote on every candidate or abstain; what speaks against an item (an institution's or a method's
name, a word that is no name) is a labeler too. The vote patterns are counted over the whole corpus (a
table bounded by the number of labelers), expectation-maximisation estimates each labeler's reliability
and the class of every pattern, starting from weak assumptions (RELIABLE). A naive Bayes span classifier
over context and shape, in hashed, bounded slots, is then trained on all candidates with these soft
labels; it decides every span, with the pattern's posterior as its tempered prior, and so corrects
patterns whose labelers contradict each other or have too few votes.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lauda.llm.chars import LOOKALIKES, plain
from lauda.llm.charlm import CharModel
from lauda.llm.encodings import LOST, ODD, Restorer, swap_tables
from lauda.session import reliable

PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "street_address": "[ADDRESS]"}
BUCKETS = 4096
ROUNDS = 30
#: Assumed reliability of each labeler, what the assumption is worth in shares of the labeler's votes (so that
#: it is worth the same at every size), and the weight of the votes' posterior in the classifier.
RELIABLE = {
    "cue": 0.7, "gaz": 0.7, "shape": 0.8, "after": 0.6, "org": 0.97, "eponym": 0.97, "form": 0.9, "ctx": 0.85, "tail": 0.9,
    "length": 0.9, "mark": 0.9, "use": 0.97,
}
ASSUMED, PRIOR_WEIGHT = 0.1, 0.5

# Common given names (accents and case folded).
GIVEN = frozenset(
    "adriana alice amanda ana andre andrea antonia antonio aparecida arthur augusto aurea beatriz benedita bernardo bianca bruna bruno caio camila carla carlos carolina "
    "cecilia celia celso cesar clara claudia claudio cristina dalva daniel daniela david davi debora denise diego edson eduardo elaine elisa eliana elias emilia ester eva "
    "fabio fabiana fatima felipe fernanda fernando flavia flavio francisca francisco gabriel gabriela geraldo gilberto gloria guilherme gustavo heitor helena helio "
    "henrique hugo ines irene isabel isabela ivan ivone jaqueline joana joao joaquim jorge jose josefa juliana julia julio karina laura leandro leonardo leticia lucas lucia "
    "luciana luis luiz luiza manoel manuel marcela marcelo marcia marcio marcos maria mariana marina mario marta mateus mauricio miguel monica nadia neide nelson nilza norberto "
    "odete olga otavio patricia paula paulo pedro priscila rafael raimundo raquel raul regina renata renato ricardo rita roberta roberto rodrigo rosa rosangela ruth sandra "
    "sebastiao sergio silvia simone sonia sueli tania teresa tereza thiago tiago valeria vanessa vera vicente victor vinicius vitor viviane wagner yara".split()
)
PARTICLES = frozenset("de da do das dos e".split())
# Words after a name cue that aren't names.
NO_NAME = frozenset(
    "amostra exame laudo material lesao biopsia novo nova o a os as um uma em no na nos nas por para com sem que se ao este esta seu sua paciente pacientes medico medica "
    "mesmo mesma retorno rotina acordo interno interna fragmento fragmentos hospital clinica laboratorio instituto maternidade unidade servico equipe familia cpf rg cns cnpj "
    "telefone celular endereco nome mae pai filho filha data removido removidos removida removidas".split()
)
STREET = r"(?:rua|r\.|avenida|av\.?|travessa|trav\.|tv\.?|praca|pca\.|pc\.|alameda|al\.|rodovia|rod\.|estrada|estr\.|largo|beco|viela|ladeira)"
_L = r"(?:[^\W\d_]|�)"
_W = rf"{_L}['’]?{_L}*(?:-{_L}+)*"
_TITLE = r"(?:(?:dr|dra|sr|sra|srta|prof|profa|enf|dom|dona|drs)\b\.?(?:\(a\))?\.?\s*)"
NAME_CUE = re.compile(
    r"(?:\b(?:paciente|pcte|pac\.|nome(?: completo| do paciente| da paciente| da mae| do pai)?|residente|assinado(?: eletronicamente)?(?: por)?|medic[oa](?: solicitante| responsavel| assistente)?|"
    r"responsavel|acompanhante|patologista|citotecnic[oa]|solicitante|requisitante|mae|pai|filh[oa]|espos[oa]|marido|irma|irmao|net[oa]|solicitad[oa] (?:por|pel[oa])|(?:a )?pedido d[eao]|retorno d[eao]|"
    r"orientacoes dadas a[o]?|encaminhad[oa] (?:por|pel[oa])|assinado|ciencia d[eao]|contato com|revisado por|liberado por|digitado por|coletado por)\s*[:\-]?\s+|\ba/c:?\s+|\b(?=(?:dr|dra|sr|sra|srta|prof|profa)\b\.?\s))"
    rf"({_TITLE}?)"
)
WEAK_CUE = re.compile(r"\s*(?:paciente|nome|mae|pai|medic[oa]|residente|responsavel|acompanhante|patologista|solicitante)\s+")
NAME_RUN = re.compile(rf"{_W}(?:(?:,\s?|\s+|(?<=\W{_L})\.\s?)(?:(?:de|da|do|das|dos|e)\s+)?{_W})*")
_AT = r"(?:@|\(\s*(?:arroba|at)\s*\)|\[\s*(?:arroba|at)\s*\]|\barroba\b)"
_DOT = r"(?:\.|\s+(?:ponto|dot)\s+|\s*[\[(](?:ponto|dot)[\])]\s*)"
LOCAL, HOST = re.compile(rf"[\w+%-]+(?:{_DOT}[\w+%-]+)*\s*\Z"), re.compile(rf"\s*[\w-]+(?:{_DOT}[\w-]+)*")
AT_SIGN, LETTERS = re.compile(_AT), re.compile(rf"{_L}+")
NUMBER = re.compile(r"(?<![\w.,/-])(?=(?:\D{0,3}\d){8})(?:\+\s?)?(?:\(\s?)?\d+(?:(?:xx|[ .\-/]|\)\s?)\d+)*(?:-?x\b)?(?![\w])")
ADDRESS = re.compile(rf"(?<![\w.-]){STREET}\s+{_W}(?:\s+{_W})*?(?:\s*,?\s*(?:n[o.�]?\.?\s*)?\d{{1,5}}\b|\s*,?\s*s/n\b|\s*,?\s*km\s*\d+)(?:\s*,?\s*(?:ap\.?|apto\.?|casa|bloco|bl\.?|sala)\s*\d+)?(?:\s*-\s*(?:vila|jardim|bairro|centro|parque)(?:\s+{_W})?|,\s*zona\s+{_W})?")
CUES = {
    "phone": re.compile(r"(?:tel(?:efone)?|fone|cel(?:ular)?|whats\s?app|zap|ligac(?:ao|oes)|ligar|contato|recado|avisar|familia|ramal)\b[^\d\n;]{0,14}$"),
    "identity_number": re.compile(r"(?:\bc\.?\s?p\.?\s?f\b|\brg|\br\.g\b|\bcns|\bc\.n\.s\b|\bsus|identidade|cartao nacional de saude|documento|cic)\b[^\d\n;]{0,8}$"),
    "none": re.compile(r"(?:protocolo|registrad[oa]|exame|laudo|bloco|lamina|frasco|medindo|pedido|requisicao|lote|cnpj|processo|convenio|guia)\b[^\d;\n]{0,14}$"),
    "email": re.compile(r"(?:e-?mail|contato|resultado para|correio|escrever para|<)[:\s]*$"),
    "street_address": re.compile(r"(?:mora (?:em|na|no)|resid\w* (?:em|na|no|a)|entregar (?:em|na|no)|endereco:?|\bend\.:?|domicili\w* (?:em|na))\s*$"),
}
NUM_SHAPES = {
    "identity_number": re.compile(r"\(?(?:\d{3}[. ]\d{3}[. ]\d{3}[- /]\d{2}|\d{9}[-/]\d{2}|\d{2}\.\d{3}\.\d{3}-?[\dx]|\d{2} \d{3} \d{3}(?: \d)?|\d{7,9}-[\dx]|\d{3}[. ]?\d{4}[. ]?\d{4}[. ]?\d{4})\)?"),
    "phone": re.compile(r"(?:\+?55\s?)?(?:0xx\s?|0)?\(?\d{2}\)?[ .]?9?[ .]?\d{4,5}[ .-]?\d{4}|\+\d{12,13}"),
}
TAX_FORMAT = re.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{9}[-/]\d{2}|\d{2}\.\d{3}\.\d{3}-[\dx]|\d{3}\.\d{4}\.\d{4}\.\d{4}")
AFTER_NAME = re.compile(r"\s*(?:\(mae\)|\(pai\)|\(filh|em sessao|em \d+ (?:dias|meses|semanas)|no dia|na alta|ciente|refere|, (?:por|encaminhad|amostra|em|de \d)|encaminhad|por telefone|[.;\-]|$|\n|\|)")
ORG = re.compile(r"(?:hospital|clinica|laboratorio|instituto|maternidade|santa casa|unidade|posto|escola|universidade|fundacao|vila|rua|avenida|praca|travessa|alameda|rodovia|coronel|marechal|professora?|santa|santo|sao|nossa senhora)\s+(?:d[aeo]s?\s+)?$")
NO_PERSON = re.compile(r"(?:dados|identificacao|historia|queixa|ficha|prontuario|estado) d[oa] (?:paciente|pcte)\s+$")
EPONYM = re.compile(r"(?:escore|escala|classificacao|sistema|metodo|coloracao|criterios?|sindrome|doenca|esofago|teste|grau|indice|categoria)\s+d[aeo]s?\s+$")

_FOLD = {}
for _c in range(0x20, 0x250):
    _d = unicodedata.normalize("NFKD", chr(_c))[:1].lower()
    if _c > 0x7E and len(_d) == 1 and _d.isalnum():
        _FOLD[_c] = _d
    elif len(chr(_c).lower()) == 1:
        _FOLD[_c] = chr(_c).lower()
_SLOW = re.compile("[^\x00-\x7f" + "".join(chr(c) for c in range(0xA1,
            0x180) if c != 0xAD) + "–—•≥≤…“”‘’�αβκμ]|&(?:[a-zA-Z]{2,8}|#\\d{2,5});")
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{2,5});")


def is_given(word: str) -> bool:
    """In the gazetteer of given names; a lost letter fits any."""
    if "�" not in word:
        return word in GIVEN
    p = re.compile(word.replace("�", "."))
    return len(word) > 3 and any(p.fullmatch(g) for g in GIVEN)


@lru_cache(maxsize=65_536)
def _folded_char(c: str) -> str:
    """Plain letters of one character, without case and accent; none for an invisible one or a separate accent."""
    s = "".join(LOOKALIKES.get(x, x) for x in plain(c))
    if len(s) == 1 and unicodedata.combining(s):
        return ""
    fold = lambda x: _FOLD.get(ord(x)) or unicodedata.normalize("NFKD", x)[:1].lower() or x
    return "".join(f if len(f := fold(x)) == 1 else x for x in s)


class Aligned:
    """A folded view of a text (plain letters, no case, accents, entities or invisible characters) with offsets."""

    __slots__ = ("text", "folded", "at")

    def __init__(self, text: str, restorer: Restorer | None):
        self.text = text
        swap = None
        if restorer is not None and ODD.search(text):
            swap, _ = restorer.swap_of(text)
        if swap is None and not _SLOW.search(text):
            self.folded, self.at = text.translate(_FOLD), None
            return
        marks = {m.start(): (html.unescape(m[0]), len(m[0])) for m in _ENTITY.finditer(text)}
        if swap is not None:
            cipher = restorer.ciphers[swap]
            for m in re.finditer(r"\S*[^\x00-\x7f]\S*", text):
                if restorer._word(m[0], swap) != m[0]:
                    marks |= {m.start() + x.start(): (cipher.table[x[0]], len(x[0])) for x in cipher.symbols.finditer(m[0])}
        out, at, i = [], [], 0
        for k in [*sorted(marks), len(text)]:
            if k < i:
                continue  # inside the symbol before
            for c in text[i:k]:
                f = _folded_char(c)
                out.append(f)
                at += [i] * len(f)
                i += 1
            if k < len(text):
                s, n = marks[k]
                f = "".join(map(_folded_char, s))
                out.append(f)
                at += [i] * len(f)
                i += n
        self.folded, self.at = "".join(out), [*at, len(text)]

    def start(self, i: int) -> int:
        return i if self.at is None else self.at[i]

    def end(self, i: int) -> int:
        return i if self.at is None else self.at[i - 1] + 1 if i else 0

    def raw(self, i: int, j: int) -> str:
        return self.text[self.start(i) : self.end(j)]


def name_span(a: Aligned, i: int) -> int | None:
    """End of the name that begins at folded offset i, or None."""
    m = NAME_RUN.match(a.folded, i)
    if not m:
        return None
    s, end, words, comma, short = m[0], None, 0, False, False
    for w in re.finditer(_W, s):
        gap = s[(end or 0) : w.start()] if end is not None else ""
        raw = a.raw(i + w.start(), i + w.end())
        word = w[0]
        if word in PARTICLES and words:
            continue
        before, short = short, len(word) == 1 and raw.isupper() and s[w.end() : w.end() + 1] == "."  # an initial
        named = is_given(word) or raw[:1].isupper()
        if word in NO_NAME or (len(word) < 2 and not short):  # a name neither begins with such a word nor holds it
            break
        if words and ("," in gap):
            # 'Surname, Given' goes on over a comma; a new clause doesn't
            if comma or words > 2 or not is_given(word):
                break
            comma = True
        if words and not named and not (words < 4 and a.raw(i, i + 1).islower() and not AFTER_NAME.match(a.folded, i + end)):
            break
        if words and not before and raw.isupper() and AFTER_NAME.match(a.folded, i + end) and not is_given(word):
            break
        end = w.end()
        words += 1
        if not short and AFTER_NAME.match(a.folded, i + end) and not a.folded.startswith(",", i + end):
            break
    return None if end is None else i + end


def emails(t: str) -> list[tuple[int, int]]:
    """Spans of e-mail addresses, searched around each sign only."""
    out, end = [], 0
    for m in AT_SIGN.finditer(t):
        if m.start() < end:
            continue
        lo = max(end, m.start() - 200)
        left, right = LOCAL.search(t[lo : m.start()]), HOST.match(t, m.end())
        if left and right:
            if not left.start() and lo > end:  # a longer one
                left, lo = LOCAL.search(t[end : m.start()]), end
            out.append((lo + left.start(), end := right.end()))
    return out


def candidates(a: Aligned) -> list[tuple[str, int, int, dict, str, str]]:
    """(type, start, end, votes, left, right) of the candidate spans of a text, in folded offsets."""
    t, out, taken = a.folded, [], []

    def free(i, j):
        return all(j <= x or i >= y for x, y in taken)

    for i, j in emails(t):
        left, host = t[max(0, i - 24) : i], AT_SIGN.split(t[i:j])[-1]
        votes = {
            "shape": "email" if re.search(r"[a-z]", host) and re.search(_DOT, host) else "none",
            "gaz": "email" if GIVEN & set(re.split(r"[\W_\d]+", t[i:j])) or any(t.startswith(g,
                    i) for g in GIVEN if len(g) > 3) else None,
            "ctx": "email" if CUES["email"].search(left) else "none" if re.search(r"(?:leitura|aumento|objetiva)\s*$",
                t[max(0, i - 12) : i + 8].split("@")[0]) else None,
        }
        out.append(("email", i, j, votes, left, t[j : j + 16]))
        taken.append((i, j))
    for m in ADDRESS.finditer(t):
        i, j = m.span()
        if not free(i, j):
            continue
        left, body = t[max(0, i - 24) : i], m[0]
        named = a.raw(*_after_type(a, i, j))
        votes = {
            "shape": "street_address" if re.search(r",\s*(?:n\S*\s*)?\d|s/n|km|n[o.]\s*\d", body) else None,
            "use": "none" if re.search(r"coleta|interna|sutura|fratura|acesso", body) else None,
            "gaz": "street_address" if named[:1].isupper() else None,
            "ctx": "street_address" if CUES["street_address"].search(left) else None,
            "tail": "street_address" if re.match(r"\s*(?:[,;-]\s*(?:vila|ap|casa|bloco|bairro|zona|centro|jardim|sala|conj)|ate sexta)",
                t[j : j + 24]) else None,
        }
        out.append(("address", i, j, votes, left, t[j : j + 16]))
        taken.append((i, j))
    for m in NUMBER.finditer(t):
        i, j = m.span()
        digits = re.sub(r"\D", "", m[0])
        if len(digits) < 8 or not free(i, j):
            continue
        if t[i] == "(" and ")" not in t[i:j]:
            i += 1  # a bracket around a number isn't part of it; one around an area code is
            while t[i] == " ":
                i += 1
        body, left = t[i:j].rstrip(" ("), t[max(0, i - 30) : i]
        # eleven bare digits are a tax number as well as a phone, four and four also a protocol
        shape = [k for k, p in NUM_SHAPES.items() if p.fullmatch(body)] if not (body.isdigit() and len(body) == 11) else []
        cue = [k for k in ("phone", "identity_number", "none") if CUES[k].search(left)]
        votes = {
            "shape": shape[0] if len(shape) == 1 else None,
            "ctx": cue[0] if cue else None,
            "length": "identity_number" if len(digits) == 15 else "none" if len(digits) in (12,
                13) and not body.startswith("+") and "x" not in body else None,
            "mark": "identity_number" if TAX_FORMAT.fullmatch(body) else "phone" if re.match(r"\+|\(\d\d\)|0xx",
                body) else "none" if re.search(r" x ", body) else None,
        }
        out.append(("number", i, i + len(body), votes, left, t[j : j + 16]))
        taken.append((i, j))
    starts = {}
    for m in NAME_CUE.finditer(t):
        i = m.end()
        starts.setdefault(i, m[0])
    for m in LETTERS.finditer(t) if LOST in t or not GIVEN.isdisjoint(LETTERS.findall(t)) else ():
        if m[0] in GIVEN or (LOST in m[0] and is_given(m[0])):
            starts.setdefault(m.start(), "")
    done = -1
    for i in sorted(starts):
        if i < done or i >= len(t) or not free(i, i + 1):
            continue
        j = name_span(a, i)
        if j is None or not free(i, j):
            continue
        words = [w for w in re.findall(_W, t[i:j]) if w not in PARTICLES]
        left, raw = t[max(0, i - 26) : i], a.raw(i, j)
        if not words or (not starts[i] and re.search(r"[\w@._-]$", left)):  # inside a word or an address
            continue
        given = sum(map(is_given, words))
        votes = {
            "cue": "name" if starts[i] and not WEAK_CUE.fullmatch(starts[i]) else None,
            "gaz": "name" if given else None,
            "shape": "name" if 2 <= len(words) <= 5 and all(x[:1].isupper() for x in re.findall(_W,
                    raw) if x.lower() not in PARTICLES) else "none" if not given and raw.islower() else None,
            "after": "name" if AFTER_NAME.match(t, j) else None,
            "org": "none" if ORG.search(left) else None,
            "eponym": "none" if EPONYM.search(left) or NO_PERSON.search(left) else None,
            "form": "none" if not given and re.search(r"(?:[ai]d[oa]s?|mente|cao|coes)$", words[0]) else None,
        }
        out.append(("name", i, j, votes, left, t[j : j + 16]))
        done = j
    return out


def _after_type(a: Aligned, i: int, j: int) -> tuple[int, int]:
    m = re.compile(rf"{STREET}\s+(?:d[aeo]s?\s+)?").match(a.folded, i)
    k = m.end() if m else i
    return k, min(k + 1, j)


CLASSES = {"name": ["none", "name"], "email": ["none", "email"], "address": ["none", "street_address"],
    "number": ["none", "phone", "identity_number"]}


def features(kind: str, body: str, left: str, right: str) -> list[str]:
    """Hashed features of a span: its neighbours and its shape."""
    lw, rw = re.findall(r"\w+|[^\w\s]", left)[-2:], re.findall(r"\w+|[^\w\s]", right)[:1]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"\d", "9", body))[:24]
    raw = [("l", lw[-1] if lw else ""), ("ll", " ".join(lw)), ("r", rw[0] if rw else ""),
        ("s", shape if kind != "name" else str(min(5, shape.count(" "))))]
    return [f"{k}{zlib.crc32(v.encode()) % BUCKETS}" for k, v in raw]


SPANS = "pilot_id long, type string, start_pos int, end_pos int, votes string, feats array<string>"


def spans(reports: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Candidate spans of every report, with votes and features, in offsets of the stored text."""
    shared = reports.sparkSession.sparkContext.broadcast(counts)

    def find(batches):
        restorer = Restorer(swap_tables(), CharModel(shared.value))
        for b in batches:
            rows = []
            for pid, text in zip(b.pilot_id, b.laudo):
                if not text:
                    continue
                a = Aligned(text, restorer)
                for kind, i, j, votes, left, right in candidates(a):
                    v = ",".join(f"{k}={x}" for k, x in sorted(votes.items()) if x)
                    rows.append((pid, kind, a.start(i), a.end(j), v, features(kind, a.folded[i:j], left, right)))
            yield pd.DataFrame(rows, columns=["pilot_id", "type", "start_pos", "end_pos", "votes", "feats"])

    return reports.select("pilot_id", "laudo").mapInPandas(find, SPANS)


def reliabilities(patterns: list, rounds: int = ROUNDS) -> dict[tuple[str, str], dict[str, float]]:
    """Posterior class of each vote pattern, by expectation-maximisation over labeler confusion tables.

    patterns: rows of type, votes and n. To abstain is an outcome too, with a share of its own per class. With
    rounds = 0 only the assumed reliabilities count.
    """
    by = defaultdict(list)
    for r in patterns:
        by[r["type"]].append((r["votes"], r["n"]))
    out = {}
    for kind, rows in by.items():
        classes = CLASSES[kind]
        k = len(classes)
        votes = [dict(x.split("=") for x in v.split(",") if x) for v, _ in rows]
        n = np.array([c for _, c in rows], float)
        labelers = sorted({x for v in votes for x in v})
        cast = np.array([[classes.index(v[x]) if x in v else k for x in labelers] for v in votes]).reshape(len(rows),
            len(labelers))
        assumed, kinds = [], np.arange(k + 1)
        for x in labelers:
            r = RELIABLE.get(x, 0.8)
            t = np.full((k, k), (1 - r) / (k - 1))
            np.fill_diagonal(t, r)
            assumed.append(t)

        def posterior(prior, tables):
            log = np.tile(np.log(prior), (len(rows), 1))
            for i, t in enumerate(tables):
                log += np.log(t).T[cast[:, i]]
            p = np.exp(log - log.max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)

        # start: assumed reliabilities, abstentions say nothing; few votes lean to none
        p = posterior(np.array([0.55] + [0.45 / (k - 1)] * (k - 1)), [np.c_[t, np.ones(k)] for t in assumed])
        cases = [(cast[:, [i]] == kinds).T @ n for i in range(len(labelers))]  # cases of each outcome
        for _ in range(rounds):
            w = n[:, None] * p
            tables = []
            for i, a in enumerate(assumed):
                voted, silent = cases[i][:k].sum(), cases[i][k]
                t = np.c_[max(4.0, ASSUMED * voted) * a, np.full(k, ASSUMED * silent + 1)]
                t += ((cast[:, [i]] == kinds).T.astype(float) @ w).T
                tables.append(t / t.sum(1, keepdims=True))
            p = posterior((w.sum(0) + 1) / (w.sum() + k), tables)
        out |= {(kind, v): dict(zip(classes, map(float, row))) for (v, _), row in zip(rows, p)}
    return out


class SpanClassifier:
    """Naive Bayes over hashed context and shape, trained on soft labels; the votes' posterior is its tempered prior."""

    def __init__(self, posterior: dict, sums: list):
        self.posterior = posterior
        by, slot = defaultdict(float), defaultdict(float)
        for r in sums:
            by[(r["type"], r["feat"], r["cls"])] += r["w"]
            slot[(r["type"], r["feat"].rstrip("0123456789"), r["cls"])] += r["w"]
        self.by, self.slot = dict(by), dict(slot)
        self.prior = {k: {c: PRIOR_WEIGHT * math.log(x + 1e-9) for c, x in p.items()} for k, p in posterior.items()}
        self.cache: dict = {}

    def weights(self, kind: str, feat: str) -> dict[str, float]:
        w = self.cache.get((kind, feat))
        if w is None:
            slot = feat.rstrip("0123456789")
            w = {c: math.log((self.by.get((kind, feat, c), 0.0) + 0.5) / (self.slot.get((kind, slot, c),
                        0.0) + 25)) for c in CLASSES[kind]}
            self.cache[(kind, feat)] = w  # at most types x slots x buckets
        return w

    def predict(self, kind: str, votes: str, feats: list[str]) -> str:
        score = dict(self.prior.get((kind, votes)) or dict.fromkeys(CLASSES[kind], 0.0))
        for f in feats:
            for c, w in self.weights(kind, f).items():
                score[c] += w
        return max(score, key=score.get)


def classified(cand: DataFrame) -> DataFrame:
    """Candidate spans (type, votes, feats and any other columns) with their `kind`, none included."""
    spark = cand.sparkSession
    posterior = reliabilities(cand.groupBy("type",
            "votes").agg(F.count("*").alias("n")).collect())  # bounded by the vote patterns
    shared = spark.sparkContext.broadcast(posterior)

    def soft(batches):
        total: Counter = Counter()
        for b in batches:
            for kind, votes, feats in zip(b.type, b.votes, b.feats):
                for c, w in shared.value[(kind, votes)].items():
                    for f in feats:
                        total[(kind, f, c)] += w
        yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=["type", "feat", "cls", "w"])

    sums = cand.mapInPandas(soft, "type string, feat string, cls string, w double").groupBy("type", "feat",
        "cls").agg(F.sum("w").alias("w"))
    model = spark.sparkContext.broadcast(SpanClassifier(posterior, sums.collect()))  # at most types x slots x buckets x classes
    schema = T.StructType([*cand.schema, T.StructField("kind", T.StringType())])

    def classify(batches):
        for b in batches:
            yield b.assign(kind=[model.value.predict(k, v, list(f)) for k, v, f in zip(b.type, b.votes, b.feats)])

    return cand.mapInPandas(classify, schema)


def found_items(reports: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(pilot_id, kind, start_pos, end_pos) of the personal items of every report.

    Offsets count code points of the stored text. NULL and empty reports give no rows, placeholders
    are no items, a repeated report gives its items under each of its ids, texts are read whole.
    """
    items = classified(reliable(spans(reports, counts))).where("kind <> 'none'")
    return items.select("pilot_id", "kind", F.col("start_pos").cast("long").alias("start_pos"),
        F.col("end_pos").cast("long").alias("end_pos"))


def redacted(reports: DataFrame, items: DataFrame) -> DataFrame:
    """Reports with every item replaced by the placeholder of its type, all else as stored."""
    per = items.groupBy("pilot_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos",
                "kind"))).alias("items"))  # the items of one report

    def replace(batches):
        for b in batches:
            out = []
            for text, its in zip(b.laudo, b["items"]):
                if text and its is not None:
                    parts, at = [], 0
                    for x in its:
                        if x["start_pos"] >= at:
                            parts += [text[at : x["start_pos"]], PLACEHOLDER[x["kind"]]]
                            at = x["end_pos"]
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pd.DataFrame({"pilot_id": b.pilot_id, "redacted": out,
                    "n_items": [0 if i is None else len(i) for i in b["items"]]})

    return reports.select("pilot_id", "laudo").join(per, "pilot_id", "left").mapInPandas(replace,
        "pilot_id long, redacted string, n_items int")
