"""Garbled text from wrong character encoding: code-page swaps as substitution ciphers.

A swap (text encoded in one code page, decoded in another) replaces every letter beyond ASCII by a
symbol of one or more characters. Sources are the rows that read best under one known swap, and the rows
that no known swap explains, by the script of their symbols. Per source the symbol-to-letter mapping is
learned by expectation-maximisation: each symbol stands for one letter, whose probability follows from
the bigrams of clean text with the neighbours of all its occurrences; neighbours that are symbols
themselves count by their present probabilities, until these settle. No letter is given to two symbols.
A code page is a prior of fixed weight that fades with the counts; a source without one is learned from
the bigrams alone. The mapping is applied with str.translate (symbols of one character) after replacing
the longer ones, word by word, so that rows garbled in places keep their sound parts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.llm.charlm import CharModel
from lauda.llm.chars import LOOKALIKES, plain, simple_form
from lauda.session import reliable

# The letters and signs beyond ASCII of ordinary texts in Portuguese, Spanish and English.
LETTERS = "áàâãäçéèêëíìîïóòôõöúùûüñÁÀÂÃÄÇÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑºª°µ±²³·–—•…“”‘’«»§®©×¿¡½¼¾≥≤αβγδκλμ"
ENCODED = ("utf-8", "cp1252", "cp850", "mac_roman", "cp1250")
DECODED = (
    "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "cp850", "cp437", "cp852", "cp858",
    "cp860", "cp865", "cp866", "koi8_r", "mac_roman", "mac_latin2",
    "iso8859-2", "iso8859-4", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-15",
)
#: Least gain in log probability of a restored word, and share of a restored lost letter.
GAIN, SURE = 3.0, 0.9
#: In a row whose swap is known, an odd word is restored unless it reads worse by more than this.
KEEP = -3.0
#: Log odds of a code page's reading before any count.
PRIOR = 12.0
ROUNDS = 12
#: Log probability of a trigram that ordinary words don't have.
RARE = -6.9
#: A source without a code page is learned from so many occurrences of so many symbols at least, and a
#: symbol of it from so many, if its letter leads by so much in log probability.
LEAST, LEAST_SYMBOLS, SEEN, LEAD = 30, 4, 3, 2.0
#: Words of a row that a swap without a code page must explain: one odd word is no sign of one.
WORDS = 3
LOST = "�"
#: Java class of characters that don't stand in ordinary text: candidates of garbling.
SUSPECT = (
    r"(?=[?\x{80}-\x{10FFFF}])(?:"  # passes plain characters by
    r"[\x{FFFD}\x{0080}-\x{009F}\x{2500}-\x{25A1}\x{2200}-\x{2263}\x{2266}-\x{22FF}\x{0100}-\x{02FF}\x{2018}-\x{201F}\x{2020}-\x{2021}\x{2026}\x{2030}-\x{2122}\x{2190}-\x{21FF}\x{25CA}\x{F8FF}\x{03A9}\x{03C0}]"
    r"|[\x{00A1}-\x{00BF}&&[^ªºµ±\x{00AD}]]|[ÄÅÆÈËÌÎÏÐÑÒÖ×ØÙÛÜÝÞßäåæèëìîïðñòöøùûüýþÿ÷]"
    r"|[ÃÂ][^A-Z\s\p{Punct}ÁÀÂÃÇÉÊÍÓÔÕÚ]|(?<=\p{Ll})[\x{00C0}-\x{00DE}]|(?<!\p{L})[ÕÂÊÔÃÇ]\p{Ll}|(?<=\p{L})\?\p{L}|Î[\x{00A0}-\x{00BF}]|\?-\p{L}|(?<=\s)[õûâêôãçñ](?=\s)|[\x{0400}-\x{04FF}]"
    r"|[\x{00C0}-\x{00DE}][\x{00DF}-\x{00FF}]|(?<=[A-Z])[\x{00C0}-\x{00DE}]\p{Ll}|Ã[AIU]|(?<!\p{L})Á[mM](?!\p{L}))"
)
# Spaces and invisible characters stand for themselves; alone they are no symbol of a swap.
NO_SYMBOL = frozenset("\xa0\xad")
#: A word that ordinary text doesn't have: only such words are read under a swap.
ODD = re.compile(
    r"[\ufffd\x80-\x9f\u2500-\u25a1\u2200-\u2263\u2266-\u22ff\u0100-\u02ff\u2018-\u201f\u2020-\u2021\u2026\u2030-\u2122\u2190-\u21ff\u25ca\uf8ff\u03a9\u03c0]"
    r"|[\xa1-\xa9\xab\xac\xae\xaf\xb2-\xb4\xb6-\xb9\xbb-\xbf]|[ÄÅÆÈËÌÎÏÐÑÒÖ×ØÙÛÜÝÞßäåæèëìîïðñòöøùûüýþÿ÷]"
    r"|[ÃÂ][^A-Z\s!-/:-@\[-`{-~ÁÀÂÃÇÉÊÍÓÔÕÚ\u200b-\u200f\u2060\ufeff]|[a-záàâãçéêíóôõú][À-Þ]|(?<![^\W\d_])[ÕÂÊÔÃÇ][a-zà-ÿ]|Î[\xa0-\xbf]|^[õûâêôãçñ]$|[\u0400-\u04ff]"
    r"|[À-Þ][ß-ÿ]|[A-Z][À-Þ][a-zß-ÿ]|Ã[AIU]|(?<![^\W\d_])Á[mM](?![^\W\d_])"
)
_TOKEN = re.compile(r"\S*[^\x00-\x7f]\S*|\S*\w\?\w\S*|\?-\w+")


def _decode(raw: bytes, page: str) -> str:
    """Decoding with control characters for undefined bytes, as common readers do."""
    return "".join(_char(b, page) for b in raw)


def _char(b: int, page: str) -> str:
    try:
        return bytes([b]).decode(page)
    except UnicodeDecodeError:
        return chr(b)


def swap_tables() -> dict[str, dict[str, str]]:
    """Name of a swap -> garbled symbol -> letter, from the code pages; twice-garbled UTF-8 too."""
    out = {}
    for enc in ENCODED:
        for dec in DECODED:
            if enc == dec or (enc != "utf-8" and enc not in ("cp1252", "mac_roman", "cp850")):
                continue
            t = {}
            for c in LETTERS:
                try:
                    g = _decode(c.encode(enc), dec)
                except UnicodeEncodeError:
                    continue
                if g != c and g not in NO_SYMBOL:
                    t.setdefault(g, c)
            if t not in out.values():  # pages that agree on these letters are one swap
                out[f"{enc}>{dec}"] = t
    for dec in ("cp1252", "latin-1"):
        t = {}
        for c in LETTERS:
            g = _decode(_decode(c.encode(), dec).encode(), dec)
            t.setdefault(g, c)
        out[f"utf-8>{dec}>utf-8>{dec}"] = t
    return out


class Cipher:
    """One learned mapping: longer symbols by one alternation, single characters by translate()."""

    def __init__(self, table: dict[str, str]):
        long = sorted((g for g in table if len(g) > 1), key=len, reverse=True)
        self.table = table
        self.long = re.compile("|".join(map(re.escape, long))) if long else None
        self.short = str.maketrans({g: c for g, c in table.items() if len(g) == 1})
        self.symbols = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))) or r"(?!)")

    def apply(self, s: str) -> str:
        if self.long is not None:
            if not self.short:
                return self.long.sub(lambda m: self.table[m[0]], s)
            return "".join(p if i % 2 else p.translate(self.short) for i, p in enumerate(self._cut(s)))
        return s.translate(self.short)

    def _cut(self, s: str):
        at = 0
        for m in self.long.finditer(s):
            yield s[at : m.start()]
            yield self.table[m[0]]
            at = m.end()
        yield s[at:]


def plain_readings(token: str) -> tuple[str, str]:
    """A word with all look-alikes plain, and with those that aren't Greek (α-actin keeps its name)."""
    t = simple_form(token)
    return "".join(LOOKALIKES.get(c, c) for c in t), "".join(c if "Ͱ" <= c <= "Ͽ" else LOOKALIKES.get(c, c) for c in t)


class Restorer:
    """Chooses the swap of a row and restores it word by word."""

    def __init__(self, tables: dict[str, dict[str, str]], lm: CharModel):
        self.ciphers = {k: Cipher(t) for k, t in tables.items()}
        self.lm = lm
        self.cache: dict = {}

    def gains(self, token: str) -> dict[str, tuple[float, str]]:
        """Swap -> (gain in log probability, restored word), of swaps that change an odd word."""
        g = self.cache.get(token)
        if g is None:
            g = {}
            if ODD.search(token):
                # a word that reads well once look-alikes and invisible characters are plain isn't garbled
                base = max(self.lm.word(token), *map(self.lm.word, plain_readings(token)))
                for k, c in self.ciphers.items():
                    w = c.apply(token)
                    if w != token:
                        g[k] = (self.lm.word(w) - base, w)
            if len(self.cache) < 200_000:
                self.cache[token] = g
        return g

    def swap_of(self, text: str) -> tuple[str | None, float]:
        total, words = Counter(), Counter()
        for t in _TOKEN.findall(text):
            for k, (gain, _) in self.gains(t).items():
                if gain > GAIN:
                    total[k] += gain
                    words[k] += 1
        for k in [k for k, n in words.items() if k.startswith("?") and n < WORDS]:
            del total[k]
        return max(total.items(), key=lambda x: (x[1], x[0])) if total else (None, 0.0)

    def lost_letters(self, left: str, n: int, right: str) -> str | None:
        """The n letters (up to two) between two neighbours if they are sure."""
        if n > 2:
            return None
        case = "any" if left[1] == " " else "upper" if right[0].isupper() or (left[1].isupper() and not right[0].islower()) else "lower"
        at = ("".join(map(self.lm.key, left)), n, "".join(map(self.lm.key, right)), case)
        if at in self.cache:
            return self.cache[at]
        letters = {"any": LOWER + UPPER, "upper": UPPER, "lower": LOWER}[case]
        tri, p = self.lm.trigram, {}
        for word in letters if n == 1 else (a + b for a in letters for b in letters):
            s = at[0] + word + at[2]
            p[word] = math.exp(sum(tri(*s[i : i + 3]) for i in range(len(s) - 2)))
        c = max(p, key=p.get)
        self.cache[at] = c if p[c] >= SURE * sum(p.values()) else None
        return self.cache[at]

    def restore(self, text: str) -> tuple[str, str | None, int]:
        """(text, swap, number of characters that stay lost)."""
        swap, gain = self.swap_of(text)
        if swap is not None:
            text = _TOKEN.sub(lambda m: self._word(m[0], swap), text)
        lost = 0
        if LOST in text or _Q.search(text):
            out, at = [], 0
            for m in _Q2.finditer(text):
                out.append(text[at : m.start()])
                c = self.lost_letters(("  " + "".join(out))[-2:], len(m[0]), (text[m.end() : m.end() + 2] + "  ")[:2])
                lost += 0 if c else len(m[0])
                out.append(c or m[0])
                at = m.end()
            text = "".join(out) + text[at:]
            swap = swap or "lost"
        return text, swap, lost

    def _word(self, token: str, swap: str) -> str:
        gain, w = self.gains(token).get(swap, (0, token))
        return w if gain > KEEP else token


_Q = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])|(?<!\S)\?(?=-[^\W\d_])")
_Q2 = re.compile(LOST + "+|" + _Q.pattern)
LOWER, UPPER = "áàâãçéêíóôõúµ±º–αβκ", "ÁÀÂÃÇÉÊÍÓÔÕÚ"


def sound(texts: DataFrame, column: str) -> DataFrame:
    """Rows without any candidate of garbling: the clean text that language models are counted on."""
    return texts.where(~F.coalesce(F.col(column).rlike(SUSPECT), F.lit(False)))


def candidates(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a character or a sequence that ordinary text doesn't have (a JVM filter)."""
    return texts.where(F.col(column).rlike(SUSPECT)).select(key, column)


SYMBOLS = "source string, symbol string, side string, other string, n long"
#: Marks a neighbour that is a symbol itself.
_SYM = "\x1f"
_RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=4096)
def _led(leads: str) -> re.Pattern:
    """Symbols of UTF-8 under a page: two characters after a known lead, else three."""
    c = re.escape(leads)
    return re.compile(rf"[{c}][^\x00-\x7f]|(?![{c}])[^\x00-\x7f]{{3}}")


def unknown_source(words: list[str]) -> tuple[str, re.Pattern] | None:
    """(name, pattern of its symbols) of the source of garbled words that no known swap explains.

    The name is the width of its symbols and their script. Symbols are pairs (or triples after another
    lead) where the runs beyond ASCII have a few leads and many second characters, as UTF-8 does; else
    single characters. Ordinary letters alone aren't symbols of an unknown swap.
    """
    runs = [r for w in words for r in _RUN.findall(w)]
    script = Counter(unicodedata.name(c, "CONTROL").split()[0] for r in runs for c in r if c not in LETTERS and plain(c).strip())
    if not script:
        return None
    name, even = max(script, key=lambda k: (script[k], k)), [r for r in runs if len(r) % 2 == 0]
    leads, seconds = {c for r in even for c in r[::2]}, {c for r in even for c in r[1::2]}
    if leads and len(leads) <= 3 and len(seconds) >= max(3, 2 * len(leads)):
        p = _led("".join(sorted(leads)))
        if all(sum(map(len, p.findall(r))) == len(r) for r in runs):
            return f"?2:{name}", p
    return f"?1:{name}", _ONE


def reads_well(word: str, lm: CharModel) -> bool:
    """No trigram of the word is rarer than one in a thousand."""
    w = "  ".join(("", "".join(map(lm.key, word)), ""))[1:-1]
    return all(lm.trigram(*w[i : i + 3]) > RARE for i in range(len(w) - 2))


def _sourced(r: Restorer, text: str):
    """(source, its words, pattern of its symbols) of a row, or None."""
    swap, _ = r.swap_of(text)
    odd = [t for t in _TOKEN.findall(text) if ODD.search(t) and LOST not in t and _RUN.search(t)]
    known = [t for t in odd if swap is not None and r.gains(t).get(swap, (0, t))[0] > GAIN]
    if swap is not None and 2 * len(known) >= len(odd):
        return swap, known, r.ciphers[swap].symbols
    rest = [t for t in odd if not any(reads_well(w, r.lm) for w in plain_readings(t))]
    source = unknown_source(rest)
    return source and (source[0], rest, source[1])


_ONE = re.compile(r"[^\x00-\x7f]")


def symbol_contexts(rows: DataFrame, column: str, counts: dict[int, int], tables: dict) -> DataFrame:
    """How often each symbol of each source stands beside which neighbour (what the E step needs).

    side l: `other` is the character before the symbol; side r: the character after it, or the symbol
    after it, marked. Bounded by sources x symbols x neighbours, whatever the number of rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast((counts, tables))

    def count(batches):
        c, t = shared.value
        r, n = Restorer(t, CharModel(c)), Counter()
        for b in batches:
            for text in b[column]:
                got = _sourced(r, text)
                for tok in got[1] if got else ():
                    tok = f" {tok} "
                    ms = list(got[2].finditer(tok))
                    for i, m in enumerate(ms):
                        if not i or ms[i - 1].end() != m.start():
                            n[(got[0], m[0], "l", tok[m.start() - 1])] += 1
                        joins = i + 1 < len(ms) and ms[i + 1].start() == m.end()
                        n[(got[0], m[0], "r", _SYM + ms[i + 1][0] if joins else tok[m.end()])] += 1
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["source", "symbol", "side", "other", "n"])

    return rows.select(column).mapInPandas(count, SYMBOLS).groupBy("source", "symbol", "side", "other").agg(F.sum("n").alias("n"))


def _assign(score: np.ndarray) -> np.ndarray:
    """A letter for each symbol, none twice: by the lead of the best first, then exchanges while they gain."""
    n, k = score.shape
    out, free = np.full(n, -1), np.ones(k, bool)
    for s in np.argsort(np.sort(score, axis=1)[:, -2] - score.max(axis=1), kind="stable"):
        if free.any():
            out[s] = int(np.where(free, score[s], -np.inf).argmax())
            free[out[s]] = False
    has = np.flatnonzero(out >= 0)
    for _ in range(10 * n):
        own = score[has, out[has]]
        cross = score[np.ix_(has, out[has])]
        swap = cross + cross.T - own[:, None] - own[None]
        move = np.where(free[None], score[has], -np.inf) - own[:, None]
        if max(swap.max(initial=0), move.max(initial=0)) <= 1e-9:
            break
        if swap.max(initial=0) >= move.max(initial=0):
            a, b = np.unravel_index(swap.argmax(), swap.shape)
            out[has[a]], out[has[b]] = out[has[b]], out[has[a]]
        else:
            a, b = np.unravel_index(move.argmax(), move.shape)
            free[out[has[a]]], free[b] = True, False
            out[has[a]] = b
    return out


def learn(contexts: list, tables: dict[str, dict[str, str]], lm: CharModel, rounds: int = ROUNDS) -> dict[str, dict[str, str]]:
    """Symbol -> letter of every source, by expectation-maximisation against the bigrams.

    Starts from the code page, or for an unknown source from the letters' frequencies; rounds = 0 leaves
    it there. Unknown sources with too few symbols are left out, so are their unsure symbols.
    """
    seen = defaultdict(list)
    for r in contexts:
        seen[r["source"]].append(r)
    letters = list(LETTERS)
    into = lambda x: np.array([lm.bigram(lm.key(x), c) for c in letters])
    out_of = lambda x: np.array([lm.bigram(c, lm.key(x)) for c in letters])
    between = np.array([[lm.bigram(a, b) for b in letters] for a in letters])
    frequent = np.log([lm.p1(c) for c in letters])
    out = dict(tables)
    for source, rows in seen.items():
        table = tables.get(source)
        symbols = sorted(set(table or ()) | {r["symbol"] for r in rows if table is None or r["symbol"] in table})
        if table is None:
            symbols = [x for x in symbols if not set(x) <= set(LETTERS) and all(plain(c).strip() for c in x)]
        at = {x: i for i, x in enumerate(symbols)}
        start, fixed = np.zeros((len(symbols), len(letters))), np.zeros((len(symbols), len(letters)))
        pairs, count = np.zeros((len(symbols), len(symbols))), np.zeros(len(symbols))
        if table is None:
            start += frequent
        else:
            for x, c in table.items():
                start[at[x], letters.index(c)] = PRIOR
        cols: dict = {}
        for r in rows:
            i, other = at.get(r["symbol"]), r["other"]
            if i is None:
                continue
            count[i] += r["n"] if r["side"] == "r" else 0
            if other.startswith(_SYM):
                if other[1:] in at:
                    pairs[i, at[other[1:]]] += r["n"]
                continue
            col = cols.get((r["side"], other))
            if col is None:
                col = cols[(r["side"], other)] = into(other) if r["side"] == "l" else out_of(other)
            fixed[i] += r["n"] * col
        if table is None and (count.sum() < LEAST or (count > 0).sum() < LEAST_SYMBOLS):
            continue
        score = start if rounds == 0 else start + fixed
        for k in range(rounds):
            heat = max(1.0, 2.0 ** (4 - k))  # cools down, so that early guesses don't settle their neighbours
            q = np.exp((score - score.max(axis=1, keepdims=True)) / heat)
            q /= q.sum(axis=1, keepdims=True)
            score = start + fixed + pairs @ (q @ between.T) + pairs.T @ (q @ between)
        letter = _assign(score)
        if table is not None:
            out[source] = {x: letters[letter[i]] if letter[i] >= 0 else table[x] for x, i in at.items()}
            continue
        rest = score.copy()
        got = {}
        for x, i in at.items():
            if letter[i] < 0 or count[i] < SEEN:
                continue
            rest[i, letter[i]] = -np.inf
            rest[i, [a for s, a in enumerate(letter) if s != i and a >= 0 and count[s] > count[i]]] = -np.inf
            if score[i, letter[i]] - rest[i].max() >= LEAD or rounds == 0:
                got[x] = letters[letter[i]]
        if got:
            out[source] = got
    return out


RESTORED = "restored string, swap string, lost int"


def restored_texts(texts: DataFrame, key: str, column: str, counts: dict[int, int], tables: dict | None = None,
    rounds: int = ROUNDS) -> DataFrame:
    """(key, restored, swap, lost) of every row with garbled text.

    swap names the swap of the row ('?...' for one that was learned without a code page), or 'lost' where
    only lost characters tell; lost counts the
    characters whose letter isn't sure any more and stays as it is. NULL, empty and sound texts give
    no row; whole texts are read; repeated rows each give their row.
    """
    rows = reliable(candidates(texts, key, column))
    tables = swap_tables() if tables is None else tables
    # contexts: at most sources x symbols x neighbours
    tables = learn(symbol_contexts(rows, column, counts, tables).collect(), tables, CharModel(counts), rounds)
    shared = texts.sparkSession.sparkContext.broadcast((counts, tables))

    def apply(batches):
        c, t = shared.value
        r = Restorer(t, CharModel(c))
        for b in batches:
            out = []
            for k, text in zip(b[key], b[column]):
                fixed, swap, lost = r.restore(text)
                if swap is not None or _C1.search(text):
                    out.append((k, fixed, swap or "control", lost))
            yield pd.DataFrame(out, columns=[key, "restored", "swap", "lost"])

    return rows.mapInPandas(apply, f"{key} long, {RESTORED}")


_C1 = re.compile("[\x80-\x84\x86-\x9f]")
