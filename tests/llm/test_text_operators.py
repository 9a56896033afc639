"""Text operators against brute force, round trips and small fixtures with awkward rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lauda.llm import encodings as X
from lauda.llm import leakage as L
from lauda.llm import pii
from lauda.llm import reading as R
from lauda.llm import tokenizer as K
from lauda.llm import vocabulary as V
from lauda.llm.charlm import CharModel, collect_model, count_trigrams
from lauda.llm.chars import simple_form
from lauda.llm.lookalikes import consistent_form, needs_search, with_consistent_form

BASE = (
    "INDICAÇÃO: Controle após procedimento anterior há 8 meses. MICROSCOPIA: Imunomarcação para β-catenina preservada em margem profunda. Relação núcleo-citoplasma conservada em células metaplásicas. "
    "Controle interno adequado; cadeia κ com padrão habitual. Observam-se histiócitos e leucócitos em fundo limpo. CONCLUSÃO: Pólipo séssil em flexura hepática, ressecado com alça fria. A lesão mede 4 mm. "
    "COMENTÁRIOS: A amostra seguiu a rotina do Hospital São Tibério. O índice é médio. Não há sinais de lesão. Categoria III do sistema Bethesda."
)


@pytest.fixture(scope="module")
def counts(spark):
    df = spark.createDataFrame([(BASE,)] * 40 + [(BASE.upper(),)] * 8 + [(None,), ("",)], "text string")
    return collect_model(count_trigrams(df, "text"))


@pytest.fixture(scope="module")
def lm(counts):
    return CharModel(counts)


# --- look-alike characters


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ｂｏｓｔｏｎ ９．", "Boston 9."), ("lesão", "lesão"), ("resse﻿cado bi­o​psia", "ressecado biopsia"),
        ("em fundo　limpo", "em fundo limpo"), ("ﬂexura ﬁna", "flexura fina"), ("Ⅲ", "III"),
        ("4 µm ± 1 º ª ≥ – •\r\n&atilde;", "4 µm ± 1 º ª ≥ – •\r\n&atilde;"), ("antibiótico", "antibiótico"),
        ("FAMІ́LIA", "FAMÍLIA"), ("", ""),
    ],
)
def test_simple_form(text, want):
    assert simple_form(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("cоnѕеrvаdа em mаrgеm", "conservada em margem"), ("Categoria ΙΙΙ do sistema", "Categoria III do sistema"),
        ("para β-catenina preservada", "para β-catenina preservada"), ("cadeia κ com padrão", "cadeia κ com padrão"),
        ("seguiυ a rotina", "seguiu a rotina"), ("Сontrole interno", "Controle interno"),
    ],
)
def test_lattice_search(lm, text, want):
    assert consistent_form(text, lm) == want


def test_forms_of_rows(spark, counts):
    rows = [(1, None, 9), (2, "", 9), (3, BASE, 9), (4, "em fundo limpo " * 5000, 9), (5, "α-actina", 9), (6, "em fundo", 9),
        (6, "em fundo", 9)]
    df = spark.createDataFrame(rows, "id long, text string, form long")
    got = sorted((r["id"], r["stands_in"]) for r in with_consistent_form(df, "id", "text", counts).collect())
    assert [x for x in got if x[1]] == [(4, True), (6, True), (6, True)]
    assert with_consistent_form(spark.createDataFrame([], "id long, text string"), "id", "text", counts).count() == 0


# --- wrong encodings


def garble(s, enc, dec):
    return X._decode(s.encode(enc, "replace"), dec)


@pytest.mark.parametrize("enc, dec",
    [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "cp1250"), ("cp1252", "cp850"),
        ("cp1252", "mac_roman")])
def test_swaps_are_found_and_reversed(lm, enc, dec):
    r = X.Restorer(X.swap_tables(), lm)
    text = BASE.replace("β-", "").replace("κ ", "")
    fixed, swap, lost = r.restore(garble(text, enc, dec))
    assert swap is not None and lost == 0
    assert sum(a != b for a, b in zip(fixed.split(), text.split())) <= 1


def test_restored_rows(spark, counts):
    part = BASE[:200] + garble(BASE[200:], "cp1252", "cp850")
    lost = BASE.encode("latin-1", "replace").decode("utf-8", "replace")
    rows = [(1, BASE), (2, part), (3, garble(garble(BASE, "utf-8", "cp1252"), "utf-8", "cp1252")), (4, lost), (5, None),
        (6, ""), (7, BASE.upper()), (8, "so­und text ​"), (9, part)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "pilot_id long, laudo string, restored string")
    got = {r["pilot_id"]: r for r in X.restored_texts(df, "pilot_id", "laudo", counts).collect()}
    assert set(got) == {2, 3, 4, 9}
    assert got[3]["restored"] == BASE and "Não há sinais" in got[4]["restored"] and got[2]["restored"] == got[9]["restored"]
    assert X.restored_texts(df.where("false"), "pilot_id", "laudo", counts).count() == 0


def contexts(source, symbol, beside):
    return [{"source": source, "symbol": symbol, "side": side, "other": x, "n": n} for n, left, right in beside for side,
        x in (("l", left), ("r", right)) if x]


def test_letters_of_one_source_differ(spark):
    """Between spaces a dash is likelier than a Greek letter; it has a symbol of its own, so the page's reading stands."""
    df = spark.createDataFrame([("alto – baixo – medio –",)] * 60 + [("cadeia κ normal",)] * 30, "text string")
    lm, page = CharModel(collect_model(count_trigrams(df, "text"))), X.swap_tables()["utf-8>cp1252"]
    for n in (5, 60, 5000):
        ctx = contexts("utf-8>cp1252", "Îº", [(n, " ", " ")]) + contexts("utf-8>cp1252", "â€“", [(3 * n, " ", " ")])
        got = X.learn(ctx, {"utf-8>cp1252": page}, lm)["utf-8>cp1252"]
        assert (got["Îº"], got["â€“"]) == ("κ", "–") and len(set(got.values())) == len(got)


def test_a_code_page_fades(lm):
    """Neighbours overrule a wrong page where they are many, not where they are few."""
    for n, want in ((0, "κ"), (300, "ã")):
        assert X.learn(contexts("s", "¤", [(n, "n", "o"), (n, "s", "o")]), {"s": {"¤": "κ"}}, lm)["s"]["¤"] == want


@pytest.mark.parametrize("enc, dec, out",
    [("cp1252", "cp1251", ("cp1251",)), ("cp1252", "iso8859-13", ("iso8859-13", "cp1257")), ("utf-8", "cp866", ("cp866",))])
def test_swaps_without_a_code_page_are_learned(spark, enc, dec, out):
    """Pages held out of the list: nine in ten garbled words come back, and only with expectation-maximisation."""
    reports = X.sound(spark.read.parquet("/root/testdata/sf0.01/run_pilot.parquet").where("laudo <> ''").select("pilot_id",
            "laudo"),
        "laudo")
    counts = collect_model(count_trigrams(reports, "laudo"))
    before = {r["pilot_id"]: r["laudo"] for r in reports.orderBy("pilot_id").limit(300).collect()}
    bad = {i: garble(t, enc, dec) for i, t in before.items() if "?" not in t.encode(enc, "replace").decode(enc)}
    held = {k: t for k, t in X.swap_tables().items() if not any(p in k for p in out)}
    df = spark.createDataFrame(list(bad.items()), "pilot_id long, laudo string")
    share = []
    for rounds in (X.ROUNDS, 0):
        after = {r["pilot_id"]: r["restored"] for r in X.restored_texts(df, "pilot_id", "laudo", counts, held, rounds).collect()}
        words = [(w, x) for i, t in bad.items() for w, g,
            x in zip(before[i].split(" "), t.split(" "), after.get(i, t).split(" ")) if w != g]
        share.append(sum(w == x for w, x in words) / len(words))
    assert share[0] >= 0.9 and share[1] < 0.2


def test_every_stand_in_meets_the_filter(spark):
    odd = [(chr(i),) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and simple_form(chr(i)) != chr(i)]
    df = spark.createDataFrame(odd, "c string")
    assert df.where(~needs_search("c")).collect() == []


# --- personal items


def items_of(text):
    a = pii.Aligned(text, None)
    return [(k, a.raw(i, j)) for k, i, j, *_ in pii.candidates(a)]


def test_candidates_and_offsets():
    text = "Pcte Lúcia de Gravajão, encaminhada. e-mail: lucia ponto grava (arroba) posto7 ponto example; Tel.: (11)9 6355 4106. Mora em Tv. Sete Moinhos, 699 - Vila Serena. CPF nº 101 052 775 57, RG 84649254-X SSP."
    got = items_of(text)
    assert ("name", "Lúcia de Gravajão") in got and ("email", "lucia ponto grava (arroba) posto7 ponto example") in got
    assert ("number", "(11)9 6355 4106") in got and ("number", "101 052 775 57") in got and ("address",
        "Tv. Sete Moinhos, 699 - Vila Serena") in got
    dirty = "Ｐａｃｉｅｎｔｅ: l⁠úcia felgu&atilde;o."
    (kind, span), *_ = items_of(dirty)
    assert (kind, span) == ("name", "l⁠úcia felgu&atilde;o")


def test_found_and_redacted(spark, counts):
    names = ["Odete Mendramar", "GRAVAJÃO, BEATRIZ", "norberto de baldrorelo", "Ana Serrimar", "Raul"]
    rows, want = [], set()
    for i in range(60):
        n, parts = names[i % 5], []
        for lead, item, kind in (("Paciente: ", n, "name"), (". CPF ", f"1{i:02d}.204.300-{i:02d}", "identity_number"),
            (". Tel.: ", f"(11) 9{i:04d}-3344", "phone"), (". Mora em ", f"Rua das Palmeiras, {i + 10}", "street_address"),
            (". Contato ", f"beatriz{i}@posto.example", "email")):
            parts.append(lead)
            want.add((i, kind, len("".join(parts))))
            parts.append(item)
        rows.append((i,
                "".join(parts) + ". Frasco identificado como protocolo 4479-7733; rua de coleta interna 3. Exame registrado sob o nº 2024020794417; leitura @ 40x. Dados do paciente removidos: [NOME], [CPF]. Hospital Santa Beatriz.",
                "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, BASE, "x"), (103, BASE * 300, "x")]
    df = spark.createDataFrame(rows, "pilot_id long, laudo string, kind string")
    found = pii.found_items(df, counts)
    got = {(r["pilot_id"], r["kind"], r["start_pos"]) for r in found.collect()}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 3
    text = {r["pilot_id"]: r["redacted"] for r in pii.redacted(df, found).collect()}
    assert text[3].startswith("Paciente: [NAME]. CPF [ID]. Tel.: [PHONE]. Mora em [ADDRESS]. Contato [EMAIL].") and "protocolo 4479-7733" in text[3]
    assert text[100] is None and text[101] == "" and text[102] == BASE
    assert pii.found_items(df.where("false"), counts).count() == 0


def test_names_with_initials_long_streets_and_unknown_names():
    text = "Paciente: Ana P. Souza. Dr. J. Quaresmal no dia. Paciente: Zulmirene Varnhagel. Mora em Rua Doutor Professor Engenheiro Alves de Moura e Silva Neto Filho, 77. Medico responsavel: Ivo Trazibulo Menegolo Prado Quinto Sexto Setimo."
    got = items_of(text)
    for want in ("Ana P. Souza", "J. Quaresmal", "Zulmirene Varnhagel", "Ivo Trazibulo Menegolo Prado Quinto Sexto Setimo"):
        assert ("name", want) in got, (want, got)
    assert ("address", "Rua Doutor Professor Engenheiro Alves de Moura e Silva Neto Filho, 77") in got


def test_context_corrects_contradicting_labelers(spark):
    """Three labelers that vote at random outvote two sound ones; EM sees through it, the classifier even more."""
    rng, rows = random.Random(6), []
    for i in range(3000):
        true = rng.random() < 0.45
        votes = {k: true if rng.random() < p else not true for k,
            p in (("cue", 0.9), ("after", 0.9), ("gaz", 0.5), ("shape", 0.5), ("form", 0.5)) if rng.random() < 0.95}
        word = rng.choice(["paciente", "mae", "por"] if true else ["hospital", "escala",
                "indice"]) if rng.random() < 0.9 else "de"
        v = ",".join(f"{k}={'name' if x else 'none'}" for k, x in sorted(votes.items()))
        rows.append((i, "name", v, [f"l{hash_of(word)}", "ll1", "r1", "s1"], true))
    df = spark.createDataFrame(rows, "id long, type string, votes string, feats array<string>, is_name boolean")
    got = {r["id"]: r["kind"] == "name" for r in pii.classified(df).collect()}
    right = sum(got[r[0]] == r[4] for r in rows) / len(rows)
    majority = sum((r[2].count("=name") > r[2].count("=none")) == r[4] for r in rows) / len(rows)
    post = pii.reliabilities([{"type": "name", "votes": v, "n": n} for v, n in Counter(r[2] for r in rows).items()])
    em = sum((post[("name", r[2])]["name"] > 0.5) == r[4] for r in rows) / len(rows)
    assert right > em + 0.02 > majority + 0.05 and right > 0.95, (right, em, majority)


def hash_of(word):
    import zlib

    return zlib.crc32(word.encode()) % pii.BUCKETS


def test_labelers_against_an_item_are_votes(spark, counts):
    """A given name in an institution or a method is a candidate that the vote and the context reject."""
    rows = [(i,
            f"Paciente: Lucia Moreira Prado. Encaminhada pelo Hospital Maria Aparecida. {BASE}") for i in range(40)] + [(100 + i,
            f"Escore de Antonio Prado. Mae: Rosa Telmira Fontes. {BASE}") for i in range(40)]
    df = spark.createDataFrame(rows, "pilot_id long, laudo string")
    assert any("org=none" in ",".join(f"{k}={v}" for k, v in x[3].items()) for x in pii.candidates(pii.Aligned(rows[0][1], None)))
    got = {(r["pilot_id"] // 100, rows_text(rows, r)) for r in pii.found_items(df, counts).collect()}
    assert got == {(0, "Lucia Moreira Prado"), (1, "Rosa Telmira Fontes")}


def rows_text(rows, r):
    return dict(rows)[r["pilot_id"]][r["start_pos"] : r["end_pos"]]


# --- vocabulary


@pytest.mark.parametrize(
    "variable, value, want",
    [
        ("bethesda", "categroia II", "II"), ("bethesda", "VII", "(none)"), ("bethesda", "BETHESDA 0", "(none)"),
        ("re_status", "RE-", "negativo"), ("re_status", "RE+", "positivo"), ("re_status", "positivo/negativo", "(none)"),
        ("adequab", "isatisfatoria", "insatisfatoria"), ("her2_score", "+++/3+", "3+"), ("her2_score", "1+/2+", "(none)"),
        ("intervalo_controle", "7 anos", "(none)"), ("intervalo_controle", "24 meeses", "2_anos"),
        ("tipo_histologico", 'resultado: "Ca ducatl inv." (ver laudo)', "carcinoma_ductal_invasivo"),
        ("tipo_histologico", "carcinoma", "(none)"), ("margens", "não comprometidas", "livres"),
        ("resultado", "LSIL x HSIL", "(none)"), ("resultado", "???", "(none)"),
        ("segmento", "flexura hpáática", "flexura_hepatica"), ("segmento", "cólon", "(none)"),
    ],
)
def test_mapping(dictionary, variable, value, want):
    assert dictionary.lookup(variable, value) == want


@pytest.fixture(scope="module")
def ontology(spark):
    rows = [(v, "enum", c) for v, by in V.SYNONYMS.items() for c in by] + [("ki67", "integer", None)]
    rows += [(v, "enum", c) for v in ("re_status", "rp_status") for c in ("positivo", "negativo")] + [("her2_score", "enum",
            c) for c in ("0", "1+", "2+", "3+")]
    rows += [("intervalo_controle", "enum", c) for c in ("3_meses", "6_meses", "1_ano", "2_anos", "3_anos", "5_anos", "10_anos")]
    return spark.createDataFrame(rows, "variable string, onto_type string, canonical string")


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("bethesda", "AUS", "III"), ("bethesda", "AUS", "III"), ("bethesda", None, "I")],
        "variable string, alias string, canonical string")


@pytest.fixture(scope="module")
def dictionary(ontology, aliases):
    return V.Dictionary([tuple(r) for r in V.spellings(ontology, aliases).collect()], {})


def test_rows_and_the_join_way(spark, ontology, aliases):
    rows = [(1, "bethesda", "II"), (2, "bethesda", " II "), (3, "bethesda", None), (4, "bethesda", "  "), (5, "ki67", "30%"),
        (6, None, "x"), (7, "margens", "Livre"), (8, "margens", "Livre"), (9, "segmento", "z" * 500),
        (10, "segmento", "coolon_descendente"), (11, "re_status", "RP-")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "verdict_id long, variable string, value string, canonical string")
    want = {2: "II", 7: "livres", 8: "livres", 9: "(none)", 10: "colon_descendente", 11: "(none)"}
    assert {r[0]: r[1] for r in V.to_canonical(df, ontology, aliases).collect()} == want
    assert {r[0]: r[1] for r in V.to_canonical(df, ontology, aliases, max_spellings=3).collect()} == want
    assert V.to_canonical(df.where("false"), ontology, aliases).count() == 0
    assert V.to_canonical(df, ontology.where("false"), aliases).count() == 0


def test_frequency_decides_alike_on_both_ways(spark):
    """Two entries at one distance: the frequent one is meant; without a lead none is; an exact spelling of two entries is none."""
    entries = spark.createDataFrame([("v", "enum", c) for c in ("barato", "batato", "cinza", "tinza", "norte", "north")],
        "variable string, onto_type string, canonical string")
    alias = spark.createDataFrame([("v", "norta", "norte"), ("v", "norta", "north")],
        "variable string, alias string, canonical string")
    rows = [(i, "v", "barato") for i in range(1000)] + [(2001, "v", "bavato"), (2002, "v", "bazato"), (2003, "v", "rinza"),
        (2004, "v", "norta"), (2005, "v", "nort"), (2006, "v", "\u2003"), (2007, "v", "ba")]
    df = spark.createDataFrame(rows, "verdict_id long, variable string, value string")
    got = [{r[0]: r[1] for r in V.to_canonical(df, entries, alias, n).collect()} for n in (V.MAX_SPELLINGS, 2)]
    assert got[0] == got[1] and got[0][2001] == got[0][2002] == "barato" and got[0][2003] == got[0][2004] == V.NONE and 2006 not in got[0]


def test_join_way_equals_the_dictionary_on_the_tables(spark, tables):
    t = {n: spark.read.parquet(f"{tables.replace('0.001', '0.01')}/{n}.parquet") for n in ("cross_verdict", "ontology_spec",
            "policy_alias")}
    got = [sorted(map(tuple, V.to_canonical(*t.values(), n).collect())) for n in (V.MAX_SPELLINGS, 0)]
    assert got[0] == got[1] and len(got[0]) > 300


def test_deletions_meet_every_spelling_within_two_edits():
    rng, letters = random.Random(2), "abcd"
    words = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(60)]
    for a in words[:20]:
        for b in words:
            if V.distance(a, b)[0] <= 1:
                assert V.deletes(a) & V.deletes(b)


# --- token ids


def test_ids_equal_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = K.load_ranks(K.TOKENIZERS + "/byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    parts = ["'", "s", "ll", " ", "  ", "\n", "\t", " ", "á", "1", "²", "!", "…", "​", "日本", "x", "'VE", "\0", "\x1c",
        "<|endoftext|>", "é", "🏥", "　", "Ⅲ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", BASE,
        "a" * 30_000 + " " * 3000 + "é" * 2000]
    got = K.encode_batch(texts, K.Merger(ranks))
    assert [g[0] for g in got] == [enc.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(1, BASE, [7]), (2, "", [7]), (3, None, [7]), (3, None, [7])],
        "doc_id long, text string, ids array<int>")
    rows = {r["doc_id"]: r for r in K.encoded(df, offsets=True).collect()}
    assert rows[2]["ids"] == [] and rows[3]["ids"] == [] and rows[3]["offsets"] == [] and K.decode(rows[1]["ids"]) == BASE
    assert K.encoded(df).count() == 4 and K.encoded(df.where("false")).count() == 0
    assert rows[1]["offsets"] == sorted(rows[1]["offsets"]) and rows[1]["offsets"][0] == 0


def test_offsets_are_those_of_each_token():
    """Against the bytes of the tokens, laid one after the other over each text."""
    ranks = K.load_ranks(K.TOKENIZERS + "/byte_bpe_50k.tiktoken")
    back = {v: k for k, v in ranks.items()}
    rng = random.Random(8)
    texts = ["".join(rng.choice("aeé漢😀 \n'sdrvelT19ãçß—") for _ in range(rng.randrange(1,
                60))) for _ in range(300)] + ["don't I'll we've 's's ''re",
        "é" * 200, "\0'\0s", "'"]
    for t, (ids, offsets) in zip(texts, K.encode_batch(texts, K.Merger(ranks))):
        owner = [i for i, c in enumerate(t) for _ in c.encode()]
        at, want = 0, []
        for x in ids:
            want.append(owner[at])
            at += len(back[x])
        assert offsets == want and b"".join(back[x] for x in ids) == t.encode(), t


# --- leaked items


def leak_brute(docs, items):
    out = set()
    for d, t in docs:
        w = L.words(t)
        runs = {tuple(w[i : i + L.RUN]) for i in range(len(w) - L.RUN + 1)}
        out |= {(d, i) for i,
            x in items for j in [L.words(x)] if any(tuple(j[k : k + L.RUN]) in runs for k in range(len(j) - L.RUN + 1))}
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(25)] + ["Ação", "acao", "É"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 11, 12, 20, 60, 130])))) for i in range(30)] + [(90,
            None),
        (91, ""), (92, "um dois")]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 8, 40, 300]))]
        if d % 2:
            src = items[rng.randrange(30)][1].upper().split()
            a = rng.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.choice([11, 12, 15, 80])]
        docs.append((d, rng.choice([" ", ", ", "\n\n"]).join(w)))
    docs += [(500, None), (501, ""), (502, items[4][1]), (502, items[4][1])]
    dd = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    want = leak_brute(docs, items)
    assert len(want) > 12 and {tuple(r) for r in L.leaks(dd, ii).collect()} == want
    assert {tuple(r) for r in L.leaks(dd, ii, max_chars=0).collect()} == want
    assert {tuple(r) for r in L._by_join(dd, ii, hot=1).collect()} == want  # every window split
    assert L.leaks(dd.where("false"), ii).count() == 0 and L.leaks(dd, ii.where("false")).count() == 0


def test_signatures_of_equal_windows_are_equal():
    rng = random.Random(2)
    w = [f"w{rng.randrange(9)}" for _ in range(60)]
    h = L.WordHashes()(w)
    sig, s = L.signatures(h), L.grams(h, L.SHINGLE)
    assert sig.shape == (L.SIGNATURE,
        60 - L.RUN + 1) and all(sig[0, i] == s[i : i + L.RUN - L.SHINGLE + 1].min() for i in range(sig.shape[1]))
    alone = L.signatures(h[7 : 7 + L.RUN])
    assert (alone[:, 0] == sig[:, 7]).all() and all((L.keys(alone, r)[0] == L.keys(sig, r)[7]) for r in range(1, L.SIGNATURE + 1))
    assert [L.rows_of(L.size_class(n)) for n in (12, 23, 24, 48, 960)] == [1, 1, 2, 3, 3]


# --- reading level


def test_levels(spark):
    easy, hard = "O exame dura pouco. Beba água. Venha com alguém.", "A heterogeneidade interinstitucional observada após regra determinística sugere que determinantes epistemológicos condicionam parcialmente inferências contrafactuais subsequentes acerca da estabilidade"
    docs = [(i, easy if i % 2 else hard, "x") for i in range(200)] + [(900, None, "x"), (901, "", "x"), (902, "123 456", "x"),
        (903, easy * 3000, "x"), (903, easy * 3000, "x")]
    dd = spark.createDataFrame(docs, "doc_id long, text string, level string")
    ll = spark.createDataFrame([(i, 1 if i % 2 else 5, "x") for i in range(200)] + [(3, None, "x"), (77777, 3, "x")],
        "doc_id long, nivel int, text string")
    got = {r["doc_id"]: r for r in R.reading_levels(dd, ll).collect()}
    assert got[1]["level"] < 1.5 and got[2]["level"] > 4.5 and got[903]["level"] < 2.5
    assert got[900]["level"] is None and got[901]["n_words"] == 0 and got[902]["level"] is None
    bare = {r["doc_id"]: r["level"] for r in R.reading_levels(dd, ll.where("false")).collect()}
    assert bare[1] <= bare[2] and [i for i, x in bare.items() if x is None] == [900, 901, 902]
    for few in ("doc_id = 1", "doc_id < 4", "doc_id < 12"):  # one formula at any number of labels
        some = {r["doc_id"]: r["level"] for r in R.reading_levels(dd, ll.where(few)).collect()}
        assert [i for i, x in some.items() if x is None] == [900, 901, 902] and (few == "doc_id = 1" or some[1] < 2 < 4 < some[2])
    assert R.reading_levels(dd.where("false"), ll).count() == 0


def test_document_frequencies_equal_brute_force(spark):
    docs = ["O exame e o exame", "o médico de plantão", None, "", "the exam of the day", "O EXAME"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(r["language"], r["word"]): r["df"] for r in R.document_frequencies(df).collect()}
    assert got[("pt", "exame")] == 2 and got[("pt", "o")] == 3 and got[("en", "the")] == 1 and got[("pt", "medico")] == 1


def test_held_out_accuracy(spark, tables):
    """On the test tables the level follows the readers' on rows that weren't used to fit it."""
    d = tables.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_label.parquet").where("nivel IS NOT NULL")
    train = labels.where("doc_id % 3 <> 0")
    x = R.reading_levels(docs, train).join(labels.where("doc_id % 3 = 0"), "doc_id")
    mae = x.agg(F.avg(F.abs(F.col("level") - F.col("nivel")))).first()[0]
    assert mae < 0.9
