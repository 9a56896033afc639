"""Catalogue of detectors over normalised reports, declared as rules.

Fixed values: the patterns and their order are the extraction semantics and are stated plainly here.
"""

from __future__ import annotations

from lauda.functions.rules import Cascade, Extract, Mapped, MultiLabel, Number, Repaired, Rule

R = Rule
NEG = r"(?:nao (?:se )?(?:observ|evidenci|identific|visualiz|detect)\w*|ausencia de|ausentes?|sem|negativ[oa] para|livres? de)"

# Thyroid cytology
BETHESDA = Cascade("bethesda", tuple(
    [R(rf"categoria\s+{c.lower()}\b\s+(?:de\s+)?bethesda", c) for c in ("VI", "IV", "III", "II", "V", "I")]
    + [R(rf"bethesda\s+{c.lower()}\b", c) for c in ("VI", "IV", "III", "II", "V", "I")]
    + [R(rf"bethesda\s+{i}\b", c) for i, c in enumerate(("I", "II", "III", "IV", "V", "VI"), 1)]
    # our own, for phrasings that none of the above reads
    + [R(rf"categoria\s+{c.lower()}\b\s+do sistema\s+bethesda|bethesda\s+categoria\s+(?:{c.lower()}|{i})\b", c) for i,
        c in ((6, "VI"), (4, "IV"), (3, "III"), (2, "II"), (5, "V"), (1, "I"))]
), anchors=("bethesda",))
BETHESDA_DESC = Extract("bethesda_desc", r"bethesda\s*[-–]+\s*([a-z][a-z\s]+)", cut=r"\s*[(.,].*")
SUBTIPO = Cascade("subtipo", (
    R(r"n.dulo\s+hiperpl.sico|adenomat.ide", "nodulo_hiperplasico"), R(r"hashimoto|tireoidite\s+linfoc", "hashimoto"),
    R(r"(?:carcinoma\s+)?papil[ai]r|papilifero", "papilar"),
    R("medular", "medular"), R("hurthle|oncocit", "hurthle"), R("folicular", "folicular"),
))
# Cervical cytology
ADEQUAB = Cascade("adequab",
    (R(r"satisfat\w*,? (?:mas|porem) limitada", "satisfatoria_limitada"), R("insatisfat", "insatisfatoria"),
        R("satisfat", "satisfatoria")))
ZT = Cascade("zona_transformacao", (
    R(r"zona de transforma..o\s*:?\s*ausente", "ausente"),
    R(r"zona de transforma..o\s*:?\s*(?:presente|representad)", "presente"),
    R(r"componente endocervical.{0,30}presente", "presente"), R(r"componente endocervical.{0,30}ausente", "ausente"),
    R(r"epitelios\s+representados.{0,40}glandular", "presente"),
))
RESULTADO = Cascade("resultado", (
    R(r"carcinoma\s+escamo|carcinoma\s+epiderm", "carcinoma_escamoso"), R(r'\bais\b|adenocarcinoma\s*"?\s*in\s+situ', "AIS"),
    R("adenocarcinoma", "adenocarcinoma"),
    R(r"\bagc\b|celulas\s+glandulares\s+at.picas|atipias.{0,25}celulas\s+glandulares", "AGC"),
    R(r"\bhsil\b|les.o\s+intraepitelial.{0,20}alto\s+grau|intraepitelial\s+de\s+alto|\bnic\s+(?:ii|iii|2|3)\b|favorecendo.{0,20}alto\s+grau",
        "HSIL", unless="excluir|afastar"),
    R(r"\basc[\s-]h\b|excluir.{0,50}alto\s+grau|afastar.{0,50}alto\s+grau", "ASC_H"),
    R(r"\blsil\b|les.o.{0,40}baixo\s+grau|intraepitelial.{0,30}baixo\s+grau|intraepitelial.{0,30}grau\s+i\b|\bnic\s+i\b|\bnic\s*1\b",
        "LSIL"),
    R(r"\basc[\s-]us\b|escamosas\s+at.picas\s+de\s+significado|atipias.{0,25}escamosas.{0,25}significado\s+indeterminado",
        "ASC_US"),
    R(r"\bnilm\b|negativo\s+para\s+les.o", "NILM"),
    R(r"les.o.{0,40}alto\s+grau", "HSIL", unless="excluir|afastar|descartar"),
    # our own, for phrasings that none of the above reads
))
ORGANISMOS = MultiLabel("organismos", (
    R("lactobacil", "lactobacilos"), R(r"gardnerella|shift.{0,15}flora|vaginose", "gardnerella"),
    R(r"candida|fungo|levedura|hifa|pseudo-?hifa|organism.s\s+fung", "candida"), R("trichomonas|tricomonas", "trichomonas"),
    R("actinomyces", "actinomyces"), R(r"herpes|\bhsv\b", "herpes"),
))
HORMONAL = Cascade("hormonal",
    (R(r"atr.fico|hipotr.fico|padrao\s+atr.fico", "atrofico"), R("hipoestr", "hipoestrogenico"), R(r"tr.fico", "trofico")))
# Gastric
OLGA = Cascade("olga",
    tuple([R(r"olga\s*(?:0|zero)\b", "0")] + [R(rf"olga\s+(?:{c.lower()}(?:[^ivx]|$)|{i})", c) for i,
            c in ((4, "IV"), (3, "III"), (2, "II"), (1, "I"))]),
    anchors=("olga",))
HP = Cascade("hp", (
    R(r"(?:h\.?\s*pylori|helicobacter).{0,50}positiv[oa]", "positivo"),
    R(r"(?:h\.?\s*pylori|helicobacter).{0,50}negativ[oa]?", "negativo"),
    R(r"pesquisa\s+de\s+h\.?\s*pylori.{0,60}negativ[oa]", "negativo"),
    R(r"pesquisa\s+de\s+h\.?\s*pylori.{0,60}positiv[oa]", "positivo"),
    # our own, for phrasings that none of the above reads
    R(r"(?:ausencia|nao (?:se )?(?:observ|identific|detect)\w*).{0,40}(?:h\.?\s*pylori|helicobacter)|(?:h\.?\s*pylori|helicobacter(?:\s+pylori)?).{0,30}(?:ausente|nao\s+(?:identific|detect|observ))",
        "negativo"),
))
METODO_HP = Cascade("metodo_hp", (R("giemsa", "giemsa"), R(r"imuno[\s-]?histoqu", "ihq"), R("warthin", "warthin_starry")))
METAPLASIA = Cascade("metaplasia_intestinal", (
    R(r"metaplasia\s+intestinal:?\s*(?:leve|moderada|acentuada|presente|focal|completa|incompleta)", "sim"),
    R(r"(?:associada?\s+a|com)\s+(?:atrofia\s+e\s+)?metaplasia\s+intestinal", "sim"),
    R(r"metaplasia\s+intestinal.{0,19}(?:inexistente|ausente)\b", "nao"),
    R(r"metaplasia\s+intestinal", "sim", unless=r"sem|ausencia\s+de|inexistente|negativ", reach=30),
), default="nao")
ATROFIA = Cascade("atrofia", (
    R(r"atrofia:?\s*(?:leve|moderada|acentuada|presente)", "sim"), R(r"(?:associada?\s+a|com)\s+atrofia", "sim"),
    R(r"(?:gastrite|mucosa)\s+\w*\s*atrofica", "sim"),
), default="nao")
DISPLASIA = Cascade("displasia", (
    R(r"displasia\s+de\s+alto\s+grau|alto\s+grau\s*[^.]{0,20}displasia|displasia\s+acentuada", "alto_grau"),
    R(r"displasia\s+(?:de\s+)?baixo\s+grau|baixo\s+grau\s*[^.]{0,20}displasia|displasia\s+moderada|displasia\s+leve",
        "baixo_grau"),
    R(r"atipias\s+citoarquiteturais\s+(?:de\s+)?baixo\s+grau", "baixo_grau"),
    R(r"atipias\s+citoarquiteturais\s+(?:leves|moderadas)", "baixo_grau"),
    R(r"atipias\s+citoarquiteturais\s+(?:de\s+)?alto\s+grau", "alto_grau"),
    R(r"atipias\s+indefinidas\s+para\s+displasia", "baixo_grau"), R(r"negativ[oa]\s+para\s+displasia|sem\s+displasia", "ausente"),
), default="ausente")
ATIVIDADE = Cascade("atividade", (
    R(r"atividade\s+neutrofilica:?\s*(?:leve|moderada|acentuada)", "sim"),
    R(r"atividade\s+inflamatoria:?\s*(?:leve|moderada|acentuada)", "sim"),
    R(r"atividade\s+(?:neutrofilica|inflamatoria):?\s*(?:ausente|inexistente)", "nao"),
    R(r"infiltrado\s+neutrofilico:?\s*(?:leve|moderado|acentuado)", "sim"),
    R(r"infiltrado\s+neutrofilico:?\s*ausente", "nao"), R(r"gastrite.{0,60}aguda", "sim"),
    R(r"gastrite\s+cronica\s+(?:\w+\s+)?ativa\b", "sim"), R(r"\bativa\b", "sim"), R(r"\binativa\b", "nao"),
), default="nao")
POLIPOS_FUNDICOS = Cascade("polipos_fundicos",
    (R(r"p.lipos?\s+de\s+gl.ndulas?\s+f.ndicas?", "sim"), R(r"p.lipo\s+f.ndico", "sim"), R(r"p.lipos\s+f.ndicos", "sim")),
    default="nao")


def receptor(name: str, words: str) -> Cascade:
    return Cascade(name, (
        R(rf"(?:{words})(?:\s*\([^)]+\))?\s*:?\s*-?\s*(?:frac[oa]\s+|forte\s+)?positiv", "positivo"),
        R(rf"(?:{words})(?:\s*\([^)]+\))?\s*:?\s*-?\s*negativ", "negativo"),
        R(rf"(?:positividade|positiv[oa])\s+para\s+(?:{words})", "positivo"),
        R(rf"(?:negatividade|negativ[oa])\s+para\s+(?:{words})|triplo[\s-]negativ", "negativo"),
    ))


def receptor_pct(name: str, words: str) -> Number:
    pre = rf"(?:{words})(?:\s*\([^)]+\))?\s*:?\s*(?:frac[oa]\s+|forte\s+)?"
    return Number(name, (
        (pre + r"positiv[oa]\s+em\s+(\d{1,3})\s*%?\s*(?:a|e)\s*(\d{1,3})\s*%", "mid"),
        (pre + r"positiv[oa](?:,)?\s+(?:em\s+)?(?:cerca\s+de\s+|menos\s+de\s+|mais\s+de\s+)?[<>]?\s*(\d{1,3})\s*%", "one"),
        (pre + r"negativ[oa]", 0),
    ))


# Breast immunohistochemistry
RE_WORDS, RP_WORDS = r"\bre\b|receptor(?:es)?\s+(?:de\s+)?estrogen\w*", r"\brp\b|receptor(?:es)?\s+(?:de\s+)?progester\w*"
RE, RP = receptor("re", RE_WORDS), receptor("rp", RP_WORDS)
RE_PCT, RP_PCT = receptor_pct("re_pct", RE_WORDS), receptor_pct("rp_pct", RP_WORDS)
RE_ALLRED = Number("re_allred", ((rf"(?:{RE_WORDS}).{{0,80}}allred\s*:\s*(\d{{1,2}})", "one"),), 0, 8)
RP_ALLRED = Number("rp_allred", ((rf"(?:{RP_WORDS}).{{0,80}}allred\s*:\s*(\d{{1,2}})", "one"),), 0, 8)
HER2_SCORE = Cascade("her2_score",
    tuple(R(rf"her-?2.{{0,25}}?(?:escore|score)?\s*\(?{p}", lab) for p,
        lab in ((r"3\s*\+", "3+"), (r"2\s*\+", "2+"), (r"1\s*\+", "1+"), (r"0\s*\+", "0+"), (r"0\b", "0"))),
    anchors=("her",))
HER2_STATUS = Cascade("her2_status", (
    R(r"her-?2.{0,25}?3\s*\+", "positivo"), R(r"her-?2.{0,25}?2\s*\+", "equivoco"),
    R(r"her-?2.{0,25}?(?:[01]\s*\+|0\b)", "negativo"), R(r"her-?2.{0,15}positiv", "positivo"),
    R(r"her-?2.{0,15}negativ", "negativo"),
), anchors=("her",))
KI67 = Number("ki67_pct", (
    (r"ki[\s-]?67\s*/?\s*mib[\s-]?1\s*\([^)]+\)\s*:\s*positivo\s+em\s+(\d+)\s*%?\s*(?:a|e)\s*(\d+)\s*%", "mid"),
    (r"ki[\s-]?67\s*/?\s*mib[\s-]?1\s*\([^)]+\)\s*:\s*positivo\s+em\s+(\d+)\s*%", "one"),
    (r"ki[\s-]?67.{0,40}positiv[oa]\s+(?:em\s+)?(?:de\s+)?(\d+)\s*%?\s*(?:a|e|-)\s*(\d+)\s*%", "mid"),
    (r"ki[\s-]?67.{0,40}positiv[oa]\s+(?:em\s+)?(\d+)\s*%", "one"),
    (r"ki[\s-]?67[^:]{0,55}:\s*positiv[oa]\s+(?:em\s+)?(\d+)\s*%", "one"),
    (r"(?:indice\s+de\s+)?proliferac.o\s+celular\s+(?:ao\s+ki[\s-]?67\s+)?de\s+(?:(?:ate|cerca\s+de)\s+)?(\d+)\s*(?:a\s+(\d+)\s*)?%",
        "any"),
    (r"proliferac.o\s+celular\s+de\s+(?:(?:ate|cerca\s+de)\s+)?(\d+)\s*(?:a\s+(\d+)\s*)?%\s*ao\s+ki", "any"),
    (r"ao\s+ki[\s-]?67\s+de\s+(?:(?:ate|cerca\s+de)\s+)?(\d+)\s*(?:a\s+(\d+)\s*)?%", "any"),
    (r"ki[\s-]?67.{0,40}positiv[oa]\s+em\s+mais\s+(?:de|que)\s+(\d+)\s*%", "one"),
    (r"ki[\s-]?67.{0,40}positiv[oa]\s+em\s+menos\s+(?:de\s+)?(\d+)\s*%", "one"),
    (r"ki[\s-]?67.{0,40}positiv[oa]\s+(?:em\s+)?(?:(?:com\s+areas\s+)?de\s+)?ate\s+(\d+)\s*%", "one"),
    (r"ki[\s-]?67.{0,40}positiv[oa][\s,]+(?:em\s+)?cerca\s+de\s+(\d+)\s*%?\s*(?:a\s+(\d+)\s*%)?", "any"),
    (r"ki[\s-]?67[^:]{0,55}:\s*(?:reacao\s+)?positiv[oa]\s+(?:em\s+)?cerca\s+de\s+(\d+)\s*%?\s*(?:a\s+(\d+)\s*%)?", "any"),
    (r"ki[\s-]?67.{0,40}positiv[oa]\s+entre\s+(\d+)\s*%?\s*(?:e|a)\s*(\d+)\s*%", "mid"),
    (r"ki[\s-]?67.{0,40}positiv[oa]\s+em\s+<\s*(\d+)\s*%", "one"),
    (r"ki[\s-]?67.{0,60}variando\s+de\s+(\d+)\s*(?:%?\s*a\s*(\d+)\s*)?%", "any"),
    (r"ki[\s-]?67\s*\((\d+)\s*%\)", "one"),
    (r"(?:,\s*e?\s*)?ki[\s-]?67\s+de\s+(\d+)\s*%", "one"),
    (r"ki[\s-]?67\s*(?:\([^)]*\)\s*)?:\s*(\d+)\s*%", "one"),
    (r"ki[\s-]?67[^:]{0,55}:\s*positiv[oa]\s+em\s+(\d+)\s+das?\s+celulas", "one"),
    (r"(\d+)\s*(?:%?\s*a\s+(\d+)\s*)?%\s+ao\s+ki[\s-]?67", "any"),
    # our own, for phrasings that none of the above reads
    (r"ki-?\s?67.{0,40}?(\d{1,3})\s*%?\s*(?:a|e|-)\s*(\d{1,3})\s*%", "mid"), (r"ki-?\s?67.{0,40}?(\d{1,3})\s*%", "one"),
    (r"(\d{1,3})\s*%\s+(?:para|de)\s+ki-?\s?67", "one"),
))
# Breast anatomical pathology
# the worst margin counts; what stands behind another structure's heading belongs to that
_MARGINS, _ELSEWHERE = r"marg(?:ens?|em)\s+cirurgica[s]?\s*(?:\([^)]*\))?\s*:\s*.{0,115}?", r"linfon|mamilo|pele|areola|\d+\)|\d+\.\d+\)"
MARGENS = Cascade("margens", (
    R(_MARGINS + "(?:comprometid|infiltrad)", "comprometidas", without=_ELSEWHERE + r"|\bnao\b"),
    R(r"margem\s+\w+\s*:\s*comprometid\w*", "comprometidas"),
    R(r"marg\w*\s+(?:cirurgica[s]?\s+)?(?:\w+\s+){0,4}comprometid", "comprometidas", without=r"linfon|mamilo|pele|areola|\bnao\b"),
    R(r"compromete\w*\s+(?:as?\s+)?marg", "comprometidas"),
    R(r"marg.{0,120}?encontra[\s-]se\s+comprometid\w*", "comprometidas"),
    R(r"margens?.{0,40}(?:comprometid|acometid|positiv)", "comprometidas", unless=r"nao\s+\w{0,12}\s*$", without=_ELSEWHERE + r"|\bnao\b"),  # our own
    R(r"marg.{0,40}tangenciad", "exiguas"),
    R(_MARGINS + "(?:exigu|tangenciad)", "exiguas", without=_ELSEWHERE),
    R(r"margem\s+\w+\s*:\s*exigu\w*", "exiguas"),
    R(r"marg.{0,120}?encontra[\s-]se\s+exigu\w*", "exiguas"),
    R(r"margem\s+(?:cirurgica\s+)?mais\s+proxima", "exiguas", unless=r"livres?\s+(?:de\s+)?(?:comprometimento|neoplasi)", reach=80),
    R(r"marg.{0,120}?\bexigu\w*", "exiguas"),
    R(r"marge(?:m|ns)\s+(?:\w+\s+){0,2}(?:proxim|tangenc)", "exiguas", without=r"\bmais\b"),  # our own
    R(_MARGINS + "(?:livre|respeitad)", "livres", without=_ELSEWHERE),
    R(r"margem\s+\w+\s*:\s*livre", "livres"),
    R(r"marg.{0,120}?encontra[\s-]se\s+livres?", "livres"),
    R(r"margens?\s+(?:cirurgicas?\s+)?livres?\b", "livres"),
    R(r"margens?\b.{0,80}livres?", "livres"),
    R(r"margens?.{0,40}(?:negativ|nao comprometid)|em margem \w+, nao se observa comprometimento", "livres"),  # our own
), anchors=("marg",))
PROCEDIMENTO = Cascade("procedimento", (
    R(r"mastectomia\s+radical", "mastectomia_radical"), R("mastectomia", "mastectomia"), R("quadrantectomia", "quadrantectomia"),
    R(r"setorectomia|resseccao\s+segmentar|tumorectomia|nodulectomia|excisional", "excisional"), R("mamotomia", "mamotomia"),
    R(r"(?:biopsia|bx)\s+(?:por\s+)?agulha|core\s+biopsy", "biopsia_agulha"),
))
_GRADES, _SCALE = (("i", "1"), ("ii", "2"), ("iii", "3"), ("1", "1"), ("2", "2"), ("3", "3")), r"(?:nottingham|mbr|bloom\s+richardson|richardson)"
GRAU_NOTT = Mapped("grau_nott", (
    (r"novo\s+grau\s+histologico\s+final\s*:\s*grau\s+(i{1,3}|[1-3])\s+(?:de\s+)?" + _SCALE, _GRADES),
    (r"grau\s+(?:histologico\s*:\s*)?grau\s+(i{1,3}|[1-3])\s+(?:de\s+)?" + _SCALE, _GRADES),
    (r"grau\s+(i{1,3}|[1-3])\s+(?:de\s+)?" + _SCALE, _GRADES),
    (r"grau\s+(i{1,3}|[1-3])\s+mbr\b", _GRADES),
    (r"\d\s*\+\s*\d\s*\+\s*\d\s*=\s*(\d+)", (("3", "1"), ("4", "1"), ("5", "1"), ("6", "2"), ("7", "2"), ("8", "3"), ("9", "3"))),
    # our own, for phrasings that none of the above reads
    (r"(?:nottingham|grau histologico|grau combinado).{0,30}?(?:grau\s+)?\b(i{1,3}|[1-3])\b", _GRADES),
))
INV_LINFOV = Cascade("inv_linfov",
    (R(rf"{NEG}\s+(?:\w+\s+){{0,3}}inva(?:sao|soes)\s+(?:angio)?linf|invasao\s+(?:angio)?linf\w*\s*:?\s*(?:ausente|nao)", "nao"),
        R(r"invasao\s+(?:angio)?linf", "sim")),
    anchors=("inva",))
INV_PERIN = Cascade("inv_perin",
    (R(rf"{NEG}\s+(?:\w+\s+){{0,3}}invasao\s+perineural|invasao\s+perineural\s*:?\s*(?:ausente|nao)", "nao"),
        R(r"invasao\s+perineural", "sim")),
    anchors=("perineural",))
NECROSE = Cascade("necrose", (R(r"(?:sem|ausencia de) necrose|necrose\s*:?\s*(?:ausente|nao)", "nao"), R("necrose", "sim")),
    anchors=("necrose",))
MULTIFOCAL = Cascade("multifocalidade",
    (R(r"unifocal|(?:sem|ausencia de) multifocal", "nao"), R("multifocal|multicentric", "sim")),
    anchors=("focal", "multicentric"))
MICROCALC = Cascade("microcalcificacoes",
    (R(r"(?:sem|ausencia de) (?:micro)?calcificac", "nao"), R("microcalcificac", "sim")), anchors=("calcificac",))
EXTRANODAL = Cascade("extensao_extranodal",
    (R(r"(?:sem|ausencia de) (?:extensao|extravasamento) (?:extra|capsular)", "nao"),
        R(r"(?:extensao|extravasamento) (?:extranodal|extracapsular|capsular)", "sim")),
    anchors=("extensao", "extravasamento"))
PELE = Cascade("pele",
    (R(r"(?:comprometimento|infiltracao) da pele|pele (?:comprometida|infiltrada)", "sim"), R(r"pele (?:livre|sem|nao)", "nao")),
    anchors=("pele",))
REF_IHQ = Cascade("ref_ihq", (R(r"imuno-?histoquim|imunomarcac|ihq\b", "sim"),), default="nao")
_STAGED, _NODES = r"(?:estadiamento[^:]*:\s*(?:y?pt\S+\s*;?\s*)?)", r"(y?pn(?:[0-3])(?:[a-c])?(?:\s*\([^)]*\))?|y?pnx)"
PT = Repaired("pT", ((r"(?:estadiamento[^:]*:\s*)?(y?pt(?:is|[0-4])(?:mi|[a-d])?(?:\([^)]*\))?)", "^x^", ""),))
# a letter o for the digit, and a missing p within the line of the stage, are mended
PN = Repaired("pN", (
    (_STAGED + _NODES, "^x^", ""), (r"\b" + _NODES, "^x^", ""), (r"\b(y?pno(?:\s*\([^)]*\))?)", r"^(y?pn)o\s*", r"\10 "), (_STAGED + r"(y?n[0-3x])(?:[a-c])?(?:\s*\([^)]*\))?", r"^(y?)n", r"\1pn"),
))
# Endoscopy
BBPS = Number("bbps", ((r"(?:boston|bbps)\b[^.]{0,30}?[\s:=(-]0?(\d)\b", "one"), (r"\b(\d)\s*/\s*9\b", "one")), 0, 9)
LA_GRAU = Cascade("la_grau", tuple(
    [R(r"(?:sem|ausencia de)\s+(?:sinais\s+de\s+)?esofagite|esofagite\s+nao[-\s]?erosiva|esofago\s+(?:de\s+aspecto\s+)?normal",
            "sem_esofagite")]
    + [R(rf"grau\s*{c}\b.{{0,12}}los\s+angeles|los\s+angeles\s*[-,:]?\s*(?:grau\s*)?{c}\b", c.upper()) for c in "dcba"]
), anchors=("esofag", "angeles"))
HERNIA = Cascade("hernia_hiatal", (
    R(rf"{NEG}\s+(?:\w+\s+){{0,3}}hernia", "nao"),
    R(r"hernia\s+(?:hiatal|de\s+hiato|para(?:esofagica|diafragmatica))|\bhh\b", "sim", unless=r"antecedente|historia|controle"),
    R(r"pincamento.{0,30}(?:coincidente|ao nivel)|(?:coincidente|ao nivel).{0,12}pincamento", "nao"),
), default="nao_mencionada")
POLIPO = Cascade("polipo_presente", (
    R(r"\bpolip(?:o|os|oide|oides)\b", "sim", unless=r"sem\b|ausencia|nao\s+\w+|nenhum|historia|controle|antecedente|educativa"),
    R(r"\blesao\s+(?:plana|deprimida)|espraiamento\s+lateral|\bmucosectomia\b|\bemr\b", "sim"),
), default="nao")
INTERVALO = Cascade("followup_interval", tuple(
    R(rf"(?:recomenda|sugere|indica|novo exame|controle|retorno|repetir)[^.]{{0,60}}?\b{p}", lab)
    for p,
    lab in ((r"(?:3|tres)\s+meses", "3_meses"), (r"(?:6|seis)\s+meses", "6_meses"),
        (r"(?:12\s+meses|1\s+ano|um\s+ano)", "1_ano"), (r"(?:24\s+meses|2\s+anos|dois\s+anos)", "2_anos"),
        (r"(?:36\s+meses|3\s+anos|tres\s+anos)", "3_anos"), (r"(?:60\s+meses|5\s+anos|cinco\s+anos)", "5_anos"),
        (r"(?:10|dez)\s+anos", "10_anos"), (r"\d{1,2}\s+meses", "outro_meses"))
), default="nao_recomendado")

# Breast: histological type and further structured fields
_LOBULAR = r"carcinoma\s+(?:mamario\s+)?lobular\s+(?:invasivo|infiltrante)"
_DUCTAL = r"carcinoma\s+(?:mamario\s+)?(?:ductal\s+)?(?:invasivo|infiltrante)\s+(?:da\s+mama|em\s+mama|de\s+mama|do\s+tipo\s+nao)|tipo\s+nao\s+especial"
_IN_SITU = r'carcinoma\s+ductal\s*"?in\s*situ"?|\bcdis\b|carcinoma\s+intraductal|carcinoma\s+intraducto\b|carcinoma\s*"?in\s*situ"?'
_INVADES = "invasiv|infiltrant|microinvasiv|microinvasao"
_DENIED = rf"(?:ausencia\s+de|sem\s+|nao\s+(?:ha|foram?\s+(?:identificad|evidenciad|observad))).{{0,36}}?(?:{_INVADES})"
TIPO_HIST = Cascade("tipo_hist", (
    R(r"carcinoma\s+metaplasico", "metaplasico"),
    R(_LOBULAR, "misto", also=_DUCTAL),
    R(_LOBULAR, "CLI"),
    R(r"carcinoma\s+papilar\s+(?:encapsulado\s+)?invasiv", "papilar"),
    R(r"(?:carcinoma\s+)?micropapilar\s+invasiv", "micropapilar"),
    R(r"tipo\s+(?:carcinoma\s+)?micropapilar", "micropapilar"),
    R(r"(?:padrao|componente)\s+micropapilar", "micropapilar", also="carcinoma|neoplasia"),
    R(r"carcinoma\s+mucinos[oa]", "mucinoso"),
    R(r"diferenciacao\s+mucinos[oa]", "mucinoso", unless=r"areas\s+de|parcial"),
    R(r"tipo\s+mucinos[oa]", "mucinoso"),
    R(r"padrao\s+misto\s+(?:tipo\s+)?ductal\s+e\s+lobular", "misto"),
    R(r"carcinoma\s+(?:invasivo|mamario).{0,30}misto", "misto"),
    R(r"carcinoma\s+tubular", "tubular"),
    R(r"carcinoma\s+medular", "medular"),
    R(r"carcinoma\s+(?:ductal\s+)?microinvasiv", "CDI_SOE"),
    R(r"carcinoma\s+ductal\s+(?:invasivo|infiltrante)", "CDI_SOE"),
    R(r"carcinoma\s+(?:mamario\s+)?(?:invasivo|infiltrante)\s+(?:da\s+mama|em\s+mama|de\s+mama)", "CDI_SOE"),
    R(r"carcinoma\s+(?:mamario\s+)?invasivo[^,]*tipo\s+nao\s+especial", "CDI_SOE"),
    R(r"tipo\s+nao\s+especial", "CDI_SOE"),
    R(r"carcinoma\s+mamario\s+(?:ductal\s+)?invasiv", "CDI_SOE"),
    R(r"carcinoma\s+mamario\s+ductal\s+infiltrant", "CDI_SOE"),
    R(r"cdi[^s]", "CDI_SOE"),
    R(_IN_SITU, "CDIS", absent=_INVADES, ignoring=_DENIED),
    R(_IN_SITU, "CDI_SOE"),
    R(r'carcinoma\s+lobular\s*"?in\s*situ"?|clis', "CLIS", absent=_INVADES, ignoring=_DENIED),
    R(r"carcinoma\s+(?:de\s+ductos\s+mamarios\s+)?metastatico", "CDI_SOE"),
    R(r"carcinoma\s+(?:invasiv|infiltrant)", "CDI_SOE"),
    R("adenocarcinoma", "outro_maligno"),
    R(r"tumor\s+(?:phyllodes|filodes)", "outro_benigno"),
    R("lipoma", "outro_benigno"),
    R(r"papiloma\s+intraduct", "outro_benigno"),
    R(r"proliferacao\s+(?:intraductal\s+)?papilar", "outro_benigno"),
    R(r"fibroadenoma\b", "fibroadenoma"),
    R("fibrocistic", "fibrocistico"),
    R(".", "fibrocistico", features=(
        r"\bcistos?\b|\bmicrocistos?\b", "adenose", r"hiperplasia\s+(?:ductal|lobular|fibroadenomatoide)", r"ectasia\s+ductal", r"metaplasia\s+apocrina",
        r"fibrose\s+(?:estromal|reacional|intersticial|interlobular)", r"alterac.o\s+(?:de\s+)?celulas\s+colunares", r"alterac.es?\s+involutiv",
    )),
    R(r"necrose\s+adiposa|adenose|hiperplasia|ectasia\s+ductal|tecido\s+mamario\s+(?:sem|com|apresentando)\s+|metaplasia\s+apocrina|cistos?\b|fibrose\s+estromal|ducto[s]?\s+dilatad|alterac.es?\s+involutiv", "outro_benigno"),
))
TIPO_IHQ = Cascade("tipo_hist_ihq", (
    R(r"lobular\s+(?:invasiv|infiltrant)", "CLI"),
    R(r"(?:carcinoma|ductal)\s+(?:invasiv|infiltrant)", "CDI_SOE", unless=r"ausencia\s+de|sem\s|nao\s"),
    R(r"ductal\s+.?in\s*situ|\bcdis\b", "CDIS"), R(r"lobular\s+.?in\s*situ|\bclis\b", "CLIS"),
    R("micropapilar", "micropapilar"), R("mucinos", "mucinoso"), R(r"carcinoma\s+papil", "papilar"),
))
COMP_INSITU = Cascade("comp_insitu", (
    R(r"(?:sem|ausencia\s+de)\s+(?:componente|carcinoma)\s+(?:ductal\s+)?.?(?:in\s*situ|intraduct)|componente\s*.?(?:in\s*situ|intraduct\w*).?\s*:?\s*(?:nao|ausente)",
        "nao"),
    R(r"componente\s*.?(?:in\s*situ|intraduct)|carcinoma\s+(?:ductal\s+|lobular\s+)?.?in\s*situ|\bcdis\b|\bclis\b|carcinoma\s+intraduct",
        "sim"),
))
MAMILO = Cascade("mamilo",
    (R(r"mamilo\s+(?:comprometid|infiltrad)|doenca\s+de\s+paget|(?:comprometimento|infiltracao)\s+do\s+mamilo", "sim"),
        R(r"mamilo\s+(?:livre|sem|nao|preservad)", "nao")),
    anchors=("mamilo", "paget"))
EFEITO = Cascade("efeito_terapeutico",
    (R(r"resposta\s+(?:patologica\s+)?completa", "completa"), R(r"resposta\s+(?:patologica\s+)?parcial", "parcial"),
        R(r"efeito\s+terapeutico", "sem_info")),
    anchors=("resposta", "efeito"))
INFILTRADO = Cascade("infiltrado_linfocitico", (
    R(r"infiltrado\s+(?:inflamatorio\s+)?linfocit\w*\s*:?\s*(?:ausente|nao)", "nao_evidenciado"),
    R(r"infiltrado\s+(?:inflamatorio\s+)?linfocit\w*\s*:?\s*(?:escasso|discreto|leve|raro)", "escasso"),
    R(r"infiltrado\s+(?:inflamatorio\s+)?linfocit\w*\s*:?\s*moderad", "moderado"),
    R(r"infiltrado\s+(?:inflamatorio\s+)?linfocit\w*\s*:?\s*(?:intens|acentuad|proeminent|exuberant)", "intenso"),
    R(r"infiltrado\s+(?:inflamatorio\s+)?linfocit", "presente"),
), anchors=("infiltrado",))
LN_EXAM = Number("ln_exam", (
    (r"linfon.dos?\s+(?:examinados?|isolados?)\s*:\s*(\d+)", "one"), (r"\d+\s*(?:/|de|em)\s*(\d+)\s+linfon", "one"),
    # our own, for phrasings that none of the above reads
    (r"(\d{1,2})\s+linfonodos?\s+(?:examinad|dissecad|isolad|identificad|avaliad)", "one"), (r"linfonodos?\s*:?\s*\d{1,2}\s*/\s*(\d{1,2})\b", "one"),
), 0, 60)
LN_POS = Number("ln_pos", (
    (r"linfon.dos?\s+(?:comprometidos?|positivos?|metastaticos?)\s*:\s*(\d+)", "one"), (r"macrometastases?\s*(?:\([^)]*\))?\s*:\s*(\d+)", "one"),
    (r"(?:linfon|axilar|sentinela|isolados?).{0,190}?comprometidos?\s*:\s*(\d+)", "one"), (r"(\d+)\s*(?:/|de|em)\s*\d+\s+linfon", "one"),
    # our own, for phrasings that none of the above reads
    (r"linfonodos?\s*:?\s*(\d{1,2})\s*/\s*\d{1,2}\b", "one"), (r"metastases?\s+em\s+(\d{1,2})\b", "one"), (r"linfonodos?\s+(?:livres?|negativ|sem\s+metastase)|ausencia\s+de\s+metastases?", 0),
), 0, 60)
SCORES = tuple(Number(n, ((rf"{w}.{{0,60}}?(?:escore|grau)?\s*:?\s*([123])\b", "one"),), 1, 3) for n,
    w in (("esc_tubular", r"formacao\s+(?:de\s+)?tubul\w*"), ("esc_nuclear", r"(?:grau\s+nuclear|pleomorfismo\s+nuclear)"),
        ("esc_mitotico", r"(?:indice\s+mitotico|mitoses)")))
# Behaviour of histological types; features of which two make a fibrocystic pattern.
INVASIVE = ("CDI_SOE", "CLI", "misto", "mucinoso", "tubular", "medular", "micropapilar", "papilar", "metaplasico",
    "outro_maligno")
IN_SITU, BENIGN = ("CDIS", "CLIS"), ("fibroadenoma", "fibrocistico", "outro_benigno")
CYSTIC = (r"\b(?:micro)?cistos?\b", "adenose", r"hiperplasia\s+(?:ductal|lobular)", r"ectasia\s+ductal",
    r"metaplasia\s+apocrina", r"fibrose\b", r"celulas\s+colunares", r"alterac\w*\s+involutiv")
# Tumour size: labels of the structured field, and the measure that follows them
SIZE_LABELS = (
    r"maior\s+extens.o\s+(?:linear\s+)?d[aoe]\s+neoplasia[^:]*:\s*",
    r"tamanho\s+d[aoe]\s+(?:tumor|neoplasia\s*(?:invasiv[ao])?|lesao)\s*:\s*",
    r"maior\s+dimens.o\s+(?:linear\s+)?d[aoe]\s+neoplasia[^:]*:\s*", r"tamanho\s*:\s*",
    r"focalidade\s+e\s+tamanho\s+d[aoe]\s+tumor\s*:\s*",
)
TUMOUR_MEASURE = r"(\d+(?:[,.]\d+)?\s*(?:x\s*\d+(?:[,.]\d+)?\s*)*(?:cm|mm|milimetros?))"
MEASURING = r"(?:mede|medindo)\s+(?:o\s+maior\s+(?:foco\s+(?:neoplasico\s+)?)?)?"
# Polyp size in words, looked for within 60 characters of a polyp noun, in this order; "grande" before these nouns is no size
SIZE_WORDS = ((r"\bdiminut(?:o|os|a|as)\b", "qualitative_diminuto"), (r"\bp(?:un|on)tiform", "qualitative_punctiform"),
    (r"\bsubcentimetric", "qualitative_subcm"), (r"\bvolumos", "qualitative_large"), (r"\bgrand(?:e|es)\b", "qualitative_large"))
NO_SIZE = r"\bgrand(?:e|es)\s+(?:quantidade|parte|volume|numero|extensao|acumulo|presenca)"
SIZE_BOUND = r"\b(?:menores?|inferiores?)\s+(?:que|do\s+que|de|a)\s*(\d{1,2}(?:[.,]\d)?)\s*(mm|cm)"
# Polyp size: nouns that a measure may belong to, and guards around it
POLYP = r"\bpolip(?:o|os|oide|oides)\b|\bles(?:ao|oes)\s+(?:plan\w+|superficial|polipoide|de\b)|\bcrescimento\s+lateral\b|\bporcao\s+cefalica\b"
OTHER = r"\bulcer(?:a|as|ada|ado)\b|\bneoplasia\b|\btumor\w*\b|\blipoma\w*\b|\bsubepitelia\w+\b|\bdiverticul\w+\b|\bhemorroid\w+\b|\banastomose\b|\bfragmentos?\b|\bpeca\b|\bnodulo\b|\bextensao\s+de\b"
SIZE = r"\b\d{1,3}(?:[.,]\d{1,2})?(?:\s*x\s*\d{1,3}(?:[.,]\d{1,2})?){0,2}\s*(?:mm|cm)\b"
BOUND = r"(?:(?:menor|menores|inferior|inferiores)\s+(?:que|do\s+que|de|a)|(?:menos|abaixo)\s+de|a\s+partir\s+de|<)\s*$"
NOISE = r"\b(?:boston|mayo|nice|paris|bbps|forrest|sakita)\b"
DISTANCE = r"^\s*d[oa]\s+(?:borda\s+anal|anus|canal\s+anal|linha\s+pectinea)"

# Why an interval is no surveillance of its own
INTENT = Cascade("interval_intent", (
    R(r"(?:completar|complementar|segunda\s+sessao|nova\s+sessao|retirada|resseccao)\s+(?:de\s+|da\s+)?(?:polipectomia|mucosectomia|lesao|resseccao)|para\s+(?:polipectomia|mucosectomia)",
        "excluded_therapeutic_session"),
    R(r"preparo\s+(?:inadequado|insatisfatorio|ruim|pessimo)|exame\s+incompleto|repetir\s+(?:o\s+)?(?:exame\s+)?com\s+(?:novo|melhor)\s+preparo",
        "excluded_bad_prep_remake"),
    R(r"complementacao\s+diagnostica|(?:aguardar|conforme)\s+(?:o\s+)?(?:resultado|anatomopatologico|histologia)",
        "excluded_diagnostic_completion"),
), default="vigilancia")

SETS = {
    "tireoide": (BETHESDA, BETHESDA_DESC, SUBTIPO),
    "cervical": (ADEQUAB, ZT, RESULTADO, ORGANISMOS, HORMONAL),
    "gastrico": (OLGA, HP, METODO_HP, METAPLASIA, ATROFIA, DISPLASIA, ATIVIDADE, POLIPOS_FUNDICOS),
    "mama_ihq": (RE, RP, RE_PCT, RP_PCT, RE_ALLRED, RP_ALLRED, HER2_SCORE, HER2_STATUS, KI67),
    "mama_ap": (MARGENS, PROCEDIMENTO, GRAU_NOTT, INV_LINFOV, INV_PERIN, NECROSE, MULTIFOCAL, MICROCALC, EXTRANODAL, PELE,
        REF_IHQ, PT, PN),
    "mama_tipo": (TIPO_HIST, TIPO_IHQ, COMP_INSITU, MAMILO, EFEITO, INFILTRADO, LN_EXAM, LN_POS, *SCORES),
    "endoscopia": (BBPS, LA_GRAU, HERNIA, POLIPO, INTERVALO, INTENT),
}
