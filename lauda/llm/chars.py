"""Character classes of visually equal text: ignorable characters, compatibility forms, look-alikes."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin letter, pairwise (look-alike, Latin).
LOOKALIKES = dict(
    zip(
        "аесорхуіјѕһԁԛԝкмтвнгпАВЕКМНОРСТХУІЈЅЗԌԚԜ" + "οαρνυικτχγηωεβσϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ",
        "aecopxyijshdqwkmtbhrnABEKMHOPCTXYIJS3GQW" + "oapvuiktxynwebscjABEZHIKMNOPTYXC",
    )
)
# Second reading of a look-alike that has two.
SECOND = {"ν": "n", "υ": "y", "у": "u", "η": "h", "г": "g", "к": "x", "в": "B"}
#: Decomposition tags of forms that stand for a plain character of the same look.
FORMS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>",
    "<circle>", "<square>", "<compat>"}
#: Characters with a compatibility form that are ordinary in these texts.
ORDINARY = frozenset("ªºµ±≥≤–—•…´¨¸¯°²³¹¼½¾™")
#: Java class of everything that may stand in for a plain character; used to keep clean rows in the JVM.
SUSPECT = (
    r"(?=[\x{80}-\x{10FFFF}])(?:[\p{M}\p{Cf}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FB00}-\x{FB4F}\x{FE10}-\x{FE19}\x{FE30}-\x{FE6F}\x{FF00}-\x{FFEF}\x{2100}-\x{214F}\x{2150}-\x{218F}\x{2460}-\x{24FF}"
    r"\x{3200}-\x{33FF}\x{1D400}-\x{1D7FF}\x{1EE00}-\x{1EEFF}\x{1F100}-\x{1F2FF}\x{1FBF0}-\x{1FBF9}"
    r"\x{037E}\x{0387}\x{1E9A}\x{1FEE}\x{1FEF}\x{1FFD}\x{20A8}\x{2329}\x{232A}\x{2ADC}\x{2E9F}\x{2EF3}\x{2F00}-\x{2FDF}\x{0890}\x{0891}\x{13430}-\x{1345F}\x{3038}-\x{303A}\x{FDFC}\x{1D15E}-\x{1D164}\x{1D1BB}-\x{1D1C0}]"
    r"|[\p{Zs}&&[^ ]]|[\p{L}&&[^\p{IsLatin}ªºµ]]|[\x{0132}\x{0133}\x{013F}\x{0140}\x{0149}\x{01C4}-\x{01CC}\x{01F1}-\x{01F3}\x{017F}])"
)
HANGUL_FILLERS = "ᅟᅠㅤﾠ"


@lru_cache(maxsize=65536)
def ignorable(c: str) -> bool:
    """Invisible: format characters, soft hyphen, variation selectors, fillers."""
    return unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or c == "͏" or c in HANGUL_FILLERS


@lru_cache(maxsize=65536)
def plain(c: str) -> str:
    """The plain form of one character: '' if ignorable, ' ' for other spaces, else itself or its compatibility form."""
    if c < "\x7f":
        return c
    if ignorable(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in ORDINARY:
        return c
    d = unicodedata.decomposition(c)
    if d.startswith("<") and d.split(" ", 1)[0] in FORMS:
        k = unicodedata.normalize("NFKC", c)
        if d.startswith("<compat>") and not k.isalnum():
            return c
        return k
    return c


_ACCENTED = re.compile("([" + "".join(LOOKALIKES) + "])([\u0300-\u036f]+)")


def simple_form(text: str) -> str:
    """Compatibility normalisation and deletion of ignorable characters, then composition of accents.

    An accent on a look-alike makes it a Latin letter: no other script is used with accents here.
    """
    t = unicodedata.normalize("NFD", "".join(map(plain, text)))
    return unicodedata.normalize("NFC", _ACCENTED.sub(lambda m: LOOKALIKES[m[1]] + m[2], t))


def other_script(c: str) -> bool:
    return c in LOOKALIKES
