"""Stemmers after the published Snowball algorithms: English (Porter 2), Finnish, Swedish.

``stem`` is a pandas UDF meant for the distinct terms of a lexicon.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

LANGUAGES = ("en", "fi", "se", "sv")


def _longest(word: str, endings, start: int = 0) -> str:
    """The longest of the endings that the word has at or after ``start``; empty if none."""
    for k in range(min(len(word) - start, max(map(len, endings))), 0, -1):
        if word[-k:] in endings:
            return word[-k:]
    return ""


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the rest begins after the first non-vowel that follows a vowel."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    if not m:
        return len(word)
    return m.end()


# English

_IRREGULAR = {
    **dict.fromkeys(("skies", "sky"), "sky"), "skis": "ski", "idly": "idl", "ugly": "ugli",
    **{x + "ying": x + "ie" for x in "tdl"}, **{x + "ly": x + "l" for x in ("sing", "gent")}, **{x + "ly": x + "li" for x in ("on", "ear")},
    **{w: w for w in "bias news cosmos andes howe atlas".split()},
}
_KEPT = {*(x + "ing" for x in ("herr", "inn", "earr", "out", "cann")), *(x + "ceed" for x in ("suc", "pro", "ex"))}
_STEP2 = {
    **dict.fromkeys(("ator", "ation", "ational"), "ate"), **dict.fromkeys(("alli", "aliti", "alism"), "al"), **dict.fromkeys(("ousness", "ousli"), "ous"), **dict.fromkeys(("bli", "biliti"), "ble"),
    **dict.fromkeys(("iviti", "iveness"), "ive"), **dict.fromkeys(("ization", "izer"), "ize"), **dict.fromkeys(("fulness", "fulli"), "ful"),
    "ogi": "og", "li": "", "lessli": "less", "tional": "tion", "entli": "ent", "abli": "able", "anci": "ance", "enci": "ence",
}
_STEP3 = {**dict.fromkeys(("ical", "iciti", "icate"), "ic"), **dict.fromkeys(("ative", "ness", "ful"), ""), "alize": "al", "ational": "ate", "tional": "tion"}
_STEP4 = set("ize ive ous iti ate ism ic er al ence ance ible able ant ent ement ment ion".split())
_DOUBLES = tuple(c + c for c in "bdfgmnprt")
_EN = "aeiouy"


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def english(word: str) -> str:
    """Stem of an English word in lower case."""
    if len(word) < 3:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word.removeprefix("'")
    w = re.sub(rf"(^|[{_EN}])y", r"\1Y", w)
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _region(w, _EN)
    r2 = _region(w, _EN, r1)
    w = re.sub("'s'$|'s$|'$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_EN}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # 1b
    end = _longest(w, {"eed", "eedly", "ed", "edly", "ing", "ingly"})
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(f"[{_EN}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN:
        w = w[:-1] + "i"
    # 2
    end = _longest(w, _STEP2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + _STEP2[end]
    # 3
    end = _longest(w, _STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _STEP3[end]
    # 4
    end = _longest(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# Swedish

_SV = "aeiouyäåö"
_SV_MAIN = set("hetens heterna heter heten het arens arnas arna aren are arne ar andes andet anden ande ades ade ad aste ast as at a ernas erns erna ern er ens en es e ornas orna or".split())


def swedish(word: str) -> str:
    """Stem of a Swedish word in lower case."""
    w = word
    r1 = max(3, _region(w, _SV))
    end = _longest(w, _SV_MAIN | {"s"}, r1) if len(w) > r1 else ""
    if end == "s":
        if w[-2:-1] in tuple("klmnoprtvybcdfghj"):
            w = w[:-1]
    elif end:
        w = w[: -len(end)]
    if len(w) - 2 >= r1 and w[-2:] in ("tt", "kt", "gt", "dt", "nn", "gd", "dd"):
        w = w[:-1]
    end = _longest(w, {"fullt", "löst", "els", "lig", "ig"}, r1) if len(w) > r1 else ""
    if end in ("fullt", "löst"):
        w = w[:-1]
    elif end:
        w = w[: -len(end)]
    return w


# Finnish

_FI, _FI_LONG = "aeiouyäö", ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
_FI_PARTICLES = set("kaan kään kin ko kö han hän pa pä sti".split())
_FI_POSSESSIVE = {"si": "", "ni": "", "nsa": "", "nsä": "", "mme": "", "nne": "", "an": "ta ssa sta lla lta na", "än": "tä ssä stä llä ltä nä", "en": "lle ine"}
_FI_CASE = set("a ä n ta tä tta ttä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine den tten siin seen han hen hin hon hän hön".split())
_FI_OTHER = set("eja ejä mpi mpa mpä mmi mma mmä impi impa impä immi imma immä".split())


def finnish(word: str) -> str:
    """Stem of a Finnish word in lower case."""
    w = word
    p1 = _region(w, _FI)
    p2 = _region(w, _FI, p1)
    is_vi = lambda s: len(s) > 1 and s[-1] == "i" and s[-2] in "aeiouäö"
    # particles
    end = _longest(w, _FI_PARTICLES, p1) if len(w) > p1 else ""
    if end == "sti":
        if len(w) - 3 >= p2:
            w = w[:-3]
    elif end and w[-len(end) - 1 : -len(end)] in tuple(_FI + "nt"):
        w = w[: -len(end)]
    # possessives
    end = _longest(w, _FI_POSSESSIVE, p1) if len(w) > p1 else ""
    if end:
        stem_, after = w[: -len(end)], _FI_POSSESSIVE[end].split()
        if end == "si":
            w = w if stem_.endswith("k") else stem_
        elif end == "ni":
            w = stem_[:-3] + "ksi" if stem_.endswith("kse") else stem_
        elif not after or stem_.endswith(tuple(after)):
            w = stem_
    # cases
    removed = False
    end = _longest(w, _FI_CASE, p1) if len(w) > p1 else ""
    if end:
        s = w[: -len(end)]
        if len(end) == 3 and end[0] == "h":
            good = s.endswith(end[1])
        elif end in ("siin", "den", "tten"):
            good = is_vi(s)
        elif end == "seen":
            good = s.endswith(_FI_LONG)
        elif end in ("a", "ä"):
            good = len(s) > 1 and s[-1] in _FI and s[-2] not in _FI
        elif end in ("tta", "ttä"):
            good = s.endswith("e")
        else:
            good = True
        if good:
            if end == "n" and (s.endswith(_FI_LONG) or s.endswith("ie")) and len(s) - 1 >= p1:
                s = s[:-1]
            w, removed = s, True
    # comparatives and agents
    end = _longest(w, _FI_OTHER, p2) if len(w) > p2 else ""
    if end and not (len(end) == 3 and end[0] == "m" and w[:-3].endswith("po")):
        w = w[: -len(end)]
    # plurals
    if removed:
        if len(w) > p1 and w[-1:] in ("i", "j"):
            w = w[:-1]
    elif len(w) > p1 and w.endswith("t") and w[-2:-1] in tuple(_FI):
        w = w[:-1]
        end = _longest(w, {"mma", "imma"}, p2) if len(w) > p2 else ""
        if end == "imma" or end == "mma" and not w[:-3].endswith("po"):
            w = w[: -len(end)]
    # tidy
    if len(w) - 2 >= p1 and w.endswith(_FI_LONG):
        w = w[:-1]
    if len(w) - 2 >= p1 and w[-1] in "aäei" and w[-2] not in _FI:
        w = w[:-1]
    if len(w) - 2 >= p1 and w[-1] == "j" and w[-2] in "ou":
        w = w[:-1]
    if len(w) - 2 >= p1 and w[-1] == "o" and w[-2] == "j":
        w = w[:-1]
    # a double consonant before any last vowels
    k = len(w)
    while k and w[k - 1] in _FI:
        k -= 1
    if k > 1 and w[k - 1] == w[k - 2]:
        w = w[: k - 1] + w[k:]
    return w


_STEMMERS = {"en": english, "fi": finnish, "se": swedish, "sv": swedish}


@lru_cache(maxsize=100_000)
def stem_word(word: str, lang: str) -> str | None:
    """Stem of a word, None for a language without a stemmer."""
    f = _STEMMERS.get(lang)
    return f(word) if f else None


@pandas_udf(StringType())
def stem(terms: pd.Series, langs: pd.Series) -> pd.Series:
    """``stem_word`` of columns; null for nulls and unknown languages."""
    return pd.Series([stem_word(t, x) if t is not None and x is not None else None for t, x in zip(terms, langs)], dtype=object)
