"""Identifiers, also in disguise, at their places in the source.

A document goes through three transducers, each of which rewrites the text and keeps, for
every character it writes, the span of source characters that it came from:

1. characters: full-width and look-alike letters, digits and signs (Cyrillic, Greek, mathematical
   and other forms by their compatibility decomposition) become ASCII, marks of no width vanish;
2. spelled digits: three or more number words in a row ("five five five") become figures;
3. disguises of an address: ``(at)``, ``[dot]``, and ``name at host dot com`` become ``@`` and ``.``.

Detectors then read the normalised text, and each hit is mapped back: its source span
starts where its first character's source starts and ends where its last one's ends.

Only documents that can hold an identifier are rewritten: those with a figure (of any
script), an @-like sign, a character that is rewritten, a number word, a word for a dot, ``at`` in brackets or
``at`` before a name with a dot. The test for that looks at every character and word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_batches
from .text import LETTER, Chunk, chunks, find, kinds, lowered, runs, span_hashes, text_hash

NUMBER_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Letters that look like ASCII ones and don't decompose to them.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ", "aeopcyxijshdqwABEKMHOPCTYXIJSaoopviABEZHIKMNOPTYXig", strict=True))
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "·": ".", "•": ".", " ": " ", " ": " ", " ": " ", "　": " "}
INVISIBLE = "​‌‍⁠﻿­"
#: The shortest run of number words that is taken for figures.
SPELLED = 3

_words = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_words})(?:[ ,.-]{{1,2}}(?:{_words}))+\b", re.I)
_ONE = re.compile(rf"{_words}", re.I)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: Bracketed signs anywhere; white space around them goes with them.
_BRACKET = re.compile(r"[\[({<]\s*(?:(?P<at>at)|(?P<dot>dot|punt|punto|point|punkt))\s*[\])}>]", re.I)
#: Endings of hosts that count after a bare ``at`` with a plain dot, and, besides all of two letters, after a spelled dot.
_ENDING = "com|org|net|edu|gov|info|io|co|de|fr|es|fi|uk|eu|us|example"
_SPELLED_ENDING = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|online|site|cloud|tech|example|test|invalid"
#: Bare words only as name at host dot tld: the sign, and the host after it. What stands before the sign is read backwards.
_HOST = re.compile(
    rf"(?: at (?!(?:a|an|the|this|that|its|our|my|your|his|her|their)\b)|@){_LABEL}(?:(?: dot |\.){_LABEL})*(?: dot (?:{_SPELLED_ENDING})| ?\. ?(?:{_ENDING}))\b", re.I,
)
_BARE_SIGN = re.compile(r" (at|dot) ", re.I)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Words before ten bare figures that make them a phone number.
_CALL = re.compile(r"\b(?:call|calls|phone|telephone|tel|mobile|cell|fax|ring|text|sms|whatsapp|contact|reach|dial|telefon|handy|anrufen|telefono|teléfono|móvil|llame|téléphone|portable|appelez)\b\W*(?:\w+\W+){0,3}$", re.I)
_NATIONAL = re.compile(r"[2-9]\d\d[2-9]\d{6}")

_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|35|6011|65")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_PHONE = re.compile(
    r"(?<![\w+(.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])(?:\d{2,4}[ .-])?\d{3,4}[ .-]?\d{3,4}(?![\w-])(?!\.\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{1,4}){3,6}(?![\w-])(?!\.\d)|(?<![\w+(.-])\d{10}(?![\w-])(?!\.\d)"
)


@lru_cache(maxsize=1)
def _characters() -> dict[int, str]:
    """What each character that isn't ASCII becomes; those that stay aren't in it."""
    out: dict[int, str] = {}
    for i in range(128, sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c in LOOKALIKES or c in SIGNS:
            out[i] = LOOKALIKES.get(c) or SIGNS[c]
        elif c in INVISIBLE:
            out[i] = ""
        elif unicodedata.category(c) == "Nd":
            out[i] = str(unicodedata.digit(c))
        else:
            n = unicodedata.normalize("NFKC", c)
            if n != c and n.isascii() and not n.isspace() and n.isprintable():
                out[i] = n
    return out


@lru_cache(maxsize=1)
def _triggers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters that call for a closer look (figures and @ in any form), those that are rewritten, and the hashes of words that do."""
    table = np.zeros(0x110000, bool)
    table[48:58] = True
    table[64] = True
    for i, c in _characters().items():
        if any(x.isdigit() or x == "@" for x in c):
            table[i] = True
    changed = np.zeros(0x110000, bool)
    changed[list(_characters())] = True
    words = np.sort(np.array([text_hash(w) for w in [*NUMBER_WORDS, "dot", "punt", "punto", "point", "punkt"]], np.uint64))
    return table, changed, words


@lru_cache(maxsize=1)
def _around_at() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White space, opening and closing brackets, and the characters of a host's labels."""
    out = np.zeros((4, 0x110000), bool)
    out[0, [i for i in range(0x110000) if chr(i).isspace()]] = True
    for k, signs in ((1, "[({<"), (2, "])}>"), (3, "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")):
        out[k, [ord(x) for x in signs]] = True
    return out[0], out[1], out[2], out[3]


def _disguised_at(points: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which of the words ``at`` stand in brackets, or before a label and a dot with at most a blank between. May look past the row: that costs a look, no more."""
    blank, opening, closing, label = _around_at()
    if not len(s):
        return np.zeros(0, bool)
    # a stop on either side of the text
    points = np.concatenate([[0], points, [0, 0, 0]])
    s, e = s + 1, e + 1
    solid = np.flatnonzero(~blank[points])
    before, after = solid[np.searchsorted(solid, s) - 1], solid[np.searchsorted(solid, e)]
    brackets = opening[points[before]] & closing[points[after]]
    ends = np.flatnonzero(~label[points])
    end = ends[np.searchsorted(ends, np.minimum(e + 1, len(points) - 2))]
    dot = (points[end] == ord(".")) | (points[end] == ord(" ")) & (points[np.minimum(end + 1, len(points) - 1)] == ord("."))
    return brackets | (points[e] == ord(" ")) & (end > e + 1) & dot


def suspects(c: Chunk) -> np.ndarray:
    """Rows (within the chunk) that can hold an identifier."""
    table, changed, words = _triggers()
    hit = np.zeros(c.stop - c.start, bool)
    at = np.flatnonzero(table[c.points])
    hit[c.rows_of(at)] = True
    points = lowered()[c.points]
    some = np.flatnonzero(changed[c.points])
    if len(some):
        # rows with look-alikes may spell such words with them
        hit[c.rows_of(some)] = True
    kind = kinds()[points]
    s, e = runs(kind, c.offsets)
    if len(s):
        keep = (kind[s] == LETTER) & (e - s <= 5) & (e - s >= 2)
        s, e = s[keep], e[keep]
        known = find(words, span_hashes(points, s, e)) >= 0
        hit[c.rows_of(s[known])] = True
        # the words at
        two = np.flatnonzero(e - s == 2)
        two = two[(points[s[two]] == ord("a")) & (points[s[two] + 1] == ord("t"))]
        hit[c.rows_of(s[two][_disguised_at(c.points, s[two], e[two])])] = True
    return np.flatnonzero(hit & c.valid)


class Tape:
    """A text with, for each character, the source span [start, end) it came from."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace the spans of ``edits`` (ascending, apart): each new character comes from the whole span replaced."""
        if not edits:
            return self
        out, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[last:a], new]
            starts.append(self.start[last:a])
            ends.append(self.end[last:a])
            if new:
                starts.append(np.full(len(new), self.start[a]))
                ends.append(np.full(len(new), self.end[b - 1]))
            last = b
        out.append(self.text[last:])
        starts.append(self.start[last:])
        ends.append(self.end[last:])
        return Tape("".join(out), np.concatenate(starts), np.concatenate(ends))


def normalise(text: str) -> Tape:
    """The three transducers."""
    tape = Tape(text)
    if not text.isascii():
        table = _characters()
        tape = tape.rewrite([(i, i + 1, table[ord(c)]) for i, c in enumerate(text) if ord(c) > 127 and ord(c) in table])
    edits = []
    for m in _SPELLED.finditer(tape.text):
        words = list(_ONE.finditer(tape.text, m.start(), m.end()))
        if len(words) < SPELLED:
            continue
        # each word becomes its figure; what stands between words goes with the word before
        for w, after in zip(words, [*words[1:], None]):
            edits.append((w.start(), after.start() if after else w.end(), NUMBER_WORDS[w.group().lower()]))
    tape = tape.rewrite(edits)
    tape = tape.rewrite(_bracketed(tape.text))
    return tape.rewrite(_bare(tape.text))


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    """Edits for signs in brackets, with the white space on either side of them."""
    edits: list[tuple[int, int, str]] = []
    for m in _BRACKET.finditer(text) if any(x in text for x in "([{<") else ():
        a, b = m.span()
        least = edits[-1][1] if edits else 0
        while a > least and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, "@" if m.group("at") else "."))
    return edits


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Edits for the bare words of name at host dot tld. Every character is looked at a fixed number of times: names are read backwards from the sign that ends them."""
    low = text.lower()
    if " dot " not in low and " at " not in low:
        return []
    edits, least = [], 0
    for m in _HOST.finditer(text):
        a = m.start()
        while True:
            end = a
            while a > least and text[a - 1] in _NAME:
                a -= 1
            # a spelled dot and a name before it
            if a == end or a - 5 < least or low[a - 5 : a] != " dot " or text[a - 6 : a - 5] not in _NAME:
                break
            a -= 5
        while a < m.start() and text[a] in "._%+-":  # a name starts with a letter or a figure
            a += 1
        if a < m.start():
            edits += [(a + x.start(), a + x.end(), "@" if x.group(1).lower() == "at" else ".") for x in _BARE_SIGN.finditer(text[a : m.end()])]
        least = m.end()
    return edits


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """The check sum of account numbers."""
    x = text.replace(" ", "")
    x = x[4:] + x[:4]
    return int("".join(str(int(c, 36)) for c in x)) % 97 == 1


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the identifiers of a normalised text; a stretch belongs to the first kind in order."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def add(m: re.Match, kind: str, value: str) -> None:
        a, b = m.span()
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind, value))

    digits = re.compile(r"\D+")
    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m, "email", m.group().lower())
    for m in _IBAN.finditer(text):
        if iban(m.group()):
            add(m, "iban", m.group().replace(" ", ""))
    for m in _CARD.finditer(text):
        d = digits.sub("", m.group())
        if _ISSUER.match(d) and luhn(d):
            add(m, "card", d)
    for m in _IP.finditer(text):
        add(m, "ip", m.group())
    for m in _SSN.finditer(text):
        add(m, "ssn", m.group())
    for m in _PHONE.finditer(text):
        d = digits.sub("", m.group())
        if 9 <= len(d) <= 15 and not (m.group().count(".") == 3 and "-" not in m.group() and " " not in m.group()):
            add(m, "phone", d)
    return sorted(found)


def identifiers(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) in the source text."""
    tape = normalise(text)
    hits = ((int(tape.start[a]), int(tape.end[b - 1]), kind, value) for a, b, kind, value in detect(tape.text))
    # ten bare figures are a phone number where the source disguises them, or where they can be one and a word before them says so
    return [x for x in hits if x[2] != "phone" or text[x[0] : x[1]] != x[3] or _NATIONAL.fullmatch(x[3]) and _CALL.search(text[max(0, x[0] - 60) : x[0]])]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, kind, value, source): a row for each identifier.

    ``start`` and ``length`` count source characters from 0, ``source`` is what stands there, ``value`` the
    canonical form. Null and empty texts have none; rows with a null or repeated id give their findings each;
    overlapping hits go to the kind first in the order email, iban, card, ip, ssn, phone. Texts are read
    whole, of any length, in time proportional to it. Ten bare figures are a phone number if their area and exchange can
    be and a word such as call or tel stands shortly before them. Other columns, of whatever names, aren't read;
    an empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch.column(1)):
            rows, found = [], []
            for r in suspects(c).tolist():
                text = c.text(int(c.offsets[r]), int(c.offsets[r + 1]))
                for a, b, kind, value in identifiers(text):
                    rows.append(c.start + r)
                    found.append((a, b - a, kind, value, text[a:b]))
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(x, pa.string()) for x in cols[2:])],
                    names=["doc_id", "start", "length", "kind", "value", "source"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id long, start long, length long, kind string, value string, source string")
