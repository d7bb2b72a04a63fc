"""Queries as trees, and the text syntax for them.

Plain words are keys (what must match); ``/word`` is a cue (the theme that orders the matches);
``"a b"`` and ``/"a b"`` are phrases; ``name:value`` is a modifier. Without cues the keys are
the cues.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qs

from ..functions.tokens import TOKEN


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Range:
    """Terms from ``low`` to ``high`` in order, both included."""

    low: str
    high: str


@dataclass(frozen=True)
class All:
    """Every segment."""


@dataclass(frozen=True)
class Not:
    node: object


@dataclass(frozen=True)
class And:
    nodes: tuple


@dataclass(frozen=True)
class Or:
    """Not in the text syntax; for programs."""

    nodes: tuple


Node = Term | Phrase | Range | All | Not | And | Or


@dataclass(frozen=True)
class Query:
    keys: tuple
    cues: tuple
    mods: dict = field(default_factory=dict, hash=False)
    dropped: tuple[str, ...] = ()

    @property
    def canonical(self) -> tuple:
        """Equal for queries with the same meaning: what a cache of ranks is keyed by; a cache of scores by its second part."""
        order = lambda nodes: tuple(sorted(set(nodes), key=repr))
        return order(self.keys), order(self.cues), tuple(sorted(self.mods.items()))


def _node(words: list[str]):
    return Term(words[0]) if len(words) == 1 else Phrase(tuple(words))


def parse(text: str, known: set[str] | None = None) -> Query:
    """A query from its text. With ``known`` terms, others are dropped and reported; an open phrase is closed at the end."""
    keys, cues, mods, dropped = [], [], {}, []
    for cue, phrase, word in re.findall(r'(/?)"([^"]*)(?:"|$)|(\S+)', text):
        if not phrase and not word:
            continue
        if not phrase:
            cue, word = ("/", word[1:]) if word.startswith("/") else ("", word)
            name, colon, value = word.partition(":")
            if colon and name and not cue:
                mods[name] = value
                continue
        found = re.findall(TOKEN, (phrase or word).lower())
        words = [w for w in found if known is None or w in known]
        dropped += [w for w in found if w not in words]
        side = cues if cue else keys
        if phrase and words:
            side.append(_node(words))
        else:
            side.extend(Term(w) for w in words)
    return Query(tuple(keys), tuple(cues or keys), mods, tuple(dropped))


def parse_request(query_string: str, known: set[str] | None = None) -> tuple[Query, int]:
    """Query and result offset of a web request's ``q`` and ``offs``; malformed strings raise ValueError."""
    fields = parse_qs(query_string.replace(";", "&"), keep_blank_values=True, strict_parsing=True)
    return parse(fields.get("q", [""])[0], known), int(fields.get("offs", ["0"])[0])


def postfix(tokens: list) -> object:
    """A tree from a postfix program: terms and nodes, 'NOT', 'AND', 'ALL'.

    A conjunction grows from left to right; NOT complements all of it so far.
    """
    now = None
    for t in tokens:
        if t == "AND":
            continue
        if t == "NOT":
            if now is None:
                raise ValueError("NOT without an operand")
            now = now.node if isinstance(now, Not) else Not(now)
            continue
        node = All() if t == "ALL" else Term(t) if isinstance(t, str) else t
        now = node if now is None else And((*now.nodes, node)) if isinstance(now, And) else And((now, node))
    if now is None:
        raise ValueError("empty program")
    return now
