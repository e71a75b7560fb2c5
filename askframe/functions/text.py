"""Tokens, lemmas, identifier parts and string similarity."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from askframe.functions.lexicon import COMPOUND_HEADS, STOPWORDS

QUOTED = re.compile(r"(?<!\w)'([^']*)'(?!\w)|\"([^\"]*)\"")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
IRREGULAR = {
    "people": "person", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "indices": "index", "indexes": "index", "statuses": "status",
    "buses": "bus", "bonuses": "bonus", "viruses": "virus", "campuses": "campus", "data": "data", "news": "news", "series": "series", "movies": "movie",
    "was": "be", "were": "be", "is": "be", "are": "be", "has": "have", "had": "have", "paid": "pay", "sold": "sell", "bought": "buy", "made": "make",
}
_VOWEL = re.compile(r"[aeiouy]")


@dataclass(frozen=True)
class Token:
    raw: str
    lemma: str
    quoted: bool = False
    at: int = 0


@dataclass(frozen=True)
class Question:
    text: str
    tokens: tuple[Token, ...]
    quoted: tuple[str, ...] = field(default=())


@functools.lru_cache(4096)
def lemma(word: str) -> str:
    """Singular, then base form. Questions and schemas go through the same rules, so a wrong stem still meets itself."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if w.endswith("ies") and len(w) > 4:
        w = w[:-3] + "y"
    elif re.search(r"(ss|x|z|ch|sh)es$", w):
        w = w[:-2]
    elif w.endswith("s") and len(w) > 3 and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    for end in ("ing", "ed"):
        stem = w[: -len(end)]
        if w.endswith(end) and len(stem) >= 3 and _VOWEL.search(stem) and not w.endswith("eed"):
            if stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            if re.search(r"[^aeiou][aeiou][^aeiouwxyr]$|[aeiou][vcgzu]$|bl$|[nr][cg]$|[aeiou]s$|at$", stem) and not stem.endswith(("en", "on", "it", "er", "or")):
                return stem + "e"
            return stem
    return w


def tokenize(text: str) -> Question:
    """Words that may name something, then quoted literals."""
    quoted = [(m.start(), m[1] if m[1] is not None else m[2]) for m in QUOTED.finditer(text)]
    bare = QUOTED.sub(lambda m: " " * len(m[0]), text)
    words = [Token(m[0], lemma(m[0]), at=m.start()) for m in WORD.finditer(bare) if m[0].lower() not in STOPWORDS]
    return Question(text, (*words, *(Token(q, q.lower(), True, at) for at, q in quoted)), tuple(q for _, q in quoted))


@functools.lru_cache(4096)
def parts(identifier: str) -> tuple[str, ...]:
    """Lemmas of the words of an identifier: camel, snake, kebab, blanks, and known run-together heads."""
    spaced = re.sub(r"([a-z0-9])([A-Z])|([A-Z])([A-Z][a-z])", lambda m: f"{m[1] or m[3]} {m[2] or m[4]}", identifier)
    found = [w for w in re.split(r"[\s_\-.]+", spaced) if w]
    if len(found) == 1 and found[0].islower():
        found = compound(found[0])
    return tuple(lemma(w) for w in found)


def compound(word: str) -> list[str]:
    """A known head and what follows it (3 letters at least), for words of 6 letters or more."""
    if len(word) >= 6:
        for head in sorted(COMPOUND_HEADS, key=len, reverse=True):
            if word.startswith(head) and len(word) - len(head) >= 3 and lemma(word) != head:
                return [head, word[len(head) :]]
    return [word]


@functools.lru_cache(1 << 16)
def similarity(a: str, b: str) -> float:
    """Normalised indel similarity: twice the longest common subsequence over both lengths."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))
