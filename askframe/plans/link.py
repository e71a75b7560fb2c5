"""Schema linking: how well tables and columns match the words of a question, and which words are values."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from askframe.functions.lexicon import CONNECTIVES, INTRODUCERS, NOT_VALUES, THESAURUS
from askframe.functions.text import Question, Token, lemma, parts, similarity
from askframe.sources.catalog import Catalog, Column, Table

#: Scores of the ways to match (fixed values): part of a table's name, fuzzy, described; a column's bigram synonym, exact, synonym, fuzzy, described.
TABLE_EXACT, TABLE_FUZZY, TABLE_DESCRIBED = 10.0, 4.0, 0.5
COLUMN_BIGRAM, COLUMN_EXACT, COLUMN_SYNONYM, COLUMN_FUZZY, COLUMN_DESCRIBED = 12.0, 10.0, 6.0, 5.0, 2.0
#: Least similarity of longer and of short words, and from which a word is taken for a misspelt schema word.
FUZZY, FUZZY_SHORT, TYPO = 0.75, 0.85, 0.85


@dataclass(frozen=True)
class TableMatch:
    table: str
    score: float


@dataclass(frozen=True)
class ColumnMatch:
    table: str
    column: str
    score: float
    reason: str


@dataclass(frozen=True)
class ImplicitValue:
    table: str
    value: str


class CatalogIndex:
    """What linking needs of a catalog, worked out once."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.table_parts = {t.name: parts(t.name) for t in catalog.tables}
        self.column_parts = {(t.name, c.name): parts(c.name) for t in catalog.tables for c in t.columns}
        self.synonyms: dict[tuple[str, str], tuple[frozenset[str], frozenset[tuple[str, ...]]]] = {}
        for t in catalog.tables:
            for c in t.columns:
                words, phrases = set(), set()
                for s in c.synonyms:
                    p = tuple(lemma(w) for w in s.split())
                    (words.add(p[0]) if len(p) == 1 else phrases.add(p)) if p else None
                for p in self.column_parts[t.name, c.name]:
                    words.update(lemma(x) for x in THESAURUS.get(p, ()))
                self.synonyms[t.name, c.name] = frozenset(words), frozenset(phrases)
        # singular words that stand for a table: its only word and that word's beginnings, then free words of compound names
        self.hints: dict[str, str] = {}
        for t in sorted((t for t in catalog.tables if len(self.table_parts[t.name]) == 1), key=lambda t: len(t.name)):
            word = self.table_parts[t.name][0]
            self.hints.setdefault(word, t.name)
            for k in range(3, len(word)):
                self.hints.setdefault(word[:k], t.name)
        shared: set[str] = set()
        own: dict[str, str] = {}
        for t in catalog.tables:
            if len(self.table_parts[t.name]) > 1:
                for word in self.table_parts[t.name]:
                    if word in own and own[word] != t.name:
                        shared.add(word)
                    own.setdefault(word, t.name)
        for word, table in own.items():
            if word not in shared:
                self.hints.setdefault(word, table)
        self.words = {w for p in (*self.table_parts.values(), *self.column_parts.values()) for w in p if len(w) > 1}
        self.words |= {w for words, phrases in self.synonyms.values() for w in (*words, *(x for p in phrases for x in p))}

    @functools.lru_cache(4096)
    def looks_like_schema(self, word: str) -> bool:
        return any(len(w) >= 4 and similarity(word, w) >= TYPO for w in self.words)


def _fuzzy(word: str, others: tuple[str, ...]) -> float:
    best = max((similarity(word, p) for p in others if len(p) > 1), default=0.0)
    return best if best >= (FUZZY if len(word) >= 4 else FUZZY_SHORT) else 0.0


def score_tables(q: Question, index: CatalogIndex) -> list[TableMatch]:
    """Best first; equal scores by earliest mention, then declaration. A table whose whole name is said beats one that shares a part."""
    out = []
    for place, t in enumerate(index.catalog.tables):
        own, score, first = index.table_parts[t.name], 0.0, 1 << 30
        joined = "".join(own)
        said = [w for w in q.tokens if not w.quoted]
        for w in said:
            hit = 0.0
            if w.lemma in own or w.lemma == joined:
                hit = TABLE_EXACT + (0.5 if own in ((w.lemma,), (joined,)) else 0)
            elif f := _fuzzy(w.lemma, own):
                hit = TABLE_FUZZY * f
            if t.description and w.lemma in t.description.lower():
                hit += TABLE_DESCRIBED
            if hit >= TABLE_FUZZY * FUZZY:
                first = min(first, w.at)
            score += hit
        if score > 0:
            out.append((-score, first, place, TableMatch(t.name, score)))
    return [m for *_, m in sorted(out, key=lambda x: x[:3])]


def score_columns(q: Question, index: CatalogIndex, tables: list[str] | None = None) -> list[ColumnMatch]:
    """Best first, each column by its best word; equal scores in declaration order."""
    said = [w for w in q.tokens if not w.quoted]
    pairs = {(a.lemma, b.lemma) for a, b in zip(said, said[1:])}
    triples = {(a.lemma, b.lemma, c.lemma) for a, b, c in zip(said, said[1:], said[2:])}
    phrases_said = pairs | triples
    wanted = {t.lower() for t in tables} if tables else None
    out = []
    for t in index.catalog.tables:
        if wanted is not None and t.name.lower() not in wanted:
            continue
        for c in t.columns:
            best, reason = _column_score(said, phrases_said, t, c, index)
            if best > 0:
                out.append(ColumnMatch(t.name, c.name, best, reason))
    return sorted(out, key=lambda m: -m.score)


def _column_score(said: list[Token], phrases_said: set, t: Table, c: Column, index: CatalogIndex) -> tuple[float, str]:
    own = index.column_parts[t.name, c.name]
    words, phrases = index.synonyms[t.name, c.name]
    if phrases & phrases_said:
        return COLUMN_BIGRAM, "synonym"
    meaning = tuple(p for p in own if len(p) > 1)
    best, reason = 0.0, ""
    if len(meaning) > 1 and meaning in phrases_said:
        best, reason = COLUMN_EXACT + 1, "exact"
    for w in said:
        if w.lemma in meaning or w.lemma == "".join(own):
            hit, why = COLUMN_EXACT, "exact"
        elif w.lemma in words:
            hit, why = COLUMN_SYNONYM, "synonym"
        elif f := _fuzzy(w.lemma, meaning):
            hit, why = COLUMN_FUZZY * f, "fuzzy"
        elif c.description and len(w.lemma) > 3 and w.lemma in c.description.lower():
            hit, why = COLUMN_DESCRIBED, "description"
        else:
            continue
        if hit > best:
            best, reason = hit, why
    return best, reason


def implicit_values(q: Question, index: CatalogIndex, flags: set[str]) -> list[ImplicitValue]:
    """Unquoted values next to a table's word: "region ASIA", "the EUROPE region", "client named Acme".

    ``flags``: words that are yes-or-no predicates, so no values.
    """
    words = [w for w in q.tokens if not w.quoted]

    def hint(w: Token) -> str | None:
        return index.hints.get(w.lemma)

    def is_value(w: Token) -> bool:
        low = w.raw.lower()
        if low in NOT_VALUES or low in INTRODUCERS or low in CONNECTIVES or w.lemma in NOT_VALUES or w.lemma in index.words or w.lemma in index.hints or w.lemma in flags or low in flags:
            return False
        # digits, underscores and capitals mark a name, not a misspelt schema word
        return any(x.isdigit() or x == "_" for x in w.raw) or (w.raw.isupper() and len(w.raw) > 1) or not index.looks_like_schema(w.lemma)

    out: list[ImplicitValue] = []
    used: set[int] = set()

    def take(table: str, at: list[int]) -> None:
        used.update(at)
        v = ImplicitValue(table, " ".join(words[i].raw for i in at))
        if v not in out:
            out.append(v)

    # a table's word, then its value
    for i, w in enumerate(words):
        if (table := hint(w)) and i not in used:
            j = i + 1
            while j < len(words) and (words[j].raw.lower() in CONNECTIVES or words[j].raw.lower() in INTRODUCERS):
                j += 1
            run = []
            while j < len(words) and j not in used and is_value(words[j]):
                run.append(j)
                j += 1
            # "customers EUROPE region": the value belongs to what follows it, if that has none of its own
            follows = j < len(words) and hint(words[j])
            own = j + 1 < len(words) and is_value(words[j + 1])
            if run and not (follows and not own):
                take(table, run)
    # a value, then the table's word
    for i, w in enumerate(words):
        if table := hint(w):
            run = []
            j = i - 1
            while j >= 0 and j not in used and is_value(words[j]):
                run.insert(0, j)
                j -= 1
            if run:
                take(table, run)
    # introduced by "named": the nearest table's word up to three words before
    for i, w in enumerate(words):
        if w.raw.lower() in INTRODUCERS and i + 1 < len(words) and i + 1 not in used and is_value(words[i + 1]):
            for j in range(i - 1, max(-1, i - 4), -1):
                if table := hint(words[j]):
                    run = [i + 1]
                    while run[-1] + 1 < len(words) and run[-1] + 1 not in used and is_value(words[run[-1] + 1]):
                        run.append(run[-1] + 1)
                    take(table, run)
                    break
    return out
