"""Literals of a question, in one pass from left to right: quoted, dates, limits, comparisons, numbers, yes and no."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from askframe.functions.lexicon import NO, STOPWORDS, YES
from askframe.functions.text import QUOTED, lemma

MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
DAYS = {d: i for i, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
_MONTH = "(" + "|".join([*MONTHS, *(m[:3] for m in MONTHS)]) + r")\.?"
_DATES = [
    (re.compile(r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"), lambda m, now: date(int(m[1]), int(m[2]), int(m[3]))),
    (re.compile(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"), lambda m, now: date(int(m[3]), int(m[1]), int(m[2]))),
    (re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}(?:,?\s+(\d{{4}}))?\b", re.I), lambda m, now: _past(now, _month(m[2]), int(m[1]), m[3])),
    (re.compile(rf"\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b", re.I), lambda m, now: _past(now, _month(m[1]), int(m[2]), m[3])),
    (re.compile(r"\b(\d+)\s+(day|week|month|year)s?\s+ago\b", re.I), lambda m, now: _ago(now, int(m[1]), m[2].lower())),
    (re.compile(r"\b(today|yesterday|tomorrow)\b", re.I), lambda m, now: now + timedelta({"today": 0, "yesterday": -1, "tomorrow": 1}[m[1].lower()])),
    (re.compile(r"\b(?:last\s+|on\s+)?(" + "|".join(DAYS) + r")\b", re.I), lambda m, now: now - timedelta((now.weekday() - DAYS[m[1].lower()]) % 7 or 7)),
]
_NUMBER = r"-?\d+(?:\.\d+)?"
_LIMITS = [(re.compile(r"\btop\s+(\d+)\b", re.I), "top"), (re.compile(r"\b(?:first|only)\s+(\d+)\b", re.I), "top"), (re.compile(r"\blimit\s+(\d+)\b", re.I), "limit")]
_COMPARE = [
    (r">=|\bat least|\bno less than|\bnot less than|\bsince", ">="),
    (r"<=|\bat most|\bno more than|\bnot more than|\bup to|\buntil", "<="),
    (r"<>|!=|\bnot equal(?: to)?|\bother than", "<>"),
    (r">|\b(?:greater|more|larger|higher|bigger|later) than|\babove|\bover|\bafter|\bexceeding", ">"),
    (r"<|\b(?:less|fewer|smaller|lower|earlier) than|\bbelow|\bunder|\bbefore", "<"),
]
_PLAIN = re.compile(rf"(?<![\w.]){_NUMBER}(?![\w.]*[A-Za-z_])")


@dataclass(frozen=True)
class Literal:
    """A number or date with its comparison; ``upper`` is the second value of ``between``."""

    value: object
    op: str = "="
    upper: object = None
    at: int = 0


@dataclass
class Values:
    quoted: list[str] = field(default_factory=list)
    numbers: list[Literal] = field(default_factory=list)
    dates: list[Literal] = field(default_factory=list)
    booleans: list[bool] = field(default_factory=list)
    limit: int | None = None
    top: int | None = None
    #: (lemma, sign) of "are X", "has X", "not X", "without X".
    predicates: list[tuple[str, bool]] = field(default_factory=list)
    #: (lemma, is null) of "where X is (not) null".
    nulls: list[tuple[str, bool]] = field(default_factory=list)


def _month(word: str) -> int:
    return next(i for m, i in MONTHS.items() if m.startswith(word.lower()[:3]))


def _past(now: date, month: int, day: int, year: str | None) -> date:
    found = date(int(year) if year else now.year, month, day)
    return found if year or found <= now else date(now.year - 1, month, day)


def _ago(now: date, n: int, unit: str) -> date:
    if unit in ("day", "week"):
        return now - timedelta(n * (7 if unit == "week" else 1))
    months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    for day in (now.day, 30, 29, 28):
        try:
            return date(year, month + 1, day)
        except ValueError:
            continue
    return date(year, month + 1, 28)


def _number(text: str) -> int | float:
    x = float(text)
    return int(text) if "." not in text else int(x) if x.is_integer() else x


def extract(text: str, now: date | None = None) -> Values:
    """Each literal uses up its place in the text, so a date's digits are not numbers and a quoted digit is no number either."""
    now = now or date.today()
    out = Values()
    left = text

    def use(m: re.Match) -> None:
        nonlocal left
        left = left[: m.start()] + " " * (m.end() - m.start()) + left[m.end() :]

    for m in QUOTED.finditer(text):
        out.quoted.append(m[1] if m[1] is not None else m[2])
        use(m)
    found: list[Literal] = []
    for pattern, make in _DATES:
        for m in list(pattern.finditer(left)):
            try:
                found.append(Literal(make(m, now), at=m.start()))
            except ValueError:
                continue
            use(m)
    for pattern, kind in _LIMITS:
        for m in list(pattern.finditer(left)):
            if kind == "limit":
                out.limit = out.limit or int(m[1])
            else:
                out.top = out.top or int(m[1])
            use(m)
    spans = [(m.start(), _number(m[0])) for m in _PLAIN.finditer(left)]
    literals = sorted([*found, *(Literal(v, at=at) for at, v in spans)], key=lambda x: x.at)
    done: set[int] = set()
    for m in re.finditer(r"\bbetween\b", text, re.I):
        pair = [x for x in literals if x.at > m.start() and type(x.value) is not bool][:2]
        if len(pair) == 2 and re.search(r"\band\b", text[pair[0].at : pair[1].at], re.I):
            _file(out, Literal(pair[0].value, "between", pair[1].value, pair[0].at))
            done |= {pair[0].at, pair[1].at}
    for x in literals:
        if x.at in done:
            continue
        before = text[: x.at].rstrip()
        op = next((op for words, op in _COMPARE if re.search(rf"(?:{words})(?:\s+the)?$", before, re.I)), "=")
        if op == "=" and re.match(rf"{_NUMBER}\s+or\s+(more|less)\b", text[x.at :], re.I):
            op = ">=" if "or more" in text[x.at :].lower() else "<="
        _file(out, Literal(x.value, op, at=x.at))
    _signs(left, out)
    return out


def _file(out: Values, x: Literal) -> None:
    mine = out.dates if isinstance(x.value, date) else out.numbers
    if not any((y.value, y.op, y.upper) == (x.value, x.op, x.upper) for y in mine):
        mine.append(x)


def _signs(text: str, out: Values) -> None:
    """Yes and no, and what is said to hold or not to hold of a column. A negated word does not count as its positive self."""
    words = re.findall(r"[A-Za-z_]+", text.lower())
    seen: set[str] = set()
    negated: set[int] = set()
    for m in re.finditer(r"\b([a-z_]+)(?:\s+(?:field|column|value))?\s+(?:is|are)\s+(not\s+)?(?:null|empty|missing)\b", text.lower()):
        out.nulls.append((lemma(m[1]), not m[2]))
        seen.add(lemma(m[1]))
    for i, w in enumerate(words):
        if w in ("without", "not", "no") and i + 1 < len(words):
            for j in range(i + 1, min(i + 4, len(words))):
                if words[j] in ("null", "empty", "missing", "more", "less", "than", "equal"):
                    break
                if words[j] not in STOPWORDS:
                    for k in range(j, min(j + 2, len(words))):  # "without payment status": both words may be of one column
                        if words[k] in STOPWORDS:
                            break
                        negated.add(k)
                        if lemma(words[k]) not in seen:
                            seen.add(lemma(words[k]))
                            out.predicates.append((lemma(words[k]), False))
                    break
    for i, w in enumerate(words):
        if w in ("is", "are", "has", "have", "with") and i + 1 < len(words):
            j = i + 1
            while j < len(words) - 1 and words[j] in ("a", "an", "the", "any"):
                j += 1
            x = words[j]
            if j not in negated and x not in STOPWORDS and x not in ("not", "no", "null", "empty") and x not in YES | NO and lemma(x) not in seen:
                seen.add(lemma(x))
                out.predicates.append((lemma(x), True))
    for i, w in enumerate(words):
        if i not in negated and w in (YES - {"on"}) | (NO - {"no", "off"}):
            if (w in YES) not in out.booleans:
                out.booleans.append(w in YES)
