"""Descriptions and synonyms for a catalog's columns, from their names, types and keys. Only empty places are filled."""

from __future__ import annotations

import copy
import difflib
import re
import shutil
from datetime import datetime
from pathlib import Path

import yaml

from askframe.functions.lexicon import ACRONYMS, STOPWORDS, THESAURUS, WORD_SYNONYMS
from askframe.functions.text import compound
from askframe.sources.catalog import Catalog, Column, Table, load, save
from askframe.sources.introspect import BOOKKEEPING

MOST_SYNONYMS = 5
_TYPE_PHRASES = {"boolean": "whether {}", "date": "when: {}"}


def words_of(name: str) -> list[str]:
    """A name's words, short forms written out, without a one- or two-letter prefix."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"^[a-z]{1,2}_", "", name))
    found = [w for part in re.split(r"[\s_\-]+", spaced) if part for w in ACRONYMS.get(part.lower(), part.lower()).split()]
    return compound(found[0]) if len(found) == 1 and found[0] != name else found


def describe(column: Column, table: Table) -> str:
    """By role (key, reference), then short form, then type, then the words themselves."""
    said = " ".join(words_of(column.name))
    if column.pk:
        return f"Identifier of {table.name}"
    if column.fk:
        return f"Reference to {column.fk.rsplit('.', 1)[0]}"
    if column.name.lower() in ACRONYMS:
        return ACRONYMS[column.name.lower()].capitalize()
    phrase = _TYPE_PHRASES.get(column.kind or "")
    return (phrase.format(said) if phrase else said).capitalize()


def synonyms(column: Column, table: Table, most: int = MOST_SYNONYMS) -> list[str]:
    """In order: short form written out, the words, words like them, the table's name and the words. Never a name of another column."""
    said = words_of(column.name)
    found = [ACRONYMS[column.name.lower()]] if column.name.lower() in ACRONYMS else []
    found.append(" ".join(said))
    for w in said:
        found += WORD_SYNONYMS.get(w, ())
    for w in said:
        found += THESAURUS.get(w, ())[:3]
    found.append(f"{' '.join(words_of(table.name))} {' '.join(said)}")
    taken = {c.name.lower() for c in table.columns}
    out = []
    for s in found:
        if len(s) >= 2 and s not in STOPWORDS and s.lower() not in taken and s not in out:
            out.append(s)
    return out[:most]


def annotate(catalog: Catalog, only: list[str] | None = None, replace: bool = False, most: int = MOST_SYNONYMS, samples: dict[tuple[str, str], list[str]] | None = None, trace: list[str] | None = None) -> Catalog:
    """An annotated copy. What is there stays unless ``replace``; a second run changes nothing.

    Keys, dates and bookkeeping columns get no synonyms. ``samples`` (values by table and column) are added to new descriptions.
    """
    out = copy.deepcopy(catalog)
    for t in out.tables:
        if only and t.name not in only:
            continue
        if replace or not t.description:
            t.description = t.description if t.description and not replace else f"One row per {' '.join(words_of(t.name))}"
        for c in t.columns:
            if replace or not c.description:
                c.description = describe(c, t)
                if shown := (samples or {}).get((t.name, c.name)):
                    c.description += f" (such as {', '.join(shown[:3])})"
            if (replace or not c.synonyms) and not c.pk and not c.fk and c.kind != "date" and c.name.lower().replace("_", "") not in BOOKKEEPING:
                c.synonyms = synonyms(c, t, most)
                if trace is not None:
                    trace.append(f"{t.name}.{c.name}: {', '.join(c.synonyms)}")
    return out


def annotate_file(path: str, **options: object) -> int:
    """Annotate a YAML catalog in place; returns the number of tables."""
    return save(annotate(load(path), **options), path)


def propose(path: str, **options: object) -> str:
    """Write an annotated copy next to a YAML catalog, as <name>.proposed.yml."""
    to = str(Path(path).with_suffix(".proposed.yml"))
    save(annotate(load(path), **options), to)
    return to


def diff(path: str) -> str:
    """What the proposal would change, as a unified diff."""
    new = Path(path).with_suffix(".proposed.yml")
    plain = lambda p: yaml.safe_dump(yaml.safe_load(Path(p).read_text()), sort_keys=False, width=120, allow_unicode=True).splitlines(keepends=True)
    return "".join(difflib.unified_diff(plain(path), plain(new), str(path), str(new)))


def apply(path: str) -> str:
    """Put the proposal in place; returns the backup of what was there."""
    backup = f"{path}.{datetime.now():%Y%m%d-%H%M%S-%f}.bak"
    shutil.copy2(path, backup)
    shutil.move(str(Path(path).with_suffix(".proposed.yml")), path)
    return backup


def discard(path: str) -> bool:
    new = Path(path).with_suffix(".proposed.yml")
    there = new.exists()
    new.unlink(missing_ok=True)
    return there
