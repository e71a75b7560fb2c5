"""Token counts of sections by offset mapping.

A document is encoded once, whole. Byte-level tokens spell their text, so the running sum of
their lengths gives every token's span; spans are then joined with the sections' intervals. A token across a
boundary is counted by a stated rule, so the sections' counts add up to the document's.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a token that crosses a boundary is counted: with the section of its first byte, of its last byte, or of most of its bytes (the first of equals).
RULES = ("first", "last", "most")
FIRST_END = re.compile(r"[.!?][ \t]+|\n")
#: White space as the tokenizer's pattern knows it; a run as long as this would be too much for its matcher.
LONG_RUN = 50_000
BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")
Sections = Callable[[str], list[tuple[str, int, int]]]


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> tuple[object, np.ndarray]:
    """The encoder of a ``.tiktoken`` file of ranks, and each id's length in bytes."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(encoder: object, text: str) -> np.ndarray:
    """The ids of a whole text. A long run of white space is one piece to the tokenizer's pattern, but for its last character if something follows: it
    goes to the merges as such, and the texts on either side are encoded as they are."""
    if len(text) < LONG_RUN or not (runs := list(BLANKS.finditer(text))):
        return encoder.encode_to_numpy(text, disallowed_special=())
    out, at = [], 0
    for run in runs:
        end = run.end() - (run.end() < len(text))
        out += [encode(encoder, text[at : run.start()]), np.array(encoder._core_bpe.encode_single_piece(text[run.start() : end].encode()), dtype=np.uint32)]
        at = end
    return np.concatenate([*out, encoder.encode_to_numpy(text[at:], disallowed_special=())])


def parts(text: str) -> list[tuple[str, int, int]]:
    """The sections of a text by default: ``head`` (first sentence), ``body``, ``tail`` (last line, if it is not the head).

    Blanks and the line break after a sentence or line belong to it, so a token that begins with a blank may cross into the next
    section. Sections are (kind, start, end) in characters, in order; they are not empty and cover the text.
    """
    first = FIRST_END.search(text)
    head = first.end() if first else len(text)
    tail = max(text.rfind("\n", 0, len(text) - 1) + 1, head)
    return [p for p in (("head", 0, head), ("body", head, tail), ("tail", tail, len(text))) if p[1] < p[2]]


def attribute(ends: np.ndarray, starts: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted for each section, and those that cross into it from the one before.

    Tokens are [starts, ends) in bytes; section i is [bounds[i], bounds[i + 1]).
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    own = {"first": first, "last": last}.get(rule)
    crossing = np.flatnonzero(first != last)
    if own is None:
        own = first.copy()
        for t in crossing:
            shares = np.minimum(ends[t], bounds[first[t] + 1 : last[t] + 2]) - np.maximum(starts[t], bounds[first[t] : last[t] + 1])
            own[t] = first[t] + int(np.argmax(shares))
    over = np.bincount(last[crossing], minlength=n)
    return np.bincount(own, minlength=n), over


def section_tokens(df: DataFrame, id_col: str, text_col: str, path: str, rule: str = "first", sections: Sections = parts) -> DataFrame:
    """A row per section: ``doc_id``, ``section`` (int from 0), ``kind``, ``start``, ``end`` (characters), ``n_tokens``, ``n_crossing``, ``doc_tokens``.

    ``sections`` gives ordered, adjacent (kind, start, end) that cover a text. ``n_tokens`` counts the section's tokens
    by ``rule``; ``n_crossing`` those of the document's tokens that begin before the section and end in it. A null or
    empty text has one section ``empty`` without tokens. Texts are encoded whole; strings of special tokens are
    ordinary text. Repeated rows are counted again, a null id stays null; other columns are not read; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = byte_encoder(path)
        for batch in batches:
            rows: list[int] = []
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                if not text:
                    rows.append(row)
                    for c, v in zip(columns, (0, "empty", 0, 0, 0, 0, 0)):
                        c.append(v)
                    continue
                ids = encode(encoder, text)
                ends = np.cumsum(sizes[ids])
                starts = ends - sizes[ids]
                found = sections(text)
                marks = [0, *(p[2] for p in found)]
                if text.isascii():
                    bounds = np.array(marks, dtype=np.int64)
                else:  # characters to bytes
                    first = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80)
                    bounds = np.append(first, ends[-1])[marks]
                n, over = attribute(ends, starts, bounds, rule)
                k = len(found)
                rows += [row] * k
                for c, v in zip(columns, (range(k), [p[0] for p in found], marks[:-1], marks[1:], n.tolist(), over.tolist(), [len(ids)] * k)):
                    c.extend(v)
            ids_ = batch.column(0).take(pa.array(rows, pa.int64()))
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids_, *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    names = ["doc_id", "section", "kind", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(count, f"doc_id {src.dtypes[0][1]}, section int, kind string, start long, `end` long, n_tokens long, n_crossing long, doc_tokens long")
