"""Best-fit packing of tokenised documents by bin completion on the histogram of lengths.

At most ``window`` different piece lengths exist, however many pieces there are, so the packing is
solved on the driver over counts per length: each step fills a sequence around the largest length
left, with the undominated filling of least waste, and repeats that pattern as often as
the counts allow. Pieces then find their place by (length, rank), in parallel.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askframe.llm.common import free_name, written

#: Nodes that the search for a better packing may visit before the incumbent stands.
NODES = 8_000
#: Steps of looking for fillings of one sequence, and fillings without waste after which it ends where lengths are many.
FILLINGS, BRANCHES = 400, 3
#: Up to so many lengths, all are tried at each step, for so many steps; up to so many pieces, sequences are decided one by one.
FEW_LENGTHS, FEW_STEPS, FEW_PIECES = 24, 10_000, 200
#: Words whose ids a worker keeps; then it starts anew.
CACHE = 150_000

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many sequences, ((length, how many of it), ...)


# -- token ids ---------------------------------------------------------------------------------------------------------


class Kept(dict):
    """What ``make`` returns for a string, kept for short strings until there are ``CACHE`` of them."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(key) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[key] = got
        return got


class WordEncoder:
    """Ids of ``word_bpe_49k.json``, a word at a time, each word's ids kept as bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    white-space-separated chunks. A chunk that is ASCII punctuation around Latin-1 letters is split into these parts and goes
    straight to the merge model; any other chunk (digits, apostrophes, ``<``, other scripts, marks) goes through the whole tokenizer.
    """

    SIMPLE = re.compile(r"([!-&(-/:;=>?@\[-`{-~]*)([a-zß-öø-ÿ]*)([!-&(-/:;=>?@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.parts = Kept(self.chunk), Kept(self.part)
        # the merge model reads bytes as printable characters: those that are printable stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join([self.shown[b] for b in part.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.parts[chunk.lower()]
        if len(chunk) <= 200 and (m := self.SIMPLE.fullmatch(chunk.lower())):
            parts = self.parts
            return parts[m[1]] + parts[m[2]] + parts[m[3]]
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        """Unsigned 32-bit ids, little-endian (as are the machines that Spark runs on)."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return self.whole(text)  # letters and marks may compose
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, window: int, end_id: int = 1) -> DataFrame:
    """Documents cut into pieces of at most ``window`` ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is its text's ids, then ``end_id``; a null text has that only. Nothing but longer documents is cut. A row of ``docs``
    that is repeated makes its pieces again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = word_encoder(path).encode, np.uint32(end_id).astype("<u4").tobytes(), 4 * window
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append(row)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids_ = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(cut, f"doc_id {src.dtypes[0][1]}, piece int, start long, length long, ids_crc32 long")


# -- packing of a histogram --------------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], window: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal sequences stay together as one pattern."""
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}  # by room left
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = next((r for r in rooms if r >= length), None)
            if at is None:
                each = min(window // length, left)
                n = left // each
                _put(open_, rooms, window - each * length, (n, ((length, each),)))
                left -= n * each
                continue
            n, items = open_[at].pop()
            if not open_[at]:
                del open_[at]
                rooms.remove(at)
            each = min(at // length, max(1, left))
            each = each if n * each <= left else max(1, left // n) if left >= n else 1
            used = min(n, left // each)
            if used < n:
                _put(open_, rooms, at, (n - used, items))
            _put(open_, rooms, at - each * length, (used, (*items, (length, each))))
            left -= used * each
    return [p for group in open_.values() for p in group]


def _put(open_: dict, rooms: list[int], room: int, pattern: tuple) -> None:
    if room not in open_:
        open_[room] = []
        i = 0
        while i < len(rooms) and rooms[i] < room:
            i += 1
        rooms.insert(i, room)
    open_[room].append(pattern)


def fillings(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated fillings of ``room`` as (waste, ((length, times), ...)), least waste first, then fewest items.

    ``lengths`` go down. Items come in decreasing order. A filling is dominated, and left out, if another item could be added to it, or if one item left over
    could take the place of one of its items, or of two, and fill no less. Few lengths are all looked at; of many, those next below
    the room left and those that fill it with one or two items; after ``FILLINGS`` steps (``FEW_STEPS``) what was found stands.
    """
    wide = len(lengths) <= FEW_LENGTHS
    found: list[tuple[int, int, tuple]] = []
    looked, best = 0, room + 1
    stack: list[tuple[int, int, tuple]] = [(room, 0, ())]
    while stack and looked < (FEW_STEPS if wide else FILLINGS):
        left, i, items = stack.pop()
        looked += 1
        lo = _first_at_most(lengths, left, i)
        used = dict(items)
        while lo < len(lengths) and used.get(lengths[lo], 0) >= counts[lengths[lo]]:
            lo += 1
        if lo == len(lengths):
            best = min(best, left)
            found.append((left, sum(k for _, k in items), items))
            if best == 0 and not wide and len(found) >= BRANCHES:
                break
            continue
        options = [(lengths[j], j) for j in range(lo, len(lengths) if wide else min(lo + 12, len(lengths))) if used.get(lengths[j], 0) < counts[lengths[j]]]
        exact = [(x, j) for x, j in options if left - x == 0 or used.get(left - x, 0) + (left - x == x) < counts.get(left - x, 0)]
        # the last one put on the stack is looked at first: what fills exactly, then the largest
        for x, j in [*reversed([o for o in options if o not in exact]), *reversed(exact)]:
            more = dict(items)
            more[x] = more.get(x, 0) + 1
            stack.append((left - x, j, tuple(more.items())))
    ranked = sorted(found, key=lambda f: (f[0], f[1]))
    kept = [(w, items) for w, _, items in ranked if not _dominated(lengths, counts, w, items)]
    return kept or [(w, items) for w, _, items in ranked[:1]]


def _first_at_most(lengths: list[int], room: int, lo: int = 0) -> int:
    """The first place from ``lo`` on of a length that is no larger than ``room``."""
    hi = len(lengths)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if lengths[mid] > room else (lo, mid)
    return lo


def _dominated(lengths: list[int], counts: dict[int, int], waste: int, items: tuple[tuple[int, int], ...]) -> bool:
    """Whether an item left over is larger than one of ``items`` by no more than the waste, or as large as two together by no more than it."""
    if not waste:
        return False
    used = dict(items)

    def free(least: int, most: int) -> bool:
        j = _first_at_most(lengths, most)
        while j < len(lengths) and lengths[j] >= least:
            if used.get(lengths[j], 0) < counts[lengths[j]]:
                return True
            j += 1
        return False

    for i, (x, n) in enumerate(items):
        if free(x + 1, x + waste):
            return True
        for y in [x] * (n > 1) + [y for y, _ in items[i + 1 :]]:
            if free(x + y, x + y + waste):
                return True
    return False


class _Search:
    """Branch and bound over sequences, each around the largest piece left."""

    def __init__(self, counts: dict[int, int], window: int):
        self.counts, self.window = dict(counts), window
        self.lengths = sorted(counts, reverse=True)
        self.total = sum(k * v for k, v in counts.items())
        # with few pieces a filling is used once at each node, so that no packing is passed over; else as often as it goes
        self.once = sum(counts.values()) <= FEW_PIECES
        self.made, self.waste = 0, 0
        self.path: list[tuple[int, int, dict[int, int]]] = []  # times, waste of one, pattern

    def options(self) -> list[tuple[int, dict[int, int]]]:
        top = self.lengths[0]
        if top == self.window:
            return [(0, {top: 1})]
        self.counts[top] -= 1
        found = fillings(self.lengths, self.counts, self.window - top)
        self.counts[top] += 1
        out = []
        for w, items in found or [(self.window - top, ())]:
            pattern = dict(items)
            pattern[top] = pattern.get(top, 0) + 1
            out.append((w, pattern))
        return out

    def put(self, waste: int, pattern: dict[int, int]) -> None:
        times = 1 if self.once else min(self.counts[x] // k for x, k in pattern.items())
        for x, k in pattern.items():
            self.counts[x] -= k * times
            if not self.counts[x]:
                self.lengths.pop(_first_at_most(self.lengths, x))
        self.made += times
        self.waste += waste * times
        self.path.append((times, waste, pattern))

    def take_back(self) -> None:
        times, waste, pattern = self.path.pop()
        for x, k in pattern.items():
            if not self.counts[x]:
                self.lengths.insert(_first_at_most(self.lengths, x), x)
            self.counts[x] += k * times
        self.made -= times
        self.waste -= waste * times


def search(counts: dict[int, int], window: int, limit: int, bound: int, nodes: int) -> list[Pattern] | None:
    """A packing of fewer than ``limit`` sequences by bin completion, the best found within ``nodes`` nodes; None if there was none.

    Depth first, the filling of least waste first. A branch is left when its waste exceeds what a packing better than the best so far may have in all. The
    search ends when ``bound`` is met or all branches are done: then nothing is better.
    """
    s, best = _Search(counts, window), None
    untried: list[list[tuple[int, dict[int, int]]]] = []  # of each node on the way down, and then of the node itself
    for _ in range(nodes):
        slack = (limit - 1) * window - s.total
        if not s.lengths and s.made < limit:
            limit = s.made
            best = [(n, tuple(sorted(p.items(), reverse=True))) for n, _, p in s.path]
            if limit <= bound:
                break
        if s.lengths and s.waste <= slack:
            untried.append([o for o in reversed(s.options()) if s.waste + o[0] <= slack])
        elif s.path:
            s.take_back()
        while untried and not untried[-1]:
            untried.pop()
            if s.path:
                s.take_back()
        if not untried:
            break
        s.put(*untried[-1].pop())
    return best


def pack(counts: dict[int, int], window: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that hold all ``counts`` (length -> how many) in few sequences of ``window``.

    Best-fit decreasing is the first incumbent; :func:`search` replaces it as long as it finds something better, until the bound (total length, or
    pieces over half a window) is met, all branches are done, or ``nodes`` nodes were seen: then the incumbent stands.
    """
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return []
    total = sum(k * v for k, v in counts.items())
    bound = max(-(-total // window), sum(v for k, v in counts.items() if 2 * k > window))
    best = best_fit(counts, window)
    n = sum(k for k, _ in best)
    return (search(counts, window, n, bound, nodes) if n > bound else None) or best


# -- places of pieces --------------------------------------------------------------------------------------------------


def best_fit_pack(cut: DataFrame, window: int, by: list[str], nodes: int = NODES) -> DataFrame:
    """``cut`` (a table; it is read twice) with ``sequence_id`` and ``offset`` for each row.

    ``length`` (1 to ``window``) is the size of a row. Each sequence is gapless from 0. Rows of a length are numbered in the order of
    ``by`` within hash buckets, so that a length that very many rows have is dealt over many tasks. The
    driver sees counts by length, and by bucket (about ``window`` + 16,384 rows at most, however many rows there are). Repeated rows
    get places of their own. An empty table gives an empty result. Columns of ``cut`` with the two new names are replaced.
    """
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    bucket, rank, salts = free_name(cut, "bucket", "rank", "salts")
    hist = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    if any(not 1 <= k <= window for k in hist):
        raise ValueError(f"lengths must be between 1 and {window}")
    per = max(512, sum(hist.values()) // 16_384)
    n_buckets = np.zeros(window + 1, dtype=np.int64)
    for k, v in hist.items():
        n_buckets[k] = -(-v // per)
    # many lengths have one bucket; those with more are named in an expression of bounded size by way of a small table
    many = spark.createDataFrame([(int(k), int(n_buckets[k])) for k in hist], f"length long, `{salts}` long")
    x = cut.join(F.broadcast(many), "length").withColumn(bucket, F.pmod(F.xxhash64(*by), F.col(salts))).drop(salts)  # at most `window` rows
    starts: dict[int, np.ndarray] = {k: np.zeros(int(n_buckets[k]) + 1, dtype=np.int64) for k in hist}
    for k, b, n in x.groupBy("length", bucket).count().collect():
        starts[k][b + 1] = n
    first = np.zeros(window + 2, dtype=np.int64)  # where a length's buckets begin
    first[1:] = np.cumsum([len(starts[k]) if k in starts else 0 for k in range(window + 1)])
    before = np.concatenate([np.cumsum(starts[k]) for k in sorted(starts)] or [np.zeros(0, dtype=np.int64)])

    rows, sequence = [], 0
    taken = dict.fromkeys(hist, 0)
    for times, items in pack(hist, window, nodes):
        at = 0
        for length, k in items:
            rows.append((length, taken[length], sequence, k, at))
            taken[length] += times * k
            at += length * k
        sequence += times
    assert taken == hist, "the packing must hold every piece once"
    rows.sort()
    plan = np.array(rows, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((first, before, plan[:, 0] << 44 | plan[:, 1], plan))  # bounded by the window, as above

    kept = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, keys, plan = shared.value
        for batch in batches:
            length, b, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", bucket, rank))
            place_ = before[first[length] + b] + r
            p = plan[np.searchsorted(keys, length << 44 | place_, side="right") - 1]
            over = place_ - p[:, 1]
            arrays = [batch.column(c) for c in kept] + [pa.array(p[:, 2] + over // p[:, 3]), pa.array(p[:, 4] + over % p[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])

    w = Window.partitionBy("length", bucket).orderBy(*by)
    x = x.withColumn(rank, (F.row_number().over(w) - 1).cast("long"))
    return x.mapInArrow(place, ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents with their places; see :func:`pieces` and :func:`best_fit_pack`."""
    cut = written(pieces(docs, id_col, text_col, path, window))
    return best_fit_pack(cut, window, ["doc_id", "piece", "start", "ids_crc32"])
