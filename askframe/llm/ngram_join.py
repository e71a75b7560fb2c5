"""N-gram Jaccard join by grouped prefixes.

Two sets of word shingles with Jaccard similarity of at least t share one of their first
|S| - ceil(t |S|) + 1 members in any common order. Members are ordered from rare to frequent, and how early the shared
member stands bounds the similarity. Documents with identical prefix
and size make one group; only groups are indexed and paired; pairs are expanded to members and verified on whole sets.

Pairs go in rounds, so that a group or a common shingle does not give all its pairs. In a round every group (later: member) is paired with one pivot
per shared shingle: the one in which the shingle comes earliest, since copies have words of their own before those that they share, and
their base has not. Links merge components, and pairs of one component need no look. When few pairs are left, or pivots no longer merge
anything, all pairs left that share a prefix shingle (or a group) and lie in different components are verified. So no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import components, drop, written

#: Words of a shingle; similarity in per cent.
WORDS, PERCENT = 5, 75
#: Counters of the frequency sketch (16 MB), in blocks that are added up separately. Every shingle of the corpus is counted in it; it only orders prefixes.
COUNTERS, BLOCKS = 1 << 22, 64
#: Postings of one index block; a shingle whose counter exceeds HOT_DOCS is known to be shared and is not sent there.
PER_BLOCK, HOT_DOCS = 400_000, 100_000
#: Rows up to which a side is broadcast (8 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: While there are more pairs to look at than this many for each posting, postings are paired with pivots only, to merge components first.
PAIRS_A_ROW = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 60_000:
                self.clear()
            self[word] = got
        return got


_hashes = WordHashes()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's n-word shingles, lower-cased in A-Z.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    words = (text or "").encode().lower().split()  # bytes: lower() knows A-Z, split() the ASCII white space, and no more
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    h = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        h *= MULTIPLIER
        h += w[i : len(w) - n + 1 + i]
    h ^= h >> np.uint64(31)
    h *= MULTIPLIER
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' shingles fall on each counter: COUNTERS numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)
        for b in batches:
            for t in b.column(0):
                np.add.at(total, counter(shingles(t.as_py(), n)), 1)
        pack = zstandard.ZstdCompressor(level=1)
        rows = [pack.compress(x.tobytes()) for x in total.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(rows, pa.binary())], ["block", "counts"])

    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), dtype=np.uint32)
    parts = docs.select("text").mapInArrow(count, "block int, counts binary")
    # partial sums by 16 tasks per block before the last, so that no task reads a row from each task of a large scan
    half = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("block", "part").applyInPandas(_summed, "block int, counts binary")
    for block, counts in half.groupBy("block").applyInPandas(_summed, "block int, counts binary").collect():
        out[block] = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), dtype=np.uint32)
    return out.reshape(-1)


def _summed(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    open_, total = zstandard.ZstdDecompressor(), np.zeros(COUNTERS // BLOCKS, dtype=np.uint64)
    for c in b["counts"]:
        total += np.frombuffer(open_.decompress(c), dtype=np.uint32)
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pd.DataFrame({"block": [key[0]], "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})


def prefixes(docs: DataFrame, n: int, percent: int, sketch: Broadcast) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``ph`` and ``sh`` (hashes of prefix and set), ``prefix`` (hashes, rare first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ph, sh, prefix = [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), n)
                k = len(h) - -(-percent * len(h) // 100) + 1 if len(h) else 0
                p = h[np.lexsort((h, sketch.value[counter(h)]))[:k]].tobytes()
                sizes.append(len(h))
                ph.append(xxhash.xxh3_64_intdigest(p) - (1 << 63))
                sh.append(xxhash.xxh3_64_intdigest(h.tobytes(), seed=1) - (1 << 63))
                prefix.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(ph, pa.int64()), pa.array(sh, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "n", "ph", "sh", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, ph long, sh long, prefix binary")


def shared_postings(reps: DataFrame, total: int, sketch: Broadcast) -> DataFrame:
    """(``h``, ``gid``, ``pos``) for prefix shingles that at least two of the groups ``reps`` (``gid``, ``prefix``) have.

    Postings travel as packed arrays by block of shingles; a block's task sorts them and passes on those that
    occur twice. Block and 32 more bits name a shingle: the few that are taken for one another only make candidates more.
    Shingles whose counter stands out by more than HOT_DOCS are shared for certain: they are
    dealt by group instead and passed on as they are, so every block is bounded.
    """
    blocks = int(min(max(32, total // PER_BLOCK), 1 << 16))
    hot = HOT_DOCS + 2 * int(sketch.value.mean())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, gs, held = [], [], 0

        def out() -> pa.RecordBatch:
            h, g = np.concatenate(hs), np.repeat(np.array(gs, dtype=np.int64), [len(x) for x in hs])
            pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in hs])
            own = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int64)
            known = sketch.value[counter(h)] > hot
            block = np.where(known, blocks + g % blocks, own)
            order = np.argsort(block, kind="stable")
            name = (own << 32 | (h >> np.uint64(32)).astype(np.int64))[order]
            block, g, pos = block[order], g[order], pos[order]
            where = np.flatnonzero(np.diff(block, prepend=-1))
            cut = list(zip(where, np.append(where[1:], len(block))))
            # within a block of shingles the upper half of the name is the block's
            names = [(name[i:j] if block[i] >= blocks else name[i:j].astype(np.uint32)).tobytes() for i, j in cut]
            rest = [pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (g, pos)]
            return pa.RecordBatch.from_arrays([pa.array(block[where].astype(np.int32)), pa.array(names, pa.binary()), *rest], ["block", "hs", "gs", "ps"])

        for b in batches:
            for g, p in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1)):
                hs.append(np.frombuffer(p.as_buffer(), dtype=np.uint64).copy())
                gs.append(g)
                held += len(hs[-1])
                if held >= PER_BLOCK:
                    yield out()
                    hs, gs, held = [], [], 0
        if held:
            yield out()

    def twice(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        parts: tuple[list, ...] = ([], [], [])
        for b in batches:
            for to, column, kind in zip(parts, ("hs", "gs", "ps"), (np.int64 if block >= blocks else np.uint32, np.int64, np.int32)):
                to += [np.frombuffer(x.as_buffer(), dtype=kind) for x in b.column(column)]
        h, g, pos = (np.concatenate(x) for x in parts)
        if block < blocks:
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            h, g, pos = block << 32 | h[keep].astype(np.int64), g[keep], pos[keep]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(pos)], ["h", "gid", "pos"])

    packed = reps.select("gid", "prefix").mapInArrow(split, "block int, hs binary, gs binary, ps binary")
    return packed.groupBy("block").applyInArrow(twice, "h long, gid long, pos int")


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``, written) whose whole sets are similar enough."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), n).tobytes() for t in b.column(1)], pa.binary())], ["id", "members"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                inter = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                hits.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
            mask = pa.array(hits, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    own = written(docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi").mapInArrow(sets, "id long, members binary"))
    left = own.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = own.select(F.col("id").alias("b"), F.col("members").alias("y"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(similar, "a long, b long").distinct())
    drop(ids, own)
    return out


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """(``a``, ``b``) with a < b."""
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (written) with ``comp`` after ``links`` (which go); a component is named by its smallest class."""
    of = label.select("cid", "comp")
    edges = links.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").select("u", "v")
    ends = components(edges, "u", "v")
    out = written(label.join(ends, F.col("comp") == F.col("id"), "left").withColumn("comp", F.coalesce("component_id", "comp")).drop("id", "component_id"))
    drop(ends, links)
    return out


def _open(wide: DataFrame, percent: int) -> DataFrame:
    """Postings (written) of shingles that several components share, early enough to go with the smallest set there is under the shingle."""
    wide = written(wide)
    shared = wide.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least")).where("lo <> hi").select("h", "least")
    early = 100 * F.col("size").cast("long") - (100 + percent) * F.col("pos").cast("long") >= percent * F.col("least").cast("long")
    out = written(wide.join(shared, "h").where(early).drop("least"))
    drop(wide)
    return out


def _left(wide: DataFrame) -> tuple[int, int]:
    """Pairs of postings under one shingle that lie in different components, and postings of shingles that have such pairs."""
    per = wide.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
    open_ = per.where("c * c > own")
    got = open_.agg(F.sum(((F.col("c") * F.col("c") - F.col("own")) / 2).cast("decimal(38,0)")), F.sum("c")).first()
    return int(got[0] or 0), int(got[1] or 0)


def _without(wide: DataFrame, pivots: DataFrame) -> DataFrame:
    """``wide`` without the postings (shingle, class) of ``pivots``."""
    return wide.join(pivots.toDF("h", "cid"), ["h", "cid"], "left_anti")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: ``doc_id`` long, ``n_shingles`` long, ``component_id`` long.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their shingle sets; ``component_id``
    is the smallest id reachable by links, its own included. A document without words links with nothing, nor does a row without an id (its
    component is null). Rows that share an id share their component. Other columns are not read; an empty table gives
    an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = df.sparkSession.sparkContext.broadcast(frequency_sketch(docs, n))  # 16 MB
    pre = written(prefixes(docs, n, percent, sketch))
    own = written(pre.drop("prefix"))
    linkable = own.where("n > 0 AND doc_id IS NOT NULL")
    # sets that are equal make a class, named by its smallest document; equal prefix and size make a group
    classes = written(linkable.groupBy("n", "ph", "sh").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("copies")))
    groups = classes.groupBy("n", "ph").agg(F.min("cid").alias("gid"))
    classes_ = written(classes.join(groups, ["n", "ph"]).select("cid", "gid", "n", "ph", "sh", "copies"))
    drop(classes)
    classes = classes_
    copies = classes.where("copies > 1").select("n", "ph", "sh", "cid")
    members = written(linkable.join(copies, ["n", "ph", "sh"]).select("doc_id", "cid").where("doc_id <> cid").distinct())
    slim = classes.select("cid", "gid", "n")
    rest = written(members.select("doc_id").unionByName(slim.where("cid <> gid").select(F.col("cid").alias("doc_id"))).distinct())
    total = pre.agg(F.sum(F.col("n").cast("long") * (100 - percent) / 100 + 1)).first()[0] or 0
    reps = pre.where("n > 0 AND doc_id IS NOT NULL").join(small(rest), "doc_id", "left_anti").select(F.col("doc_id").alias("gid"), "prefix")
    posts = written(shared_postings(reps, int(total), sketch))
    drop(rest, pre)
    sketch.destroy()

    size = slim.where("cid = gid").select("gid", F.col("n").alias("size"))
    sized = written(posts.join(size, "gid"))
    drop(posts)

    def may(x: str, y: str) -> Column:
        """Whether sets of these sizes can be similar if their first common member has these places."""
        n, m, i, j = (F.col(c).cast("long") for c in (f"{x}.size", f"{y}.size", f"{x}.pos", f"{y}.pos"))
        return F.least(n - i, m - j) * (100 + percent) >= percent * (n + m)

    # first round: each group with the pivot of each of its shingles, and with its own classes
    pivots = written(sized.groupBy("h").agg(F.min(F.struct("pos", "gid", "size")).alias("p")))
    x = sized.alias("x").join(pivots, "h").where("gid <> p.gid").where(may("x", "p"))
    x = x.select("gid", F.col("p.gid").alias("pivot")).distinct().join(slim.select("cid", "gid"), "gid")
    first = _pairs(x, "pivot", "cid").unionByName(_pairs(slim.where("cid <> gid"), "gid", "cid"))
    tried = [written(first.distinct())]
    label = _merged(slim.withColumn("comp", F.col("cid")), verified(tried[0], docs, n, percent))
    # what shares a prefix shingle, or a group, and is not known to be connected; a pivot has met all others
    several = label.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
    inside = label.where("cid <> gid").join(several, "gid").select(F.xxhash64(F.lit("group"), "gid").alias("h"), "cid", F.lit(0).alias("pos"), F.col("n").alias("size"), "comp")
    wide = sized.join(label.select("cid", "gid", "comp"), "gid").select("h", "cid", "pos", "size", "comp")
    wide = _open(_without(wide, pivots.select("h", "p.gid")).unionByName(inside), percent)
    drop(sized, pivots)
    before = None
    while True:
        pairs, rows = _left(wide)
        if not rows:
            break
        last = pairs <= PAIRS_A_ROW * rows or (before is not None and 10 * pairs > 9 * before)
        before = pairs
        if last:  # all pairs that are left
            x = wide.alias("x").join(wide.alias("y"), F.col("x.h") == F.col("y.h")).where("x.cid < y.cid AND x.comp <> y.comp").where(may("x", "y"))
            x = x.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
        else:  # each posting with the next pivot of its shingle
            pivots = written(wide.groupBy("h").agg(F.min(F.struct("pos", "cid", "size", "comp")).alias("p")))
            x = _pairs(wide.alias("x").join(pivots, "h").where("comp <> p.comp").where(may("x", "p")), "p.cid", "cid")
        x = x.distinct()
        for t in tried:
            x = x.join(t, ["a", "b"], "left_anti")
        tried.append(written(x))
        old, label = label, _merged(label, verified(tried[-1], docs, n, percent))
        drop(old)
        if last:
            break
        rest = _without(wide, pivots.select("h", "p.cid")).drop("comp").join(label.select("cid", "comp"), "cid")
        old, wide = wide, _open(rest, percent)
        drop(old, pivots)
    drop(wide, classes, *tried)

    # classes to documents
    base = own.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    of = label.select("cid", F.col("comp").alias("component_id"))
    mine = of.select(F.col("cid").alias("doc_id"), "component_id").where("doc_id <> component_id")
    theirs = members.join(of, "cid").select("doc_id", "component_id")
    found = mine.unionByName(theirs).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return base.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, columns as in ``docs``: of each component the one with the smallest id, and rows without an id."""
    gone = written(near_duplicates(docs, "doc_id", "text", n, percent).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
