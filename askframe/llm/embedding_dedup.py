"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, learned on the two halves of unit vectors, span a grid of cells. Every vector lies in its nearest cell and visits cells in the
order of multi-sequence traversal, that is by the sum of the two halves' distances, as long as the sum exceeds the nearest cell's by no more
than a margin. The margin is measured: the true neighbours of probe vectors among all vectors, and neighbours just at the threshold in random directions,
must lie in a visited cell as often as ``recall`` asks. No number of cells or candidates is capped: a margin may
cover the whole grid. A link is found from either of its ends, so the recall of links is higher still.

Candidates are verified by their cosine in double precision. Cells are worked through in blocks of bounded size on both sides: a task sends on how many
links each vector has and a spanning forest of them, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import components, drop, written

#: Codebooks are fitted on at most this many distinct vectors and numbers (the vectors first by a hash); every vector is indexed.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 22
#: Vectors of a cell aimed at, codewords of a half at most.
PER_CELL, MOST_WORDS = 32, 512
#: Vectors whose true neighbours, and random ones, set the margin.
PROBES, RANDOM = 256, 1024
#: Share of neighbours whose cell is visited.
RECALL = 0.995
#: Vectors on either side of a block; a cell row (label, first codeword) with more is dealt over a grid of blocks.
BLOCK = 4096
#: Steps in which margins are counted; the last holds all larger ones.
STEPS, STEP = 4096, 1 / 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the scale is taken out first, so that neither very small nor very large components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means; an empty codeword moves to a random vector."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, added up in one order, so that a vector gets the same ones in whatever batch it comes."""
    d = np.zeros((len(x), len(c)))
    for t in range(x.shape[1]):
        d += (x[:, t, None] - c[None, :, t]) ** 2
    return d


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray, margin: float = 0.0):
        self.first, self.second, self.margin = first, second, margin

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return distances(x[:, :h], self.first), distances(x[:, h:], self.second)

    def bound(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """The largest sum of distances of a visited cell, with room for rounding: codewords may be all but equal."""
        return d1.min(axis=1) + d2.min(axis=1) + (self.margin + 1e-9)

    def visited_rows(self, d1: np.ndarray, d2: np.ndarray) -> list[np.ndarray]:
        """For each vector the first codewords of visited cells, nearest first."""
        order = np.argsort(d1, axis=1, kind="stable")
        last = self.bound(d1, d2) - d2.min(axis=1)
        n = (np.take_along_axis(d1, order, 1) <= last[:, None]).sum(axis=1)
        return [o[: max(1, k)] for o, k in zip(order.astype(np.int32), n)]

    @classmethod
    def fit(cls, x: np.ndarray, k: int, seed: int = 5) -> MultiIndex:
        """``x``: unit vectors, the sample; ``k``: codewords of a half."""
        rng = np.random.default_rng(seed)
        h = max(1, x.shape[1] // 2)
        k = min(k, len(x))
        return cls(codebook(x[:, :h], k, rng), codebook(x[:, h:], k, rng))

    def margins(self, probes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What margin each probe (a row) needs to visit the home cells of each other vector (a column)."""
        d1, d2 = self.halves(probes)
        o1, o2 = self.halves(others)
        i, j = o1.argmin(axis=1), o2.argmin(axis=1)
        return d1[:, i] + d2[:, j] - (d1.min(axis=1) + d2.min(axis=1))[:, None]


def random_margins(index: MultiIndex, x: np.ndarray, threshold: float, seed: int = 6) -> np.ndarray:
    """Margins that neighbours at the threshold need: in random directions, and in those in which the vectors themselves differ."""
    rng = np.random.default_rng(seed)
    own = x[rng.integers(len(x), size=RANDOM)]
    out = []
    for away in (rng.normal(size=own.shape), x[rng.integers(len(x), size=RANDOM)] - x[rng.integers(len(x), size=RANDOM)]):
        away = away - (away * own).sum(axis=1, keepdims=True) * own
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        other = threshold * own + (1 - threshold**2) ** 0.5 * away / np.where(norm > 0, norm, 1)
        d1, d2 = index.halves(own)
        o1, o2 = index.halves(unit(other))
        at = np.arange(len(own))
        out.append(d1[at, o1.argmin(axis=1)] + d2[at, o2.argmin(axis=1)] - d1.min(axis=1) - d2.min(axis=1))
    return np.concatenate(out)


def steps(margins: np.ndarray) -> np.ndarray:
    """Margins as numbers of steps, rounded up."""
    return np.minimum(np.ceil(margins / STEP - 1e-7), STEPS).astype(np.int64)


def least_margin(counts: np.ndarray, recall: float) -> float:
    """The least margin that covers the share ``recall`` of ``counts`` (by step); without counts 0. The last step means all cells."""
    if not counts.sum():
        return 0.0
    at = int(np.searchsorted(np.cumsum(counts), recall * counts.sum() - 1e-9))
    return np.inf if at >= STEPS else at * STEP


def links_of(index: MultiIndex, row: int, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links between members (``a``) and visitors (``b``) of one row of cells, each as (keys, copies, unit vectors).

    A pair is found at the home of one if the other visits it. Where both places find it, that with the smaller number counts; of members of one
    cell, which visit it too, the pair in the order of keys. Returns links per key, weighted by copies, and edges of a spanning forest.
    """
    words = len(index.second)
    (ka, ca, xa), (kb, cb, xb) = a, b
    nodes, where = np.unique(np.concatenate([ka, kb]), return_inverse=True)
    ia, ib = where[: len(ka)], where[len(ka) :]
    n, root = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    (a1, a2), (b1, b2) = index.halves(xa), index.halves(xb)
    ha, hb = a1.argmin(axis=1) * words + a2.argmin(axis=1), b1.argmin(axis=1) * words + b2.argmin(axis=1)
    most_a, most_b = index.bound(a1, a2), index.bound(b1, b2)
    edges: list[tuple[int, int]] = []
    mine = ha // words == row
    for cell in np.unique(ha[mine]):
        own = np.flatnonzero(mine & (ha == cell))
        seen = np.flatnonzero(b1[:, row] + b2[:, cell % words] <= most_b)
        for at in range(0, len(seen), 1024):
            part = seen[at : at + 1024]
            hit = xa[own] @ xb[part].T >= threshold
            for other in np.unique(hb[part]):
                cols = np.flatnonzero(hb[part] == other)
                if other == cell:
                    hit[:, cols] &= ka[own][:, None] < kb[part][cols][None, :]
                elif other < cell:  # the pair counts there if the member visits that cell
                    hit[np.ix_(a1[own, other // words] + a2[own, other % words] <= most_a[own], cols)] = False
            if not hit.any():
                continue
            np.add.at(n, ia[own], hit @ cb[part])
            np.add.at(n, ib[part], ca[own] @ hit)
            # least root over the links, until nothing changes: a forest of stars
            while True:
                ra, rb = root[ia[own]], root[ib[part]]
                least = np.minimum(ra, np.where(hit, rb[None, :], len(nodes)).min(axis=1))
                back = np.minimum(rb, np.where(hit, least[:, None], len(nodes)).min(axis=0))
                if (least == ra).all() and (back == rb).all():
                    break
                for i, old, new in ((ia[own], ra, least), (ib[part], rb, back)):
                    for u in np.flatnonzero(new < old):
                        edges.append((int(old[u]), int(new[u])))
                    np.minimum.at(root, i, new)
    return {int(nodes[i]): int(n[i]) for i in np.flatnonzero(n)}, sorted({(int(nodes[u]), int(nodes[v])) for u, v in edges})


def near_duplicates(df: DataFrame, id_col: str, vec_col: str, label_col: str, threshold: float = 0.98, recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: ``vec_id`` long, ``n_links`` long, ``component_id`` long, ``kept`` boolean.

    Vectors are compared only within equal, not null labels (and equal lengths) and link at a cosine of ``threshold`` or more. Those that
    are null, empty, zero or hold null or non-finite components link with nothing. Equal vectors of a label are one class in
    the index and count as often as they occur. A row without an id has no links; its component is null and it is kept. Rows that share an id
    have each its own links. Other columns are not read; an empty table gives an empty result. ``recall`` 1 finds the neighbours
    of all probes; a margin of infinity (every cell) would be exact.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("fine"), F.xxhash64("label", "v")))
    slim = written(rows.select("vec_id", "key"))
    classes = rows.where("fine").groupBy("key", "label", "v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("part", F.concat_ws("/", F.size("v"), "label")).drop("label"))
    n, comp = _links(classes, threshold, recall)
    least = comp.join(classes.select("key", "cid"), comp.id == F.col("key")).groupBy("component_id").agg(F.min("cid").alias("least"))
    of = comp.join(least, "component_id").select(F.col("id").alias("key"), "least")
    per = classes.select("key", "cid", "copies").join(n, "key", "left").join(of, "key", "left")
    per = written(per.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "cid").alias("component_id")))
    drop(classes)
    out = slim.join(per, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``n``) and (``id``, ``component_id``) of classes that link with others."""
    spark = classes.sparkSession
    # an index for each length of vectors
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("part").alias("parts")).orderBy(F.desc("n"), "d").collect()
    found = spark.createDataFrame([], "key long, n long, other long")
    used, tables = [], []
    for d, n, parts in lengths:
        if n > 1:
            one = classes.where(F.size("v") == d)
            used.append(spark.sparkContext.broadcast(fitted(one, d, n, parts, threshold, recall)))  # codebooks: at most 2 * MOST_WORDS half vectors
            links, placed = _links_of_length(one, d, used[-1], threshold)
            found, tables = found.unionByName(links), [*tables, *placed]
    found = written(found)
    drop(*tables)
    for shared in used:
        shared.destroy()
    n = found.where("other IS NULL").groupBy("key").agg(F.sum("n").alias("n"))
    return n, components(found.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))


def fitted(classes: DataFrame, d: int, n: int, parts: int, threshold: float, recall: float) -> MultiIndex:
    """An index of ``n`` classes (``key``, ``part``, ``v`` of length ``d``) in ``parts`` parts, with its margin."""
    spark = classes.sparkSession
    vectors = _vectors_of(d)
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(max(2, min(SAMPLE, SAMPLE_NUMBERS // d))).select("key", "part", "v").toArrow()
    x = vectors(sample.column(2).combine_chunks())
    index = MultiIndex.fit(x, int(min(max(2, round((n / max(1, parts) / PER_CELL) ** 0.5)), MOST_WORDS)))
    parts_of = {p: i for i, p in enumerate(dict.fromkeys(sample.column(1).to_pylist()[:PROBES]))}
    shared = spark.sparkContext.broadcast((index, x[:PROBES], sample.column(0).to_numpy()[:PROBES], np.array([parts_of[p] for p in sample.column(1).to_pylist()[:PROBES]])))

    # the probes against all vectors, in blocks; what comes back is counts of margins
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, probes, keys, parts = shared.value
        total = np.zeros(STEPS + 1, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                other = vectors(b.column(2))
                same = parts[:, None] == np.array([parts_of.get(p, -1) for p in b.column(1).to_pylist()])[None, :]
                hit = (probes @ other.T >= threshold) & same & (keys[:, None] != b.column(0).to_numpy()[None, :])
                near = np.flatnonzero(hit.any(axis=0))
                if len(near):
                    total += np.bincount(steps(index.margins(probes, other[near])[hit[:, near]]), minlength=STEPS + 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["step", "n"])

    counts = np.zeros(STEPS + 1, dtype=np.int64)
    for step, k in classes.select("key", "part", "v").mapInArrow(measure, "step long, n long").groupBy("step").agg(F.sum("n")).collect():
        counts[step] = k
    shared.destroy()
    index.margin = max(least_margin(counts, recall), least_margin(np.bincount(steps(random_margins(index, x, threshold)), minlength=STEPS + 1), recall))
    return index


def _vectors_of(d: int):
    def vectors(column: pa.Array) -> np.ndarray:
        return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64))

    return vectors


def _links_of_length(classes: DataFrame, d: int, shared: Broadcast, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """(``key``, ``n``, ``other``): counts to be added up, and edges. Also the tables that it reads."""
    vectors = _vectors_of(d)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = shared.value.visited_rows(*shared.value.halves(vectors(part.column(2))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], ["key", "part", "v", "copies", "rows"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = written(classes.select("key", "part", "v", "copies").mapInArrow(locate, f"key long, part string, v {kind}, copies long, rows array<int>"))
    # members of a row are dealt over blocks, and so are its visitors (members too): each pair of blocks is a task of bounded size
    seen = placed.select("part", F.posexplode("rows").alias("place", "row"))
    sizes = written(seen.groupBy("part", "row").agg(F.ceil(F.sum((F.col("place") == 0).cast("long")) / BLOCK).cast("int").alias("mine"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("theirs")))
    x = placed.select("key", "part", "v", "copies", F.posexplode("rows").alias("place", "row")).join(sizes.where("mine > 0"), ["part", "row"])
    deal = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), n).cast("int")
    visitors = x.withColumn("theirs", deal(F.col("theirs"), 1)).withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("mine") - 1))).withColumn("member", F.lit(False))
    members = x.where("place = 0").withColumn("mine", deal(F.col("mine"), 2)).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))).withColumn("member", F.lit(True))

    def solve(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        member = t.column("member").to_numpy(zero_copy_only=False).astype(bool)
        if not member.any() or member.all():
            return
        x = vectors(t.column("v").combine_chunks())
        keys, copies = (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "copies"))
        a, b = ((keys[m], copies[m], x[m]) for m in (member, ~member))
        n, edges = links_of(shared.value, key[1].as_py(), a, b, threshold)
        out = [*n, *(u for u, _ in edges)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array([*n.values(), *[None] * len(edges)], pa.int64()), pa.array([*[None] * len(n), *(v for _, v in edges)], pa.int64())], ["key", "n", "other"])

    columns = ["part", "row", "mine", "theirs", "key", "copies", "v", "member"]
    blocks = visitors.select(columns).unionByName(members.select(columns)).groupBy("part", "row", "mine", "theirs")
    return blocks.applyInArrow(solve, "key long, n long, other long"), [placed, sizes]
