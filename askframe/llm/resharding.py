"""Resharding by minimum-cost flow.

Old shard sizes and new capacities make a transport problem: a byte that stays costs nothing, a byte that
moves costs one. The flow names blocks (how many bytes go from which old shard to which new one). Rows of one old shard and one group (such as
equal texts) are a unit and stay together, unless the unit is larger than a whole new shard. Units that are large against a shard are
placed one by one, at home if they fit; all others are lined up inside their old shard by hash and cut into the blocks of the flow. So a row's new
shard follows from its old one and its group's hash by a short table, and texts move once, when the shards are written. Only shards that a block
leaves or enters are rewritten, into new folders.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askframe.llm.common import drop, free_name, written

#: A unit over 1 / FINE of a shard is placed by itself, so the driver sees at most FINE units for each shard.
FINE = 256
#: Hash ranges in which the other units of an old shard are cut.
BINS = 4096
#: Bytes of one file of a shard, about.
FILE_BYTES = 128 << 20


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a largest flow of least cost.

    Successive shortest paths with potentials; nodes and arcs are a few for each shard.
    """
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        for x, y, k, p in ((u, v, c, w), (v, u, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(p)
    potential = [0] * n
    while True:
        dist, via, queue = [None] * n, [-1] * n, [(0, source)]
        dist[source] = 0
        done = [False] * n
        while queue:
            d, u = heapq.heappop(queue)
            if done[u]:
                continue
            done[u] = True
            for e in head[u]:
                if cap[e] > 0 and not done[to[e]]:
                    new = d + cost[e] + potential[u] - potential[to[e]]
                    if dist[to[e]] is None or new < dist[to[e]]:
                        dist[to[e]], via[to[e]] = new, e
                        heapq.heappush(queue, (new, to[e]))
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        far = max(d for d in dist if d is not None)
        potential = [p + (far if d is None else d) for p, d in zip(potential, dist)]
        path, u = [], sink
        while u != source:
            path.append(via[u])
            u = to[via[u] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def transfers(old: dict[int, int], new: dict[int, int]) -> list[tuple[int, int, int]]:
    """Blocks (old shard, new shard, bytes) that move the fewest bytes; the new capacities hold at least the old bytes.

    A shard keeps what it can for nothing; all other bytes pass one middle node at a cost of one, so the network has
    a few arcs per shard instead of one per pair. What enters and leaves the middle is paired in order.
    """
    olds, news = sorted(old), sorted(new)
    left, right = {s: 2 + i for i, s in enumerate(olds)}, {s: 2 + len(olds) + i for i, s in enumerate(news)}
    middle = 2 + len(olds) + len(news)
    arcs = [(0, left[s], old[s], 0) for s in olds] + [(right[s], 1, new[s], 0) for s in news]
    stay = [s for s in olds if s in right]
    big = sum(old.values()) + 1
    first = len(arcs)
    arcs += [(left[s], right[s], big, 0) for s in stay]
    arcs += [(left[s], middle, big, 1) for s in olds] + [(middle, right[s], big, 0) for s in news]
    flow = min_cost_flow(middle + 1, arcs, 0, 1)
    out = [(s, s, f) for s, f in zip(stay, flow[first:]) if f]
    leaves = [[s, f] for s, f in zip(olds, flow[first + len(stay) :]) if f]
    enters = [[s, f] for s, f in zip(news, flow[first + len(stay) + len(olds) :]) if f]
    while leaves and enters:
        block = min(leaves[0][1], enters[0][1])
        out.append((leaves[0][0], enters[0][0], block))
        for side in (leaves, enters):
            side[0][1] -= block
            if not side[0][1]:
                side.pop(0)
    return out


def level(loads: list[int], fill: int) -> list[int]:
    """What each of ``loads`` gets of ``fill``, so that all come out as equal as can be (within one where they get anything)."""
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    used, top = 0, 0
    while used < len(order) and loads[order[used]] * (used + 1) - (top + loads[order[used]]) < fill:
        top += loads[order[used]]
        used += 1
    out = [0] * len(loads)
    if used:
        each, more = divmod(fill + top, used)
        for rank, i in enumerate(order[:used]):
            out[i] = each + (rank < more) - loads[i]
    return out


def place_large(units: list[tuple[int, int]], shards: int, capacity: int) -> list[int]:
    """New shards of units (old shard, bytes), given largest first: at home while that holds them, else where least lies so far."""
    loads = [0] * shards
    queue = [(0, s) for s in range(shards)]
    out = []
    for old, size in units:
        to = old if 0 <= old < shards and loads[old] + size <= capacity else None
        while to is None:
            load, s = heapq.heappop(queue)
            if load == loads[s]:
                to = s
        loads[to] += size
        heapq.heappush(queue, (loads[to], to))
        out.append(to)
    return out


def reshard(df: DataFrame, id_col: str, old: Column, size: Column, shards: int, group: Column | None = None) -> DataFrame:
    """``df`` with ``size``, ``old_shard``, ``shard`` and ``slot``.

    ``old`` (int) and ``size`` (long above 0) are expressions without nulls. New capacities are equal; shards come out equal within about 1 / FINE of
    a shard, or within the largest unit where that is more. Rows of equal ``group`` (any expression; without it each row is alone) and equal ``old`` stay
    together if a shard can hold them; of a larger group rows go by a hash of their id. ``slot`` numbers a shard's rows from 0, gapless. What reaches the
    driver is at most FINE units for each new shard, one row for each old shard, and the blocks of the flow. Nulls in the id,
    repeated rows and an empty table are allowed; columns of ``df`` with these names are replaced.
    """
    spark = df.sparkSession
    made = ("size", "old_shard", "shard", "slot")
    key, parts, to, cuts, file, start, files, own, home, size_ = free_name(df, "unit_key", "unit_parts", "unit_to", "unit_cuts", "file_no", "file_start", "file_n", "unit_hash", "unit_old", "unit_size")
    keep = [c for c in df.columns if c.lower() not in made]
    x = df.withColumn(size_, size.cast("long")).withColumn(home, old.cast("int")).withColumn(key, F.xxhash64(group if group is not None else F.col(id_col)))
    slim = written(x.select(F.col(id_col).alias("id"), F.col(size_).alias("size"), F.col(home).alias("old"), F.col(key).alias("key")))
    total, n_rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    capacity = -(-total // shards)
    units = slim.groupBy("old", "key").agg(F.sum("size").alias("bytes"))
    # fewer than `shards` units are larger than a shard
    huge = [tuple(r) for r in units.where(F.col("bytes") > capacity).select("old", "key", (2 * F.ceil(F.col("bytes") / max(1, capacity))).cast("int")).collect()]
    huge = F.broadcast(spark.createDataFrame(huge, f"`{home}` int, `{key}` long, `{parts}` int"))

    def hashed(x: DataFrame, id_: Column) -> DataFrame:
        x = x.join(huge, [home, key], "left")
        return x.withColumn(own, F.when(F.col(parts).isNull(), F.col(key)).otherwise(F.xxhash64(F.col(key), F.pmod(F.xxhash64(id_), F.col(parts))))).drop(parts)

    slim_ = written(hashed(slim.withColumnsRenamed({"old": home, "key": key}), F.col("id")).select("id", "size", F.col(home).alias("old"), F.col(own).alias("h")))
    drop(slim)
    slim = slim_
    units = written(slim.groupBy("old", "h").agg(F.sum("size").alias("bytes")))
    large = units.where(F.col("bytes") > capacity // FINE).orderBy(F.desc("bytes"), "old", "h").collect()  # fewer than FINE * shards
    placed = place_large([(r.old, r.bytes) for r in large], shards, capacity)
    loads = [0] * shards
    for r, s in zip(large, placed):
        loads[s] += r.bytes
    # the rest, by hash ranges
    bin_ = lambda h: F.shiftrightunsigned(h, 64 - (BINS - 1).bit_length()).cast("int")
    bins = units.where(F.col("bytes") <= capacity // FINE).groupBy("old", bin_(F.col("h")).alias("bin")).agg(F.sum("bytes").alias("bytes"))
    bins = written(bins.withColumn("middle", F.sum("bytes").over(Window.partitionBy("old").orderBy("bin")) - F.floor(F.col("bytes") / 2)))
    sizes = {r[0]: r[1] for r in bins.groupBy("old").agg(F.sum("bytes")).collect()}
    fill = level(loads, sum(sizes.values()))
    blocks, at = [], {}
    for o, s, b in sorted(transfers(sizes, dict(enumerate(fill))), key=lambda x: (x[0], x[0] != x[1], x[1])):
        blocks.append((o, s, at.get(o, 0), at.get(o, 0) + b))
        at[o] = at.get(o, 0) + b
    ends: dict[int, list] = {}
    inside = bins.join(F.broadcast(spark.createDataFrame(blocks, "old int, shard int, first long, last long")), "old").where("middle > first AND middle <= last")  # a few blocks for each shard
    for r in inside.groupBy("old", "shard", "first").agg(F.max("bin").alias("bin")).orderBy("old", "bin").collect():
        ends.setdefault(r.old, []).append((r.bin, r.shard))
    drop(units, bins)
    cut = F.broadcast(spark.createDataFrame(list(ends.items()), f"`{home}` int, `{cuts}` array<struct<bin:int,shard:int>>"))
    alone = F.broadcast(spark.createDataFrame([(r.old, r.h, s) for r, s in zip(large, placed)], f"`{home}` int, `{own}` long, `{to}` int"))
    expected = {s: loads[s] + fill[s] for s in range(shards)}
    per_shard = F.create_map(*[F.lit(v) for s, n in expected.items() for v in (s, max(1, -(-n // FILE_BYTES)))])

    def located(x: DataFrame, id_: Column) -> DataFrame:
        x = x.join(alone, [home, own], "left").join(cut, home, "left")
        later = F.filter(cuts, lambda c: c["bin"] >= bin_(F.col(own)))
        x = x.withColumn("shard", F.coalesce(F.col(to), F.get(later, F.lit(0))["shard"], F.element_at(cuts, -1)["shard"])).drop(to, cuts)
        return x.withColumn(file, F.pmod(F.xxhash64(id_, F.col(own)), F.element_at(per_shard, F.col("shard"))))

    counts = located(slim.withColumnsRenamed({"old": home, "h": own}), F.col("id")).groupBy("shard", file).agg(F.count(F.lit(1)).alias(files))
    starts = written(counts.select("shard", file, (F.sum(files).over(Window.partitionBy("shard").orderBy(file)) - F.col(files)).alias(start)))
    drop(slim)
    x = located(hashed(x.drop(*made), F.col(id_col)), F.col(id_col))
    line = Window.partitionBy("shard", file).orderBy(F.col(id_col).asc_nulls_first(), own)
    x = x.withColumn("slot", F.row_number().over(line).cast("long") - 1).join(starts, ["shard", file])
    return x.select(*keep, F.col(size_).alias("size"), F.col(home).alias("old_shard"), "shard", (F.col("slot") + F.col(start)).alias("slot"))


def write_shards(df: DataFrame, path: str) -> dict[int, str]:
    """Files of a sharded table: one folder for each value of ``shard``, rows by ``slot``; returns the layout, a folder for each shard.

    A result of :func:`reshard` comes in ranges of slots of about ``FILE_BYTES``, a task and file each, however large a shard is.
    """
    df.write.partitionBy("shard").mode("errorifexists").parquet(path)
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    return {int(n.removeprefix("shard=")): f"{path}/{n}" for n in names if n.startswith("shard=")}


def read_shards(df: DataFrame, layout: dict[int, str]) -> DataFrame:
    """The rows of a layout, with ``shard`` from their folder; ``df`` has the columns."""
    spark = df.sparkSession
    files = df.drop("shard").schema
    out = spark.createDataFrame([], files).withColumn("shard", F.lit(0))
    roots: dict[str, list[str]] = {}
    for folder in layout.values():
        roots.setdefault(folder.rsplit("/", 1)[0], []).append(folder)
    for root, folders in sorted(roots.items()):
        out = out.unionByName(spark.read.schema(files).option("basePath", root).parquet(*folders))
    return out


def rewrite_affected(moved: DataFrame, layout: dict[int, str], path: str) -> dict[int, str]:
    """Write the shards that rows leave or enter below the new folder ``path``, and return the new layout.

    ``moved`` is a result of :func:`reshard`; ``layout`` says where its old shards lie. Other shards keep their folders, and nothing is deleted, so
    a job that dies halfway leaves the old layout whole. A shard without rows has no folder.
    """
    changed = moved.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    affected = sorted({r[0] for r in changed.collect()} | {s for s, in moved.select("shard").distinct().collect() if s not in layout})  # at most the number of shards
    new = write_shards(moved.where(F.col("shard").isin(affected)), path)
    return {s: f for s, f in layout.items() if s not in affected} | new
