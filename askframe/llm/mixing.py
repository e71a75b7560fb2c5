"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies. The prefix sum of
expected copies, plus one offset for the source, crosses integers; a document is emitted once for each
integer that its part of the sum crosses. Documents are lined up by size, so every stretch of sizes is
drawn at the same rate. Of ``OFFSETS`` evenly spread offsets the one is drawn whose words come nearest to the source's target (of equals, one by
the seed): how many words each offset takes follows from two events per document, added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askframe.llm.common import drop, free_name, rank_within, words, written

#: Rows of one (source, size) numbered by one window.
PER_BUCKET = 512
#: Offsets that a source's one is drawn from.
OFFSETS = 1021


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """A row per source of ``sizes`` (``source``, ``size``): ``source_size``, ``target``.

    Sources in code-point order, null last, get ``weights`` in turn and share
    ``share`` times all sizes by weight. A target stops at ``most`` times the source's size; what is over goes to the
    others by weight until none is above. If all sources fill up, each stays at its cap. Sources may be many: they are sorted in ranges, and each round of sharing is
    one sum over them.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    x = written(own.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()))
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    # rows before each range, a number per range
    starts, before = [], 0
    for p, n in sorted(tuple(r) for r in x.groupBy(part).count().collect()):
        starts += [F.lit(p), F.lit(before % len(weights))]
        before += n
    turn = ((F.element_at(F.create_map(*starts), part) if starts else F.lit(0)) + place) % len(weights)
    x = x.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    total = float(share) * float(x.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full, open_ = -1.0, 0.0, x.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    while open_ and (total - full) / open_ > level:
        level = (total - full) / open_
        over = F.col("cap") <= F.lit(level) * F.col("w")
        full, open_ = x.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
    return x.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def mix(df: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 0) -> DataFrame:
    """``df`` (written once to the shared folder) with ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` is a long column expression, never null. ``copies`` is how often the mix takes the row: the floor or ceiling of target / source_size,
    at most ``most`` rounded up. Sources of size 0 take nothing. A null source is a source of its own. Rows that repeat an
    id are separate rows. Reruns give the same counts for the same rows. An empty table gives an empty result.
    Columns of ``df`` with these four names are replaced.
    """
    src, key, rank, before, n, at, offset, row, same, keys = free_name(df, "src_key", "mix_key", "mix_rank", "mix_before", "mix_n", "mix_salts", "mix_offset", "mix_row", "mix_id", "mix_keys")
    base = df.drop("size", "source_size", "target", "copies").withColumn("size", size)
    # never null, and one to one with the source
    base = written(base.withColumn(src, F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))))
    goal = targets(base.select(F.col(source_col).alias("source"), "size"), weights, share, most)
    goal = goal.select(F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias(src), "source_size", "target")
    # rows per (source, size), and how many rows of the source are smaller
    per = base.groupBy(src, "size").agg(F.count(F.lit(1)).alias(n))
    per = per.withColumn(before, F.sum(n).over(Window.partitionBy(src).orderBy("size")) - F.col(n))
    per = per.withColumn(at, F.ceil(F.col(n) / PER_BUCKET)).withColumn(key, F.concat(F.col("size").cast("string"), F.lit("/"), F.col(src)))
    per = written(per.join(goal, src).drop(n))
    joined = written(base.join(per, [src, "size"]).withColumn(row, F.monotonically_increasing_id()))
    drop(base, per)
    # rows of one id, source and size that are very many are dealt by their row number too
    many = written(joined.groupBy(key, F.col(id_col).alias(same)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > PER_BUCKET).withColumn(n, F.ceil(F.col(n) / PER_BUCKET)).withColumnRenamed(key, keys))
    dealt = joined.join(many, (F.col(key) == F.col(keys)) & F.col(id_col).eqNullSafe(F.col(same)), "left")
    dealt = dealt.withColumn(n, F.when(F.col(n).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(row), F.col(n)))).drop(keys, same, row)
    x = rank_within(dealt, key, [id_col, n], F.col(at), rank)
    x = written(x)
    drop(joined, many)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col(before) + F.col(rank)
    drawn = _offsets(x, src, rate, place * rate, seed, offset)
    at = (F.coalesce(F.col(offset), F.lit(0)) + 0.5) / OFFSETS
    crossed = F.floor((place + 1) * rate + at) - F.floor(place * rate + at)
    keep = [c for c in df.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    return x.join(drawn, src, "left").withColumn("copies", crossed.cast("long")).select(*keep, "size", "source_size", "target", "copies")


def _offsets(x: DataFrame, src: str, rate: Column, start: Column, seed: int, name: str) -> DataFrame:
    """The offset (0 to ``OFFSETS`` - 1) drawn for each source.

    A row is taken one time more than its rate's floor by the offsets of one interval (cyclic, as long as the rate's fraction): its words
    come in at one offset and go out at another. Sums of these events give the words that each offset takes.
    """
    part = rate - F.floor(rate)
    first = F.pmod(1 - part - (start - F.floor(start)), F.lit(1.0))
    a, e = (F.ceil(c * OFFSETS - 0.5).cast("long") for c in (first, first + part))
    event = lambda j, words_: F.struct((j % OFFSETS).alias("j"), words_.alias("w"))
    around = F.floor(e / OFFSETS) - F.floor(a / OFFSETS)
    events = F.array(event(F.lit(0).cast("long"), F.col("size") * around), event(a, F.col("size")), event(e, -F.col("size")))
    sums = x.where((F.col("size") > 0) & (part > 0)).select(src, "source_size", "target", F.explode(events).alias("e")).groupBy(src, "source_size", "target", "e.j").agg(F.sum("e.w").alias("w"))
    taken = F.col("source_size") * F.floor(F.col("target") / F.col("source_size")) + F.sum("w").over(Window.partitionBy(src).orderBy("j"))  # at most OFFSETS rows a source
    best = sums.withColumn("err", F.abs(taken - F.col("target"))).groupBy(src).agg(F.min(F.struct("err", F.xxhash64(F.lit(seed), src, "j"), F.col("j").alias("j"))).alias("best"))
    return written(best.select(src, F.col("best.j").alias(name)))


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, each row repeated as often as it is taken, columns as in ``docs``.

    Ids, sources and sizes are mixed on their own; texts move once, to meet the result by these three. Rows that
    agree in them share out their numbers of copies in any order.
    """
    size, n, rows, total, time, i, s, z = free_name(docs, "size", "n", "rows", "total", "time", "id_key", "source_key", "size_key")
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("n_words"))
    mixed = mix(slim, "doc_id", "source", F.col("n_words"), seed=seed)
    taken = mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)).where(F.col(total) > 0)
    taken = written(taken.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z), total, rows))
    x = docs.withColumn(size, words(F.col("text")))
    x = x.join(taken, x.doc_id.eqNullSafe(taken[i]) & x.source.eqNullSafe(taken[s]) & (x[size] == taken[z]))
    once = x.where(F.col(rows) == 1).withColumn(n, F.col(total))
    if not taken.where(F.col(rows) > 1).isEmpty():
        place = F.row_number().over(Window.partitionBy(i, s, z).orderBy("text")) - 1
        several = x.where(F.col(rows) > 1).withColumn(n, F.floor(F.col(total) / F.col(rows)) + (place < F.col(total) % F.col(rows)).cast("long"))
        once = once.unionByName(several.where(F.col(n) > 0))
    return once.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
