"""Exact dedup by content sort, with DataFrame functions only.

Sampled splitters range-partition the normalised bytes, Spark's external sort places equal
texts next to each other, and a window walks the sorted rows, comparing each whole text with its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askframe.llm.common import ascii_lower, drop, free_name, written

#: The bytes of a text that the splitters see; a sample of whole texts could overflow the driver.
SPLITTER_CHARS = 24
#: A text with more copies than this is dealt over several ranges.
HOT_COPIES = 512


def exact_dedup(df: DataFrame, id_col: str, text_col: str, keep: str = "min", hot: int = HOT_COPIES) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the smallest id stays (``keep="max"``: the largest); a null id is smaller than any other. Of repeated
    rows with the id that stays, exactly one is kept. Other columns of ``df`` are not read. An empty
    table gives an empty result.

    A text with over ``hot`` copies (counted beforehand by hash with a map-side combine) is spread
    over several ranges by a salt made from the id. Each range settles its own run by
    comparing neighbours; the runs of one hot text are then joined by SHA-256 and length,
    one row per run, so no task holds a whole hot group.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = df.select(F.col(id_col).alias("doc_id"), norm.alias("t"), F.xxhash64(id_col, text_col).alias("row_hash")).withColumn("h", F.xxhash64("t"))
    heavy = written(docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).withColumn("salts", F.ceil(F.col("n") / hot)).drop("n"))
    x = docs.join(heavy, "h", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)))
    x = x.withColumn("head", F.substring("t", 1, SPLITTER_CHARS)).withColumn("hot", F.col("salts").isNotNull()).drop("salts")
    x = x.repartitionByRange("head", "h", "salt")
    run = Window.partitionBy("head", "h", "salt", "t")
    ordered = run.orderBy(_order("doc_id", keep))
    x = x.select(
        "doc_id", "hot", "h", "row_hash",
        F.first("doc_id").over(ordered).alias("keep_id"),
        F.row_number().over(ordered).alias("pos"),
        F.count(F.lit(1)).over(run).alias("group_size"),
        F.sha2(F.col("t"), 256).alias("text_sha256"),
        F.octet_length("t").alias("n_bytes"),
    )
    runs = written(x)
    drop(heavy)
    # Runs of one hot text: a row for each, no texts. All others are whole already.
    best = F.max if keep == "max" else F.min
    reps = runs.where("hot AND pos = 1").groupBy("h", "text_sha256", "n_bytes").agg(
        # a null id is the smallest: it stays under "min" if there is any, under "max" only if all are null
        (best("keep_id") if keep == "max" else F.when(F.max(F.col("keep_id").isNull()), F.lit(None)).otherwise(best("keep_id"))).alias("all_keep"),
        F.sum("group_size").alias("all_size"),
    )
    reps = written(reps)  # so that its size is known: a few rows for many, which need not move then
    # rows with equal ids share a salt, so of all runs only one begins with the id that stays
    y = runs.where("hot").join(reps, ["h", "text_sha256", "n_bytes"], "left")
    hot_rows = y.select("doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"), ((F.col("pos") == 1) & F.col("keep_id").eqNullSafe(F.col("all_keep"))).alias("kept"), "text_sha256", "row_hash")
    rest = runs.where("NOT hot").select("doc_id", "keep_id", "group_size", (F.col("pos") == 1).alias("kept"), "text_sha256", "row_hash")
    return rest.unionByName(hot_rows)


def _order(name: str, keep: str) -> Column:
    return F.col(name).desc_nulls_last() if keep == "max" else F.col(name).asc_nulls_first()


def drop_copies(df: DataFrame, id_col: str, text_col: str, keep: str = "min") -> DataFrame:
    """The rows of ``df``, all columns, that stay; rows that repeat an id and its text stay once.

    Copies are taken away by an anti-join with the rows that go, so the texts move only if
    those rows are too many to broadcast (Spark decides that by their size).
    """
    key, other = free_name(df, "row_hash", "other_id")
    found = written(exact_dedup(df, id_col, text_col, keep))
    gone = found.where("NOT kept").select(F.col("row_hash").alias(key), F.col("doc_id").alias(other), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again"))
    x = df.withColumn(key, F.xxhash64(id_col, text_col))
    same = lambda t: [x[key] == t[key], x[id_col].eqNullSafe(t[other])]
    # a row that goes although it has the id that stays repeats the row that is kept, or differs from it in case only
    repeats, copies = gone.where("again"), gone.where("NOT again")
    if repeats.isEmpty():
        return x.join(copies, same(copies), "left_anti").drop(key)
    once = x.join(repeats, same(repeats), "left_semi")
    t = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    same_text = free_name(df, "same_text")[0]
    once = once.withColumn(same_text, F.sha2(t, 256)).dropDuplicates([id_col, same_text]).drop(same_text)
    rest = x.join(copies, same(copies), "left_anti")
    # the kept row of a repeated one: it comes back once through `once` or is matched by its text
    return rest.join(repeats, [rest[key] == repeats[key], rest[id_col].eqNullSafe(repeats[other])], "left_anti").unionByName(once).drop(key)
