"""What several operators of this subpackage share: shared tables, ranks, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words in every word-based operator: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a temporary folder of its
    own; on a cluster that would not be shared, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="askframe-"))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per Spark application; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_askframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="askframe-py-")) / "askframe.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))  # the driver serves the file to all executors
    sc._askframe_shipped = True


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/askframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._askframe_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._askframe_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of ASCII only take the quicker built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that do not clash with any column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def rank_within(df: DataFrame, key: str, by: list[str], salts: Column, out: str) -> DataFrame:
    """Number the rows of each ``key`` from 0 in a deterministic order, gapless, without one task per key.

    ``key`` holds no nulls. Rows of a key are dealt by a hash of ``by`` over ``salts``
    (a column that is constant within a key) buckets; a bucket is numbered by a window, and starts
    after the counts of the buckets before it, which a partial aggregation brings together.
    ``df`` is read twice, so pass a table. Rows equal in ``by`` get numbers in any order.
    """
    bucket, n, start = free_name(df, "bucket", "n", "start")
    x = df.withColumn(bucket, F.pmod(F.xxhash64(*by), salts))
    starts = x.groupBy(key, bucket).agg(F.count(F.lit(1)).alias(n))
    starts = starts.withColumn(start, F.sum(n).over(Window.partitionBy(key).orderBy(bucket)) - F.col(n)).drop(n)
    own = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in by])) - 1
    x = x.withColumn(out, own.cast("long"))
    return x.join(starts, [key, bucket]).withColumn(out, F.col(out) + F.col(start)).drop(bucket, start).select(*df.columns, out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each id that has a link: columns ``id``, ``component_id``.

    Alternating large-star and small-star steps. Each step sends a node's neighbours to the smallest
    one by a minimum (combined before the shuffle) and a join (which Spark splits where
    one node has very many neighbours); the links never meet in one task or on the driver. Steps are written
    to the shared folder. The number of steps grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = written(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    state = None
    while True:
        # now: u > v. Large star: a node's larger neighbours go to its smallest neighbour or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours and itself go to the smallest of them.
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        seen = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop(now)
        now = new
        if seen == state:
            break
        state = seen
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    out = ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
    out._askframe_path = now._askframe_path  # for :func:`drop`
    return out
