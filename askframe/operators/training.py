"""Learning intents from a seed corpus and from questions that were answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askframe.plans.intent import IntentModel

#: Newest answered questions that are looked at (a training window, newest first).
NEWEST = 5000
_ENTITIES = ("customers", "orders", "suppliers", "parts", "employees", "products", "events")
#: Question frames for each intent; each is filled with a few entities.
FRAMES = {
    "count": ("how many {} are there", "count of {}", "number of {} in the region", "total {}", "count all {}"),
    "exists": ("are there any {}", "is there a record in {}", "do we have any {}", "any {} without a name", "does the list of {} have pending ones"),
    "list": ("list all {}", "show me the {}", "display {} with their details", "which {} are active", "give me {} named Smith"),
    "sum": ("sum of the amount of {}", "total price of {}", "total amount for {}", "add up the quantity of {}"),
    "avg": ("average price of {}", "mean amount per record in {}", "what is the average size of {}"),
    "min": ("lowest price among {}", "earliest date of {}", "minimum balance of {}", "cheapest of the {}"),
    "max": ("highest price among {}", "latest date of {}", "maximum balance of {}", "largest of the {}"),
    "top": ("top 5 {} by price", "top 10 {} by amount", "best 3 {} by total", "top {} by balance"),
}


def seed_corpus() -> list[tuple[str, str]]:
    out = []
    for label, frames in FRAMES.items():
        for i, f in enumerate(frames):
            out += [(f.format(e), label) for e in (_ENTITIES[i % 7], _ENTITIES[(i + 3) % 7], _ENTITIES[(i + 5) % 7])]
    return out


def intent_of_sql(sql: Column) -> Column:
    """The intent that a statement's shape shows; null for none. A comparison of a count is an existence check."""
    shape = lambda p: sql.rlike(f"(?is){p}")
    return (
        F.when(shape(r"order\s+by.+desc.*limit"), "top")
        .when(shape(r"count\s*\(\s*\*?[^)]*\)\s*>\s*0"), "exists")
        .when(shape(r"\bcount\s*\("), "count")
        .when(shape(r"\bsum\s*\("), "sum")
        .when(shape(r"\bavg\s*\("), "avg")
        .when(shape(r"\bmin\s*\("), "min")
        .when(shape(r"\bmax\s*\("), "max")
        .when(shape(r"^\s*select\b"), "list")
    )


def harvest(history: DataFrame, newest: int = NEWEST) -> DataFrame:
    """Labelled questions (``question``, ``label``, ``id``) of the newest answered rows."""
    ok = history.where("status = 'ok' AND question IS NOT NULL AND sql IS NOT NULL").orderBy(F.col("id").desc()).limit(newest)
    x = ok.select(F.trim("question").alias("question"), intent_of_sql(F.col("sql")).alias("label"), "id")
    return x.where("label IS NOT NULL AND question <> ''")


def merge(seed: DataFrame, found: DataFrame) -> DataFrame:
    """Both, without repeats (case and blanks aside): seed rows win, then newer ones. Adds ``origin``."""
    both = seed.select("question", "label", F.lit(0).alias("id"), F.lit("seed").alias("origin")).unionByName(found.select("question", "label", "id", F.lit("history").alias("origin")))
    first = Window.partitionBy(F.lower(F.trim("question"))).orderBy(F.desc("origin"), F.desc("id"), "label")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "id")


def train(spark: SparkSession, history: DataFrame | None, path: str) -> dict:
    """Fit, save, report. What reaches the driver is the seed and at most ``NEWEST`` questions."""
    seed = spark.createDataFrame(seed_corpus(), "question string, label string")
    found = harvest(history) if history is not None else spark.createDataFrame([], "question string, label string, id bigint")
    rows = merge(seed, found).orderBy("question").collect()
    model = IntentModel.fit([(r.question, r.label) for r in rows])
    model.save(path)
    n = {k: sum(r.origin == k for r in rows) for k in ("seed", "history")}
    return {"examples": len(rows), "labels": model.labels, "path": path, "from_seed": n["seed"], "from_history": n["history"], "total_unique": len(rows)}
