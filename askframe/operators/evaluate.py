"""Differential evaluation: generated questions, result signatures, verdicts."""

from __future__ import annotations

import csv
import json
import random
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.functions.text import lemma
from askframe.operators.annotate import words_of
from askframe.plans.planner import namelike
from askframe.sources.catalog import Catalog

#: Rows of a result that its signature covers, and its length in hex digits.
SIGNED_ROWS, SIGNATURE = 100, 16


def questions(catalog: Catalog, values: dict[tuple[str, str], list[str]] | None = None, n: int = 500, seed: int = 42) -> list[tuple[str, str]]:
    """(bucket, question) over a catalog, shuffled by a seed, without repeats; ``values`` fill the quoted filters."""
    out: list[tuple[str, str]] = []
    for t in catalog.tables:
        many = " ".join(words_of(t.name))
        many = many if many.endswith("s") else many[:-1] + "ies" if many.endswith("y") else many + "s"
        out += [("count", f"how many {many} are there"), ("count", f"count {many}"), ("list_basic", f"list all {many}"), ("list_basic", f"show {many}"), ("exists", f"are there any {many}")]
        for c in t.columns:
            said = " ".join(c.synonyms[:1] or words_of(c.name))
            if c.kind == "numeric" and not c.pk and not c.fk:
                out += [("aggregate", f"{word} {said} of {many}") for word in ("average", "sum of", "highest", "lowest")]
                out += [("top_N", f"top {k} {many} by {said}") for k in (3, 5, 10)]
            elif c.kind == "date":
                out += [("aggregate", f"earliest {said} of {many}"), ("aggregate", f"latest {said} of {many}")]
            elif c.kind == "boolean":
                out += [("boolean", f"list {many} that are {said}"), ("boolean", f"list {many} that are not {said}")]
            if c.kind and not c.pk:
                out.append(("is_null", f"{many} where {lemma(said.split()[-1])} is null"))
            for v in (values or {}).get((t.name, c.name), [])[:3]:
                out.append(("quoted_filter", f"list {many} with {said} '{v}'"))
        for c in t.columns:
            if c.fk and (other := catalog.table(c.fk.rsplit(".", 1)[0])):
                out.append(("join_explicit", f"show {many} with their {' '.join(words_of(other.name))}"))
                if (name := namelike(other)) and (values or {}).get((other.name, name.name)):
                    out.append(("string_filter", f"count {many} in {' '.join(words_of(other.name))} {values[other.name, name.name][0]}"))
    out = list(dict.fromkeys(out))
    random.Random(seed).shuffle(out)
    return out[:n]


def signature(df: DataFrame) -> DataFrame:
    """One row, ``signature``: a digest of the columns' names and the first rows in the order of their text. Equal results in any order agree."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    rows = df.select(line.alias("line")).orderBy("line").limit(SIGNED_ROWS).agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("t"))
    head = F.lit("\x1e".join(df.columns) + "\n")
    return rows.select(F.substring(F.sha2(F.concat(head, F.coalesce("t", F.lit(""))), 256), 1, SIGNATURE).alias("signature"))


def verdict(own_rows: Column, other_rows: Column, own: Column, other: Column) -> Column:
    """How two results compare; a null number of rows means that a side failed."""
    return (
        F.when(own_rows.isNull() & other_rows.isNull(), "both_fail")
        .when(own_rows.isNull(), "other_only")
        .when(other_rows.isNull(), "own_only")
        .when(own == other, "match")
        .when(own_rows == other_rows, "count_match")
        .otherwise("diverge")
    )


def evaluate(spark: SparkSession, asked: list[tuple[str, str]], own: Callable[[str], DataFrame], other: Callable[[str], DataFrame]) -> DataFrame:
    """A row per question: ``bucket``, ``question``, both numbers of rows and signatures, ``verdict``. The questions are a test set of fixed size."""

    def side(run: Callable[[str], DataFrame], q: str) -> tuple[int | None, str | None]:
        try:
            df = run(q)
            return df.count(), signature(df).first()[0]
        except Exception:  # a failing side is an outcome here
            return None, None

    rows = [(b, q, *side(own, q), *side(other, q)) for b, q in asked]
    df = spark.createDataFrame(rows, "bucket string, question string, own_rows bigint, own_signature string, other_rows bigint, other_signature string")
    return df.withColumn("verdict", verdict(F.col("own_rows"), F.col("other_rows"), F.col("own_signature"), F.col("other_signature")))


def report(results: DataFrame, folder: str) -> dict:
    """results.csv, summary.json (verdicts by bucket) and failures.csv (50 at most, a report); returns the summary."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    rows = results.collect()
    for name, chosen in (("results.csv", rows), ("failures.csv", [r for r in rows if r.verdict not in ("match", "count_match")][:50])):
        with (to / name).open("w", newline="") as f:
            w = csv.writer(f)
            w.writerow(results.columns)
            w.writerows(chosen)
    summary: dict = {"total": len(rows), "verdicts": {}, "buckets": {}}
    for r in rows:
        summary["verdicts"][r.verdict] = summary["verdicts"].get(r.verdict, 0) + 1
        b = summary["buckets"].setdefault(r.bucket, {})
        b[r.verdict] = b.get(r.verdict, 0) + 1
    (to / "summary.json").write_text(json.dumps(summary, indent=1))
    return summary
