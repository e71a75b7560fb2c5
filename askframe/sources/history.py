"""The log of questions: JSON lines in a folder, a file for each writer."""

from __future__ import annotations

import itertools
import json
import os
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    id bigint, created_at string, question string, sql string, status string, error string, row_count int, elapsed_ms int,
    tables_used string, model string, prompt_tokens int, completion_tokens int
"""
COLUMNS = [c.split()[0] for c in SCHEMA.split(",")]
STATUSES = ("ok", "no_sql", "invalid_sql", "exec_error", "gen_error")


class History:
    def __init__(self, path: str):
        self.path = Path(path)
        self._file = self.path / f"log-{os.getpid()}-{time.time_ns()}.jsonl"
        self._ids = itertools.count()

    def record(self, **columns: object) -> int:
        """Append a row with any of the columns; a list of tables becomes JSON. Returns its id, which grows with time."""
        if unknown := set(columns) - set(COLUMNS):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if isinstance(columns.get("tables_used"), list | tuple | set):
            columns["tables_used"] = json.dumps(sorted(columns["tables_used"]) if isinstance(columns["tables_used"], set) else list(columns["tables_used"]))
        row = {"id": time.time_ns() // 1000 * 1000 + next(self._ids) % 1000, "created_at": datetime.now(timezone.utc).isoformat()} | columns
        self.path.mkdir(parents=True, exist_ok=True)
        with self._file.open("a") as f:
            f.write(json.dumps(row) + "\n")
        return row["id"]

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows, ``tables_used`` as an array."""
        if not self.path.exists() or not any(self.path.glob("*.jsonl")):
            return spark.createDataFrame([], SCHEMA).withColumn("tables_used", F.from_json("tables_used", "array<string>"))
        return spark.read.schema(SCHEMA).json(str(self.path)).withColumn("tables_used", F.from_json("tables_used", "array<string>"))

    def recent(self, spark: SparkSession, n: int = 50) -> DataFrame:
        return self.table(spark).orderBy(F.col("id").desc()).limit(n)
