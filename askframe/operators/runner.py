"""Running a query: row cap, time limit, JSON values."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame

TIMEOUT_MS = 15_000


class QueryTimeout(TimeoutError):
    pass


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    row_count: int
    elapsed_ms: int
    truncated: bool


def jsonable(v: object) -> object:
    """None, text, numbers and booleans stay; a decimal becomes a float; anything else its text."""
    if v is None or isinstance(v, str | int | float | bool):
        return v
    return float(v) if isinstance(v, Decimal) else str(v)


def run(df: DataFrame, max_rows: int = 500, timeout_ms: int = TIMEOUT_MS) -> Result:
    """The first ``max_rows`` rows. One more is fetched to know whether there are more; jobs over the time limit are cancelled."""
    sc, group = df.sparkSession.sparkContext, f"askframe-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout_ms / 1000, stop)
    began = time.perf_counter()
    sc.setJobGroup(group, "question", interruptOnCancel=True)
    timer.start()
    try:
        rows = df.limit(max_rows + 1).collect()
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"took longer than {timeout_ms} ms") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    shown = [[jsonable(v) for v in r] for r in rows[:max_rows]]
    return Result(df.columns, shown, len(shown), round((time.perf_counter() - began) * 1000), len(rows) > max_rows)
