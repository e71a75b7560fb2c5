"""The engine: ask questions, run guarded SQL, manage databases, learn from what was asked."""

from __future__ import annotations

import time
from dataclasses import asdict
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from askframe.operators import annotate as notes
from askframe.operators import training
from askframe.operators.compile import compile_spec
from askframe.operators.runner import TIMEOUT_MS, Result, run
from askframe.plans import guard
from askframe.plans.intent import IntentModel
from askframe.plans.link import CatalogIndex
from askframe.plans.planner import MAX_ROWS, alternatives, plan, worth_showing
from askframe.plans.render import render
from askframe.plans.spec import Plan, PlanError
from askframe.sources import introspect
from askframe.sources.catalog import Catalog, load, save
from askframe.sources.history import History
from askframe.sources.registry import Database, Registry, safe_name


class Frames:
    """Tables by name, read on first use: a folder of Parquet tables or a database by its JDBC URL (with Spark's options), overlaid by given DataFrames."""

    def __init__(self, spark: SparkSession, path: str | None = None, given: dict[str, DataFrame] | None = None, **options: str):
        self.spark, self.path, self.options, self.given = spark, path, options, {k.lower(): v for k, v in (given or {}).items()}

    def __call__(self, name: str) -> DataFrame:
        if name.lower() not in self.given:
            if self.path is None:
                raise KeyError(name)
            if self.path.startswith("jdbc:"):
                self.given[name.lower()] = introspect.jdbc_table(self.spark, self.path, name, **self.options)
            else:
                self.given[name.lower()] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self.given[name.lower()]


class Engine:
    """Answers over one catalog. ``home`` (a local folder) holds history, registry, catalogs and the intent model, if given."""

    def __init__(self, spark: SparkSession, catalog: Catalog, tables: Frames, home: str | None = None, max_rows: int = MAX_ROWS, timeout_ms: int = TIMEOUT_MS, dialect: str = "spark"):
        self.spark, self.max_rows, self.timeout_ms, self.dialect = spark, max_rows, timeout_ms, dialect
        self.home = Path(home) if home else None
        self.log = History(str(self.home / "history")) if self.home else None
        self.registry = Registry(str(self.home / "databases.json")) if self.home else None
        self.model_path = str(self.home / "intent.json") if self.home else None
        self.model = IntentModel.load(self.model_path) if self.model_path else None
        self._passwords: dict[str, str] = {}  # of this process only; the registry holds none
        self.use(catalog, tables)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: object) -> Engine:
        """An engine over a folder of Parquet tables; the catalog is introspected and annotated."""
        return cls(spark, notes.annotate(introspect.from_parquet(spark, path)), Frames(spark, path), **options)

    def use(self, catalog: Catalog, tables: Frames) -> None:
        self.catalog, self.tables, self.index = catalog, tables, CatalogIndex(catalog)
        # its own session: views of one database are not seen by another
        self.session = self.spark.newSession()
        self._views: set[str] = set()

    # -- questions ---------------------------------------------------------------------------------------------------

    def plan(self, question: str, **options: object) -> Plan:
        return plan(question, self.index, self.model, max_rows=self.max_rows, **options)

    def frame(self, question: str, **options: object) -> DataFrame:
        """The answer as a lazy DataFrame."""
        p = self.plan(question, **options)
        if p.spec is None:
            raise PlanError(p.explanation)
        return compile_spec(p.spec, self.tables)

    def ask(self, question: str, execute: bool = True, now: date | None = None) -> dict:
        """The answer with its SQL, explanation, confidence and other readings. Failures are told in ``error``; runs are recorded, dry runs are not."""
        if not 2 <= len(question) <= 2000:
            raise ValueError("a question has 2 to 2000 characters")
        out: dict = {"question": question, "sql": "", "columns": [], "rows": [], "row_count": 0, "elapsed_ms": 0, "truncated": False, "error": None, "alternatives": [], "model": "trained" if self.model else "rules"}
        began = time.perf_counter()
        try:
            plans = alternatives(question, self.index, self.model, max_rows=self.max_rows, now=now)
        except Exception as e:  # the caller gets an answer that says so
            self._record(execute, question, "gen_error", error=str(e)[:500])
            return out | {"error": f"planning_failed: {(str(e).splitlines() or [type(e).__name__])[0][:300]}"}
        best = plans[0]
        out |= {"explanation": best.explanation, "confidence": best.confidence, "intent": best.intent, "tables_used": best.tables_used, "used_columns": best.used_columns, "planning_ms": round((time.perf_counter() - began) * 1000, 2)}
        if best.spec is None:
            self._record(execute, question, "no_sql", error=best.explanation)
            return out | {"error": "no_sql_generated"}
        out["sql"] = render(best.spec, self.dialect)
        out["alternatives"] = [{"sql": render(p.spec, self.dialect), "explanation": p.explanation, "confidence": p.confidence, "intent": p.intent, "tables_used": p.tables_used} for p in worth_showing(plans)]
        if not execute:
            return out
        try:
            r = run(compile_spec(best.spec, self.tables), self.max_rows, self.timeout_ms)
        except Exception as e:  # the caller gets an answer that says so
            self._record(True, question, "exec_error", sql=out["sql"], error=str(e)[:500], tables_used=best.tables_used)
            return out | {"error": f"execution_failed: {str(e).splitlines()[0][:300]}"}
        self._record(True, question, "ok", sql=out["sql"], row_count=r.row_count, elapsed_ms=r.elapsed_ms, tables_used=best.tables_used)
        return out | asdict(r)

    def ask_many(self, asked: list[str]) -> DataFrame:
        """Plans of many questions as a table."""
        rows = []
        for q in asked:
            p = self.plan(q)
            rows.append((q, p.intent, p.confidence, render(p.spec, self.dialect) if p.spec else None, p.explanation))
        return self.spark.createDataFrame(rows, "question string, intent string, confidence double, sql string, explanation string")

    def _record(self, wanted: bool, question: str, status: str, **more: object) -> None:
        if wanted and self.log:
            self.log.record(question=question, status=status, model="trained" if self.model else "rules", **more)

    # -- SQL ---------------------------------------------------------------------------------------------------------

    def validate(self, sql: str) -> guard.Checked:
        return guard.check(self.spark, sql, [t.name for t in self.catalog.tables], self.max_rows)

    def sql(self, sql: str) -> DataFrame:
        """Foreign SQL behind the guard, as a lazy DataFrame with its row cap."""
        checked = self.validate(sql)
        for name in checked.tables:
            if name not in self._views:
                df = self.tables(name)
                DataFrame.createOrReplaceTempView(df if df.sparkSession is self.session else _in(self.session, df), name)
                self._views.add(name)
        df = guard.check_analyzed(self.session.sql(checked.sql))
        return df if checked.limit is None else df.limit(checked.limit)

    def run_sql(self, sql: str) -> Result:
        """Rows of foreign SQL. Refusals, failures and successes are recorded."""
        try:
            df = self.sql(sql)
        except Exception as e:
            self._record(True, sql, "invalid_sql", sql=sql, error=str(e)[:500])
            raise
        try:
            r = run(df, self.max_rows, self.timeout_ms)
        except Exception as e:
            self._record(True, sql, "exec_error", sql=sql, error=str(e)[:500])
            raise
        self._record(True, sql, "ok", sql=sql, row_count=r.row_count, elapsed_ms=r.elapsed_ms)
        return r

    # -- databases, history, learning ----------------------------------------------------------------------------------

    def register(self, name: str, path: str | None = None, *, dialect: str = "", host: str = "", port: int | None = None, dbname: str = "", username: str = "", password: str = "") -> Database:
        """Probe a folder of Parquet tables or a database (by JDBC URL, or by dialect, host and name), introspect, annotate, keep its catalog, and switch to it.

        The password stays in this process: after a restart, :meth:`activate` needs it again.
        """
        name = safe_name(name)
        if self.registry.get(name):
            raise ValueError(f"database {name!r} exists")
        path = path or introspect.jdbc_url(dialect or "postgres", host, port, dbname)
        db = Database(name, path, dialect=introspect.dialect_of(path) if path.startswith("jdbc:") else "spark", username=username)
        if password:
            self._passwords[name] = password
        if db.dialect == "spark" and not introspect.parquet_tables(self.spark, path):
            raise ValueError(f"no Parquet tables in {path}")
        catalog = self._introspected(db)
        if not catalog.tables:
            raise ValueError(f"no tables in {path}")
        file = self.home / "schemas" / f"{name}.yml"
        file.parent.mkdir(parents=True, exist_ok=True)
        db.schema_file, db.table_count = str(file), save(catalog, file)
        db = self.registry.insert(db)
        self.activate(name)
        return db

    def _options(self, db: Database) -> dict[str, str]:
        out = {"user": db.username} if db.username else {}
        return out | ({"password": self._passwords[db.name]} if db.name in self._passwords else {})

    def _introspected(self, db: Database) -> Catalog:
        if db.dialect == "spark":
            return notes.annotate(introspect.from_parquet(self.spark, db.path, db.name))
        return notes.annotate(introspect.from_jdbc(self.spark, db.path, database=db.name, **self._options(db)))

    def activate(self, name: str, password: str = "") -> None:
        db = self.registry.get(name)
        if db is None or not self.registry.activate(name):
            raise KeyError(name)
        if password:
            self._passwords[name] = password
        self.use(load(db.schema_file), Frames(self.spark, db.path, **self._options(db)))
        self.dialect = db.dialect

    def regenerate(self, name: str) -> int:
        """Introspect and annotate again; returns the number of tables."""
        db = self.registry.get(name)
        if db is None:
            raise KeyError(name)
        n = save(self._introspected(db), db.schema_file)
        self.registry.set_table_count(name, n)
        if db.is_active:
            self.activate(name)
        return n

    def unregister(self, name: str) -> bool:
        """Forget a database; its catalog goes too if it lies in this engine's folder."""
        db = self.registry.get(name)
        if db and (file := Path(db.schema_file)).exists() and (self.home / "schemas").resolve() in file.resolve().parents:
            file.unlink()
        return self.registry.delete(name)

    def databases(self) -> list[dict]:
        return [asdict(d) for d in self.registry.list()]

    def history(self, limit: int = 50) -> list[dict]:
        return [r.asDict() for r in self.log.recent(self.spark, limit).collect()]

    def train(self) -> dict:
        """Learn from the seed and the history, and use the new model."""
        out = training.train(self.spark, self.log.table(self.spark) if self.log else None, self.model_path)
        self.model = IntentModel.load(self.model_path)
        return out

    def health(self) -> dict:
        active = self.registry.active() if self.registry else None
        return {"status": "ok", "database": self.catalog.database, "active_db": active.name if active else None, "tables": len(self.catalog.tables), "model": "logistic regression on character n-grams" if self.model else "rules", "model_trained": self.model is not None}

    def schema(self) -> list[dict]:
        return [{"name": t.name, "columns": [{"name": c.name, "type": c.type} for c in t.columns]} for t in self.catalog.tables]


def _in(session: SparkSession, df: DataFrame) -> DataFrame:
    """The same plan in another session."""
    jdf = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(jdf, session)
