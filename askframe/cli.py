"""Command line: ask, serve, train, bootstrap a catalog, annotate, review and apply annotations, evaluate."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from askframe.engine import Engine
from askframe.operators import annotate, evaluate
from askframe.plans.render import render
from askframe.sources import introspect
from askframe.sources.catalog import load, save


def session() -> SparkSession:
    """Master, memory and shuffle partitions come from spark-submit or the cluster's defaults."""
    return SparkSession.builder.appName("askframe").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="askframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options: dict) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for k, o in options.items():
            c.add_argument("--" + k.replace("_", "-"), **o)
        return c

    command("ask", "data", "question", home={"default": None}, dry={"action": "store_true"})
    command("serve", "data", home={"required": True}, port={"type": int, "default": 8000})
    command("train", "data", home={"required": True})
    command("bootstrap", "data", out={"required": True}, append={"action": "store_true"})
    command("annotate", "catalog", tables={"nargs": "*"}, mode={"choices": ["merge", "replace"], "default": "merge"}, max_synonyms={"type": int, "default": annotate.MOST_SYNONYMS}, verbose={"action": "store_true"}, with_samples={"default": None, "metavar": "DATA"})
    for name in ("diff", "apply", "discard"):
        command(name, "catalog")
    command("evaluate", "data", out={"required": True}, n={"type": int, "default": 100})
    a = p.parse_args(argv)

    if a.command == "bootstrap":
        new = introspect.from_parquet(session(), a.data)
        if a.append and Path(a.out).exists():
            old = load(a.out)
            old.tables += [t for t in new.tables if old.table(t.name) is None]
            new = old
        print(save(new, a.out), "tables")
    elif a.command == "annotate":
        trace: list[str] = []
        samples = None
        if a.with_samples:
            spark = session()
            samples = {}
            for t in load(a.catalog).tables:
                df = spark.read.parquet(f"{a.with_samples}/{t.name}.parquet")
                for c in introspect.text_columns(df):
                    samples[t.name, c] = [r[0] for r in introspect.distinct_samples(df, c, 3).collect()]
        print(annotate.propose(a.catalog, only=a.tables, replace=a.mode == "replace", most=a.max_synonyms, samples=samples, trace=trace))
        if a.verbose:
            print("\n".join(trace))
    elif a.command in ("diff", "apply", "discard"):
        print(getattr(annotate, a.command)(a.catalog))
    else:
        e = Engine.open(session(), a.data, home=getattr(a, "home", None))
        if a.command == "ask":
            print(json.dumps(e.ask(a.question, not a.dry), indent=1, default=str))
        elif a.command == "train":
            print(json.dumps(e.train()))
        elif a.command == "evaluate":
            asked = evaluate.questions(e.catalog, n=a.n)
            print(json.dumps(evaluate.report(evaluate.evaluate(e.spark, asked, e.frame, lambda q: e.sql(render(e.plan(q).spec))), a.out), indent=1))
        else:
            from askframe.server import serve

            serve(e, port=a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
