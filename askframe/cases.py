"""Registered queries whose rows are cases and their outcomes: each runs its part of the engine, and its SQL states what must come out."""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.engine import Engine, Frames
from askframe.functions.literals import extract
from askframe.functions.text import compound, lemma, parts, similarity, tokenize
from askframe.operators import annotate, evaluate, training
from askframe.operators.runner import QueryTimeout, jsonable, run
from askframe.plans import guard
from askframe.plans.intent import IntentModel, by_rules, choose
from askframe.plans.link import CatalogIndex, implicit_values, score_columns, score_tables
from askframe.plans.planner import alternatives, plan, worth_showing
from askframe.plans.render import render
from askframe.server import route
from askframe.sources import introspect
from askframe.sources.catalog import Catalog, Column, Table, load, save
from askframe.sources.demo import build
from askframe.sources.history import History
from askframe.sources.registry import Database, Registry, safe_name

Cases = list[tuple[str, str]]
NOW = date(2024, 5, 15)

FLEET = build("fleet", {
    "Client": ("", ["id uuid pk", "name string", "email string", "enabled boolean", "createdAt timestamptz", "OrganizationId uuid >Organization.id"]),
    "Organization": ("", ["id uuid pk", "name string"]),
    "Employee": ("", ["id uuid pk", "name string", "clientId uuid >Client.id", "salary numeric", "active boolean | enabled", "hiredAt date"]),
    "User": ("", ["id uuid pk", "name string", "OrganizationId uuid >Organization.id"]),
})
SHOP = build("shop", {
    "categories": ("", ["id integer pk", "name string", "parent_id integer"]),
    "products": ("", ["id integer pk", "name string", "category_id integer >categories.id", "price numeric"]),
    "orphan": ("", ["id integer pk", "label string"]),
})
FLAGS = build("flags", {
    "products": ("", ["id integer pk", "name string", "category string", "supplier string", "warranty integer", "isservice boolean", "isscale boolean", "isconstant boolean", "hasdiscount boolean", "pricesell numeric"]),
    "onlineorders": ("", ["id bigint pk", "orderId string", "paymentStatus string"]),
})
BARE = build("bare", {"thing": ("", [])})
CATALOGS = {"fleet": FLEET, "shop": SHOP, "flags": FLAGS, "bare": BARE}
ROWS = {
    "categories": ([(1, "Veg Pizza", None), (2, "Drinks", None), (3, None, 1)], "id int, name string, parent_id int"),
    "products": ([(1, "50% off", 1, 9.5), (2, "5000", 1, 7.0), (3, "foo_bar", 2, 2.5), (4, "fooXbar", 2, 2.5), (5, "Margherita", 1, None)], "id int, name string, category_id int, price double"),
    "orphan": ([], "id int, label string"),
    "Organization": ([("o1", "Swaraj"), ("o2", "Acme")], "id string, name string"),
    "Client": ([("c1", "North", "n@x", True, None, "o1"), ("c2", "South", None, False, None, "o2")], "id string, name string, email string, enabled boolean, createdAt timestamp, OrganizationId string"),
    "Employee": ([("e1", "John", "c1", 10.0, True, date(2020, 1, 1)), ("e2", "Ann", "c1", 30.0, False, date(2021, 5, 5)), ("e3", "Joe", "c2", 20.0, True, None)], "id string, name string, clientId string, salary double, active boolean, hiredAt date"),
    "User": ([("u1", "A", "o1"), ("u2", "B", "o1"), ("u3", "C", "o2")], "id string, name string, OrganizationId string"),
}


def small(spark: SparkSession, catalog: Catalog, **options: object) -> Engine:
    given = {t.name: spark.createDataFrame(*ROWS[t.name]) for t in catalog.tables if t.name in ROWS}
    return Engine(spark, catalog, Frames(spark, given=given), **options)


def failure(f: Callable[[], object], *kinds: type[Exception]) -> str:
    """What a call gives, or the kind of its failure."""
    try:
        return str(f())
    except kinds or Exception as e:
        return type(e).__name__


# -- the guard -------------------------------------------------------------------------------------------------------------

ACCEPTED = [
    "SELECT name FROM Employee", "select * from employee;", "SELECT e.name FROM Employee e JOIN Client c ON e.clientId = c.id", "SELECT name, COUNT(*) FROM Employee GROUP BY name", "(SELECT name FROM Employee)",
    "SELECT name FROM Employee UNION SELECT name FROM Client", "SELECT name FROM Employee EXCEPT SELECT name FROM Client", "WITH x AS (SELECT * FROM Employee) SELECT * FROM x", "SELECT name FROM Employee LIMIT 10",
    "SELECT * FROM Employee WHERE id IN (SELECT id FROM Client)", "SELECT ROW_NUMBER() OVER (ORDER BY id) FROM Employee", "SELECT ROW_NUMBER() OVER w FROM Employee WINDOW w AS (ORDER BY id)", "SELECT lpad(name, 5, '0') FROM Employee",
]
REFUSED = [
    "", "   ", ";", "garbage here", "SELECT 1; SELECT 2", "DELETE FROM Employee", "UPDATE Employee SET name = 'x'", "INSERT INTO Employee VALUES (1)", "DROP TABLE Employee", "CREATE TABLE t (a INT)", "TRUNCATE TABLE Employee",
    "ALTER TABLE Employee ADD COLUMN x INT", "MERGE INTO Employee USING Client ON true WHEN MATCHED THEN DELETE", "SET spark.x = 1", "EXPLAIN SELECT * FROM Employee", "SHOW TABLES", "CACHE TABLE Employee", "SELECT * FROM range(10)",
    "SELECT * FROM Secret", "SELECT * FROM a.Employee", "SELECT * FROM parquet.`/etc/passwd`", "SELECT (SELECT MAX(id) FROM Secret) FROM Employee", "SELECT * FROM Employee WHERE id IN (SELECT id FROM Secret)",
    "WITH x AS (SELECT * FROM Secret) SELECT * FROM x", "SELECT * FROM Employee e WHERE EXISTS (SELECT 1 FROM Secret s WHERE s.id = e.id)", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT reflect('a', 'b')",
    "SELECT input_file_name() FROM Employee", "SELECT pg_sleep(10)", "SELECT current_user()", "SELECT repeat('x', 2000000000)", "SELECT row_number() OVER w FROM Employee WINDOW w AS (ORDER BY reflect('a', 'b'))",
    "SELECT count(*) OVER w FROM Employee WINDOW w AS (PARTITION BY (SELECT max(x) FROM parquet.`/any`))",
]


def guard_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """Trim, one statement, kinds of statements, functions and tables at every level."""
    return [(sql, "refused" if failure(lambda sql=sql: guard.check(spark, sql, ["Employee", "Client"])) == "GuardError" else "ok") for sql in (*ACCEPTED, *REFUSED)]


GUARD = [(s, "ok") for s in ACCEPTED] + [(s, "refused") for s in REFUSED]


def limit_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """Caps on foreign SQL, single-row statements, unknown columns; truncation, the time limit and JSON values of the runner."""
    e = small(spark, SHOP, max_rows=2)
    out = [(sql, failure(lambda sql=sql: e.run_sql(sql).row_count)) for sql, _ in LIMITS if sql.startswith("SELECT")]
    out += [("cap of " + sql, str(e.validate(sql).limit)) for sql in ("SELECT COUNT(*) FROM products", "SELECT COUNT(*) > 0 FROM products", "SELECT name, COUNT(*) FROM products GROUP BY name")]
    many, few = run(spark.range(10).toDF("n"), 3), run(spark.range(3).toDF("n"), 3)
    out += [("10 rows, at most 3", f"{many.row_count} {many.truncated}"), ("3 rows, at most 3", f"{few.row_count} {few.truncated}")]
    slow = spark.range(0, 10**12, 1, 4).where(F.sin("id") + F.cos("id") * F.sqrt("id") == F.lit(0.123456789)).limit(1)
    out.append(("a slow query", failure(lambda: run(slow, 1, timeout_ms=700), QueryTimeout)))
    values = (None, "a", 1, True, Decimal("1.5"), date(2020, 1, 2), datetime(2020, 1, 2, 3))
    return [*out, ("JSON values", json.dumps([jsonable(v) for v in values]))]


LIMITS = [
    ("SELECT id FROM products LIMIT 4", "2"), ("SELECT id FROM products", "2"), ("SELECT id FROM products UNION SELECT id FROM categories", "2"), ("SELECT id FROM products ORDER BY id LIMIT 1", "1"), ("SELECT COUNT(*) FROM products", "1"),
    ("SELECT nothing FROM products", "AnalysisException"),
    ("cap of SELECT COUNT(*) FROM products", "None"), ("cap of SELECT COUNT(*) > 0 FROM products", "None"), ("cap of SELECT name, COUNT(*) FROM products GROUP BY name", "2"),
    ("10 rows, at most 3", "3 True"), ("3 rows, at most 3", "3 False"), ("a slow query", "QueryTimeout"), ("JSON values", '[null, "a", 1, true, 1.5, "2020-01-02", "2020-01-02 03:00:00"]'),
]

# -- language and planning ---------------------------------------------------------------------------------------------------


def language_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """Lemmas, identifiers, similarity, yes and no, flags, nulls, numbers, dates and rules."""
    out = [(f"lemma {w}", lemma(w)) for w in ("categories", "orders", "services", "employees", "address", "status", "boxes", "people")]
    out += [(f"parts {w}", " ".join(parts(w))) for w in ("createdAt", "parent_id", "HTTPServer", "onlineorders")] + [("compound name", " ".join(compound("name")))]
    out += [(f"similarity {a} {b}", f"{similarity(a, b):.2f}") for a, b in (("categris", "category"), ("a", ""), ("x", "x"))]
    for text in ("list active employees", "list employees that are not active", "products that are services", "where name is null", "where name is not null"):
        v = extract(text, NOW)
        out.append((text, f"{v.booleans} {v.predicates} {v.nulls}"))
    for text in ("price > 5", "price at least 5", "price less than 5", "price other than 5", "size between 10 and 20"):
        x = extract(text, NOW).numbers[0]
        out.append((text, f"{x.op} {x.value} {x.upper}"))
    out += [(text, str([str(x.value) for x in extract(text, NOW).dates])) for text in ("from yesterday", "from 3 days ago", "from March 5, 2020", "from december 1", "on 2020-13-45")]
    return out + [(f"intent: {q}", by_rules(q)[0]) for q in ("how many employees are there", "are there any orders", "sum of salary", "average salary", "lowest price", "highest price", "top 5 employees by salary", "list all clients", "total orders")]


LANGUAGE = [
    ("lemma categories", "category"), ("lemma orders", "order"), ("lemma services", "service"), ("lemma employees", "employee"), ("lemma address", "address"), ("lemma status", "status"), ("lemma boxes", "box"), ("lemma people", "person"),
    ("parts createdAt", "create at"), ("parts parent_id", "parent id"), ("parts HTTPServer", "http server"), ("parts onlineorders", "online order"), ("compound name", "name"),
    ("similarity categris category", "0.75"), ("similarity a ", "0.00"), ("similarity x x", "1.00"),
    ("list active employees", "[True] [] []"), ("list employees that are not active", "[] [('active', False)] []"), ("products that are services", "[] [('service', True)] []"),
    ("where name is null", "[] [] [('name', True)]"), ("where name is not null", "[] [] [('name', False)]"),
    ("price > 5", "> 5 None"), ("price at least 5", ">= 5 None"), ("price less than 5", "< 5 None"), ("price other than 5", "<> 5 None"), ("size between 10 and 20", "between 10 20"),
    ("from yesterday", "['2024-05-14']"), ("from 3 days ago", "['2024-05-12']"), ("from March 5, 2020", "['2020-03-05']"), ("from december 1", "['2023-12-01']"), ("on 2020-13-45", "[]"),
    ("intent: how many employees are there", "count"), ("intent: are there any orders", "exists"), ("intent: sum of salary", "sum"), ("intent: average salary", "avg"), ("intent: lowest price", "min"), ("intent: highest price", "max"),
    ("intent: top 5 employees by salary", "top"), ("intent: list all clients", "list"), ("intent: total orders", "count"),
]


def plan_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """What questions over the small catalogs are planned to: filters, columns, joins, limits, errors, confidence, other readings, dialects, matches."""
    index = {k: CatalogIndex(c) for k, c in CATALOGS.items()}
    out = []
    for item, _ in PLANS:
        kind, _, rest = item.partition(" ")
        name, _, q = rest.partition(": ")
        if kind == "sql":
            got = render(plan(q, index[name]).spec, "postgres")
        elif kind == "mysql":
            got = render(plan(q, index[name]).spec, "mysql")
        elif kind == "where":
            got = "; ".join(f"{p.ref} {p.op} {p.value}" for p in plan(q, index[name]).spec.predicates)
        elif kind == "tables":
            got = ", ".join(plan(q, index[name]).spec.tables)
        elif kind == "shown":
            s = plan(q, index[name]).spec
            got = "*" if s.star else ", ".join(p.alias for p in s.projections)
        elif kind == "limit":
            got = str(plan(q, index[name]).spec.limit)
        elif kind == "capped":
            got = str(plan(q, index[name], max_rows=3).spec.limit)
        elif kind == "error":
            got = plan(q, index[name], **({"table": "products"} if name == "shop" else {"intent": "sum"} if "sum" in q else {})).explanation
        elif kind == "sure":
            got = str(plan(q, index[name]).confidence)
        elif kind == "says":
            got = plan(q, index[name]).explanation
        elif kind == "as-User":
            got = plan(q, index[name], table="User").spec.primary
        elif kind == "via-Client":
            got = render(plan(q, index[name], table="Client").spec, "postgres")
        elif kind == "others":
            found = alternatives(q, index[name])
            got = f"{[p.intent for p in found]} {len(worth_showing(found))}"
        elif kind == "best-table":
            got = score_tables(tokenize(q), index[name])[0].table
        elif kind == "best-column":
            m = score_columns(tokenize(q), index[name])[0]
            got = f"{m.table}.{m.column} {m.reason}"
        else:
            got = str([(x.table, x.value) for x in implicit_values(tokenize(q), index[name], {w for w, _ in extract(q).predicates})])
        out.append((item, got))
    return out


PLANS = [
    ("sql fleet: how many employees are there", 'SELECT COUNT(*) AS "count" FROM "Employee"'), ("sql fleet: total salary of employees", 'SELECT SUM("Employee"."salary") AS "sum" FROM "Employee"'),
    ("sql fleet: earliest hired date for employees", 'SELECT MIN("Employee"."hiredAt") AS "min" FROM "Employee"'), ("sql fleet: are there any employees", 'SELECT COUNT(*) > 0 AS "exists" FROM "Employee"'),
    ("sql fleet: total users belongs to org swaraj", """SELECT COUNT(*) AS "count" FROM "User" INNER JOIN "Organization" ON "User"."OrganizationId" = "Organization"."id" WHERE "Organization"."name" ILIKE '%swaraj%' ESCAPE '\\'"""),
    ("mysql fleet: how many employees are there", "SELECT COUNT(*) AS `count` FROM `Employee`"),
    ("sql bare: list thing", 'SELECT * FROM "thing" LIMIT 500'),
    ("where fleet: show employees named 'John'", "Employee.name = John"), ("where fleet: list active employees", "Employee.active = True"), ("where fleet: list employees that are not active", "Employee.active = False"),
    ("where flags: list products that are services", "products.isservice = True"), ("where flags: list products that are not services", "products.isservice = False"), ("where flags: list products with discount", "products.hasdiscount = True"),
    ("where flags: any products without a category", "products.category is_null None"), ("where flags: are there any onlineorders without payment status", "onlineorders.paymentStatus is_null None"),
    ("where flags: list products by suplier", ""), ("where shop: count products with price 2.5", "products.price = 2.5"), ("where fleet: count employees with hired date 2020-01-01", "Employee.hiredAt = 2020-01-01"),
    ("where shop: products with name 'Pizza'", "products.name = Pizza"),
    ("tables fleet: how many employees of organization Acme", "Employee, Client, Organization"), ("tables shop: show all products with their categories", "products, categories"), ("tables shop: list categories with their orphan", "categories"),
    ("tables shop: list all products under the Pizza category", "products, categories"), ("tables shop: sum of price of products", "products"),
    ("tables fleet: average salary of employees of client Acme", "Employee, Client"),
    ("shown fleet: list all clients", "id, name, email, enabled, OrganizationId"), ("shown fleet: show email of clients", "email"), ("shown bare: list thing", "*"),
    ("limit fleet: list all clients", "500"), ("limit fleet: list all clients limit 7", "7"), ("limit fleet: top employees by salary", "10"), ("limit fleet: top 5 employees by salary", "5"),
    ("capped fleet: list all clients limit 7", "3"), ("capped fleet: top 5 employees by salary", "3"),
    ("error fleet: zzz qqq", "no table or column matches the question"), ("error fleet: sum of clients", "SUM needs a numeric column"), ("error shop: count products of orphan Bob", "no foreign-key path from products to orphan"),
    ("sure fleet: how many employees", "0.6"), ("sure fleet: zzz qqq", "0.0"), ("sure fleet: how many clients with 77", "0.5"), ("says fleet: how many clients with 77", "COUNT(*) on Client; ignored: 77"),
    ("via-Client fleet: average salary of employees", """SELECT AVG("Employee"."salary") AS "avg" FROM "Client" INNER JOIN "Employee" ON "Client"."id" = "Employee"."clientId\""""),
    ("as-User fleet: list clients", "User"), ("others fleet: total salary of employees", "['sum', 'avg', 'count'] 2"),
    ("best-table fleet: how many emplyees", "Employee"), ("best-table shop: products with their categories", "products"), ("best-column fleet: average salary", "Employee.salary exact"), ("best-column fleet: salry", "Employee.salary fuzzy"),
    ("values fleet: total users belongs to org swaraj", "[('Organization', 'swaraj')]"), ("values fleet: list employee named John", "[('Employee', 'John')]"), ("values shop: list all products under the Pizza category", "[('categories', 'Pizza')]"),
    ("values flags: list products that are services", "[]"), ("values flags: list products by suplier", "[]"),
]


def answers(spark: SparkSession, sf_dir: str) -> Cases:
    """Questions over the small tables, answered."""
    engines = {"fleet": small(spark, FLEET), "shop": small(spark, SHOP)}
    return [(item, json.dumps(engines[item.split(": ", 1)[0]].ask(item.split(": ", 1)[1])["rows"])) for item, _ in ANSWERS]


ANSWERS = [
    ("fleet: how many employees are there", "[[3]]"), ("fleet: total salary of employees", "[[60.0]]"), ("fleet: average salary", "[[20.0]]"), ("fleet: earliest hired date for employees", '[["2020-01-01"]]'),
    ("fleet: total users belongs to org swaraj", "[[2]]"), ("fleet: count active employees", "[[2]]"), ("fleet: count employees that are not active", "[[1]]"), ("fleet: how many employees of organization Acme", "[[1]]"),
    ("fleet: count clients without email", "[[1]]"), ("fleet: count employees with salary between 15 and 40", "[[2]]"), ("fleet: are there any employees named 'Nobody'", "[[false]]"),
    ("shop: count products named '5000'", "[[1]]"), ("shop: count products named foo_bar", "[[1]]"), ("shop: count orphan", "[[0]]"), ("shop: are there any orphan", "[[false]]"), ("shop: sum of price of products", "[[21.5]]"),
]

# -- metadata, learning, interfaces -------------------------------------------------------------------------------------------


def catalog_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """YAML both ways, summaries, key paths, native types, dialects, JDBC URLs, information_schema, junction tables."""
    path = str(Path(tempfile.mkdtemp()) / "c.yml")
    out = [("tables saved", str(save(FLEET, path))), ("round trip", str(load(path).to_dict() == FLEET.to_dict())), ("kept until changed", str(load(path) is load(path)))]
    out += [("summary of one", str(FLEET.summary(["Organization"]).count("table "))), ("path", " ".join(e[2] for e in FLEET.path("Employee", "Organization"))), ("no path", str(SHOP.path("products", "orphan")))]
    out += [(f"{d} {n}", introspect.native_type(n, d)) for d, n in (("mysql", "tinyint(1)"), ("mysql", "tinyint(4)"), ("mysql", "datetime"), ("postgres", "character varying"), ("postgres", "USER-DEFINED"))]
    out += [(u, introspect.dialect_of(u)) for u in ("jdbc:mariadb://h/d", "postgresql://h/d")] + [("url", introspect.jdbc_url("mysql", "h", None, "d")), ("bad host", failure(lambda: introspect.jdbc_url("postgres", "h/x?y", 1, "d")))]
    columns = spark.createDataFrame([("a", "id", "integer", 1), ("b", "id", "uuid", 1), ("b", "a_id", "integer", 2)], "table_name string, column_name string, data_type string, ordinal_position int")
    pk = spark.createDataFrame([("a", "id"), ("b", "id")], "table_name string, column_name string")
    fk = spark.createDataFrame([("b", "a_id", "a", "id")], "table_name string, column_name string, rt string, rc string")
    c = introspect.from_information_schema(columns, pk, fk, "postgres")
    out += [(f"{t.name}.{x.name}", f"{x.type} {x.pk} {x.fk}") for t in c.tables for x in t.columns]
    j = introspect.junctions(Catalog("", "", [Table("U", [Column("id", pk=True)]), Table("R", [Column("id", pk=True)]), Table("UR", [Column("u", pk=True, fk="U.id"), Column("r", pk=True, fk="R.id"), Column("createdAt")])]))
    return [*out, ("junction", f"{j.table('UR').description}: {[(r.to, r.type, r.via) for r in j.table('U').relationships]}")]


CATALOG_CASES = [
    ("tables saved", "4"), ("round trip", "True"), ("kept until changed", "True"), ("summary of one", "1"), ("path", "Client Organization"), ("no path", "None"),
    ("mysql tinyint(1)", "boolean"), ("mysql tinyint(4)", "smallint"), ("mysql datetime", "timestamp"), ("postgres character varying", "string"), ("postgres USER-DEFINED", "enum"),
    ("jdbc:mariadb://h/d", "mysql"), ("postgresql://h/d", "postgres"), ("url", "jdbc:mysql://h:3306/d"), ("bad host", "ValueError"),
    ("a.id", "integer True None"), ("b.id", "uuid True None"), ("b.a_id", "integer False a.id"), ("junction", "Connects U and R: [('R', 'many-to-many', 'UR')]"),
]


def learning_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """The history folder, training and its report, the saved model's choices, annotation files, verdicts and their report."""
    home = Path(tempfile.mkdtemp())
    h = History(str(home / "h"))
    for q, s, status in (("odd thing A", "SELECT COUNT(*) FROM t", "ok"), ("odd thing B", "SELECT COUNT(*) > 0 FROM t", "ok"), ("bad", "SELECT 1", "exec_error"), ("ODD thing a ", "SELECT MAX(x) FROM t", "ok")):
        h.record(question=q, sql=s, status=status, tables_used=["t"])
    out = [("newest", ", ".join(r.question.strip() for r in h.recent(spark, 2).collect())), ("harvest", str(sorted((r.question, r.label) for r in training.harvest(h.table(spark)).collect())))]
    out.append(("unknown column", failure(lambda: h.record(nonsense=1))))
    report = training.train(spark, h.table(spark), str(home / "m.json"))
    out += [("from history", str(report["from_history"])), ("labels", " ".join(sorted(report["labels"]))), ("seed", str(len({q.lower() for q, _ in training.seed_corpus()}) == report["from_seed"]))]
    model = IntentModel.load(str(home / "m.json"))
    out += [(q, choose(q, model)[0]) for q in ("how many widgets are there", "average weight of widgets", "top 7 widgets by weight", "list all widgets", "are there any widgets")]
    out += [("given intent", str(choose("list", model, "count"))), ("no model", str(IntentModel.load(str(home / "none.json")))), ("bad intent", failure(lambda: choose("x", None, "nonsense")))]
    path = str(home / "c.yml")
    save(FLEET, path)
    annotate.propose(path)
    out += [("diff", str("+" in annotate.diff(path))), ("applied", str(bool(annotate.apply(path)))), ("twice the same", str(annotate.annotate(load(path)).to_dict() == load(path).to_dict())), ("nothing to discard", str(annotate.discard(path)))]
    sides = [(1, 1, "a", "a"), (1, 1, "a", "b"), (1, 2, "a", "b"), (None, 1, None, "b"), (1, None, "a", None), (None, None, None, None)]
    df = spark.createDataFrame(sides, "n int, m int, a string, b string")
    out.append(("verdicts", " ".join(r[0] for r in df.select(evaluate.verdict(F.col("n"), F.col("m"), F.col("a"), F.col("b"))).collect())))
    e = small(spark, SHOP)
    asked = evaluate.questions(SHOP, {("categories", "name"): ["Drinks"]}, n=1000)
    out += [("questions repeat by seed", str(asked == evaluate.questions(SHOP, {("categories", "name"): ["Drinks"]}, n=1000))), ("buckets", " ".join(sorted({b for b, _ in asked})))]
    found = evaluate.evaluate(spark, asked[:6], e.frame, lambda q: e.sql(render(e.plan(q).spec)))
    return [*out, ("report", f"{evaluate.report(found, str(home / 'r'))['total']} {sorted(f.name for f in (home / 'r').iterdir())}")]


LEARNING = [
    ("newest", "ODD thing a, bad"), ("harvest", "[('ODD thing a', 'max'), ('odd thing A', 'count'), ('odd thing B', 'exists')]"), ("unknown column", "ValueError"),
    ("from history", "2"), ("labels", "avg count exists list max min sum top"), ("seed", "True"),
    ("how many widgets are there", "count"), ("average weight of widgets", "avg"), ("top 7 widgets by weight", "top"), ("list all widgets", "list"), ("are there any widgets", "exists"),
    ("given intent", "('count', 0.6)"), ("no model", "None"), ("bad intent", "ValueError"),
    ("diff", "True"), ("applied", "True"), ("twice the same", "True"), ("nothing to discard", "False"), ("verdicts", "match count_match diverge other_only own_only both_fail"),
    ("questions repeat by seed", "True"), ("buckets", "aggregate count exists is_null join_explicit list_basic quoted_filter string_filter top_N"), ("report", "6 ['failures.csv', 'results.csv', 'summary.json']"),
]


def interface_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """Registry, endpoints and commands."""
    from askframe.cli import main

    home = Path(tempfile.mkdtemp())
    r = Registry(str(home / "r.json"))
    r.insert(Database("b", "/b"))
    r.insert(Database("a", "/a"))
    out = [("first is active", r.active().name), ("activate", f"{r.activate('a')} {r.activate('zz')} {[d.name for d in r.list()]}"), ("twice", failure(lambda: r.insert(Database("a", "/a")))), ("delete", f"{r.delete('b')} {r.delete('b')}"), ("name", safe_name("a b/c"))]
    e = small(spark, FLEET, home=str(home / "e"))
    calls = [
        ("POST", "/api/ask", {"question": "how many employees are there"}), ("POST", "/api/ask", {"question": "x"}), ("GET", "/api/health", {}), ("GET", "/api/schema", {}), ("GET", "/api/history", {}), ("POST", "/api/train", {}),
        ("POST", "/api/databases", {"name": "tpc h", "path": sf_dir}), ("POST", "/api/databases", {"name": "tpc_h", "path": sf_dir}), ("GET", "/api/databases", {}), ("POST", "/api/databases/tpc_h/activate", {}),
        ("POST", "/api/databases/tpc_h/regenerate", {}), ("DELETE", "/api/databases/tpc_h", {}), ("DELETE", "/api/databases/tpc_h", {}), ("POST", "/api/databases/no/activate", {}), ("GET", "/nothing", {}),
    ]
    for i, (method, path, body) in enumerate(calls):
        status, said = route(e, method, path, {}, body)
        more = said["rows"] if path == "/api/ask" and status == 200 else len(said) if isinstance(said, list) else sorted(said)[0]
        out.append((f"{i} {method} {path}", f"{status} {more}"))
    yml, model = str(home / "boot.yml"), str(home / "m")
    for words in (["bootstrap", sf_dir, "--out", yml], ["annotate", yml], ["diff", yml], ["apply", yml], ["discard", yml], ["train", sf_dir, "--home", model], ["ask", sf_dir, "how many regions are there", "--dry"], ["evaluate", sf_dir, "--out", str(home / "ev"), "--n", "2"]):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            code = main(words)
        text = said.getvalue()
        short = {"bootstrap": text.strip(), "diff": str(text.count("\n+") > 10), "discard": text.strip(), "train": str("from_seed" in text), "ask": str(json.loads(text)["sql"] if words[0] == "ask" else ""), "evaluate": str(json.loads(text)["total"] if words[0] == "evaluate" else "")}
        out.append((f"command {words[0]}", f"{code} {short.get(words[0], '')}".strip()))
    return out


INTERFACES = [
    ("first is active", "b"), ("activate", "True False ['a', 'b']"), ("twice", "ValueError"), ("delete", "True False"), ("name", "a_b_c"),
    ("0 POST /api/ask", "200 [[3]]"), ("1 POST /api/ask", "400 error"), ("2 GET /api/health", "200 active_db"), ("3 GET /api/schema", "200 4"), ("4 GET /api/history", "200 1"), ("5 POST /api/train", "200 examples"),
    ("6 POST /api/databases", "201 name"), ("7 POST /api/databases", "409 error"), ("8 GET /api/databases", "200 1"), ("9 POST /api/databases/tpc_h/activate", "200 active"),
    ("10 POST /api/databases/tpc_h/regenerate", "200 name"), ("11 DELETE /api/databases/tpc_h", "200 deleted"), ("12 DELETE /api/databases/tpc_h", "404 error"), ("13 POST /api/databases/no/activate", "404 error"), ("14 GET /nothing", "404 error"),
    ("command bootstrap", "0 14 tables"), ("command annotate", "0"), ("command diff", "0 True"), ("command apply", "0"), ("command discard", "0 False"), ("command train", "0 True"),
    ("command ask", "0 SELECT COUNT(*) AS `count` FROM `region`"), ("command evaluate", "0 2"),
]

CASES: dict[str, tuple[Callable[[SparkSession, str], Cases], Cases]] = {
    "guard_cases": (guard_cases, GUARD),
    "limit_cases": (limit_cases, LIMITS),
    "language_cases": (language_cases, LANGUAGE),
    "plan_cases": (plan_cases, PLANS),
    "answers": (answers, ANSWERS),
    "catalog_cases": (catalog_cases, CATALOG_CASES),
    "learning_cases": (learning_cases, LEARNING),
    "interface_cases": (interface_cases, INTERFACES),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, run=run_: spark.createDataFrame(run(spark, sf_dir), "item string, outcome string") for name, (run_, _) in CASES.items()}


def values(rows: list[tuple], columns: list[str]) -> str:
    """SQL of a table given by its rows."""
    said = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT {', '.join(columns)} FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


def oracle_sql() -> dict[str, str]:
    return {name: values(rows, ["item", "outcome"]) for name, (_, rows) in CASES.items()}
