import json
import threading
import urllib.request
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from askframe.engine import Engine, Frames
from askframe.operators import annotate, evaluate, training
from askframe.operators.runner import QueryTimeout, jsonable, run
from askframe.plans import guard
from askframe.plans.render import render
from askframe.server import route, serve
from askframe.sources import demo, introspect
from askframe.sources.catalog import Catalog, Column, Table, load, save
from askframe.sources.history import History
from askframe.sources.registry import Database, Registry, safe_name
from tests.conftest import SF
from tests.fixtures import FLEET, FLEET_ROWS, SHOP, SHOP_ROWS, catalog, frames


@pytest.fixture(scope="module")
def fleet(spark):
    return Engine(spark, FLEET, Frames(spark, given=frames(spark, FLEET_ROWS)))


@pytest.fixture(scope="module")
def shop(spark):
    return Engine(spark, SHOP, Frames(spark, given=frames(spark, SHOP_ROWS)))


@pytest.mark.parametrize(
    "question, rows",
    [
        ("how many employees are there", [[3]]),
        ("total salary of employees", [[60.0]]),
        ("average salary", [[20.0]]),
        ("earliest hired date for employees", [["2020-01-01"]]),
        ("total users belongs to org swaraj", [[2]]),
        ("count active employees", [[2]]),
        ("count employees that are not active", [[1]]),
        ("how many employees of organization Acme", [[1]]),
        ("count clients without email", [[1]]),
        ("count employees with salary between 15 and 40", [[2]]),
        ("are there any employees named 'Nobody'", [[False]]),
    ],
)
def test_answers(fleet, question, rows):
    assert fleet.ask(question)["rows"] == rows


def test_shop(shop):
    assert shop.ask("list all products under the Pizza category")["row_count"] == 3
    assert shop.ask("count products named '5000'")["rows"] == [[1]]
    assert shop.ask("count orphan")["rows"] == [[0]] and shop.ask("are there any orphan")["rows"] == [[False]]
    assert shop.ask("sum of price of products")["rows"] == [[21.5]]
    assert shop.frame("count products named foo_bar").first()[0] == 1  # the underscore is no wildcard
    top = shop.ask("top 2 products by price")
    assert [r[-1] for r in top["rows"]] == [9.5, 7.0]


def test_spec_and_sql_agree(shop, fleet):
    for e, c in ((shop, SHOP), (fleet, FLEET)):
        asked = evaluate.questions(c, {("categories", "name"): ["Drinks"], ("Organization", "name"): ["Acme"]}, n=25)
        out = evaluate.evaluate(e.spark, asked, e.frame, lambda q, e=e: e.sql(render(e.plan(q).spec)))
        assert {r.verdict for r in out.collect()} == {"match"}


def test_failures_are_told(fleet):
    assert fleet.ask("zzz qqq")["error"] == "no_sql_generated"
    dry = fleet.ask("list all clients", execute=False)
    assert dry["rows"] == [] and dry["sql"].startswith("SELECT")
    with pytest.raises(ValueError):
        fleet.ask("x")


# -- guard ---------------------------------------------------------------------------------------------------------------

EMPLOYEES = ["Employee", "Client"]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT name FROM Employee", "select * from employee;", "SELECT e.name FROM Employee e JOIN Client c ON e.clientId = c.id", "SELECT name, COUNT(*) FROM Employee GROUP BY name",
        "SELECT name FROM Employee UNION SELECT name FROM Client", "(SELECT name FROM Employee)", "WITH x AS (SELECT * FROM Employee) SELECT * FROM x", "SELECT * FROM Employee WHERE id IN (SELECT id FROM Client)",
        "SELECT ROW_NUMBER() OVER (ORDER BY id) FROM Employee", "SELECT COUNT(*) FROM Employee", "SELECT name FROM Employee LIMIT 10", "SELECT name FROM Employee INTERSECT SELECT name FROM Client",
    ],
)
def test_guard_accepts(spark, sql):
    assert set(guard.check(spark, sql, EMPLOYEES).tables) <= set(EMPLOYEES)


@pytest.mark.parametrize(
    "sql",
    [
        "", ";", "garbage here", "DELETE FROM Employee", "UPDATE Employee SET name = 'x'", "INSERT INTO Employee VALUES (1)", "DROP TABLE Employee", "CREATE TABLE t (a INT)", "ALTER TABLE Employee ADD COLUMN x INT",
        "TRUNCATE TABLE Employee", "SELECT 1; SELECT 2", "SELECT * FROM Secret", "SELECT * FROM Employee WHERE id IN (SELECT id FROM Secret)", "SELECT (SELECT MAX(id) FROM Secret) FROM Employee",
        "WITH x AS (SELECT * FROM Secret) SELECT * FROM x", "SELECT * FROM parquet.`/etc/passwd`", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT reflect('a', 'b')", "SELECT input_file_name() FROM Employee",
        "SELECT pg_sleep(10)", "SELECT * FROM range(10)", "SET spark.x = 1", "EXPLAIN SELECT * FROM Employee", "MERGE INTO Employee USING Client ON true WHEN MATCHED THEN DELETE", "SHOW TABLES", "CACHE TABLE Employee",
        "SELECT * FROM Employee e WHERE EXISTS (SELECT 1 FROM Secret s WHERE s.id = e.id)", "SELECT * FROM a.Employee",
    ],
)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.check(spark, sql, EMPLOYEES)


#: Every place of a statement that holds an expression.
PLACES = [
    "SELECT {} AS x FROM Employee", "SELECT name FROM Employee WHERE {} IS NOT NULL", "SELECT e.name FROM Employee e JOIN Client c ON e.id = c.id AND {} = 'x'", "SELECT COUNT(*) AS n FROM Employee GROUP BY {}",
    "SELECT name, COUNT(*) AS n FROM Employee GROUP BY name HAVING MAX({}) = 'x'", "SELECT name FROM Employee ORDER BY {}", "SELECT row_number() OVER (ORDER BY {}) AS x FROM Employee",
    "SELECT row_number() OVER w AS x FROM Employee WINDOW w AS (ORDER BY {})", "SELECT count(*) OVER w AS x FROM Employee WINDOW w AS (PARTITION BY {})", "WITH x AS (SELECT {} AS a FROM Employee) SELECT a FROM x",
    "SELECT name FROM Employee WHERE id IN (SELECT id FROM Client WHERE {} = 'x')", "SELECT (SELECT MAX({}) FROM Client) AS x FROM Employee", "SELECT name FROM Employee UNION SELECT {} FROM Client",
    "SELECT * FROM VALUES ({}) AS t(a)", "SELECT x FROM Employee LATERAL VIEW explode(array({})) t AS x", "SELECT name, y FROM Employee, LATERAL (SELECT {} AS y)",
    "SELECT * FROM (SELECT name, id FROM Employee) PIVOT (MAX({}) FOR id IN (1, 2))", "SELECT transform(array(name), v -> concat(v, {})) AS x FROM Employee", "SELECT CASE WHEN {} = 'x' THEN 1 ELSE 2 END AS x FROM Employee",
    "SELECT COUNT(*) FILTER (WHERE {} = 'x') AS n FROM Employee", "SELECT name FROM Employee GROUP BY CUBE (name, {})",
]
OUTSIDE = [
    "reflect('java.lang.System', 'getProperty', 'user.name')", "java_method('java.lang.System', 'getProperty', 'user.name')", "input_file_name()", "(SELECT MAX(text) FROM parquet.`/root/testdata/sf0.001/documents.parquet`)",
    "(SELECT MAX(name) FROM Secret)", "current_user()", "version()", "repeat('x', 2000000000)", "some_udf(name)", "a.b(name)",
]


@pytest.mark.parametrize("place", PLACES)
def test_nothing_forbidden_passes_anywhere(spark, place):
    assert guard.check(spark, place.format("upper('x')"), EMPLOYEES)  # the place itself is fine
    for what in OUTSIDE:
        with pytest.raises(guard.GuardError):
            guard.check(spark, place.format(what), EMPLOYEES)


def test_the_analysed_plan_is_checked_too(spark, shop, monkeypatch):
    monkeypatch.setattr(guard, "check", lambda spark, sql, *a: guard.Checked(sql, ("products",), 5))
    assert shop.sql("SELECT id FROM products WHERE id IN (SELECT MAX(id) FROM products)").count() == 1
    for sql in ("SELECT count(*) OVER w AS n FROM products WINDOW w AS (PARTITION BY (SELECT max(doc_id) FROM parquet.`/root/testdata/sf0.001/documents.parquet`))", "SELECT row_number() OVER w AS n FROM products WINDOW w AS (ORDER BY reflect('java.lang.System', 'getProperty', 'user.name'))", "SELECT * FROM range(3)"):
        with pytest.raises(guard.GuardError):
            shop.sql(sql)


def test_sized_functions_need_a_small_size(spark):
    assert guard.check(spark, "SELECT lpad(name, 5, '0') AS x, repeat('a', 3) AS y FROM Employee", EMPLOYEES)
    for sql in ("SELECT repeat('a', id) FROM Employee", "SELECT lpad(name, 2000000000, '0') FROM Employee", "SELECT space(99999) FROM Employee", "SELECT sequence(1, 2000000000) FROM Employee"):
        with pytest.raises(guard.GuardError):
            guard.check(spark, sql, EMPLOYEES)


def test_limits(spark, shop):
    assert guard.check(spark, "SELECT COUNT(*) FROM Employee", EMPLOYEES).limit is None
    assert guard.check(spark, "SELECT COUNT(*) > 0 FROM Employee", EMPLOYEES).limit is None
    assert guard.check(spark, "SELECT name, COUNT(*) FROM Employee GROUP BY name", EMPLOYEES, 50).limit == 50
    small = Engine(spark, SHOP, shop.tables, max_rows=2)
    assert small.run_sql("SELECT id FROM products LIMIT 4").row_count == 2
    assert small.run_sql("SELECT id FROM products UNION SELECT id FROM categories").row_count == 2
    assert small.run_sql("SELECT id FROM products ORDER BY id LIMIT 1").rows == [[1]]


def test_run_truncates_and_stops(spark):
    r = run(spark.range(10).toDF("n"), 3)
    assert r.truncated and r.rows == [[0], [1], [2]] and not run(spark.range(3).toDF("n"), 3).truncated
    slow = spark.range(0, 10**12, 1, 4).where(F.sin("id") + F.cos("id") * F.sqrt("id") == F.lit(0.123456789)).limit(1)
    with pytest.raises(QueryTimeout):
        run(slow, 1, timeout_ms=700)


def test_jsonable():
    assert [jsonable(v) for v in (None, "a", 1, True, Decimal("1.5"), date(2020, 1, 2), datetime(2020, 1, 2, 3))] == [None, "a", 1, True, 1.5, "2020-01-02", "2020-01-02 03:00:00"]


# -- metadata ------------------------------------------------------------------------------------------------------------


def test_yaml_round_trip(tmp_path):
    path = str(tmp_path / "c.yml")
    assert save(FLEET, path) == 4 and load(path).to_dict() == FLEET.to_dict() and load(path) is load(path)
    assert "Employee" in FLEET.summary() and "Client" not in FLEET.summary(["Organization"])


def test_introspection(spark):
    c = introspect.from_parquet(spark, SF, only=["region", "nation", "customer", "orders"])
    assert c.table("nation").column("n_regionkey").fk == "region.r_regionkey" and c.table("orders").column("o_custkey").fk == "customer.c_custkey"
    assert c.table("region").column("r_regionkey").pk and c.table("orders").column("o_orderdate").type == "timestamp"
    assert "documents" in introspect.parquet_tables(spark, SF)


def test_native_types_and_dialects():
    assert introspect.native_type("tinyint(1)", "mysql") == "boolean" and introspect.native_type("tinyint(4)", "mysql") == "smallint" and introspect.native_type("datetime", "mysql") == "timestamp"
    assert introspect.native_type("character varying", "postgres") == "string" and introspect.native_type("cidr", "postgres") == "cidr"
    assert introspect.dialect_of("jdbc:mariadb://h/d") == "mysql" and introspect.dialect_of("postgresql://h/d") == "postgres"


def test_information_schema(spark):
    columns = spark.createDataFrame([("a", "id", "integer", 1), ("b", "id", "uuid", 1), ("b", "a_id", "integer", 2)], "table_name string, column_name string, data_type string, ordinal_position int")
    pk = spark.createDataFrame([("a", "id"), ("b", "id")], "table_name string, column_name string")
    fk = spark.createDataFrame([("b", "a_id", "a", "id")], "table_name string, column_name string, rt string, rc string")
    c = introspect.from_information_schema(columns, pk, fk, "postgres")
    assert c.table("b").column("a_id").fk == "a.id" and c.table("a").column("id").pk


def test_junctions():
    c = introspect.junctions(Catalog("", "", [Table("U", [Column("id", pk=True)]), Table("R", [Column("id", pk=True)]), Table("UR", [Column("u", pk=True, fk="U.id"), Column("r", pk=True, fk="R.id"), Column("createdAt")])]))
    assert [(r.to, r.type, r.via) for r in c.table("U").relationships] == [("R", "many-to-many", "UR")] and "Connects" in c.table("UR").description


def test_annotations(tmp_path):
    c = catalog(Client=["id uuid pk", "name string", "GSTIN string", "paymentTerm integer", "createdAt timestamptz"])
    c.tables[0].columns[1].description = "kept"
    once = annotate.annotate(c)
    assert once.table("Client").column("name").description == "kept" and once.table("Client").column("paymentTerm").synonyms[0] == "payment term"
    assert once.table("Client").column("GSTIN").synonyms and not once.table("Client").column("id").synonyms and not once.table("Client").column("createdAt").synonyms
    assert annotate.annotate(once).to_dict() == once.to_dict()
    path = str(tmp_path / "c.yml")
    save(c, path)
    annotate.propose(path)
    assert "+" in annotate.diff(path)
    assert annotate.apply(path) and load(path).to_dict() == once.to_dict() and not annotate.discard(path)
    assert annotate.annotate_file(path) == 1


def test_samples(spark):
    df = spark.createDataFrame([("abcdef",), ("x",), ("x",), ("",), (None,)], "c string")
    assert sorted(r[0] for r in introspect.distinct_samples(df, "c", 10, 3).collect()) == ["abc…", "x"]


def test_registry(tmp_path):
    r = Registry(str(tmp_path / "r.json"))
    r.insert(Database("b", "/b"))
    r.insert(Database("a", "/a"))
    assert [d.name for d in r.list()] == ["b", "a"] and r.active().name == "b"
    assert r.activate("a") and not r.activate("zz") and [d.name for d in r.list()] == ["a", "b"]
    with pytest.raises(ValueError):
        r.insert(Database("a", "/a"))
    r.set_table_count("a", 3)
    assert r.get("a").table_count == 3 and r.delete("b") and not r.delete("b") and safe_name("a b/c") == "a_b_c" and safe_name("") == "db"


def test_history_and_training(spark, tmp_path):
    h = History(str(tmp_path / "h"))
    assert h.recent(spark).count() == 0
    ids = [h.record(question=q, sql=s, status=st, tables_used=["t"]) for q, s, st in [("odd thing A", "SELECT COUNT(*) FROM t", "ok"), ("odd thing B", "SELECT COUNT(*) > 0 FROM t", "ok"), ("bad", "SELECT 1", "exec_error"), ("ODD thing a ", "SELECT MAX(x) FROM t", "ok")]]
    assert ids == sorted(ids) and [r.question for r in h.recent(spark, 2).collect()] == ["ODD thing a ", "bad"] and h.recent(spark, 1).first().tables_used == ["t"]
    found = {r.question: r.label for r in training.harvest(h.table(spark)).collect()}
    assert found == {"odd thing A": "count", "odd thing B": "exists", "ODD thing a": "max"}
    seed = spark.createDataFrame([("odd thing b", "list")], "question string, label string")
    assert {r.question: (r.label, r.origin) for r in training.merge(seed, training.harvest(h.table(spark))).collect()} == {"odd thing b": ("list", "seed"), "ODD thing a": ("max", "history")}
    with pytest.raises(ValueError):
        h.record(nonsense=1)
    report = training.train(spark, h.table(spark), str(tmp_path / "m.json"))
    assert report["from_history"] == 2 and report["examples"] == report["from_seed"] + 2


def test_signature_and_verdicts(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert evaluate.signature(a).first()[0] == evaluate.signature(a.orderBy(F.desc("i"))).first()[0] != evaluate.signature(a.limit(1)).first()[0]
    rows = [(1, 1, "a", "a"), (1, 1, "a", "b"), (1, 2, "a", "b"), (None, 1, None, "b"), (1, None, "a", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, m int, a string, b string").select(evaluate.verdict(F.col("n"), F.col("m"), F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == ["match", "count_match", "diverge", "other_only", "own_only", "both_fail"]


def test_evaluation_report(spark, tmp_path):
    out = spark.createDataFrame([("b", "q", 1, "s", 2, "t", "diverge")], "bucket string, question string, own_rows int, own_signature string, other_rows int, other_signature string, verdict string")
    assert evaluate.report(out, str(tmp_path / "r"))["verdicts"] == {"diverge": 1} and (tmp_path / "r" / "failures.csv").read_text().count("\n") == 2


# -- whole engine --------------------------------------------------------------------------------------------------------


def test_register_ask_train(spark, tmp_path):
    e = Engine(spark, SHOP, Frames(spark), home=str(tmp_path))
    e.register("tpc h", SF)
    assert e.databases()[0]["name"] == "tpc_h" and e.health()["active_db"] == "tpc_h"
    assert e.ask("how many customers are there")["rows"] == [[150]]
    assert [h["status"] for h in e.history()] == ["ok"]
    assert e.train()["from_history"] == 0 or e.model is not None  # the question is one of the seed's frames
    assert e.ask("how many customers are there")["model"] == "trained"
    assert e.regenerate("tpc_h") >= 10 and any(t["name"] == "region" for t in e.schema())
    with pytest.raises(ValueError):
        e.register("tpc h", SF)
    assert e.unregister("tpc_h") and not e.unregister("tpc_h")


class Jdbc:
    """Stands in for Spark's JDBC reader: tables and information_schema from frames."""

    def __init__(self, spark, tables):
        self.spark, self.tables, self.asked = spark, tables, []

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.asked.append(options)
        return self

    def load(self):
        o = self.asked[-1]
        if "dbtable" in o:
            return self.tables[o["dbtable"].strip('"`')]
        if "information_schema.columns" in o["query"]:
            rows = [(t, f.name, {"int": "integer", "double": "numeric"}.get(f.dataType.simpleString(), "text"), i) for t, df in self.tables.items() for i, f in enumerate(df.schema.fields)]
            return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position int")
        keys = [("products", "category_id", "x", "categories", "id")] if "FOREIGN" in o["query"] else [("products", "id", "PRIMARY", None, None), ("categories", "id", "PRIMARY", None, None)]
        return self.spark.createDataFrame(keys, "table_name string, column_name string, constraint_name string, rt string, rc string")


def test_databases_over_jdbc(spark, tmp_path, monkeypatch):
    tables = {k: v for k, v in frames(spark, SHOP_ROWS).items() if k != "orphan"}
    jdbc = Jdbc(spark, tables)
    parquet = type(spark).read.fget(spark)
    jdbc.schema, jdbc.json = parquet.schema, parquet.json  # the history's reader
    monkeypatch.setattr(type(spark), "read", property(lambda s: jdbc))
    e = Engine(spark, FLEET, Frames(spark), home=str(tmp_path))
    db = e.register("shop", dialect="postgres", host="db.example", dbname="shop", username="u", password="secret")
    assert (db.path, db.dialect, db.table_count) == ("jdbc:postgresql://db.example:5432/shop", "postgres", 2)
    assert e.ask("sum of price of products")["rows"] == [[21.5]] and e.ask("list all products under the Pizza category")["row_count"] == 3
    assert jdbc.asked[-1] == {"url": db.path, "dbtable": '"categories"', "user": "u", "password": "secret"}
    assert "secret" not in "".join(f.read_text() for f in tmp_path.rglob("*") if f.is_file())
    assert e.regenerate("shop") == 2 and e.catalog.table("products").column("category_id").fk == "categories.id"
    with pytest.raises(ValueError):
        e.register("other", dialect="oracle", host="h", dbname="d")
    with pytest.raises(ValueError):
        e.register("other", dialect="mysql", host="h/x?y", dbname="d")
    assert introspect.jdbc_url("mysql", "h", None, "d") == "jdbc:mysql://h:3306/d"
    introspect.from_jdbc(spark, "jdbc:postgresql://h/d", schema="it's")
    assert "'it''s'" in jdbc.asked[-1]["query"]
    introspect.jdbc_table(spark, "jdbc:mysql://h/d", "products")
    assert jdbc.asked[-1]["dbtable"] == "`products`"


def test_all_statuses_are_recorded(spark, shop, tmp_path, monkeypatch):
    e = Engine(spark, SHOP, shop.tables, home=str(tmp_path))
    e.ask("how many products")
    e.ask("zzz qqq")
    e.run_sql("SELECT name FROM products")
    for bad in ("SELECT * FROM secret", "SELECT CAST('x' AS INT) AS n FROM products"):
        with pytest.raises(Exception):
            e.run_sql(bad)
    monkeypatch.setattr("askframe.engine.alternatives", lambda *a, **k: 1 / 0)
    assert e.ask("how many products")["error"].startswith("planning_failed")
    assert [h["status"] for h in e.history()] == ["gen_error", "exec_error", "invalid_sql", "ok", "no_sql", "ok"]


def test_http(spark, tmp_path, fleet):
    e = Engine(spark, FLEET, fleet.tables, home=str(tmp_path))
    assert route(e, "GET", "/api/health", {}, {})[1]["tables"] == 4 and route(e, "GET", "/nothing", {}, {})[0] == 404
    assert route(e, "POST", "/api/ask", {}, {"question": "x"})[0] == 400 and route(e, "POST", "/api/databases/no/activate", {}, {})[0] == 404
    server = serve(e, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    ask = urllib.request.Request(f"{base}/api/ask", json.dumps({"question": "how many employees are there"}).encode())
    assert json.load(urllib.request.urlopen(ask))["rows"] == [[3]]
    assert b"askframe" in urllib.request.urlopen(base).read() and len(json.load(urllib.request.urlopen(f"{base}/api/history"))) == 1
    server.shutdown()


def test_plan_is_pruned_and_pushed_down(spark):
    e = Engine(spark, demo.catalog(), Frames(spark, SF))
    plan = e.frame("count parts with size 15")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<p_size:int>" in plan and "EqualTo(p_size,15)" in plan
    top = e.frame("top 5 customers by account balance")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top


def test_registered_queries_match_their_sql(spark):
    from askframe import cases, queries

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    text = lambda v: "null" if v is None else str(round(v, 4)) if isinstance(v, float) else str(v)
    runs, sql = queries.queries(), queries.oracle_sql()
    for name in ("count_simple", "like_implicit", "join_multi_hop", "is_null", "topn", "between_date", "gateway_cte", "gateway_rollup", "gateway_except", "train_merge", "result_signature", "verdicts", "introspect_keys", "annotate_catalog", "alternative_readings", "questions_planned", *cases.CASES):
        df = runs[name](spark, SF)
        other = con.sql(sql[name])
        order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        order2 = sorted(range(len(other.columns)), key=lambda i: other.columns[i])
        assert [df.columns[i] for i in order] == [other.columns[i] for i in order2], name
        assert sorted([text(r[i]) for i in order] for r in df.collect()) == sorted([text(r[i]) for i in order2] for r in other.fetchall()), name
