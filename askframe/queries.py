"""Registered queries over the demonstration tables: questions, guarded SQL, and metadata pipelines, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe import cases
from askframe.engine import Engine, Frames
from askframe.operators import evaluate, training
from askframe.operators.annotate import annotate
from askframe.plans.planner import alternatives
from askframe.plans.render import render
from askframe.sources import demo, introspect
from askframe.sources.history import SCHEMA

Query = Callable[[SparkSession, str], DataFrame]

FLAGS = "(SELECT doc_id, quality = 1 AS is_quality, toxic = 1 AS is_toxic FROM labels)"
QUALITY = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
ASIA = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) LIKE '%asia%'"

#: name -> (question, SQL, digits that the first column is rounded to, or None).
QUESTIONS: dict[str, tuple[str, str, int | None]] = {
    "count_simple": ("how many customers are there", 'SELECT COUNT(*) AS "count" FROM customer', None),
    "count_total_plural": ("total orders", 'SELECT COUNT(*) AS "count" FROM orders', None),
    "exists_true": ("are there any suppliers", 'SELECT COUNT(*) > 0 AS "exists" FROM supplier', None),
    "exists_false": ("is there an order with order status 'Z'", "SELECT COUNT(*) > 0 AS \"exists\" FROM orders WHERE o_orderstatus = 'Z'", None),
    "sum_num": ("sum of extended price in lineitem", 'SELECT ROUND(SUM(l_extendedprice), 2) AS "sum" FROM lineitem', 2),
    "avg_num": ("average account balance of customers", 'SELECT ROUND(AVG(c_acctbal), 4) AS "avg" FROM customer', 4),
    "min_num": ("lowest retail price of parts", 'SELECT MIN(p_retailprice) AS "min" FROM part', None),
    "max_num": ("highest retail price of parts", 'SELECT MAX(p_retailprice) AS "max" FROM part', None),
    "min_date": ("earliest order date of orders", 'SELECT MIN(o_orderdate) AS "min" FROM orders', None),
    "max_date": ("latest ship date of lineitem", 'SELECT MAX(l_shipdate) AS "max" FROM lineitem', None),
    "list_default": ("list regions", "SELECT r_name, r_regionkey FROM region", None),
    "list_explicit": ("show name of nations", "SELECT n_name FROM nation", None),
    "topn": ("top 5 customers by account balance", "SELECT c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 5", None),
    "limit_agg": ("count customers limit 5", 'SELECT COUNT(*) AS "count" FROM customer LIMIT 5', None),
    "eq_string": ("count orders with order priority '1-URGENT'", "SELECT COUNT(*) AS \"count\" FROM orders WHERE o_orderpriority = '1-URGENT'", None),
    "eq_number": ("count parts with size 15", 'SELECT COUNT(*) AS "count" FROM part WHERE p_size = 15', None),
    "eq_date": ("count orders with order date 1995-01-01", "SELECT COUNT(*) AS \"count\" FROM orders WHERE o_orderdate = DATE '1995-01-01'", None),
    "cmp_number": ("count lineitem with quantity greater than 45", 'SELECT COUNT(*) AS "count" FROM lineitem WHERE l_quantity > 45', None),
    "cmp_decimal": ("count lineitem with discount at least 0.05", 'SELECT COUNT(*) AS "count" FROM lineitem WHERE l_discount >= 0.05', None),
    "between_number": ("count parts with size between 10 and 20", 'SELECT COUNT(*) AS "count" FROM part WHERE p_size BETWEEN 10 AND 20', None),
    "between_date": ("count orders with order date between 1996-01-01 and 1996-12-31", "SELECT COUNT(*) AS \"count\" FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", None),
    "like_implicit": ("count nations in region ASIA", "SELECT COUNT(*) AS \"count\" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) LIKE '%asia%'", None),
    "like_value_first": ("count customers in EUROPE region", "SELECT COUNT(*) AS \"count\" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) LIKE '%europe%'", None),
    "like_named": ("list nations named NATION_3", "SELECT n_nationkey, n_regionkey, n_name FROM nation WHERE n_name ILIKE '%NATION\\_3%' ESCAPE '\\'", None),
    "bool_true": ("count doc flags that are toxic", f'SELECT COUNT(*) AS "count" FROM {FLAGS} WHERE is_toxic', None),
    "bool_false": ("count doc flags that are not toxic", f'SELECT COUNT(*) AS "count" FROM {FLAGS} WHERE NOT is_toxic', None),
    "is_null": ("count doc quality without toxic", f'SELECT COUNT(*) AS "count" FROM {QUALITY} WHERE toxic IS NULL', None),
    "not_null": ("count doc quality where toxic is not null", f'SELECT COUNT(*) AS "count" FROM {QUALITY} WHERE toxic IS NOT NULL', None),
    "join_1hop": ("how many nations belong to region AFRICA", "SELECT COUNT(*) AS \"count\" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) LIKE '%africa%'", None),
    "join_multi_hop": ("count orders for region ASIA", f'SELECT COUNT(*) AS "count" FROM {ASIA}', None),
    "join_two_table_list": ("nations with their regions", "SELECT n_name, n_nationkey, n_regionkey, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey", None),
    "agg_cross_table": ("sum of total price of orders for region ASIA", f'SELECT ROUND(SUM(o_totalprice), 2) AS "sum" FROM {ASIA}', 2),
}

#: name -> (SQL behind the guard, the same for DuckDB).
GATEWAY: dict[str, str] = {
    "gateway_groupby": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "gateway_having": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 1",
    "gateway_union": "SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region",
    "gateway_join": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "gateway_left_join": "SELECT r.r_name, COUNT(n.n_nationkey) AS n FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20 GROUP BY r.r_name",
    "gateway_window": "SELECT n_name, n_regionkey, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation",
    "gateway_rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "gateway_cte": "WITH rich AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000) SELECT n_name, COUNT(*) AS n FROM rich JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "gateway_subquery": "SELECT COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "gateway_exists": "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)",
    "gateway_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "gateway_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 10",
    "gateway_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
}

#: Logged questions for the learning queries: id, status, question, sql.
LOG = [
    (1, "ok", "how many regions", "SELECT COUNT(*) AS count FROM region"),
    (2, "ok", "How many regions ", "SELECT COUNT(*) AS count FROM region"),
    (3, "ok", "any suppliers", "SELECT COUNT(*) > 0 AS exists FROM supplier"),
    (4, "ok", "best customers", "SELECT c_name FROM customer ORDER BY c_acctbal DESC LIMIT 5"),
    (5, "exec_error", "broken", "SELECT SUM(x) FROM y"),
    (6, "ok", "total of it all", "SELECT SUM(o_totalprice) AS sum FROM orders"),
    (7, "ok", "all regions", "SELECT r_name FROM region"),
    (8, "ok", "mean price", "SELECT AVG(p_retailprice) FROM part"),
    (9, "no_sql", "gibberish", None),
]
SEED = [("how many regions", "count"), ("list regions", "list")]
_LOG_SQL = "(VALUES " + ", ".join(f"({i}, '{s}', '{q}', {'NULL' if x is None else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39)})" for i, s, q, x in LOG) + ") AS h(id, status, question, sql)"
_LABEL_SQL = """CASE WHEN regexp_matches(sql, 'order\\s+by.+desc.*limit', 'is') THEN 'top' WHEN regexp_matches(sql, 'count\\s*\\([^)]*\\)\\s*>\\s*0', 'is') THEN 'exists'
    WHEN regexp_matches(sql, '\\bcount\\s*\\(', 'is') THEN 'count' WHEN regexp_matches(sql, '\\bsum\\s*\\(', 'is') THEN 'sum' WHEN regexp_matches(sql, '\\bavg\\s*\\(', 'is') THEN 'avg'
    WHEN regexp_matches(sql, '\\bmin\\s*\\(', 'is') THEN 'min' WHEN regexp_matches(sql, '\\bmax\\s*\\(', 'is') THEN 'max' WHEN regexp_matches(sql, '^\\s*select\\b', 'is') THEN 'list' END"""
_HARVEST_SQL = f"SELECT trim(question) AS question, {_LABEL_SQL} AS label, CAST(id AS BIGINT) AS id FROM {_LOG_SQL} WHERE status = 'ok' AND question IS NOT NULL AND sql IS NOT NULL"


def engine(spark: SparkSession, sf_dir: str, max_rows: int = 1_000_000) -> Engine:
    return Engine(spark, demo.catalog(), Frames(spark, sf_dir, demo.derived(spark, sf_dir)), max_rows=max_rows)


def _question(text: str, digits: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).frame(text)
        return df if digits is None else df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) for c in df.columns])

    return run


def _gateway(sql: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(sql)


def _log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q, x, s) for i, s, q, x in LOG], "id bigint, question string, sql string, status string")


def sample_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.distinct_samples(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment", 10, 6)


def history_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.harvest(_log(spark))


def train_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.merge(spark.createDataFrame(SEED, "question string, label string"), training.harvest(_log(spark)))


def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = spark.createDataFrame([], SCHEMA).select("id", "question", "sql", "status")
    return full.unionByName(_log(spark)).orderBy(F.desc("id")).limit(3)


def result_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.signature(spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated questions over two small tables: the engine's DataFrame against its SQL through the gateway."""
    e = engine(spark, sf_dir)
    small = demo.catalog()
    small.tables = [t for t in small.tables if t.name in ("region", "nation")]
    asked = evaluate.questions(small, {("region", "r_name"): ["ASIA"]}, n=12)
    out = evaluate.evaluate(spark, asked, e.frame, lambda q: e.sql(render(e.plan(q).spec, "spark")))
    return out.select("bucket", "question", "own_rows", "other_rows", "verdict")


def introspect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all tables with the keys that introspection infers."""
    c = introspect.from_parquet(spark, sf_dir)
    rows = [(t.name, x.name, x.type, x.pk, x.fk) for t in c.tables for x in t.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, pk boolean, fk string")


def annotate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions and synonyms of all tables' columns."""
    c = annotate(introspect.from_parquet(spark, sf_dir))
    rows = [(t.name, x.name, x.description, ", ".join(x.synonyms)) for t in c.tables for x in t.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, description string, synonyms string")


def alternative_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    found = alternatives("total price of orders", e.index)
    return spark.createDataFrame([(i, p.intent, p.confidence, render(p.spec)) for i, p in enumerate(found) if p.spec], "place int, intent string, confidence double, sql string")


def questions_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered questions planned as a batch."""
    return engine(spark, sf_dir).ask_many([q for q, _, _ in QUESTIONS.values()])


OTHERS = (sample_distinct, history_label, train_merge, history_recent, result_signature, verdicts, introspect_keys, annotate_catalog, alternative_readings, questions_planned)


#: What introspection must find in the demonstration tables: table, then column, type and PK or the key that it refers to.
KEYS = """
benchmark: item_id bigint, text string
conversations: conv_id bigint PK, turn bigint, role string, text string
customer: c_custkey bigint PK, c_name string, c_nationkey integer nation.n_nationkey, c_acctbal double_precision, c_mktsegment string
documents: doc_id bigint PK, text string, lang string, source string, n_chars bigint
embeddings: vec_id bigint, embedding ARRAY, label integer
events: event_id bigint PK, ts timestamp, user_id bigint, event_type string, value double_precision, props string
labels: doc_id bigint documents.doc_id, quality integer, toxic integer
lineitem: l_orderkey bigint orders.o_orderkey, l_partkey bigint part.p_partkey, l_suppkey bigint supplier.s_suppkey, l_linenumber integer, l_quantity double_precision, l_extendedprice double_precision, l_discount double_precision, l_tax double_precision, l_returnflag string, l_linestatus string, l_shipdate timestamp
nation: n_nationkey integer PK, n_name string, n_regionkey integer region.r_regionkey
orders: o_orderkey bigint PK, o_custkey bigint customer.c_custkey, o_orderstatus string, o_totalprice double_precision, o_orderdate timestamp, o_orderpriority string
pages: page_id bigint PK, url string, html string
part: p_partkey bigint PK, p_name string, p_brand string, p_type string, p_size integer, p_retailprice double_precision
region: r_regionkey integer PK, r_name string
supplier: s_suppkey bigint PK, s_name string, s_nationkey integer nation.n_nationkey, s_acctbal double_precision
"""  # fmt: skip
#: What annotation must say of them: table.column, description, synonyms.
NOTES = """
benchmark.item_id | Item id | item id, benchmark item id
benchmark.text | Text | content, benchmark text
conversations.conv_id | Identifier of conversations | -
conversations.turn | Turn | conversations turn
conversations.role | Role | conversations role
conversations.text | Text | content, conversations text
customer.c_custkey | Identifier of customer | -
customer.c_name | Name | name, title, label, customer name
customer.c_nationkey | Reference to nation | -
customer.c_acctbal | Account balance | account balance, funds, customer account balance
customer.c_mktsegment | Market segment | market segment, sector, customer market segment
documents.doc_id | Identifier of documents | -
documents.text | Text | content, documents text
documents.lang | Language | language, tongue, documents language
documents.source | Source | documents source
documents.n_chars | Chars | chars, documents chars
embeddings.vec_id | Vector id | vector id, embeddings vector id
embeddings.embedding | Embedding | embeddings embedding
embeddings.label | Label | embeddings label
events.event_id | Identifier of events | -
events.ts | Timestamp | -
events.user_id | User id | user id, events user id
events.event_type | Event type | event type, kind, events event type
events.value | Value | worth, events value
events.props | Props | events props
labels.doc_id | Reference to documents | -
labels.quality | Quality | labels quality
labels.toxic | Toxic | labels toxic
lineitem.l_orderkey | Reference to orders | -
lineitem.l_partkey | Reference to part | -
lineitem.l_suppkey | Reference to supplier | -
lineitem.l_linenumber | Linenumber | linenumber, lineitem linenumber
lineitem.l_quantity | Quantity | quantity, amount, units, count, volume
lineitem.l_extendedprice | Extendedprice | extendedprice, lineitem extendedprice
lineitem.l_discount | Discount | discount, rebate, reduction, lineitem discount
lineitem.l_tax | Tax | tax, duty, lineitem tax
lineitem.l_returnflag | Returnflag | returnflag, lineitem returnflag
lineitem.l_linestatus | Linestatus | linestatus, lineitem linestatus
lineitem.l_shipdate | When: shipdate | -
nation.n_nationkey | Identifier of nation | -
nation.n_name | Name | name, title, label, nation name
nation.n_regionkey | Reference to region | -
orders.o_orderkey | Identifier of orders | -
orders.o_custkey | Reference to customer | -
orders.o_orderstatus | Order status | order status, state, purchase, condition, orders order status
orders.o_totalprice | Totalprice | totalprice, orders totalprice
orders.o_orderdate | When: order date | -
orders.o_orderpriority | Order priority | order priority, urgency, purchase, orders order priority
pages.page_id | Identifier of pages | -
pages.url | Web address | web address, location, pages web address
pages.html | Html | pages html
part.p_partkey | Identifier of part | -
part.p_name | Name | name, title, label, part name
part.p_brand | Brand | brand, make, part brand
part.p_type | Type | type, kind, part type
part.p_size | Size | size, dimension, part size
part.p_retailprice | Retailprice | retailprice, part retailprice
region.r_regionkey | Identifier of region | -
region.r_name | Name | name, title, label, region name
supplier.s_suppkey | Identifier of supplier | -
supplier.s_name | Name | name, title, label, supplier name
supplier.s_nationkey | Reference to nation | -
supplier.s_acctbal | Account balance | account balance, funds, supplier account balance
"""  # fmt: skip
#: What must be planned for the questions above: intent, SQL, explanation.
PLANNED = """
count | SELECT COUNT(*) AS `count` FROM `customer` | COUNT(*) on customer
count | SELECT COUNT(*) AS `count` FROM `orders` | COUNT(*) on orders
exists | SELECT COUNT(*) > 0 AS `exists` FROM `supplier` | whether supplier has such rows
exists | SELECT COUNT(*) > 0 AS `exists` FROM `orders` WHERE `orders`.`o_orderstatus` = 'Z' | whether orders has such rows; filtered by orders.o_orderstatus =
sum | SELECT SUM(`lineitem`.`l_extendedprice`) AS `sum` FROM `lineitem` | SUM of lineitem.l_extendedprice
avg | SELECT AVG(`customer`.`c_acctbal`) AS `avg` FROM `customer` | AVG of customer.c_acctbal
min | SELECT MIN(`part`.`p_retailprice`) AS `min` FROM `part` | MIN of part.p_retailprice
max | SELECT MAX(`part`.`p_retailprice`) AS `max` FROM `part` | MAX of part.p_retailprice
min | SELECT MIN(`orders`.`o_orderdate`) AS `min` FROM `orders` | MIN of orders.o_orderdate
max | SELECT MAX(`lineitem`.`l_shipdate`) AS `max` FROM `lineitem` | MAX of lineitem.l_shipdate
list | SELECT `region`.`r_name`, `region`.`r_regionkey` FROM `region` LIMIT 1000000 | rows of region; at most 1000000 rows
list | SELECT `nation`.`n_name` FROM `nation` LIMIT 1000000 | rows of nation; at most 1000000 rows
top | SELECT `customer`.`c_name`, `customer`.`c_custkey`, `customer`.`c_nationkey`, `customer`.`c_acctbal`, `customer`.`c_mktsegment` FROM `customer` ORDER BY `customer`.`c_acctbal` DESC NULLS LAST LIMIT 5 | first 5 of customer by customer.c_acctbal, largest first; at most 5 rows
count | SELECT COUNT(*) AS `count` FROM `customer` LIMIT 5 | COUNT(*) on customer; at most 5 rows
count | SELECT COUNT(*) AS `count` FROM `orders` WHERE `orders`.`o_orderpriority` = '1-URGENT' | COUNT(*) on orders; filtered by orders.o_orderpriority =
count | SELECT COUNT(*) AS `count` FROM `part` WHERE `part`.`p_size` = 15 | COUNT(*) on part; filtered by part.p_size =
count | SELECT COUNT(*) AS `count` FROM `orders` WHERE `orders`.`o_orderdate` = CAST('1995-01-01' AS DATE) | COUNT(*) on orders; filtered by orders.o_orderdate =
count | SELECT COUNT(*) AS `count` FROM `lineitem` WHERE `lineitem`.`l_quantity` > 45 | COUNT(*) on lineitem; filtered by lineitem.l_quantity >
count | SELECT COUNT(*) AS `count` FROM `lineitem` WHERE `lineitem`.`l_discount` >= 0.05 | COUNT(*) on lineitem; filtered by lineitem.l_discount >=
count | SELECT COUNT(*) AS `count` FROM `part` WHERE `part`.`p_size` BETWEEN 10 AND 20 | COUNT(*) on part; filtered by part.p_size between
count | SELECT COUNT(*) AS `count` FROM `orders` WHERE `orders`.`o_orderdate` BETWEEN CAST('1996-01-01' AS DATE) AND CAST('1996-12-31' AS DATE) | COUNT(*) on orders; filtered by orders.o_orderdate between
count | SELECT COUNT(*) AS `count` FROM `nation` INNER JOIN `region` ON `nation`.`n_regionkey` = `region`.`r_regionkey` WHERE `region`.`r_name` ILIKE '%ASIA%' | COUNT(*) on nation; filtered by region.r_name contains; joined with region
count | SELECT COUNT(*) AS `count` FROM `customer` INNER JOIN `nation` ON `customer`.`c_nationkey` = `nation`.`n_nationkey` INNER JOIN `region` ON `nation`.`n_regionkey` = `region`.`r_regionkey` WHERE `region`.`r_name` ILIKE '%EUROPE%' | COUNT(*) on customer; filtered by region.r_name contains; joined with nation, region
list | SELECT `nation`.`n_name`, `nation`.`n_nationkey`, `nation`.`n_regionkey` FROM `nation` WHERE `nation`.`n_name` ILIKE '%NATION\\\\_3%' LIMIT 1000000 | rows of nation; filtered by nation.n_name contains; at most 1000000 rows
count | SELECT COUNT(*) AS `count` FROM `doc_flags` WHERE `doc_flags`.`is_toxic` = TRUE | COUNT(*) on doc_flags; filtered by doc_flags.is_toxic =
count | SELECT COUNT(*) AS `count` FROM `doc_flags` WHERE `doc_flags`.`is_toxic` = FALSE | COUNT(*) on doc_flags; filtered by doc_flags.is_toxic =
count | SELECT COUNT(*) AS `count` FROM `doc_quality` WHERE `doc_quality`.`toxic` IS NULL | COUNT(*) on doc_quality; filtered by doc_quality.toxic is_null
count | SELECT COUNT(*) AS `count` FROM `doc_quality` WHERE `doc_quality`.`toxic` IS NOT NULL | COUNT(*) on doc_quality; filtered by doc_quality.toxic not_null
count | SELECT COUNT(*) AS `count` FROM `nation` INNER JOIN `region` ON `nation`.`n_regionkey` = `region`.`r_regionkey` WHERE `region`.`r_name` ILIKE '%AFRICA%' | COUNT(*) on nation; filtered by region.r_name contains; joined with region
count | SELECT COUNT(*) AS `count` FROM `orders` INNER JOIN `customer` ON `orders`.`o_custkey` = `customer`.`c_custkey` INNER JOIN `nation` ON `customer`.`c_nationkey` = `nation`.`n_nationkey` INNER JOIN `region` ON `nation`.`n_regionkey` = `region`.`r_regionkey` WHERE `region`.`r_name` ILIKE '%ASIA%' | COUNT(*) on orders; filtered by region.r_name contains; joined with customer, nation, region
list | SELECT `nation`.`n_name`, `nation`.`n_nationkey`, `nation`.`n_regionkey`, `region`.`r_name`, `region`.`r_regionkey` FROM `nation` INNER JOIN `region` ON `nation`.`n_regionkey` = `region`.`r_regionkey` LIMIT 1000000 | rows of nation with region; joined with region; at most 1000000 rows
sum | SELECT SUM(`orders`.`o_totalprice`) AS `sum` FROM `orders` INNER JOIN `customer` ON `orders`.`o_custkey` = `customer`.`c_custkey` INNER JOIN `nation` ON `customer`.`c_nationkey` = `nation`.`n_nationkey` INNER JOIN `region` ON `nation`.`n_regionkey` = `region`.`r_regionkey` WHERE `region`.`r_name` ILIKE '%ASIA%' | SUM of orders.o_totalprice; filtered by region.r_name contains; joined with customer, nation, region
"""  # fmt: skip
VERDICTS = [("count", "how many nations are there", 1), ("list_basic", "list all nations", 25), ("is_null", "regions where name is null", 0), ("quoted_filter", "list regions with name 'ASIA'", 1), ("join_explicit", "show nations with their region", 25), ("list_basic", "show nations", 25), ("is_null", "nations where name is null", 0), ("count", "count nations", 1), ("count", "count regions", 1), ("list_basic", "list all regions", 5), ("is_null", "nations where regionkey is null", 0), ("string_filter", "count nations in region ASIA", 1)]


def _stated() -> dict[str, str]:
    """SQL of the tables above."""
    keys = []
    for line in KEYS.strip().splitlines():
        table, _, columns = line.partition(": ")
        for c in columns.split(", "):
            name, kind, *more = c.split()
            keys.append((table, name, kind.replace("_", " "), more == ["PK"], next((m for m in more if m != "PK"), None)))
    notes = [(*at.split("."), said, also) for at, said, also in (line.split(" | ") for line in NOTES.strip().splitlines())]
    planned = [(q, *line.split(" | ")) for q, line in zip([q for q, _, _ in QUESTIONS.values()], PLANNED.strip().splitlines(), strict=True)]
    other = [(0, "sum", 0.6, "SUM"), (1, "avg", 0.65, "AVG"), (2, "count", 0.6, "COUNT")]
    return {
        "introspect_keys": cases.values(keys, ["table_name", "column_name", "type", "pk", "fk"]),
        "annotate_catalog": cases.values([tuple("" if x == "-" else x for x in n) for n in notes], ["table_name", "column_name", "description", "synonyms"]),
        "questions_planned": cases.values([(q, intent, 0.6, sql, says) for q, intent, sql, says in planned], ["question", "intent", "confidence", "sql", "explanation"]),
        "alternative_readings": cases.values([(i, k, sure, f"SELECT {f}({'*' if k == 'count' else '`orders`.`o_totalprice`'}) AS `{k}` FROM `orders`") for i, k, sure, f in other], ["place", "intent", "confidence", "sql"]),
        "verdicts": cases.values([(b, q, n, n, "match") for b, q, n in VERDICTS], ["bucket", "question", "own_rows", "other_rows", "verdict"]),
    }


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _question(q, digits) for name, (q, _, digits) in QUESTIONS.items()}
    out |= {name: _gateway(sql) for name, sql in GATEWAY.items()}
    return out | {f.__name__: f for f in OTHERS} | cases.queries()


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql, _) in QUESTIONS.items()}
    out |= GATEWAY
    seed = ", ".join(f"('{q}', '{x}')" for q, x in SEED)
    out["sample_distinct"] = "SELECT DISTINCT CASE WHEN length(c_mktsegment) > 6 THEN substr(c_mktsegment, 1, 6) || '…' ELSE c_mktsegment END AS value FROM customer WHERE c_mktsegment <> ''"
    out["history_label"] = _HARVEST_SQL
    out["history_recent"] = f"SELECT CAST(id AS BIGINT) AS id, question, sql, status FROM {_LOG_SQL} ORDER BY id DESC LIMIT 3"
    out["train_merge"] = f"""SELECT question, label, origin FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY origin DESC, id DESC, label) AS n FROM (
        SELECT *, 0 AS id, 'seed' AS origin FROM (VALUES {seed}) AS s(question, label) UNION ALL SELECT question, label, id, 'history' FROM ({_HARVEST_SQL}) WHERE label IS NOT NULL)) WHERE n = 1"""
    out["result_signature"] = """SELECT substr(sha256('r_regionkey' || chr(30) || 'r_name' || chr(10) || string_agg(line, chr(10) ORDER BY line)), 1, 16) AS signature
        FROM (SELECT CAST(r_regionkey AS VARCHAR) || chr(31) || r_name AS line FROM region)"""
    return out | _stated() | cases.oracle_sql()
