"""A declared catalog over the demonstration tables (orders, parts, documents and so on), and two derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.sources.catalog import Catalog

#: table -> description, columns as "name type [pk] [>table.column] [| synonym, synonym]".
TABLES = {
    "region": ("", ["r_regionkey integer pk", "r_name string"]),
    "nation": ("", ["n_nationkey integer pk", "n_name string", "n_regionkey integer >region.r_regionkey"]),
    "customer": ("", ["c_custkey bigint pk", "c_name string", "c_nationkey integer >nation.n_nationkey", "c_acctbal double precision | account balance", "c_mktsegment string | market segment, segment"]),
    "supplier": ("", ["s_suppkey bigint pk", "s_name string", "s_nationkey integer >nation.n_nationkey", "s_acctbal double precision | account balance"]),
    "part": ("", ["p_partkey bigint pk", "p_name string", "p_brand string | brand", "p_type string", "p_size integer | size", "p_retailprice double precision | retail price"]),
    "orders": ("", ["o_orderkey bigint pk", "o_custkey bigint >customer.c_custkey", "o_orderstatus string | order status", "o_totalprice double precision | total price", "o_orderdate timestamp | order date", "o_orderpriority string | order priority, priority"]),
    "lineitem": ("", ["l_orderkey bigint pk >orders.o_orderkey", "l_partkey bigint >part.p_partkey", "l_suppkey bigint >supplier.s_suppkey", "l_linenumber integer pk", "l_quantity double precision | quantity", "l_extendedprice double precision | extended price", "l_discount double precision | discount", "l_tax double precision | tax", "l_returnflag string | return flag", "l_linestatus string | line status", "l_shipdate timestamp | ship date"]),
    "events": ("", ["event_id bigint pk", "ts timestamp | time", "user_id bigint", "event_type string", "value double precision", "props json"]),
    "documents": ("", ["doc_id bigint pk", "text text", "lang string | language", "source string", "n_chars bigint | length"]),
    "doc_flags": ("", ["doc_id bigint pk >documents.doc_id", "is_quality boolean", "is_toxic boolean"]),
    "doc_quality": ("", ["doc_id bigint pk >documents.doc_id", "lang string | language", "quality integer", "toxic integer"]),
}


def build(database: str, tables: dict[str, tuple[str, list[str]]], description: str = "") -> Catalog:
    """A catalog from tables written as in ``TABLES``."""
    made = []
    for name, (about, columns) in tables.items():
        out = []
        for line in columns:
            left, _, also = line.partition(" | ")
            left, _, fk = left.partition(" >")
            words = left.split()
            pk = words[-1] == "pk"
            out.append({"name": words[0], "type": " ".join(words[1 : len(words) - pk]), "pk": pk, "fk": fk or None, "synonyms": [s.strip() for s in also.split(",") if s.strip()]})
        made.append({"name": name, "description": about, "columns": out})
    return Catalog.from_dict({"database": database, "description": description, "tables": made})


def catalog() -> Catalog:
    return build("demo", TABLES, "orders, events and documents")


def derived(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``doc_flags``: labels as booleans. ``doc_quality``: documents with their labels, null where there are none."""
    labels, docs = spark.read.parquet(f"{path}/labels.parquet"), spark.read.parquet(f"{path}/documents.parquet")
    return {
        "doc_flags": labels.select("doc_id", (F.col("quality") == 1).alias("is_quality"), (F.col("toxic") == 1).alias("is_toxic")),
        "doc_quality": docs.select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic"),
    }
