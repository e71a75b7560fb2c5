"""Catalogs from data: Parquet folders, JDBC databases, and Spark's own catalog."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from askframe.sources.catalog import Catalog, Column, Relationship, Table, from_struct

#: Native type names of databases and the catalog's names for them (fixed values).
POSTGRES_TYPES = {
    "integer": "integer", "bigint": "bigint", "smallint": "smallint", "numeric": "numeric", "real": "real", "double precision": "double precision", "boolean": "boolean",
    "text": "text", "character varying": "string", "character": "string", "uuid": "uuid", "date": "date", "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz", "json": "json", "jsonb": "jsonb", "USER-DEFINED": "enum",
}
MYSQL_TYPES = {
    "int": "integer", "integer": "integer", "mediumint": "integer", "year": "integer", "smallint": "smallint", "tinyint": "smallint", "bigint": "bigint", "decimal": "numeric",
    "numeric": "numeric", "float": "float", "double": "double precision", "bit": "boolean", "bool": "boolean", "boolean": "boolean", "char": "string", "varchar": "string", "tinytext": "text",
    "text": "text", "mediumtext": "text", "longtext": "text", "time": "string", "date": "date", "datetime": "timestamp", "timestamp": "timestamptz", "json": "json",
    "enum": "enum", "set": "enum", "binary": "string", "varbinary": "string", "tinyblob": "string", "blob": "string", "mediumblob": "string", "longblob": "string",
}
BOOKKEEPING = {"createdat", "updatedat", "createdby", "updatedby", "revision", "deletedat"}


def native_type(name: str, dialect: str) -> str:
    """The catalog's name of a database's type; unknown names stay."""
    if dialect == "mysql":
        if name.lower().replace(" ", "") == "tinyint(1)":
            return "boolean"
        base = re.sub(r"\(.*|\s+unsigned.*", "", name.lower()).strip()
        return MYSQL_TYPES.get(base, base)
    return POSTGRES_TYPES.get(name, name)


def dialect_of(url: str) -> str:
    return "mysql" if url.lower().removeprefix("jdbc:").startswith(("mysql", "mariadb")) else "postgres"


def parquet_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the Parquet tables directly below a folder, on any file system that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet"))


def from_parquet(spark: SparkSession, path: str, database: str = "", only: list[str] | None = None) -> Catalog:
    """Columns and types of a folder of Parquet tables, from file footers; keys are then inferred by name."""
    tables = [from_struct(n, spark.read.parquet(f"{path}/{n}.parquet").schema) for n in (only or parquet_tables(spark, path))]
    return junctions(infer_keys(Catalog(database, "", tables)))


def from_spark(spark: SparkSession, database: str) -> Catalog:
    """The tables and views of a database of Spark's catalog."""
    names = [t.name for t in spark.catalog.listTables(database)]
    return junctions(infer_keys(Catalog(database, "", [from_struct(n, spark.table(f"`{database}`.`{n}`").schema) for n in names])))


#: Subprotocol and port of each dialect's JDBC URL (fixed values).
JDBC = {"postgres": ("postgresql", 5432), "mysql": ("mysql", 3306)}


def jdbc_url(dialect: str, host: str, port: int | None, dbname: str) -> str:
    """The JDBC URL of a database."""
    if dialect not in JDBC:
        raise ValueError(f"dialect must be one of {sorted(JDBC)}")
    if not re.fullmatch(r"[A-Za-z0-9._:\[\]-]+", host) or not re.fullmatch(r"[A-Za-z0-9_.$-]+", dbname):
        raise ValueError("not a host and a database name")
    name, usual = JDBC[dialect]
    return f"jdbc:{name}://{host}:{int(port or usual)}/{dbname}"


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table's rows. Spark prunes columns and pushes filters and limits to the database; ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` among the options make the scan parallel. Needs the driver's jar on Spark's class path."""
    quote = "`" if dialect_of(url) == "mysql" else '"'
    return spark.read.format("jdbc").options(url=url, dbtable=quote + name.replace(quote, quote * 2) + quote, **options).load()


def from_jdbc(spark: SparkSession, url: str, schema: str = "public", database: str = "", **options: str) -> Catalog:
    """Columns, primary and foreign keys from a database's information_schema. Needs the driver's jar on Spark's class path."""
    dialect = dialect_of(url)
    where = "table_schema = DATABASE()" if dialect == "mysql" else "table_schema = '" + schema.replace("'", "''") + "'"
    read = lambda q: spark.read.format("jdbc").options(url=url, query=q, **options).load()
    native = "column_type" if dialect == "mysql" else "data_type"
    columns = read(f"SELECT table_name, column_name, {native} AS data_type, ordinal_position FROM information_schema.columns WHERE {where}")
    if dialect == "mysql":
        keys = read(f"SELECT table_name, column_name, constraint_name, referenced_table_name AS rt, referenced_column_name AS rc FROM information_schema.key_column_usage WHERE {where}")
        pk, fk = keys.where("constraint_name = 'PRIMARY'"), keys.where("rt IS NOT NULL")
    else:
        on = "USING (constraint_schema, constraint_name)"
        one = "SELECT k.table_name, k.column_name{more} FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k " + on
        pk = read(one.format(more="") + f" WHERE c.constraint_type = 'PRIMARY KEY' AND k.{where}")
        fk = read(one.format(more=", u.table_name AS rt, u.column_name AS rc") + f" JOIN information_schema.constraint_column_usage u {on} WHERE c.constraint_type = 'FOREIGN KEY' AND k.{where}")
    return from_information_schema(columns, pk, fk, dialect, database)


def from_information_schema(columns: DataFrame, pk: DataFrame, fk: DataFrame, dialect: str, database: str = "") -> Catalog:
    """A catalog from rows as information_schema has them (their number is that of a database's columns)."""
    keys = {(r.table_name, r.column_name) for r in pk.collect()}
    refs = {(r.table_name, r.column_name): f"{r.rt}.{r.rc}" for r in fk.collect()}
    tables: dict[str, Table] = {}
    for r in columns.orderBy("table_name", "ordinal_position").collect():
        at = (r.table_name, r.column_name)
        tables.setdefault(r.table_name, Table(r.table_name)).columns.append(Column(r.column_name, native_type(r.data_type, dialect), pk=at in keys, fk=refs.get(at)))
    return junctions(Catalog(database, "", list(tables.values())))


def infer_keys(catalog: Catalog) -> Catalog:
    """Keys by name where none are declared: the first column that ends in key or id is the primary key, and a column of another
    table whose name, without its prefix, equals such a key refers to it."""
    bare = lambda n: re.sub(r"^[a-z]{1,2}_", "", n.lower())
    owners: dict[str, tuple[str, str]] = {}
    for t in catalog.tables:
        if not any(c.pk for c in t.columns):
            first = next(iter(t.columns), None)
            if first and re.search(r"(key|id)$", first.name.lower()) and not first.fk:
                stem = re.sub(r"_?(key|id)$", "", bare(first.name))
                if stem == "" or t.name.lower().startswith(stem[:3]) or stem in t.name.lower():
                    first.pk = True
        for c in t.columns:
            if c.pk:
                owners.setdefault(bare(c.name), (t.name, c.name))
    for t in catalog.tables:
        for c in t.columns:
            other = owners.get(bare(c.name))
            if other and not c.fk and other[0] != t.name and re.search(r"(key|id)$", c.name.lower()) and bare(c.name) not in ("id", "key"):
                c.fk = ".".join(other)
    return catalog


def junctions(catalog: Catalog) -> Catalog:
    """Tables that only tie two others together (two columns that are keys and references, and bookkeeping) get a description,
    and their parents a many-to-many relationship."""
    for t in catalog.tables:
        ties = [c for c in t.columns if c.pk and c.fk]
        rest = [c for c in t.columns if c not in ties and not c.pk]
        parents = [c.fk.rsplit(".", 1)[0] for c in ties]
        if len(ties) != 2 or len(set(parents)) != 2 or any(c.pk and not c.fk for c in t.columns) or any(c.name.lower().replace("_", "") not in BOOKKEEPING for c in rest):
            continue
        t.description = t.description or f"Connects {parents[0]} and {parents[1]}"
        for own, other in (parents, parents[::-1]):
            table = catalog.table(own)
            if table and not any(r.to == other and r.via == t.name for r in table.relationships):
                table.relationships.append(Relationship(other, "many-to-many", t.name))
    return catalog


def distinct_samples(df: DataFrame, column: str, n: int = 10, longest: int = 60) -> DataFrame:
    """Up to ``n`` distinct values that are neither null nor empty, cut at ``longest`` characters with an ellipsis: column ``value``."""
    c = F.col(f"`{column}`").cast("string")
    x = df.select(c.alias("value")).where(F.col("value").isNotNull() & (F.col("value") != "")).distinct().limit(n)
    return x.select(F.when(F.length("value") > longest, F.concat(F.substring("value", 1, longest), F.lit("…"))).otherwise(F.col("value")).alias("value"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
