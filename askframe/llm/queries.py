"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import chat_format, embedding_dedup, exact_dedup, mixing, ngram_join, packing, resharding, token_counts, toxicity, warc
from askframe.llm.common import LOWER, UPPER, shared_dir, ship, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; every machine has them installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each section of each document; one that crosses a boundary counts where most of its bytes lie."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k.tiktoken"), "most")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return x.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, and what a reader gets back from the output."""
    own = spark.sql("SELECT -7L AS conv_id, i AS turn, IF(i = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L), (1L) AS t(i)")
    out = chat_format.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    x = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document gives to the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("n_words"))
    x = mixing.mix(docs, "doc_id", "source", F.col("n_words"))
    return x.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    x = warc.round_trip(table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+|null)>$", 1)
    page = F.when(number("record_id") != "null", number("record_id")).cast("long")
    return x.select(
        page.alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).cast("long").alias("refers_to"),
        F.length(F.decode("payload", "UTF-8")).cast("long").alias("payload_chars"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", keep="max").drop("row_hash")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, laid out by a hash of their text so that equal texts lie together, moved into 40 shards of equal bytes, and read back from these."""
    shards = 40
    text = F.coalesce(F.col("text"), F.lit(""))
    n_bytes = (F.octet_length(text) + 16).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    moved = resharding.reshard(docs, "doc_id", F.pmod(F.xxhash64(text), F.lit(shards)).cast("int"), n_bytes, shards, group=text)
    # the given table is no layout of shards, so all of them are new
    layout = resharding.write_shards(moved, f"{shared_dir(spark)}/askframe/shards-{uuid.uuid4().hex}")
    back = resharding.read_shards(moved, layout)
    return back.select("doc_id", n_bytes.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = (
    op1_token_counts,
    op2_embedding_dedup,
    op3_ngram_join,
    op4_toxicity,
    op5_chat_formatting,
    op6_packing,
    op7_mixing,
    op8_warc,
    op9_exact_dedup,
    op10_resharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

ORACLE_SQL = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT t.vec_id, coalesce(n.n, 0) AS n_links, least(t.vec_id, coalesce(c.least, t.vec_id)) AS component_id, t.vec_id <= coalesce(c.least, t.vec_id) AS kept
        FROM embeddings t LEFT JOIN c ON c.a = t.vec_id LEFT JOIN n ON n.a = t.vec_id""",
    "op3_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id""",
    "op5_chat_formatting": f"""
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (VALUES (0), (1)) AS x(i)),
        m AS (SELECT *, length(regexp_replace(text, '([<\\[])(\\\\*){chat_format.REST}', '\\1\\\\\\2\\3', 'g')) AS safe,
            role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(safe + CASE WHEN opens THEN {len(chat_format.START) + 1 + len(chat_format.END)} + length(role) ELSE {len(chat_format.NEXT)} END)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id""",
    # base32: five bits at a time out of three hex digits
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '00' AS h FROM pages),
        d AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS best, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((strpos('0123456789abcdef', h[(5 * i) // 4 + 1]) - 1) * 256 + (strpos('0123456789abcdef', h[(5 * i) // 4 + 2]) - 1) * 16 + strpos('0123456789abcdef', h[(5 * i) // 4 + 3]) - 1)
            // CAST(power(2, 7 - (5 * i) % 4) AS INTEGER)) % 32 + 1, 1)), '') AS digest FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> best THEN best END AS refers_to, CASE WHEN page_id = best THEN length(html) END AS payload_chars FROM d""",
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB where it can say the whole query; the others are tested against brute force."""
    return dict(ORACLE_SQL)
