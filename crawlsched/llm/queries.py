"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.llm import byte_cnn, katz, language, mixing, neardup, packing, pii, quality_rules, topk, warc
from crawlsched.llm.shared import Scratch, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


ORACLE_SQL["op5_topk"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score FROM q JOIN e ON q.vec_id <> e.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLE_SQL["op10_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
    CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (h)"""


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.judge(read(spark, sf_dir, "documents"), trusted)


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, found="n_found")


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(read(spark, sf_dir, "embeddings"), k=5, query_every=50)


@query
def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer())


@query
def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Scratch(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), f"{keep.path}/archives")
    return warc.digests(keep.keep(warc.read_chunks(spark, f"{keep.path}/archives", keep_all=False), "records"))
