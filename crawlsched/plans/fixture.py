"""A crawl state derived from the driver's tables, as DataFrames and as DuckDB SQL.

Every order is a URL of its customer's queue, and its priority is the crawl; finished orders are completed URLs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.schema import METADATA

#: 1998-01-01 UTC, within the range of order dates.
NOW = 883612800


class State(NamedTuple):
    urls: DataFrame
    queues: DataFrame
    leases: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host(column: str) -> F.Column:
    return F.concat(F.lit("cust-"), F.col(column).cast("string"), F.lit(".example.com"))


def state(spark: SparkSession, sf_dir: str) -> State:
    o, zero = read(spark, sf_dir, "orders"), F.lit(0).cast("long")
    when = F.unix_timestamp("o_orderdate")
    done = F.col("o_orderstatus") == "F"
    url = F.concat(F.lit("https://"), host("o_custkey"), F.lit("/o/"), F.col("o_orderkey").cast("string"))
    named = o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("crawl_id"), host("o_custkey").alias("key"), url.alias("url"), "o_orderstatus", when.alias("at"), done.alias("done"))
    meta = F.when(F.col("done"), F.create_map().cast(METADATA)).otherwise(F.create_map(F.lit("status"), F.array("o_orderstatus")))
    urls = named.select("crawl_id", "key", "url", meta.alias("metadata"), F.when(F.col("done"), zero).otherwise(F.col("at")).alias("refetch"), F.col("at").alias("creation_date"))
    leases = named.filter(~F.col("done") & (F.col("o_orderkey") % 7 == 0)).select("crawl_id", "key", "url", F.lit(NOW + 30).cast("long").alias("held_until"))
    c = F.col("c_custkey")
    number = F.substring("crawl_id", 1, 1).cast("long")
    q = named.select("crawl_id", "key", F.col("o_custkey").alias("c_custkey")).distinct().join(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    pick = lambda n, yes, no: F.when(c % n == 0, F.lit(yes)).otherwise(F.lit(no)).cast("long")
    queues = q.select("crawl_id", "key", pick(11, NOW, -1).alias("blocked_until"), pick(5, 60, -1).alias("delay"), pick(3, NOW - 30, 0).alias("last_produced"), pick(13, 2, 0).alias("crawl_limit"), (c * 10 + number).alias("rotation_pos"))
    return State(urls, queues, leases)


#: The same state, and what serving needs, as common table expressions.
STATE_SQL = f"""
urls AS (SELECT o_orderpriority AS crawl_id,
    concat('cust-', CAST(o_custkey AS VARCHAR), '.example.com') AS key,
    concat('https://cust-', CAST(o_custkey AS VARCHAR), '.example.com/o/', CAST(o_orderkey AS VARCHAR)) AS url,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status,
    CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS refetch,
    CAST(epoch(o_orderdate) AS BIGINT) AS creation_date,
    CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 = 0 THEN {NOW + 30} ELSE -1 END AS held_until FROM orders),
queues AS (SELECT u.crawl_id, u.key,
    CASE WHEN c_custkey % 11 = 0 THEN {NOW} ELSE -1 END AS blocked_until,
    CASE WHEN c_custkey % 5 = 0 THEN 60 ELSE -1 END AS delay,
    CASE WHEN c_custkey % 3 = 0 THEN {NOW - 30} ELSE 0 END AS last_produced,
    CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 0 END AS crawl_limit,
    c_custkey * 10 + CAST(substr(u.crawl_id, 1, 1) AS BIGINT) AS rotation_pos
    FROM (SELECT DISTINCT crawl_id, key FROM urls) u
    JOIN customer ON u.key = concat('cust-', CAST(c_custkey AS VARCHAR), '.example.com')),
counts AS (SELECT crawl_id, key, sum(CASE WHEN refetch <> 0 THEN 1 ELSE 0 END) AS active,
    sum(CASE WHEN refetch = 0 THEN 1 ELSE 0 END) AS completed,
    sum(CASE WHEN held_until > {NOW} THEN 1 ELSE 0 END) AS in_process FROM urls GROUP BY crawl_id, key)"""


def due_sql(n: int, m: int = 0, where: str = "TRUE") -> str:
    """Common table expressions up to ``sent``: the first ``n`` due URLs of each open queue, of ``m`` queues."""
    limit = f"LIMIT {m}" if m else ""
    return f"""{STATE_SQL},
open_queues AS (SELECT q.* FROM queues q JOIN counts c USING (crawl_id, key)
    WHERE NOT q.blocked_until >= {NOW} AND NOT (q.crawl_limit > 0 AND c.completed >= q.crawl_limit)
    AND q.last_produced + CASE WHEN q.delay = -1 THEN 1 ELSE q.delay END < {NOW} AND c.in_process < {n} AND {where}),
ranked AS (SELECT u.*, o.rotation_pos, row_number() OVER (PARTITION BY crawl_id, key ORDER BY u.refetch, u.url) AS rank
    FROM urls u JOIN open_queues o USING (crawl_id, key)
    WHERE u.refetch <> 0 AND u.refetch <= {NOW} AND NOT u.held_until > {NOW}),
first_queues AS (SELECT crawl_id, key, rotation_pos FROM ranked WHERE rank = 1 ORDER BY rotation_pos {limit}),
sent AS (SELECT r.* FROM ranked r JOIN first_queues USING (crawl_id, key) WHERE rank <= {n})"""


def puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of put items: each event names one of 500 URLs; signups complete, purchases and others reschedule."""
    e = read(spark, sf_dir, "events")
    site, page = (F.col("user_id") % 20).cast("string"), (F.floor("value").cast("long") % 25).cast("string")
    url = F.concat(F.lit("http://u"), site, F.lit(".example.org/p"), page)
    kind = F.when(F.col("event_type").isin("view", "click"), "discovered").otherwise("known")
    refetch = F.when(F.col("event_type") == "signup", F.lit(0)).when(kind == "known", F.lit(1704067200) + F.col("event_id")).otherwise(F.lit(0)).cast("long")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), kind.alias("kind"), F.lit("").alias("crawl_id"), F.lit("").alias("key"), url.alias("url"), F.create_map(F.lit("type"), F.array("event_type")).alias("metadata"), refetch.alias("refetch"))


PUTS_SQL = """
puts AS (SELECT event_id AS seq, concat('e', CAST(event_id AS VARCHAR)) AS id,
    CASE WHEN event_type IN ('view', 'click') THEN 'discovered' ELSE 'known' END AS kind,
    concat('u', CAST(user_id % 20 AS VARCHAR), '.example.org') AS key,
    concat('http://u', CAST(user_id % 20 AS VARCHAR), '.example.org/p', CAST(CAST(floor(value) AS BIGINT) % 25 AS VARCHAR)) AS url,
    event_type,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE 1704067200 + event_id END AS refetch FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY key, url ORDER BY seq) AS nth,
    row_number() OVER (PARTITION BY key, url, kind ORDER BY seq DESC) AS from_last FROM puts)"""


def more_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put items for the state above, of eight sorts by order: discoveries of URLs that are there, updates, completions,
    new URLs (twice each), URLs without a key, keys that are too long (some only in UTF-16 units), items without an
    identifier in queues with underscores, and new known URLs without key and crawl."""
    s = state(spark, sf_dir).urls
    n = F.regexp_extract("url", r"/o/([0-9]+)$", 1).cast("long")
    o = s.select("crawl_id", "key", "url", n.alias("n")).filter("n % 3 = 0").withColumn("sort", F.expr("n % 24 div 3"))
    o = o.withColumn("again", F.explode(F.when(F.col("sort") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    sort, again = F.col("sort"), F.col("again") == 1
    text = F.col("n").cast("string")
    kind = F.when(sort.isin(1, 2, 7) | again, "known").otherwise("discovered")
    key = F.when(sort < 3, F.col("key")).when((sort == 5) & (F.col("n") % 2 == 0), F.lit("k" * 300)).when(sort == 5, F.lit("\U0001f600" * 128)).when(sort == 6, F.concat(F.lit("q_"), (F.col("n") % 10).cast("string"))).otherwise(F.lit(""))
    url = F.when(sort == 3, F.concat("url", F.lit("/new"))).when(sort == 4, "http://").when(sort == 6, F.concat("url", F.lit("?x"))).when(sort == 7, F.concat(F.lit("http://new"), text, F.lit(".org/"))).otherwise(F.col("url"))
    refetch = F.when(sort == 1, NOW + 100 + F.col("n")).when(again | (sort == 7), F.lit(NOW + 5)).otherwise(F.lit(0)).cast("long")
    return o.select((F.col("n") * 2 + F.col("again")).alias("seq"), F.when(sort != 6, F.concat(F.lit("i"), text)).otherwise(F.lit("")).alias("id"), kind.alias("kind"), F.when(sort == 7, F.lit("")).otherwise(F.col("crawl_id")).alias("crawl_id"), key.alias("key"), url.alias("url"), F.create_map(F.lit("status"), F.array(F.lit("N"))).alias("metadata"), refetch.alias("refetch"))


MORE_SQL = f"""
more_of AS (SELECT crawl_id, key, url, CAST(regexp_extract(url, '/o/([0-9]+)$', 1) AS BIGINT) AS n FROM urls),
more_sorts AS (SELECT *, n % 24 // 3 AS sort FROM more_of WHERE n % 3 = 0),
more_twice AS (SELECT *, 0 AS again FROM more_sorts UNION ALL SELECT *, 1 FROM more_sorts WHERE sort = 3),
more_items AS (SELECT n * 2 + again AS seq, CASE WHEN sort <> 6 THEN concat('i', CAST(n AS VARCHAR)) END AS id,
    CASE WHEN sort IN (1, 2, 7) OR again = 1 THEN 'known' ELSE 'discovered' END AS kind,
    CASE WHEN sort = 7 THEN 'DEFAULT' ELSE crawl_id END AS crawl_id,
    CASE WHEN sort < 4 THEN key WHEN sort = 6 THEN concat('q_', CAST(n % 10 AS VARCHAR)) WHEN sort = 7 THEN concat('new', CAST(n AS VARCHAR), '.org') END AS key,
    CASE WHEN sort = 3 THEN concat(url, '/new') WHEN sort = 4 THEN 'http://' WHEN sort = 6 THEN concat(url, '?x') WHEN sort = 7 THEN concat('http://new', CAST(n AS VARCHAR), '.org/') ELSE url END AS url,
    CASE WHEN sort = 1 THEN {NOW + 100} + n WHEN again = 1 OR sort = 7 THEN {NOW + 5} ELSE 0 END AS refetch FROM more_twice),
more_placed AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, key, url ORDER BY seq) AS nth,
    EXISTS (SELECT 1 FROM urls u WHERE u.crawl_id = i.crawl_id AND u.key = i.key AND u.url = i.url) AS there FROM more_items i)"""

MORE_OK = "key IS NOT NULL AND (kind = 'known' OR (nth = 1 AND NOT there))"
