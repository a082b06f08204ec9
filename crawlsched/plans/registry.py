"""Queries over the driver's tables, each with its DuckDB form where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.functions import keys
from crawlsched.operators import control, ingest, inspect, serve
from crawlsched.plans.fixture import MORE_OK, MORE_SQL, NOW, PUTS_SQL, STATE_SQL, due_sql, more_puts, puts, read, state
from crawlsched.schema import KEYS, METADATA, URL_KEYS
from crawlsched.sources import dump
from crawlsched.sources.puts import parse_lines as parsed
from crawlsched.streaming.rates import ack_rate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

URGENT, HIGH, MEDIUM = "1-URGENT", "2-HIGH", "3-MEDIUM"
ONE_QUEUE = "cust-51.example.com"
NODES = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, so that types agree with SQL's."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# Serving


def _due(spark: SparkSession, sf_dir: str, get: serve.Get) -> tuple:
    s = state(spark, sf_dir)
    return s, serve.due(s.urls, s.queues, s.leases, NOW, get)


def _rows(sent: DataFrame) -> DataFrame:
    return sent.select(*URL_KEYS, F.get(F.col("metadata")["status"], 0).alias("status"), "refetch", "rank")


_SENT = "SELECT crawl_id, key, url, status, refetch, rank FROM sent"
ALL, FIFTY = serve.Get(max_urls=2), serve.Get(max_urls=2, max_queues=50)


@query(f"WITH {due_sql(2)} {_SENT}")
def get_urls_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_due(spark, sf_dir, ALL)[1])


@query(f"WITH {due_sql(2, 50)} {_SENT}")
def get_urls_max_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_due(spark, sf_dir, FIFTY)[1])


@query(f"WITH {due_sql(5, where=f'''q.crawl_id = '{HIGH}' AND q.key = '{ONE_QUEUE}' ''')} {_SENT}")
def get_urls_one_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_due(spark, sf_dir, serve.Get(max_urls=5, crawl_id=HIGH, key=ONE_QUEUE))[1])


@query(f"WITH {due_sql(3, where=f'''q.crawl_id = '{HIGH}' ''')} {_SENT}")
def get_urls_one_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_due(spark, sf_dir, serve.Get(max_urls=3, crawl_id=HIGH))[1])


@query(f"WITH {due_sql(1_000_000)} {_SENT}")
def get_urls_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_due(spark, sf_dir, serve.Get())[1])


_NODE = f"""abs((SELECT CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END FROM (SELECT list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(concat(replace(q.crawl_id, '_', '%5F'), '_', replace(q.key, '_', '%5F')), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: (a * 31 + x) % 4294967296) AS h)) % {NODES})"""


@query(f"WITH {due_sql(2, where=f'{_NODE} = 1')} {_SENT}")
def get_urls_one_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_due(spark, sf_dir, serve.Get(max_urls=2, node=1, nodes=NODES))[1])


@query(f"""WITH {STATE_SQL} SELECT q.crawl_id, q.key, CASE WHEN q.crawl_limit > 0 THEN CAST(c.completed AS BIGINT) ELSE 0 END AS completed,
    CAST(c.in_process AS BIGINT) AS in_process, CASE WHEN q.blocked_until >= {NOW} THEN 'blocked'
    WHEN q.crawl_limit > 0 AND c.completed >= q.crawl_limit THEN 'limit'
    WHEN NOT q.last_produced + CASE WHEN q.delay = -1 THEN 1 ELSE q.delay END < {NOW} THEN 'delay'
    WHEN c.in_process >= 2 THEN 'in_process' END AS closed FROM queues q JOIN counts c USING (crawl_id, key)""")
def queue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return serve.gate(s.queues, s.urls, s.leases, NOW, ALL).select(*KEYS, "completed", "in_process", "closed")


@query(f"""WITH {due_sql(2, 50)} SELECT q.crawl_id, q.key, CASE WHEN f.key IS NULL THEN q.last_produced ELSE {NOW} END AS last_produced
    FROM queues q LEFT JOIN first_queues f USING (crawl_id, key)""")
def next_last_produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sent = _due(spark, sf_dir, FIFTY)
    return serve.produced(s.queues, sent, NOW).select(*KEYS, "last_produced")


@query(f"""WITH {due_sql(2, 50)}, b AS (SELECT min(rotation_pos) lo, max(rotation_pos) hi FROM queues),
    h AS (SELECT count(*) n, max(rotation_pos) last FROM first_queues)
    SELECT crawl_id, key, CASE WHEN n >= 50 THEN CASE WHEN rotation_pos <= last THEN rotation_pos + hi - lo + 1 ELSE rotation_pos END
    WHEN rotation_pos = lo THEN hi + 1 ELSE rotation_pos END AS rotation_pos FROM queues, b, h""")
def next_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sent = _due(spark, sf_dir, FIFTY)
    return serve.rotated(s.queues, sent, FIFTY).select(*KEYS, "rotation_pos")


@query(f"""WITH {due_sql(2, 50)} SELECT crawl_id, key, url, CAST(held_until AS BIGINT) AS held_until FROM urls WHERE held_until > {NOW}
    UNION ALL SELECT crawl_id, key, url, CAST({NOW + 30} AS BIGINT) FROM sent""")
def next_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sent = _due(spark, sf_dir, FIFTY)
    return serve.leased(s.leases, sent, NOW, FIFTY)


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, url FROM urls WHERE held_until > {NOW}")
def held_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.held(s.urls, s.leases, NOW).select(*URL_KEYS)


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, CAST(in_process AS BIGINT) AS in_process FROM counts WHERE in_process > 0")
def in_process_by_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.in_process(state(spark, sf_dir).leases, NOW)


# Inspection

_STATS = """SELECT q.crawl_id, CAST(sum(active) AS BIGINT) AS size, CAST(sum(in_process) AS BIGINT) AS in_process, count(*) AS number_of_queues,
    CAST(sum(completed) AS BIGINT) AS completed, count(CASE WHEN active > 0 OR in_process > 0 THEN 1 END) AS active_queues
    FROM queues q JOIN counts USING (crawl_id, key)"""


@query(f"WITH {STATE_SQL} {_STATS} GROUP BY q.crawl_id")
def stats_by_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.stats(s.urls, s.queues, s.leases, NOW)


@query(f"WITH {STATE_SQL} {_STATS} WHERE q.crawl_id = '{HIGH}' AND q.key = '{ONE_QUEUE}' GROUP BY q.crawl_id")
def stats_one_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.stats(s.urls, s.queues, s.leases, NOW, HIGH, ONE_QUEUE)


@query(f"WITH {STATE_SQL} {_STATS} GROUP BY q.crawl_id")
def stats_merged_over_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each node's queues, added up."""
    s = state(spark, sf_dir)
    return inspect.merge_stats(inspect.stats_by_node(s.urls, s.queues, s.leases, NOW, NODES))


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, CAST(active AS BIGINT) AS active, CAST(completed AS BIGINT) AS completed, CAST(in_process AS BIGINT) AS in_process FROM counts JOIN queues USING (crawl_id, key)")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.queue_counts(s.urls, s.queues, s.leases, NOW)


def _plain(urls: DataFrame) -> DataFrame:
    return urls.select(*URL_KEYS, F.get(F.col("metadata")["status"], 0).alias("status"), "refetch", "creation_date")


_LIST = "SELECT crawl_id, key, url, status, refetch, creation_date FROM urls WHERE"


@query(f"WITH {STATE_SQL} {_LIST} crawl_id = '{HIGH}' AND contains(url, '/o/1') ORDER BY key, url LIMIT 25 OFFSET 40")
def list_urls_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(inspect.list_urls(state(spark, sf_dir).urls, HIGH, start=40, size=25, wanted="/o/1"))


@query(f"WITH {STATE_SQL} {_LIST} crawl_id = '{URGENT}' AND contains(lower(url), 'com/o/12') ORDER BY key, url LIMIT 100")
def list_urls_filter_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(inspect.list_urls(state(spark, sf_dir).urls, URGENT, wanted="COM/O/12", ignore_case=True))


@query(f"WITH {STATE_SQL} {_LIST} crawl_id = '{URGENT}' AND contains(url, 'com/o/12') ORDER BY key, url LIMIT 100")
def list_urls_filter_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(inspect.list_urls(state(spark, sf_dir).urls, URGENT, wanted="com/o/12"))


@query(f"WITH {STATE_SQL} {_LIST} crawl_id = '{HIGH}' AND key = '{ONE_QUEUE}' ORDER BY key, url LIMIT 100")
def list_urls_one_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(inspect.list_urls(state(spark, sf_dir).urls, HIGH, ONE_QUEUE))


@query(f"WITH {STATE_SQL} SELECT count(*) AS n FROM urls WHERE crawl_id = '{URGENT}' AND contains(lower(url), 'com/o/12')")
def count_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.count_urls(state(spark, sf_dir).urls, URGENT, wanted="COM/O/12", ignore_case=True)


@query(f"WITH {STATE_SQL} SELECT count(*) AS n FROM urls WHERE crawl_id = '{HIGH}' AND key = '{ONE_QUEUE}'")
def count_urls_one_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.count_urls(state(spark, sf_dir).urls, HIGH, ONE_QUEUE)


@query(f"WITH {STATE_SQL} SELECT u.crawl_id, u.key, u.url, u.status, u.refetch, u.creation_date FROM urls u JOIN orders ON o_orderkey = 7 AND u.url = concat('https://cust-', CAST(o_custkey AS VARCHAR), '.example.com/o/7') AND u.crawl_id = o_orderpriority")
def url_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of the URL of order 7, whose queue is derived from it."""
    s, o = state(spark, sf_dir), read(spark, sf_dir, "orders").filter("o_orderkey = 7")
    asked = o.select(F.concat(F.lit("https://cust-"), F.col("o_custkey").cast("string"), F.lit(".example.com/o/7")).alias("url"), F.col("o_orderpriority").alias("crawl")).first()
    return _plain(inspect.url_status(s.urls, asked.url if asked else "", crawl_id=asked.crawl if asked else ""))


@query(f"WITH {STATE_SQL} SELECT q.crawl_id, q.key FROM queues q JOIN counts USING (crawl_id, key) WHERE q.crawl_id = '{URGENT}' AND NOT blocked_until >= {NOW} AND active > 0 ORDER BY q.key LIMIT 100 OFFSET 10")
def list_queues_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.list_queues(s.queues, s.urls, NOW, URGENT, start=10, size=100)


@query(f"WITH {STATE_SQL} SELECT crawl_id, key FROM queues WHERE crawl_id = '{URGENT}' ORDER BY key LIMIT 100 OFFSET 10")
def list_queues_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.list_queues(s.queues, s.urls, NOW, URGENT, start=10, include_inactive=True)


@query(f"WITH {STATE_SQL} SELECT DISTINCT crawl_id FROM queues")
def list_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.list_crawls(state(spark, sf_dir).queues)


@query("SELECT concat('node', CAST(n_nationkey AS VARCHAR), ':7071') AS node FROM nation")
def list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"node{r.n_nationkey}:7071" for r in read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return inspect.list_nodes(spark, names)


@query("SELECT bool_and(n_nationkey <> 3) AS active FROM nation")
def all_nodes_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.all_active(read(spark, sf_dir, "nation").select((F.col("n_nationkey") != 3).alias("active")))


_FAULTY = f"""{STATE_SQL}, bad_urls AS (SELECT crawl_id, key, url FROM urls UNION ALL SELECT crawl_id, key, url FROM urls WHERE contains(url, '/o/1') UNION ALL SELECT ' ', key, url FROM urls WHERE contains(url, '/o/2')
    UNION ALL SELECT crawl_id, concat('lost-', key), url FROM urls WHERE contains(url, '/o/3'))"""


@query(f"WITH {_FAULTY} SELECT 'repeated_url' AS fault, (SELECT count(*) FROM (SELECT crawl_id, key, url FROM bad_urls GROUP BY ALL HAVING count(*) > 1)) AS n UNION ALL SELECT 'url_without_queue', (SELECT count(*) FROM bad_urls ANTI JOIN queues USING (crawl_id, key)) UNION ALL SELECT 'crawl_not_normalised', (SELECT count(*) FROM bad_urls WHERE trim(crawl_id) = '')")
def state_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a state with repeated URLs, crawls without a name and URLs without a queue."""
    s = state(spark, sf_dir)
    has = lambda n: s.urls.filter(F.contains("url", F.lit(f"/o/{n}")))
    bad = s.urls.unionByName(has(1)).unionByName(has(2).withColumn("crawl_id", F.lit(" "))).unionByName(has(3).withColumn("key", F.concat(F.lit("lost-"), "key")))
    return inspect.check(bad, s.queues)


# Ingest

_OK = "kind = 'known' OR nth = 1"


@query(f"WITH {PUTS_SQL} SELECT seq, id, kind, CASE WHEN {_OK} THEN 'OK' ELSE 'SKIPPED' END AS status FROM placed")
def put_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.put(puts(spark, sf_dir), _no_urls(spark), NOW).acks


@query(f"WITH {PUTS_SQL} SELECT kind, CASE WHEN {_OK} THEN 'OK' ELSE 'SKIPPED' END AS status, count(*) AS n FROM placed GROUP BY ALL")
def put_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(ingest.put(puts(spark, sf_dir), _no_urls(spark), NOW).acks)


def _no_urls(spark: SparkSession) -> DataFrame:
    from crawlsched.schema import URLS

    return spark.createDataFrame([], URLS)


@query(f"""WITH {PUTS_SQL}, last_known AS (SELECT * FROM placed WHERE kind = 'known' AND from_last = 1), firsts AS (SELECT * FROM placed WHERE nth = 1)
    SELECT 'DEFAULT' AS crawl_id, f.key, f.url, CASE WHEN k.url IS NULL THEN f.event_type WHEN k.refetch = 0 THEN NULL ELSE k.event_type END AS type,
    CASE WHEN k.url IS NULL THEN {NOW} ELSE k.refetch END AS refetch, CAST({NOW} AS BIGINT) AS creation_date
    FROM firsts f LEFT JOIN last_known k USING (key, url)""")
def put_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.put(puts(spark, sf_dir), _no_urls(spark), NOW).changed
    return out.select(*URL_KEYS, F.get(F.col("metadata")["type"], 0).alias("type"), "refetch", "creation_date")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in batches of ten; the URL's path is dropped from every other one, so that URLs repeat."""
    p = read(spark, sf_dir, "pages").filter("page_id is not null")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://"), keys.derive_key(F.col("url")), F.lit("/"))).otherwise(F.col("url"))
    item = lambda x: F.struct(x["url"].alias("url"), F.lit("").alias("key"), F.lit("").alias("crawl_id"), F.create_map().cast(METADATA).alias("metadata"))
    b = p.groupBy(F.floor(F.col("page_id") / 10).cast("long").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("page_id", url.alias("url")))).alias("all"))
    return b.select("seq", F.concat(F.lit("b"), F.col("seq").cast("string")).alias("id"), F.transform("all", item).alias("items"))


_KEY_SQL = "nullif(split_part(split_part(split_part(split_part(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END, ':', 1), '/', 1), '?', 1), '&', 1), '')"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('http://', {_KEY_SQL}, '/') ELSE url END AS url FROM pages),
    r AS (SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY page_id) = 1 THEN 'OK' ELSE 'SKIPPED' END AS status FROM p)
    SELECT concat('b', CAST(page_id // 10 AS VARCHAR)) AS id, string_agg(status, ',' ORDER BY page_id) AS statuses FROM r GROUP BY page_id // 10""")
def put_discovered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _batches(spark, sf_dir)
    acks = ingest.put(ingest.batch_items(b), _no_urls(spark), NOW).acks
    return ingest.batch_acks(b, acks).select("id", F.array_join("statuses", ",").alias("statuses"))


@query(f"""WITH {STATE_SQL}, changed AS (SELECT * FROM urls WHERE refetch = 0) SELECT crawl_id, key, url, CAST(held_until AS BIGINT) AS held_until FROM urls WHERE held_until > -1
    AND NOT (strpos(url, '/o/1') > 0)""")
def released_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases left when the URLs of orders that begin with 1 are updated."""
    s = state(spark, sf_dir)
    return ingest.release(s.leases, s.urls.filter(F.contains("url", F.lit("/o/1"))))


@query(f"""WITH {STATE_SQL}, p AS (SELECT page_id, {_KEY_SQL} AS key FROM pages), f AS (SELECT key, row_number() OVER (ORDER BY min(page_id)) AS nth FROM p WHERE key IS NOT NULL GROUP BY key)
    SELECT crawl_id, key, rotation_pos FROM queues UNION ALL SELECT 'DEFAULT', key, (SELECT max(rotation_pos) FROM queues) + nth FROM f""")
def add_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues once the pages were put: new ones at the tail, in the order in which they came."""
    s = state(spark, sf_dir)
    return ingest.add_queues(s.queues, ingest.batch_items(_batches(spark, sf_dir))).select(*KEYS, "rotation_pos")


# Ingest into a state that is there


@query(f"WITH {STATE_SQL}, {MORE_SQL} SELECT seq, coalesce(id, url) AS id, kind, CASE WHEN {MORE_OK} THEN 'OK' ELSE 'SKIPPED' END AS status FROM more_placed")
def put_more_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for URLs that are there, scheduled and completed, for new ones, and with keys that can't be taken."""
    return ingest.put(more_puts(spark, sf_dir), state(spark, sf_dir).urls, NOW).acks


@query(f"WITH {STATE_SQL}, {MORE_SQL} SELECT kind, CASE WHEN {MORE_OK} THEN 'OK' ELSE 'SKIPPED' END AS status, count(*) AS n FROM more_placed GROUP BY ALL")
def put_more_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summary(ingest.put(more_puts(spark, sf_dir), state(spark, sf_dir).urls, NOW).acks)


@query(f"""WITH {STATE_SQL}, {MORE_SQL}, ok AS (SELECT * FROM more_placed WHERE {MORE_OK}),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, key, url ORDER BY seq DESC) AS back FROM ok) WHERE back = 1)
    SELECT crawl_id, key, url, CASE WHEN l.url IS NULL THEN u.status WHEN l.kind = 'known' AND l.refetch = 0 THEN NULL ELSE 'N' END AS status,
    CASE WHEN l.url IS NULL THEN u.refetch WHEN l.kind = 'known' THEN l.refetch ELSE {NOW} END AS refetch, coalesce(u.creation_date, {NOW}) AS creation_date
    FROM urls u FULL JOIN last l USING (crawl_id, key, url)""")
def put_more_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs after these items: dates of creation stay, completed ones lose their metadata."""
    urls = state(spark, sf_dir).urls
    return _plain(ingest.upsert(urls, ingest.put(more_puts(spark, sf_dir), urls, NOW).changed))


@query(f"""WITH {STATE_SQL}, {MORE_SQL}, f AS (SELECT crawl_id, key, row_number() OVER (ORDER BY min(seq)) AS nth FROM more_placed m
    WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM queues q WHERE q.crawl_id = m.crawl_id AND q.key = m.key) GROUP BY crawl_id, key)
    SELECT crawl_id, key, (SELECT max(rotation_pos) FROM queues) + nth AS rotation_pos FROM f""")
def put_more_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queues that these items name first, in the order of their arrival."""
    q = state(spark, sf_dir).queues
    return ingest.new_queues(q, more_puts(spark, sf_dir), q.agg(F.max("rotation_pos").alias("m")).scalar()).select(*KEYS, "rotation_pos")


@query(f"""WITH {STATE_SQL}, {MORE_SQL} SELECT crawl_id, key, url, CAST(held_until AS BIGINT) AS held_until FROM urls u WHERE held_until > -1
    AND NOT EXISTS (SELECT 1 FROM more_placed m WHERE m.kind = 'known' AND m.crawl_id = u.crawl_id AND m.key = u.key AND m.url = u.url)""")
def put_more_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases after these items: those of updated URLs are released."""
    s = state(spark, sf_dir)
    return ingest.release(s.leases, ingest.put(more_puts(spark, sf_dir), s.urls, NOW).changed)


@query(f"WITH {STATE_SQL}, {MORE_SQL} SELECT seq, coalesce(id, url) AS id, crawl_id, key, url FROM more_items")
def put_more_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with crawl, key and identifier filled in; null keys for what can't be taken."""
    return ingest.normalised(more_puts(spark, sf_dir)).select("seq", "id", "crawl_id", "key", "url")


# Control and deletion

_TWO = f"crawl_id = '{HIGH}' AND key = '{ONE_QUEUE}'"


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, CASE WHEN {_TWO} THEN {NOW + 600} ELSE blocked_until END AS blocked_until FROM queues")
def block_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.block_until(state(spark, sf_dir).queues, HIGH, ONE_QUEUE, NOW + 600).select(*KEYS, "blocked_until")


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, CASE WHEN {_TWO} THEN 0 ELSE delay END AS delay FROM queues")
def set_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.set_delay(state(spark, sf_dir).queues, HIGH, ONE_QUEUE, 0).select(*KEYS, "delay")


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, CASE WHEN {_TWO} THEN 5 ELSE crawl_limit END AS crawl_limit FROM queues")
def set_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.set_limit(state(spark, sf_dir).queues, HIGH, ONE_QUEUE, 5).select(*KEYS, "crawl_limit")


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, url FROM urls WHERE NOT ({_TWO})")
def delete_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.keep_outside(state(spark, sf_dir).urls, HIGH, ONE_QUEUE).select(*URL_KEYS)


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, url FROM urls WHERE crawl_id <> '{HIGH}'")
def delete_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.keep_outside(state(spark, sf_dir).urls, HIGH).select(*URL_KEYS)


@query(f"WITH {STATE_SQL} SELECT count(*) AS n FROM urls WHERE crawl_id = '{HIGH}'")
def delete_crawl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.deleted_count(state(spark, sf_dir).urls, HIGH)


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, url FROM urls WHERE NOT held_until > {NOW}")
def delete_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs left when all leased ones are deleted."""
    s = state(spark, sf_dir)
    return control.delete_urls(s.urls, s.leases).select(*URL_KEYS)


_OLD = f"crawl_id = '{MEDIUM}' AND creation_date < {NOW - 365 * 86400}"


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, url FROM urls WHERE NOT ({_OLD})")
def purge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.purge(state(spark, sf_dir).urls, MEDIUM, NOW, 365).select(*URL_KEYS)


@query(f"WITH {STATE_SQL} SELECT count(*) AS n FROM urls WHERE {_OLD}")
def purge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.purge_count(state(spark, sf_dir).urls, MEDIUM, NOW, 365)


# Functions


@query(f"SELECT page_id, {_KEY_SQL} AS key FROM pages")
def derive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", keys.derive_key(F.col("url")).alias("key"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'DEFAULT' WHEN n_nationkey % 4 = 1 THEN 'DEFAULT' ELSE concat(' ', n_name) END AS crawl_id FROM nation")
def normalise_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    raw = F.when(n % 4 == 0, "").when(n % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), "n_name"))
    return longs(read(spark, sf_dir, "nation").select("n_nationkey", keys.normalise_crawl(raw).alias("crawl_id")))


@query("SELECT c_custkey, concat(replace(concat('crawl_', c_mktsegment), '_', '%5F'), '_', replace(c_name, '_', '%5F')) AS queue_id, concat('crawl_', c_mktsegment) AS crawl_id, c_name AS key FROM customer")
def queue_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    qid = keys.queue_id(F.concat(F.lit("crawl_"), "c_mktsegment"), F.col("c_name"))
    crawl, key = keys.parse_queue_id(F.col("queue_id"))
    return read(spark, sf_dir, "customer").select("c_custkey", qid.alias("queue_id")).select("c_custkey", "queue_id", crawl.alias("crawl_id"), key.alias("key"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey * 1009 AS VARCHAR), CAST(greatest(10, length(CAST(o_orderkey * 1009 AS VARCHAR))) AS INTEGER), '0') AS padded FROM orders")
def padded_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", keys.padded_date(F.col("o_orderkey") * 1009).alias("padded"))


@query(f"WITH {STATE_SQL} SELECT q.crawl_id, q.key, CAST({_NODE} AS BIGINT) AS node FROM queues q")
def partition_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.owners(state(spark, sf_dir).queues, NODES).withColumn("node", F.col("node").cast("long"))


@query(f"WITH {STATE_SQL}, {MORE_SQL} SELECT seq, CAST({_NODE} AS BIGINT) AS node FROM more_items q WHERE key IS NOT NULL")
def puts_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that each item goes to."""
    items = ingest.normalised(more_puts(spark, sf_dir)).filter("key is not null")
    return items.select("seq", keys.partition_for(F.col("crawl_id"), F.col("key"), NODES).cast("long").alias("node"))


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, url, status, refetch, creation_date FROM urls WHERE crawl_id = '{HIGH}' AND (key > 'cust-2' OR (key = 'cust-2' AND url > 'https://')) ORDER BY key, url LIMIT 50")
def list_urls_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a given key and URL."""
    return _plain(inspect.list_urls(state(spark, sf_dir).urls, HIGH, size=50, after=("cust-2", "https://")))


@query(f"WITH {STATE_SQL} SELECT crawl_id, key FROM queues WHERE crawl_id = '{URGENT}' AND key > 'cust-2' ORDER BY key LIMIT 100")
def list_queues_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.list_queues(s.queues, s.urls, NOW, URGENT, include_inactive=True, after="cust-2")


@query(f"WITH {STATE_SQL} SELECT q.crawl_id, q.key FROM queues q JOIN counts USING (crawl_id, key) WHERE q.crawl_id = '{MEDIUM}' AND NOT blocked_until >= {NOW} AND active > 0 ORDER BY q.key LIMIT 60")
def list_queues_merged_over_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each node's queues, merged to one page."""
    s = state(spark, sf_dir)
    pages = inspect.pages_by_node(inspect.select_queues(s.queues, s.urls, NOW, MEDIUM), NODES, size=60)
    return pages.select(*KEYS).orderBy("key").limit(60)


@query(f"WITH {STATE_SQL} SELECT q.crawl_id, q.key, CAST(coalesce(c.active + c.completed, 0) AS BIGINT) AS size FROM queues q LEFT JOIN counts c USING (crawl_id, key)")
def queue_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    return inspect.queue_sizes(s.queues, s.urls)


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, rotation_pos FROM queues ORDER BY rotation_pos LIMIT 1")
def first_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.first_queue(state(spark, sf_dir).queues).select(*KEYS, "rotation_pos")


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, rotation_pos FROM queues ORDER BY rotation_pos OFFSET 1")
def poll_first_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation without its head."""
    return serve.without_first(state(spark, sf_dir).queues).select(*KEYS, "rotation_pos")


@query(f"""WITH {STATE_SQL} SELECT q.crawl_id, q.key, CASE WHEN q.blocked_until >= {NOW} THEN 'blocked' WHEN q.crawl_limit > 0 AND c.completed >= q.crawl_limit THEN 'limit'
    WHEN NOT q.last_produced + CASE WHEN q.delay = -1 THEN 40 ELSE q.delay END < {NOW} THEN 'delay' END AS closed FROM queues q JOIN counts c USING (crawl_id, key)""")
def queue_gate_default_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed queues under a default delay of forty seconds."""
    s = state(spark, sf_dir)
    return serve.gate(s.queues, s.urls, s.leases, NOW, serve.Get(), 40).select(*KEYS, "closed")


_UNDATED = "CASE WHEN strpos(url, '/o/1') > 0 THEN 0 ELSE creation_date END"


@query(f"WITH {STATE_SQL} SELECT crawl_id, key, url, {_UNDATED} AS creation_date FROM urls WHERE NOT (crawl_id = '{MEDIUM}' AND {_UNDATED} < {NOW - 30 * 86400})")
def purge_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purge takes URLs without a date of creation (0) as well."""
    urls = state(spark, sf_dir).urls
    dated = urls.withColumn("creation_date", F.when(F.contains("url", F.lit("/o/1")), F.lit(0).cast("long")).otherwise(F.col("creation_date")))
    return control.purge(dated, MEDIUM, NOW, 30).select(*URL_KEYS, "creation_date")


@query("SELECT event_type AS kind, count(*) AS n, count(*) / greatest(1, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT)) AS per_second FROM events GROUP BY event_type")
def ack_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.averages(read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")))


@query(f"WITH {STATE_SQL} SELECT crawl_id, url, strftime(make_timestamp(refetch * 1000000), '%Y-%m-%dT%H:%M:%S') AS shown FROM urls")
def shown_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir).urls.select("crawl_id", "url", keys.shown_date(F.col("refetch")).alias("shown"))


# Sources, sinks and rates


@query("""SELECT CASE WHEN page_id % 5 = 0 THEN concat('mine_http://h', CAST(page_id AS VARCHAR), '.org/') ELSE concat('i', CAST(page_id AS VARCHAR)) END AS id,
    CASE WHEN page_id % 5 IN (0, 1) THEN 'discovered' WHEN page_id % 5 IN (2, 3) THEN 'known' ELSE 'invalid' END AS kind,
    CASE WHEN page_id % 5 = 0 THEN 'mine' WHEN page_id % 5 = 1 THEN 'c_1' END AS crawl_id, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 2 THEN 'q' END AS key,
    CASE WHEN page_id % 5 <> 4 THEN concat('http://h', CAST(page_id AS VARCHAR), '.org/') END AS url, CASE WHEN page_id % 5 = 1 THEN 'a,b' ELSE '' END AS meta,
    CASE WHEN page_id % 5 IN (2, 3) THEN 1700000000 + page_id ELSE 0 END AS refetch FROM pages WHERE page_id IS NOT NULL""")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put items from plain URLs and JSON lines of several sorts, with dates as numbers and as strings."""
    n = F.col("page_id").cast("string")
    url = F.concat(F.lit("http://h"), n, F.lit(".org/"))
    own = F.concat(F.lit('"ID": "i'), n, F.lit('"}'))
    date = F.concat(F.lit("17"), F.lpad(n, 8, "0"))
    line = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("  "), url, F.lit("\t")))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit('{"discovered": {"info": {"url": "'), url, F.lit('", "crawlID": "c_1", "metadata": {"m": {"values": ["a", "b"]}}}}, '), own))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit('{"known": {"info": {"url": "'), url, F.lit('", "key": "q"}, "refetchableFromDate": "'), date, F.lit('"}, '), own))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit('{"known": {"info": {"url": "'), url, F.lit('"}, "refetchableFromDate": '), date, F.lit("}, "), own))
        .otherwise(F.concat(F.lit("{"), own))
    )
    items = parsed(read(spark, sf_dir, "pages").filter("page_id is not null").select(line.alias("value")), "mine")
    return items.select("id", "kind", "crawl_id", "key", "url", F.array_join(F.coalesce(F.col("metadata")["m"], F.array().cast("array<string>")), ",").alias("meta"), "refetch")



@query(f"""WITH {STATE_SQL} SELECT concat('{{"known":{{"info":{{"url":"', url, '","key":"', key, '"', CASE WHEN status IS NULL THEN '' ELSE concat(',"metadata":{{"status":{{"values":["', status, '"]}}}}') END,
    ',"crawlID":"', crawl_id, '"}}', CASE WHEN refetch = 0 THEN '' ELSE concat(',"refetchableFromDate":"', CAST(refetch AS VARCHAR), '"') END, '}},"creationDate":"', CAST(creation_date AS VARCHAR), '"}}') AS value FROM urls""")
def dump_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.json_lines(state(spark, sf_dir).urls)


@query(f"WITH {STATE_SQL} SELECT concat(url, ';', CAST(refetch AS VARCHAR)) AS value FROM urls")
def dump_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump.listing(state(spark, sf_dir).urls)


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def ack_rate_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return ack_rate(e, "1 hour", by=("kind",)).select(F.unix_timestamp("start").alias("hour"), "kind", "n")
