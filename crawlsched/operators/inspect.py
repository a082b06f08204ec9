"""Inspection: listings, counts, status and statistics over the crawl state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsched.functions.keys import derive_key, normalise_crawl, partition_for, url_filter
from crawlsched.operators.serve import in_process, live
from crawlsched.schema import DEFAULT_CRAWL, DEFAULT_PAGE, KEYS, URL_KEYS


class NotFound(LookupError):
    """No such URL or queue."""


def crawl_name(crawl_id: str | None) -> str:
    return crawl_id if crawl_id and crawl_id.strip() else DEFAULT_CRAWL


def select_urls(urls: DataFrame, crawl_id: str | None = "", key: str = "", wanted: str | None = None, ignore_case: bool = False) -> DataFrame:
    """URLs of a crawl, of one of its queues if ``key`` is given, that contain a string."""
    df = urls.filter(F.col("crawl_id") == crawl_name(crawl_id))
    if key:
        df = df.filter(F.col("key") == key)
    return df.filter(url_filter(F.col("url"), wanted, ignore_case))


def list_urls(urls: DataFrame, crawl_id: str | None = "", key: str = "", start: int = 0, size: int = 0, wanted: str | None = None, ignore_case: bool = False, after: tuple[str, str] | None = None) -> DataFrame:
    """A page of URLs, whatever their schedule, by key and URL. ``start`` counts rows that pass the filter; ``after``
    (key and URL of the last row of the page before) goes on without counting: each task keeps its ``size`` first rows."""
    found = select_urls(urls, crawl_id, key, wanted, ignore_case)
    if after is not None:
        found = found.filter((F.col("key") > after[0]) | ((F.col("key") == after[0]) & (F.col("url") > after[1])))
    return found.orderBy("key", "url").offset(start).limit(size or DEFAULT_PAGE)


def count_urls(urls: DataFrame, crawl_id: str | None = "", key: str = "", wanted: str | None = None, ignore_case: bool = False) -> DataFrame:
    return select_urls(urls, crawl_id, key, wanted, ignore_case).agg(F.count("*").alias("n"))


def url_status(urls: DataFrame, url: str, key: str = "", crawl_id: str | None = "") -> DataFrame:
    """The row of one URL, if there is one. A missing key is derived."""
    same: Column = F.col("key") == (F.lit(key) if key else derive_key(F.lit(url)))
    return urls.filter((F.col("crawl_id") == crawl_name(crawl_id)) & same & (F.col("url") == url))


def one_status(urls: DataFrame, url: str, key: str = "", crawl_id: str | None = "") -> dict:
    """As ``url_status``; raises ValueError for a URL without a key and NotFound for an unknown one."""
    if not key and not urls.sparkSession.range(1).select(derive_key(F.lit(url)).alias("k")).first()["k"]:
        raise ValueError(f"no key can be derived from {url!r}")
    found = url_status(urls, url, key, crawl_id).head(1)
    if not found:
        raise NotFound(url)
    return found[0].asDict(recursive=True)


def queue_counts(urls: DataFrame, queues: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """crawl_id, key, active, completed, in_process of every queue, empty ones too."""
    per = urls.groupBy(*KEYS).agg(F.count_if(F.col("refetch") != 0).alias("active"), F.count_if(F.col("refetch") == 0).alias("completed"))
    return queues.select(*KEYS).join(per, KEYS, "left").join(in_process(leases, now), KEYS, "left").fillna(0, ["active", "completed", "in_process"])


def stats(urls: DataFrame, queues: DataFrame, leases: DataFrame, now: int, crawl_id: str | None = None, key: str = "") -> DataFrame:
    """One row for each crawl (or for the one asked for): size, in_process, number_of_queues, completed, active_queues."""
    parts = []
    for df in (urls, queues, leases):
        if crawl_id is not None:
            df = df.filter(F.col("crawl_id") == crawl_name(crawl_id))
        parts.append(df.filter(F.col("key") == key) if key else df)
    return _added(queue_counts(*parts, now), "crawl_id")


def _added(per: DataFrame, *by: str | Column) -> DataFrame:
    """Rows of ``queue_counts`` as statistics, one row for each value of ``by``."""
    return per.groupBy(*by).agg(
        F.sum("active").alias("size"), F.sum("in_process").alias("in_process"), F.count("*").alias("number_of_queues"),
        F.sum("completed").alias("completed"), F.count_if((F.col("active") > 0) | (F.col("in_process") > 0)).alias("active_queues"),
    )


def stats_by_node(urls: DataFrame, queues: DataFrame, leases: DataFrame, now: int, nodes: int) -> DataFrame:
    """Rows of ``stats`` with the node they are of, for all nodes in one pass. The owner is worked out once a queue, behind
    the counts; a filter by owner would be pushed down to every URL. Queues without crawl or key have no owner."""
    per = queue_counts(urls, queues.dropna(subset=KEYS), leases, now)
    return _added(per, partition_for(F.col("crawl_id"), F.col("key"), nodes).alias("node"), "crawl_id")


def merge_stats(parts: DataFrame) -> DataFrame:
    """Statistics of several nodes (rows as ``stats`` gives them) added up."""
    names = ("size", "in_process", "number_of_queues", "completed", "active_queues")
    return parts.groupBy("crawl_id").agg(*[F.sum(c).alias(c) for c in names])


def as_message(one: DataFrame) -> DataFrame:
    """Rows of ``stats`` with the counters in a map."""
    return one.select("crawl_id", "size", "in_process", "number_of_queues", F.create_map(F.lit("completed"), "completed", F.lit("active_queues"), "active_queues").alias("counts"))


def list_queues(queues: DataFrame, urls: DataFrame, now: int, crawl_id: str | None = "", start: int = 0, size: int = 0, include_inactive: bool = False, after: str = "") -> DataFrame:
    """A page of queues of a crawl by key, as ``select_queues`` finds them. ``start`` counts queues that match, ``after`` is
    the last key of the page before."""
    return select_queues(queues, urls, now, crawl_id, include_inactive, after).orderBy("key").offset(start).limit(size or DEFAULT_PAGE)


def select_queues(queues: DataFrame, urls: DataFrame, now: int, crawl_id: str | None = "", include_inactive: bool = False, after: str = "") -> DataFrame:
    """crawl_id, key: queues of a crawl; unless ``include_inactive``, without those that are blocked or have no scheduled
    URL, due or not."""
    q = queues.filter((F.col("crawl_id") == crawl_name(crawl_id)) & (F.col("key") > after))
    if not include_inactive:
        own = urls.filter((F.col("crawl_id") == crawl_name(crawl_id)) & (F.col("refetch") != 0))
        q = q.filter(~(F.col("blocked_until") >= now)).join(own.select(*KEYS), KEYS, "left_semi")
    return q.select(*KEYS)


def pages_by_node(found: DataFrame, nodes: int, size: int = 0) -> DataFrame:
    """The first page, by key, of each node's queues among those found, in one pass: crawl_id, key, node. Tasks keep a page
    for each node before the shuffle; beyond a ``size`` of 1000 (``spark.sql.optimizer.windowGroupLimitThreshold``) all."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy("key"))
    return owners(found, nodes).withColumn("rank", rank).filter(F.col("rank") <= (size or DEFAULT_PAGE)).drop("rank")


def queue_sizes(queues: DataFrame, urls: DataFrame) -> DataFrame:
    """crawl_id, key, size: all queues with how many URLs they hold, completed ones too."""
    held = urls.groupBy(*KEYS).agg(F.count("*").alias("size"))
    return queues.select(*KEYS).join(held, KEYS, "left").fillna(0, ["size"])


def list_crawls(queues: DataFrame) -> DataFrame:
    return queues.select("crawl_id").distinct()


def list_nodes(spark, nodes: list[str]) -> DataFrame:
    """Sorted node names."""
    return spark.createDataFrame([(n,) for n in sorted(nodes)], "node string")


def all_active(settings: DataFrame) -> DataFrame:
    """Whether every node's row of ``settings`` is active."""
    return settings.agg(F.bool_and("active").alias("active"))


def held(urls: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """URLs that are leased at ``now``."""
    return urls.join(live(leases, now).select(*URL_KEYS), URL_KEYS, "left_semi")


def owners(queues: DataFrame, nodes: int) -> DataFrame:
    """crawl_id, key and the number of the node that owns the queue."""
    return queues.select(*KEYS, partition_for(F.col("crawl_id"), F.col("key"), nodes).alias("node"))


def check(urls: DataFrame, queues: DataFrame) -> DataFrame:
    """Faults of the state, one row each kind: URL keys that occur twice, URLs without a queue, crawls not normalised."""
    twice = urls.groupBy(*URL_KEYS).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("repeated_url").alias("fault"), F.count("*").alias("n"))
    stray = urls.join(queues, KEYS, "left_anti").agg(F.lit("url_without_queue").alias("fault"), F.count("*").alias("n"))
    raw = urls.filter(~F.col("crawl_id").eqNullSafe(normalise_crawl(F.col("crawl_id")))).agg(F.lit("crawl_not_normalised").alias("fault"), F.count("*").alias("n"))
    return twice.unionByName(stray).unionByName(raw)
