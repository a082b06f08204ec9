"""Serving: which URLs are due now, and the state after they were handed out.

A queue is open if it is not blocked, its limit of completed URLs is not reached, its delay has passed since it last
gave a URL, and fewer than ``max_urls`` of its URLs are leased. An open queue gives its due, unleased URLs in order of
date and URL.

Plan: an open queue has at most ``max_urls`` - 1 leases, so its answer lies within its first 2 * ``max_urls`` - 1 due
URLs. The scan over all URLs therefore ranks first (Spark prunes each task to that many rows per queue before the
shuffle, so a queue with a third of all URLs costs no more than any other), and gate and leases are joined to what is
left. In-process counts come from the leases alone. Completed URLs are counted by queue within each scan task, before what is
left of them meets the queues with a limit; limits are rare, but nothing bounds their number, so they are not broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlsched.functions.keys import partition_for
from crawlsched.schema import DEFAULT_DELAY, DEFAULT_LEASE, KEYS, LEASES, QUEUES, UNSET, URL_KEYS, columns


@dataclass(frozen=True)
class Get:
    """What to serve. 0 is unlimited for ``max_urls`` and ``max_queues``, and the default for ``lease``. ``crawl_id``
    None is any crawl; a ``key`` needs a crawl. ``node`` of ``nodes`` serves one node's queues only."""

    max_urls: int = 0
    max_queues: int = 0
    lease: int = 0
    crawl_id: str | None = None
    key: str = ""
    node: int | None = None
    nodes: int = 1

    @property
    def seconds(self) -> int:
        return self.lease or DEFAULT_LEASE


def live(leases: DataFrame, now: int) -> DataFrame:
    """Leases that still hold."""
    return leases.filter(F.col("held_until") > now)


def in_process(leases: DataFrame, now: int) -> DataFrame:
    return live(leases, now).groupBy(*KEYS).agg(F.count("*").alias("in_process"))


def chosen(df: DataFrame, get: Get) -> DataFrame:
    """Rows of the crawl, queue and node asked for."""
    if get.crawl_id is not None:
        df = df.filter(F.col("crawl_id") == (get.crawl_id if get.crawl_id.strip() else "DEFAULT"))
    if get.key:
        df = df.filter(F.col("key") == get.key)
    if get.node is not None:
        df = df.filter(partition_for(F.col("crawl_id"), F.col("key"), get.nodes) == get.node)
    return df


def reason(now: int, max_urls: int, default_delay: int) -> Column:
    """Why a queue is closed: the first of blocked, limit, delay, in_process; null if it is open."""
    delay = F.when(F.col("delay") == UNSET, F.lit(default_delay)).otherwise(F.col("delay"))
    why = F.when(F.col("blocked_until") >= now, "blocked").when((F.col("crawl_limit") > 0) & (F.col("completed") >= F.col("crawl_limit")), "limit").when(~(F.col("last_produced") + delay < now), "delay")
    return why.when(F.col("in_process") >= max_urls, "in_process") if max_urls else why


def gate(queues: DataFrame, urls: DataFrame, leases: DataFrame, now: int, get: Get = Get(), default_delay: int = DEFAULT_DELAY) -> DataFrame:  # noqa: B008
    """The queues asked for, with completed (of limited queues; else 0), in_process and ``closed`` (the reason)."""
    q = chosen(queues, get)
    limited = q.filter("crawl_limit > 0").select(*KEYS)
    done = chosen(urls.filter("refetch = 0"), get).groupBy(*KEYS).agg(F.count("*").alias("completed")).join(limited, KEYS, "left_semi")
    q = q.join(done, KEYS, "left").join(in_process(chosen(leases, get), now), KEYS, "left").fillna(0, ["completed", "in_process"])
    return q.withColumn("closed", reason(now, get.max_urls, default_delay))


def due(urls: DataFrame, queues: DataFrame, leases: DataFrame, now: int, get: Get = Get(), default_delay: int = DEFAULT_DELAY, active: bool = True) -> DataFrame:  # noqa: B008
    """The URLs to hand out: columns of ``urls`` and ``rank`` within the queue, from 1."""
    u = chosen(urls.filter((F.col("refetch") != 0) & (F.col("refetch") <= now)), get)
    if not active or (get.key and get.crawl_id is None):
        u = u.filter(F.lit(False))
    order = Window.partitionBy(*KEYS).orderBy("refetch", "url")
    rank = F.row_number().over(order)
    if get.max_urls:
        u = u.withColumn("rank", rank).filter(F.col("rank") <= 2 * get.max_urls - 1).drop("rank")
    open_ = gate(queues, urls, leases, now, get, default_delay).filter("closed is null").select(*KEYS, "rotation_pos")
    u = u.join(open_, KEYS).join(live(chosen(leases, get), now).select(*URL_KEYS), URL_KEYS, "left_anti")
    u = u.withColumn("rank", rank.cast("long"))
    if get.max_urls:
        u = u.filter(F.col("rank") <= get.max_urls)
    if get.max_queues and not get.key:
        first = u.filter("rank = 1").orderBy("rotation_pos").limit(get.max_queues).select(*KEYS)
        u = u.join(first, KEYS, "left_semi")
    return u.select(*[c for c in urls.columns], "rank")


def leased(leases: DataFrame, sent: DataFrame, now: int, get: Get) -> DataFrame:
    """Leases after ``sent`` was handed out; expired ones are gone."""
    new = sent.select(*URL_KEYS, F.lit(now + get.seconds).cast("long").alias("held_until"))
    old = live(leases, now).join(new.select(*URL_KEYS), URL_KEYS, "left_anti")
    return old.select(*columns(LEASES)).unionByName(new)


def produced(queues: DataFrame, sent: DataFrame, now: int) -> DataFrame:
    """``queues`` with last_produced set where at least one URL went out."""
    from_ = sent.select(*KEYS).distinct().withColumn("_sent", F.lit(True))
    cols = [F.when(F.col("_sent"), F.lit(now).cast("long")).otherwise(F.col(c)).alias(c) if c == "last_produced" else F.col(c) for c in queues.columns]
    return queues.join(from_, KEYS, "left").select(*cols)


def rotated(queues: DataFrame, sent: DataFrame, get: Get) -> DataFrame:
    """``queues`` with the rotation after a serve. Queues are visited by position until ``max_queues`` of them gave a
    URL, and visited ones go to the tail in order. A full round ends where it began, with the first queue moved once
    more, so that the next one starts at the second: only its position changes. A serve by key does not rotate.

    Adding the width of the range to a position keeps the order and puts it above all others, so no ranks are needed.
    """
    if get.key:
        return queues
    hits = queues.join(sent.select(*KEYS).distinct(), KEYS, "left_semi").agg(F.count("*").alias("n"), F.max("rotation_pos").alias("last"))
    bounds = queues.agg(F.struct(F.min("rotation_pos").alias("lo"), F.max("rotation_pos").alias("hi")).alias("b"))
    q = queues.withColumn("_b", bounds.scalar()).withColumn("_h", hits.select(F.struct("n", "last")).scalar())
    q = q.select("*", "_b.lo", "_b.hi", "_h.n", "_h.last")
    stopped = F.lit(bool(get.max_queues)) & (F.col("n") >= get.max_queues)
    width = F.col("hi") - F.col("lo") + 1
    there = F.col("rotation_pos")
    new = F.when(stopped, F.when(there <= F.col("last"), there + width).otherwise(there)).when(there == F.col("lo"), F.col("hi") + 1).otherwise(there)
    return q.select(*[new.alias(c) if c == "rotation_pos" else F.col(c) for c in queues.columns])


def first_queue(queues: DataFrame) -> DataFrame:
    """The queue at the head of the rotation: the one that is served next. No row if there are none."""
    return queues.orderBy("rotation_pos").limit(1)


def without_first(queues: DataFrame) -> DataFrame:
    """What is left when the head of the rotation is taken out."""
    return queues.filter(F.col("rotation_pos") > queues.agg(F.min("rotation_pos").alias("m")).scalar())


def moved(queues: DataFrame, sent: DataFrame, now: int, get: Get) -> DataFrame:
    """The rows of ``queues`` that a serve changes, as they are after it."""
    state = F.struct("last_produced", "rotation_pos")
    after = rotated(produced(queues.withColumn("_was", state), sent, now), sent, get)
    return after.filter(state != F.col("_was")).select(*columns(QUEUES))
