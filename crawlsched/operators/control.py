"""Control, delete and purge: the state after each, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsched.operators.inspect import crawl_name
from crawlsched.schema import URL_KEYS

DAY = 86400


def same_queue(crawl_id: str | None, key: str) -> Column:
    return (F.col("crawl_id") == crawl_name(crawl_id)) & (F.col("key") == key)


def in_crawl(crawl_id: str | None, key: str = "") -> Column:
    """Rows of a crawl, or of one of its queues."""
    return same_queue(crawl_id, key) if key else F.col("crawl_id") == crawl_name(crawl_id)


def set_queue(queues: DataFrame, crawl_id: str | None, key: str, column: str, value: int) -> DataFrame:
    """One control value of one queue changed; an unknown queue changes nothing."""
    new = F.when(same_queue(crawl_id, key), F.lit(value).cast("long")).otherwise(F.col(column))
    return queues.select(*[new.alias(c) if c == column else F.col(c) for c in queues.columns])


def block_until(queues: DataFrame, crawl_id: str | None, key: str, time: int) -> DataFrame:
    """0 unblocks."""
    return set_queue(queues, crawl_id, key, "blocked_until", time)


def set_delay(queues: DataFrame, crawl_id: str | None, key: str, seconds: int) -> DataFrame:
    return set_queue(queues, crawl_id, key, "delay", seconds)


def set_limit(queues: DataFrame, crawl_id: str | None, key: str, limit: int) -> DataFrame:
    """0 clears."""
    return set_queue(queues, crawl_id, key, "crawl_limit", limit)


def keep_outside(df: DataFrame, crawl_id: str | None, key: str = "") -> DataFrame:
    """Any table of the state without a crawl, or without one of its queues."""
    return df.filter(~in_crawl(crawl_id, key))


def deleted_count(urls: DataFrame, crawl_id: str | None, key: str = "") -> DataFrame:
    """How many URLs, scheduled or completed, such a deletion takes."""
    return urls.filter(in_crawl(crawl_id, key)).agg(F.count("*").alias("n"))


def delete_urls(urls: DataFrame, keys: DataFrame) -> DataFrame:
    """``urls`` without the listed (crawl_id, key, url); unknown ones are ignored, queues stay."""
    return urls.join(keys.select(*URL_KEYS), URL_KEYS, "left_anti")


def purgeable(crawl_id: str | None, key: str, now: int, days: int) -> Column:
    """Rows created before ``days`` ago; completed and leased ones too, and all without a creation date (0)."""
    return in_crawl(crawl_id, key) & (F.col("creation_date") < now - days * DAY)


def purge(urls: DataFrame, crawl_id: str | None, now: int, days: int, key: str = "") -> DataFrame:
    """What a purge leaves. Queues stay."""
    return urls.filter(~purgeable(crawl_id, key, now, days))


def purge_count(urls: DataFrame, crawl_id: str | None, now: int, days: int, key: str = "") -> DataFrame:
    return urls.filter(purgeable(crawl_id, key, now, days)).agg(F.count("*").alias("n"))
