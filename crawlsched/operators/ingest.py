"""Ingest: discovered and fetched URLs into the crawl state, with an acknowledgement for each item.

A discovered URL is inserted, due at once, if it is not there; else the item is SKIPPED. A known URL overwrites what is
there: its date is when to fetch it again, 0 being never, and a completed URL loses its metadata. The creation date is
set once. Items without a usable key are SKIPPED.

Items of one call that share a URL are folded in the order of ``seq``. Only the first item of a URL can be an accepted
discovery, so one aggregate per URL (combined before the shuffle, so that a URL named by a third of all items costs one
row for each task) gives both the new state and the few sequence numbers that the acknowledgements depend on; these are
joined back on ``seq``, which no two items share.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlsched.functions.keys import ack_id, key_of, normalise_crawl
from crawlsched.schema import ACKS, METADATA, QUEUES, UNSET, URL_KEYS, URLS, columns

ITEM = 1 << 31
SLOTS = 1024


class Ingested(NamedTuple):
    acks: DataFrame
    changed: DataFrame  # rows of urls, to replace those of equal keys


def normalised(puts: DataFrame) -> DataFrame:
    """Puts with crawl and key filled in; ``key`` is null for items that can't be taken. A missing kind is discovered."""
    url = F.coalesce("url", F.lit(""))
    return puts.select(
        "seq",
        ack_id(F.col("id"), url).alias("id"),
        F.coalesce("kind", F.lit("discovered")).alias("kind"),
        normalise_crawl(F.col("crawl_id")).alias("crawl_id"),
        key_of(F.col("key"), url).alias("key"),
        url.alias("url"),
        F.coalesce("metadata", F.create_map().cast(METADATA)).alias("metadata"),
        F.coalesce("refetch", F.lit(0)).cast("long").alias("refetch"),
    )


def groups(items: DataFrame) -> DataFrame:
    """One row per URL: its first item, and its last known item if any."""
    known = F.col("kind") == "known"
    return items.filter("key is not null").groupBy(*URL_KEYS).agg(
        F.min("seq").alias("first_seq"),
        F.min_by("kind", "seq").alias("first_kind"),
        F.min_by("metadata", "seq").alias("first_metadata"),
        F.max(known).alias("has_known"),
        F.max_by(F.when(known, F.struct("refetch", "metadata")), F.when(known, F.col("seq"))).alias("known"),
    )


def put(puts: DataFrame, urls: DataFrame, now: int) -> Ingested:
    """Fold ``puts`` (see schema.PUTS; ``seq`` unique) into ``urls`` at time ``now``."""
    items = normalised(puts)
    old = urls.select(*URL_KEYS, F.col("creation_date").alias("old_creation"))
    g = groups(items).join(old, URL_KEYS, "left")
    new = F.col("old_creation").isNull()
    accepted = g.filter(new & (F.col("first_kind") == "discovered")).select(F.col("first_seq").alias("seq"), F.lit(True).alias("accepted"))
    taken = (F.col("kind") == "known") | F.coalesce("accepted", F.lit(False))
    status = F.when(F.col("key").isNotNull() & taken, "OK").otherwise("SKIPPED")
    acks = items.select("seq", "id", "kind", "key").join(accepted, "seq", "left").withColumn("status", status).select(*columns(ACKS))
    refetch = F.when(F.col("has_known"), F.col("known.refetch")).otherwise(F.lit(now).cast("long"))
    metadata = F.when(F.col("has_known"), F.col("known.metadata")).otherwise(F.col("first_metadata"))
    changed = g.filter(new | F.col("has_known")).withColumn("refetch", refetch)
    changed = changed.withColumn("metadata", F.when(F.col("refetch") == 0, F.create_map().cast(METADATA)).otherwise(metadata))
    changed = changed.withColumn("creation_date", F.coalesce("old_creation", F.lit(now).cast("long"))).select(*columns(URLS))
    return Ingested(acks, changed)


def upsert(urls: DataFrame, changed: DataFrame) -> DataFrame:
    """``urls`` with the rows of ``changed`` in place of those of equal keys."""
    cols = columns(URLS)
    return urls.join(changed.select(*URL_KEYS), URL_KEYS, "left_anti").select(*cols).unionByName(changed.select(*cols))


def release(leases: DataFrame, changed: DataFrame) -> DataFrame:
    """Leases without those of updated URLs."""
    return leases.join(changed.select(*URL_KEYS), URL_KEYS, "left_anti")


def new_queues(queues: DataFrame, puts: DataFrame, tail: int | Column) -> DataFrame:
    """Rows for the queues that an accepted put names first, behind position ``tail`` in the order of their arrival.

    Ranks are taken within SLOTS ranges of sequence numbers and set off by the counts of the ranges before, so that no
    task sorts all new queues."""
    named = normalised(puts).filter("key is not null").groupBy("crawl_id", "key").agg(F.min("seq").alias("seq"))
    fresh = named.join(queues.select("crawl_id", "key"), ["crawl_id", "key"], "left_anti")
    ends = fresh.agg(F.struct(F.min("seq").alias("lo"), F.max("seq").alias("hi")).alias("e")).scalar()
    fresh = fresh.withColumn("_e", ends).withColumn("slot", F.floor((F.col("seq") - F.col("_e.lo")) / (F.floor((F.col("_e.hi") - F.col("_e.lo")) / SLOTS) + 1))).drop("_e")
    before = fresh.groupBy("slot").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))  # SLOTS rows
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("seq")).cast("long")
    placed = fresh.withColumn("rank", rank).join(F.broadcast(before.select("slot", F.coalesce("before", F.lit(0)).alias("before"))), "slot")
    unset, zero = F.lit(UNSET).cast("long"), F.lit(0).cast("long")
    place = (tail if isinstance(tail, Column) else F.lit(tail)) + F.col("before") + F.col("rank")
    return placed.select("crawl_id", "key", unset.alias("blocked_until"), unset.alias("delay"), zero.alias("last_produced"), zero.alias("crawl_limit"), place.cast("long").alias("rotation_pos"))


def add_queues(queues: DataFrame, puts: DataFrame) -> DataFrame:
    """``queues`` with ``new_queues`` at the tail of the rotation."""
    tail = queues.agg(F.coalesce(F.max("rotation_pos"), F.lit(-1)).alias("tail")).scalar()
    return queues.select(*columns(QUEUES)).unionByName(new_queues(queues, puts, tail))


def batch_items(batches: DataFrame) -> DataFrame:
    """Discovered batches (see schema.BATCHES) as puts; the sequence number is the batch's, then the place in it. An
    array has fewer than ITEM items, so no two are given the same; batch numbers go up to 2**32."""
    each = batches.select(F.col("seq").alias("batch"), F.posexplode("items"))
    return each.select(
        (F.col("batch") * F.lit(ITEM).cast("long") + F.col("pos")).alias("seq"), F.lit(None).cast("string").alias("id"), F.lit("discovered").alias("kind"),
        F.col("col.crawl_id").alias("crawl_id"), F.col("col.key").alias("key"), F.col("col.url").alias("url"),
        F.col("col.metadata").alias("metadata"), F.lit(None).cast("long").alias("refetch"),
    )


def batch_acks(batches: DataFrame, acks: DataFrame) -> DataFrame:
    """id, statuses (in the order of the items) of each batch; a batch without items has none."""
    by = acks.groupBy(F.shiftright("seq", 31).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("all"))
    statuses = F.coalesce(F.transform("all", lambda x: x["status"]), F.array().cast("array<string>"))
    return batches.select("seq", "id").join(by, "seq", "left").select("seq", "id", statuses.alias("statuses"))


def summary(acks: DataFrame) -> DataFrame:
    """Items by kind and status."""
    return acks.groupBy("kind", "status").agg(F.count("*").alias("n"))


def averages(acks: DataFrame) -> DataFrame:
    """kind, n, per_second of timed acknowledgements (``ts``): items over the whole seconds from the first to the last, 1
    at least."""
    seconds = F.greatest(F.lit(1), F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts")))
    return acks.groupBy("kind").agg(F.count("*").alias("n"), (F.count("*") / seconds).alias("per_second"))
