"""The crawl scheduler: all operations over a stored state.

Every change is one commit of ``sources.store``: what a call returns is written before it is returned, so a result is
never worked out again from a state that has moved on. A call writes the rows it changes and no others, in the shards of
their queues. ``local`` arguments of single-node services have no use here and are left out; ``node`` restricts
serving to the queues that one of several nodes would own.

``metrics`` counts what this object did since it was made: calls, URLs and seconds of serving, calls of ingest, and
items discovered, ignored and completed.
"""

from __future__ import annotations

import logging
import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.operators import control, ingest, inspect, serve
from crawlsched.operators.inspect import NotFound, crawl_name
from crawlsched.operators.serve import Get
from crawlsched.schema import ACKS, KEYS, UNSET, URL_KEYS
from crawlsched.sources.store import SHARDS, Manifest, Store, _settings, shard_of


class Frontier:
    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS, purge: bool = False, reset_controls: bool = False, check: bool = False, bloom: bool = True):
        """``purge`` starts empty; ``reset_controls`` forgets delays, blocks, limits, leases and the time of the last
        serve, and activates the service; ``check`` raises if the state has faults."""
        self.spark, self.store, self.metrics = spark, Store(spark, path, shards, bloom), Counter()
        if purge:
            before = self.store.load()
            self.store.commit(before, Manifest(before.version, before.shards, settings=before.settings, results=before.results))
        if reset_controls:
            self._reset()
        if check and (bad := [r.asDict() for r in self.check().filter("n > 0").collect()]):
            raise ValueError(f"the stored state has faults: {bad}")

    # State

    def _state(self, shards: list[int] | None = None) -> tuple[Manifest, DataFrame, DataFrame, DataFrame]:
        m = self.store.load()
        return m, self.store.urls(m, shards), self.store.queues(m, shards), self.store.leases(m, shards)

    def _of(self, crawl_id: str | None, key: str) -> list[int] | None:
        """The shards of what a crawl, or one queue of it, may have: one if there is a key."""
        return [self.store.shard(self.store.load(), crawl_name(crawl_id), key)] if key else None

    def _urls(self, crawl_id: str | None, key: str) -> DataFrame:
        return self.store.urls(self.store.load(), self._of(crawl_id, key))

    def _shards(self, m: Manifest, rows: DataFrame) -> list[int]:
        found = rows.select(shard_of(F.col("crawl_id"), F.col("key"), m.shards).alias("s")).distinct()
        return sorted(r.s for r in found.collect())  # at most as many as there are shards

    def _reset(self) -> None:
        m = self.store.load()
        q = self.store.queues(m).withColumn("blocked_until", F.lit(UNSET).cast("long")).withColumn("delay", F.lit(UNSET).cast("long"))
        q = q.withColumn("last_produced", F.lit(0).cast("long")).withColumn("crawl_limit", F.lit(0).cast("long"))
        fresh = _settings() | {k: m.settings[k] for k in ("last_epoch", "tail") if k in m.settings}
        after = self.store.replace(m, "queues", [int(s) for s in m.tables["queues"]], q)
        self.store.commit(m, Manifest(**(vars(after) | {"tables": after.tables | {"leases": {}}})), settings=fresh)

    def reshard(self, shards: int) -> None:
        """Write the state again in another number of shards, for one that has outgrown its own."""
        m = self.store.load()
        after, every = Manifest(m.version, shards, settings=m.settings, results=m.results), list(range(shards))
        for table, own in m.tables.items():
            if own:
                after = self.store.replace(after, table, every, self.store.read(m, table), sum(x[1] for p in own.values() for x in p))
        self.store.commit(m, after)

    # Ingest

    def put_urls(self, puts: DataFrame, now: int | None = None, source: str | None = None, epoch: int | None = None) -> DataFrame:
        """Acknowledgements (schema.ACKS) of put items (schema.PUTS). They are part of the commit: the last ``epoch`` of
        a ``source`` is acknowledged again as it was if it comes again; an earlier one changes and acknowledges
        nothing."""
        now = int(time.time()) if now is None else now
        m, store = self.store.load(), self.store
        if source is not None and epoch is not None and m.settings["last_epoch"].get(source, -1) >= epoch:
            again = m.results.get(source) if m.settings["last_epoch"][source] == epoch else None
            return store._load([again], ACKS) if again else self.spark.createDataFrame([], ACKS)
        puts, p_path = store.result(puts, "puts")
        shards = self._shards(m, ingest.normalised(puts).filter("key is not null"))
        urls, queues, leases = (store.read(m, t, shards) for t in ("urls", "queues", "leases"))
        done = ingest.put(puts, urls, now)
        acks, a_path = store.result(done.acks, "acks")
        changed, c_path = store.result(done.changed, "changed")
        tail = m.settings.get("tail", -1)
        fresh, f_path = store.result(ingest.new_queues(queues, puts, tail), "fresh")
        after = store.change(store.change(m, "urls", changed), "queues", fresh)
        if m.tables["leases"]:
            held, h_path = store.result(leases.join(changed.select(*URL_KEYS), URL_KEYS, "left_semi"), "held")
            after = store.change(after, "leases", held.limit(0), held)
            store.drop(h_path)
        settings = m.settings | {"tail": fresh.agg(F.coalesce(F.max("rotation_pos"), F.lit(tail))).first()[0]}
        results = m.results
        if source is not None and epoch is not None:
            settings, results = settings | {"last_epoch": m.settings["last_epoch"] | {source: epoch}}, results | {source: a_path}
        store.commit(m, after, settings=settings, results=results)
        store.drop(p_path, c_path, f_path)
        self.metrics["put_calls"] += 1
        for r in acks.groupBy("kind", "status").count().collect():
            self.metrics["ignored" if r.status != "OK" else "completed" if r.kind == "known" else "discovered"] += r["count"]
        return acks

    def put_discovered(self, batches: DataFrame, now: int | None = None) -> DataFrame:
        """id and statuses of each batch (schema.BATCHES)."""
        batches, _ = self.store.result(batches, "batches")
        return ingest.batch_acks(batches, self.put_urls(ingest.batch_items(batches), now)).drop("seq")

    # Serving

    def get_urls(self, get: Get = Get(), now: int | None = None) -> DataFrame:  # noqa: B008
        """The URLs handed out, leased from now on: columns of urls and ``rank``."""
        now, began = int(time.time()) if now is None else now, time.time()
        store, shards = self.store, self._of(get.crawl_id, get.key) if get.key and get.crawl_id is not None else None
        m, urls, queues, leases = self._state(shards)
        sent, _ = store.result(serve.due(urls, queues, leases, now, get, m.settings["default_delay"], m.settings["active"]), "sent")
        if m.settings["active"] and m.tables["queues"]:
            moved, q_path = store.result(serve.moved(queues, sent, now, get), "moved")
            held, h_path = store.result(serve.leased(leases.limit(0), sent, now, get), "held")
            after = store.change(store.change(m, "queues", moved), "leases", held, keep=F.col("held_until") > now)
            tail = moved.agg(F.greatest(F.max("rotation_pos"), F.lit(m.settings.get("tail", -1)))).first()[0]
            if after is not m:
                store.commit(m, after, settings=m.settings | {"tail": m.settings.get("tail", -1) if tail is None else tail})
            store.drop(q_path, h_path)
        self.metrics.update(get_calls=1, get_urls=sent.count())
        self.metrics["get_seconds"] += time.time() - began
        return sent

    # Inspection

    def list_urls(self, crawl_id: str | None = "", key: str = "", start: int = 0, size: int = 0, wanted: str | None = None, ignore_case: bool = False, after: tuple[str, str] | None = None) -> DataFrame:
        return inspect.list_urls(self._urls(crawl_id, key), crawl_id, key, start, size, wanted, ignore_case, after)

    def count_urls(self, crawl_id: str | None = "", key: str = "", wanted: str | None = None, ignore_case: bool = False) -> int:
        return inspect.count_urls(self._urls(crawl_id, key), crawl_id, key, wanted, ignore_case).first()["n"]

    def url_status(self, url: str, key: str = "", crawl_id: str | None = "") -> dict:
        urls = self.store.urls(self.store.load()) if not key else self._urls(crawl_id, key)
        return inspect.one_status(urls, url, key, crawl_id)

    def stats(self, crawl_id: str | None = None, key: str = "", now: int | None = None) -> DataFrame:
        _, urls, queues, leases = self._state(self._of(crawl_id, key) if crawl_id is not None else None)
        return inspect.stats(urls, queues, leases, int(time.time()) if now is None else now, crawl_id, key)

    def list_queues(self, crawl_id: str | None = "", start: int = 0, size: int = 0, include_inactive: bool = False, now: int | None = None, after: str = "") -> DataFrame:
        _, urls, queues, _ = self._state()
        return inspect.list_queues(queues, urls, int(time.time()) if now is None else now, crawl_id, start, size, include_inactive, after)

    def list_crawls(self) -> DataFrame:
        return inspect.list_crawls(self.store.queues(self.store.load()))

    def list_nodes(self) -> list[str]:
        return sorted(self.store.load().settings["nodes"]) or ["local"]

    def statistics(self) -> DataFrame:
        """Rows and pieces of every shard of every table; nothing is read but the manifest."""
        return self.store.statistics(self.store.load())

    def check(self) -> DataFrame:
        _, urls, queues, _ = self._state()
        return inspect.check(urls, queues)

    # Control

    def get_active(self) -> bool:
        return self.store.load().settings["active"]

    def set_active(self, active: bool) -> None:
        self._settings(active=active)

    def set_nodes(self, nodes: list[str]) -> None:
        self._settings(nodes=sorted(nodes))

    def _settings(self, **changes) -> None:
        m = self.store.load()
        self.store.commit(m, settings=m.settings | changes)

    def _queue_change(self, crawl_id: str | None, key: str, change) -> bool:
        """Write one queue's row as ``change`` makes it; False for an unknown queue."""
        m = self.store.load()
        row, path = self.store.result(change(self.store.queues(m, self._of(crawl_id, key)).filter(control.same_queue(crawl_id, key))), "queue")
        after = self.store.change(m, "queues", row)
        if after is not m:
            self.store.commit(m, after)
        self.store.drop(path)
        return after is not m

    def block_queue_until(self, key: str, crawl_id: str | None = "", until: int = 0) -> None:
        """Unknown queues are ignored."""
        self._queue_change(crawl_id, key, lambda q: control.block_until(q, crawl_id, key, until))

    def set_delay(self, seconds: int, key: str = "", crawl_id: str | None = "") -> None:
        """Without a key, the default of all queues that have no delay of their own."""
        if not key:
            self._settings(default_delay=seconds)
        else:
            self._queue_change(crawl_id, key, lambda q: control.set_delay(q, crawl_id, key, seconds))

    def set_crawl_limit(self, limit: int, key: str, crawl_id: str | None = "") -> None:
        """NotFound for an unknown queue."""
        if not self._queue_change(crawl_id, key, lambda q: control.set_limit(q, crawl_id, key, limit)):
            raise NotFound(key)

    def set_log_level(self, level: str, package: str = "crawlsched") -> None:
        names = {"TRACE": logging.DEBUG}
        logging.getLogger(package).setLevel(names.get(level.upper(), level.upper()))

    # Deletion

    def _drop(self, crawl_id: str | None, key: str, condition, whole: bool) -> int:
        """Rewrite the shards that hold rows of ``condition``; ``whole`` drops queues and leases as well."""
        shards, store = self._of(crawl_id, key), self.store
        m, urls, queues, leases = self._state(shards)
        per = urls.filter(condition).groupBy(shard_of(F.col("crawl_id"), F.col("key"), m.shards).alias("s")).count().collect()  # a row for each shard
        after, hit = m, sorted(r.s for r in per)
        if hit:
            after = store.replace(after, "urls", hit, store.urls(m, hit).filter(~condition))
        lost = leases.filter(control.in_crawl(crawl_id, key)) if whole else leases.join(urls.filter(condition).select(*URL_KEYS), URL_KEYS, "left_semi")
        for table, rows in (("leases", lost), ("queues", queues.filter(control.in_crawl(crawl_id, key)) if whole else queues.limit(0))):
            gone, path = store.result(rows, "gone")
            after = store.change(after, table, gone.limit(0), gone)
            store.drop(path)
        if after is not m:
            store.commit(m, after)
        return sum(r["count"] for r in per)

    def delete_queue(self, key: str, crawl_id: str | None = "") -> int:
        """How many URLs went, completed ones too; 0 for an unknown queue."""
        return self._drop(crawl_id, key, control.in_crawl(crawl_id, key), True)

    def delete_crawl(self, crawl_id: str | None) -> int:
        return self._drop(crawl_id, "", control.in_crawl(crawl_id), True)

    def purge_urls(self, crawl_id: str | None, days: int, key: str = "", now: int | None = None) -> int:
        """How many URLs created more than ``days`` ago went; queues stay."""
        return self._drop(crawl_id, key, control.purgeable(crawl_id, key, int(time.time()) if now is None else now, days), False)

    def delete_urls(self, keys: DataFrame) -> None:
        """Remove listed (crawl_id, key, url); unknown ones are ignored."""
        m, store = self.store.load(), self.store
        keys, k_path = store.result(keys.select(*URL_KEYS).distinct(), "keys")
        after, shards = m, self._shards(m, keys)
        for table in ("urls", "leases"):
            gone, path = store.result(store.read(m, table, shards).join(keys, URL_KEYS, "left_semi"), "gone")
            after = store.change(after, table, gone.limit(0), gone)
            store.drop(path)
        if after is not m:
            store.commit(m, after)
        store.drop(k_path)

    def queue_table(self) -> DataFrame:
        return self.store.queues(self.store.load()).select(*KEYS, "blocked_until", "delay", "last_produced", "crawl_limit", "rotation_pos")
