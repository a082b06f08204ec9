"""The crawl state on disk: immutable Parquet pieces and a manifest for each version.

Every table (urls, queues, leases) is cut into shards by a hash of crawl and key, so that whatever concerns one queue
reads and writes one shard. A shard is a base piece and deltas on top of it: a change writes only the rows it changes
(and marks for rows that are gone), and a read takes the newest row of each key. Deltas are merged by an anti-join of the
base with their keys, which are broadcast while the manifest counts at most BROADCAST_ROWS of them; a shard whose deltas
have grown to a share of its base (or to MOST_DELTAS) is rewritten by the next change that touches it. Within a base piece
rows are sorted by crawl, key, date and URL, so that row groups prune by date and by queue, and ``url`` has a Bloom filter.

A commit writes its pieces, claims the next version number, and puts the manifest there by a rename: of two writers
on the same version the second fails. The claim is a file created where none was, which file systems do in one step.
Results that a version has to be able to give again (acknowledgements of a stream) are named in its manifest. Pieces,
and results that no manifest names, stay until ``vacuum``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.schema import DEFAULT_DELAY, KEYS, LEASES, QUEUES, URL_KEYS, URLS, columns

SHARDS = 64
PART_ROWS = 2_000_000
BROADCAST_ROWS = 1 << 18
MOST_DELTAS = 8
DELTA_SHARE = 0.2
CLAIM_SECONDS = 600
#: Schema, key columns and sort order of each table.
TABLES = {"urls": (URLS, URL_KEYS, [*KEYS, "refetch", "url"]), "queues": (QUEUES, KEYS, KEYS), "leases": (LEASES, URL_KEYS, URL_KEYS)}
DELTA = ", _version bigint, _gone boolean"


class Conflict(RuntimeError):
    """Another writer committed first."""


def shard_of(crawl_id: Column, key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(crawl_id, key), F.lit(shards)).cast("int")


def _settings() -> dict:
    return {"active": True, "default_delay": DEFAULT_DELAY, "nodes": [], "last_epoch": {}}


@dataclass
class Manifest:
    version: int
    shards: int
    #: table -> shard -> pieces as (path, rows), the base first; an empty path is no base.
    tables: dict[str, dict[str, list[list]]] = field(default_factory=lambda: {t: {} for t in TABLES})
    settings: dict = field(default_factory=_settings)
    #: source of a stream -> path of the acknowledgements of its last epoch.
    results: dict[str, str] = field(default_factory=dict)


class Store:
    """Versions of the state below ``path``, on any file system that Spark's Hadoop client opens."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS, bloom: bool = True):
        self.spark, self.path, self.bloom = spark, path.rstrip("/"), bloom
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._Path(f"{self.path}/manifests"))
        if not self.versions():
            self._put(Manifest(0, shards))

    # Manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._Path(f"{self.path}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, version: int | None = None) -> Manifest:
        at = self.versions()[-1] if version is None else version
        stream = self.fs.open(self._Path(f"{self.path}/manifests/{at:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _claim(self, version: int) -> None:
        """Create the file that makes ``version`` ours; one left by a writer that died is taken over after a while."""
        path = self._Path(f"{self.path}/manifests/{version:012d}.claim")
        for _ in range(2):
            try:
                if self.fs.getScheme() == "file":  # where Spark's own check and creation are two steps
                    os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                else:
                    self.fs.create(path, False).close()
                return
            except FileExistsError:
                pass
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
            age = time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000
            if version in self.versions() or age < CLAIM_SECONDS:
                break
            self.fs.delete(path, False)
        raise Conflict(f"version {version} is another writer's")

    def _put(self, m: Manifest) -> None:
        self._claim(m.version)
        draft = self._Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(vars(m)).encode()))
        out.close()
        if not self.fs.rename(draft, self._Path(f"{self.path}/manifests/{m.version:012d}.json")):
            raise Conflict(f"version {m.version} is there already")

    # Reading

    def read(self, m: Manifest, table: str, shards: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its shards."""
        schema, keys, _ = TABLES[table]
        held = {s: p for s, p in m.tables[table].items() if shards is None or int(s) in set(shards)}
        base = lambda which: [p[0][0] for p in which if p[0][0]]
        clean, dirty = [p for p in held.values() if len(p) == 1], [p for p in held.values() if len(p) > 1]
        deltas = [d for p in dirty for d in p[1:]]
        if not deltas:
            return self._load(base(clean), schema)
        latest = self._load([d[0] for d in deltas], schema + DELTA)
        rows = F.max_by(F.struct(*columns(schema), "_gone"), "_version").alias("row")
        latest = latest.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(rows).select("row.*")
        named = latest.select(*keys)
        few = sum(d[1] for d in deltas) <= BROADCAST_ROWS
        old = self._load(base(dirty), schema).join(F.broadcast(named) if few else named, keys, "left_anti").select(*columns(schema))
        out = old.unionByName(latest.filter("not _gone").drop("_gone"))
        return self._load(base(clean), schema).unionByName(out) if base(clean) else out

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def urls(self, m: Manifest, shards: list[int] | None = None) -> DataFrame:
        return self.read(m, "urls", shards)

    def queues(self, m: Manifest, shards: list[int] | None = None) -> DataFrame:
        return self.read(m, "queues", shards)

    def leases(self, m: Manifest, shards: list[int] | None = None) -> DataFrame:
        return self.read(m, "leases", shards)

    def shard(self, m: Manifest, crawl_id: str, key: str) -> int:
        """The shard of one queue."""
        return self.spark.range(1).select(shard_of(F.lit(crawl_id), F.lit(key), m.shards).alias("s")).first()["s"]

    def statistics(self, m: Manifest) -> DataFrame:
        """table, shard, base_rows, delta_rows, pieces of every shard, from the manifest."""
        rows = [(t, int(s), int(p[0][1]), int(sum(d[1] for d in p[1:])), len(p)) for t, own in m.tables.items() for s, p in own.items()]
        return self.spark.createDataFrame(rows, "table string, shard int, base_rows bigint, delta_rows bigint, pieces int")

    # Writing

    def _write(self, m: Manifest, table: str, rows: DataFrame, n: int, delta: bool) -> dict[str, list]:
        """Write ``n`` rows by shard; the piece and the number of rows of each shard."""
        _, _, order = TABLES[table]
        piece = f"{table}/{uuid.uuid4().hex}"
        # A shard is dealt over several tasks by URL, so that a queue with a third of all rows is not one task's.
        parts = max(1, -(-n // (PART_ROWS * m.shards))) * (4 if n > PART_ROWS else 1)
        deal = F.pmod(F.xxhash64("url" if table != "queues" else "key"), F.lit(parts))
        tagged = rows.withColumn("shard", shard_of(F.col("crawl_id"), F.col("key"), m.shards)).withColumn("_part", deal)
        writer = tagged.repartition("shard", "_part").drop("_part").sortWithinPartitions("shard", *order).write.partitionBy("shard")
        if self.bloom and not delta and table == "urls":
            writer = writer.option("parquet.bloom.filter.enabled#url", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/{piece}")
        if not n:
            return {}
        found = self.spark.read.schema("shard int").parquet(f"{self.path}/{piece}").groupBy("shard").count().collect()  # a row for each shard
        return {str(r["shard"]): [f"{piece}/shard={r['shard']}", r["count"]] for r in found}

    def replace(self, m: Manifest, table: str, shards: list[int], rows: DataFrame, n: int | None = None) -> Manifest:
        """``rows`` (about ``n``, or as many as there were) in place of all rows of ``shards``."""
        n = n or sum(x[1] for s in shards for x in m.tables[table].get(str(s), []))
        made = self._write(m, table, rows, max(n, 1), delta=False)
        own = {s: p for s, p in m.tables[table].items() if int(s) not in set(shards)} | {s: [p] for s, p in made.items()}
        return self._with(m, table, own)

    def change(self, m: Manifest, table: str, rows: DataFrame, gone: DataFrame | None = None, keep: Column | None = None) -> Manifest:
        """``rows`` in place of those of equal keys, and ``gone`` away (no key is in both). Both must be cheap to
        read again (written tables). Shards that have too many deltas then get a new base, of the rows that pass ``keep``;
        a table that was empty is written as bases."""
        schema, keys, _ = TABLES[table]
        mark = lambda df, away: df.select(*columns(schema), F.lit(m.version + 1).cast("long").alias("_version"), F.lit(away).alias("_gone"))
        delta = mark(rows, False)
        if gone is not None:
            blank = [F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in self.spark.createDataFrame([], schema).dtypes]
            delta = delta.unionByName(mark(gone.select(*blank), True))
        n = delta.count()
        if not n:
            return m
        if not m.tables[table]:
            return self.replace(m, table, list(range(m.shards)), rows.select(*columns(schema)), n)
        own = dict(m.tables[table])
        for s, p in self._write(m, table, delta, n, delta=True).items():
            own[s] = [*own.get(s, [["", 0]]), p]
        after = self._with(m, table, own)
        full = [int(s) for s, p in own.items() if len(p) > 1 and (len(p) > MOST_DELTAS or sum(d[1] for d in p[1:]) > DELTA_SHARE * p[0][1])]
        if not full:
            return after
        merged = self.read(after, table, full)
        return self.replace(after, table, full, merged if keep is None else merged.filter(keep))

    @staticmethod
    def _with(m: Manifest, table: str, own: dict) -> Manifest:
        return Manifest(**(vars(m) | {"tables": m.tables | {table: own}}))

    def commit(self, before: Manifest, after: Manifest | None = None, **changes) -> Manifest:
        """The version after ``before``: its tables are those of ``after``, other fields may be given."""
        new = Manifest(**(vars(after or before) | changes | {"version": before.version + 1}))
        self._put(new)
        return new

    # Results

    def result(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """``df`` written and read back, and where."""
        piece = f"results/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{piece}")
        return self._load([piece], df.schema), piece

    def drop(self, *pieces: str) -> None:
        for p in pieces:
            self.fs.delete(self._Path(f"{self.path}/{p}"), True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but for the last ``keep``, and pieces and results that none of these names (results of
        earlier calls can't be read any more then). Returns how many pieces."""
        found = self.versions()
        live: set[str] = set()
        for v in found[-keep:]:
            m = self.load(v)
            live |= {x[0].rpartition("/")[0] for own in m.tables.values() for p in own.values() for x in p} | set(m.results.values())
        for v in found[:-keep]:
            for end in ("json", "claim"):
                self.fs.delete(self._Path(f"{self.path}/manifests/{v:012d}.{end}"), False)
        gone = 0
        for kind in (*TABLES, "results"):
            top = self._Path(f"{self.path}/{kind}")
            if self.fs.exists(top):
                for s in self.fs.listStatus(top):
                    if f"{kind}/{s.getPath().getName()}" not in live:
                        self.fs.delete(s.getPath(), True)
                        gone += 1
        return gone
