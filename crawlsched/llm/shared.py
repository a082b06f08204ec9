"""Tables in the folder that driver and executors share, and what several operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (one machine, tests) a temporary one takes its place."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="crawlsched-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A place for the intermediate tables of one run, each written once and read back; this cuts the lineage, so that
    a lost executor costs one stage and not the whole run. The shuffles behind a table go as soon as it is written, the
    tables go with ``drop``, ``clear`` or the end of the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/crawlsched/{name}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._fs.deleteOnExit(self._path(self.path))

    def keep(self, df: DataFrame, name: str, rows: int = 1024) -> DataFrame:
        """``df`` written and read back. Python workers get at most ``rows`` rows at once while it is worked out."""
        set_, before = {CLEANUP: "true", BATCH: str(rows)}, {k: self.spark.conf.get(k) for k in (CLEANUP, BATCH)}
        for k, v in set_.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """For tables that nothing to come reads."""
        for name in names:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def clear(self) -> None:
        """For a run whose result was written elsewhere."""
        self._fs.delete(self._path(self.path), True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; null identifiers count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out
