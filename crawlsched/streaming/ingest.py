"""Continuous ingest: a stream of lines or put items into a stored crawl state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlsched.frontier import Frontier
from crawlsched.schema import PUTS
from crawlsched.sources.puts import parse_lines


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of text files (column ``value``) as they appear below ``path``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def put_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Put items of Parquet files (schema.PUTS) as they appear below ``path``."""
    return spark.readStream.schema(PUTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(frontier: Frontier, puts: DataFrame, checkpoint: str, acks: str | None = None, source: str = "stream", trigger: dict | None = None, crawl_id: str = "", clock: Callable[[], int] = lambda: int(time.time())) -> StreamingQuery:
    """Fold every micro-batch of put items, or of lines (read as items of ``crawl_id``), into ``frontier``. The number of the micro-batch and its acknowledgements are part of the commit, so one that is
    replayed after a failure changes nothing and gives the same acknowledgements, which go to ``acks``/epoch=N."""

    def fold(batch: DataFrame, epoch: int) -> None:
        if "seq" not in batch.columns:  # numbers for lines can only be given within a micro-batch
            batch = parse_lines(batch, crawl_id).filter("kind != 'invalid'")
        done = frontier.put_urls(batch, clock(), source, epoch)
        if acks and done.head(1):
            done.withColumn("ts", F.current_timestamp()).write.mode("overwrite").parquet(f"{acks}/epoch={epoch}")

    return puts.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
