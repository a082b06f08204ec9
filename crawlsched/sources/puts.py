"""Reading put items: plain text and JSON lines, mixed, gzipped or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.functions.keys import normalise_crawl
from crawlsched.schema import METADATA, PUTS, columns

_INFO = "struct<url:string,key:string,crawlID:string,metadata:map<string,struct<values:array<string>>>>"
#: Longs come as strings; numbers are read as their text.
ITEM = f"discovered struct<info:{_INFO}>, known struct<info:{_INFO},refetchableFromDate:string>, ID string, creationDate string"


def parse_lines(lines: DataFrame, crawl_id: str | None = "") -> DataFrame:
    """Put items from a column ``value``: a line that starts with a brace is one JSON item (whose own crawl counts),
    any other is a URL discovered in ``crawl_id``, with crawl and URL as its identifier.

    ``seq`` follows the order of the lines within a file; it is taken from the scan, before any shuffle. JSON lines
    that can't be read, or that hold neither branch, have kind ``invalid``.
    """
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    d = lines.select(F.monotonically_increasing_id().alias("seq"), text.alias("t"))
    json = F.col("t").startswith("{")
    d = d.withColumn("j", F.when(json, F.from_json("t", ITEM)))
    info = F.coalesce("j.known.info", "j.discovered.info")
    name = normalise_crawl(F.lit(crawl_id or ""))
    kind = F.when(~json, "discovered").when(F.col("j.known").isNotNull(), "known").when(F.col("j.discovered").isNotNull(), "discovered").otherwise("invalid")
    meta = F.transform_values(info["metadata"], lambda _, v: v["values"])
    return d.select(
        "seq",
        F.when(json, F.col("j.ID")).otherwise(F.concat(name, F.lit("_"), "t")).alias("id"),
        kind.alias("kind"),
        F.when(json, info["crawlID"]).otherwise(name).alias("crawl_id"),
        F.when(json, info["key"]).otherwise(F.lit("")).alias("key"),
        F.when(json, info["url"]).otherwise(F.col("t")).alias("url"),
        F.coalesce(meta, F.create_map().cast(METADATA)).alias("metadata"),
        F.coalesce(F.col("j.known.refetchableFromDate").cast("long"), F.lit(0)).alias("refetch"),
    ).select(*columns(PUTS))


def read_puts(spark: SparkSession, path: str, crawl_id: str | None = "") -> DataFrame:
    """Put items from the text files below ``path`` (files named .gz are unpacked), without invalid lines."""
    return parse_lines(spark.read.text(path), crawl_id).filter("kind != 'invalid'")


def invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq of the lines that ``read_puts`` leaves out."""
    return parse_lines(spark.read.text(path)).filter("kind = 'invalid'").select("seq")
