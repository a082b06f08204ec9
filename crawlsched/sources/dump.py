"""Writing URLs: JSON lines that ``sources.puts`` reads back, and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsched.functions.keys import shown_date


def as_item() -> Column:
    """A row of urls as a known item; names in camel case, longs as strings, defaults left out."""
    some = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    meta = F.transform_values("metadata", lambda _, v: F.struct(v.alias("values")))
    info = F.struct(F.col("url"), F.col("key"), F.when(F.size("metadata") > 0, meta).alias("metadata"), F.col("crawl_id").alias("crawlID"))
    known = F.struct(info.alias("info"), some("refetch").alias("refetchableFromDate"))
    return F.struct(known.alias("known"), some("creation_date").alias("creationDate"))


def json_lines(urls: DataFrame, crawl_id: str | None = None, pretty: bool = False) -> DataFrame:
    """One column ``value``: every URL, completed ones too, as compact (or pretty) JSON."""
    if crawl_id is not None:
        urls = urls.filter(F.col("crawl_id") == crawl_id)
    return urls.select(F.to_json(as_item(), {"pretty": str(pretty).lower(), "ignoreNullFields": "true"}).alias("value"))


def dump(urls: DataFrame, path: str, crawl_id: str | None = None, compress: bool = False) -> None:
    """Write ``json_lines`` as text files, one per partition, gzipped if ``compress``."""
    json_lines(urls, crawl_id).write.option("compression", "gzip" if compress else "none").text(path)


def listing(urls: DataFrame, show_dates: bool = False, zone: str = "UTC") -> DataFrame:
    """One column ``value``: URL and date, as epoch seconds or as local time, separated by a semicolon."""
    date = shown_date(F.col("refetch"), zone) if show_dates else F.col("refetch").cast("string")
    return urls.select(F.concat_ws(";", "url", date).alias("value"))
