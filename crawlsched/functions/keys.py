"""Column functions for crawl identifiers, queue keys and queue identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsched.schema import DEFAULT_CRAWL, LONGEST_KEY


def normalise_crawl(crawl_id: Column) -> Column:
    """Null or blank is the default crawl; anything else stays as it is, untrimmed."""
    return F.when(crawl_id.rlike(r"(?U)\S"), crawl_id).otherwise(F.lit(DEFAULT_CRAWL))


def derive_key(url: Column) -> Column:
    """Queue of a URL that came without one: what follows ``://``, cut at the first ``:``, then ``/``, ``?`` and ``&``.
    Null where nothing is left. Neither lower-cased nor parsed."""
    host = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(url)
    for sign in ":/?&":
        host = F.substring_index(host, sign, 1)
    return F.nullif(host, F.lit(""))


def key_of(key: Column, url: Column) -> Column:
    """The stated key or else the derived one; null if there is none or it is too long, counted in UTF-16 units."""
    found = F.coalesce(F.nullif(key, F.lit("")), derive_key(url))
    return F.when(F.octet_length(F.encode(found, "UTF-16BE")) <= 2 * LONGEST_KEY, found)


def queue_id(crawl_id: Column, key: Column) -> Column:
    """One string for a queue within a crawl; underscores within the parts are escaped."""
    return F.concat(F.replace(crawl_id, F.lit("_"), F.lit("%5F")), F.lit("_"), F.replace(key, F.lit("_"), F.lit("%5F")))


def parse_queue_id(qid: Column) -> tuple[Column, Column]:
    """Crawl and key of ``queue_id``; both null where there is no separator."""
    part = lambda n: F.when(F.instr(qid, "_") > 0, F.replace(F.split_part(qid, F.lit("_"), F.lit(n)), F.lit("%5F"), F.lit("_")))
    return part(1), part(2)


def padded_date(date: Column) -> Column:
    """Ten digits with leading zeros; longer numbers stay whole."""
    text = date.cast("string")
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of the JVM, as a signed long: over UTF-16 units, so astral characters count twice. Folds are
    interpreted, character by character: plain ASCII takes a shorter step, and the sign refers to the fold only once."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = lambda a, unit: (a * 31 + unit).bitwiseAND(mask)

    def char(a: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        far = code - 0x10000
        return F.when(code < 0x10000, step(a, code)).otherwise(step(step(a, F.shiftright(far, 10) + 0xD800), far.bitwiseAND(F.lit(0x3FF)) + 0xDC00))

    fold = lambda f: F.aggregate(F.split(text, ""), F.lit(0).cast("long"), f)
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, fold(lambda a, c: step(a, F.ascii(c)))).otherwise(fold(char))
    return low.bitwiseXOR(F.lit(2**31)) - 2**31


def partition_for(crawl_id: Column, key: Column, nodes: int) -> Column:
    """The node, in a sorted list of ``nodes``, that owns a queue. The remainder keeps the sign of the hash before its
    absolute value is taken."""
    return F.abs(java_hash(queue_id(crawl_id, key)) % nodes)


def url_filter(url: Column, wanted: str | None, ignore_case: bool = False) -> Column:
    """Whether a URL contains a string; a blank one lets all through."""
    if not wanted or not wanted.strip():
        return F.lit(True)
    return F.contains(F.lower(url), F.lit(wanted.lower())) if ignore_case else F.contains(url, F.lit(wanted))


def ack_id(item_id: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(item_id, F.lit("")), url)


def shown_date(epoch: Column, zone: str = "UTC") -> Column:
    """Local date and time of epoch seconds, for display."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd'T'HH:mm:ss")
