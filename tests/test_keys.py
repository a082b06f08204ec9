import pytest
from pyspark.sql import functions as F

from crawlsched.functions import keys
from crawlsched.operators.inspect import list_nodes


def values(spark, column, inputs):
    return [r.out for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i long, x string").select("i", column(F.col("x")).alias("out")).orderBy("i").collect()]


def test_derive_key(spark):
    cases = {"http://user:pw@h.com/x": "user", "http://a.com:80/x:y": "a.com", "mailto:x@y": "mailto", "http://h.com#f": "h.com#f", "": None, "http://": None, "http://[::1]/": "[", "HTTP://A.com&x": "A.com", "http://gac.icann.org?language_id=9": "gac.icann.org", None: None}
    assert values(spark, keys.derive_key, cases) == list(cases.values())


def test_crawls_and_queue_ids(spark):
    assert values(spark, keys.normalise_crawl, ["", " ", "\t", None, " a ", "b"]) == ["DEFAULT"] * 4 + [" a ", "b"]
    assert values(spark, lambda x: keys.queue_id(x, F.lit("k_1")), ["a_b"]) == ["a%5Fb_k%5F1"]
    assert values(spark, lambda x: F.concat_ws("|", *keys.parse_queue_id(x)), ["a%5Fb_k%5F1", "none"]) == ["a_b|k_1", ""]
    assert values(spark, lambda x: keys.padded_date(x.cast("long")), ["0", "12", "1234567890", "12345678901"]) == ["0000000000", "0000000012", "1234567890", "12345678901"]


def java(text):
    h, raw = 0, text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2])) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


@pytest.mark.parametrize("nodes", [1, 3, 7])
def test_partition(spark, nodes):
    names = ["example.com", "", "aé", "x" * 40, "\U0001f600.org", "polygenelubricants"]
    assert values(spark, keys.java_hash, names) == [java(n) for n in names]
    want = [abs(int(java(f"DEFAULT_{n}") / nodes) * nodes - java(f"DEFAULT_{n}")) for n in names]
    assert values(spark, lambda x: keys.partition_for(F.lit("DEFAULT"), x, nodes), names) == want
    assert values(spark, lambda x: keys.java_hash(keys.queue_id(F.lit("DEFAULT"), x)), ["example.com"]) == [2127384031]


def test_filters_and_dates(spark):
    assert values(spark, lambda x: keys.url_filter(x, "b_", True), ["aB_", "ab", "b_"]) == [True, False, True]
    assert values(spark, lambda x: keys.url_filter(x, " "), ["a"]) == [True]
    assert values(spark, lambda x: keys.ack_id(x, F.lit("u")), ["", None, "i"]) == ["u", "u", "i"]
    assert values(spark, lambda x: keys.shown_date(x.cast("long"), "Europe/Paris"), ["0"]) == ["1970-01-01T01:00:00"]
    assert [r.node for r in list_nodes(spark, ["b", "a"]).collect()] == ["a", "b"]
