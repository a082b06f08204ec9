"""What is asked of every node: results against a loop over rows, and the owner worked out once a queue."""

import pytest
from pyspark.sql import functions as F

from crawlsched.functions import keys
from crawlsched.operators import inspect
from crawlsched.plans import registry
from crawlsched.schema import LEASES, QUEUES, URLS
from tests.test_keys import java

SF, NOW, NODES = "/root/testdata/sf0.001", 1000, 3
NAMES = [f"h{i}.org" for i in range(40)] + ["", "aé_x", "\U0001f600.org", "polygenelubricants"]


def owner(crawl, key):
    h = java(crawl.replace("_", "%5F") + "_" + key.replace("_", "%5F"))
    return abs(h) % NODES


@pytest.fixture(scope="module")
def crawl(spark):
    """Queues without URLs or crawl, completed and scheduled URLs, leases that hold and that don't."""
    queues = [(c, k, NOW if i % 7 == 0 else -1, -1, 0, 0, i) for c in ("a_b", "c") for i, k in enumerate(NAMES)] + [(None, "x", -1, -1, 0, 0, 99), ("c", None, -1, -1, 0, 0, 98)]
    urls = [(q[0], q[1], f"u{n}", {}, n * 5, 1) for i, q in enumerate(queues) for n in range(i % 4)]
    leases = [(c, k, u, NOW + (1 if i % 3 else 0)) for i, (c, k, u, _, refetch, _) in enumerate(urls) if refetch]
    return [spark.createDataFrame(rows, schema) for rows, schema in ((urls, URLS), (queues, QUEUES), (leases, LEASES))]


def test_stats_by_node(crawl):
    urls, queues, leases = (df.collect() for df in crawl)
    want = {}
    for q in queues:
        if q.crawl_id is None or q.key is None:
            continue
        own = [u for u in urls if (u.crawl_id, u.key) == (q.crawl_id, q.key)]
        active = sum(u.refetch != 0 for u in own)
        busy = sum((r.crawl_id, r.key) == (q.crawl_id, q.key) and r.held_until > NOW for r in leases)
        row = want.setdefault((owner(q.crawl_id, q.key), q.crawl_id), [0] * 5)
        for i, n in enumerate((active, busy, 1, len(own) - active, int(active > 0 or busy > 0))):
            row[i] += n
    parts = inspect.stats_by_node(*crawl, NOW, NODES)
    assert {(r.node, r.crawl_id): list(r[2:]) for r in parts.collect()} == want
    assert {n for n, _ in want} == set(range(NODES))
    merged = {c: [sum(x) for x in zip(*(v for (_, d), v in want.items() if d == c), strict=True)] for c in ("a_b", "c")}
    assert {r.crawl_id: list(r[1:]) for r in inspect.merge_stats(parts).collect()} == merged


def test_pages_by_node(crawl):
    urls, queues, _ = crawl
    scheduled = {(u.crawl_id, u.key) for u in urls.collect() if u.refetch != 0}
    found = sorted(q.key for q in queues.collect() if q.crawl_id == "c" and q.key and q.blocked_until < NOW and ("c", q.key) in scheduled)
    pages = inspect.pages_by_node(inspect.select_queues(queues, urls, NOW, "c"), NODES, 3).collect()
    want = {n: [k for k in found if owner("c", k) == n][:3] for n in range(NODES)}
    assert {n: sorted(r.key for r in pages if r.node == n) for n in range(NODES)} == want and max(map(len, want.values())) == 3


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    return plan(df).count("Relation [")


@pytest.mark.parametrize(("name", "like"), [("stats_merged_over_nodes", "stats_by_crawl"), ("list_queues_merged_over_nodes", "list_queues_active")])
def test_nodes_share_one_pass(spark, name, like):
    """As many tables read as without nodes, and no filter, which would be run for every URL, works out an owner."""
    df = registry.QUERIES[name](spark, SF)
    assert scans(df) == scans(registry.QUERIES[like](spark, SF)) > 0
    assert not [line for line in plan(df).splitlines() if "Filter" in line and "%5F" in line]


def test_a_filter_works_the_hash_out_once(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "x string")
    found = names.filter(keys.java_hash(F.col("x")) % 2 == 0)
    assert sorted(r.x for r in found.collect()) == sorted(n for n in NAMES if java(n) % 2 == 0)
    # One fold for plain text, one for other text.
    assert plan(found).count("aggregate(split(") == 2


def test_hash_of_plain_and_other_text(spark):
    texts = NAMES + ["\x00", "\x7f", "\x80", "é", "￿", "a\U0010ffffb", "z" * 300, "polygenelubricants\U0001f600"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i long, x string")
    got = [r.h for r in df.select("i", keys.java_hash(F.col("x")).alias("h")).orderBy("i").collect()]
    assert got == [java(t) for t in texts] + [None]
