"""The stored scheduler: ingest, serving with leases and rotation, control, deletion, dump and streams."""

import json
import random

import pytest

from crawlsched import cli, config
from crawlsched.frontier import Frontier
from crawlsched.operators import ingest, inspect, serve
from crawlsched.operators.inspect import NotFound
from crawlsched.operators.serve import Get
from crawlsched.schema import BATCHES, LEASES, PUTS, QUEUES, URLS
from crawlsched.sources import dump, puts
from crawlsched.sources.store import Conflict, Store
from crawlsched.streaming import ingest as stream
from crawlsched.streaming.rates import ack_rate

NOW = 1_700_000_000


def items(spark, rows):
    """Put items from (kind, crawl, key, url, refetch)."""
    return spark.createDataFrame([(i, "", k, c, q, u, {"n": [str(i)]}, r) for i, (k, c, q, u, r) in enumerate(rows)], PUTS)


FIXTURE = [
    ("discovered", "crawl_id", "queue_mysite", "https://www.mysite.com/discovered", None),
    ("discovered", "crawl_id", "queue_mysite", "https://www.mysite.com/completed", None),
    ("known", "crawl_id", "queue_mysite", "https://www.mysite.com/completed", 0),
    ("known", "crawl_id", "queue_mysite", "https://www.mysite.com/knowntorefetch", NOW + 3600),
    ("known", "crawl_id", "another_queue", "https://www.mysite.com/secondqueue", NOW + 3600),
    ("known", "crawl_id", "delete_queue", "https://www.delete.me/tobedeleted", NOW + 3600),
]


@pytest.fixture
def frontier(spark, tmp_path):
    return Frontier(spark, str(tmp_path / "state"), shards=4)


@pytest.fixture
def filled(spark, frontier):
    frontier.put_urls(items(spark, FIXTURE), NOW)
    return frontier


def statuses(acks):
    return [r.status for r in acks.orderBy("seq").collect()]


def served(df):
    return [r.url for r in df.orderBy("crawl_id", "key", "rank").collect()]


def test_fixture(spark, filled):
    assert filled.list_urls("crawl_id").count() == 5
    assert filled.list_urls("crawl_id", "another_queue").count() == 1
    assert filled.list_urls("crawl_id", start=3, size=10).count() == 2
    assert filled.list_urls("crawl_id", wanted="COMPLETED", ignore_case=True).count() == 1
    assert filled.list_urls("crawl_id", wanted="COMPLETED").count() == 0
    assert filled.count_urls("crawl_id", "queue_mysite") == 3
    done = filled.url_status("https://www.mysite.com/completed", "queue_mysite", "crawl_id")
    assert done["refetch"] == 0 and done["metadata"] == {} and done["creation_date"] == NOW
    with pytest.raises(NotFound):
        filled.url_status("https://www.mysite.com/unknown", "queue_mysite", "crawl_id")
    with pytest.raises(ValueError):
        filled.url_status("http://", crawl_id="crawl_id")
    again = filled.put_urls(items(spark, [FIXTURE[1], ("discovered", *FIXTURE[3][1:4], None), ("known", *FIXTURE[3][1:4], 2943003600)]), NOW + 5)
    assert statuses(again) == ["SKIPPED", "SKIPPED", "OK"]
    row = filled.url_status("https://www.mysite.com/knowntorefetch", "queue_mysite", "crawl_id")
    assert (row["refetch"], row["creation_date"]) == (2943003600, NOW)
    filled.delete_urls(spark.createDataFrame([("crawl_id", "delete_queue", "https://www.delete.me/tobedeleted"), ("x", "y", "z")], "crawl_id string, key string, url string"))
    assert filled.count_urls("crawl_id") == 4
    assert filled.stats("crawl_id", now=NOW).first().number_of_queues == 3


def test_order_and_leases(spark, frontier):
    at = {"a": -100, "b": 300, "c": -50, "d": 400, "e": 100}
    frontier.put_urls(items(spark, [("known", "", "q", f"https://www.mysite.com/{k}", NOW + d) for k, d in at.items()]), NOW - 1000)
    assert served(frontier.get_urls(Get(10), NOW - 200)) == []
    assert [u[-1] for u in served(frontier.get_urls(Get(10), NOW))] == ["a", "c"]
    assert frontier.stats("", now=NOW).first().in_process == 2
    assert frontier.stats("", now=NOW + 30).first().in_process == 0
    assert [u[-1] for u in served(frontier.get_urls(Get(2), NOW + 1000))] == ["a", "c"]


def test_held_urls_are_passed_over(spark):
    urls = spark.createDataFrame([("c", "q", f"url-{i}", {}, NOW - 100 + 10 * i, 0) for i in range(10)], URLS)
    queues = spark.createDataFrame([("c", "q", -1, -1, 0, 0, 0)], QUEUES)
    held = spark.createDataFrame([("c", "q", f"url-{i}", NOW + 60) for i in range(3)], LEASES)
    none = spark.createDataFrame([], LEASES)
    assert served(serve.due(urls, queues, none, NOW, Get(3))) == ["url-0", "url-1", "url-2"]
    assert served(serve.due(urls, queues, held, NOW, Get(4))) == ["url-3", "url-4", "url-5", "url-6"]
    assert served(serve.due(urls, queues, held, NOW, Get(3))) == []  # as many leased as may be
    assert served(serve.due(urls, queues, held, NOW, Get())) == [f"url-{i}" for i in range(3, 10)]


@pytest.mark.parametrize(
    ("queue", "now", "closed"),
    [
        ((-1, 5, 100, 0), 105, "delay"), ((-1, 5, 100, 0), 106, None), ((150, -1, 0, 0), 100, "blocked"), ((100, -1, 0, 0), 100, "blocked"),
        ((99, -1, 0, 0), 100, None), ((-1, -1, 0, 1), 100, "limit"), ((-1, -1, 0, 0), 100, None), ((-1, -1, 99, 0), 100, "delay"), ((-1, 0, 99, 0), 100, None),
    ],
)
def test_gate_boundaries(spark, queue, now, closed):
    q = spark.createDataFrame([("c", "q", *queue, 0)], QUEUES)
    urls = spark.createDataFrame([("c", "q", "done", {}, 0, 0), ("c", "q", "u", {}, 50, 0)], URLS)
    assert serve.gate(q, urls, spark.createDataFrame([], LEASES), now, Get(1)).first().closed == closed


def test_batches(spark, frontier):
    def put(*batches):
        rows = [(i, f"b{i}", [(u, "", "", {}) for u in b]) for i, b in enumerate(batches)]
        return {r.id: r.statuses for r in frontier.put_discovered(spark.createDataFrame(rows, BATCHES), NOW).collect()}

    assert put(["http://a.com/1", "http://b.com/1", "http://a.com/2"]) == {"b0": ["OK"] * 3}
    s = frontier.stats("", now=NOW).first()
    assert (s.number_of_queues, s.size) == (2, 3)
    assert put(["http://a.com/3", "http://a.com/3"], ["http://a.com/3"]) == {"b0": ["OK", "SKIPPED"], "b1": ["SKIPPED"]}
    assert put(["", "http://a.com/4"], []) == {"b0": ["SKIPPED", "OK"], "b1": []}


def test_keys_and_crawls(spark, frontier):
    frontier.put_urls(items(spark, [("discovered", c, "", "http://site.net/", None) for c in ("BESPOKE", "", "DEFAULT", "  ")] + [("discovered", "", "k" * 256, "http://x.y/", None), ("discovered", "", None, None, None)]), NOW)
    by = {r.crawl_id: (r.size, r.number_of_queues) for r in frontier.stats(now=NOW).collect()}
    assert by == {"BESPOKE": (1, 1), "DEFAULT": (1, 1)}
    assert sorted(r.crawl_id for r in frontier.list_crawls().collect()) == ["BESPOKE", "DEFAULT"]


def test_rotation(spark, frontier):
    frontier.put_urls(items(spark, [("discovered", "", q, f"http://{q}/{i}", None) for q in "abc" for i in range(3)]), NOW - 10)
    order = lambda: [r.key for r in frontier.queue_table().orderBy("rotation_pos").collect()]
    first = order()
    frontier.get_urls(Get(1), NOW)
    assert order() == first[1:] + first[:1]
    got = frontier.get_urls(Get(2, max_queues=1), NOW + 10)
    assert {r.key for r in got.collect()} == {first[1]} and order() == [first[2], first[0], first[1]]
    frontier.get_urls(Get(5, crawl_id="", key=first[0]), NOW + 20)
    assert order() == [first[2], first[0], first[1]]


def test_control(spark, filled):
    assert filled.get_active()
    filled.set_active(False)
    assert served(filled.get_urls(Get(), NOW + 9999)) == []
    filled.set_active(True)
    assert served(filled.get_urls(Get(key="another_queue"), NOW + 9999)) == []  # a key needs a crawl
    filled.block_queue_until("another_queue", "crawl_id", NOW + 9999)
    filled.block_queue_until("unknown", "crawl_id", NOW)
    assert served(filled.get_urls(Get(crawl_id="crawl_id", key="another_queue"), NOW + 9999)) == []
    assert [r.key for r in filled.list_queues("crawl_id", now=NOW).collect()] == ["delete_queue", "queue_mysite"]
    assert filled.list_queues("crawl_id", include_inactive=True, now=NOW).count() == 3
    filled.block_queue_until("another_queue", "crawl_id", 0)
    filled.set_delay(50000)
    assert served(filled.get_urls(Get(), 40000)) == []
    filled.set_delay(0, "another_queue", "crawl_id")
    assert len(served(filled.get_urls(Get(crawl_id="crawl_id", key="another_queue"), NOW + 9999))) == 1
    filled.set_crawl_limit(1, "queue_mysite", "crawl_id")
    filled.set_delay(1)
    assert "queue_mysite" not in {r.key for r in filled.get_urls(Get(), NOW + 9999).collect()}
    with pytest.raises(NotFound):
        filled.set_crawl_limit(1, "unknown", "crawl_id")
    reset = Frontier(spark, filled.store.path, reset_controls=True, check=True)
    assert {(r.blocked_until, r.delay, r.crawl_limit) for r in reset.queue_table().collect()} == {(-1, -1, 0)}


def test_deletion_and_purge(spark, filled):
    filled.put_urls(items(spark, [("discovered", "crawl_id", "queue_mysite", "http://new/", None)]), NOW + 86400 * 3)
    assert filled.purge_urls("crawl_id", 3, now=NOW + 86400 * 3) == 0  # created exactly three days ago
    assert filled.purge_urls("crawl_id", 2, "another_queue", now=NOW + 86400 * 3) == 1
    assert filled.delete_queue("unknown", "crawl_id") == 0
    assert filled.delete_queue("delete_queue", "crawl_id") == 1
    assert filled.delete_queue("queue_mysite", "crawl_id") == 4
    assert [r.key for r in filled.list_queues("crawl_id", include_inactive=True).collect()] == ["another_queue"]
    assert filled.delete_crawl("crawl_id") == 0 and filled.list_crawls().count() == 0
    assert filled.store.vacuum() > 0 and filled.count_urls("crawl_id") == 0
    assert Frontier(spark, filled.store.path, purge=True).count_urls() == 0


def test_known_update_releases_the_lease(spark, filled):
    url = FIXTURE[0][3]
    assert served(filled.get_urls(Get(1), NOW + 10)) == [url]
    assert filled.stats("crawl_id", now=NOW + 11).first().in_process == 1
    filled.put_urls(items(spark, [("known", "crawl_id", "queue_mysite", url, NOW + 50)]), NOW + 11)
    assert filled.stats("crawl_id", now=NOW + 11).first().in_process == 0


def test_commits_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    m = store.load()
    store.commit(m, settings=m.settings | {"active": False})
    with pytest.raises(Conflict):
        store.commit(m)


def test_one_writer_wins(spark, tmp_path):
    """Of writers that start from one version at the same time, one commits."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, str(tmp_path / "s"))
    m = store.load()

    def write(n):
        try:
            return store.commit(m, settings=m.settings | {"default_delay": n}).settings["default_delay"]
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(write, range(8)) if x is not None]
    assert len(won) == 1 and store.load().settings["default_delay"] == won[0]


def test_a_dead_writers_claim_is_taken_over(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store._claim(1)
    with pytest.raises(Conflict):
        store.commit(store.load())
    monkeypatch.setattr("crawlsched.sources.store.CLAIM_SECONDS", -1)
    assert store.commit(store.load()).version == 1


def test_a_change_writes_one_shard(spark, tmp_path, frontier):
    frontier.put_urls(items(spark, [("discovered", "", f"q{i}", f"http://q{i}/{k}", None) for i in range(40) for k in range(3)]), NOW)
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before, old = files(), frontier.store.load()
    frontier.set_delay(7, "q5")
    new = frontier.store.load()
    added = set(files()) - set(before)
    assert len(added) == 1 and all("queues/" in p for p in added) and set(before) <= set(files())
    assert sum(old.tables["queues"][s] != new.tables["queues"][s] for s in new.tables["queues"]) == 1
    assert new.tables["urls"] == old.tables["urls"] and {r.key: r.delay for r in frontier.queue_table().collect()} == {f"q{i}": 7 if i == 5 else -1 for i in range(40)}
    # A put of one item adds one row to one shard of urls, and is read back through the delta.
    frontier.put_urls(items(spark, [("known", "", "q5", "http://q5/0", 0), ("discovered", "", "q5", "http://q5/9", None)]), NOW + 1)
    last = frontier.store.load()
    assert [p[-1][1] for s, p in last.tables["urls"].items() if new.tables["urls"][s] != p] == [2]
    assert frontier.count_urls(key="q5") == 4 and frontier.url_status("http://q5/0", "q5")["refetch"] == 0
    assert frontier.statistics().filter("table = 'urls'").agg({"delta_rows": "sum"}).first()[0] == 2


def test_deltas_equal_whole_rewrites(spark, tmp_path):
    """Random puts, serves, controls and deletions over shards with deltas, against the same calls with none."""
    rng, states = random.Random(8), []
    calls = []
    for n in range(10):
        calls.append(("put", [(rng.choice(["discovered", "known"]), "", f"q{rng.randrange(4)}", f"http://h/{rng.randrange(9)}", rng.choice([0, NOW + 5])) for _ in range(4)]))
        calls.append((rng.choice(["get", "delay", "purge", "delete"]), n))
    for share in (100.0, -1.0):  # never compacted by size, and always
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr("crawlsched.sources.store.DELTA_SHARE", share)
            f = Frontier(spark, str(tmp_path / f"s{share}"), shards=2)
            for n, (what, arg) in enumerate(calls):
                if what == "put":
                    f.put_urls(items(spark, arg), NOW + n)
                elif what == "get":
                    f.get_urls(Get(1, max_queues=2), NOW + 100 + n)
                elif what == "delay":
                    f.set_delay(arg, "q1")
                elif what == "purge":
                    f.purge_urls("", 0, "q2", NOW + n)
                else:
                    f.delete_queue("q3")
            m = f.store.load()
            states.append([sorted(map(str, f.store.read(m, t).drop("metadata").filter("held_until > 0" if t == "leases" else "true").collect())) for t in ("urls", "queues")])
            assert {r.n for r in f.check().collect()} == {0}
            f.reshard(3)
            assert sorted(map(str, f.store.urls(f.store.load()).drop("metadata").collect())) == states[-1][0]
    assert states[0] == states[1] and states[0][0]


def test_new_queues_stand_in_the_order_of_arrival(spark, frontier):
    frontier.put_urls(items(spark, [("discovered", "", k, f"http://{k}/{i}", None) for i in range(2) for k in ("k3", "k0", "k5", "k1", "k4", "k2")]), NOW)
    frontier.put_urls(items(spark, [("discovered", "", k, f"http://{k}/", None) for k in ("k9", "k0", "k7", "k8")]), NOW)
    assert [(r.key, r.rotation_pos) for r in frontier.queue_table().orderBy("rotation_pos").collect()] == [(k, i) for i, k in enumerate(("k3", "k0", "k5", "k1", "k4", "k2", "k9", "k7", "k8"))]


def test_acknowledgements_survive_a_crash(spark, tmp_path, frontier):
    """A stream that dies between the commit and its acknowledgements gives them when it runs again."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("http://a.com/1\nhttp://a.com/2\n")
    first = frontier.put_urls(puts.read_puts(spark, str(tmp_path / "in")), NOW, "stream", 0)  # and then nothing more
    stream.start(frontier, stream.line_stream(spark, str(tmp_path / "in")), str(tmp_path / "ckpt"), str(tmp_path / "acks"), clock=lambda: NOW).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "acks"))
    assert sorted((r.id, r.status) for r in got.collect()) == sorted((r.id, r.status) for r in first.collect()) and got.count() == 2
    assert frontier.count_urls() == 2
    frontier.put_urls(items(spark, [("discovered", "", "", "http://b.com/", None)]), NOW, "other")
    assert frontier.store.vacuum() > 0 and len(list((tmp_path / "state" / "results").iterdir())) == 1  # the last epoch's
    assert frontier.put_urls(items(spark, []), NOW, "stream", 0).count() == 2


def test_metrics(spark, frontier):
    frontier.put_urls(items(spark, [("discovered", "", "q", "http://q/1", None), ("discovered", "", "q", "http://q/1", None), ("known", "", "q", "http://q/2", 0)]), NOW)
    frontier.get_urls(Get(5), NOW + 5)
    got = dict(frontier.metrics)
    assert got.pop("get_seconds") > 0 and got == {"put_calls": 1, "discovered": 1, "ignored": 1, "completed": 1, "get_calls": 1, "get_urls": 1}


def test_fold_equals_replay(spark):
    """Random items with repeated URLs, folded in two calls, against one at a time."""
    rng = random.Random(5)
    rows = [(rng.choice(["discovered", "known"]), rng.choice(["", "x"]), "", f"http://h{rng.randrange(4)}/{rng.randrange(6)}", rng.choice([0, 7, 9])) for _ in range(300)]
    want, state = [], {}
    for n, (kind, crawl, _, url, refetch) in enumerate(rows):
        k, now = (crawl or "DEFAULT", url), 100 if n < 150 else 200
        if kind == "discovered" and k in state:
            want.append("SKIPPED")
            continue
        want.append("OK")
        state[k] = (now if kind == "discovered" else refetch, {} if kind == "known" and not refetch else {"n": [str(n)]}, state.get(k, (0, 0, now))[2])
    all_ = items(spark, rows)
    one = ingest.put(all_.filter("seq < 150"), spark.createDataFrame([], URLS), 100)
    two = ingest.put(all_.filter("seq >= 150"), one.changed, 200)
    assert statuses(one.acks) + statuses(two.acks) == want
    got = {(r.crawl_id, r.url): (r.refetch, r.metadata, r.creation_date) for r in ingest.upsert(one.changed, two.changed).collect()}
    assert got == state


def test_empty_inputs(spark, frontier):
    assert frontier.put_urls(spark.createDataFrame([], PUTS), NOW).count() == 0
    assert frontier.get_urls(Get(), NOW).count() == 0
    assert frontier.stats(now=NOW).count() == 0 and frontier.count_urls() == 0
    assert frontier.delete_crawl("none") == 0
    assert {r.n for r in frontier.check().collect()} == {0}
    assert inspect.list_urls(spark.createDataFrame([], URLS)).count() == 0


def test_dump_round_trip(spark, tmp_path, frontier):
    frontier.put_urls(items(spark, [("discovered", "", "example.com", "http://example.com/discovered", None), ("known", "", "example.com", "http://example.com/done", 0), ("known", "", "example.com", "http://example.com/later", NOW + 3600), ("discovered", "BESPOKE", "bespoke.com", "http://bespoke.com/", None)]), NOW)
    urls = frontier.store.urls(frontier.store.load())
    dump.dump(urls, str(tmp_path / "out"), compress=True)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 4 and all("known" in x for x in lines)
    other = Frontier(spark, str(tmp_path / "other"), shards=2)
    other.put_urls(puts.read_puts(spark, str(tmp_path / "out")), NOW + 1)
    rows = lambda f: sorted((r.crawl_id, r.key, r.url, r.refetch, json.dumps(r.metadata)) for r in f.store.urls(f.store.load()).collect())
    assert rows(other) == rows(frontier)
    dump.dump(urls, str(tmp_path / "one"), crawl_id="BESPOKE")
    assert spark.read.text(str(tmp_path / "one")).count() == 1


def test_gzipped_lines(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt.gz").write_bytes(gzip.compress("http://a.com/1\nhttp://ü.com/\n".encode()))
    (tmp_path / "in" / "b.txt").write_text("http://b.com/\n")
    assert sorted(r.url for r in puts.read_puts(spark, str(tmp_path / "in")).collect()) == ["http://a.com/1", "http://b.com/", "http://ü.com/"]


def test_mixed_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text('  http://a.com/1 \n{"known": {"info": {"url": "http://b.com/", "crawlID": "z"}, "refetchableFromDate": 12}, "ID": "i"}\n{broken\n{}\n{"discovered": {"info": {"url": "u", "metadata": {"k": {"values": ["1", "2"]}}}}}\n')
    rows = puts.read_puts(spark, str(tmp_path / "in.txt"), "mine").orderBy("seq").collect()
    assert [(r.id, r.kind, r.crawl_id, r.url, r.refetch) for r in rows] == [("mine_http://a.com/1", "discovered", "mine", "http://a.com/1", 0), ("i", "known", "z", "http://b.com/", 12), (None, "discovered", None, "u", 0)]
    assert rows[2].metadata == {"k": ["1", "2"]}
    assert puts.invalid_lines(spark, str(tmp_path / "in.txt")).count() == 2


def test_stream(spark, tmp_path, frontier):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("http://a.com/1\nhttp://a.com/2\n")
    go = lambda: stream.start(frontier, stream.line_stream(spark, str(tmp_path / "in")), str(tmp_path / "ckpt"), str(tmp_path / "acks"), clock=lambda: NOW).awaitTermination()
    go()
    (tmp_path / "in" / "2.txt").write_text("http://a.com/2\nhttp://b.com/1\n")
    go()
    assert frontier.count_urls() == 3
    acks = spark.read.parquet(str(tmp_path / "acks"))
    assert {r.status: r["count"] for r in acks.groupBy("status").count().collect()} == {"OK": 3, "SKIPPED": 1}
    assert frontier.put_urls(items(spark, [("discovered", "", "", "http://c.com/", None)]), NOW, "stream", 1).count() == 2  # a replayed batch gives what the first one gave
    assert frontier.put_urls(items(spark, [("discovered", "", "", "http://c.com/", None)]), NOW, "stream", 0).count() == 0
    assert frontier.count_urls() == 3
    assert ack_rate(acks, "1 day").agg({"n": "sum"}).first()[0] == 4


def test_rates_on_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2020-01-01 00:00:30' AS ts, 'known' AS kind, 'OK' AS status UNION ALL SELECT timestamp'2020-01-01 02:00:00', 'known', 'OK'").coalesce(1).write.parquet(str(tmp_path / "acks"))
    live = spark.readStream.schema("ts timestamp, kind string, status string").parquet(str(tmp_path / "acks"))
    q = ack_rate(live).writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r.start), r.n) for r in spark.sql("SELECT * FROM rates").collect()] == [("2020-01-01 00:00:00", 1)]


def test_config():
    c = config.parse_lines(["a = 1", "b=x=y", "bare", "# no", "", "e=", "t = TRUE"])
    assert c == {"a": "1", "b": "x=y", "bare": "", "e": "", "t": "TRUE"}
    assert config.integer(c, "a") == 1 and config.integer(c, "e", 4) == 4 and config.integer(c, "none") is None
    assert config.real(c, "a") == 1.0 and config.string(c, "e", "d") == "d"
    assert config.boolean(c, "t") and not config.boolean(c, "bare") and config.flag(c, "bare") and not config.flag(c, "b")
    with pytest.raises(ValueError):
        config.integer(c, "b")


def test_command_line(spark, tmp_path, capsys):
    store = ["--store", str(tmp_path / "s")]
    (tmp_path / "in.txt").write_text("http://a.com/1\nhttp://a.com/2\n{bad\n")
    run = lambda *a: (cli.main([*store, *a], spark), capsys.readouterr())
    code, out = run("put", "-f", str(tmp_path / "in.txt"))
    assert code == 0 and out.out.startswith("acked 2, ok 2, skipped 0") and "Invalid" in out.err
    assert run("count")[1].out == "2\n"
    assert json.loads(run("get", "-m", "1")[1].out)["url"] == "http://a.com/1"
    assert json.loads(run("stats")[1].out)["in_process"] == 1
    assert run("list-queues")[1].out == "a.com\n" and run("list-crawls")[1].out == "DEFAULT\n"
    assert run("list-urls", "-n", "1")[1].out.startswith("http://a.com/1;")
    assert run("status", "-u", "http://none/")[0] == 1
    assert run("list-queues", "-i")[1].out == "a.com\n" and run("log-level", "-l", "ERROR")[0] == 0
    run("set-active", "false")
    assert run("get-active")[1].out == "false\n" and run("nodes")[1].out == "local\n"
    assert run("limit", "-k", "none", "-l", "3")[0] == 1
    assert run("dump", "-o", str(tmp_path / "d"))[0] == 0 and spark.read.text(str(tmp_path / "d")).count() == 2
    assert run("purge", "-d", "1")[1].out == "0\n"
    assert run("delete-queue", "-k", "a.com")[1].out == "2\n"
