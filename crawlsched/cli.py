"""Command line over a stored crawl state: ``crawlsched --store PATH COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from contextlib import nullcontext

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crawlsched import config
from crawlsched.frontier import Frontier
from crawlsched.operators import ingest
from crawlsched.operators.inspect import NotFound, crawl_name
from crawlsched.operators.serve import Get
from crawlsched.sources import dump, puts


def truth(text: str) -> bool:
    return text.strip().lower() == "true"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crawlsched", description="Crawl scheduling on Spark.")
    top.add_argument("--store", help="folder of the crawl state")
    top.add_argument("--config", help="file of settings: store.path, store.shards, store.purge, store.check, nodes")
    cmd = top.add_subparsers(dest="command", required=True)

    def add(name, text, *options):
        p = cmd.add_parser(name, help=text)
        for names, kw in options:
            p.add_argument(*names, **kw)

    key = (("-k", "--key"), {"default": "", "help": "queue"})
    crawl = (("-c", "--crawl"), {"default": "", "help": "crawl; empty is the default one"})
    out = (("-o", "--out"), {"help": "file to write to"})
    start = (("-s", "--start"), {"type": int, "default": 0})
    size = (("-n", "--number"), {"type": int, "default": 100})
    wanted = (("-f", "--filter"), {"default": "", "help": "string that URLs contain"})
    fold = (("-i", "--ignore-case"), {"action": "store_true"})
    show = (("-p", "--parse"), {"action": "store_true", "help": "show dates as local time"})
    need = lambda x: (x[0], x[1] | {"required": True})

    add("nodes", "sorted node names")
    add("list-queues", "all queues of a crawl, page by page", size, start, out, (("-i", "--inactive"), {"action": "store_true"}), crawl)
    add("list-crawls", "crawls that have a queue")
    add("list-urls", "a page of URLs", size, start, key, out, crawl, (("-j", "--json"), {"action": "store_true"}), show, wanted, fold)
    add("stats", "counters of a crawl or queue", key, (("-c", "--crawl"), {"default": None}))
    add("put", "ingest a file of URLs or JSON items", need((("-f", "--file"), {})), crawl)
    add("get", "hand out due URLs", key, (("-d", "--delay"), {"type": int, "default": 0}), (("-m", "--max-urls"), {"type": int, "default": 1}), (("-q", "--max-queues"), {"type": int, "default": 1}), (("-c", "--crawl"), {"default": None, "help": "none: any crawl"}))
    add("set-active", "switch serving on or off", (("state",), {"type": truth}))
    add("get-active", "whether serving is on")
    add("delete-queue", "delete a queue", need(key), crawl)
    add("delete-crawl", "delete a crawl", need(crawl))
    add("log-level", "set the level of a logger", (("-p", "--package"), {"default": "crawlsched"}), (("-l", "--level"), {"default": "DEBUG"}))
    add("limit", "limit a queue's completed URLs; 0 clears", need(key), crawl, (("-l", "--limit"), {"type": int, "default": 0}))
    add("status", "what is known of a URL", crawl, key, need((("-u", "--url"), {})), show)
    add("count", "number of URLs", key, crawl, wanted, fold)
    add("purge", "delete URLs created more than some days ago", key, crawl, need((("-d", "--days"), {"type": int})))
    add("dump", "write all URLs as JSON lines", need(out), (("-c", "--crawl"), {"default": None}), (("-z", "--gzip"), {"action": "store_true"}))
    add("delay", "set a queue's delay, or the default without a key", key, crawl, (("-d", "--delay"), {"type": int, "required": True}))
    add("block", "block a queue until a time; 0 unblocks", need(key), crawl, (("-u", "--until"), {"type": int, "default": 0}))
    return top


SHOWN = 20


def write(rows, path: str | None) -> None:
    """Lines to a file or to standard output, as they come."""
    with open(path, "w", encoding="utf-8") if path else nullcontext(sys.stdout) as f:
        f.writelines(f"{r}\n" for r in rows)


def run(a: argparse.Namespace, f: Frontier) -> int:
    c = a.command
    if c == "nodes":
        write(f.list_nodes(), None)
    elif c == "list-queues":
        # All pages in one sorted plan, a partition at a time.
        write((r.key for r in f.list_queues(a.crawl, a.start, 2**31 - 1 - a.start, a.inactive).toLocalIterator()), a.out)
    elif c == "list-crawls":
        write(sorted(r.crawl_id for r in f.list_crawls().collect()), None)
    elif c == "list-urls":
        rows = f.list_urls(a.crawl, a.key, a.start, a.number, a.filter, a.ignore_case)
        lines = dump.json_lines(rows, pretty=True) if a.json else dump.listing(rows, a.parse)
        write((r.value for r in lines.toLocalIterator()), a.out)
    elif c == "stats":
        write((json.dumps(r.asDict()) for r in f.stats(a.crawl, a.key).collect()), None)
    elif c == "put":
        began, items = time.time(), puts.read_puts(f.spark, a.file, a.crawl)
        bad = puts.invalid_lines(f.spark, a.file)
        for r in bad.limit(SHOWN).collect():
            print(f"Invalid input line {r.seq}", file=sys.stderr)
        if (n := bad.count()) > SHOWN:
            print(f"Invalid input lines: {n} in all", file=sys.stderr)
        by = {(r.kind, r.status): r.n for r in ingest.summary(f.put_urls(items)).collect()}
        n = sum(by.values())
        count = lambda s: sum(v for k, v in by.items() if k[1] == s)
        write([f"acked {n}, ok {count('OK')}, skipped {count('SKIPPED')}, {n * 1000 // max(1, int(1000 * (time.time() - began)))} a second"], None)
    elif c == "get":
        if a.key and a.crawl is None:
            print("a key needs a crawl", file=sys.stderr)
        sent = f.get_urls(Get(a.max_urls, a.max_queues, a.delay, a.crawl, a.key))
        write((r.value for r in sent.select(F.to_json(F.struct("url", "key", "crawl_id", "metadata")).alias("value")).toLocalIterator()), None)
    elif c == "set-active":
        f.set_active(a.state)
    elif c == "get-active":
        write([str(f.get_active()).lower()], None)
    elif c == "delete-queue":
        write([f.delete_queue(a.key, a.crawl)], None)
    elif c == "delete-crawl":
        write([f.delete_crawl(a.crawl)], None)
    elif c == "log-level":
        f.set_log_level(a.level, a.package)
    elif c == "limit":
        f.set_crawl_limit(a.limit, a.key, a.crawl)
    elif c == "status":
        row = f.url_status(a.url, a.key, a.crawl)
        if a.parse:
            row["refetch"] = time.strftime("%Y-%m-%dT%H:%M:%S", time.localtime(row["refetch"]))
        write([json.dumps(row)], None)
    elif c == "count":
        write([f.count_urls(a.crawl, a.key, a.filter, a.ignore_case)], None)
    elif c == "purge":
        write([f.purge_urls(a.crawl, a.days, a.key)], None)
    elif c == "dump":
        urls = f.store.urls(f.store.load())
        dump.dump(urls, a.out, None if a.crawl is None else crawl_name(a.crawl), a.gzip)
    elif c == "delay":
        f.set_delay(a.delay, a.key, a.crawl)
    elif c == "block":
        f.block_queue_until(a.key, a.crawl, a.until)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    settings = {}
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            settings = config.parse_lines(f)
    path = a.store or config.string(settings, "store.path", "./crawl-state")
    spark = spark or SparkSession.builder.appName("crawlsched").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    f = Frontier(spark, path, config.integer(settings, "store.shards", 64), purge=config.flag(settings, "store.purge"), check=config.flag(settings, "store.check"), bloom=not config.flag(settings, "store.bloom.disable"))
    if config.flag(settings, "store.stats"):
        write((json.dumps(r.asDict()) for r in f.statistics().collect()), None)  # a row for each shard
    if nodes := config.string(settings, "nodes"):
        if sorted(n.strip() for n in nodes.split(",")) != f.list_nodes():
            f.set_nodes([n.strip() for n in nodes.split(",")])
    try:
        return run(a, f)
    except (NotFound, ValueError) as e:
        print(f"{a.command}: {type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
