"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source are dealt into shards of about SHARD_WORDS words, or 1 / MOST_SHARDS of all if that is more; a shard
is a stream of its documents in a seeded order, cut into blocks of equally many words. Blocks are apportioned to the sources, and each source's blocks to its shards, by the highest
quotients size / (2 * seats + 1), so quotas are whole numbers that add up. A shard with n blocks and quota q takes
every block q // n times and q % n blocks once more: a run of blocks from a seeded start. As the order is a seeded
shuffle, the run is a random sample of documents, and all but the two at its ends stay whole; blocks drawn one by one would
cut nearly every document.

A row for each source and at most 2 * MOST_SHARDS for shards come to the driver, whatever the number of documents.

Defined cases: null text has size 0; a null source is a source of its own and the last; documents of size 0 take 0;
an empty table gives an empty result; repeated rows count as often as they stand; rows of one identifier and size are
ordered by their text, so reruns agree; other columns play no part, and kept ones keep their values whatever their names.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlsched.llm.shared import SPACE, WORD, Scratch

BLOCK_WORDS = 8
SHARD_WORDS = 65536
MOST_SHARDS = 1 << 18
BROADCAST_ROWS = 1 << 19
SEED = 17


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is over goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1), ties to the earlier; ``most`` bounds each. The bulk comes
    from a divisor found by bisection, only the rest is dealt one by one."""
    most = most or [seats] * len(votes)
    given = lambda d: [min(m, int((v / d + 1) / 2)) if v > 0 else 0 for v, m in zip(votes, most, strict=True)]
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    if seats <= 0 or not any(v > 0 for v in votes):
        return [0] * len(votes)
    low, high = min(v for v in votes if v > 0) / (4 * seats + 4), 2 * max(votes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(given(mid)) > seats else (low, mid)
    out = given(high * (1 + 1e-12))
    queue = [(-v / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, out, most, strict=True)) if v > 0 and s < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, size, source_size, target, taken, and for ``materialise``: copies (whole takings), part_from and
    part_to (words of one more, partial taking), kept columns as struct ``row``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(source).isNull().alias("s_null"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"), *([F.struct(*keep).alias("row")] if keep else []))
    bits = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(MOST_SHARDS)).cast("int")
    d = d.withColumn("bucket", bits)
    fine = scratch.keep(d.groupBy("s_null", "s", "bucket").agg(F.sum("size").alias("words")), "fine")
    by = {(r.s_null, r.s.encode()): r.words for r in fine.groupBy("s_null", "s").agg(F.sum("words").alias("words")).collect()}
    names = sorted(by)
    sizes = [by[k] for k in names]
    shard_words = max(SHARD_WORDS, sum(sizes) // MOST_SHARDS)
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(sizes), most)
    blocks = lambda n: -(-n // BLOCK_WORDS)
    cut = {k: 2 ** max(0, min(MOST_SHARDS.bit_length() - 1, math.ceil(math.log2(max(1, n / shard_words))))) for k, n in zip(names, sizes, strict=True)}
    per = spark.createDataFrame([(bool(k[0]), k[1].decode(), cut[k]) for k in names], "s_null boolean, s string, per int")
    per = F.broadcast(per) if len(names) <= BROADCAST_ROWS else per
    shards = {k: [0] * cut[k] for k in names}
    for r in fine.join(per, ["s_null", "s"]).groupBy("s_null", "s", F.pmod("bucket", "per").alias("shard")).agg(F.sum("words").alias("words")).collect():
        shards[r.s_null, r.s.encode()][r.shard] = r.words
    quotas = sainte_lague(want, round(sum(want) / BLOCK_WORDS), [most * sum(map(blocks, shards[k])) for k in names])
    rows = []
    for k, n, t, q in zip(names, sizes, want, quotas, strict=True):
        own = shards[k]
        for i, (words, quota) in enumerate(zip(own, sainte_lague([float(x) for x in own], q, [most * blocks(x) for x in own]), strict=True)):
            have = max(1, blocks(words))
            rows.append((bool(k[0]), k[1].decode(), len(own), i, n, float(t), quota // have, quota % have, have, words))
    plan = spark.createDataFrame(rows, "s_null boolean, s string, per int, shard int, source_size long, target double, each int, more long, blocks long, words long")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan  # else joined by a shuffle; shards are small
    d = d.join(per, ["s_null", "s"]).withColumn("shard", F.pmod("bucket", F.col("per"))).drop("per")
    order = Window.partitionBy("s_null", "s", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "size", "tie")
    d = d.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    d = d.join(plan, ["s_null", "s", "shard"])
    first = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("s"), F.col("shard")), F.col("blocks"))
    d = d.withColumn("w0", first * BLOCK_WORDS).withColumn("w1", (F.col("w0") + F.col("more") * BLOCK_WORDS))
    ring = F.col("blocks") * BLOCK_WORDS
    # The run [w0, w1) may pass the end of the ring and go on at 0.
    a0, a1 = F.greatest("begin", "w0"), F.least("end", "w1")
    b1 = F.least(F.col("end"), F.col("w1") - ring)
    d = d.withColumn("a", F.greatest(F.lit(0), a1 - a0)).withColumn("b", F.greatest(F.lit(0), b1 - F.col("begin")))
    d = d.withColumn("part_from", F.when(F.col("a") > 0, a0 - F.col("begin")).otherwise(F.lit(0))).withColumn("part", F.col("a") + F.col("b"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("each") * F.col("size") + F.col("part")).alias("taken"), F.col("each").alias("copies"), "part_from", F.col("a").alias("part_a"), F.col("b").alias("part_b"), *(["row"] if keep else []))


def materialise(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix: the kept columns, once for each whole taking, and once with the words of a partial one
    (words joined by a space; at most two documents of a shard are cut)."""
    cols = mixed.schema["row"].dataType.names
    full = (F.col("part_a") + F.col("part_b") >= F.col("size")) & (F.col("size") > 0)
    m = mixed.withColumn("times", F.col("copies") + full.cast("int"))
    whole = m.filter("times > 0").select(F.explode(F.sequence(F.lit(1), "times")).alias("_n"), "row").select("row.*")
    words = F.filter(F.split(F.col(f"row.{text}"), SPACE), lambda w: w != "")
    piece = F.array_join(F.concat(F.slice(words, (F.col("part_from") + 1).cast("int"), F.col("part_a").cast("int")), F.slice(words, 1, F.col("part_b").cast("int"))), " ")
    cut = m.filter(~full & (F.col("part_a") + F.col("part_b") > 0)).select("row", piece.alias("_piece"))
    cut = cut.select(*[(F.col("_piece") if c == text else F.length("_piece").cast("long") if c == "n_chars" else F.col(f"row.{c}")).alias(c) for c in cols])
    return whole.unionByName(cut)
