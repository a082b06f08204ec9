"""Exact top-k inner products by a three-phase uniform threshold.

The lists are slices of the dimensions: a vector's score is the sum of its partial scores over SLICES slices.
Phase 1 gathers, for each query, the k highest entries of each slice's list over one lot of the vectors, and their scores. The k-th
highest of these is a cutoff t that is safe, as the k-th highest of all vectors is no lower; so a lot does, and the
rest is not multiplied out twice. Phase 2 sends t to all vectors and collects the entries where some slice's partial score, less
its least possible value, is at least an equal share of t less all of these; no vector that reaches t can lack such an
entry. Least values come from Cauchy's bound with the largest norm of a block's slice; a block whose bounds all lie
below t is skipped. Phase 3 adds up the scores of the collected entries exactly. Each task keeps the k best of a query, and the
k-th of them raises its cutoff from block to block.

Queries are sent in batches of at most BATCH_BYTES, one after the other, and all vectors stream by once a batch; vectors are
kept in the narrowest whole numbers that hold them.

Defined cases: null vectors, null or non-finite components and null identifiers take no part; shorter vectors are
filled up with zeros; a query repeated under one identifier is answered once (by the smallest vector after rounding), a vector
repeated under one identifier is found as often as it stands; ties go to the smaller identifier; fewer rows than k give all;
other columns play no part. Components are floor(256 x) in 64 bits; products are exact while sums stay below 2**63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlsched.llm.shared import Scratch

SLICES = 4
QUERY_ROWS = 1024
BLOCK_ROWS = 2048
LOTS = 8
BATCH_BYTES = 64 << 20
BLOCK = "name string, lot int, n int, dims int, kind string, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def valid(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of valid vectors, filled up with zeros."""
    sizes = np.asarray(vectors.value_lengths())
    flat = np.floor(np.asarray(vectors.flatten()).astype(np.float64) * 256).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def narrow(v: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if v.min(initial=0) >= np.iinfo(kind).min and v.max(initial=0) <= np.iinfo(kind).max:
            return v.astype(kind)
    return v


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors; ``name`` tells the partition they were dealt to."""

    def make(batches):
        from pyspark import TaskContext

        p, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                ids, v = np.asarray(b.column(0).slice(lo, rows)), narrow(quantised(b.column(1).slice(lo, rows)))
                yield pa.RecordBatch.from_pylist([{"name": f"{p}-{k}", "lot": (p + k) % LOTS, "n": len(ids), "dims": v.shape[1], "kind": v.dtype.str, "ids": ids.tobytes(), "vectors": v.tobytes()}], schema)
                k += 1

    schema = pa.schema([("name", pa.string()), ("lot", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())])
    return df.mapInArrow(make, BLOCK)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["dims"])


class Best:
    """The k best (score, vec_id) of each query of a block, fed with batches of entries."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.q, self.v, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, -(2**63), np.int64)  # the k-th score so far

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        if not len(q):
            return
        q, v, s = np.concatenate((self.q, q)), np.concatenate((self.v, v)), np.concatenate((self.s, s))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        own = nth < self.k
        self.floor[q[nth == self.k - 1]] = s[nth == self.k - 1]
        self.q, self.v, self.s = q[own], v[own], s[own]


def partial_scores(q: np.ndarray, v: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each slice: partial scores (queries x vectors), norms of the queries, largest norm of the vectors."""
    dims = max(1, q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, v))
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * dims
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64  # exact in each
    q, v = q.astype(kind), v.astype(kind)
    cuts = np.linspace(0, dims, SLICES + 1).astype(int)
    slices = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    norm = lambda x: np.stack([np.sqrt((x[:, s].astype(np.float64) ** 2).sum(1)) for s in slices])
    return [q[:, s] @ v[:, s].T for s in slices], norm(q), norm(v).max(1, initial=0.0)


def gathered(parts: list[np.ndarray], qid: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: query, vector and score of the k highest entries of each slice's list."""
    n, hits = min(k + 1, len(vid)), set()
    for p in parts:  # one more, as a query's own row may be among them
        at = np.argpartition(-p, n - 1, axis=1)[:, :n]
        hits.add((np.arange(len(qid))[:, None] * len(vid) + at).tobytes())
    both = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in hits]))
    i, j = both // len(vid), both % len(vid)
    i, j = i[vid[j] != qid[i]], j[vid[j] != qid[i]]
    return i, j, sum(p[i, j].astype(np.int64) for p in parts)


def sufficient(parts: list[np.ndarray], least: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: entries where some slice has its share of the cutoff. ``least``: what each slice may have at least."""
    share = (cut.astype(np.float64) - least.sum(0)) / SLICES
    hit = np.zeros(parts[0].shape, bool)
    for p, low in zip(parts, least, strict=True):
        hit |= p >= (low + share - 1e-6 * (1 + np.abs(low) + np.abs(share)))[:, None]
    return np.nonzero(hit)


def topk(vectors: DataFrame, k: int, query_every: int, vec_id: str = "vec_id", embedding: str = "embedding", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose identifier ``query_every`` divides."""
    spark, keep = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    t = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null").filter(valid(F.col("embedding")))
    rounded = F.transform("embedding", lambda x: F.floor(x * 256))
    asked = t.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min(rounded).alias("v"))
    asked = keep.keep(asked.select("vec_id", F.transform("v", lambda x: x / F.lit(256.0)).alias("embedding")), "asked")
    n, dims = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    batches = -(-n * max(dims, 1) * 8 // batch_bytes)
    queries = keep.keep(blocks(asked.repartition(batches, "vec_id"), QUERY_ROWS).withColumn("batch", F.substring_index("name", "-", 1).cast("int")), "queries")
    vb = keep.keep(blocks(t, BLOCK_ROWS), "blocks")
    found = [_batch(keep, vb, queries.filter(F.col("batch") == b).drop("batch"), k, b) for b in range(batches)]
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _batch(keep: Scratch, vb: DataFrame, queries: DataFrame, k: int, number: int) -> DataFrame:
    """The best entries that tasks found for one batch of queries, written."""
    context = vb.sparkSession.sparkContext
    # Bounded by the size of a batch, as is what phase 1 returns to the driver: a number for each query of it.
    sent = context.broadcast([unpacked(r.asDict()) for r in queries.collect()])

    def stream(rows, cutoffs: dict[int, int] | None):
        best = [Best(len(ids), k) for ids, _ in sent.value]
        start = [np.array([-(2**63) if cutoffs is None else cutoffs.get(int(i), -(2**63)) for i in ids], np.int64) for ids, _ in sent.value]
        for b in rows:
            for row in b.to_pylist():
                vid, v = unpacked(row)
                for (qid, q), own, t in zip(sent.value, best, start, strict=True):
                    if cutoffs is None:
                        i, j, s = gathered(partial_scores(q, v)[0], qid, vid, k)
                    else:
                        cut = np.maximum(t, own.floor)
                        parts, far, near = partial_scores(q, v)
                        bound = far * near[:, None]
                        if not (bound.sum(0) * (1 + 1e-9) >= cut).any():
                            continue
                        i, j = sufficient(parts, -bound, cut)
                        s = sum(p[i, j].astype(np.int64) for p in parts)
                        ok = (s >= cut[i]) & (vid[j] != qid[i])
                        i, j, s = i[ok], j[ok], s[ok]
                    own.add(i, vid[j], s)
        for (qid, _), own in zip(sent.value, best, strict=True):
            if len(own.q):
                yield pa.RecordBatch.from_arrays([pa.array(qid[own.q]), pa.array(own.v), pa.array(own.s)], names=["query_id", "vec_id", "score"])

    lists = vb.filter("lot = 0").mapInArrow(lambda rows: stream(rows, None), FOUND)
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoffs = {r.query_id: r.score for r in lists.withColumn("n", F.row_number().over(nth)).filter(F.col("n") == k).collect()}
    safe = context.broadcast(cutoffs)
    return keep.keep(vb.mapInArrow(lambda rows: stream(rows, safe.value), FOUND), f"found-{number}", 64)
