"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles. A shingle weighs its count in the document times an inverse
document frequency, FLOOR + (1 - FLOOR) log(N / df) / log(1 / COMMON), which is 1 for shingles in at most COMMON of all
documents and falls with every document more. The constant part is there as a plain log(N / df) undoes large groups
of near copies: their common shingles would be worth next to nothing, so that nothing but their differences counts.

Consistent weighted sampling draws, with SAMPLES hash functions, one shingle each with probability in proportion to its
weight, equal for two documents with the probability of their weighted Jaccard similarity. BANDS of ROWS samples make
bucket keys. Two documents of a bucket are linked if the weighted Jaccard similarity of their whole shingle multisets
is at least LEAST. First come leaders: the first and the last document of each part of PART in a bucket, and across
parts the first of the bucket. Buckets that are still in several classes go round again with other leaders, until a
round finds no link (at most ROUNDS). That only saves work: in buckets that are open then, every document outside
the bucket's largest class is compared with every document of another class, in blocks of GROUP by GROUP documents
that are dealt out. So each pair that shares a bucket is compared or is of one class already. Classes are the connected
components of the links.

Which shingles are common is exact: pass one adds up counts in a table of BUCKETS cells (a fixed size); a shingle above
COMMON lies in a cell above it; pass two counts just the shingles in such cells. Their number is at most 1 / COMMON
times the mean length of a document, whatever the corpus; only they are sent to all executors.

Equal texts are one node from the start, so groups of copies cost one comparison each. A node is a 64-bit hash of the
text; a second hash shows where different texts share one, and these few get other numbers. Large buckets are
known by their count (at most 2**20 of them, whatever the corpus) and cut into parts of PART, so no bucket is one
task's. Classes and leaders with very many links lie on one side of plain joins, which adaptive execution splits.

Defined cases: a null text is a class of its own; equal texts (empty ones too) are one class; texts of one to four
words have one shingle; texts without words are near no other text; repeated rows are copies; a class is named by its
smallest identifier; a null identifier gets the class of its text, or null if nothing else is in it; other columns
play no part, and keep their values whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsched.llm.shared import Scratch
from crawlsched.llm.textarrays import buffers, mix, runs, spans, trimmed, words

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
COMMON = 0.01
BUCKETS = 1 << 18
PART = 1024
ROUNDS = 3
GROUP = 512
BROADCAST_NODES = 1 << 20
_RNG = np.random.default_rng(1234567)
_ODD = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_R = _RNG.gamma(2.0, 1.0, 1 << 16)
_BETA = _RNG.random(1 << 16)
_FLAT = (_R * (1 - _BETA)).astype(np.float32)
_U24 = np.uint64((1 << 24) - 1)
_MIXERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
FLOOR = 0.6
_HIDDEN = "__neardup_"


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle of each row, by row and hash."""
    h, row = words(*buffers(column))
    n = np.bincount(row, minlength=len(column)) if len(h) else np.zeros(len(column), np.int64)
    short = (n > 0) & (n < WORDS)
    if len(h) >= WORDS:
        s = h[: len(h) - WORDS + 1] * _MIXERS[0]
        for k in range(1, WORDS):
            s = mix(s + h[k : len(h) - WORDS + 1 + k] * _MIXERS[k])
        first = row[: len(s)]
        ok = first == row[WORDS - 1 :]
        s, first = s[ok], first[ok]
    else:
        s, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short.any():
        more, at = [], np.concatenate(([0], np.cumsum(n)))
        for r in np.flatnonzero(short):
            x = np.uint64(n[r])
            for v in h[at[r] : at[r + 1]]:
                x = mix(np.array([x], np.uint64) * _MIXERS[0] + v)[0]
            more.append(x)
        s, first = np.concatenate((s, np.array(more, np.uint64))), np.concatenate((first, np.flatnonzero(short)))
    order = np.lexsort((s, first))
    s, first = s[order], first[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (first[1:] != first[:-1]))) if len(s) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return first[begin], s[begin], np.diff(begin, append=len(s))


def weights(s: np.ndarray, count: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = count.astype(np.float64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        w *= np.where(common[0][at] == s, common[1][at], 1.0)
    return w


def signatures(row: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and for each the smallest ln a of each hash function (ties are equal samples)."""
    begin = runs(row)
    out = np.empty((len(begin), SAMPLES), np.float32)
    odd = np.flatnonzero(w != 1.0)
    stops = np.append(begin, len(s))
    i = 0
    while i < len(begin):  # pieces that stay in the cache
        j = max(i + 1, int(np.searchsorted(stops, stops[i] + (1 << 15), "right")) - 1)
        a, b = stops[i], stops[j]
        part, cuts = s[a:b], begin[i:j] - a
        own = odd[np.searchsorted(odd, a) : np.searchsorted(odd, b)] - a
        lw = np.log(w[a:b][own])
        for k in range(SAMPLES):
            x = mix(part * _ODD[k] + _ADD[k])
            table = (x >> np.uint64(48)).astype(np.int64)
            u = ((x & _U24).astype(np.float32) + 0.5) * np.float32(2**-24)
            v = ((x >> np.uint64(24) & _U24).astype(np.float32) + 0.5) * np.float32(2**-24)
            c = np.log(-np.log(u * v + np.float32(1e-30)))
            a_k = c - _FLAT[table]
            if len(own):
                r, beta = _R[table[own]], _BETA[table[own]]
                t = np.floor(lw / r + beta)
                a_k[own] = (c[own] - r * (t - beta + 1)).astype(np.float32)
            out[i:j, k] = np.minimum.reduceat(a_k, cuts)
        i = j
    return row[begin], out


def keys(signature: np.ndarray) -> np.ndarray:
    bits = signature.view(np.uint32).astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIXERS[1], bits.shape[:2]).copy()
    for r in range(ROWS):
        x = mix(x + bits[:, :, r] * _MIXERS[2])
    return x.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], common) -> float:
    """Weighted Jaccard similarity of two (hash, count)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = weights(*a, common), weights(*b, common)
    both = np.minimum(wa[i], wb[j]).sum()
    return both / (wa.sum() + wb.sum() - both)


def block_links(table: pa.Table, common) -> list[tuple[int, int, float]]:
    """Links between the rows ``side`` 0 and 1 of one block of a bucket that join different classes, found a few
    megabytes of text at a time; some links that join the same two classes again are left out. A pair that shares
    several buckets belongs to the one with the smallest key."""
    one, two = (table.filter(pc.equal(table["side"], s)).combine_chunks() for s in (0, 1))
    out = []
    for i, n in spans([one["text"].chunk(0)], GROUP, 4 << 20) if one.num_rows and two.num_rows else ():
        for j, m in spans([two["text"].chunk(0)], 2 * GROUP, 4 << 20):
            out += _part_links(pa.concat_tables([one.slice(i, n), two.slice(j, m)]), common)
    return out


def _part_links(table: pa.Table, common) -> list[tuple[int, int, float]]:
    table = table.sort_by("side").combine_chunks()
    n = int(np.count_nonzero(np.asarray(table["side"]) == 0))
    node, comp, rest, bucket = (np.asarray(table[c]) for c in ("node", "comp", "rest", "key"))
    comp = np.unique(comp, return_inverse=True)[1]
    if n == 0 or n == len(node):
        return []
    row, s, count = shingles(table["text"].chunk(0))
    cut, w = np.searchsorted(row, np.arange(len(node) + 1)), weights(s, count, common)
    word, size = np.unique(s, return_inverse=True)[1], np.diff(cut)
    heavy = np.add.reduceat(w, cut[:-1])
    lists = table["keys"].chunk(0)
    own, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy())
    own, owner = own[own < bucket[0]], owner[own < bucket[0]]
    held, seen = np.zeros(word.max() + 1), set(zip(own[owner >= n].tolist(), owner[owner >= n].tolist(), strict=True))
    by_key: dict[int, list[int]] = {}
    for k, j in seen:
        by_key.setdefault(k, []).append(j - n)
    at = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for i in range(n):
        other = (comp[n:] != comp[i]) & (~rest[n:] | (node[n:] > node[i]))
        for k in own[at[i] : at[i + 1]].tolist():
            other[by_key.get(k, [])] = False
        other &= np.minimum(heavy[i], heavy[n:]) >= (LEAST - 1e-9) * np.maximum(heavy[i], heavy[n:])
        j = np.flatnonzero(other) + n
        if not len(j):
            continue
        mine = slice(cut[i], cut[i + 1])
        held[word[mine]] = w[mine]
        begin = np.concatenate(([0], np.cumsum(size[j])[:-1]))
        pick = np.repeat(cut[j] - begin, size[j]) + np.arange(size[j].sum())
        both = np.add.reduceat(np.minimum(held[word[pick]], w[pick]), begin)
        held[word[mine]] = 0
        weighted = both / (heavy[i] + heavy[j] - both)
        near = np.flatnonzero(weighted >= LEAST)
        for x in near:
            if comp[j[x]] != comp[i]:
                out.append((int(min(node[i], node[j[x]])), int(max(node[i], node[j[x]])), float(weighted[x])))
                comp[comp == comp[j[x]]] = comp[i]
    return out


def common_shingles(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes and the weights of shingles in more than COMMON of the n texts."""
    least = max(2, int(n * COMMON) + 1)

    def cells(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for lo, n in spans([b.column(0)]):
                total += np.bincount((shingles(b.column(0).slice(lo, n))[1] >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        # 256 rows of neighbouring cells, so that the sums are dealt out evenly.
        for part in np.split(at, np.searchsorted(at, np.arange(1, 256) * (BUCKETS // 256))):
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[0]) // (BUCKETS // 256)], pa.int32()), pa.array([part.astype(np.int32).tobytes()]), pa.array([total[part].tobytes()])], names=["part", "cells", "counts"])

    def add(table: pa.Table) -> pa.Table:
        c = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["cells"]])
        total, i = np.unique(c, return_inverse=True)
        hot = total[np.bincount(i, weights=np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]])) >= least]
        return pa.table({"cell": pa.array(hot, pa.int32())})

    hot = np.sort(np.array([r.cell for r in texts.mapInArrow(trimmed(cells), "part int, cells binary, counts binary").groupBy("part").applyInArrow(add, "cell int").collect()], np.int64))  # at most BUCKETS
    if not len(hot):
        return np.zeros(0, np.uint64), np.zeros(0)
    marked = np.zeros(BUCKETS, bool)
    marked[hot] = True

    def count(batches):
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for lo, many in spans([b.column(0)]):
                s = shingles(b.column(0).slice(lo, many))[1]
                s = s[marked[(s >> np.uint64(46)).astype(np.int64)]]
                both, i = np.unique(np.concatenate((held, s)), return_inverse=True)
                counts = np.bincount(i, weights=np.concatenate((counts, np.ones(len(s)))), minlength=len(both)).astype(np.int64)
                held = both
                if len(held) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], names=["s", "n"])
                    held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], names=["s", "n"])

    found = texts.mapInArrow(trimmed(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()  # at most mean length / COMMON rows
    s = np.array([r.s for r in found], np.int64).view(np.uint64)
    df = np.array([r.n for r in found], float)
    order = np.argsort(s)
    return s[order], FLOOR + (1 - FLOOR) * np.minimum(1.0, np.log(n / df[order]) / np.log(1 / COMMON))


def components(edges: DataFrame, keep: Scratch, name: str) -> DataFrame:
    """node, comp: the smallest node of each connected component of (a, b); least labels with pointer jumping."""
    both = keep.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = keep.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), f"{name}-0")
    for k in range(1, 100):
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "m").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = low.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("comp"), (F.least("low", F.coalesce("up", "low")) != F.col("comp")).alias("moved"))
        label = keep.keep(new, f"{name}-{k}")
        keep.drop(f"{name}-{k - 1}")
        if not label.filter("moved").limit(1).count():
            return label.select("node", "comp")
    raise RuntimeError("connected components have not settled")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, node (the text's number), comp (the class's smallest node) for every row."""
    return _classes(docs, doc_id, text)[0]


def _classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """The table of ``classes``, and the numbers that more than one text had."""
    spark, keep = docs.sparkSession, Scratch(docs.sparkSession, "neardup")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = d.filter("text is not null").count()
    common = common_shingles(d.select("text").filter("text is not null"), max(n, 1))
    sent = spark.sparkContext.broadcast(common)

    def sign(batches):
        for b in batches:
            for lo, many in spans([b.column(3)]):
                part = b.slice(lo, many)
                row, s, count = shingles(part.column(3))
                found, sig = signatures(row, s, weights(s, count, sent.value))
                k: list = [None] * part.num_rows
                for r, x in zip(found, keys(sig), strict=True):
                    k[r] = x
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(k, pa.list_(pa.int64()))], names=["doc_id", "node", "other", "keys"])

    shared: list[int] = []
    while True:
        rows = d.select("doc_id", "text", number(F.col("text"), shared).alias("node"))
        signed = rows.filter("text is not null").select("doc_id", "node", F.xxhash64(F.lit(8), "text").alias("other"), "text").mapInArrow(trimmed(sign), "doc_id long, node long, other long, keys array<long>")
        nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), (F.min("other") != F.max("other")).alias("twin"))
        nodes = keep.keep(nodes, f"nodes-{len(shared)}")
        twins = [r.node for r in nodes.filter("twin").select("node").collect()]  # about n**2 / 2**65 of n texts
        if not twins:
            break
        shared += twins
    banded = nodes.select("node", F.explode("keys").alias("key"))
    size = keep.keep(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    # At most 2**20 buckets have over 1 / 2**20 of the rows; only they are cut into parts.
    large = max(PART, nodes.count() * BANDS >> 20)
    hot = size.filter(F.col("n") > large).select("key", F.ceil(F.col("n") / PART).cast("int").alias("subs"))
    banded = banded.join(F.broadcast(hot), "key", "left")
    few = banded.filter("subs is null").drop("subs").join(size.filter(F.col("n") <= large), "key", "left_semi").withColumn("subs", F.lit(1))
    banded = keep.keep(banded.filter("subs is not null").select("node", "key", "subs").unionByName(few.select("node", "key", "subs")), "banded")

    def check(batches):
        for b in batches:
            for lo, many in spans([b.column("ta"), b.column("tb")], 256):
                part = b.slice(lo, many)
                sets = []
                for c in ("ta", "tb"):
                    row, s, count = shingles(part.column(c))
                    cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                    sets.append([(s[x:y], count[x:y]) for x, y in zip(cut, cut[1:], strict=False)])
                sim = [similarity(x, y, sent.value) for x, y in zip(*sets, strict=True)]
                ok = [i for i, x in enumerate(sim) if x >= LEAST]
                yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(ok, pa.int64())), part.column("b").take(pa.array(ok, pa.int64())), pa.array([sim[i] for i in ok], pa.float64())], names=["a", "b", "similarity"])

    def among(df: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Rows of ``df`` with one of ``nodes``, which are broadcast while there are few."""
        nodes = keep.keep(nodes, name)
        return df.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, "node", "left_semi")

    def parted(df: DataFrame, seed: int) -> DataFrame:
        return df.withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("subs")).cast("int"))

    def every_part(df: DataFrame) -> DataFrame:
        """A row of each part of a bucket for each bucket."""
        return df.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")

    # Only texts that share a bucket are ever compared; they are put aside once, one for each node.
    texts = among(rows.filter("text is not null").select("node", "text"), banded.select("node").distinct(), "candidates")
    texts = keep.keep(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    links, label = None, None
    for turn in range(ROUNDS + 1):
        # Leaders by a seeded order: of each part, and the first of the bucket for the leaders of its parts.
        order = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), F.col("node"))
        now = banded if label is None else banded.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        now = parted(now, 100 + turn)
        if label is not None:
            mixed = now.groupBy("key", "sub", "subs").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).groupBy("key", "subs").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi")
            now = now.join(every_part(mixed.select("key", "subs")), ["key", "sub"], "left_semi")
        sub = now.groupBy("key", "sub").agg(F.min(F.struct(order.alias("o"), "node")).alias("low"), F.max(F.struct(order.alias("o"), "node")).alias("high"))
        whole = sub.groupBy("key").agg(F.min("low")["node"].alias("head"))
        leaders = sub.join(whole, "key").select("key", "sub", F.col("low")["node"].alias("l"), F.col("high")["node"].alias("h"), "head")
        lead = F.when(F.col("node").isin(F.col("l"), F.col("h")), F.array("l", "h", "head")).otherwise(F.array("l", "h"))
        edges = now.join(leaders, ["key", "sub"]).select("node", *(["comp"] if label is not None else []), F.explode(F.array_distinct(lead)).alias("to")).filter("node != to")
        if label is not None:
            edges = edges.join(label.select(F.col("node").alias("to"), F.col("comp").alias("to_comp")), "to", "left").filter(F.col("comp") != F.coalesce("to_comp", "to"))
        pairs = keep.keep(edges.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct(), f"pairs-{turn}")
        used = among(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"wanted-{turn}")
        joined = pairs.join(used.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(used.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        found = keep.keep(joined.select("a", "b", "ta", "tb").mapInArrow(trimmed(check), "a long, b long, similarity double"), f"links-{turn}")
        keep.drop(f"wanted-{turn}", f"pairs-{turn}")
        if not found.limit(1).count():
            break
        links = found if links is None else links.unionByName(found)
        label = keep.keep(components(links, keep, f"comp-{turn}"), f"label-{turn}")
    # What the leaders left open, whole: (outside the largest class) x (all) of each bucket. Buckets of up to three were
    # compared whole in the first round.
    now = banded.withColumn("comp", F.col("node")) if label is None else banded.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    now = keep.keep(parted(now, 100), "now")
    per = now.groupBy("key", "subs", "comp").agg(F.count("*").alias("m")).groupBy("key", "subs").agg(F.max(F.struct("m", "comp")).alias("big"), F.sum("m").alias("m"))
    per = per.filter("m > 3 and big.m < m").select("key", "subs", F.col("big")["comp"].alias("big"), F.ceil((F.col("m") - F.col("big")["m"]) / GROUP).cast("int").alias("na"), F.ceil(F.col("m") / GROUP).cast("int").alias("nb"))
    left = keep.keep(now.drop("subs").join(every_part(per), ["key", "sub"]).withColumn("rest", F.col("comp") != F.col("big")), "left")
    if left.limit(1).count():
        deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = left.filter("rest").withColumn("ga", deal(200, "na")).withColumn("gb", every("nb")).withColumn("side", F.lit(0))
        two = left.withColumn("gb", deal(201, "nb")).withColumn("ga", every("na")).withColumn("side", F.lit(1))
        cells = one.unionByName(two).select("key", "ga", "gb", "side", "node", "comp", "rest")
        used = among(texts, left.select("node").distinct(), "wanted-left").join(nodes.select("node", "keys"), "node")
        found = cells.join(keep.keep(used, "used"), "node").groupBy("key", "ga", "gb")

        def whole_block(table: pa.Table) -> pa.Table:
            got = block_links(table, sent.value)
            return pa.table({c: pa.array(x, t) for c, x, t in zip(("a", "b", "similarity"), zip(*got, strict=True) if got else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

        found = keep.keep(found.applyInArrow(whole_block, "a long, b long, similarity double"), "links-left")
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            label = keep.keep(components(links, keep, "comp-left"), "label-left")
        keep.drop("wanted-left", "used", "left")
    keep.drop("texts", "candidates", "banded", "now", "sizes")
    first = nodes.select("node", "first")
    if label is None:
        named = first.select("node", F.col("first").alias("class_id"), F.col("node").alias("comp"))
    else:
        labelled = first.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        name = labelled.groupBy("comp").agg(F.min("first").alias("class_id"))
        named = labelled.join(name, "comp").select("node", "class_id", "comp")
    rows = d.select("doc_id", number(F.col("text"), shared).alias("node"))
    return rows.join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "node", "comp"), shared


def number(text: Column, shared: list[int]) -> Column:
    """The number of a text (null for null): a hash, or another one where ``shared`` has the first."""
    h = F.xxhash64(F.lit(7), text)
    if shared:
        h = F.when(h.isin(shared), F.xxhash64(F.lit(9), text)).otherwise(h)
    return F.when(text.isNotNull(), h)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, that of its smallest identifier (rows without one come last); every row with
    a null text stays."""
    keep = Scratch(docs.sparkSession, "representatives")
    none, i_, n_ = F.lit(-(2**63)).cast("long"), f"{_HIDDEN}id", f"{_HIDDEN}node"
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", none).alias(i_), F.col("node").alias(n_))
    found, shared = _classes(docs, doc_id, text)
    found = keep.keep(found.filter("node is not null").groupBy("comp").agg(F.min(order).alias("m")).select(f"m.{i_}", f"m.{n_}"), "kept")
    d = docs.withColumn(i_, F.coalesce(F.col(doc_id).cast("long"), none)).withColumn(n_, number(F.col(text).cast("string"), shared))
    named = d.filter(F.col(text).isNotNull())
    # Rows repeated under one identifier (rare) are reduced within each task first, then by key.
    if found.join(named.groupBy(i_, n_).agg(F.count("*").alias("k")).filter("k > 1").select(i_, n_), [i_, n_], "left_semi").limit(1).count():
        named = named.dropDuplicates([i_, n_])
    picked = named.join(found, [i_, n_], "left_semi")
    return picked.unionByName(d.filter(F.col(text).isNull())).select(*docs.columns)
