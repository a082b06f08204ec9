"""Katz backoff language model with Good-Turing discounts and exactly normalised backoff weights.

P(w | h) is d(c) c / T for a history h and word w seen together c times in training, T being the count of h as a history; else it is
a(h) P(w | h without its first word), where a(h) makes the probabilities after h add up to 1 exactly. The recursion ends with P(w), the
discounted share of w; the rest of the mass belongs to the one class of unknown words. A history never seen backs off at
once. d(c) follows Katz, for each order by itself, with counts up to LARGE discounted. Where a ratio of raw counts of counts
lies outside (0, 1), as repeated documents make it, the counts of counts are smoothed first by a line through their
logarithms (simple Good-Turing). Only where that line falls no faster than 1 / r, or fewer than two counts of counts
are above zero, c loses one half. A history whose followers are all undiscounted gives up one half of a count.

Tables are partitioned by the hash of the word or history. Blocks of documents keep their tokens as numbers into their
own word list; for each order and partition a block sends its words, or its histories with the words after them, once, with training
counts; the owner of the partition adds up the counts of all blocks, and sends back what the block asked for. From that the
block works out the probability of each of its n-grams, which the next order builds on. So what travels grows with the
corpus's distinct n-grams per block, and a frequent one costs one entry per block. Followers of a history with more
than ``hot`` tokens (at least 1 / 2**16 of all, so there are at most 2**16 such histories an order) are dealt over several
partitions by the word; the partial sums of these histories are added up on the driver and sent to all. Words have
numbers of their own; longer histories are told apart by a 64-bit hash of these.

Defined cases: null text is empty and consists of the end token; before the first word stand end tokens; repeated
rows count and score as often as they stand; null identifiers belong to the fold of the empty text; an empty table
gives an empty result; with no training rows every word is unknown; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsched.llm.shared import Scratch
from crawlsched.llm.textarrays import buffers, mix, runs, spans, trimmed, words

LARGE = 5
BLOCK_TOKENS = 1 << 20
BLOCKS_AT_ONCE = 4
PART_TOKENS = 1_000_000
HOT_TOKENS = PART_TOKENS // 8
END = np.uint64(1)
SHIFT = 40
ADD = 0.1


ORDER = 2


def put(a: np.ndarray) -> bytes:
    """Packed: first bytes of all numbers, then their second bytes and so on, as the high ones hardly differ."""
    planes = np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(a.size, -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def take(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0..LARGE) from N(1), N(2), ..., N(LARGE + 1); d above LARGE is 1."""
    r = np.arange(1, LARGE + 1)

    def katz(n: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            over = (LARGE + 1) * n[LARGE] / n[0]
            return np.where(over < 1, ((r + 1) * n[1:] / n[:-1] / r - over) / (1 - over), np.nan)

    def sound(d: np.ndarray) -> bool:
        return bool(np.all(np.isfinite(d)) and d.min() > 0 and d.max() < 1)

    n = np.array(counts_of_counts[: LARGE + 1], float)
    d = katz(n)
    if not sound(d):
        at = np.flatnonzero(n > 0) + 1
        if len(at) > 1:
            # A count of counts stands for the empty ones around it too: half the way to its neighbours on both sides.
            before, after = np.append(0, at[:-1]), np.append(at[1:], 2 * at[-1] - at[-2])
            slope, start = np.polyfit(np.log(at), np.log(2 * n[at - 1] / (after - before)), 1)
            d = katz(np.exp(start + slope * np.log(np.arange(1, LARGE + 2))))
            if slope >= -1 or not sound(d):
                d = 1 - 0.5 / r
        else:
            d = 1 - 0.5 / r
    return np.concatenate(([0.0], d))


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c > LARGE, 1.0, d[np.minimum(c, LARGE)])


BLOCK = "block string, doc_ids array<long>, held array<boolean>, tokens long, train_tokens long, vocab binary, stream binary, ends binary"


def is_held(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def blocks(docs: DataFrame, doc_id: str, text: str, folds: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        p, k = TaskContext.get().partitionId(), 0
        ids, hashes, sizes = [], [], []

        def flush():
            all_ = np.concatenate(hashes)
            vocab, stream = np.unique(all_, return_inverse=True)
            n = np.concatenate(sizes)
            held = [is_held(i, folds) for i in ids]
            train = int(n[~np.array(held, bool)].sum())
            return pa.RecordBatch.from_pylist([{"block": f"{p}-{k}", "doc_ids": list(ids), "held": held, "tokens": len(all_), "train_tokens": train, "vocab": vocab.tobytes(), "stream": put(stream.astype(np.uint32)), "ends": put(np.cumsum(n))}], schema)

        for b in batches:
            for lo, many in spans([b.column(1)], 512):
                part = b.slice(lo, many)
                h, row = words(*buffers(part.column(1)), lower=True)
                n = np.bincount(row, minlength=part.num_rows)
                stops = np.cumsum(n)
                hashes.append(np.insert(h, stops, END))
                sizes.append(n + 1)
                ids += part.column(0).to_pylist()
                if sum(map(len, hashes)) >= BLOCK_TOKENS:
                    yield flush()
                    ids, hashes, sizes, k = [], [], [], k + 1
        if ids:
            yield flush()

    schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.int64()), ("train_tokens", pa.int64()), ("vocab", pa.binary()), ("stream", pa.binary()), ("ends", pa.binary())])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(make), BLOCK)


def trained(row: dict) -> np.ndarray:
    """Which tokens of a block belong to training documents."""
    ends = take(row["ends"], np.int64)
    return np.repeat(~np.array(row["held"], bool), np.diff(ends, prepend=0))


def owner(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def split(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part that keeps the order within, and where each part begins in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 10, hot_tokens: int = HOT_TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both in log10). ``order`` is the length of the
    longest n-gram, 2 at least."""
    spark, keep = docs.sparkSession, Scratch(docs.sparkSession, "katz")
    b0 = keep.keep(blocks(docs, doc_id, text, folds), "blocks")
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    total, train_tokens, many = b0.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0)), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], out_schema)
    parts = max(16, -(-total // PART_TOKENS))
    hot = max(hot_tokens, total >> 16)
    together = -(-many // BLOCKS_AT_ONCE)  # partitions of blocks, whatever the session's number

    # Words: each block asks the owner of a hash for the corpus count and the number of the word.
    def ask_words(batches):
        for b in batches:
            for row in b.to_pylist():
                vocab, stream = np.frombuffer(row["vocab"], np.uint64), take(row["stream"], np.uint32)
                count = np.bincount(stream[trained(row)], minlength=len(vocab)).astype(np.uint64)
                order, at = split(owner(vocab, parts), parts)
                rows = [(p, row["block"], put(vocab[order[at[p] : at[p + 1]]]), put(count[order[at[p] : at[p + 1]]])) for p in range(parts) if at[p] < at[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["p", "block", "words", "counts"])

    def answer_words(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [take(r["words"], np.uint64) for r in rows]
        word, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([take(r["counts"], np.uint64) for r in rows])).astype(np.int64)
        stops = np.cumsum([len(a) for a in asked])
        out = [{"block": r["block"], "p": r["p"], "ids": put(i.astype(np.uint32)), "counts": put(count[i].astype(np.uint64)), "stats": None} for r, i in zip(rows, np.split(inverse, stops[:-1]), strict=True)]
        exact = [int((count == r).sum()) for r in range(1, LARGE + 2)]
        out.append({"block": None, "p": rows[0]["p"], "ids": None, "counts": None, "stats": [int((count > 0).sum()), *exact, *(int(count[count == r].sum()) for r in range(1, LARGE + 1))]})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.string()), ("p", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))]))

    asked = b0.mapInArrow(trimmed(ask_words), "p int, block string, words binary, counts binary").repartition(parts, "p")
    replies = keep.keep(asked.groupBy("p").applyInArrow(answer_words, "block string, p int, ids binary, counts binary, stats array<long>"), "words", BLOCKS_AT_ONCE)
    stats = np.array([r.stats for r in replies.filter("block is null").select("stats").collect()]).sum(0)  # a row for each part
    types, seen_n = int(stats[0]), [int(x) for x in stats[1 : LARGE + 2]]
    d1 = discounts(seen_n)
    kept = sum(d1[r] * r * seen_n[r - 1] for r in range(1, LARGE + 1)) + (train_tokens - sum(r * seen_n[r - 1] for r in range(1, LARGE + 1)))
    unknown = 1.0 if not train_tokens else (train_tokens - kept) / train_tokens
    denominator = train_tokens
    if unknown <= 0:  # no word was seen up to LARGE times
        denominator, unknown = train_tokens + 0.5, 0.5 / (train_tokens + 0.5)

    def unigram(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, d1) / max(denominator, 1), unknown)

    listed = replies.filter("block is not null").repartition(together, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", "ids", "counts"))).alias("replies"))
    joined = b0.repartition(together, "block").join(listed, "block")
    lean = "block string, doc_ids array<long>, held array<boolean>, ids binary, counts binary, stream binary, ends binary"

    def number(batches):
        for b in batches:
            for row in b.to_pylist():
                vocab = np.frombuffer(row["vocab"], np.uint64)
                order, at = split(owner(vocab, parts), parts)
                ids, counts = np.empty(len(vocab), np.int64), np.empty(len(vocab), np.uint64)
                for r in row["replies"]:
                    own = order[at[r["p"]] : at[r["p"] + 1]]
                    ids[own] = take(r["ids"], np.uint32).astype(np.int64) + (r["p"] << SHIFT)
                    counts[own] = take(r["counts"], np.uint64)
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("block", "doc_ids", "held", "stream", "ends")} | {"ids": put(ids), "counts": put(counts)}], pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("ids", pa.binary()), ("counts", pa.binary()), ("stream", pa.binary()), ("ends", pa.binary())]))

    b1 = keep.keep(joined.mapInArrow(trimmed(number), lean), "numbered", BLOCKS_AT_ONCE)
    keep.drop("blocks", "words")

    state, level = b1, None
    for n in range(2, order + 1):
        level = Level(n, parts, hot, unigram, None, None)
        asked = state.mapInArrow(trimmed(level.ask), "p int, block string, h binary, many binary, w binary, lower binary, n binary, hot binary").repartition(parts, "p")
        replies = keep.keep(asked.groupBy("p").applyInArrow(level.answering(), "block string, p int, count binary, t binary, q binary, few binary, stats array<long>, hot array<struct<h:long,t:long,q:double,few:array<long>>>"), f"replies-{n}", BLOCKS_AT_ONCE)
        sums = replies.filter("block is null").select("p", "stats", "hot").orderBy("p").collect()  # a row for each part
        whole: dict[int, np.ndarray] = {}
        for r in sums:
            for x in r.hot:
                whole[x.h] = whole.get(x.h, 0) + np.array([x.t, x.q, *x.few], float)
        named = np.array(sorted(whole), np.int64)
        frequent = spark.sparkContext.broadcast((named, np.array([whole[h] for h in named.tolist()]).reshape(len(named), 2 + LARGE)))
        level = Level(n, parts, hot, unigram, discounts([int(x) for x in np.array([r.stats for r in sums]).sum(0)]), frequent)
        listed = replies.filter("block is not null").repartition(together, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", "count", "t", "q", "few"))).alias("replies"))
        joined = state.repartition(together, "block").join(listed, "block")
        if n < order:
            state = keep.keep(joined.mapInArrow(trimmed(level.store), lean + ", prob binary, seen binary"), f"grams-{n}", BLOCKS_AT_ONCE)
            keep.drop(f"replies-{n}", "numbered" if n == 2 else f"grams-{n - 1}")

    def evaluate(batches):
        for b in batches:
            for row in b.to_pylist():
                g = level.grams(row)
                log = np.log10(level.probabilities(row, g)[0])[g.inverse]
                counts, stream = take(row["counts"], np.int64), take(row["stream"], np.uint32).astype(np.int64)
                base = np.log10((counts + ADD) / (train_tokens + ADD * (types + 1)))[stream]
                known = (counts > 0)[stream].astype(np.int64)
                ends = take(row["ends"], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(ends - starts), pa.array(np.add.reduceat(known, starts)), pa.array(np.full(len(ends), train_tokens, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(log, starts))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = keep.keep(joined.mapInArrow(trimmed(evaluate), out_schema), "scores", BLOCKS_AT_ONCE)
    keep.drop(f"replies-{order}", "numbered" if order == 2 else f"grams-{order - 1}")
    return out


class Grams(NamedTuple):
    """The distinct n-grams of a block, by history and word in the block's own numbers."""

    inverse: np.ndarray  # of each token, its n-gram
    h: np.ndarray  # history of each n-gram
    w: np.ndarray
    ids: np.ndarray  # of each word of the block
    key: np.ndarray  # of each history, its number in the corpus
    count: np.ndarray  # of each history in training
    lower: np.ndarray  # of each n-gram, the one without its first word (a word for pairs)


class Level:
    """The n-grams of one order: what blocks ask, what owners answer, and probabilities from the answers."""

    def __init__(self, n: int, parts: int, hot: int, unigram: Callable[[np.ndarray], np.ndarray], d: np.ndarray | None, frequent):
        self.n, self.parts, self.hot, self.unigram, self.d, self.frequent = n, parts, hot, unigram, d, frequent

    def grams(self, row: dict) -> Grams:
        stream, ids, counts = take(row["stream"], np.uint32).astype(np.int64), take(row["ids"], np.int64), take(row["counts"], np.int64)
        starts = np.concatenate(([0], take(row["ends"], np.int64)[:-1]))
        end = stream[-1]  # every document ends with the end token
        lower, key, before = stream, ids, ids[end]
        for k in range(2, self.n + 1):
            # Histories are the shorter n-grams that end one token before; that of a first word is all end tokens.
            many = int(lower.max()) + 1 if k > 2 else len(ids)
            history = np.empty_like(stream)
            history[1:] = lower[:-1]
            history[starts] = end if k == 2 else many
            packed, first, inverse = np.unique(history.astype(np.uint64) << np.uint64(32) | stream.astype(np.uint64), return_index=True, return_inverse=True)
            h, w, below = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), lower[first]
            if k > 2:
                key = np.append(key, before)
            if k < self.n:
                chain = lambda x, y: mix(mix(x.astype(np.uint64)) + y.astype(np.uint64)).view(np.int64)
                key, before = chain(key[h], ids[w]), chain(np.array([before]), ids[end : end + 1])[0]
                lower = inverse
        count = counts if self.n == 2 else np.append(take(row["seen"], np.int64), counts[end])
        return Grams(inverse, h, w, ids, key, count, below)

    def dealt(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """An order of the n-grams by partition, and where each begins; frequent histories are cut by word."""
        cuts = np.maximum(-(-g.count // self.hot), 1)[g.h].astype(np.uint64)
        return split(owner(mix(g.key.astype(np.uint64)[g.h] + (mix(g.ids.astype(np.uint64))[g.w] % cuts << np.uint64(55))), self.parts), self.parts)

    def ask(self, batches):
        for b in batches:
            for row in b.to_pylist():
                g = self.grams(row)
                n = np.bincount(g.inverse[trained(row)], minlength=len(g.h)).astype(np.uint64)
                # Counts of words, from which their probability follows; probabilities of longer n-grams.
                lower = take(row["counts"], np.int64)[g.w] if self.n == 2 else take(row["prob"], np.float64)[g.lower]
                order, at = self.dealt(g)
                rows = []
                for p in range(self.parts):
                    own = order[at[p] : at[p + 1]]
                    if len(own):
                        first = runs(g.h[own])
                        h = g.h[own[first]]
                        # Only n-grams seen in training need their lower probability, for the mass of their history.
                        rows.append((p, row["block"], put(g.key[h]), put(np.diff(first, append=len(own)).astype(np.uint32)), put(g.ids[g.w[own]]), put(np.where(n[own] > 0, lower[own], 0)), put(n[own]), put(g.count[h] > self.hot)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), *[pa.binary()] * 6), strict=True)], names=["p", "block", "h", "many", "w", "lower", "n", "hot"])

    def answering(self) -> Callable[[pa.Table], pa.Table]:
        return lambda table: self.answer(table)  # Spark counts arguments, self too

    def answer(self, table: pa.Table) -> pa.Table:
        rows = [{k: v.as_py() for k, v in zip(table.column_names, x, strict=True)} for x in zip(*table.columns, strict=True)]
        hs, many = [take(r["h"], np.int64) for r in rows], [take(r["many"], np.uint32) for r in rows]
        hist, hi = np.unique(np.concatenate(hs), return_inverse=True)
        pair_h = np.concatenate([np.repeat(i, m) for i, m in zip(np.split(hi, np.cumsum([len(x) for x in hs])[:-1]), many, strict=True)])
        w = np.concatenate([take(r["w"], np.int64) for r in rows])
        lower = np.concatenate([take(r["lower"], np.int64 if self.n == 2 else np.float64) for r in rows])
        n = np.concatenate([take(r["n"], np.uint64) for r in rows])
        order = np.lexsort((n == 0, w, pair_h))  # entries with counts, which have a lower probability, come first
        new = np.concatenate(([True], (pair_h[order][1:] != pair_h[order][:-1]) | (w[order][1:] != w[order][:-1])))
        group = np.cumsum(new) - 1
        c = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        first = order[new]
        gh, seen = pair_h[first], c > 0
        per = len(hist)
        t = np.bincount(gh, weights=c, minlength=per)
        below = lower[first][seen]
        q = np.bincount(gh[seen], weights=self.unigram(below) if self.n == 2 else below, minlength=per)
        few = np.stack([np.bincount(gh[c == r], minlength=per) for r in range(1, LARGE + 1)])
        count = np.empty(len(w), np.uint64)
        count[order] = c[group]
        out, at_h, at_w = [], 0, 0
        for r, x in zip(rows, hs, strict=True):
            k, i = int(many[len(out)].sum()), hi[at_h : at_h + len(x)]
            out.append({"block": r["block"], "p": r["p"], "count": put(count[at_w : at_w + k]), "t": put(t[i].astype(np.uint64)), "q": put(q[i]), "few": put(few[:, i].astype(np.uint64)), "stats": None, "hot": None})
            at_h, at_w = at_h + len(x), at_w + k
        frequent = np.unique(hi[np.concatenate([take(r["hot"], bool) for r in rows])])
        sums = [{"h": int(hist[i]), "t": int(t[i]), "q": float(q[i]), "few": few[:, i].tolist()} for i in frequent]
        out.append({"block": None, "p": rows[0]["p"], "count": None, "t": None, "q": None, "few": None, "stats": [int((c == r).sum()) for r in range(1, LARGE + 2)], "hot": sums})
        kinds = [("block", pa.string()), ("p", pa.int32()), *[(k, pa.binary()) for k in ("count", "t", "q", "few")], ("stats", pa.list_(pa.int64())), ("hot", pa.list_(pa.struct([("h", pa.int64()), ("t", pa.int64()), ("q", pa.float64()), ("few", pa.list_(pa.int64()))])))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    def probabilities(self, row: dict, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram: its probability, and its count in training."""
        order, at = self.dealt(g)
        lower = self.unigram(take(row["counts"], np.int64))[g.w] if self.n == 2 else take(row["prob"], np.float64)[g.lower]
        name, sums = self.frequent.value
        prob, seen = np.empty(len(g.h)), np.empty(len(g.h), np.int64)
        for r in row["replies"]:
            own = order[at[r["p"]] : at[r["p"] + 1]]
            first = runs(g.h[own])
            i = np.repeat(np.arange(len(first)), np.diff(first, append=len(own)))
            c, t, q, few = take(r["count"], np.int64), take(r["t"], np.uint64).astype(float), take(r["q"], np.float64).copy(), take(r["few"], np.uint64).reshape(LARGE, -1).astype(float)
            own_h = g.h[own[first]]
            if len(cut := np.flatnonzero(g.count[own_h] > self.hot)):
                of = sums[np.searchsorted(name, g.key[own_h[cut]])]
                t[cut], q[cut], few[:, cut] = of[:, 0], of[:, 1], of[:, 2:].T
            size = np.arange(1, LARGE + 1)[:, None]
            lost = ((1 - self.d[1:])[:, None] * size * few).sum(0)
            whole = np.where((lost > 0) | (t == 0), t, t + 0.5)
            lost = np.where(lost > 0, lost, 0.5)
            back = np.where(t > 0, lost / np.maximum(whole, 1) / (1 - q), 1.0)
            prob[own], seen[own] = np.where(c > 0, discounted(c, self.d) / np.maximum(whole[i], 1), back[i] * lower[own]), c
        return prob, seen

    def store(self, batches):
        names = ("block", "doc_ids", "held", "ids", "counts", "stream", "ends")
        for b in batches:
            for row in b.to_pylist():
                prob, seen = self.probabilities(row, self.grams(row))
                kinds = [("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *[(k, pa.binary()) for k in ("ids", "counts", "stream", "ends", "prob", "seen")]]
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in names} | {"prob": put(prob), "seen": put(seen)}], pa.schema(kinds))
