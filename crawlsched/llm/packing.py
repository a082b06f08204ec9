"""Packing token sequences into fixed-length contexts by minimum bin slack.

Only lengths matter for a packing, so the plan is made over the histogram of piece lengths (at most ``capacity``
entries, whatever the corpus): the longest open piece starts a bin, and a bitset subset-sum over the remaining lengths
finds the fullest combination for the rest. A found pattern is used as often as its lengths last, then its pieces are
removed; that is the same packing as bin by bin, as the search is deterministic. Pieces that fill a sequence need no plan and
get one of their own where they stand. The others get their place by their rank among pieces of equal length, counted in
parts of about PART_ROWS, so that a length that a third of all pieces have is no single task's.

Defined cases: null text is empty and still ends with the end token; repeated rows are packed as often as they stand;
an empty table gives an empty result. Texts are parted at white space before they are tokenized; the tokenizer drops
white space and never joins across it, so the identifiers are those of the whole text.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlsched.llm.shared import Scratch
from crawlsched.llm.textarrays import bounds, buffers, hashes, spans, trimmed

CAPACITY = 4096
END = 1
PART_ROWS = 1 << 18
CACHE_CHUNKS = 100_000
CACHE_WORDS = 400_000
PART = 1 << 20
LONGEST_PART = 2 << 20
_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.array([0x20, *range(0x09, 0x0E)], np.uint8)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run behind the other."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(int(size.sum()))


class WordTokenizer:
    """Identifiers of texts as little-endian uint32.

    White space parts texts into chunks; equal chunks of some megabytes of text are looked up once, and their identifiers are
    dealt out to all places by numpy. A chunk of letters is one word to the tokenizer, with ASCII signs behind them (but
    for the apostrophe, which may belong to either) it is two; case makes no difference. Many words are encoded in one go. Letters
    are A to Z and those of Latin-1, which are whole characters in normal form. Signs, and chunks of other kinds,
    are encoded one by one. What was encoded is cached, within bounds."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def one_by_one(self, chunks: list[str]) -> list[bytes]:
        missing = list(set(chunks).difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_CHUNKS:
            self.cache.clear()
            missing = list(set(chunks))
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            self.cache.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(some, encode(some, add_special_tokens=False), strict=True))
        return list(map(self.cache.__getitem__, chunks))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Identifiers of words of letters, where each begins, and how many each has."""
        found = list(map(self.known.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        flat, size = [b"".join(filter(None, found))], np.fromiter((len(x) // 4 if x else 0 for x in found), np.int64, len(found))
        begin = np.cumsum(size) - size
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        done = len(flat[0]) // 4
        for at in range(0, len(new), 2048):
            own = new[at : at + 2048]
            e = self.tokenizer.encode(" ".join([words[k] for k in own]), add_special_tokens=False)
            ids, many = np.array(e.ids, "<u4").tobytes(), np.bincount(np.array(e.word_ids, np.int64), minlength=len(own))
            size[own], begin[own] = many, done + np.cumsum(many) - many
            flat.append(ids)
            stops = (4 * np.cumsum(many)).tolist()
            self.known.update((words[k], ids[x:y]) for k, x, y in zip(own, [0, *stops], stops, strict=False))
            done += len(ids) // 4
        return np.frombuffer(b"".join(flat), "<u4"), begin, size

    def _part(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = bounds(raw, at)
        _, first, inverse = np.unique(hashes(raw, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        # Bytes of letters: ASCII, or two that stand for a letter of Latin-1.
        letter, lead = _LETTER[raw], raw[:-1] == 0xC3
        pair = lead & (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        letter[:-1] |= pair
        letter[1:] |= pair
        letters, signs = (np.concatenate((np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32))) for x in (letter, _SIGN[raw]))
        body = (letters[b] - letters[a]).astype(np.int64)
        easy = (body > 0) & (letters[a + body] - letters[a] == body) & (signs[b] - signs[a + body] == b - a - body)
        data = raw.tobytes()
        cut = lambda x, y: [data[i:j].decode("utf-8", "replace") for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        # Words of letters, in lower case, each once; then signs behind them; then the other chunks.
        ea, eb = a[easy], (a + body)[easy]
        place = np.argsort(ea)
        lower = np.empty(len(ea), np.uint64)
        lower[place] = hashes(raw, ea[place], eb[place], True)
        _, one, word = np.unique(lower, return_index=True, return_inverse=True)
        flat, begin, size = self.words([w.lower() for w in cut(ea[one], eb[one])])
        tail = easy & (b > a + body)
        rest = self.one_by_one(cut(np.concatenate(((a + body)[tail], a[~easy])), np.concatenate((b[tail], b[~easy]))))
        more = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        flat = np.concatenate((flat, np.frombuffer(b"".join(rest), "<u4")))
        more_begin = len(flat) - int(more.sum()) + np.cumsum(more) - more
        # Units of each chunk: a word, what is behind it; or one of another kind.
        unit_begin, unit_size = np.zeros((len(a), 2), np.int64), np.zeros((len(a), 2), np.int64)
        unit_begin[easy, 0], unit_size[easy, 0] = begin[word], size[word]
        for rows, column, own in ((tail, 1, slice(0, int(tail.sum()))), (~easy, 0, slice(int(tail.sum()), None))):
            unit_begin[rows, column], unit_size[rows, column] = more_begin[own], more[own]
        flat, size = flat[_places(unit_begin.ravel(), unit_size.ravel())], unit_size.sum(1)
        many = size[inverse]
        ids = flat[_places((np.cumsum(size) - size)[inverse], many)]
        return ids, np.concatenate(([0], np.cumsum(many)))[np.searchsorted(starts, at)]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all rows, one behind the other, and where each row begins (and the last one ends)."""
        if len(raw) <= LONGEST_PART:
            return self._part(raw, at)
        out, cut = [], 0  # a very long text, in parts that end at white space
        while cut < len(raw):
            stop = min(len(raw), cut + LONGEST_PART)
            while stop < len(raw) and not (blank := np.flatnonzero(np.isin(raw[stop : stop + 4096], _BLANK))).size:
                stop = min(len(raw), stop + 4096)
            stop += int(blank[0]) if stop < len(raw) else 0
            own = np.unique(np.concatenate(([cut], at[(at > cut) & (at < stop)], [stop]))) - cut
            ids, begin = self._part(raw[cut:stop], own)
            out.append((ids, own + cut, begin))
            cut = stop
        size = np.concatenate(([0], np.cumsum([len(x[0]) for x in out])))
        place, begin = np.concatenate([x[1][:-1] for x in out] + [[len(raw)]]), np.concatenate([x[2][:-1] + s for x, s in zip(out, size, strict=False)] + [[size[-1]]])
        return np.concatenate([x[0] for x in out]), begin[np.searchsorted(place, at)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its caches last from task to task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        tok = word_tokenizer(tokenizer)
        for batch in batches:
            for lo, many in spans([batch.column(1)], 4096, PART):
                ids, begin = tok.encode(*buffers(batch.column(1).slice(lo, many)))
                ids, begin = np.insert(ids, begin[1:], end), begin + np.arange(many + 1)
                data, size = memoryview(ids.astype("<u4").tobytes()), np.diff(begin)
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(many), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                at = 4 * (begin[row] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, many).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(cut), PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (each at most counts times) with the largest sum up to ``room``; bitset subset-sum, longest first."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, power = min(counts[n], room // n), 1
        while left:
            k = min(power, left)
            new = reach | reach << n * k & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            left, power = left - k, power * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            out += [n] * k
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of each pattern."""
    counts, out = {n: c for n, c in counts.items() if c}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        pattern = [top, *fullest(lengths, counts, capacity - top)]
        counts[top] += 1
        need = {n: pattern.count(n) for n in set(pattern)}
        times = min(counts[n] // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
        out.append((times, pattern))
    return out


def pack(piece_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. ``piece_table`` is a written table of pieces with a column ``lot``, any numbers that are
    spread over all rows, repeated ones too."""
    spark = piece_table.sparkSession
    full = piece_table.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).drop("lot")
    t = piece_table.filter(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in t.groupBy("length").agg(F.count("*").alias("n")).collect()}  # below capacity rows
    salts = spark.createDataFrame([(n, -(-c // PART_ROWS)) for n, c in counts.items()], "length long, _salts long")
    t = t.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("lot"), "_salts")).drop("_salts")
    base: list[tuple[int, int, int]] = []
    before: dict[int, int] = {}
    for r in sorted(t.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()):  # rows / PART_ROWS + capacity rows
        base.append((r["length"], r["_salt"], before.get(r["length"], 0)))
        before[r["length"]] = before.get(r["length"], 0) + r["n"]
    first, at = {}, 0
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for times, pattern in plan(counts, capacity):
        offset = 0
        for n in pattern:  # ranks [rank, rank + times) of this length go to sequences at, at + 1, ...
            rank = first.get(n, 0)
            slots.setdefault(n, []).append((rank, at, offset, times))
            first[n] = rank + times
            offset += n
        at += times
    ranks = {n: (np.array([s[0] for s in x]), np.array([s[1] for s in x]), np.array([s[2] for s in x])) for n, x in slots.items()}
    starts = spark.createDataFrame(base, "length long, _salt long, _base long")
    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    t = t.withColumn("_rank", F.row_number().over(w)).join(F.broadcast(starts), ["length", "_salt"])
    t = t.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_base") - 1).alias("rank"))

    def place(batches):
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for v in np.unique(n):
                at, (lo, sid, o) = np.flatnonzero(n == v), ranks[int(v)]
                k = np.searchsorted(lo, rank[at], "right") - 1
                seq[at], off[at] = sid[k] + rank[at] - lo[k], o[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[x.split()[0] for x in (PIECES + ", sequence_id long, offset long").split(", ")])

    return t.mapInArrow(trimmed(place), PIECES + ", sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    keep = Scratch(docs.sparkSession, "packing")
    return pack(keep.keep(pieces(docs, tokenizer, doc_id, text, capacity, end).withColumn("lot", F.monotonically_increasing_id()), "pieces"), capacity)
