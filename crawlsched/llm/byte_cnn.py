"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

Bytes are embedded, convolved with learned filters (WIDTH bytes, every STRIDE-th position), rectified, and max-pooled
over chunks of CHUNK bytes that overlap by OVERLAP and cover the whole text. The maxima over all chunks and the mean of
the chunks' maxima go into one logistic unit. Training (Adam, seeded) runs on a bounded sample: SAMPLE labelled texts
of each label, none over LONGEST characters, over EPOCHS rounds, or up to MOST_EPOCHS until STEPS batches are done. One row in HELD is kept from training; on
these the unit's offset is fitted, so that the threshold keeps all but LOST of label 1 and rejects as many others as it
can. With fewer than FEWEST such rows of a label, the label shares of all rows are the offset.

Defined cases: null and empty texts are one chunk of zero bytes; rows without a label are scored, not learned from;
without both labels in training every score is the share of label 1 (1 if there is none); a document with several
labels counts with its largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from crawlsched.llm.sample import bounded
from crawlsched.llm.shared import fold
from crawlsched.llm.textarrays import trimmed

DIM, WIDTH, STRIDE, FILTERS = 8, 6, 2, 20
CHUNK, OVERLAP = 512, 64
STEP = CHUNK - OVERLAP
SAMPLE = 1500
LONGEST = 12_000
EPOCHS = 12
STEPS = 1000
MOST_EPOCHS = 60
BATCH = 32
HELD = 6
FEWEST = 10
LOST = 0.01
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(text: bytes) -> np.ndarray:
    n = max(1, -(-(len(text) - OVERLAP) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, DIM)), "w": r.normal(0, (2 / (DIM * WIDTH)) ** 0.5, (WIDTH * DIM, FILTERS)), "b": np.zeros(FILTERS), "v": np.zeros(2 * FILTERS), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift = 0.0
        self.constant: float | None = None

    def windows(self, c: np.ndarray) -> np.ndarray:
        x = self.p["e"][c].reshape(len(c), CHUNK * DIM)
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]

    def pooled(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over each chunk's positions, and where they are."""
        z = (self.windows(c).reshape(-1, WIDTH * DIM) @ self.p["w"]).reshape(len(c), POSITIONS, FILTERS)
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["b"], 0), at

    def maxima(self, c: np.ndarray) -> np.ndarray:
        return np.maximum((self.windows(c).reshape(-1, WIDTH * DIM) @ self.p["w"]).reshape(len(c), POSITIONS, FILTERS).max(1) + self.p["b"], 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        feature = np.zeros((len(texts), 2 * FILTERS))
        for k, t in enumerate(texts):
            top, total, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0
            whole = chunks(t)
            for lo in range(0, len(whole), 64):
                m = self.maxima(whole[lo : lo + 64])
                top, total, n = np.maximum(top, m.max(0)), total + m.sum(0, dtype=float), n + len(m)
            feature[k] = np.concatenate((top, total / n))
        return 1 / (1 + np.exp(-(feature @ self.p["v"].astype(float) + float(self.p["c"][0]) + self.shift)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> None:
        r = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                batch = order[lo : lo + BATCH]
                parts = [chunks(texts[i]) for i in batch]
                begin = np.cumsum([0, *map(len, parts)])
                c = np.concatenate(parts)
                pool, at = self.pooled(c)
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                d_pool = np.zeros_like(pool)
                for k, i in enumerate(batch):
                    own = pool[begin[k] : begin[k + 1]]
                    top = own.argmax(0)
                    f = np.concatenate((own.max(0), own.mean(0)))
                    err = np.float32(1 / (1 + np.exp(-(f @ self.p["v"] + self.p["c"][0]))) - labels[i]) / len(batch)
                    g["v"] += err * f
                    g["c"] += err
                    d_pool[begin[k] : begin[k + 1]] += err * self.p["v"][FILTERS:] / len(own)
                    d_pool[begin[k] + top, np.arange(FILTERS)] += err * self.p["v"][:FILTERS]
                d_pool *= pool > 0
                g["b"] = d_pool.sum(0)
                where = at * STRIDE  # only the positions of the maxima have a gradient
                for o in range(WIDTH):
                    byte = np.take_along_axis(c, where + o, 1)
                    e = self.p["e"][byte]
                    rows = slice(o * DIM, (o + 1) * DIM)
                    g["w"][rows] = np.einsum("nf,nfd->df", d_pool, e)
                    np.add.at(g["e"], byte.ravel(), (d_pool[:, :, None] * self.p["w"][rows].T[None]).reshape(-1, DIM))
                step += 1
                now = rate * (1 - 0.8 * epoch / epochs)
                for k in self.p:
                    if k == "v":
                        g[k] = g[k] + np.float32(1e-4) * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def offset(logits: np.ndarray, labels: np.ndarray, least: float) -> float:
    """What to add to the logits so that probability ``least`` keeps all but LOST of label 1 and few of label 0. Between
    cuts that do equally well the middle one is taken."""
    z = np.unique(logits)
    cuts = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    good, bad = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    lost, caught = np.searchsorted(good, cuts) / len(good), np.searchsorted(bad, cuts) / len(bad)
    worth = np.where(lost <= LOST, caught - lost, -1.0)
    best = cuts[worth >= worth.max() - 1e-12]
    return float(np.log(least / (1 - least)) - (best[0] + best[-1]) / 2)


def fit(rows: list[tuple[int, str, int]], share: float | None, least: float = 0.3) -> Net:
    """``share``: of label 1 among all labelled rows, None if there are none."""
    net = Net()
    labels = np.array([r[2] for r in rows], float)
    if share is None or not len(rows) or labels.min() == labels.max():
        net.constant = 1.0 if share is None else share
        return net
    texts = [r[1].encode() for r in rows]
    back = np.zeros(len(rows), bool)
    for v in (0, 1):  # identifiers are in order, so this is a fixed choice
        back[np.flatnonzero(labels == v)[::HELD]] = True
    fitted = min(labels[back].sum(), (1 - labels[back]).sum()) >= FEWEST
    own = np.flatnonzero(~back) if fitted else np.arange(len(rows))
    net.p["v"][:] = np.random.default_rng(6).normal(0, 0.1, 2 * FILTERS)
    net.train([texts[i] for i in own], labels[own], min(MOST_EPOCHS, max(EPOCHS, -(-STEPS // -(-len(own) // BATCH)))))
    if fitted:
        p = np.clip(net.score([texts[i] for i in np.flatnonzero(back)]), 1e-12, 1 - 1e-12)
        net.shift = offset(np.log(p / (1 - p)), labels[back], least)
    else:
        drawn = labels.mean()
        net.shift = float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return net


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE, least: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted; ``keep`` adds columns of ``docs`` as struct ``row``."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.struct(*keep).alias("row")] if keep else []))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = y.agg(F.avg("y")).first()[0]
    net = docs.sparkSession.sparkContext.broadcast(fit(bounded(d.select("doc_id", "text"), "y", sample, LONGEST, labels=y), share, least))  # a fixed size

    def predict(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(2).field(keep.index(text)) if inside else part.column(2)
                p = net.value.score([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= least).astype(np.int32)), *part.columns[2 if inside else 3 :]], names=names)

    names = ["doc_id", "held_out", "score", "predicted", *(["row"] if keep else [])]
    inside = text in keep and docs.schema[text].dataType == StringType()  # then the text need not travel twice
    asked = d.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), *([] if inside else ["text"]), *(["row"] if keep else []))
    schema = "doc_id long, held_out boolean, score double, predicted int"
    if keep:
        schema = StructType.fromDDL(schema).add(asked.schema["row"])
    return asked.mapInArrow(trimmed(predict), schema)
