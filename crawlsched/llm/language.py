"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order four over lower-case letters (all else is one blank, runs are one). The n-grams of
all languages stand in one sorted array of hashes per order, beside a matrix of log probabilities, a column for each
language; a second pair of arrays holds the contexts and their interpolation weights, for n-grams that no language has
seen. A text gets the language of the lowest cross-entropy per character, over the whole text. The score is the
posterior at a temperature fitted on sampled rows held back from the counts; ``rejected`` marks texts whose
cross-entropy lies above what 99.9 % of the held-back rows of the language reach.

The models are fitted on a bounded sample (see ``sample``): SAMPLE texts of each language, none over LONGEST characters.
Texts are predicted whole: a very long one is read in pieces of PIECE characters, each with the last symbols before it.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any training row all are; rows
with a null language are predicted but not learned from; repeated rows are predicted alike; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsched.llm.sample import bounded
from crawlsched.llm.shared import fold
from crawlsched.llm.textarrays import trimmed

ORDER = 4
SAMPLE = 600
LONGEST = 20_000
PIECE = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(99)
_SALT = _RNG.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _lower(i: int) -> int:
    c = chr(i)
    return 0 if not c.isalpha() else ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 1 << 16 else i


_LETTER = np.array([0 if 0xD800 <= i < 0xE000 else _lower(i) for i in range(1 << 16)], np.int64)


def mapped(text: str) -> np.ndarray:
    """The symbol of each character (0: blank)."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _LETTER[np.minimum(cp, 0xFFFF)]
    if len(cp) and cp.max() > 0xFFFF:
        far = np.flatnonzero(cp > 0xFFFF)
        s = s.copy()
        s[far] = [int(x) if chr(int(x)).isalpha() else 0 for x in cp[far]]
    return s


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts (runs of blanks are one), each text led by a blank; where each text begins; which have a letter."""
    parts, n = [], []
    for t in texts:
        s = np.concatenate(([0], mapped(t or "")))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        parts.append(s)
        n.append(len(s))
    begin = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), begin, np.array([bool(p.any()) for p in parts], bool)


def grams(sym: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-, ..., ORDER-grams that end at each position; before a text stand blanks."""
    value = _SALT[sym & 0xFFFF] + (sym >> 16).astype(np.uint64)
    place = np.arange(len(sym)) - np.repeat(begin, np.diff(begin, append=len(sym)))
    out = [value]
    for k in range(1, ORDER):
        back = np.full(len(sym), _SALT[0])
        back[k:] = value[:-k] if k else value
        back[place < k] = _SALT[0]
        out.append(out[-1] + back * _M ** np.uint64(k))
    return out


class Table:
    """A sorted array of hashes with an index over the leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(1, min(20, int(len(keys)).bit_length() + 2))
        self.start = np.searchsorted(keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.start).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == h, at, -1)
        for step in range(1, self.deepest):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            place = np.minimum(at[open_] + step, len(self.keys) - 1)
            hit = self.keys[place] == h[open_]
            out[open_[hit]] = place[hit]
        return out


class Model:
    def __init__(self, languages: list[str], texts: dict[str, list[str]], held: dict[str, list[str]]):
        self.languages = languages
        n = len(languages)
        counts, alphabet = [], set()
        for lang in languages:
            sym, begin, _ = symbols(texts[lang])
            g = grams(sym, begin)
            use = np.ones(len(sym), bool)
            use[begin] = False  # the leading blank is context only
            rows = np.stack([x[use] for x in g], 1) if len(sym) else np.zeros((0, ORDER), np.uint64)
            context = [np.concatenate((np.zeros(1, np.uint64), x[:-1]))[use] if len(x) else x for x in g]
            # distinct 4-grams with their shorter suffixes, and the contexts (k-grams one position before)
            _, first, c = np.unique(rows[:, ORDER - 1], return_index=True, return_counts=True)
            counts.append((rows[first], [x[first] for x in context], c))
            alphabet |= set(np.unique(sym).tolist())
        self.size = len(alphabet) + 1
        self.prob: list[Table] = []
        self.back: list[Table | None] = [None]
        floor = np.full(n, 1 / self.size)
        lower: Table | None = None
        for k in range(1, ORDER + 1):
            per = []
            for rows, context, c in counts:
                if k == ORDER:
                    g, first, m = rows[:, k - 1], np.arange(len(rows)), c.astype(float)
                else:  # how many different symbols stand before the k-gram
                    wide = np.unique(np.stack((rows[:, k - 1], rows[:, k]), 1), axis=0)
                    g, m = np.unique(wide[:, 0], return_counts=True)
                    first = np.unique(rows[:, k - 1], return_index=True)[1]
                    m = m.astype(float)
                ctx = context[k - 2][first] if k > 1 else np.zeros(len(g), np.uint64)
                suffix = rows[first, k - 2] if k > 1 else None
                n1, n2 = (m == 1).sum(), (m == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                cs, inv = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(inv, weights=m, minlength=len(cs)), np.bincount(inv, minlength=len(cs))
                per.append((g, ctx, suffix, np.maximum(m - d, 0) / np.maximum(total[inv], 1e-9), cs, d * kinds / np.maximum(total, 1e-9)))
            keys = np.unique(np.concatenate([p[0] for p in per]))
            ctxs = np.unique(np.concatenate([p[4] for p in per]))
            weight = np.ones((len(ctxs), n))
            direct, of = np.zeros((len(keys), n)), np.zeros(len(keys), np.int64)
            below = np.empty((len(keys), n))
            for j, (g, ctx, suffix, share, cs, w) in enumerate(per):
                at = np.searchsorted(keys, g)
                direct[at, j] = share
                of[at] = np.searchsorted(ctxs, ctx)
                weight[np.searchsorted(ctxs, cs), j] = w
                below[at] = floor if k == 1 else lower.values[lower.find(suffix)]
            if k == 1:
                floor = weight[0] * floor
            values = direct + weight[of] * below
            lower = Table(keys, values)
            self.prob.append(lower)
            if k > 1:
                self.back.append(Table(ctxs, weight))
        self.floor = np.log(np.maximum(floor, 1e-12)).astype(np.float32)
        for t in [*self.prob, *self.back[1:]]:
            t.values = np.log(np.maximum(t.values, 1e-12)).astype(np.float32)
        own = {lang: self.entropies(held[lang] or texts[lang])[0][:, j] for j, lang in enumerate(languages)}
        self.limit = np.array([np.quantile(x, 0.999) if len(x) else np.inf for x in own.values()])
        e = np.concatenate([self.entropies(held[lang] or texts[lang])[0] for lang in languages])
        y = np.concatenate([np.full(len(held[lang] or texts[lang]), j) for j, lang in enumerate(languages)])
        def loss(t: float) -> float:
            z = -e * t
            z -= z.max(1, keepdims=True)
            return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean())

        self.temperature = min((0.5, 1, 2, 4, 8, 16, 32, 64), key=loss)

    def log_prob(self, g: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(g[0]), len(self.languages)), np.float32)
        open_ = np.arange(len(g[0]))
        for k in range(ORDER, 0, -1):
            at = self.prob[k - 1].find(g[k - 1][open_])
            hit = at >= 0
            out[open_[hit]] += self.prob[k - 1].values[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            if k > 1:
                before = np.maximum(open_ - 1, 0)
                at = self.back[k - 1].find(g[k - 2][before])
                hit = (at >= 0) & (open_ > 0)
                out[open_[hit]] += self.back[k - 1].values[at[hit]]
        out[open_] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character in each language, and which texts have a letter."""
        n = len(self.languages)
        out, letters = np.zeros((len(texts), n)), np.zeros(len(texts), bool)
        i = 0
        while i < len(texts):  # about a million characters at once
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") < 1 << 18):
                size += len(texts[j] or "")
                j += 1
            if size > 4 * PIECE:  # one very long text
                before, total, many = np.zeros(1, np.int64), np.zeros(n), 0
                for at in range(0, size, PIECE):
                    s = np.concatenate((before[-1:], mapped(texts[i][at : at + PIECE])))
                    s = s[1:][(s[1:] != 0) | (s[:-1] != 0)]
                    sym = np.concatenate((before, s))
                    total += self.log_prob(grams(sym, np.zeros(1, np.int64)))[len(before) :].sum(0, dtype=float)
                    many, letters[i], before = many + len(s), letters[i] or bool(s.any()), sym[1 - ORDER :]
                out[i] = -total / max(many, 1)
            else:
                sym, begin, letters[i:j] = symbols(texts[i:j])
                lp = self.log_prob(grams(sym, begin))
                lp[begin] = 0
                out[i:j] = -np.add.reduceat(lp, begin, axis=0, dtype=float) / np.maximum(np.diff(begin, append=len(sym)) - 1, 1)[:, None]
            i = j
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        e, letters = self.entropies(texts)
        best = e.argmin(1)
        z = -e * self.temperature
        p = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        low = e[np.arange(len(e)), best]
        names = [self.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)]
        return names, np.where(letters, p, 0.0), np.where(letters, low, 0.0), ~letters | (low > self.limit[best])


def fit(rows: list[tuple[int, str, str]]) -> Model | None:
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    by = {lang: [t for _, t, x in rows if x == lang] for lang in languages}
    return Model(languages, {k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in by.items()}, {k: [t for i, t in enumerate(v) if i % 5 == 0] for k, v in by.items()})


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    learn = d.filter(fold(F.col("doc_id"), folds) != 0)
    model = docs.sparkSession.sparkContext.broadcast(fit(bounded(learn, "lang", sample, LONGEST)))  # bounded by the sample

    def predict(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = part.column(2).to_pylist()
                names, p, e, far = model.value.predict(texts) if model.value else (["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(p), pa.array(e), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return d.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text").mapInArrow(trimmed(predict), "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
