"""The ten operators and the pipeline: defined cases, brute force, round trips and held-out accuracy on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlsched.llm import byte_cnn, katz, language, mixing, neardup, packing, pii, quality_rules, queries, sample, topk, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30_000))
#: Nulls in any column, empty and blank texts, a very long one, repeated rows, ties, a repeated identifier.
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \n\t ", "en", None, 4, "x"), (4, LONG, "de", "b", 1, "x"), (5, "one two", "en", "a", 7, "x"), (5, "one two", "en", "a", 7, "x"), (None, "no identifier here", None, "a", 3, "x"), (None, None, None, None, None, None), (6, "\U0001f600 Ünïcödé\r\n" * 3, "en", "c", 9, "x"), (7, "one two", "fr", "c", 7, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


# 1


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_quality_rules(spark, docs, odd, none, labels):
    trusted = labels.filter("quality = 1")
    out = quality_rules.judge(docs, trusted).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
    grams = {r.doc_id: r.g for r in quality_rules.hashed(docs, "text").select("doc_id", F.col("_grams").alias("g")).collect()}
    good = {r.doc_id for r in trusted.collect()}
    n, g = Counter(), Counter()
    for k, v in grams.items():
        n.update(v)
        g.update(v if k in good else [])
    b = quality_rules.BUCKETS
    raw = lambda x: (n[x] + 1) / (n.total() + b)
    ratio = lambda x: math.log((g[x] + b * raw(x)) / (g.total() + b) / raw(x))
    for r in out:
        want = sum(map(ratio, grams[r.doc_id])) / max(1, len(grams[r.doc_id]))
        assert r.llr == pytest.approx(want, abs=1e-5) and (r.kept == (not r.base_failed and r.llr >= quality_rules.LEAST) or abs(want - quality_rules.LEAST) < 1e-5)
    got = quality_rules.judge(odd, trusted).collect()
    assert len(got) == len(ODD) and quality_rules.judge(none, trusted).count() == 0
    assert all(r.kept is False for r in got if r.n_words == 0) and quality_rules.judge(odd).count() == len(ODD)
    assert Counter(base(x[1])[:5] for x in ODD) == Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)


# 2 and 8


def test_language(spark, docs, odd, none):
    out = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    own = [r for r in out if r.held_out]
    assert all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in own) / len(own) >= 0.95
    got = language.identify(docs.unionByName(odd, allowMissingColumns=True).filter("doc_id is null or doc_id < 50")).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id is None and r.cross_entropy == 0)
    assert {r.lang_pred for r in language.identify(odd).filter("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert language.identify(none).count() == 0


def test_a_very_long_text_is_read_as_a_whole(monkeypatch):
    """Pieces with the symbols before them give the entropy of the whole, wherever they are cut."""
    m = language.fit([(i, t, lang) for i in range(5) for t, lang in (("the cat sat on the mat, and so on", "en"), ("der Hund lief über die Straße, ja", "de"))])
    rng = random.Random(4)
    text = "".join(rng.choice("the mat der Straße   12,,\n\U0001f600\U00010400") for _ in range(3000))
    whole = m.entropies([text])[0]
    for piece in (1, 2, 3, 7, 100, 599):
        monkeypatch.setattr(language, "PIECE", piece)
        got, letters = m.entropies([text])
        assert got == pytest.approx(whole, rel=1e-12) and letters[0]


def test_kneser_ney_by_hand(spark):
    """Probabilities of the recursion written out over plain counts."""
    texts = ["abab cab", "bca bab", "cabba", "aab bcc", "ccab a"] * 3
    m = language.fit([(i, t, "en") for i, t in enumerate(texts)])
    train = [t for i, t in enumerate(texts) if i % 5]
    order, full = language.ORDER, Counter()
    for t in train:
        s = "#" * order + t.replace(" ", "#")
        full.update(s[i - order + 1 : i + 1] for i in range(order, len(s)))
    level = {order: full}
    for k in range(order - 1, 0, -1):
        level[k] = Counter({g: len(v) for g, v in [(g, {w[0] for w in level[k + 1] if w[1:] == g}) for g in {w[1:] for w in level[k + 1]}]}) if k + 1 == order else Counter({g: len({w[order - k - 1] for w in full if w.endswith(g)}) for g in {w[-k:] for w in full}})
    alphabet = {c for t in train for c in t.replace(" ", "#")} | {"#"}

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(alphabet) + 1)
        c = level[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = {w: v for w, v in c.items() if w[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        return max(own.get(g, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(g[1:])

    for text in ("abab", "bcab", "cc aab", "abc"):
        s = "#" * order + text.replace(" ", "#")
        want = [math.log(p(s[i - order + 1 : i + 1])) for i in range(order, len(s))]
        got = m.log_prob(language.grams(*language.symbols([text])[:2]))[1:, 0]
        assert got.tolist() == pytest.approx(want, abs=1e-5)


def test_kneser_ney_adds_up():
    """After any context the probabilities of all symbols add up to one."""
    m = language.fit([(i, t, "en") for i, t in enumerate(["abab cab", "bca bab", "cabba", "aab bcc", "ccab a"] * 3)])
    assert m.languages == ["en"]
    for context in ("ab", "c", "zz", ""):  # the four known symbols, and one that stands for all unknown ones
        last = [m.log_prob(language.grams(*language.symbols([context + c])[:2]))[-1, 0] for c in ("a", "b", "c", " ", "z") if context or c != " "]
        if context:
            assert sum(math.exp(float(x)) for x in last) == pytest.approx(1, abs=1e-4)
    e, letters = m.entropies(["abab", "zzzz", "", "12"])
    assert letters.tolist() == [True, True, False, False] and e[0, 0] < e[1, 0]


def test_classifier(spark, docs, odd, none, labels):
    out = byte_cnn.classify(docs, labels).collect()
    y = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out) and len(out) == docs.count()
    good, bad = ([r.score for r in out if y.get(r.doc_id) == v] for v in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.8
    assert [r.score for r in byte_cnn.classify(docs, labels).orderBy("doc_id").collect()] == [r.score for r in sorted(out, key=lambda r: r.doc_id)]
    got = byte_cnn.classify(odd, labels, keep=("text", "extra"))
    assert got.count() == len(ODD) and byte_cnn.classify(none, labels).count() == 0
    assert len({r.score for r in byte_cnn.classify(odd, labels.filter("quality = 1")).collect()}) == 1


def test_offset_keeps_label_one():
    z, y = byte_cnn.np.array([-3.0, -2.0, 1.0, 5.0, 6.0, 7.0]), byte_cnn.np.array([0, 0, 0, 1, 1, 1])
    assert z[3] + byte_cnn.offset(z, y, 0.3) > math.log(0.3 / 0.7) > z[2] + byte_cnn.offset(z, y, 0.3)
    z[2] = 6.5  # a row of label 0 among those of label 1 is let through
    assert z[3] + byte_cnn.offset(z, y, 0.3) > math.log(0.3 / 0.7) > z[1] + byte_cnn.offset(z, y, 0.3)


def test_held_out_rows_of_low_quality_are_rejected(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = [r for r in byte_cnn.classify(d, y).join(y.select("doc_id", "quality"), "doc_id").filter("held_out and quality is not null").collect()]
    bad, good = ([r.predicted for r in got if r.quality == v] for v in (0, 1))
    assert sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.95 * len(good)


def test_classifier_by_hand():
    """The network's score of texts of several chunks, byte by byte."""
    net = byte_cnn.Net()
    r = random.Random(2)
    net.p["v"][:] = [r.uniform(-1, 1) for _ in net.p["v"]]
    net.shift = 0.25
    for text in (b"", b"abc", bytes(r.randrange(256) for _ in range(1300))):
        n = max(1, -(-(len(text) - byte_cnn.OVERLAP) // byte_cnn.STEP))
        padded, tops = text + bytes((n - 1) * byte_cnn.STEP + byte_cnn.CHUNK - len(text)), []
        for k in range(n):
            chunk = padded[k * byte_cnn.STEP : k * byte_cnn.STEP + byte_cnn.CHUNK]
            best = [0.0] * byte_cnn.FILTERS
            for at in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
                x = [v for b in chunk[at : at + byte_cnn.WIDTH] for v in net.p["e"][b]]
                for f in range(byte_cnn.FILTERS):
                    best[f] = max(best[f], sum(float(a) * float(w) for a, w in zip(x, net.p["w"][:, f], strict=True)) + float(net.p["b"][f]))
            tops.append(best)
        feature = [max(c) for c in zip(*tops, strict=True)] + [sum(c) / n for c in zip(*tops, strict=True)]
        z = sum(a * float(w) for a, w in zip(feature, net.p["v"], strict=True)) + float(net.p["c"][0]) + 0.25
        assert net.score([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_bounded_sample(spark):
    rows = [(i, f"t{i}", "a" if i % 50 else "b") for i in range(5000)] + [(7, "t7", "a")] * 500 + [(9, None, "a"), (None, "x", "a"), (8, "t" * 300, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sample.bounded(d, "lang", 60, 100)
    assert Counter(r[2] for r in got) == {"a": 60, "b": 60} and len(set(got)) == len(got) == 120
    assert sample.bounded(d.repartition(9), "lang", 60, 100) == got
    y = d.filter("doc_id is not null").groupBy("doc_id").agg(F.max("lang").alias("y"))
    both = sample.bounded(d.drop("lang"), "y", 60, 100, labels=y)
    assert Counter(r[2] for r in both) == {"a": 60, "b": 60} and len(set(both)) == 120
    assert len(sample.bounded(d, "lang", 10_000, 100)) == 5000 and sample.bounded(d.limit(0), "lang", 5, 100) == []


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        c = byte_cnn.chunks(bytes([7]) * n)
        assert sum((x == 7).sum() for x in c) >= n and c.shape[1] == byte_cnn.CHUNK


# 3


class Near:
    """The rule by brute force: weighted Jaccard of the shingle counts of two texts."""

    def __init__(self, rows):
        self.bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := WORD.findall(t or "")) else Counter() for i, t in rows}
        n, df = sum(t is not None for _, t in rows), Counter(g for b in self.bags.values() for g in b)
        self.idf = {g: 1.0 if f <= 0.01 * n else 0.6 + 0.4 * math.log(n / f) / math.log(100) for g, f in df.items()}

    def __call__(self, a, b):
        x, y = self.bags[a], self.bags[b]
        both = sum(min(x[g], y[g]) * self.idf[g] for g in x.keys() & y.keys())
        return both / (sum(c * self.idf[g] for bag in (x, y) for g, c in bag.items()) - both) if both else 0.0

    def classes(self, rows):
        name, by = {i: i for i in self.bags}, defaultdict(set)
        for i, x in self.bags.items():
            for g in x:
                by[g].add(i)
        find = lambda i: i if name[i] == i else find(name[i])
        for a in self.bags:
            for b in {j for g in self.bags[a] for j in by[g] if j > a}:
                if self(a, b) >= 0.8:
                    x, y = sorted((find(a), find(b)))
                    name[y] = x
        same = defaultdict(list)
        for i, t in rows:
            if t is not None:
                same[t].append(find(i))
        for g in same.values():  # equal texts without words
            for x in g:
                x, y = sorted((find(x), find(g[0])))
                name[y] = x
        return {i: find(i) for i in self.bags}


def test_near_duplicates(spark, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == Near(rows).classes(rows)
    got = {(r.doc_id, r.class_id) for r in neardup.classes(odd).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 5), (None, None)}
    kept = neardup.representatives(odd.withColumn("_id", F.lit("mine")).withColumn("node", F.lit("own")))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6] and {(r._id, r.node) for r in kept.collect()} == {("mine", "own")}
    assert neardup.classes(none).count() == 0 and neardup.representatives(none).count() == 0


def test_near_duplicates_of_more_documents(spark):
    """At sf0.01, links found by banding against all pairs of the rule."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, got = Near(rows).classes(rows), {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    merged = [i for i in want if want[i] != i]
    assert merged and sum(got[i] == got[want[i]] for i in merged) >= 0.95 * len(merged)
    assert all(want[i] == want[got[i]] for i in got)


def test_pairs_from_one_template(spark):
    """Buckets full of documents that are near one other document each, and below the bound to all the rest."""
    body, rows = [f"t{k}" for k in range(400)], []
    for i in range(400):
        rows.append((i, " ".join([*body, *(f"p{i // 2}x{k}" for k in range(15)), *(f"o{i}x{k}" for k in range(20))])))
    near = Near(rows)
    assert min(near(i, i + 1) for i in range(0, 400, 2)) >= 0.8 > max(near(0, j) for j in range(2, 400))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_a_chain_and_a_large_group_of_near_copies(spark):
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, f"tail{i}"])) for i in range(300)] + [(1000 + i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(d).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(50))


def test_copies_that_are_near_their_original_only(spark):
    """Each copy is similar to the original, no two copies to each other unless they agree by chance; no leader need be
    the original."""
    rng = random.Random(3)
    words = [f"o{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 1500):
        at = {10 + 60 * k + rng.randrange(50) for k in range(3)}
        rows.append((i, " ".join(f"n{i}x{k}" if k in at else w for k, w in enumerate(words))))
    near = Near(rows)
    assert all(near(0, i) >= 0.8 for i in range(1500)) and near(1, 2) < 0.8
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in neardup.classes(d).collect()} == {0}


def test_texts_that_share_a_number(spark):
    """Different texts of one hash get numbers of their own."""
    text = F.col("text")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    h = rows.select(neardup.number(text, []).alias("n")).collect()
    again = rows.select(neardup.number(text, [h[0].n]).alias("n")).collect()
    assert again[0].n != h[0].n and again[1].n == h[1].n and again[2].n is None


# 4


def test_pseudonyms(spark, odd, none):
    texts = ["mail joe.doe@example.com now", "again joe.doe@example.com", "card 4111 1111 1111 1111.", "bad card 4111 1111 1111 1112", "born 1990-02-28 and 28/02/1990", "not 1990-02-30", "ip 10.20.30.40, not 300.1.1.1", "ssn 123-45-6789", "call +1 (555) 123-4567", None, "", "no values, 12 of them"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(d, found="n").orderBy("doc_id").collect()]
    shape = lambda t: re.sub(r"[0-9]", "0", re.sub(r"[a-z]+(?:[.][a-z0-9]+)*@", "a@", t))
    assert out[3] == texts[3] and out[5] == texts[5] and out[9:] == texts[9:]
    first, second = (re.search(r"\S+@example\.com", out[i])[0] for i in (0, 1))
    assert first == second != "joe.doe@example.com" and len(first) == len("joe.doe@example.com")
    for i in (2, 7):
        assert out[i] != texts[i] and shape(out[i]) == shape(texts[i])
    number = [int(c) for c in out[2] if c.isdigit()]
    assert sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(number)) % 10 == 0
    assert re.fullmatch(r"born \d{4}-[01]\d-[0-3]\d and [0-3]\d/[01]\d/\d{4}", out[4]) and out[4] != texts[4]
    assert "300.1.1.1" in out[6] and "10.20.30.40" not in out[6]
    assert out[8].startswith("call +1 (5") and out[8] != texts[8]
    assert [r.text for r in pii.pseudonymise(d).orderBy("doc_id").collect()] == out
    other = pii.pseudonymise(odd)
    assert other.columns == odd.columns and other.count() == len(ODD) and pii.pseudonymise(none).count() == 0


def test_cards_beside_numbers_and_short_addresses(spark):
    texts = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 08/27", "card 1 4111111111111111", "card 4111 1111 1111 1111", "j@example.com", "4111 1111 1111 1112 123"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(d).orderBy("doc_id").collect()]
    number = out[3][5:]
    assert number != "4111 1111 1111 1111" and out[:3] == [number + " 123", number + " 08/27", "card 1 " + number.replace(" ", "")]
    assert re.fullmatch(r"[a-z]@example\.com", out[4]) and out[4] != texts[4] and out[5] == texts[5]


KINDS = [
    "Joe.Doe@example.com", "joe.doe@example.com", "a@b.com", "j_99@mail.example.org", "7@x.io", "token: 0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef", "password: DEADBEEFDEADBEEFAA12", 'api_key = "00ffAA11bbCC22dd33', "secret=1234567890123456",
    "10.20.30.40", "192.168.0.1", "1990-02-28", "2199-12-31", "28/02/1990", "02/28/1990", "31.12.1999", "12.31.1999", "123-45-6789", "899-99-9999", "667-01-0001", "(555) 123-4567", "555-123-4567", "+1 (555) 123-4567",
    "+44 20 7946 0958", "+442079460958", "phone: 5551234567", "Tel. 5551234567", "4111 1111 1111 1111", "4111111111111111", "378282246310005", "4111 1111 1111 1111 123", "card 1 4111111111111111", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606 XY", "6304 0000 0000 0000 125",
]
LEFT = ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "010.001.1.1", "300.1.1.1", "1990-02-30", "45/45/1990", "1799-12-31", "GB83 WEST 1234 5698 7654 32", "5551234567", "4111 1111 1111 1112", "+1 22", "version 1.2.3", "@ 12"]


def test_every_kind_is_replaced_and_comes_back(spark):
    rows = [(k, f"see {t} there") for k, t in enumerate(KINDS)] + [(1000 + k, t) for k, t in enumerate(LEFT)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for key in ("a", "b", pii.KEY):
        out = pii.pseudonymise(d, key=key)
        got = {r.doc_id: r.text for r in out.collect()}
        for k, t in enumerate(KINDS):
            shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
            assert got[k] != rows[k][1] and (t[0] in "1" or shape(got[k]) == shape(rows[k][1])), (t, got[k])
        assert all(got[1000 + k] == t for k, t in enumerate(LEFT))
        assert {r.doc_id: r.text for r in pii.invert(out, key=key).collect()} == dict(rows)
    luhn = lambda s: sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate([int(c) for c in s if c.isdigit()][::-1])) % 10 == 0
    assert all(luhn(got[KINDS.index(c)]) for c in ("4111 1111 1111 1111", "378282246310005"))
    iban = got[KINDS.index("DE89370400440532013000")].split()[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE"
    area, group, serial = (int(x) for x in got[KINDS.index("123-45-6789")].split()[1].split("-"))
    assert 0 < area < 900 and area != 666 and group and serial


def test_documents_come_back(spark, docs):
    """Over a whole table, with columns whose names the operator might use itself."""
    d = docs.withColumn("_new", F.lit("mine")).withColumn("_matches", F.lit(1)).withColumn("_parts", F.col("text"))
    out = pii.pseudonymise(d, found="n")
    assert out.columns == [*d.columns, "n"] and out.filter("n > 0").count() > 5
    back = pii.invert(out.drop("n"))
    assert sorted(back.collect(), key=lambda r: r.doc_id) == sorted(d.collect(), key=lambda r: r.doc_id)
    assert out.filter("(n > 0) = (text <=> _parts)").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(d, found="_new")


def test_feistel_permutes(spark):
    """All two-digit lists have different images, and so have all days of some years."""
    d = spark.range(100).select(pii.Keyed("k").feistel(F.array((F.col("id") / 10).cast("int"), (F.col("id") % 10).cast("int")), 10, "t").alias("x"))
    assert len({tuple(r.x) for r in d.collect()}) == 100
    days = spark.range(1000).select(pii.Keyed("k").day(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int"))).alias("d"))
    assert len({r.d for r in days.collect()}) == 1000


# 5


def best(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    # A query repeated under one identifier: its smallest vector after rounding.
    for q, v in sorted({i: v for i, v in sorted(ok, reverse=True) if i % every == 0}.items()):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def test_topk(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = best([(r.vec_id, r.embedding) for r in e.collect()], 5, 50)
    assert sorted(tuple(r) for r in topk.topk(e, 5, 50).collect()) == want
    rows = [(0, [0.5, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (50, [1.0]), (6, [-1.0, -1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.topk(d, 5, 50)
    assert sorted(tuple(r) for r in got.collect()) == best(rows, 5, 50)
    odd = [(50, [None, 5.0]), (50, [0.5, 1.0]), (0, [0.001, 5.0]), (0, [0.002, 1.0]), (1, [1.0, 1.0]), (2, [-0.5, 3.0]), (3, []), (100, None), (150, [float("inf"), 1.0])]
    d2 = spark.createDataFrame([(i, v, "x", 1) for i, v in odd], "vec_id long, embedding array<float>, score string, query_id int")
    assert sorted(tuple(r) for r in topk.topk(d2, 3, 50).collect()) == best(odd, 3, 50)
    # Queries in several batches and vectors in many blocks give the same.
    assert sorted(tuple(r) for r in topk.topk(e.repartition(7), 5, 50, batch_bytes=512).collect()) == want
    assert topk.topk(d.limit(0), 5, 50).count() == 0 and topk.topk(d.filter("vec_id = 0"), 5, 50).count() == 0


def test_topk_of_repeated_block_sparse_rows(spark):
    """Scores in few slices, rows repeated under one identifier, and unlike rows of one identifier."""
    rng = random.Random(1)
    rows = []
    for i in range(200):
        at = 4 * rng.randrange(4)
        v = [rng.randint(0, 256) / 256 if i % 100 == 0 or at <= k < at + 4 else 0.0 for k in range(16)]
        rows += [(i, v)] * rng.choice((2, 3))
    rows += [(7, [v[0] + 2.0, v[1] - 1.0, *v[2:]]) for _, v in rows[:1]] + [(7, v) for _, v in rows[:1]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.topk(d, 5, 100).collect()) == best(rows, 5, 100)


# 6


def good_turing(seen):
    """Katz's discounts of counts 1 to 5, from a line through the logarithms of smoothed counts of counts where the raw
    ones do not serve; None where the line does not either."""
    n = [sum(c == r for c in seen.values()) for r in range(1, 7)]

    def ratios(f):
        g = 6 * f(6) / f(1)
        return [((r + 1) * f(r + 1) / (r * f(r)) - g) / (1 - g) for r in range(1, 6)] if g < 1 else [9.0]

    d = ratios(lambda r: n[r - 1]) if all(n) else [9.0]
    if not all(0 < x < 1 for x in d):
        full = [r for r in range(1, 7) if n[r - 1]]
        z = [(math.log(r), math.log(n[r - 1] / (0.5 * ((full[k + 1] if k + 1 < len(full) else 2 * r - full[k - 1]) - (full[k - 1] if k else 0))))) for k, r in enumerate(full)]
        mx, my = sum(a for a, _ in z) / len(z), sum(b for _, b in z) / len(z)
        slope = sum((a - mx) * (b - my) for a, b in z) / sum((a - mx) ** 2 for a, _ in z)
        d = ratios(lambda r: r**slope) if slope < -1 else [9.0]
    return [0.0, *d] if all(0 < x < 1 for x in d) else None


def katz_by_hand(rows, folds):
    tokens = {i: [*WORD.findall(lowered(t or "")), None] for i, t in rows}
    train = [t for i, t in tokens.items() if not held(i, folds)]
    one, two, hist = Counter(), Counter(), Counter()
    for t in train:
        one.update(t)
        pairs = list(zip([None, *t[:-1]], t, strict=True))
        two.update(pairs)
        hist.update(h for h, _ in pairs)
    d1, d2 = good_turing(one), good_turing(two)
    cut = lambda c, d: c * (d[c] if c <= katz.LARGE else 1.0)
    n = one.total()
    unknown = 1 - sum(cut(c, d1) for c in one.values()) / n
    p1 = lambda w: cut(one[w], d1) / n if one[w] else unknown
    after = defaultdict(list)
    for h, w in two:
        after[h].append(w)
    weight = {}
    for h, ws in after.items():
        lost = hist[h] - sum(cut(two[h, w], d2) for w in ws)
        whole = hist[h] if lost > 1e-9 else hist[h] + 0.5
        weight[h] = whole, max(lost if lost > 1e-9 else 0.5, 0) / whole / (1 - sum(p1(w) for w in ws))

    def p(h, w):
        if h not in weight:
            return p1(w)
        return cut(two[h, w], d2) / weight[h][0] if two[h, w] else weight[h][1] * p1(w)

    return {i: (len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in t), sum(math.log10(p(h, w)) for h, w in zip([None, *t[:-1]], t, strict=True))) for i, t in tokens.items()}, p, p1, one, unknown


def test_katz_of_order_three(spark, docs):
    """The recursion written out over plain counts."""
    rows = [(r.doc_id, r.text) for r in docs.filter("length(text) < 3000 or text is null").collect()]
    tokens = {i: [*WORD.findall(lowered(t or "")), None] for i, t in rows}
    count = {1: Counter(), 2: Counter(), 3: Counter()}
    for i, t in tokens.items():
        if not held(i, 10):
            for k in count:
                count[k].update(tuple(([None] * 2 + t)[j + 3 - k : j + 3]) for j in range(len(t)))
    d = {k: good_turing(c) or [0.0, *(1 - 0.5 / r for r in range(1, 6))] for k, c in count.items()}
    cut = lambda k, c: c * (d[k][c] if c <= 5 else 1.0)
    n, after = count[1].total(), defaultdict(list)
    for k in (2, 3):
        for g in count[k]:
            after[g[:-1]].append(g[-1])
    weight = {}

    def p(h, w):
        if not h:
            return cut(1, count[1][(w,)]) / n if count[1][(w,)] else 1 - sum(cut(1, c) for c in count[1].values()) / n
        if h not in after:
            return p(h[1:], w)
        k = len(h) + 1
        if h not in weight:
            total = sum(count[k][(*h, x)] for x in after[h])
            lost = total - sum(cut(k, count[k][(*h, x)]) for x in after[h])
            whole = total if lost > 1e-9 else total + 0.5
            weight[h] = whole, (lost if lost > 1e-9 else 0.5) / whole / (1 - sum(p(h[1:], x) for x in after[h]))
        return cut(k, count[k][(*h, w)]) / weight[h][0] if count[k][(*h, w)] else weight[h][1] * p(h[1:], w)

    d3 = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (katz.HOT_TOKENS, 3):
        for r in katz.score(d3, order=3, hot_tokens=hot).collect():
            t = [None, None, *tokens[r.doc_id]]
            assert r.score == pytest.approx(sum(math.log10(p(tuple(t[j : j + 2]), t[j + 2])) for j in range(len(t) - 2)), rel=1e-6)
    words = [g[0] for g in count[1]]
    for h in [(None, None), (None, words[0]), *[g[:2] for g in list(count[3])[:3]]]:
        assert sum(p(h, w) for w in words) + p(h, object()) == pytest.approx(1, abs=1e-9)


def test_katz(spark, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, p, p1, one, unknown = katz_by_hand(rows, 10)
    for r in katz.score(docs, order=2).collect():
        n, known, train, base_, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, held(r.doc_id, 10))
        assert r.base_score == pytest.approx(base_, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)
    for h in [None, *list(one)[:5]]:  # exactly normalised
        assert sum(p(h, w) for w in one) + p(h, object()) == pytest.approx(1, abs=1e-9)
    # With every history of over 3 tokens split over partitions the scores are the same.
    split = {r.doc_id: r.score for r in katz.score(docs, order=2, hot_tokens=3).collect()}
    assert all(split[i] == pytest.approx(want[i][4], rel=1e-6) for i in want)
    got = {r.doc_id: r for r in katz.score(odd).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and all(math.isfinite(r.score) for r in got.values())
    assert katz.score(odd).count() == len(ODD) and katz.score(none).count() == 0
    assert katz.score(odd.filter("doc_id = 1")).count() == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_good_turing_is_used(spark, sf):
    """On the given tables the discounts are Good-Turing's, never the fallback of one half."""
    one, two = Counter(), Counter()
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect():
        if not held(r.doc_id, 10):
            t = [*WORD.findall(lowered(r.text or "")), None]
            one.update(t)
            two.update(zip([None, *t[:-1]], t, strict=True))
    for seen in (one, two):
        d = katz.discounts([sum(c == r for c in seen.values()) for r in range(1, 7)])
        assert d == pytest.approx(good_turing(seen)) and d[1] != pytest.approx(0.5)


def test_katz_discounts():
    """Good-Turing ratios of sound counts of counts as they are; of uneven ones (sf0.1's pairs) those of a fitted line."""
    n = [1000, 300, 140, 80, 50, 33]
    over = 6 * n[5] / n[0]
    assert katz.discounts(n)[1:] == pytest.approx([((r + 1) * n[r] / n[r - 1] / r - over) / (1 - over) for r in range(1, 6)])
    n = [1655711, 262472, 56325, 23262, 20048, 8151]
    x, y = [math.log(r) for r in range(1, 7)], [math.log(v) for v in n]
    mx, my = sum(x) / 6, sum(y) / 6
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
    over = 6 ** (slope + 1)
    d = katz.discounts(n)
    assert d[1:] == pytest.approx([((1 + 1 / r) ** (slope + 1) - over) / (1 - over) for r in range(1, 6)])
    assert d[1] < 0.4 and all(0 < a < b < 1 for a, b in zip(d[1:], d[2:], strict=False))
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [5] * 6):
        assert katz.discounts(n)[1:] == pytest.approx([1 - 0.5 / r for r in range(1, 6)])


# 7


def packed_well(out, docs):
    """Pieces, offsets and the number of sequences of packed documents, from the tokenizer itself."""
    from tokenizers import Tokenizer

    tok, want, bins = Tokenizer.from_file(queries.tokenizer()), Counter(), defaultdict(list)
    for r in docs:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[r.doc_id, k // 4096, k, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r.length for r in out) / 4096) + 2


def test_packing(spark, docs, odd, none):
    long = spark.createDataFrame([(1, "word " * 9000), (1, "word " * 9000), (2, "word " * 4095)], "doc_id long, text string")
    for d in (docs, odd, long):
        packed_well(packing.pack_documents(d, queries.tokenizer()).collect(), d.collect())
    assert packing.pack_documents(none, queries.tokenizer()).count() == 0


def test_tokenizer_shortcuts(spark, monkeypatch):
    """Parting, looking up and dealing out give what the tokenizer gives for whole texts."""
    from tokenizers import Tokenizer

    rng, tok = random.Random(9), Tokenizer.from_file(queries.tokenizer())
    signs = list("abcXYZ éßÉÿ×÷ñµªº 019 .,;-'\"!?()[]{}_/\\ \t\n\r\x0b\x1c\x1f\u00a0\u2028\u3000 Σσς e\u0301 ı İ 漢字 \U0001f600 \u00ad don't it's")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "a" * 5000, "é" * 3000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text is not None]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for longest in (packing.LONGEST_PART, 50_000):
        monkeypatch.setattr(packing, "LONGEST_PART", longest)
        ids, begin = packing.WordTokenizer(queries.tokenizer()).encode(*packing.buffers(packing.pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == want


@pytest.mark.parametrize("room", [0, 1, 7, 13, 29])
def test_fullest_is_fullest(room):
    counts = {11: 1, 7: 2, 5: 1, 3: 2}
    every = {0}
    for n, c in counts.items():
        every = {s + n * k for s in every for k in range(c + 1)}
    got = packing.fullest(sorted(counts, reverse=True), counts, room)
    assert sum(got) == max(s for s in every if s <= room) and all(got.count(n) <= counts[n] for n in set(got))


# 9


def test_targets_and_seats():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 300, 3) == [50, 100, 150]
    got = mixing.targets([10, 100, 190], [3, 1, 1], 300, 3)
    assert got == pytest.approx([30, 135, 135])
    assert mixing.targets([1, 1], [1, 1], 100, 3) == [3, 3]
    votes, seats = [53.0, 24.0, 23.0, 0.0], 7
    want = [0] * 4
    for _ in range(seats):
        want[max(range(4), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert mixing.sainte_lague(votes, seats) == want and mixing.sainte_lague([0.0], 3) == [0]


def test_mixing(spark, docs, odd, none):
    out = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.05 * own[0].target, 3 * mixing.BLOCK_WORDS)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    whole = mixing.mix(docs, keep=tuple(docs.columns))
    made = mixing.materialise(whole)
    assert made.columns == docs.columns
    assert made.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == whole.agg(F.sum("taken")).first()[0]
    # Rows that agree in identifier and size are told apart by their text, and extra columns keep their names.
    rows = [(1, f"{c} " * 50 + str(k), "en", "s", 1, c) for k, c in enumerate("abcdefgh")]
    tied = spark.createDataFrame(rows + [(2, "z " * 300, "en", "t", 1, "z")], DOCS)
    taken = [sorted((r.row.text[:1], r.taken, r.part_from) for r in mixing.mix(x, keep=("text", "extra")).collect()) for x in (tied, tied.repartition(5), tied.orderBy(F.desc("text")))]
    assert taken[0] == taken[1] == taken[2]
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(odd).collect() if r.size == 0)


# 10


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 5000 + "x" * 3000
    rows = [(1, "http://a/", "<p>"), (2, None, None), (3, "http://b/ c", big), (9, "u", big), (5, "u", "y" * 1000), (6, "u", "y" * 1000), (6, "u", "y" * 1000), (7, "u", "y" * 999), (8, "u", "y" * 999), (None, "u", big), (10, "u", "a\r\n\r\nWARC/1.1\r\n")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(d, str(tmp_path / "w"), chunk_bytes=1024)
    chunks = warc.read_chunks(spark, str(tmp_path / "w"))
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 1024 and chunks.agg(F.max("chunk")).first()[0] > 10
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digests(chunks).collect())
    top = {big: 9, "y" * 1000: 6}
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        to = top.get(html) if i != top.get(html) else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to] += 1
    assert got == want
    whole = {r.page_id: bytes(r.data).decode() for r in chunks.filter("record_type = 'response' and chunk = 0").collect()}
    assert whole[10] == rows[-1][2] and whole[1] == "<p>"
    warc.write(d.limit(0), str(tmp_path / "e"))
    assert warc.digests(warc.read_chunks(spark, str(tmp_path / "e"))).count() == 0


def test_warc_reader_holds_no_whole_record():
    """A record of 64 MB in one piece comes back in chunks; what the reader holds stays near a chunk."""
    import tracemalloc

    size, piece = 64 << 20, b"0123456789abcdef" * 4096
    whole = hashlib.sha1()
    for _ in range(size // len(piece)):
        whole.update(piece)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5:x>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" % (whole.hexdigest().encode(), size + 19)
    reader, n, count, last = warc.Reader(), 0, 0, None
    tracemalloc.start()
    for data in (head, *[piece] * (size // len(piece)), b"\r\n\r\n"):
        for row in reader.feed(data):
            n, count, last = n + len(row[-1]), count + 1, row
            assert len(row[-1]) <= warc.CHUNK_BYTES
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    reader.end()
    assert n == size and last[4] == count and last[5] and last[6] == size and last[8] == whole.hexdigest() and peak < 4 << 20


@pytest.mark.parametrize("change", [(b"sha1:", b"sha1:0"), (b"Length: 42", b"Length: 41"), (b"WARC/1.1", b"WORC/1.1"), (b"\r\n\r\n$", b""), (b"X-Payload-Length: 23", b"X-Payload-Length: 24")])
def test_warc_reader_refuses_faults(change):
    body = b"<p>twenty-three bytes.</"
    body = body[:23]
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5:x>\r\nWARC-Payload-Digest: sha1:%s\r\nX-Payload-Length: 23\r\nContent-Length: 42\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n" % (hashlib.sha1(body).hexdigest().encode(), body)

    def read(data):
        reader = warc.Reader()
        rows = [x for k in range(0, len(data), 7) for x in reader.feed(data[k : k + 7])]
        reader.end()
        return rows

    assert [r[-1] for r in read(good)] == [body]
    bad = good[:-4] if change[0].endswith(b"$") else good.replace(*change)
    with pytest.raises(ValueError):
        read(bad)


# Queries and pipeline


def rows_of(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cur = queries.QUERIES[name](spark, SF), c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_pipeline(spark, docs):
    """Every stage by brute force on what the one before it kept."""
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near duplicates", "pseudonyms", "mixing", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, tables = docs, []
    for name, stage in cp.STAGES:
        rows = stage(spark, before, SF).collect()
        tables.append(rows)
        if name != "packing":
            before = spark.createDataFrame(rows, docs.schema)
    quality, once, hidden, mixed, packed = tables
    good = {r.doc_id for r in byte_cnn.classify(docs, labels).collect() if r.score >= 0.3}
    assert {r.doc_id for r in quality} == good and Counter(quality) == Counter(r for r in docs.collect() if r.doc_id in good)
    pairs = [(r.doc_id, r.text) for r in quality]
    name = Near(pairs).classes(pairs)
    assert Counter(once) == Counter(r for r in quality if name[r.doc_id] == r.doc_id)
    back = pii.invert(spark.createDataFrame(hidden, docs.schema)).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text for r in once}
    assert all(r.n_chars == len(r.text) for r in hidden if r.text is not None) and len(hidden) == len(once)
    size = lambda r: len(WORD.findall(r.text or ""))
    sources = sorted({r.source for r in hidden if r.source is not None}, key=str.encode) + ([None] if any(r.source is None for r in hidden) else [])
    own = [sum(size(r) for r in hidden if r.source == s) for s in sources]
    want = mixing.targets(own, [(1, 2, 3)[i % 3] for i in range(len(sources))], sum(own), 3)
    for s, w in zip(sources, want, strict=True):
        assert abs(sum(size(r) for r in mixed if r.source == s) - w) <= 3 * mixing.BLOCK_WORDS
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in hidden} and max(Counter(r.doc_id for r in mixed).values()) <= 4
    packed_well(packed, mixed)
    assert cp.run(spark, SF).count() == len(packed)
