"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and runs of other signs (``TOKEN``), alone and in pairs, are hashed to ``BUCKETS`` buckets. Two multinomials over
the buckets are learned: one from the trusted documents, one from all. A document's score is the mean over its n-grams
of log(trusted / raw); it is kept if the score is at least ``LEAST``. All of it is DataFrame operations; the model is
BUCKETS numbers whatever the corpus, and reaches each row as a scalar subquery.

Defined cases: null text has no words and fails the base rules; a text without n-grams scores 0; without any trusted
document every score is 0, so only the base rules decide; repeated rows are judged alike; identifiers may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsched.llm.shared import SPACE

BUCKETS = 16384
BROADCAST_IDS = 1 << 20
LEAST = -0.25
PRIOR = 1.0
TOKEN = r"[\p{L}\p{M}]+|\p{Nd}+|[^\p{L}\p{M}\p{Nd}\s]+"
SYMBOLS = "[#*$%&|<>]"


def base_columns(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    d = d.withColumn("_windows", F.when(F.size("_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", F.when(F.instr(t, "\n") > 0, lines).otherwise(F.array().cast("array<string>")))
    # Only texts that repeat a window sort their windows: equal neighbours are repeats, and each position counts
    # the words up to the next repeated window, five at most.
    order = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    d = d.withColumn("_order", F.when(F.col("_repeats"), order))
    d = d.withColumn("_at", F.array_sort(F.transform(F.filter("_order", lambda x, j: F.coalesce(F.when(j > 0, x["h"] == F.get(F.col("_order"), j - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(F.col("_order"), j + 1)["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("_at", F.slice(F.col("_at"), 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.regexp_replace(t, SPACE, "")).cast("long"))
    d = d.withColumn("n_symbols", F.coalesce(F.regexp_count(t, F.lit(SYMBOLS)), F.lit(0)).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("n_repeat_words", F.when(F.col("_repeats"), covered).otherwise(F.lit(0)).cast("long"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("_words", "_windows", "_lines", "_repeats", "_order", "_at")


def grams(text: Column) -> Column:
    """Tokens as they stand in the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def bucket(*tokens: Column) -> Column:
    return F.pmod(F.xxhash64(*tokens), F.lit(BUCKETS)).cast("int")


def hashed(docs: DataFrame, text: str) -> DataFrame:
    """Adds _grams: the buckets of all single tokens, then of all neighbours."""
    both = lambda t: F.concat(F.transform(t, lambda x: bucket(x)), F.transform(t, lambda x, i: bucket(x, F.coalesce(F.get(t, i + 1), F.lit("")))))
    # Bound by a one-element transform: the optimizer would else work the tokens out again for each of them.
    return docs.withColumn("_grams", F.element_at(F.transform(F.array(grams(F.col(text))), both), 1))


def model(docs: DataFrame, text: str, trusted: str) -> DataFrame:
    """One row with one array: log(trusted / raw) of each bucket, add-PRIOR smoothed towards the raw distribution."""
    counts = hashed(docs, text).select(F.col(trusted).cast("int").alias("good"), F.explode_outer("_grams").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("good").alias("g")).filter("b is not null")
    # A row for each bucket, so that the array can be read by position.
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("g"))
    summed = counts.unionByName(every).groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.coalesce("g", F.lit(0))).alias("g"))
    one = summed.agg(F.sort_array(F.collect_list(F.struct("b", "n", "g"))).alias("c"), F.sum("n").alias("n"), F.sum("g").alias("g"))
    raw = lambda x: (x["n"] + F.lit(PRIOR)) / (F.col("n") + F.lit(PRIOR * BUCKETS))
    # The trusted multinomial gets BUCKETS pseudo-counts dealt as the raw one, so buckets never seen there stay finite.
    good = lambda x: (x["g"] + F.lit(PRIOR * BUCKETS) * raw(x)) / (F.col("g") + F.lit(PRIOR * BUCKETS))
    return one.select(F.transform("c", lambda x: F.log(good(x) / raw(x)).cast("float")).alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, the base columns, kept, llr. ``trusted`` has the identifiers (``doc_id``) of trusted documents."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if trusted is not None:
        ids = trusted.select(F.col("doc_id").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("_good", F.lit(1))
        # Sent to all while there are few of them, so that texts stay where they are; else joined by a shuffle.
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        learn = d.join(ids, "doc_id", "left").withColumn("_good", F.coalesce("_good", F.lit(0)))
    else:
        learn = d.withColumn("_good", F.lit(0))
    table = model(learn, "text", "_good")
    scored = hashed(base_columns(d, "text"), "text").withColumn("_ratio", table.scalar())
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(F.col("_ratio"), b))
    scored = scored.withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0)))
    keep = ~F.col("base_failed") & (F.col("llr") >= least)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", keep.alias("kept"), "llr")
