"""A bounded, seeded sample of rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 1000
MOST_ROWS = 24_000


def bounded(docs: DataFrame, by: str, most: int, longest: int, seed: int = 3, labels: DataFrame | None = None) -> list:
    """At most ``most`` different rows (doc_id, text, by) for each value of ``by``, and MOST_ROWS of all values together,
    drawn by a seeded hash of the identifier among texts of at most ``longest`` characters. ``by`` is a column of ``docs``, or of
    ``labels`` (doc_id, by; one row for each identifier). Of more than MOST_VALUES values the most frequent are sampled.

    Rows are counted first, so that about half more than wanted lie below a hash bound; nothing but these is sent to
    the driver, and no row is shuffled or sorted for the others' sake."""
    fit: Column = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest)
    asked = (docs.filter(fit) if labels is None else labels).filter(F.col(by).isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[by]: r["n"] for r in asked.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(MOST_VALUES).collect()}
    if not counts:
        return []
    each = min(most, max(1, MOST_ROWS // len(counts)))
    share = {k: min(1.0, (1.5 * each + 50) / n) for k, n in counts.items()}
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) / float(1 << 53)
    out: dict = {}
    while share:
        limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])
        drawn = asked.filter(F.coalesce(place < limit[F.col(by)], F.lit(False)))
        if labels is not None:
            drawn = docs.filter(fit).join(F.broadcast(drawn.select("doc_id", by)), "doc_id")  # a bounded sample
        got: dict = {k: [] for k in share}
        for r in drawn.select("doc_id", "text", by, place.alias("h")).distinct().collect():
            got[r[by]].append((r["h"], r["doc_id"], r["text"]))
        for k, rows in got.items():
            if len(rows) >= each or share[k] >= 1:
                out[k] = sorted(rows)[:each]
        share = {k: min(1.0, 4 * v) for k, v in share.items() if k not in out}
    return sorted((doc_id, text, k) for k, rows in out.items() for _, doc_id, text in rows)
