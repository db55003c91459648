"""Mixing sources to target weights by Poisson replication.

A document of a source with mean target rate r is repeated k times, k being the Poisson
quantile at a uniform number hashed from the seed and the document. Rates need one
row per source; documents are never gathered by source, so a source with a third of all rows costs
nothing extra. Copies are dealt to partitions by a hashed place and sorted by it: a
global shuffle that a lost executor's rerun repeats exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import quoted, width

SEED = 20260801
#: Most sources whose rates are sent to all executors; beyond it the rates are joined by exchange.
MAX_BROADCAST = 20_000
#: A rate above this is split in parts, as exp(-rate) would vanish.
MAX_RATE = 500.0


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) hashed from the columns."""
    h = F.xxhash64(*cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def poisson_cdf(rate: Column) -> Column:
    """Distribution function at 0, 1, 2, ... as an array, up to where double precision ends."""
    last = F.ceil(rate + F.lit(10.0) * F.sqrt(rate) + F.lit(20.0)).cast("int")
    start = F.struct(
        F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("cdf")
    )

    def step(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, source: str, total: float | None) -> DataFrame:
    """``_source, n_docs, rate``: mean repetitions that give each source its share of ``total`` documents."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            if not w >= 0 or math.isinf(w):
                raise ValueError(f"weight of {name!r}: {w}")
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("_w", weight)
    sums = counts.agg(F.sum("_w").alias("w"), F.sum("n_docs").alias("n")).first()
    if not sums["w"]:
        return counts.select("_source", "n_docs", F.lit(0.0).alias("rate"))
    goal = float(sums["n"] if total is None else total)
    return counts.select("_source", "n_docs", (F.col("_w") / sums["w"] * goal / F.col("n_docs")).alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: float | None = None,
    seed: int = SEED,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str | None = "text",
) -> DataFrame:
    """Documents repeated to the target weights and shuffled globally.

    Returns the input's columns and ``copy_no`` (0-based), ``rate``, ``place`` (the position
    in the order, in (0, 1)); a name that the input has already gets underscores in front. ``weights`` maps sources to shares (default: equal); a source that it
    lacks gets none. ``total`` is the expected number of copies (default: that of the rows). A null source
    is a source of its own. The draw hashes doc_id and text (or, with ``text=None``, the id alone), so rows that repeat both draw alike, and a null doc_id draws by
    its text. Empty tables give empty results.
    """
    columns, taken = docs.columns, {c.lower() for c in docs.columns}
    added = ["copy_no", "rate", "place"]
    while taken & set(added):
        added = [c if c not in taken else "_" + c for c in added]
    rates = source_rates(docs, weights, source, total).withColumn("_parts", F.ceil(F.greatest("rate", F.lit(0.001)) / MAX_RATE))
    rates = rates.withColumn("_cdf", poisson_cdf(F.col("rate") / F.col("_parts")))
    if rates.count() <= MAX_BROADCAST:
        rates = F.broadcast(rates)
    # the document is one struct until its copies are made, so that no name of its columns meets one of the rates
    base = docs.select(F.struct(*[docs[quoted(c)] for c in columns]).alias("row"))
    at = {c: F.col("row")[c] for c in columns}
    with_rate = base.join(rates, at[source].eqNullSafe(rates["_source"]))
    key = [F.lit(seed), at[doc_id]] + ([at[text]] if text is not None else [])
    parts = F.transform(
        F.sequence(F.lit(1), F.col("_parts").cast("int")),
        lambda j: F.size(F.filter(F.col("_cdf"), lambda c: c < uniform(*key, j))),
    )
    n = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    copies = with_rate.withColumn("_n", n).where("_n > 0")
    copies = copies.select("row", "rate", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy_no"))
    copies = copies.withColumn("place", uniform(F.lit(seed + 1), at[doc_id], F.col("copy_no"), F.xxhash64(*key)))
    parts_out = width(docs.sparkSession)
    return (
        copies.repartitionById(parts_out, F.floor(F.col("place") * parts_out).cast("int"))
        .sortWithinPartitions("place", F.col("row")[doc_id], "copy_no")
        .select(*[at[c].alias(c) for c in columns], *[F.col(c).alias(new) for c, new in zip(["copy_no", "rate", "place"], added, strict=True)])
    )
