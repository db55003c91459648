"""Seeded sampling without replacement, and probes drawn from it.

A row's priority is a digest of the seed and its key; a sample is the k rows of least priority of each group. Samples are the same whatever the partitions, samples
of parts merge to the sample of the whole, and a larger k only adds rows. The k least of each partition are kept before rows are sent (Spark limits a ranked window by group
ahead of the exchange), so that a group of any size sends k rows from a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators import matching
from sievewright.operators.quantiles import with_quantiles
from sievewright.session import cut

# The seed, the probes of a family, the least skills of a probe, the hits looked at, and the family that suits all.
SEED, PER_FAMILY, LEAST, TOP_K, GENERIC = 20260824, 25, 5, 6, "generic"


def priority(seed: int, *key: Column) -> Column:
    """32 hex digits, uniform for each seed and key; null parts count as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))


def draw(rows: DataFrame, by: list[str], key: list[str], k: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``place``: of each group the k rows of least priority, in its order (ties by key). Rows that repeat a key are rows of their own."""
    order = Window.partitionBy(*by).orderBy(priority(seed, *[F.col(c) for c in key]), *key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def probe_texts(skills: DataFrame, titles: list[str], per_family: int = PER_FAMILY, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``family, probe, query``: texts like postings, each with a drawn number of drawn skills of its family, for ``skills(family, skill)``.

    A probe takes from ``least`` to all skills of its family (all, if they are fewer), in order of priority, and the titles by turns.
    """
    c = F.col
    own = skills.where("family IS NOT NULL AND skill IS NOT NULL").distinct()
    asked = own.groupBy("family").agg(F.count("*").alias("n")).select("family", "n", F.explode(F.sequence(F.lit(0), F.lit(per_family - 1))).alias("probe"))
    spread = F.conv(F.substring(priority(seed, c("family"), c("probe")), 1, 8), 16, 10).cast("long")
    size = F.when(c("n") <= least, c("n")).otherwise(least + spread % (c("n") - least + 1))
    ranked = asked.withColumn("size", size).join(own, "family").withColumn("p", priority(seed, c("family"), c("probe"), c("skill")))
    place = F.row_number().over(Window.partitionBy("family", "probe").orderBy("p", "skill"))
    # a family's skills are at most the vocabulary
    named = ranked.withColumn("place", place).where("place <= size").groupBy("family", "probe").agg(F.array_sort(F.collect_list(F.struct("place", "skill"))).alias("s"))
    title = F.element_at(F.array(*map(F.lit, titles)), (c("probe") % len(titles) + 1).cast("int"))
    # The wording of a probe.
    return named.select("family", "probe", F.concat(
        F.lit("Job requirements: "), F.array_join(F.transform("s", lambda x: x["skill"]), ", "), F.lit(". Job description excerpt: We are hiring a "), title,
        F.lit(" to join our team and work on production systems."),
    ).alias("query"))


def probe_hits(probes: DataFrame, corpus: DataFrame, k: int = TOP_K) -> DataFrame:
    """``probe, family, relevant, similarity`` of the k nearest of ``corpus(chunk_id, vec, family)`` for each of ``probes(query_id, vec, family)``.

    Relevant are hits of the probe's family or of the generic one. A probe that is itself in the corpus doesn't find itself.
    """
    found = matching.vector_top_k(probes.select("query_id", "vec"), corpus.select("chunk_id", "vec"), k + 1).where("query_id <> chunk_id")
    hits = matching.top_k(found.drop("rank"), ["query_id"], [F.col("similarity").desc(), "chunk_id"], k)
    of = corpus.select("chunk_id", F.col("family").alias("_theirs"))
    hits = hits.join(of, "chunk_id").join(probes.select("query_id", "family"), "query_id")
    theirs = F.coalesce(F.col("_theirs").cast("string"), F.lit(""))
    return hits.select(F.col("query_id").alias("probe"), "family", ((theirs == F.col("family").cast("string")) | (theirs == GENERIC)).alias("relevant"), "similarity")


def calibrate(corpus: DataFrame, per_family: int = PER_FAMILY, k: int = TOP_K, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The calibration of a corpus of vectors by probes drawn from it, and the medians of each family: one row, and ``family, relevant_median, irrelevant_median, n``."""
    probes = cut(draw(corpus, ["family"], ["chunk_id"], per_family, seed).select(F.col("chunk_id").alias("query_id"), "vec", "family"))
    hits = cut(probe_hits(probes, corpus, k))
    best = hits.groupBy("probe", "family").agg(
        F.max(F.when(F.col("relevant"), F.col("similarity"))).alias("rel"), F.max(F.when(~F.col("relevant"), F.col("similarity"))).alias("irr")
    )
    best = cut(best)
    per = best.groupBy("family").agg(F.count("rel").alias("n"))
    per = with_quantiles(per, best, ["family"], "rel", {"relevant_median": ("linear", 0.5)})
    per = with_quantiles(per, best, ["family"], "irr", {"irrelevant_median": ("linear", 0.5)})
    whole = matching.derive_calibration(hits).withColumn("separation", F.col("relevant_median") - F.col("irrelevant_median"))
    return whole, per
