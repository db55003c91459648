"""Exact dedup by a tree-merge of sorted digest runs.

Every partition sorts its digests into a run with one row per text (its ranking row and count), and runs then meet
in rounds. With ``FAN ** rounds`` slots, a slot keeps in round r the digests whose r-th base-FAN digit is its own r-th digit and
sends the rest to the FAN - 1 slots that differ from it in this digit only (a binomial exchange by recursive halving, FAN ways
at a time). A slot sorts what arrives - FAN sorted runs - and merges equal neighbours in one pass, retaining the row
that ranks first and adding counts. After the last round each slot holds a range of digests of its own, fully
merged: no slot ever holds more than its share of the texts, and a text that a third of all rows repeat costs at most FAN rows
per slot and round. A text is known by SHA-256, verified by its length and XXH64 at every merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import cut, exactly, rank_columns, spread_join, width

FAN = 4


def identity(text: str) -> F.Column:
    """The verified identity of a text in 48 bytes: SHA-256, XXH64, byte length."""
    t = F.coalesce(F.col(text), F.lit(""))
    check = F.lpad(F.hex(F.xxhash64(t)), 16, "0")
    return F.unhex(F.concat(F.sha2(t, 256), check, F.lpad(F.hex(F.octet_length(t)), 16, "0")))


def merge_runs(ids: DataFrame) -> DataFrame:
    """``key, keep, group_size`` per text of ``ids(key, rank)``: the largest rank and the number of rows."""
    parts = width(ids.sparkSession)
    rounds, slots = 1, FAN
    while slots < parts:
        rounds, slots = rounds + 1, slots * FAN
    # a rank is a struct, whose maximum Spark takes by sorted aggregation: runs are sorted before they are written
    runs = ids.select(
        (F.spark_partition_id() % slots).cast("long").alias("slot"), "key", F.col("rank").alias("keep"), F.lit(1).cast("long").alias("group_size")
    )
    home = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % slots
    for r in range(rounds):
        unit = FAN**r
        own = (F.col("slot") / unit).cast("long") % FAN
        due = (home / unit).cast("long") % FAN
        runs = runs.withColumn("slot", F.col("slot") + (due - own) * unit)
        if r:  # the first exchange merges within partitions before it sends
            runs = runs.repartition(parts, "slot").sortWithinPartitions("slot", "key")
        runs = runs.groupBy("slot", "key").agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    return runs.drop("slot")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Mark exact copies: of equal texts the row with the largest id stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Texts are equal when identical; null counts as empty. Rows that
    repeat text and doc_id share its decision. A row without doc_id is kept only if no
    copy has one. An empty table gives an empty result; further columns are ignored.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), identity(text).alias("key"))
    groups = merge_runs(ids.select("key", F.struct("doc_id").alias("rank"))).where("group_size > 1")
    groups = groups.select("key", F.col("keep.doc_id").alias("keep_id"), "group_size")
    out = spread_join(ids, groups, "key", "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: exactly one of each text.

    It is that of the largest doc_id; a row without one stays only if no copy has one, and of rows that share the id, too, the
    one of the largest hash of all columns. Null texts count as empty. An empty table stays empty.
    """
    doc, tie = rank_columns(docs, doc_id)
    ids = docs.select(identity(text).alias("key"), F.struct(F.col(doc_id).cast("long").alias("id"), tie, doc).alias("rank"))
    return exactly(docs, doc_id, merge_runs(ids).select("keep.doc", "keep.tie"))
