"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets by a seeded hash of where they stand in the input, so that neither ids nor
texts nor copies decide: a text that a third of all rows repeat is spread like any other. There are as many buckets as keep one
within ``bucket_bytes``, and an exchange brings each to one task, which sorts its buckets on disk if need be. Pass two holds one
bucket at a time in memory, shuffles it by Fisher-Yates with a generator seeded by the bucket, and numbers its rows on from the
rows of all earlier buckets. Those starts come from a count per bucket and travel as one marker row each with the bucket's own
rows: nothing is broadcast. The place in the whole order gives the shard (equal pieces of the order, so that
counts differ by one at most) and the slot in it; a task writes to the few shards that its buckets fall into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import quoted, width

SEED = 20261128
SHARDS = 16
#: What a bucket should hold in bytes of text; one bucket at a time is in a task's memory.
BUCKET_BYTES = 16 << 20
#: Buckets whose starts are summed in one group.
_GROUP = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of ``range(n)``: each place from the last on swaps with one at or before it."""
    order = np.arange(n)
    draws = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1)) if n else order
    for i, j in zip(range(n - 1, 0, -1), draws.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def bucket_starts(counts: DataFrame) -> DataFrame:
    """``bucket, start`` of ``counts(bucket, n)``: the rows of all earlier buckets, summed within groups of buckets and then over the groups."""
    grouped = counts.withColumn("part", F.floor(F.col("bucket") / _GROUP))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    inner = grouped.select("bucket", "part", before(Window.partitionBy("part").orderBy("bucket")).alias("inner"))
    # a row for each 4096 buckets of 16 MB
    outer = grouped.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("outer"))
    return inner.join(outer, "part").select("bucket", (F.col("inner") + F.col("outer")).alias("start"))


def shard(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", row: Column | None = None, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``row`` (a struct of all columns), ``shard`` and ``slot`` (gapless from 0) of every row, in the order of shards and slots.

    ``row`` is a column that tells where a record stands in the input, such as a struct of ``_metadata.file_name`` and ``_metadata.row_index``:
    the order then depends on files alone. Without one Spark's row numbers serve, and the order depends on the splits, too; ``docs`` must
    then be read from files or a checkpoint, so that a rerun numbers rows alike. Rows are told apart by place only, so null and repeated ids, null and
    empty texts and wholly repeated rows are records like others, and columns of any name come through in the struct. A very long text may fill a bucket of its own.
    Shards differ by one row at most; with fewer rows than shards some are empty. An empty table gives an empty result.
    """
    place = F.monotonically_increasing_id() if row is None else row
    base = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), F.xxhash64(F.lit(seed), place).alias("draw"))
    sums = base.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("row")[text])).alias("bytes")).first()
    total, buckets = sums["n"], max(1, -(-(sums["bytes"] or 0) // bucket_bytes))
    parts = width(docs.sparkSession)
    bucket = F.pmod(F.col("draw"), F.lit(buckets).cast("long"))
    counts = base.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    markers = bucket_starts(counts).select("bucket", F.lit(None).cast("long").alias("draw"), F.lit(None).cast(docs.schema).alias("row"), "start")
    records = base.select(bucket.alias("bucket"), "draw", "row", F.lit(None).cast("long").alias("start"))
    dealt = records.unionByName(markers).repartitionById(parts, F.floor(F.col("bucket") * parts / buckets).cast("int"))
    # nulls come first, so a marker stands before its bucket's rows; equal draws are two rows in 2^64
    placed = dealt.sortWithinPartitions("bucket", F.col("start").isNull(), "draw")

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now, start = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.concat_tables(held).combine_chunks()
                t = t.take(pa.array(fisher_yates(t.num_rows, seed, now)))
                at = start + np.arange(t.num_rows)
                where = at * shards // total
                slot = at - -(-where * total // shards)
                out = pa.table([t["row"], pa.array(where.astype("i4")), pa.array(slot)], names=["row", "shard", "slot"])
                yield from out.to_batches(max_chunksize=1000)
                held.clear()

        for batch in batches:
            ids = batch["bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if ids[lo] != now:
                        yield from flush()
                        now, start, lo = int(ids[lo]), batch["start"][lo].as_py(), lo + 1
                    if hi > lo:
                        held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]).select(["row"]))
        yield from flush()

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return placed.select("bucket", "start", "row").mapInArrow(permute, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as Parquet, a folder ``shard=N`` each, with the record as one struct; files and the rows in them are in the order of slots."""
    sharded.sortWithinPartitions("shard", "slot").select("row", "slot", "shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """``row, slot, shard`` of written shards, of an empty folder too."""
    schema = T.StructType([T.StructField("row", record), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
