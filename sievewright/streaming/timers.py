"""Timing records as a stream: baseline and assisted measurements paired by timer and case in keyed state.

The state of a pair and a span of ``KEEP`` of event time holds the last measurement of each phase by its ordinal, so repeated and out-of-order rows change nothing
that a later one has settled. It is an aggregation of Spark's own, as calls of Python for each pair cost about 9 ms of CPU. A span is forgotten once the watermark has
passed its end. Every change is sent on, and each batch is written as a part of its own that replaces itself if the batch runs again; readers take the last state of
each pair over all its spans, also of those that were forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The span of event time that a state is for; how late a record may come.
KEEP, LATE = "30 days", "10 days"
PAIR = "timer_id string, case_id string, baseline double, b_ord long, assisted double, a_ord long, assisted_first boolean, baseline_first boolean"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB; the session's own store is set again afterwards."""
    name, ours = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, ours)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def valid(timers: DataFrame) -> DataFrame:
    """Rows that count: a timer, a case, a known phase, minutes above 0."""
    c = F.col
    return timers.select(
        F.trim("timer_id").alias("timer_id"), F.trim("case_id").alias("case_id"), F.lower(F.trim("phase")).alias("phase"), c("minutes").try_cast("double").alias("minutes"),
        F.trim(F.coalesce("first_exposure", F.lit(""))).alias("first_exposure"), "ordinal", "at",
    ).where((c("timer_id") != "") & (c("case_id") != "") & c("phase").isin("baseline", "assisted") & (c("minutes") > 0))


def pairs(stream: DataFrame, truth: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """Changes of pairs from a stream of ``timer_id, case_id, phase, minutes, first_exposure, ordinal, at``; with ``truth(case_id)`` only cases that it has."""
    rows = valid(stream)
    if truth is not None:
        rows = rows.join(truth.select("case_id").distinct(), "case_id")
    # a record without a time belongs to no span
    rows = rows.withColumn("at", F.coalesce("at", F.raise_error(F.lit("a measurement without a time")).cast("timestamp")))
    c = F.col
    of = lambda phase, x: F.when(c("phase") == phase, c(x))
    spans = rows.withWatermark("at", late).groupBy("timer_id", "case_id", F.window("at", KEEP)).agg(
        *[f for phase, n, o in (("baseline", "baseline", "b_ord"), ("assisted", "assisted", "a_ord"))
          for f in (F.max_by(of(phase, "minutes"), of(phase, "ordinal")).alias(n), F.max(of(phase, "ordinal")).alias(o))],
        F.max(c("first_exposure") == "assisted_first").alias("assisted_first"), F.max(c("first_exposure") == "baseline_first").alias("baseline_first"),
    )
    return spans.drop("window")


def write_parts(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Start a query that writes each batch to ``path/batch=N``, and end when all that is there now has been read."""

    def part(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each pair over all parts: each phase by its own ordinal."""
    rows = spark.read.schema(PAIR).parquet(path)
    return rows.groupBy("timer_id", "case_id").agg(
        F.max_by("baseline", "b_ord").alias("baseline"), F.max_by("assisted", "a_ord").alias("assisted"), F.max("assisted_first").alias("assisted_first"), F.max("baseline_first").alias("baseline_first")
    )
