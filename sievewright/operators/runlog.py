"""Analytics of run logs, and the gated timing measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators.quantiles import with_quantiles
from sievewright.session import cut


def cost_latency(log: DataFrame, price_in: float = 0.15, price_out: float = 0.60) -> DataFrame:
    """Per condition: calls, tokens, cost, cost per passed case (null if none passed), median and maximal latency.

    ``log``: condition, passed, prompt_tokens, completion_tokens, calls, latency_ms.
    """
    c = F.col
    df = log.groupBy("condition").agg(
        F.count("*").alias("n"),
        F.count_if(c("passed")).alias("passed"),
        F.sum("calls").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    df = with_quantiles(df, log, ["condition"], "latency_ms", {"median_latency_ms": ("upper", 0.5)})
    cost = (c("prompt_tokens") * price_in + c("completion_tokens") * price_out) / 1e6
    return df.withColumn("cost", F.bround(cost, 6)).withColumn("cost_per_passed", F.bround(F.try_divide(cost, c("passed")), 6))


def retrieval_stats(log: DataFrame) -> DataFrame:
    """Smallest, median and largest similarity and number of distinct chunks per condition (``condition, similarity, chunk_ids``)."""
    chunks = log.select("condition", F.explode("chunk_ids").alias("chunk")).groupBy("condition").agg(F.countDistinct("chunk").alias("distinct_chunks"))
    sims = log.groupBy("condition").agg(F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"))
    sims = with_quantiles(sims, log, ["condition"], "similarity", {"median_similarity": ("linear", 0.5)})
    return sims.join(chunks, "condition", "left")


def chunk_histogram(log: DataFrame) -> DataFrame:
    """How many records of each condition retrieved how many chunks (null counts as none)."""
    size = F.coalesce(F.nullif(F.size("chunk_ids"), F.lit(-1)), F.lit(0))
    return log.groupBy("condition", size.alias("chunks")).agg(F.count("*").alias("n"))


def usage_per_run(log: DataFrame, price_in: float = 0.15, price_out: float = 0.60) -> DataFrame:
    """Per run and condition: records, calls, tokens, cost, cost of a record."""
    sums = log.groupBy("run_id", "condition").agg(
        F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    cost = (F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out) / 1e6
    return sums.withColumn("cost", F.bround(cost, 6)).withColumn("cost_per_record", F.bround(cost / F.col("n"), 8))


def stripped_and_displayed(stripped: DataFrame, displayed: DataFrame, limit: int = 6) -> DataFrame:
    """Claims that a guard removed beside those that were shown: ``condition, kind, item, n, total, rank``, the ``limit`` most frequent of each condition and kind.

    Both take ``condition`` and an array ``items``. ``total`` counts all claims of the condition and kind. Ties by item.
    """
    rows = stripped.select("condition", F.lit("stripped").alias("kind"), F.explode("items").alias("item"))
    rows = rows.union(displayed.select("condition", F.lit("displayed"), F.explode("items")))
    counts = rows.groupBy("condition", "kind", "item").agg(F.count("*").alias("n"))
    by = ["condition", "kind"]
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "item")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return top.join(counts.groupBy(*by).agg(F.sum("n").alias("total")), by).select(*by, "item", "n", "total", "rank")


def frequency(log: DataFrame, items: str, limit: int) -> DataFrame:
    """The most frequent elements of an array column (ties by name)."""
    return (
        log.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item").limit(limit)
    )


def note_frequency(log: DataFrame, limit: int = 12) -> DataFrame:
    """Notes by what stands before their colon."""
    notes = log.select(F.explode("notes").alias("note")).select(F.trim(F.split_part("note", F.lit(":"), F.lit(1))).alias("item"))
    return notes.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item").limit(limit)


def last_run(log: DataFrame, ordinal: str) -> DataFrame:
    """The records of the run that the last record belongs to."""
    last = log.agg(F.max_by("run_id", ordinal).alias("run_id"))
    return log.join(F.broadcast(last), "run_id")


def decision_histogram(decisions: DataFrame) -> DataFrame:
    """Counts of each decision and in how many runs it occurs (``run_id, decision``)."""
    return decisions.groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))


def form_deltas(decisions: DataFrame, baseline: str) -> DataFrame:
    """Counts of each form and decision less those of the baseline form (``form_id, decision``)."""
    n = decisions.groupBy("form_id", "decision").agg(F.count("*").alias("n"))
    # a row for each kind of decision
    base = n.where(F.col("form_id") == baseline).select("decision", F.col("n").alias("base"))
    return n.join(F.broadcast(base), "decision", "left").select("form_id", "decision", "n", (F.col("n") - F.coalesce("base", F.lit(0))).alias("delta"))


def control_decisions(decisions: DataFrame) -> DataFrame:
    """All decisions that a control name ever got, in one cell (there are six kinds)."""
    return decisions.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("decision")), ",").alias("decisions"))


def suffix_duplicates(df: DataFrame, by: list[str], id_: str, order: str) -> DataFrame:
    """Ids made unique in order: the second of a kind gets -2, the third -3."""
    n = F.row_number().over(Window.partitionBy(*by, id_).orderBy(order))
    return df.withColumn("unique_id", F.when(n == 1, F.col(id_)).otherwise(F.concat(F.col(id_), F.lit("-"), n)))


def carry_forward(df: DataFrame, by: list[str], order: str, marker: str, out: str) -> DataFrame:
    """The last marker at or before each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(marker, ignorenulls=True).over(w))


def sliding_text(df: DataFrame, by: list[str], order: str, text: str, rows: int = 4) -> DataFrame:
    """The texts of a row and those after it, ``rows`` in all, joined by spaces."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, rows - 1)
    return df.withColumn("window_text", F.array_join(F.collect_list(text).over(w), " "))


def timing_pairs(timers: DataFrame) -> DataFrame:
    """Valid measurements paired by timer and case: baseline and assisted minutes (the last of each by ``ordinal``)."""
    c = F.col
    phase = F.lower(F.trim("phase"))
    minutes = c("minutes").try_cast("double")
    ok = timers.select(
        F.trim("timer_id").alias("timer_id"), F.trim("case_id").alias("case_id"), phase.alias("phase"), minutes.alias("minutes"),
        F.trim(F.coalesce("first_exposure", F.lit(""))).alias("first_exposure"), "ordinal",
    ).where((c("timer_id") != "") & (c("case_id") != "") & c("phase").isin("baseline", "assisted") & (c("minutes") > 0))
    return ok.groupBy("timer_id", "case_id").agg(
        F.max_by(F.when(c("phase") == "baseline", c("minutes")), F.when(c("phase") == "baseline", c("ordinal"))).alias("baseline"),
        F.max_by(F.when(c("phase") == "assisted", c("minutes")), F.when(c("phase") == "assisted", c("ordinal"))).alias("assisted"),
        F.max(c("first_exposure") == "assisted_first").alias("assisted_first"),
        F.max(c("first_exposure") == "baseline_first").alias("baseline_first"),
    )


def timing_gate(timers: DataFrame, least: int = 3, target: float = 0.30) -> DataFrame:
    """One row: status and counts; means only if enough independent timers and a complete pair are there."""
    c = F.col
    return gate(timing_pairs(timers), timers.isEmpty(), least, target)


def gate(pairs: DataFrame, nothing: bool = False, least: int = 3, target: float = 0.30) -> DataFrame:
    """The measure of ``pairs(timer_id, baseline, assisted)``; ``nothing`` tells that there was no record at all."""
    c = F.col
    complete = c("baseline").isNotNull() & c("assisted").isNotNull()
    pairs = cut(pairs.withColumn("_cut", F.when(complete, (c("baseline") - c("assisted")) / c("baseline"))))
    reduction = c("_cut")
    agg = pairs.agg(
        F.countDistinct("timer_id").alias("n_timers"), F.count_if(complete).alias("n_paired"), F.count_if(reduction >= target).alias("_hits"),
        F.avg(reduction).alias("_mean"), F.min(reduction).alias("_min"), F.max(reduction).alias("_max"),
    )
    agg = with_quantiles(agg, pairs, [], "_cut", {"_median": ("linear", 0.5)})
    status = F.when(F.lit(nothing), "no_data").when((c("n_timers") < least) | (c("n_paired") == 0), "insufficient").otherwise("reported")
    shown = lambda x: F.when(status == "reported", F.bround(x, 4))
    return agg.select(
        status.alias("status"), "n_timers", "n_paired", F.when(status == "reported", c("_hits")).alias("hits"),
        shown(c("_mean")).alias("mean_reduction"), shown(c("_median")).alias("median_reduction"),
        shown(c("_min")).alias("min_reduction"), shown(c("_max")).alias("max_reduction"),
    )


def order_warnings(timers: DataFrame) -> DataFrame:
    """Timers who only ever began with the assisted phase."""
    return timing_pairs(timers).groupBy("timer_id").agg(F.max("assisted_first").alias("a"), F.max("baseline_first").alias("b")).where("a AND NOT b").select("timer_id")
