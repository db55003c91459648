"""Exact percentiles of groups by selection: counts over ranges of values narrow down where a rank lies, and only the rows of the last range are read.

Each round cuts the range that holds a wanted rank at approximate percentiles (a sketch of bounded size for each rank), counts the rows between the cuts and goes on with the
part that the rank falls into, about one in ``CUTS``. It ends where a part is a single value or has at most ``FEW`` rows, which are sorted in one array. No task
ever holds the values of a group, and rows are never sorted or sent by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import cut

#: Parts of a range, and rows that are sorted in one array.
CUTS, FEW = 64, 250_000
#: Wanted ranks that are sent to all tasks.
MAX_BROADCAST = 100_000


def _positions(kind: str, q: float) -> list[F.Column]:
    """The ranks (from 0) that a quantile of ``n`` values is made of."""
    n = F.col("n")
    if kind == "linear":
        at = (n - 1) * F.lit(q)
        return [F.floor(at), F.ceil(at)]
    if kind == "nearest":
        return [F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0))]
    if kind == "rounded":
        return [F.bround((n - 1) * F.lit(q))]
    if kind == "upper":
        return [F.floor(n * F.lit(q))]
    raise ValueError(kind)


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``by`` and a column for each of ``wanted``, ``{name: (kind, q)}``, of the values that aren't null; a group without any has nulls.

    Kinds: ``linear`` interpolates at ``q * (n - 1)``, ``nearest`` is the smallest value that a share ``q`` doesn't exceed, ``upper`` the element at ``n * q`` (the upper
    median for one half), ``rounded`` that at ``q * (n - 1)``, rounded half to even. Groups of null are groups. Values are doubles.
    """
    c = F.col
    base = df.select(F.struct(*[c(f"`{b}`") for b in by], F.lit(0).alias("_")).alias("g"), c(value).cast("double").alias("v"))
    sizes = cut(base.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    ranks = F.array_distinct(F.concat(*[F.array(*[p.cast("long") for p in _positions(*w)]) for w in wanted.values()]))
    state = cut(sizes.where("n > 0").select("g", F.explode(ranks).alias("at"), "n", "lo", "hi").select("g", "at", c("at").alias("rank"), "n", "lo", "hi"))
    open_ = (c("lo") < c("hi")) & (c("n") > FEW)
    values = base.where("v IS NOT NULL")

    def inside(targets: DataFrame) -> DataFrame:
        t = targets.select(c("g").alias("tg"), "at", "rank", "lo", "hi", *[x for x in ("edges",) if x in targets.columns])
        t = F.broadcast(t) if t.count() <= MAX_BROADCAST else t
        return values.join(t, c("g").eqNullSafe(c("tg")) & c("v").between(c("lo"), c("hi"))).drop("tg")

    while not state.where(open_).isEmpty():
        left = state.where(open_)
        probs = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
        edges = inside(left).groupBy("g", "at").agg(F.array_distinct(F.percentile_approx("v", probs, F.lit(1000))).alias("edges"))
        # an edge belongs to the part below it, and to one of its own if it is all that is there
        cuts = cut(left.join(edges, ["g", "at"]))
        part = F.size(F.filter("edges", lambda e: e < c("v"))) * 2 + F.array_contains("edges", c("v")).cast("int")
        counts = inside(cuts).groupBy("g", "at", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("g", "at").orderBy("part"))
        found = counts.withColumn("upto", upto).where((c("upto") > c("rank")) & (c("upto") - c("n") <= c("rank")))
        found = found.select("g", "at", (c("rank") - (c("upto") - c("n"))).alias("rank"), "n", "lo", "hi")
        state = cut(state.where(~open_).union(found))
    single = state.where("lo = hi").select("g", "at", c("lo").alias("x"))
    few = inside(state.where("lo < hi")).groupBy("g", "at", "rank").agg(F.array_sort(F.collect_list("v")).alias("s"))
    known = cut(single.union(few.select("g", "at", F.element_at("s", (c("rank") + 1).cast("int")).alias("x"))))
    per_group = known.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    out = sizes.join(per_group.select(c("g").alias("og"), "m"), c("g").eqNullSafe(c("og")), "left")

    def result(kind: str, q: float) -> F.Column:
        at = [F.element_at("m", p.cast("long")) for p in _positions(kind, q)]
        if len(at) == 1:
            return at[0]
        share = (c("n") - 1) * F.lit(q) - F.floor((c("n") - 1) * F.lit(q))
        return at[0] + (at[1] - at[0]) * share

    return out.select(*[c("g")[b].alias(b) for b in by], *[F.when(c("n") > 0, result(*w)).alias(name) for name, w in wanted.items()])


def with_quantiles(groups: DataFrame, df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``groups`` (one row per group) with its quantiles."""
    q = quantiles(df, by, value, wanted)
    if not by:
        return groups.join(F.broadcast(q), F.lit(True), "left")  # one row each
    return groups.join(q.withColumnsRenamed({b: f"_{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], "left").drop(*[f"_{b}" for b in by])
