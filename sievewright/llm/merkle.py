"""Merkle manifest of a dataset, with proofs by coordinate lookup.

Leaves are numbered within their group by one range sort whose partitions are counted and the counts summed: no group is gathered,
however large. The tree is built a level at a time, and each level is materialised as a table of runs (``grp, run`` and the digests of its
at most three nodes), with a third of the rows of the level below. A proof is looked up, not walked: the index of a leaf and the size of
its group give the coordinates of all runs on the way up. They are exploded, joined with the node table and put in order of level
again; the siblings in a run give the text before and after the own digest. Coordinates of upper levels are the same for all leaves below, so
they are exploded ``TIER`` levels at a time, once per ancestor, and an ancestor's path joins those below it by its own coordinate. The
groups' roots are the leaves of a tree of their own.

Digests are lowercase hex SHA-256; a node hashes the hex digests of its run, concatenated. They are stored as 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import cut, quoted, spread_join, width

ARITY = 3
#: Levels whose coordinates are exploded at once.
TIER = 4
_PATH = "array<struct<level:int,before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:``, the value."""
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_digest(*values: Column) -> Column:
    """The digest of a record: that of its encoded values, concatenated."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, gapless from 0 in ascending order, nulls first; what ties in the order is numbered in any.

    ``rows`` must be read from files or a checkpoint. Its ties are split by row number, so that even wholly equal rows don't meet in one task.
    The sorted rows are checkpointed; their partitions are counted, and the counts (a row for each partition) summed.
    """
    sort = [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(width(rows.sparkSession), *sort).sortWithinPartitions(*sort)
    placed = cut(placed.drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    part, inner = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + inner).alias("at"))


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, ``grp, n, run, a, b, c``, and ``grp, digest`` of the roots, of ``leaves(grp, n, idx, digest)``.

    ``n`` is the number of nodes of the group at that level. Groups of one node are done: their node is the root. The number of levels follows from the largest group.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, now = [], leaves
    done = [leaves.where("n = 1").select("grp", "digest")]
    place = F.col("idx") % ARITY
    while largest > 1:
        runs = cut(
            now.where("n > 1").groupBy("grp", "n", F.expr(f"idx div {ARITY}").alias("run"))
            .agg(*[F.max(F.when(place == k, F.col("digest"))).alias(name) for k, name in enumerate("abc")])
        )
        levels.append(runs)
        text = F.concat(*[F.coalesce(F.lower(F.hex(name)), F.lit("")) for name in "abc"])
        now = runs.select("grp", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.col("run").alias("idx"), F.unhex(F.sha2(text, 256)).alias("digest"))
        done.append(now.where("n = 1").select("grp", "digest"))
        largest = -(-largest // ARITY)
    roots = done[0]
    for d in done[1:]:
        roots = roots.union(d)
    return levels, cut(roots)


def paths(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``rows(at, grp, n, idx, ...)`` with ``path``: from the lowest level up, the text before and after the own digest in its run.

    The path of a group of one is empty.
    """
    above = None
    for lo in reversed(range(0, len(levels), TIER)):
        tier = range(lo, min(lo + TIER, len(levels)))
        if lo:
            # the nodes of this level are the runs of the one below
            base = levels[lo - 1].select("grp", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.col("run").alias("idx"))
            key = ["grp", "idx"]
        else:
            base, key = rows.select("at", "grp", "n", "idx"), ["at"]
        nodes = None
        for level in tier:
            one = levels[level].select(F.lit(level).alias("level"), "grp", "run", "a", "b", "c")
            nodes = one if nodes is None else nodes.union(one)
        steps = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(ARITY ** (k - lo)).cast("long").alias("span")) for k in tier])
        asked = base.select(*key, *[c for c in ("grp", "idx", "n") if c not in key], F.explode(steps).alias("s")).where("n > s.span")
        asked = asked.select(
            *key, *[c for c in ("grp",) if c not in key], F.col("s.level").alias("level"), F.expr(f"idx div (s.span * {ARITY})").alias("run"), F.expr(f"(idx div s.span) % {ARITY}").alias("place")
        )
        a, b, c = (F.coalesce(F.lower(F.hex(x)), F.lit("")) for x in "abc")
        at = F.col("place")
        before = F.when(at == 0, F.lit("")).when(at == 1, a).otherwise(F.concat(a, b))
        after = F.when(at == 0, F.concat(b, c)).when(at == 1, c).otherwise(F.lit(""))
        found = asked.join(nodes, ["grp", "level", "run"]).select(*key, F.struct("level", before.alias("before"), after.alias("after")).alias("step"))
        own = found.groupBy(*key).agg(F.array_sort(F.collect_list("step")).alias("path"))
        if not lo:
            own = rows.join(own, "at", "left")
        if above is not None:
            up = above.select("grp", F.col("idx").alias("_up"), F.col("path").alias("_rest"))
            own = own.withColumn("_up", F.expr(f"idx div {ARITY ** len(tier)}")).join(up, ["grp", "_up"], "left").drop("_up")
            own = own.withColumn("path", F.concat(F.coalesce("path", F.lit(None).cast(_PATH), F.array().cast(_PATH)), F.coalesce("_rest", F.array().cast(_PATH)))).drop("_rest")
        above = own
    out = rows.withColumn("path", F.lit(None).cast(_PATH)) if above is None else above
    return out.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))


def siblings(path: Column) -> Column:
    """The digests that a proof consists of, as one text in order."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", **more: Column
) -> DataFrame:
    """Leaf, subroot, root and proof of every row: ``order``, ``group``, ``leaf``, ``subroot``, ``root``, ``path`` and the columns of ``more``, expressions over ``docs``.

    Leaves ascend by ``order`` within their group (null first, ties by leaf; wholly equal rows have neighbouring leaves in any order), groups by bytes of their
    name (null first). Nulls in any column are encoded apart from texts. Texts of any length are hashed where they are read, once, and aren't moved.
    A group with a third of all rows is split over tasks like others. Columns of other names are ignored; an empty table gives an empty result.
    """
    at = {c: docs[quoted(c)] for c in columns}
    leaves = cut(
        docs.select(
            docs[quoted(order)].cast("long").alias("order"), docs[quoted(group)].cast("string").alias("group"), F.unhex(leaf_digest(*at.values())).alias("digest"),
            F.struct(F.lit(0).alias("_"), *[e.alias(name) for name, e in more.items()]).alias("more"),
        )
    )
    rows = numbered(leaves, "group", "order", "digest").withColumn("key", encoded(F.col("group")))
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("grp")))
    rows = cut(spread_join(rows, groups, "key", "n").withColumn("idx", F.col("at") - F.col("grp")))
    levels, subroots = build(rows.select("grp", "n", "idx", "digest"))
    tops = numbered(groups.join(subroots, "grp").select("key", F.col("n").alias("size"), "grp", "digest"), "grp")
    n = tops.count()
    tops = cut(tops.select("key", "size", "digest", F.col("at").alias("idx"), "at", F.lit(0).cast("long").alias("grp"), F.lit(n).cast("long").alias("n")))
    high, root = build(tops.select("grp", "n", "idx", "digest"))
    over = paths(tops, high).select("key", "size", F.col("digest").alias("subroot"), F.col("path").alias("over"))
    out = spread_join(cut(paths(rows, levels)), over, "key", "size")
    # the root is one row
    out = out.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    text = lambda name: F.lower(F.hex(name))
    return out.select(
        F.col("order").alias(order), F.col("group").alias(group), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.concat("path", "over").alias("path"), *[F.col("more")[name].alias(name) for name in more],
    )
