"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local master may do with a folder of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or local_folder(sc.master))


def local_folder(master: str) -> str:
    """A new folder of this machine, if driver and executors are one process; on a cluster an error."""
    if re.fullmatch(r"local(\[[^\]]*\])?", master) is None:
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    return tempfile.mkdtemp(prefix="sievewright-ckpt-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a replicated checkpoint that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession, least: int = 1) -> int:
    """The number of partitions that a full exchange should have."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quoted(name: str) -> str:
    """A column name for use in expressions, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def digest(col) -> F.Column:
    """A 128-bit key of a string column (md5 as 16 bytes)."""
    return F.unhex(F.md5(col))


def row_identity(doc_id: str, text: str) -> list[F.Column]:
    """``doc, h1, h2``: what tells a row from all rows that differ in id or text, and ranks rows by id, null last.

    Rows that repeat both are one row to the operators that use it.
    """
    known = F.col(doc_id).cast("long")
    return [
        F.coalesce(known, F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.lit(1), known, F.col(text)).alias("h1"),
        F.xxhash64(F.lit(2), F.col(text), known).alias("h2"),
    ]


_LAST = (1 << 63) - 1


def row_hash(docs: DataFrame) -> F.Column:
    """64 bits of all columns of a row, to rank rows that share an id."""
    hashable = [
        F.to_json(F.struct(docs[quoted(f.name)])) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else docs[quoted(f.name)]
        for f in docs.schema
    ]
    return F.xxhash64(*hashable)


def rank_columns(docs: DataFrame, doc_id: str) -> list[F.Column]:
    """``doc`` (the id, null last) and ``tie`` (a hash of the whole row): they rank rows, and only wholly equal rows share them."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), row_hash(docs).alias("tie")]


def exactly(docs: DataFrame, doc_id: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept(doc, tie)`` names, all columns; of wholly equal rows one."""
    held = docs.select(F.struct("*").alias("row"), *rank_columns(docs, doc_id))
    return held.join(kept.select("doc", "tie"), ["doc", "tie"], "left_semi").dropDuplicates(["doc", "tie"]).select("row.*")


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per ``key``), whatever the skew.

    Groups that hold at least a thousandth of the grouped rows are at most 1000, a proven bound, and are
    broadcast. Their rows get a salt of their own, so that no task gathers them; all others
    meet their group by exchange. ``size`` is the number of rows of a group. ``rows`` must be read from files or a
    checkpoint (with row-wise steps at most), so that a rerun numbers them alike. Null keys find nothing. ``total``, at least the rows of all groups, spares counting them;
    groups of few columns are then computed in the join itself.
    """
    if total is None:
        groups = cut(groups)
        total = groups.agg(F.sum(size)).first()[0] or 0
    extra = [c for c in groups.columns if c != key]
    hot = (F.col(size) * 1000 >= total) & (F.col(size) > 50)
    heavy = groups.where(hot).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h{c}") for c in extra])
    light = groups.where(~hot).select(F.col(key).alias("_lk"), F.lit(0).cast("long").alias("_ls"), *[F.col(c).alias(f"_l{c}") for c in extra])
    out = rows.join(F.broadcast(heavy), rows[key] == heavy["_hk"], "left")
    # hot rows and those without a key are dealt by salt (never 0) and find no light group
    alone = F.col("_hk").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_salt", F.when(alone, F.shiftleft(F.xxhash64(F.monotonically_increasing_id()), 1).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    out = out.join(light, (out[key] == light["_lk"]) & (out["_salt"] == light["_ls"]), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h{c}", f"_l{c}").alias(c) for c in extra if c not in rows.columns])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable over undirected ``edges(u, v)``, as ``(id, component)``.

    Alternates large-star and small-star contraction on DataFrames, so no
    component, adjacency list or edge set is ever gathered in one task or on the
    driver; the driver sees one row (count and checksum) per round. Ids that have
    no edge don't appear. Self loops and nulls are ignored, repeated edges count once.
    """
    e = cut(
        edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .where(F.col("a") < F.col("b"))
        .distinct()
    )

    def mark(d: DataFrame):
        r = d.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        return r["n"], r["s"]

    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = (
            both.where("b > a")
            .join(low, "a")
            .select(F.col("m").alias("a"), F.col("b"))
            .distinct()
        )
        low = big.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            big.join(low, "b")
            .select(F.col("m").alias("a"), F.col("a").alias("b"))
            .where("a < b")
            .union(low.select(F.col("m").alias("a"), F.col("b")))
            .distinct()
        )
        e = cut(small)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)
