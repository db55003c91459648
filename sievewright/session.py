"""Session factory and table access."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and adaptive execution."""
    builder = (
        SparkSession.builder.master(master)
        .appName("sievewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table whose files split into fewer tasks than there are cores, dealt to all cores; a larger one as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``; only a local master may do with a new one of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievewright-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A table written to the shared folder once, for what several steps read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
