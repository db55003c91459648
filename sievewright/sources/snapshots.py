"""Versioned tables: a version is written in full, then published by one manifest that appears at once or not at all.

``root/data/<name>`` holds the files of a version, ``root/versions/<number>.json`` its manifest. A manifest is written aside and renamed to the next free number; whoever
loses a race for a number takes the next one. Readers pin the number they first see, so that later versions don't change what they read,
and a write that fails halfway leaves nothing but files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, ascending."""
    fs, folder = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The manifest of a version (default: the last); None if there is none."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        return None
    number = known[-1] if version is None else version
    text = spark.read.text(f"{root}/versions/{number:08d}.json", wholetext=True).first()[0]
    return {"version": number, **json.loads(text)}


def publish(df: DataFrame, root: str, by: list[str] | None = None) -> int:
    """Write ``df`` as a version and publish it; its number. ``by`` are partition columns."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/data/{name}")
    rows = spark.read.schema(df.schema).parquet(f"{root}/data/{name}").count()
    text = json.dumps({"data": name, "rows": rows, "schema": df.schema.json()})
    fs, aside = _fs(spark, f"{root}/versions/.{name}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    number = (versions(spark, root) or [0])[-1] + 1
    while True:
        target = _fs(spark, f"{root}/versions/{number:08d}.json")[1]
        # rename doesn't replace a file that is there
        if not fs.exists(target) and fs.rename(aside, target):
            return number
        number += 1


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version (default: the last one published now, whatever is published later)."""
    found = manifest(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"no version {'' if version is None else version} in {root}")
    return spark.read.schema(T.StructType.fromJson(json.loads(found["schema"]))).parquet(f"{root}/data/{found['data']}")


def expire(spark: SparkSession, root: str, keep: int) -> int:
    """Withdraw all but the last ``keep`` versions: first their manifests, then their files. How many went."""
    gone = versions(spark, root)[:-keep] if keep else versions(spark, root)
    for number in gone:
        data = manifest(spark, root, number)["data"]
        for path, deep in ((f"{root}/versions/{number:08d}.json", False), (f"{root}/data/{data}", True)):
            fs, p = _fs(spark, path)
            fs.delete(p, deep)
    return len(gone)


def action_records(actions: DataFrame, texts: list[str], keep: list[str]) -> DataFrame:
    """What a log may hold of actions: the columns of ``keep``, and of the texts (null counts as empty) their length and the first 8 digits of a hash."""
    mark = lambda t: F.struct(F.char_length(t).alias("chars"), F.substring(F.sha2(t, 256), 1, 8).alias("sha256_8"))
    return actions.select(*keep, *[mark(F.coalesce(F.col(t), F.lit(""))).alias(t) for t in texts])
