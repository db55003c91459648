"""Sharding against the two passes done by hand, and what holds of any result."""

import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sievewright.llm import sharding
from sievewright.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, `a.b` string, shard string, slot string, bucket string, row string"


def by_hand(records, total_bytes, shards, seed, bucket_bytes):
    """``records``: (place, record). Scatter by XXH64 of seed and place, shuffle each bucket, deal the order out."""
    buckets = max(1, -(-total_bytes // bucket_bytes))
    held = {}
    for place, record in records:
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", place), h)
        h -= (h >> 63) << 64
        held.setdefault(h % buckets, []).append((h, record))
    order = []
    for b in sorted(held):
        rows = [r for _, r in sorted(held[b], key=lambda x: x[0])]
        order += [rows[i] for i in sharding.fisher_yates(len(rows), seed, b)]
    n = len(order)
    out = []
    for at, record in enumerate(order):
        s = at * shards // n
        out.append((record, s, at - -(-s * n // shards)))
    return out


@pytest.mark.parametrize(("n", "shards", "bucket_bytes"), [(500, 16, 300), (37, 5, 10**9), (3, 16, 1), (501, 4, 4000)])
def test_against_the_passes_by_hand(spark, n, shards, bucket_bytes):
    rows = [(i if i % 9 else None, None if i % 11 == 0 else "x" * (i % 50), "dot", "s", "t", "b", "r") for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    placed = [(r._id, tuple(r)[:-1]) for r in df.withColumn("_id", F.monotonically_increasing_id()).collect()]
    want = by_hand(placed, sum(len(r[1] or "") for r in rows), shards, 7, bucket_bytes)
    got = [(tuple(r.row), r.shard, r.slot) for r in sharding.shard(df, shards, 7, bucket_bytes=bucket_bytes).collect()]
    assert got == want  # in this order, too
    sizes = Counter(s for _, s, _ in got)
    assert max(sizes.values()) - min([sizes[s] for s in range(shards)]) <= 1


def test_copies_spread_and_repeated_rows_all_come_out(spark):
    df = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    got = sharding.shard(df, 4, bucket_bytes=1000).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert sorted((r.shard, r.n, r.k, r.m) for r in got) == [(s, 1500, 1500, 1499) for s in range(4)]


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, 1, b).tolist()) for b in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert sharding.fisher_yates(0, 1, 1).tolist() == [] and sharding.fisher_yates(1, 1, 1).tolist() == [0]


def test_files_and_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "dot", "s", "t", "b", "r") for i in range(100)], SCHEMA)
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    read = spark.read.parquet(f"{tmp_path}/in")
    place = F.struct("_metadata.file_name", "_metadata.row_index")
    sharding.write_shards(sharding.shard(read, 3, row=place, bucket_bytes=100), f"{tmp_path}/out")
    got = sharding.read_shards(spark, f"{tmp_path}/out", df.schema)
    plain = sorted((r.shard, r.slot, r.row.doc_id) for r in got.collect())
    assert sorted(i for _, _, i in plain) == list(range(100)) and [i for *_, i in plain] != list(range(100))
    # the order depends on the files alone, not on splits or partitions
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        again = sharding.shard(spark.read.parquet(f"{tmp_path}/in"), 3, row=place, bucket_bytes=100)
        assert sorted((r.shard, r.slot, r.row.doc_id) for r in again.collect()) == plain
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sharding.write_shards(sharding.shard(df.limit(0)), f"{tmp_path}/none")
    assert sharding.read_shards(spark, f"{tmp_path}/none", df.schema).count() == 0


def test_starts_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_GROUP", 3)
    counts = spark.createDataFrame([(b, b % 4 + 1) for b in range(20) if b != 7], "bucket long, n long")
    got = {r.bucket: r.start for r in sharding.bucket_starts(counts).collect()}
    start = 0
    for b in range(20):
        if b != 7:
            assert got[b] == start
            start += b % 4 + 1


def test_query(spark, tiny):
    got = QUERIES["op11_sharding"](spark, tiny).toPandas()
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert len(got) == len(docs) == got["doc_id"].nunique()
    import zlib

    for r in got.itertuples():
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "rows")
    per = got.groupby("shard")["slot"]
    assert set(got["shard"]) == set(range(16)) and per.count().max() - per.count().min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in per) and got["grown_shard"].isna().all()
