"""Streams with state, versions of tables, places in files, seeded samples."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sievewright.operators import runlog, sampling
from sievewright.sources import files, snapshots
from sievewright.streaming import timers


def test_timers_in_batches_equal_the_batch_measure(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for n in range(300):
        phase = rng.choice(["baseline", " Assisted", "assisted", "other"])
        rows.append((f"t{rng.randrange(6)}", f"c{rng.randrange(4)}", phase, rng.choice(["10", "4.5", "x", "-1", "7"]), rng.choice(["baseline_first", "assisted_first", None]), n, 1_700_000_000 + n * 3600))
    batches = [rows[:100], rows[100:180] + rows[40:60], rows[200:] + rows[180:200] + rows[230:240]]  # repeated and late rows
    schema = files.TIMERS + ", ordinal long, at timestamp"
    typed = lambda part: spark.createDataFrame(part, files.TIMERS + ", ordinal long, sec long").select("*", F.timestamp_seconds("sec").alias("at")).drop("sec")
    truth = spark.createDataFrame([("c0",), ("c1",), ("c2",), ("c2",)], "case_id string")
    with timers.keyed_state(spark):
        for k, part in enumerate(batches):
            typed(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            timers.write_parts(timers.pairs(stream, truth), f"{tmp_path}/out", f"{tmp_path}/state")
    got = timers.read_pairs(spark, f"{tmp_path}/out")
    known = typed(rows).where("case_id <> 'c3'")
    key = lambda df: sorted(map(tuple, df.select("timer_id", "case_id", "baseline", "assisted", "assisted_first", "baseline_first").collect()), key=str)
    assert key(got) == key(runlog.timing_pairs(known))
    assert runlog.gate(got).first() == runlog.timing_gate(known).first()


def test_a_pair_is_forgotten_in_time(spark, tmp_path, monkeypatch):
    day = 86400
    rows = [("a", "c", "baseline", "10", None, 0, 900 * day), ("b", "c", "baseline", "10", None, 1, 1000 * day)]
    typed = lambda part: spark.createDataFrame(part, files.TIMERS + ", ordinal long, sec long").select("*", F.timestamp_seconds("sec").alias("at")).drop("sec")
    with timers.keyed_state(spark):
        for part in (rows[:1], rows[1:], [("b", "c", "assisted", "5", None, 2, 1000 * day)]):
            typed(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(files.TIMERS + ", ordinal long, at timestamp").parquet(f"{tmp_path}/in")
            q = timers.write_parts(timers.pairs(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    rows_left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows_left < 3 * 3  # a's state is gone; b's value and timer are left
    assert {(r.timer_id, r.baseline, r.assisted) for r in timers.read_pairs(spark, f"{tmp_path}/out").collect()} == {("a", 10.0, None), ("b", 10.0, 5.0)}


def test_pairs_are_made_without_a_call_for_each(spark, tmp_path):
    """Many pairs, phases in different spans and batches: the batch measure, by Spark's own aggregation."""
    day = 86400
    phases = ("baseline", "assisted", "baseline")
    rows = [(f"t{n % 500}", f"c{n % 7}", phases[k], str(n % 13 + k), None, 10 * n + k, (900 + 8 * k + n % 30) * day) for k in range(3) for n in range(3000)]
    typed = lambda part: spark.createDataFrame(part, files.TIMERS + ", ordinal long, sec long").select("*", F.timestamp_seconds("sec").alias("at")).drop("sec")
    with timers.keyed_state(spark):
        for part in (rows[:4000], rows[4000:]):
            typed(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(files.TIMERS + ", ordinal long, at timestamp").parquet(f"{tmp_path}/in")
            q = timers.write_parts(timers.pairs(stream, late="60 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    plan = q._jsq.explainInternal(False)
    assert "StateStoreSave" in plan and "Pandas" not in plan
    key = lambda df: sorted(map(tuple, df.select("timer_id", "case_id", "baseline", "assisted", "assisted_first", "baseline_first").collect()), key=str)
    got = key(timers.read_pairs(spark, f"{tmp_path}/out"))
    assert len(got) == 3000 and got == key(runlog.timing_pairs(typed(rows)))
    typed([("t", "c", "baseline", "1", None, 0, None)]).write.parquet(f"{tmp_path}/timeless")
    stream = spark.readStream.schema(files.TIMERS + ", ordinal long, at timestamp").parquet(f"{tmp_path}/timeless")
    with timers.keyed_state(spark), pytest.raises(Exception, match="without a time"):
        timers.write_parts(timers.pairs(stream), f"{tmp_path}/none", f"{tmp_path}/state2")


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.versions(spark, root) == [] and snapshots.manifest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root)
    df = spark.range(10).withColumn("x", F.lit("a"))
    assert snapshots.publish(df, root) == 1
    old = snapshots.read(spark, root)
    fails = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("halfway")).cast("string")).otherwise("b").alias("x"))
    with pytest.raises(Exception, match="halfway"):
        snapshots.publish(fails, root)
    assert snapshots.versions(spark, root) == [1] and snapshots.read(spark, root).count() == 10
    assert snapshots.publish(spark.range(3).withColumn("x", F.lit("c")), root, ["x"]) == 2
    assert snapshots.publish(df.limit(0), root) == 3
    assert old.count() == 10 == snapshots.read(spark, root, 1).count() and snapshots.read(spark, root).count() == 0
    assert snapshots.manifest(spark, root, 2)["rows"] == 3 and snapshots.manifest(spark, root, 9) is None
    # a number that another writer took meanwhile isn't replaced
    os.rename(f"{root}/versions/00000003.json", f"{root}/versions/00000004.json")
    assert snapshots.publish(df, root) == 5
    assert snapshots.expire(spark, root, 1) == 3 and snapshots.versions(spark, root) == [5] and snapshots.read(spark, root).count() == 10
    record = snapshots.action_records(spark.createDataFrame([(1, "secret", None)], "id int, profile string, url string"), ["profile", "url"], ["id"]).first()
    assert (record.id, record.profile.chars, record.url.chars) == (1, 6, 0) and "secret" not in str(record)


def test_last_row_of_several_files_and_splits(spark, tmp_path):
    names = [h.split()[0] for h in files.GROUND_TRUTH.split(", ")]
    line = lambda case, v: ",".join(str({"case_id": case, "skill_overlap": v}.get(n, "")) for n in names)
    folder = tmp_path / "g"
    folder.mkdir()
    # the first file is small, so that it is packed behind parts of the second
    (folder / "b.csv").write_text("\n".join([",".join(names), line("a", 1.0), line("k", 0.5)]) + "\n")
    time.sleep(1.1)
    (folder / "a.csv").write_text("\n".join([",".join(names), *[line("a", 2 + i / 1000) for i in range(400)], line("z", 9)]) + "\n")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text("timer_id,case_id,phase,minutes,first_exposure\n" + "".join(f"t,c,baseline,{i + 1},\n" for i in range(300)))
    for size in ("128", "1000", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = {r.case_id: r.skill_overlap for r in files.read_ground_truth(spark, str(folder)).collect()}
            assert got == {"a": 2.399, "k": 0.5, "z": 9.0}
            pair = runlog.timing_pairs(files.read_timers(spark, str(tmp_path / "t"))).first()
            assert pair.baseline == 300
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_last_run_over_appended_files(spark, tmp_path):
    log = str(tmp_path / "log")
    for k, run in enumerate(["r2", "r9", "r1"]):
        files.append_run_log(spark.createDataFrame([(run, "A", f"c{i}", f"n{k}") for i in range(5)], "run_id string, condition string, case_id string, text string"), log)
        time.sleep(1.1)
    last = runlog.last_run(files.read_run_log(spark, log), "ordinal").collect()
    assert {r.run_id for r in last} == {"r1"} and len(last) == 5


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = lambda d, k: {(r.g, r.id) for r in sampling.draw(d, ["g"], ["id"], k).collect()}
    ten = got(df, 10)
    assert len(ten) == 30 and ten < got(df.repartition(7), 11)
    parts = got(df.where("id < 400"), 10) | got(df.where("id >= 400"), 10)
    assert ten <= parts and got(df.where(F.col("id").isin([i for _, i in parts])), 10) == ten
    assert got(df, 1000) == {(i % 3, i) for i in range(1000)} and got(df.limit(0), 5) == set()
    skills = spark.createDataFrame([("f", f"s{i}") for i in range(12)] + [("small", "only"), ("small", "two"), (None, "x"), ("f", None)], "family string, skill string")
    probes = sampling.probe_texts(skills, ["Engineer"]).collect()
    assert len(probes) == 50 and len({r.query for r in probes if r.family == "f"}) > 15
    sizes = [r.query.split(". ")[0].count(",") + 1 for r in probes if r.family == "f"]
    assert min(sizes) >= 5 and max(sizes) <= 12 and all("only" in r.query and "two" in r.query for r in probes if r.family == "small")
