"""Containment by anchors, and walks over nested records."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions import records
from sievewright.operators import audit, containment
from sievewright.session import cut


@pytest.fixture(scope="module")
def haystack():
    rng = random.Random(2)
    letters = "abcde -.\n" + "é😀"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 60, 400])))) for i in range(80)]
    texts += [(100, None), (101, "the same line, again and again " * 30), (102, "the same line, again and again ")]
    needles = []
    for _ in range(150):
        t = rng.choice(texts[:80])[1]
        at, n = rng.randrange(len(t) + 1), rng.choice([1, 2, 3, 7, 8, 9, 12, 30])
        needles.append(t[at : at + n])
    return texts, [*needles, "absent string", "zzz", "x", "", None, "line, again", "e again and again the", "éé", "+", "a" * 20]


@pytest.mark.parametrize("most", [200_000, 3])
def test_find_is_contains(spark, haystack, monkeypatch, most):
    monkeypatch.setattr(containment, "MAX_BROADCAST", most)
    texts, needles = haystack
    got = containment.find(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(n,) for n in needles], "needle string"), "id", "t")
    want = {(i, n) for i, t in texts if t is not None for n in needles if n and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_long_needles_are_not_multiplied(spark, monkeypatch):
    """Whole lines as needles: what is written stays near the size of the texts. Rows may lack an id or share one."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(n)) for n in (3000, 3000, 3000, 900, 40, 12, 5)]
    lines += ["".join(rng.choice("abcé") for _ in range(5000)), "nr. " + lines[0], "日本語" * 400 + "終", lines[1][:9000]]
    texts = [(None if k % 5 == 0 else k % 7, f"head\n{line} tail") for k, line in enumerate(lines)] + [(None, lines[3]), (3, lines[4] * 2)]
    needles = [*lines, lines[0] + "x", lines[2][1:], "x" + lines[2], lines[7][3:], lines[9][5:]]
    folder = cut(spark.range(1)).sparkSession.sparkContext.getCheckpointDir().removeprefix("file:")
    used = lambda: sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())
    for most in (200_000, 0):
        monkeypatch.setattr(containment, "MAX_BROADCAST", most)
        before = used()
        got = containment.find(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(n,) for n in needles], "needle string"), "id", "t").collect()
        assert used() - before < 10 * sum(len(t.encode()) for _, t in texts)
        want = {(i, n) for i, t in texts for n in needles if n in t}
        assert {tuple(r) for r in got} == want and len(got) == len(want) and any(i is None for i, _ in want)


def test_leaks_have_no_nested_loop(spark, haystack):
    texts = spark.createDataFrame(haystack[0], "file long, value string")
    secrets = spark.createDataFrame([("line, again and",), ("never there",)], "sentinel string")
    hits = audit.leaks(texts, secrets)
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.file for r in hits.collect()) == [101, 102]
    none = spark.createDataFrame([], "sentinel string")
    assert audit.leaks(texts, none).count() == 0 == audit.leaks(texts.limit(0), secrets).count()


def test_profile_sentinels(spark):
    profile = "struct<name:string,notes:string,contact:map<string,string>,jobs:array<struct<title:string,firm:string,tags:array<string>>>,n:int>"
    rows = [((" Ada Example ", "private words here", {"mail": "a@b.org", "purpose": "to be seen", "home": None}, [("Some Title", "Acme Corp.", ["deep-learning", "Singapore", None]), None], 3),), (None,)]
    got = audit.profile_sentinels(spark.createDataFrame(rows, f"p {profile}"), "p").collect()
    assert {r.sentinel for r in got} == {"Ada Example", "Acme Corp.", "deep-learning"}


def test_scrub_and_strip_any_shape(spark):
    kind = T._parse_datatype_string("struct<a:struct<TEXT:string,b:array<struct<prompt:string,x:int>>>,m:map<string,map<string,string>>,i:map<int,string>,l:array<array<string>>,passport_no:string>")
    value = (("é", [("p", 1), None, (None, 2)]), {"content": {"content": "c", "k": "v", "text": None}}, {1: "kept"}, [["t"]], "X1")
    df = spark.createDataFrame([(value,), (None,)], T.StructType([T.StructField("r", kind)]))
    got = df.select(records.scrub(F.col("r"), kind).alias("s"), records.strip(F.col("r"), kind).alias("t")).collect()
    s = got[0].s
    assert (s.a.TEXT.chars, s.a.b[0].prompt.chars, s.a.b[0].x, s.a.b[1], s.a.b[2].prompt) == (1, 1, 1, None, None)
    inner = s.m["content"]
    assert json.loads(inner["content"])["chars"] == 1 and inner["k"] == "v" and inner["text"] is None
    assert s.i == {1: "kept"} and s.l == [["t"]] and got[1].s is None
    assert "passport_no" not in got[0].t.asDict() and got[0].t.a.TEXT == "é" and got[1].t is None


def test_names(spark):
    names = ["passport_no", "student_id", "NRIC", "id-number", "email", "taxId", "candidate reference no", "Licence.No", "identity card"]
    df = spark.createDataFrame([(n,) for n in names], "k string").select("k", records.key_forbidden(F.col("k")).alias("f"))
    assert {r.k: r.f for r in df.collect()} == {n: records.name_forbidden(n) for n in names}
