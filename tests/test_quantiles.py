"""Selection against sorted lists."""

import math
import random

import pytest

from sievewright.operators import quantiles

WANTED = {"p10": ("linear", 0.1), "med": ("linear", 0.5), "p95": ("nearest", 0.95), "top": ("nearest", 1.0), "low": ("nearest", 0.0), "up": ("upper", 0.5)}


def by_hand(xs):
    s = sorted(xs)
    n = len(s)
    if not n:
        return dict.fromkeys(WANTED)

    def linear(q):
        p = (n - 1) * q
        return s[math.floor(p)] + (s[math.ceil(p)] - s[math.floor(p)]) * (p - math.floor(p))

    near = lambda q: s[max(0, math.ceil(q * n) - 1)]
    return {"p10": linear(0.1), "med": linear(0.5), "p95": near(0.95), "top": near(1.0), "low": near(0.0), "up": s[n // 2]}


@pytest.mark.parametrize("few", [20_000, 3])
def test_groups(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(1)
    groups = {
        "wide": [rng.uniform(-1e12, 1e12) * rng.random() ** 9 for _ in range(3000)], "one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 500, None: [rng.gauss(0, 1) for _ in range(700)],
        "steps": [float(rng.randint(0, 5)) for _ in range(1000)], "heavy": [0.0] * 900 + [rng.random() for _ in range(300)], "none": [],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("two", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.asDict() for r in quantiles.quantiles(df, ["g"], "x", WANTED).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, want in by_hand(xs).items():
            assert got[g][name] == (None if want is None else pytest.approx(want, rel=1e-12)), (g, name)


def test_whole_and_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert quantiles.quantiles(df, [], "x", {"m": ("linear", 0.25)}).first().m == 2.5
    assert quantiles.quantiles(df.limit(0), [], "x", {"m": ("linear", 0.25)}).count() == 0
