"""Ranked search against scores taken one by one."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import impact_search as search


def by_hand(docs, items, k=10):
    terms = [Counter(search.terms_of(t)) for _, t in docs]
    sizes = [c.total() for c in terms]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for c in terms for w in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, n in zip(docs, terms, sizes, strict=True):
            s = 0
            for w, r in Counter(search.terms_of(text)).items():
                if w in c:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    m = 25 + 75 * n * n_docs // length
                    s += r * weight * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def same(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], "doc_id long, text string, terms string, n int, `a.b` string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in search.ranked_search(d, q, **more).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(by_hand(docs, items), key=str)


@pytest.fixture
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["É", "naïve", "名", "Up", "per"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30]))) for i in range(300)]
    docs += [(1000 + i, docs[5][1] + " w1 w1") for i in range(40)]  # ties
    docs += [(None, text(9)), (None, None), (7, "w3 W3"), (7, "w3 W3"), (9000, None), (9001, "... !"), (9002, "w2 " * 20_000)]
    items = [(i, text(8)) for i in range(12)] + [(50, "w1 w1 w1 w2"), (50, "w1"), (51, None), (52, "??"), (53, "unknown"), (54, "w0-W0_w5 É é")]
    return docs, items


def test_against_scores_one_by_one(spark, corpus, monkeypatch):
    same(spark, *corpus)


def test_blocks_and_batches(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 64)
    monkeypatch.setattr(search, "KEPT", 3)
    same(spark, *corpus, max_pairs=30)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked_search(docs.limit(0), items).count() == 0 == search.ranked_search(docs, items.limit(0)).count()
    assert [tuple(r) for r in search.ranked_search(docs, items).collect()] == by_hand([(1, "a b")], [(1, "a")])


def test_carry_arithmetic_and_descent():
    rng = np.random.default_rng(3)
    numbers = [rng.integers(0, 2**34, search.BLOCK) * rng.integers(0, 2, search.BLOCK) for _ in range(5)]
    total, want = [], np.zeros(search.BLOCK, np.int64)
    for k, x in enumerate(numbers):
        places = np.flatnonzero(x)
        bits = search.sliced(x[places])
        search.add(total, search.spread(places, len(bits), bits.tobytes()), k)
        want += x << k
    assert (search.values_at(total, np.arange(search.BLOCK)) == want).all()
    order = np.lexsort((np.arange(search.BLOCK), -want))
    for k in (1, 10, 777):
        assert set(search.best(total, k)) == set(order[:k])
    few = [np.zeros(search.BLOCK // 64, np.uint64)]
    few[0][3] = 5
    assert search.best(few, 10).tolist() == [192, 194] and search.best([], 10).tolist() == []
