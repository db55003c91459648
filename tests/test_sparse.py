"""The TF-IDF index against all weights and scores taken one by one."""

import math
import random
from collections import Counter

import pytest

from sievewright.operators import sparse


def terms(text):
    words = [w for w in (text or "").lower().split() if len(w) > 1]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def by_hand(docs, queries, most, k):
    tf = {i: terms(t) for i, t in docs}
    total, df = Counter(), Counter()
    for t in tf.values():
        total.update(t)
        df.update(t.keys())
    features = sorted(total, key=lambda w: (-total[w], w))[:most]
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in features}

    def vector(t):
        v = {w: (1 + math.log(n)) * idf[w] for w, n in t.items() if w in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    vectors = {i: vector(t) for i, t in tf.items()}
    out = set()
    for q, t in queries:
        v = vector(terms(t))
        scored = sorted((-round(sum(x * d[w] for w, x in v.items() if w in d), 6), i) for i, d in vectors.items() if v.keys() & d.keys())
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(scored[:k], 1)}
    return features, out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    docs = [(i, text(rng.choice([2, 9, 40, 120]))) for i in range(250)]
    docs += [(300 + i, docs[3][1]) for i in range(12)] + [(400, None), (401, ""), (402, "unseen words"), (403, "w1 " * 3000)]
    return docs, [(i, text(12)) for i in range(20)] + [(50, None), (51, "nothing here"), (52, docs[3][1])]


@pytest.mark.parametrize(("most", "k"), [(4096, 4), (90, 4), (25, 20)])
def test_against_scores_one_by_one(spark, corpus, most, k):
    docs, queries = corpus
    features, want = by_hand(docs, queries, most, k)
    index = sparse.Index(spark.createDataFrame(docs, "id long, text string"), "id", "text", most, [])
    assert {r.term for r in index.features.collect()} == set(features)
    q = index.queries(spark.createDataFrame(queries, "q long, text string"), "q", "text")
    got = {(r.query, r.id, r.similarity, r["rank"]) for r in index.top_k(q, k).collect()}
    assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want}
    assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in want), abs=1e-4)


def test_lists_are_skipped_and_by_exchange_alike(spark, corpus, monkeypatch):
    docs, queries = corpus
    index = sparse.Index(spark.createDataFrame(docs, "id long, text string"), "id", "text", stop_words=[])
    q = index.queries(spark.createDataFrame(queries, "q long, text string"), "q", "text")
    plan = index.plan(q, 4)
    seen = index.touched(plan).collect()
    assert 0 < sum(r.read for r in seen) < sum(r.postings for r in seen)
    want = sorted(map(tuple, index.top_k(q, 4, plan).collect()))
    monkeypatch.setattr(sparse, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, index.top_k(q, 4).collect())) == want


def test_empty(spark):
    some, none = spark.createDataFrame([(1, "alpha beta")], "id long, text string"), spark.createDataFrame([], "id long, text string")
    for docs, asks in ((some, none), (none, some)):
        index = sparse.Index(docs, "id", "text")
        assert index.top_k(index.queries(asks, "id", "text"), 3).count() == 0


def test_choice_of_an_embedder(spark):
    from sievewright.operators import embedding

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "id long, text string")
    tell = lambda *a, **k: (embedding.choose(*a, **k).info["backend"], embedding.choose(*a, **k).info["downgraded"])
    assert tell("auto", docs) == tell(None, docs) == (embedding.TFIDF, True) and tell("tfidf", docs) == (embedding.TFIDF, False)
    assert tell("auto") == tell("tfidf") == tell("hashing", docs) == (embedding.HASHING, True)
    model = embedding.Embedder(lambda t, i, x: t, {"backend": "a model"})
    assert tell("auto", docs, sentence_model=lambda: model) == tell("sentence_transformers", sentence_model=lambda: model) == ("a model", False)
    with pytest.raises(RuntimeError, match="can't be loaded"):
        embedding.choose("sentence_transformers", docs)
    with pytest.raises(ValueError, match="unknown"):
        embedding.choose("other")
    for backend in ("tfidf", "hashing"):
        rows = embedding.choose(backend, docs).encode(docs, "id", "text").collect()
        norms = {i: sum(r.x**2 for r in rows if r.id == i) for i in {r.id for r in rows}}
        assert set(norms) == {1, 2} and all(abs(n - 1) < 1e-9 for n in norms.values())
