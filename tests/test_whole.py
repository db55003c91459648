"""Queries that other tests see only in part, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sievewright.functions import similarity, skills
from sievewright.operators import assistant, matching, profiles, runner
from sievewright.plans import catalogue


def test_matched_missing(spark, tiny):
    def own(df, key):
        return {r[0]: set(r.s) for r in df.select(key, skills.match_skills(df["text"]).alias("s")).collect()}

    docs = own(catalogue.planted_documents(spark, tiny), "doc_id")
    posts = own(catalogue.planted_benchmark(spark, tiny), "item_id")
    want = {(i, j, "|".join(sorted(a & b)), "|".join(sorted(b - a))) for i, a in docs.items() for j, b in posts.items() if a & b}
    got = [tuple(r) for r in catalogue.QUERIES["matched_missing"](spark, tiny).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r[1] % 4 for r in got} == {0, 1, 2, 3}


def test_all_pairs(spark, tiny):
    def same(got, want):
        got, want = {(r[0], r[1]): r[2] for r in got.collect()}, {(r[0], r[1]): r[2] for r in want.collect()}
        assert set(got) == {k for k, v in want.items() if v > 0} and max(k[1] for k in got) == max(k[1] for k in want)
        assert all(abs(v - want[k]) < 2e-6 for k, v in got.items())

    docs, items = catalogue.planted_documents(spark, tiny).select("doc_id", "text"), catalogue.planted_benchmark(spark, tiny)
    a, b = similarity.with_term_counts(docs, "text", "a").drop("text"), similarity.with_term_counts(items, "text", "b").drop("text")
    pairs = a.crossJoin(b)
    same(catalogue.tfidf_pair_cosine(spark, tiny), pairs.select("doc_id", "item_id", similarity.pair_cosine(F.col("a"), F.col("b"))))
    docs, items = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = docs.select("doc_id", "text").crossJoin(items.select("item_id", F.col("text").alias("other")))
    same(catalogue.jaccard_pairs(spark, tiny), pairs.select("doc_id", "item_id", similarity.jaccard(F.col("text"), F.col("other"))))


def test_pair_cosines_where_documents_are(spark, monkeypatch):
    """Pairs are not exchanged; the join on terms gives the same, also of rows that share an id or have none."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"word{k}" for k in rng.zipf(1.5, n) % 40)
    docs = [(i, text(rng.integers(0, 60))) for i in range(600)]
    posts = [(i, text(rng.integers(0, 20))) for i in range(23)] + [(3, "word1 word2 lonely"), (None, "word1"), (50, None)]
    frame = lambda rows, prefix: matching.with_features(spark.createDataFrame(rows, "id long, t string"), "id", "t", prefix)
    key = lambda df: sorted(map(tuple, df.collect()))
    c = similarity.ONE_OF_TWO**2
    cosine = F.expr(f"dot / sqrt((own_a + {c!r}D * (_qa - own_a)) * (own_b + {c!r}D * (_qb - own_b)))").alias("cosine")
    for rows in (docs, [*docs, (7, "word1 word1 word2"), (None, "word1"), (9, None)]):
        for name, value in (("WIDE", 7), ("MEETINGS", 50), ("MAX_TERMS", 100)):
            got = matching.cosine_pairs(frame(rows, "cand"), frame(posts, "post"))
            want = key(matching.term_pairs(frame(rows, "cand"), frame(posts, "post")).select("cand_id", "post_id", cosine))
            assert [x[:2] for x in key(got)] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(key(got), want, strict=True)) and len(want) > 5000
            monkeypatch.setattr(matching, name, value)
        monkeypatch.undo()
    assert "hashpartitioning" not in matching.cosine_pairs(frame(docs, "cand"), frame(posts, "post"))._jdf.queryExecution().toString()


def test_vector_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 7)
    rng = np.random.default_rng(5)
    vecs = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties
    rows = [(i, v.tolist(), ["a", "b", None][i % 3]) for i, v in enumerate(vecs)]
    x = spark.createDataFrame([*rows, (99, None, "a")], "chunk_id bigint, vec array<double>, family string")
    q = x.where("chunk_id % 4 = 0 OR chunk_id = 99").withColumnRenamed("chunk_id", "query_id")
    n = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = np.divide(vecs, n, out=np.zeros_like(vecs), where=n > 0)
    for family in (False, True):
        want = []
        for i in range(0, 60, 4):
            near = [(-round(float(unit[i] @ unit[j]), 6), j) for j in range(60) if not family or rows[i][2] and rows[i][2] == rows[j][2]]
            want += [(i, j, r) for r, (_, j) in enumerate(sorted(near)[:5], 1)]
        got = matching.vector_top_k(q, x, 5, family).select("query_id", "chunk_id", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert matching.vector_top_k(q.limit(0), x, 5).count() == 0 == matching.vector_top_k(q, x.limit(0), 5).count()


def test_suggestions_of_a_model(spark):
    """Drafts of a model: grounded ones pass, invented ones don't, and condition A sees none."""
    html = "<form>" + "".join(f"<p><label>{t} <input name='{n}'></label></p>" for t, n in (("Full name", "a"), ("Cover letter", "b"), ("University", "c"))) + "</form>"
    web = spark.createDataFrame([(1, html), (2, html), (3, html), (4, None)], "page_id bigint, html string")
    asks = spark.createDataFrame([(1, "p1", "c", None, 0.9, None), (2, "p1", "A", None, None, False), (3, "nobody", "B", None, None, False), (4, "p1", "B", "", None, False)],
                                 "page_id bigint, profile_id string, condition string, posting string, retrieval double, overwrite boolean")
    people = catalogue._values(spark, catalogue._PROFILES, catalogue._PROFILE_SCHEMA)
    controls = catalogue.pages.scan_controls(web)
    ids = {r.idx: r.field_id for r in catalogue.forms.normalise_fields(controls).where("page_id = 1").collect()}
    said = {0: "Eve Other", 1: "At Beta Labs Group I led 40 people.", 2: "Example University"}
    drafts = spark.createDataFrame([(p, ids[i], v, 0.9) for p in (1, 2, 3) for i, v in said.items()], "page_id bigint, field_id string, proposed string, model_confidence double")
    out = assistant.suggest(controls, asks, people, drafts)
    got = {(r.page_id, r.idx): (r.decision, r.suggested_value) for r in out.collect()}
    assert got[1, 0] == ("offered", "Ada Example") and got[1, 1] == ("missing", None) and got[1, 2] == ("offered", "Example University")
    assert got[2, 0] == ("offered", "Ada Example") and got[2, 1] == ("missing", None)
    assert {got[3, i] for i in range(3)} == {("missing", None)} and len(got) == 9
    assert {r.page_id: r.total for r in assistant.summarise(out, asks, people).collect()} == {1: 3, 2: 3, 3: 3, 4: 0}


def test_first_facts(spark):
    rows = [("p", "k", "late", 0.9, 2), ("p", "k", "early", 0.1, 1), ("p", "other", None, None, None)]
    df = spark.createDataFrame(rows, "profile_id string, key string, value string, confidence double, position int")
    assert {r.value for r in runner.first_facts(df).collect()} == {"early", None}
    assert {r.value for r in runner.first_facts(df.drop("position")).collect()} == {"late", None}


def test_facts_of(spark):
    people = catalogue._values(spark, catalogue._PROFILES, catalogue._PROFILE_SCHEMA)
    rows = spark.createDataFrame([("p3", ["personal_info", "education"], {"linkedin": " in/x ,", "location": "Oslo", "github": " "}, [{"school": "X College", "gpa": "3.9 / 4"}], [{"title": "hidden"}], None), ("p4", [], None, None, None, None)],
                                 people.schema)
    got = {(r.profile_id, r.key): (r.value, r.confidence) for r in profiles.facts_of(people.unionByName(rows)).collect()}
    assert got["p1", "education_degree"] == ("Master of Science", 0.8) and got["p1", "gpa"] == ("4.5", 0.75) and ("p1", "internship_title") not in got
    assert {k: v for (p, k), v in got.items() if p == "p2"} == {
        "internship_employer": ("Acme Corp", 0.8), "internship_title": ("Intern", 0.8), "internship_dates": ("May", 0.7), "internship_summary": ("Did things", 0.55)}
    mine = {k: v for (p, k), v in got.items() if p == "p3"}
    assert mine["linkedin"] == ("in/x", 0.8) and mine["location"] == ("Oslo", 0.7) and mine["gpa"] == ("3.9 / 4", 0.75) and "github" not in mine
    assert not any(p == "p4" for p, _ in got)
