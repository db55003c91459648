"""Columns that bear the names an operator uses inside change nothing."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import sievewright.llm as llm
from sievewright.llm import (
    byte_bpe,
    cover_tree,
    exact_dedup,
    impact_search,
    language_id,
    line_dedup,
    masked_lm,
    merkle,
    mixing,
    sharding,
    simhash,
    substring_dedup,
    url_filter,
)
from sievewright.llm.common import quoted
from sievewright.llm.queries import tokenizer

#: Names that the data or the result own.
OWN = {"doc_id", "text", "lang", "source", "n_chars", "vec_id", "embedding", "page_id", "url", "html", "item_id"}


#: Names that need quotes.
ODD = ["a.b", "with space", "Upper.Case", "back`tick"]


def inner_names() -> list[str]:
    """Every identifier that stands as a string in the operators' sources."""
    found = set()
    for path in Path(llm.__file__).parent.glob("*.py"):
        if path.name != "queries.py":
            found |= set(re.findall(r"[\"']([a-z_][a-z0-9_]*)[\"']", path.read_text()))
    return sorted(found - OWN)


def with_clashes(df):
    return df.select("*", *[F.lit("x").alias(n) for n in [*inner_names(), *ODD]])


@pytest.fixture(scope="module")
def docs(spark):
    words = "the quick brown fox jumps over one lazy dog near two old barns by night"
    rows = [(i, f"{words} {i % 7} again", "en" if i % 2 else "de", "a" if i % 3 else "b", 10) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(20)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, f"https://a{i}.example.org/en/{i}?x", "") for i in range(20)], "page_id long, url string, html string")


DOC_CASES = {
    "mix": mixing.mix,
    "identify": lambda d: language_id.identify(d, language_id.train(d)),
    "label": lambda d: language_id.label(d, language_id.train(d)),
    "known": lambda d: language_id.known(d, language_id.train(d)),
    "exact": exact_dedup.exact_dedup,
    "exact_filter": exact_dedup.deduplicated,
    "simhash": simhash.simhash_dedup,
    "simhash_filter": simhash.deduplicated,
    "substring": substring_dedup.substring_dedup,
    "bpe": lambda d: byte_bpe.encode_documents(d, *tokenizer(), keep=["doc_id", "source", "lang"]),
    "lm": masked_lm.pseudo_likelihood,
    "line": line_dedup.line_dedup,
    "shards": lambda d: sharding.shard(d).select("row.doc_id", "row.text", "shard", "slot"),
    "merkle": merkle.manifest,
    "search": lambda d: impact_search.ranked_search(d, d.where("doc_id % 5 = 0").withColumnsRenamed({"doc_id": "item_id"})),
}


def same(run, df):
    plain = run(df)
    got = run(with_clashes(df))
    names = [c for c in plain.columns if c != "removed"]
    # a result that keeps the input's columns gives its own another name
    mine = [f"_{c}" if c not in df.columns and f"_{c}" in got.columns else c for c in names]
    assert sorted(map(tuple, got.select(mine).collect()), key=str) == sorted(map(tuple, plain.select(names).collect()), key=str)


@pytest.mark.parametrize("name", DOC_CASES)
def test_documents(docs, name):
    same(DOC_CASES[name], docs)


def test_many_labels(spark):
    n = 2000
    rows = spark.range(4 * n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" again and again")).alias("text"),
        F.concat(F.lit("l"), F.col("id") % n).alias("lang"),
    )
    model = language_id.train(rows)
    assert len(model.langs) > 0.99 * n
    few = rows.where("doc_id < 8")
    assert language_id.identify(few, model).count() == 8


def test_filters_return_the_columns_of_documents_as_they_were(docs, spark):
    import corpus_pipeline

    clashing = with_clashes(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clashing, "")
        assert got.columns == clashing.columns and got.count()
        assert got.where(" or ".join(f"{quoted(n)} <> 'x'" for n in [*inner_names(), *ODD])).count() == 0


def test_vectors(vectors):
    same(cover_tree.embedding_dedup, vectors)


def test_pages(pages):
    same(url_filter.url_filter, pages)
