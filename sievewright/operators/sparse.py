"""TF-IDF retrieval over a corpus: features chosen by frequency, an inverted index with bounds, exact top-k that skips postings.

The features are the ``max_features`` most frequent terms of the corpus (ties by term), their inverse document frequencies
are smoothed, weights are sublinear and every vector has length 1. The index keeps (term, document, weight) and, for each class of documents with about as many
features, each term's largest weight.

A query's terms of least weight are left out of its first pass as far as what they can add stays below a score that its k-th best
document is known to reach. What a set of terms can add is bounded twice: by the sum of query weight times the class's largest weight,
and, as documents have length 1, by the length of the query's part in these terms. Documents that can still reach the k-th score are then completed
by lookups of (document, term). Short, rare lists are read whole; the long lists of common terms only for candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import similarity
from sievewright.session import cut

#: Fixed value: the number of features.
MAX_FEATURES = 4096
#: Slack of bounds, above the rounding of scores.
SLACK = 2e-6
#: Query terms (all queries together) up to which they are sent to all tasks.
MAX_BROADCAST = 500_000


def occurrences(texts: DataFrame, id_: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """``id, term`` of every term of each text, repeats included."""
    df = similarity.with_terms(texts.select(F.col(id_).alias("id"), F.col(text).alias("_text")), "_text", "terms", stop_words)
    return df.select("id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


def counted(rows: DataFrame) -> DataFrame:
    """``id, term, tf`` of occurrences."""
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def frequent(rows: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The features ``term``: the most frequent terms of occurrences, ties by term."""
    totals = rows.groupBy("term").agg(F.count("*").alias("total"))
    return cut(totals.orderBy(F.col("total").desc(), "term").limit(max_features).select("term"))


def fit(tf: DataFrame, n_docs: int) -> DataFrame:
    """``term, idf`` of the counted features of a corpus of ``n_docs`` texts."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return cut(df.select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")))


def transform(tf: DataFrame, features: DataFrame) -> DataFrame:
    """``id, n, term, w``: the feature weights of each text, scaled to length 1, and how many it has. Texts without a feature have no row.

    A text has at most as many rows as there are features, which are broadcast.
    """
    rows = tf.join(F.broadcast(features), "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    held = rows.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    held = held.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])))
    return held.select("id", "norm", F.size("v").alias("n"), F.explode("v").alias("x")).select("id", "n", F.col("x.term").alias("term"), (F.col("x.w") / F.col("norm")).alias("w"))


class Index:
    """Postings and bounds of a corpus: made once, searched by many queries."""

    def __init__(self, corpus: DataFrame, id_: str, text: str, max_features: int = MAX_FEATURES, stop_words: list[str] | None = None):
        self.stop_words = stop_words
        rows = occurrences(corpus, id_, text, stop_words)
        # texts are read twice, so that only features are counted by document
        tf = cut(counted(rows.join(F.broadcast(frequent(rows, max_features)), "term")))
        self.features = fit(tf, corpus.count())
        # classes double in size, so that a class's largest weights are near those of all its documents
        postings = transform(tf, self.features).select("id", F.floor(F.log2("n")).cast("int").alias("kind"), "term", "w")
        self.postings = cut(postings)
        self.bounds = cut(self.postings.groupBy("kind", "term").agg(F.max("w").alias("top"), F.count("*").alias("df")))

    def queries(self, texts: DataFrame, id_: str, text: str) -> DataFrame:
        """``query, term, qw``: texts in the corpus's features."""
        return transform(counted(occurrences(texts, id_, text, self.stop_words)), self.features).select(F.col("id").alias("query"), "term", F.col("w").alias("qw"))

    def _near(self, q: DataFrame, n: int) -> DataFrame:
        return F.broadcast(q) if n <= MAX_BROADCAST else q

    def plan(self, queries: DataFrame, k: int) -> DataFrame:
        """``query, kind, term, qw, df, needed, theta, rest``: which lists of which class a query has to read.

        ``theta`` is a score that k documents reach: the k best by the rarest terms are scored in full. ``rest`` bounds what the lists that aren't needed can add.
        """
        q = cut(queries)
        n = q.count()
        asked = q.join(F.broadcast(self.bounds), "term")  # at most 32 classes of each feature
        whole = asked.groupBy("query", "term", "qw").agg(F.sum("df").alias("all"))
        rare = Window.partitionBy("query").orderBy(F.col("qw").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
        first = whole.withColumn("before", F.coalesce(F.sum("all").over(rare), F.lit(0))).where(F.col("before") < 8 * k)
        part = self.postings.join(self._near(first.select("query", "term", "qw"), n), "term").groupBy("query", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("part"))
        ranked = part.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("part").desc(), "id"))).where(F.col("r") <= k)
        full = self.postings.join(self._near(ranked.select("query", "id"), k * n), "id").join(self._near(q, n), ["query", "term"])
        sure = full.groupBy("query", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("score")).groupBy("query").agg(F.min("score").alias("low"), F.count("*").alias("c"))
        theta = sure.select("query", F.when(F.col("c") >= k, F.col("low")).otherwise(F.lit(0.0)).alias("theta"))
        up = Window.partitionBy("query", "kind").orderBy("qw", F.col("term").desc()).rowsBetween(Window.unboundedPreceding, 0)
        can = F.least(F.sum(F.col("qw") * F.col("top")).over(up), F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(up)))
        out = asked.withColumn("can", can).join(theta, "query", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)) - SLACK)
        out = out.withColumn("needed", F.col("can") >= F.col("theta"))
        rest = F.coalesce(F.max(F.when(~F.col("needed"), F.col("can"))).over(Window.partitionBy("query", "kind")), F.lit(0.0))
        return cut(out.select("query", "kind", "term", "qw", "df", "needed", "theta", rest.alias("rest")))

    def candidates(self, plan: DataFrame) -> DataFrame:
        """``query, id, kind, part``: documents that may reach theta, scored by the lists that were needed."""
        need = plan.where("needed").select("query", "kind", "term", "qw", "theta", "rest")
        hits = self.postings.join(self._near(need, need.count()), ["kind", "term"])
        got = hits.groupBy("query", "id", "kind").agg(F.sum(F.col("qw") * F.col("w")).alias("part"), F.first("theta").alias("theta"), F.first("rest").alias("rest"))
        return got.where(F.col("part") + F.col("rest") >= F.col("theta")).select("query", "id", "kind", "part")

    def complete(self, plan: DataFrame, found: DataFrame) -> DataFrame:
        """``query, id, score``: candidates with what their remaining terms add, looked up by (document, term)."""
        left = plan.where("NOT needed").select("query", "kind", "term", "qw")
        asked = found.join(self._near(left, left.count()), ["query", "kind"]).select("query", "id", "term", "qw")
        more = asked.join(self.postings.select("id", "term", "w"), ["id", "term"]).select("query", "id", (F.col("qw") * F.col("w")).alias("part"))
        return found.select("query", "id", "part").union(more).groupBy("query", "id").agg(F.sum("part").alias("score"))

    def top_k(self, queries: DataFrame, k: int, plan: DataFrame | None = None) -> DataFrame:
        """``query, id, similarity, rank``: the k nearest of each query by cosine (rounded to 6 places, ties by id), of those that share a feature with it."""
        plan = self.plan(queries, k) if plan is None else plan
        scored = self.complete(plan, cut(self.candidates(plan))).select("query", "id", F.round("score", 6).alias("similarity"))
        order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def touched(self, plan: DataFrame) -> DataFrame:
        """``query, lists, read, postings, candidates``: lists and postings that a query has, those that its first pass reads, and what it looks up."""
        lists = plan.groupBy("query").agg(F.count("*").alias("lists"), F.sum(F.when(F.col("needed"), F.col("df")).otherwise(0)).alias("read"), F.sum("df").alias("postings"))
        return lists.join(self.candidates(plan).groupBy("query").agg(F.count("*").alias("candidates")), "query", "left").fillna(0, ["candidates"])
