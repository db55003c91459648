"""Which embedder a run uses: a sentence model where one can be loaded, else TF-IDF of the corpus, else hashed features. What was chosen, why, and whether it is a
lesser one than was asked for is always told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import similarity
from sievewright.operators import sparse

BACKENDS = ("auto", "sentence_transformers", "tfidf", "hashing")
# The names that a record gives the chosen embedder.
TFIDF, HASHING = "tfidf-corpus-fitted", "hashing-fallback"


class Embedder:
    """``encode(texts, id_, text)`` gives the components ``id, feature, x`` that aren't zero; ``info`` describes the choice."""

    def __init__(self, encode: Callable[[DataFrame, str, str], DataFrame], info: dict):
        self.encode, self.info = encode, info


def _hashed(texts: DataFrame, id_: str, text: str) -> DataFrame:
    long = texts.select(F.col(id_).alias("id"), F.posexplode(similarity.hash_embedding(F.coalesce(F.col(text), F.lit("")))).alias("place", "x"))
    return long.where("x <> 0").select("id", F.col("place").cast("string").alias("feature"), "x")


def choose(preference: str | None, corpus: DataFrame | None = None, id_: str = "id", text: str = "text", sentence_model: Callable[[], Embedder] | None = None, max_features: int = sparse.MAX_FEATURES) -> Embedder:
    """The embedder for a preference (default auto). ``sentence_model`` loads a sentence embedder or raises; without one none is at hand.

    A sentence model that was asked for by name and can't be loaded is an error, as is an unknown preference. TF-IDF needs a corpus and is skipped without one.
    """
    wanted = (preference or "auto").lower()
    if wanted not in BACKENDS:
        raise ValueError(f"unknown embedding backend {preference!r}")
    reason = "not requested"
    if wanted in ("sentence_transformers", "auto"):
        try:
            if sentence_model is None:
                raise ModuleNotFoundError("no sentence model is at hand")
            found = sentence_model()
            return Embedder(found.encode, {**found.info, "reason": "sentence model loaded", "downgraded": False, "semantic": True})
        except Exception as e:
            if wanted == "sentence_transformers":
                raise RuntimeError(f"a sentence model was asked for but can't be loaded: {type(e).__name__}: {e}") from e
            reason = f"sentence model unavailable ({type(e).__name__}: {e}); corpus TF-IDF instead"
    if wanted != "hashing" and corpus is not None:
        index = sparse.Index(corpus, id_, text, max_features)
        weights = lambda texts, i, t: index.queries(texts, i, t).select(F.col("query").alias("id"), F.col("term").alias("feature"), F.col("qw").alias("x"))
        return Embedder(weights, {"backend": TFIDF, "reason": reason, "downgraded": wanted != "tfidf", "semantic": False})
    why = "requested" if wanted == "hashing" else "no corpus supplied for the TF-IDF backend"
    return Embedder(_hashed, {"backend": HASHING, "reason": why, "downgraded": True, "semantic": False, "warning": "hashed vectors don't separate families well"})
