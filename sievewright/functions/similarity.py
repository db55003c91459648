"""Text and vector similarity."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.skills import trie

# Our own explicit list of function words. The usual machine-learning lists differ from one another; this
# one is fixed here so that both engines agree.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can "
    "could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it "
    "its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such "
    "than that the their theirs them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your yours"
).split()
#: Inverse document frequency of a term that one of two texts has (the other's is 1), with smoothing.
ONE_OF_TWO = 1 + math.log(1.5)


def with_terms(df: DataFrame, text: str, out: str, stop_words: list[str] | None = None) -> DataFrame:
    """Adds the terms of a text: words of two and more word characters, stop words dropped (``stop_words``, in lower case, or the own list), then pairs of neighbours.

    One pattern passes over stop words as it finds the others. Built in stages, as an expression that a lambda captures would be evaluated anew for each element.
    """
    one = r"[\p{L}\p{N}_]"
    pattern = rf"(?<!{one})(?!{trie(STOP_WORDS if stop_words is None else stop_words)}(?!{one})){one}{{2,}}"
    df = df.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0)))
    words = F.col("_words")
    heads = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(heads, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return df.withColumn(out, F.concat(words, pairs)).drop("_words")


def with_term_counts(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds a map of each term to how often it occurs, in time linear in the sorted terms."""
    df = with_terms(df, text, "_terms").withColumn("_sorted", F.array_sort("_terms"))
    t = F.col("_sorted")
    df = df.withColumn(
        "_starts",
        F.when(F.size(t) > 0, F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))).otherwise(
            F.array().cast("array<int>")
        ),
    )
    s = F.col("_starts")
    ends = F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(t) + 1))
    counts = F.map_from_arrays(F.transform(s, lambda i: F.element_at(t, i)), F.zip_with(s, ends, lambda a, b: b - a))
    return df.withColumn(out, F.when(F.size(s) > 0, counts).otherwise(F.create_map().cast("map<string,int>"))).drop("_terms", "_sorted", "_starts")


def pair_cosine(a: Column, b: Column) -> Column:
    """TF-IDF cosine of two term-count maps in the space of just the two; 0 if either has no term.

    With two texts the inverse document frequency is 1 for shared terms and ``ONE_OF_TWO`` for others, so nothing
    needs fitting.
    """
    sq = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)
    # the smaller map is walked, the other looked up
    shared = F.filter(F.transform(F.map_entries(a), lambda e: F.struct(e["value"].alias("x"), F.element_at(b, e["key"]).alias("y"))), lambda e: e["y"].isNotNull())
    dot = F.aggregate(shared, F.lit(0.0), lambda s, e: s + e["x"] * e["y"])
    own_a = F.aggregate(shared, F.lit(0.0), lambda s, e: s + e["x"] * e["x"])
    own_b = F.aggregate(shared, F.lit(0.0), lambda s, e: s + e["y"] * e["y"])
    norm = lambda m, own: own + ONE_OF_TWO**2 * (sq(m) - own)
    product = norm(a, own_a) * norm(b, own_b)
    return F.when(product > 0, dot / F.sqrt(product)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the words of either text that both have; 0 if either is blank."""
    split = lambda t: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 0))
    x, y = split(a), split(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; zero stays zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


# The parameters of 64-bit FNV-1a, and the embedding's size.
FNV_OFFSET, FNV_PRIME, HASH_DIM = 0xCBF29CE484222325, 0x100000001B3, 1024


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def hash_features(text: str, dim: int = HASH_DIM) -> list[float]:
    """Signed feature hashing of words (two and more letters or digits) and of every second 4-gram of theirs, L2-normalised.

    The place is the hash modulo the size, the sign its bit 32.
    """
    import numpy as np

    words = [w for w in re.sub(r"[\W_]", " ", text).lower().split() if len(w) > 1]
    line = " ".join(words)
    hashes = [fnv1a(f.encode()) for f in words + [line[i : i + 4] for i in range(0, len(line) - 4, 2)]]
    out = np.zeros(dim)
    np.add.at(out, [h % dim for h in hashes], [-1.0 if h >> 32 & 1 else 1.0 for h in hashes])
    n = np.linalg.norm(out)
    return (out / n if n else out).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hash_features(t or ""))
