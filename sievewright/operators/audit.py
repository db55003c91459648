"""Audits: sensitive keys, distinctive strings that must not leak, quotes against their source, counts of decisions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions import records
from sievewright.functions.records import key_forbidden
from sievewright.operators import containment

# Glyphs of quotes, and of dashes and dots with what they become.
QUOTES = "“”‘’\"'«»"
FOLDED = {"—": "-", "–": "-", "−": "-", "…": "..."}


def strip_forbidden(record: Column) -> Column:
    """A map without the keys that are never stored."""
    return F.map_filter(record, lambda k, _: ~key_forbidden(k))


def sentinels(texts: DataFrame, text: str) -> DataFrame:
    """Distinctive strings: lines of twelve and more characters with a blank, once each."""
    line = F.explode(F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^[ \-*\t]+|[ \-*\t]+$", "")))
    return texts.select(line.alias("sentinel")).where((F.length("sentinel") >= 12) & F.contains("sentinel", F.lit(" "))).distinct()


def profile_sentinels(profiles: DataFrame, column: str) -> DataFrame:
    """Distinctive strings of nested profiles: values at any depth of eight and more characters with a blank or a symbol, once each."""
    values = records.strings(F.col(column), profiles.schema[column].dataType, records.NOT_PRIVATE)
    value = profiles.select(F.explode(values).alias("value")).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("sentinel"))
    return value.where((F.char_length("sentinel") >= 8) & F.col("sentinel").rlike("[^A-Za-z0-9]")).distinct()


def leaks(files: DataFrame, secrets: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """Files that contain a sentinel, with the hash of which."""
    return containment.find(files, secrets.select(F.col("sentinel").alias("needle")), file, text, F.substring(F.sha2("needle", 256), 1, 8).alias("sha256_8"))


def fold(s: str | None) -> str | None:
    if s is None:
        return None
    s = unicodedata.normalize("NFKC", s)
    for q in QUOTES:
        s = s.replace(q, "'")
    for a, b in FOLDED.items():
        s = s.replace(a, b)
    return "".join(s.split()).lower()


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Text as quotes are compared: compatibility forms, one quote sign, one dash, no white space, lower case."""
    return text.map(fold)


def find_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Where each quote stands: ``quotes(quote_id, deck, quote)`` in windows ``lines(deck, line_no, page, window_text)`` of the same deck."""
    q = quotes.select("quote_id", "deck", folded("quote").alias("_q"))
    w = lines.select("deck", "line_no", "page", folded("window_text").alias("_w"))
    hit = q.join(w, "deck").where(F.contains("_w", "_q")).groupBy("quote_id").agg(F.min(F.struct("line_no", "page")).alias("at"))
    return quotes.join(hit, "quote_id", "left").select("quote_id", F.col("at").isNotNull().alias("found"), F.col("at.page").alias("page"))


def scan_counts(fields: DataFrame) -> DataFrame:
    """Per page: controls, fillable, required, already filled, sensitive, skipped."""
    c = F.col
    return fields.groupBy("page_id").agg(
        F.count("*").alias("total"), F.count_if("fillable").alias("fillable"), F.count_if(c("required") & c("fillable")).alias("required"),
        F.count_if("already_filled").alias("already_filled"), F.count_if("sensitive").alias("sensitive"), F.count_if(~c("fillable")).alias("skipped"),
    )


def partition_violations(decisions: DataFrame) -> DataFrame:
    """Pages whose decisions don't add up to their controls, or are of no known kind (none are expected)."""
    known = ("offered", "abstained", "missing", "sensitive_skipped", "not_fillable", "already_filled")
    return decisions.groupBy("page_id").agg(F.count("*").alias("controls"), F.count_if(F.col("decision").isin(*known)).alias("decided")).where("controls <> decided")


def source_fingerprint(files: DataFrame) -> DataFrame:
    """One hash over the content of a ``binaryFile`` table, in order of path. For few, small files."""
    one = files.select("path", F.sha2("content", 256).alias("h"))
    return one.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"), F.count("*").alias("files"))


def verdict_counts(sheet: DataFrame, column: str, line: str = "value", order: str = "line_no") -> DataFrame:
    """Counts of the values in a named column of a Markdown table."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = sheet.where(F.trim(line).startswith("|")).select(order, cells.alias("cells"))
    head = rows.where(F.array_contains("cells", column)).agg(F.min_by(F.array_position("cells", F.lit(column)), order).alias("_p"), F.min(order).alias("_o"))
    body = rows.join(F.broadcast(head), rows[order] > head["_o"]).select(F.get("cells", F.col("_p").cast("int") - 1).alias("verdict"))
    return body.where((F.length("verdict") > 0) & ~F.col("verdict").rlike("^:?-+:?$")).groupBy("verdict").agg(F.count("*").alias("n"))
