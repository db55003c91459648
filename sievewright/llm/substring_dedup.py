"""Substring dedup by hashing of lines and their sentences.

A unit is a line or, within a line, what runs up to the end of a sentence. Where a unit ends depends on the word just before only, so a passage that stands
in the middle of another document's line falls into the same units there, but for its first and last. Units are normalised and digested,
digests are grouped globally with partial sums first, and the occurrence of the smallest rank (document, then place) stays. All later ones
are removed, whatever their length. What is removed is told by its offsets in the original text. A document is said to repeat a passage if neighbouring removed
units hold half of ``PASSAGE`` words: the first and last sentence of a passage may be cut off by what it stands in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import row_identity, spread_join

#: Words of a passage that is reported as repeated.
PASSAGE = 50
_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_BETWEEN = {
    # white space that ends a line or follows the end of a sentence
    "line": re.compile(r"(?<=[.!?])[ \t\r\f\v]+(?![ \t\n\r\f\v])|[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*"),
    "paragraph": re.compile(r"[ \t\r\f\v]*\n[ \t\r\f\v]*\n[ \t\n\r\f\v]*"),
}
_RANK = "doc bigint, h1 bigint, h2 bigint"


def units(text: str, unit: str = "line") -> list[tuple[int, list[str]]]:
    """Where each unit starts, and its words in lower case. Units tile the text; one without words has none."""
    out: list[tuple[int, list[str]]] = []
    at = 0
    for m in [*_BETWEEN[unit].finditer(text), None]:
        words = _WORD.findall(text[at : m.start() if m else len(text)].lower())
        if words:
            out.append((at, words))
        at = m.end() if m else at
    return [(0, out[0][1]), *out[1:]] if out else out


def digest(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def runs(found: list[tuple[int, list[str]]], late: set[int]) -> list[tuple[int, int, int]]:
    """Runs of units that are all ``late``: first, last + 1, words."""
    out, at, held = [], None, 0
    for i, (_, words) in enumerate([*found, (0, [])]):
        if i in late:
            if at is None:
                at, held = i, 0
            held += len(words)
        elif at is not None:
            out.append((at, i, held))
            at = None
    return out


def _small(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def unit_table(docs: DataFrame, text: str, doc_id: str, unit: str) -> DataFrame:
    """``doc, h1, h2, place, digest`` of every unit."""
    source = docs.select(*row_identity(doc_id, text), F.col(text).alias("_text_")).where(F.col("_text_").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sizes, digests = [], []
            for t in batch.column(3):
                found = units(t.as_py(), unit)
                sizes.append(len(found))
                digests += [digest(w) for _, w in found]
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(row) for i in range(3)], pa.array(place), pa.array(digests, pa.binary())],
                names=["doc", "h1", "h2", "place", "digest"],
            )

    return source.mapInArrow(run, f"{_RANK}, place int, digest binary")


def substring_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "line", passage: int = PASSAGE
) -> DataFrame:
    """Remove repeated units from all texts.

    Returns one row per row: ``doc_id, n_units, n_removed`` (units), ``repeats`` (whether a passage of ``passage`` words did), ``removed`` (array of start and end
    offsets, in characters of the original text, white space up to the next unit included), ``text`` (what stays: the original without these spans).
    A repeated unit's earliest occurrence by doc_id and place stays, also within one document. Words are what white space (blank, tab, line and page
    breaks) parts, in lower case. A null text stays null and an empty one empty, with no units. Rows that share a doc_id but not the text are
    different documents (ranked by a hash of the text), rows without one rank last and each counts; rows that repeat both id and text count as one
    and lose the same. Other columns aren't read; an empty table gives an empty result.
    """
    rows = unit_table(docs, text, doc_id, unit)
    rank = F.struct("doc", "h1", "h2", "place")
    first = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = spread_join(rows, first, "digest", "n").where(F.col("first").isNotNull() & (rank > F.col("first")))
    drops = late.groupBy("doc", "h1", "h2").agg(F.collect_set("place").alias("late"))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text_"), *row_identity(doc_id, text))
    both = base.join(drops, ["doc", "h1", "h2"], "left").select("doc_id", "_text_", "late")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            n, gone, long, offsets, lows, highs, texts = [], [], [], [0], [], [], []
            for t, late_ in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = t.as_py()
                found = units(t, unit) if t is not None else []
                spans = runs(found, set(late_)) if late_ else []
                n.append(len(found))
                gone.append(sum(b - a for a, b, _ in spans))
                long.append(any(2 * w >= passage for *_, w in spans))
                parts, at = [], 0
                for a, b, _ in spans:
                    lo, hi = found[a][0], found[b][0] if b < len(found) else len(t)
                    lows.append(lo)
                    highs.append(hi)
                    parts.append(t[at:lo])
                    at = hi
                offsets.append(len(lows))
                texts.append("".join([*parts, t[at:]]) if spans else t)
            span = pa.StructArray.from_arrays([pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int32()),
                    pa.array(gone, pa.int32()),
                    pa.array(long, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), span),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_units", "n_removed", "repeats", "removed", "text"],
            )

    return both.mapInArrow(
        cut_out,
        "doc_id bigint, n_units int, n_removed int, repeats boolean, removed array<struct<start:int,end:int>>, text string",
    )
