"""Ranked lexical search over a bit-sliced impact index.

Documents are cut into blocks of ``BLOCK`` rows. For each block and term the index holds the places of the term's documents and, for each
binary digit of their integer impacts, a bitmap over those places (a slice). To score a query in a block its terms' slices are
spread to bitmaps over the whole block and added by bitwise carry arithmetic, 64 documents a word: sum and carry of each
digit are two XORs and a majority. The best k are then found by descending from the most significant slice of the sum, keeping those that have the
digit set as long as they are at least k. Blocks are independent, and their best are merged by a partial top-k.

The index depends on the corpus statistics (documents, length, document frequencies), which are counted over all rows first, in a
forward table (per document the counts of asked terms, never the text) that the blocks are made of. Only terms that some query has are
indexed; queries are dealt into batches of at most about ``MAX_PAIRS`` terms, so that what goes to every task is bounded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import cut, quoted

#: Letters, digits and whatever isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a block (places are 16-bit numbers).
BLOCK = 16_384
#: Terms of queries (each counted with its query) that are sent to all tasks at a time.
MAX_PAIRS = 1_000_000
#: Spread terms of a block that are kept for the next query (70 KB each).
KEPT = 1024
TOP = 10
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NO_ID = np.iinfo(np.int64).max
_FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
_INDEX = "block long, term int, places binary, width int, slices binary"
_HITS = "query int, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    return re.findall(TERM, (text or "").translate(_LOWER))


def forward(docs: DataFrame, vocabulary: dict[str, int], doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, terms, counts``: number of all terms of a document, and the asked ones with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, find = shared.value, re.compile(TERM).findall
        for batch in batches:
            sizes, terms, counts = [], [], []
            for t in batch["text"]:
                found = Counter(find((t.as_py() or "").translate(_LOWER)))
                asked = [(number[w], k) for w, k in found.items() if w in number]
                sizes.append(found.total())
                terms.append([w for w, _ in asked])
                counts.append([k for _, k in asked])
            arrays = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "counts"])

    return docs.select(docs[quoted(doc_id)].cast("long").alias("doc_id"), docs[quoted(text)].alias("text")).mapInArrow(count, _FORWARD)


def weight(n_docs: int, df: int) -> int:
    """A term's weight in thousandths."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """What an occurrence count adds to a document's score, in 64-bit integers."""
    m = 25 + 75 * n * n_docs // max(length, 1)
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def sliced(values: np.ndarray) -> np.ndarray:
    """The binary digits of non-negative integers, least first: packed bitmaps over the values, ``width x bytes``."""
    digits = np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    width = int(values.max()).bit_length()
    return np.packbits(np.ascontiguousarray(digits[:, :width].T), axis=1, bitorder="little")


def spread(places: np.ndarray, width: int, slices: bytes) -> np.ndarray:
    """Slices as bitmaps over the block, ``width x words``."""
    compact = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(width, -1), axis=1, count=len(places), bitorder="little")
    wide = np.zeros((width, BLOCK), np.uint8)
    wide[:, places] = compact
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def add(total: list[np.ndarray], more: np.ndarray, shift: int = 0) -> None:
    """Add bit-sliced numbers, shifted left, to ``total`` in place: a ripple of carries from slice to slice."""
    carry = None
    for k in range(len(more)):
        at = k + shift
        while len(total) <= at:
            total.append(np.zeros_like(more[0]))
        a, b = total[at], more[k]
        half = a ^ b
        over = a & b
        if carry is not None:
            over |= half & carry
            half ^= carry
        total[at], carry = half, over
    at = len(more) + shift
    while carry is not None and carry.any():
        if len(total) <= at:
            total.append(carry)
            break
        total[at], carry = total[at] ^ carry, total[at] & carry
        at += 1


def best(total: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the k largest positive sums, those of lower place first among equals at the edge; all positive ones if they are fewer."""
    if not total:
        return np.zeros(0, int)
    size = lambda bits: int(np.bitwise_count(bits).sum())
    open_ = total[0].copy()
    for s in total[1:]:
        open_ |= s
    sure = np.zeros_like(open_)
    n_sure = 0
    for s in reversed(total):
        with_digit = open_ & s
        n = size(with_digit)
        if n_sure + n >= k:
            open_ = with_digit
        else:
            sure |= with_digit
            n_sure += n
            open_ = open_ & ~s
    places = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    return np.concatenate([places(sure), places(open_)[: k - n_sure]])


def values_at(total: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """The sums at the places."""
    out = np.zeros(len(places), np.int64)
    for k, s in enumerate(total):
        out |= ((s[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
    return out


def build_index(table: DataFrame, weights: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """``block, term, places, width, slices`` of a forward table; the row of term -1 holds the block's ids in order of places.

    ``table`` must be read from files or a checkpoint. Places ascend by id, ids of null last. Documents without an asked term of positive weight have no place.
    """
    shared = table.sparkSession.sparkContext.broadcast(weights)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held, rows = [], 0

        def flush(t: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
            t = t.set_column(0, "doc_id", t["doc_id"].combine_chunks().fill_null(_NO_ID)).sort_by("doc_id").combine_chunks()
            per = np.diff(t["terms"].combine_chunks().offsets.to_numpy())
            term = t["terms"].combine_chunks().flatten().to_numpy()
            tf = t["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
            place = np.repeat(np.arange(len(per)), per)
            value = impacts(shared.value[term], tf, t["n"].to_numpy()[place], n_docs, length)
            order = np.argsort(term, kind="stable")
            order = order[value[order] > 0]
            term, place, value = term[order], place[order], value[order]
            edges = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)]
            out = [(-1, t["doc_id"].to_numpy().astype("<i8").tobytes(), 0, b"")]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    cut_ = sliced(value[lo:hi])
                    out.append((int(term[lo]), place[lo:hi].astype("<u2").tobytes(), len(cut_), cut_.tobytes()))
            block = (task << 32) + number
            for lo in range(0, len(out), 256):
                part = list(zip(*out[lo : lo + 256], strict=True))
                kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(part[0]), pa.int64()), *[pa.array(c, k) for c, k in zip(part, kinds, strict=True)]], names=["block", "term", "places", "width", "slices"]
                )

        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, BLOCK - rows)
                held.append(head)
                rows += head.num_rows
                batch = batch.slice(head.num_rows)
                if rows == BLOCK:
                    yield from flush(pa.Table.from_batches(held), made)
                    held, rows, made = [], 0, made + 1
        if rows:
            yield from flush(pa.Table.from_batches(held), made)

    return table.where("size(terms) > 0").mapInArrow(blocks, _INDEX)


def search(index: DataFrame, queries: list[list[tuple[int, int]]], k: int = TOP) -> DataFrame:
    """``query, doc_id, score``: of each query (its terms with how often it repeats them) the best k of each block."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def block(t: pa.Table) -> pa.Table:
        rows = dict(zip(t["term"].to_pylist(), range(t.num_rows), strict=True))
        ids = np.frombuffer(t["places"][rows[-1]].as_py(), "<i8")
        near: dict[int, np.ndarray] = {}

        def bitmaps(term: int) -> np.ndarray:
            if term not in near:
                if len(near) >= KEPT:
                    near.pop(next(iter(near)))
                at = rows[term]
                near[term] = spread(np.frombuffer(t["places"][at].as_py(), "<u2"), t["width"][at].as_py(), t["slices"][at].as_py())
            return near[term]

        found: list[tuple[np.ndarray, ...]] = []
        for q, asked in enumerate(shared.value):
            total: list[np.ndarray] = []
            for term, repeats in asked:
                if term in rows:
                    for digit in range(repeats.bit_length()):
                        if repeats >> digit & 1:
                            add(total, bitmaps(term), digit)
            places = best(total, k)
            found.append((np.full(len(places), q), ids[places], values_at(total, places)))
        who, doc, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        return pa.table([pa.array(who, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return index.groupBy("block").applyInArrow(block, _HITS)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """The k best documents of every item: ``item_id, rank, doc_id, score`` (score above 0, all if fewer; equal scores by ascending doc_id, null last).

    Every row of ``docs`` is a document of its own, repeated ids and texts too; null and empty texts have no term and are found by nothing. Items
    without a term find nothing, and those that repeat an id are answered each. Whole texts count, of any length: a text is read into terms in one task. Other columns are ignored.
    Empty tables give an empty result.
    """
    asked = items.select(items[quoted(item_id)].alias("item_id"), items[quoted(text)].alias("text")).where("text IS NOT NULL")
    # a bound: a term and what parts it from the next are two characters at least
    pairs = asked.agg(F.sum(F.expr("char_length(text) div 2 + 1"))).first()[0] or 0
    batches = max(1, -(-pairs // max_pairs))
    kind = items.schema[item_id].dataType
    out = None
    for b in range(batches):
        mine = asked if batches == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b)
        vocabulary: dict[str, int] = {}
        names, queries = [], []
        for row in mine.toLocalIterator():
            repeated = Counter(terms_of(row["text"]))
            if repeated:
                names.append((len(names), row["item_id"]))
                queries.append([(vocabulary.setdefault(w, len(vocabulary)), n) for w, n in repeated.items()])
        table = cut(forward(docs, vocabulary, doc_id, text))
        sums = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
        # one row for each term that a query has
        holding = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()
        weights = np.zeros(max(1, len(vocabulary)), np.int64)
        for r in holding:
            weights[r["term"]] = weight(sums["docs"], r["df"])
        index = build_index(table, weights, sums["docs"], sums["length"] or 0)
        hits = search(index, queries, k)
        asked_as = docs.sparkSession.createDataFrame(names, f"query int, item_id {kind.simpleString()}")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
        top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(asked_as), "query")
        # documents without an id carry the largest number inside
        known = F.when(F.col("doc_id") < _NO_ID, F.col("doc_id"))
        top = top.select("item_id", "rank", known.alias("doc_id"), "score")
        out = top if out is None else out.union(top)
    return out
