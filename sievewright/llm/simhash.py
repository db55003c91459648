"""SimHash near-dedup by segment-popcount embedding.

A fingerprint of 64 bits becomes the vector of its bit counts in 32 segments of 2 bits. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints, so all links lie within Manhattan distance BOUND. The 32 axes form 8 blocks of four, and
a block in which two vectors differ spends at least 1 of that range: two vectors in range agree in at least 4 blocks. The grid
therefore has one cell for each choice of 4 blocks and each vector of counts in them, every vector is put in its cell of each
choice, and all vectors in range meet in a cell. There the Manhattan distance is taken first, as a lower bound, and pairs within it are verified by
Hamming distance. It is computed on counts in unary (0: 00, 1: 01, 2: 11), where it is a bit count, too.

No pairs come out of a cell, only a spanning forest of its links, so a cell with n fingerprints gives at most n - 1 links. A large
cell is split once more: in range, one of five groups of the axes that the cell leaves free must agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import connected_components, cut, exactly, rank_columns, spread_join, width

BOUND = 4
SHINGLE = 4
BLOCKS = 8
#: Blocks that must agree: at most BOUND blocks differ.
AGREE = BLOCKS - BOUND
_SEED = 42
_CHUNK = 1 << 15
#: Groups of up to so many fingerprints are compared by shifted arrays, larger ones one by one.
_SMALL = 8
#: Cells of more fingerprints are split once more.
_LARGE = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    counts, n = np.zeros(64, dtype=np.int64), 0
    hashes: list[int] = [xxhash.xxh64_intdigest(p, _SEED) for p in parts]
    for at in range(0, len(hashes), _CHUNK):
        h = np.array(hashes[at : at + _CHUNK], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranked: bool = False) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row; with ``ranked``, ``doc, tie`` instead of the id."""
    ident = rank_columns(docs, doc_id) if ranked else [F.col(doc_id).cast("long").alias("doc_id")]
    source = docs.select(*ident, F.col(text).alias("_text_"))
    names = [c for c in source.columns if c != "_text_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(len(names))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], names=[*names, "fp"])

    return source.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "fp"]))


def counts(fp: np.ndarray) -> np.ndarray:
    """The bit count of each segment, in its two bits."""
    u, odd = fp.view(np.uint64), np.uint64(0x5555555555555555)
    return (u & odd) + ((u >> np.uint64(1)) & odd)


def unary(fp: np.ndarray) -> np.ndarray:
    """The bit counts in unary, so that the bits in which two of them differ count their Manhattan distance."""
    u, odd = fp.view(np.uint64), np.uint64(0x5555555555555555)
    low, high = u & odd, (u >> np.uint64(1)) & odd
    return (low | high) | ((low & high) << np.uint64(1))


def cells(fp: np.ndarray) -> np.ndarray:
    """Grid cells of each fingerprint: an array of (choices, fingerprints)."""
    pop = counts(fp)
    codes = []
    for b in range(BLOCKS):
        code = np.zeros(len(pop), dtype=np.int64)
        for s in range(4):
            at = np.uint64(2 * (4 * b + s))
            code = code * 3 + ((pop >> at) & np.uint64(3)).astype(np.int64)
        codes.append(code)
    out = []
    for n, choice in enumerate(combinations(range(BLOCKS), AGREE)):
        cell = np.full(len(pop), n, dtype=np.int64)
        for b in choice:
            cell = cell * 81 + codes[b]
        out.append(cell)
    return np.array(out)


def near(fp: np.ndarray, bar: np.ndarray, f: np.uint64, b: np.uint64, bound: int) -> np.ndarray:
    """Which of ``fp`` (``bar`` in unary) are within ``bound`` bits of ``f``: the Manhattan distance first, then those in range exactly."""
    ok = np.bitwise_count(bar ^ b) <= bound
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(fp[at] ^ f) <= bound
    return ok


def forest(fp: np.ndarray, rep: np.ndarray, bound: int = BOUND) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints within ``bound``; compares each met one with those not met yet."""
    fp = fp.view(np.uint64)
    left_fp, left_bar, left_rep = fp, unary(fp), rep
    out = []
    while len(left_fp):
        queue = [(left_fp[0], left_bar[0], left_rep[0])]
        left_fp, left_bar, left_rep = left_fp[1:], left_bar[1:], left_rep[1:]
        while queue and len(left_fp):
            f, b, r = queue.pop()
            ok = near(left_fp, left_bar, f, b, bound)
            if ok.any():
                queue += list(zip(left_fp[ok], left_bar[ok], left_rep[ok], strict=True))
                out += [(int(r), int(x)) for x in left_rep[ok]]
                left_fp, left_bar, left_rep = left_fp[~ok], left_bar[~ok], left_rep[~ok]
    return out


def _split(fp: np.ndarray, rep: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Links that join a large cell's components: vectors in range agree in one of ``bound + 1`` groups of the axes in which the cell's vectors differ."""
    if len(fp) <= _LARGE:
        return forest(fp, rep, bound)
    bar = unary(fp)
    free = [s for s in range(32) if len(np.unique((bar >> np.uint64(2 * s)) & np.uint64(3))) > 1]
    out = []
    for g in range(bound + 1):
        mask = np.uint64(sum(3 << 2 * s for s in free[g :: bound + 1]))
        order = np.argsort(bar & mask, kind="stable")
        key = (bar & mask)[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo > 1:
                out += forest(fp[order[lo:hi]], rep[order[lo:hi]], bound)
    return out


def _links(cell: np.ndarray, fp: np.ndarray, rep: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole cells, which are sorted."""
    fp = fp.view(np.uint64)  # bit counts of negative numbers are those of their absolute values
    edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    size = np.diff(edge)
    of = np.repeat(size, size)
    few = (of > 1) & (of <= _SMALL)
    c, f, r = cell[few], fp[few], rep[few]
    b = unary(f)
    us, vs = [], []
    for d in range(1, _SMALL):
        if len(c) <= d:
            break
        ok = (c[d:] == c[:-d]) & (np.bitwise_count(b[d:] ^ b[:-d]) <= bound)
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(f[at + d] ^ f[at]) <= bound]
        us.append(r[at])
        vs.append(r[at + d])
    for i in np.flatnonzero(size > _SMALL):
        got = _split(fp[edge[i] : edge[i + 1]], rep[edge[i] : edge[i + 1]], bound)
        if got:
            a = np.array(got, dtype=np.int64)
            us.append(a[:, 0])
            vs.append(a[:, 1])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def links(distinct: DataFrame, bound: int = BOUND) -> DataFrame:
    """Links ``u, v`` that join exactly the components of ``distinct(rep, fp)`` within ``bound`` bits."""
    if not 0 <= bound <= BOUND:
        raise ValueError(f"the grid serves 0 to {BOUND} bits")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rep, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                got = cells(fp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.ravel()), pa.array(np.tile(fp, len(got))), pa.array(np.tile(rep, len(got)))],
                    names=["cell", "fp", "rep"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def out(parts):
            u, v = _links(*parts, bound)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            got = [batch.column(i).to_numpy() for i in range(3)]
            cell, fp, rep = (np.concatenate(x) for x in zip(held, got, strict=True))
            if not len(cell):
                continue
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if whole:
                yield out((cell[:whole], fp[:whole], rep[:whole]))
            held = [cell[whole:], fp[whole:], rep[whole:]]
        if len(held[0]):
            yield out(held)

    return (
        distinct.select("rep", "fp")
        .mapInArrow(place, "cell bigint, fp bigint, rep bigint")
        .repartition(width(distinct.sparkSession), "cell")
        .sortWithinPartitions("cell")
        .mapInArrow(meet, "u bigint, v bigint")
    )


def _components(fps: DataFrame, rank: str, bound: int) -> DataFrame:
    """``fp, first, n``: the smallest ``rank`` among all rows of a fingerprint's component, and the rows of the fingerprint."""
    distinct = cut(fps.groupBy("fp").agg(F.min(rank).alias("low"), F.count("*").alias("n")))
    comps = connected_components(links(distinct.select(F.col("fp").alias("rep"), "fp"), bound))
    rooted = cut(distinct.join(comps, distinct["fp"] == comps["id"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "low", "n"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("size"))
    return spread_join(rooted, lowest, "root", "size").select("fp", "first", "n")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bound: int = BOUND) -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``bound`` bits.

    Returns one row per row: ``doc_id, fingerprint`` (16 lowercase hex digits), ``component_id`` (smallest doc_id
    reachable) and ``kept`` (doc_id is that id). Null and empty texts, and those of white space, have fingerprint zero and link
    like any other. Equal fingerprints meet once, however many rows have them. A row without doc_id links its component
    but names none; if no row of the component has an id, component_id is null.
    An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, text, doc_id))
    named = _components(fps, "doc_id", bound).select(F.col("fp"), F.col("first").alias("component_id"), "n")
    return spread_join(fps, named, "fp", "n").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: exactly one of each component.

    It is that of the smallest doc_id; rows without one come last, and rows that share an id rank by a hash of all columns.
    Null texts count as empty. An empty table stays empty.
    """
    fps = cut(fingerprints(docs, text, doc_id, ranked=True))
    ranked = fps.select("fp", F.struct("doc", "tie").alias("rank"))
    return exactly(docs, doc_id, _components(ranked, "rank", BOUND).select("first.*").distinct())
