"""Which texts contain which strings, by an equi-join on hashes of windows.

Each string (needle) names windows of its own bytes that any text which contains it must show, too. Their length is the largest power of two that fits from three bytes
before its first separator (a byte of ASCII that is no letter or digit), at least ``LEAST``: texts have such windows at separators only, about one in six places, and the
first and the last window of a long needle cover nearly all of it. Other needles use windows at every place, up to ``PLAIN`` bytes long. Texts hash their windows
(a polynomial that slides over the bytes) and keep those that some needle may ask for, by a bitmap of bounded size that is sent to all tasks; so little more than real
occurrences is sent on. Of a needle's windows the one that the fewest texts have is its anchor; a needle with a window that no text has is settled there. Texts that have
the anchor are candidates, and each is looked up in the text itself. Candidates go to the texts as long as there are at most ``MAX_BROADCAST`` of them, else both meet by exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut

#: Shortest window at a separator, longest one elsewhere, in bytes; needles with windows shorter than ``FEW`` use all of them.
LEAST, PLAIN, FEW = 8, 32, 32
#: Candidates, and characters of their needles, that are sent to all tasks.
MAX_BROADCAST, MAX_SENT = 50_000, 8_000_000
#: Bits of the bitmap for each window, at most (64 MB); bits that a hash sets; bytes of texts that are hashed at once.
BITS, MOST_BITS, SET, SLICE = 16, 1 << 29, 4, 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_OF_BYTE = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Bytes:
    """Some texts as one run of bytes, with what hashes any window of them in constant time."""

    powers = backs = np.ones(1, _U)

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.start, self.end = data, offsets[:-1], offsets[1:]
        n = len(data)
        if len(_Bytes.powers) < n + 1:
            m = max(n + 1, SLICE)
            _Bytes.powers, _Bytes.backs = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(m, x, _U)])) for x in (_BASE, _BACK))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_OF_BYTE[data] * self.powers[:n], dtype=_U)])
        self.at_separator = np.flatnonzero(_SEPARATOR[data])
        self.row = np.searchsorted(self.end, self.at_separator, side="right")

    def places(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """``start, row`` of the windows of a kind: that many bytes at separators, if it is negative at every place."""
        if kind > 0:
            at, row = self.at_separator - 3, self.row
        else:
            at = np.arange(len(self.data))
            row = np.repeat(np.arange(len(self.start)), self.end - self.start)
        fits = (at >= self.start[row]) & (at + abs(kind) <= self.end[row])
        return at[fits], row[fits]

    def hashes(self, at: np.ndarray, kind: int) -> np.ndarray:
        h = (self.sums[at + abs(kind)] - self.sums[at]) * self.backs[at] + _U(kind % (1 << 64))
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))

    def kinds(self) -> np.ndarray:
        """The kind of each row as a needle: a power of two at least ``LEAST``, else less than zero; 0 for an empty one."""
        size = self.end - self.start
        late = self.at_separator >= self.start[self.row] + 3
        first = np.full(len(size), -1)
        row, at = self.row[late][::-1], self.at_separator[late][::-1]
        first[row] = at
        room = np.where(first >= 0, self.end - first + 3, 0)
        power = lambda x: 1 << np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
        plain = np.where(size < LEAST, size, np.minimum(power(size), PLAIN))
        return np.where(room >= LEAST, power(room), -plain)


def _slices(column: pa.Array) -> Iterator[tuple[int, _Bytes]]:
    """The texts of a column (none null) by runs of about ``SLICE`` bytes, with the row that each begins at."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
        yield lo, _Bytes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _needle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n, kind, h``: the windows that each needle may be found by."""
    names = ["n", "kind", "h"]
    for batch in batches:
        for lo, some in _slices(batch.column(1)):
            of = some.kinds()
            for kind in np.unique(of[of != 0]).tolist():
                at, row = some.places(kind)
                mine = of[row] == kind
                at, row = at[mine], row[mine]
                if kind >= FEW:  # the first and the last cover a needle
                    edge = np.flatnonzero(np.diff(row, prepend=-1))
                    pick = np.unique(np.concatenate([edge, np.append(edge[1:], len(row)) - 1]))
                    at, row = at[pick], row[pick]
                h = some.hashes(at, kind).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), pa.array(np.full(len(h), kind, np.int32)), pa.array(h)], names=names)


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of a bitmap that a hash sets."""
    step = (h >> _U(32)) | _U(1)
    return [(h + _U(k) * step) & _U(bits - 1) for k in range(SET)]


def _bitmap(windows: DataFrame, total: int) -> np.ndarray:
    """Whether a hash is among those of ``windows(h)``, by bits; none that is gets lost. Made in pieces of at most 1 MB."""
    bits = 1 << 16
    while bits < min(MOST_BITS, total * BITS):
        bits *= 2
    piece = min(bits, 1 << 23)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(_bits(batch.column(0).to_numpy().view(_U), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((p // piece).astype(np.int32)), pa.array((p % piece).astype(np.int32))], names=["piece", "bit"])

    def one(table: pa.Table) -> pa.Table:
        own = np.zeros(piece, bool)
        own[table["bit"].to_numpy()] = True
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    parts = windows.select("h").mapInArrow(places, "piece int, bit int").groupBy("piece").applyInArrow(one, "piece int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[r["piece"] * piece // 8 : (r["piece"] + 1) * piece // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _asked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The indexes of the hashes that the bitmap may hold."""
    left = np.arange(len(h))
    for k in range(SET):
        p = _bits(h[left], len(bitmap) * 8)[k]
        left = left[(bitmap[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1]
    return left


def _hits(texts: DataFrame, kinds: list[int], bitmap: np.ndarray) -> DataFrame:
    """``id, th, h``: windows of ``texts(id, th, _text)`` that some needle may ask for, once for each text."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, some in _slices(batch.column(2)):
                for kind in kinds:
                    at, row = some.places(kind)
                    if not len(at):
                        continue
                    h = some.hashes(at, kind)
                    left = _asked(sent.value, h)
                    if not len(left):
                        continue
                    row, h = row[left], h[left].view(np.int64)
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
                    rows = pa.array(lo + row[new])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h[new])], names=["id", "th", "h"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(scan, f"id {kind}, th bigint, h bigint")


def find(texts: DataFrame, needles: DataFrame, id_: str, text: str, give: Column | None = None) -> DataFrame:
    """``id_, needle``: each text that contains a needle, once; ``needles(needle)``. With ``give`` that function of ``needle`` instead, each value once for a text.

    Empty and null needles are found nowhere. Rows that share ``id_`` count as one text for the result, but each is searched.
    """
    c = F.col
    give = c("needle") if give is None else give
    sought = needles.select("needle").where("needle <> ''").distinct()
    sought = cut(sought.select(F.unhex(F.md5("needle")).alias("n"), "needle"))
    base = texts.select(c(id_).alias("id"), F.xxhash64(text).alias("th"), c(text).alias("_text")).where("_text IS NOT NULL")
    windows = cut(sought.select("n", c("needle").cast("binary")).mapInArrow(_needle_windows, "n binary, kind int, h bigint").distinct())
    kinds = {r["kind"]: r["k"] for r in windows.groupBy("kind").agg(F.count("*").alias("k")).collect()}
    nothing = base.select(c("id").alias(id_)).join(sought.select(give), F.lit(False))
    if not kinds:
        return nothing
    hits = cut(_hits(base.withColumn("_text", c("_text").cast("binary")), sorted(kinds), _bitmap(windows, sum(kinds.values()))))
    counted = windows.join(hits.groupBy("h").agg(F.count("*").alias("k")), "h", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    marks = counted.groupBy("n").agg(F.min(F.struct("k", "h")).alias("b")).where("b.k > 0").select("n", c("b.h").alias("h"))
    pairs = cut(hits.join(marks, "h").select(c("id").alias("_id"), c("th").alias("_th"), "n"))
    n_pairs = pairs.count()
    if not n_pairs:
        return nothing
    near = n_pairs <= MAX_BROADCAST
    wanted = pairs.join(sought, "n")
    if near and wanted.agg(F.sum(F.length("needle"))).first()[0] > MAX_SENT:
        near = False
    wanted = F.broadcast(wanted) if near else wanted
    met = base.join(wanted, c("id").eqNullSafe(c("_id")) & (c("th") == c("_th"))).where(F.contains("_text", "needle"))
    return met.select(c("id").alias(id_), give).distinct()
