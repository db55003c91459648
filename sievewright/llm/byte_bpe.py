"""Byte-level BPE by monoid tree reduction.

A match of the splitting pattern is encoded by merging, while one has a rank, the neighbours of lowest rank (the leftmost
of equals). An encoded span is an element of a monoid: halves are encoded recursively and
two neighbours join by re-encoding a window around their border. A place where a
character that isn't white space is followed by white space ends a match of the
splitting pattern in any context (no alternative crosses it, and none that ends there looks further than the white
space), so the tokens before and after such a cut can't depend on each other. The window grows
to the nearest cut on either side of the border; tokens outside it are provably those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a leaf. Leaves are encoded at once; longer spans are halved.
LEAF = 1024
# White space that every engine agrees on, after what no engine takes for white space.
_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r\f\v])")
_codecs: dict[tuple[int, str], Codec] = {}
#: Matches whose ids are remembered, and the longest of them in characters.
MEMORY, SHORT = 200_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: neighbours are merged by lowest rank, the leftmost first, until no pair has one.

    Pairs wait in a heap, so a match of n bytes takes n log n steps, whatever its length.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at i; -1 end: merged away
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if mid < 0 or mid >= n or end[mid] != stop:
            continue  # one of the two has changed since
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        j = before[i]
        if j >= 0:
            r = ranks.get(piece[j:stop])
            if r is not None:
                heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def joining(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of what two tokens join to, by ``left * 2**32 + right``: every way to cut a token into two tokens."""
    get = ranks.get
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left = get(token[:i])
            if left is not None and (right := get(token[i:])) is not None:
                out[left << 32 | right] = rank
    return out


def merge_few(piece: bytes, ranks: dict[bytes, int], single: list[int], joined: dict[int, int]) -> list[int]:
    """What ``merge`` gives, by looking at all pairs each time: quicker for a few bytes. Works on ids, which are the ranks.

    ``single``: the ids of the 256 bytes; ``joined``: ``joining(ranks)``.
    """
    if piece in ranks:
        return [ranks[piece]]
    ids = [single[x] for x in piece]
    none = 1 << 62
    get = joined.get
    pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        ids[i] = low
        del ids[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(low << 32 | ids[i + 1], none)
        if i:
            pairs[i - 1] = get(ids[i - 1] << 32 | low, none)
    return ids


class Memory(dict):
    """Ids of matches, encoded when first asked for.

    At ``MEMORY`` matches all move to a second place, from where a match comes back if it is met again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.joined = ranks, joining(ranks)
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.older: dict[str, list[int]] = {}

    def __missing__(self, piece: str) -> list[int]:
        if len(piece) > SHORT:
            return merge(piece.encode(), self.ranks)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        got = self.older.get(piece) or merge_few(piece.encode(), self.ranks, self.single, self.joined)
        self[piece] = got
        return got


class Codec:
    def __init__(self, data: bytes, pattern: str, leaf: int = LEAF):
        self.ranks = read_ranks(data)
        self.leaf = leaf
        # white space by Unicode's property, as the tokenizer's own engine has it
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memory = Memory(self.ranks)
        self.token = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, i in self.ranks.items():
            self.token[i] = t
        self.name = [str(i) for i in range(len(self.token))]

    def ids(self, text: str) -> list[int]:
        """Ids of a text that is encoded at once."""
        return list(chain.from_iterable(map(self.memory.__getitem__, self.split(text))))

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        """Ids of ``text[lo:hi]``."""
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.ids(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of ``text[lo:hi]`` from those of its two sides."""
        a, b, step = mid, mid, 64
        while a > lo:  # the last cut at or before mid, sought in growing windows
            start = max(lo, mid - step)
            # one character before the window is seen, so that a cut at its start counts; one after mid, too
            found = [m.start() for m in _CUT.finditer(text, max(lo, start - 1), min(hi, mid + 1)) if lo < m.start() <= mid]
            a = found[-1] if found else start if start == lo else a
            if found or start == lo:
                break
            step *= 4
        step = 64
        while b < hi:
            end = min(hi, mid + step)
            found = _CUT.search(text, max(lo, mid - 1), min(hi, end + 1))
            while found and found.start() < mid:
                found = _CUT.search(text, found.start() + 1, min(hi, end + 1))
            if found:
                b = found.start()
                break
            if end == hi:
                b = hi
                break
            step *= 4
        if a == mid == b:
            return left + right
        n, size = len(left), len(text[a:mid].encode())
        while size > 0:
            n -= 1
            size -= len(self.token[left[n]])
        k, size_r = 0, len(text[mid:b].encode())
        while size_r > 0:
            size_r -= len(self.token[right[k]])
            k += 1
        if size or size_r:
            raise AssertionError("a cut is not a token border")
        del left[n:]
        left += self.ids(text[a:b])
        left += right[k:]
        return left

    def decode(self, ids: list[int], lo: int = 0, hi: int | None = None) -> bytes:
        """Bytes of ``ids[lo:hi]``, concatenated up the tree."""
        hi = len(ids) if hi is None else hi
        if hi - lo <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids[lo:hi]))
        mid = (lo + hi) // 2
        return self.decode(ids, lo, mid) + self.decode(ids, mid, hi)


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def _small(batch: pa.RecordBatch, most: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def encode_documents(
    docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = True
) -> DataFrame:
    """Ids of each whole text, and what they decode to.

    Returns the ``keep`` columns (default: doc_id) and ``n_tokens, ids_sha256, decoded_sha256``,
    with ``ids`` also ``token_ids``. Null counts as empty and has no tokens. Rows
    stand alone, so repeated rows and empty tables need no care; other columns aren't read. ``ranks`` is the content
    of the vocabulary file (its size is fixed by the vocabulary), sent to the executors.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ranks)
    source = docs.select(*keep, docs[text].alias("_text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text_")
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, pattern)
        for batch in (x for b in batches for x in _small(b)):
            n, names, back, all_ids = [], [], [], []
            for t in batch.column(batch.num_columns - 1):
                got = codec.encode(t.as_py() or "")
                n.append(len(got))
                names.append(hashlib.sha256(" ".join(map(codec.name.__getitem__, got)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(got)).hexdigest())
                if ids:
                    all_ids.append(pa.array(got, pa.int32()))
            out = [batch.column(i) for i in range(batch.num_columns - 1)]
            out += [pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(back, pa.string())]
            if ids:
                offsets = pa.array([0, *accumulate(map(len, all_ids))], pa.int32())
                values = pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())
                out.append(pa.ListArray.from_arrays(offsets, values))
            labels = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]
            yield pa.RecordBatch.from_arrays(out, names=labels)

    return source.mapInArrow(run, schema)
