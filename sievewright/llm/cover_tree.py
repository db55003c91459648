"""Embedding near-dedup by dual traversal of a cover tree.

Unit vectors with cosine >= t are those within distance sqrt(2 - 2t), the reach. Nested levels of
centres with halving radii (a level's centres are further apart than its radius and include those of the level above) are
fitted on a bounded sample; every vector descends to a lowest centre. Nodes are packed into blocks in the order of the tree, so that near nodes
share a block, and each block goes on below them: leaves of at most half the reach, each with a vector as its centre, so near copies share a leaf.

The covering radius of a node is the largest distance of *any* vector below it, so the bound holds for all rows whatever the sample: two nodes
whose centres are further apart than both radii and the reach have no links. The dual traversal goes
from the pair (root, root) to pairs of children and drops such pairs: on the driver between the nodes of the sample, whose open pairs say which
pairs of blocks (tiles) must meet, then in each tile between leaves. Vectors of open pairs of leaves are compared exactly in double precision.

Blocks are rows of a table that meets itself in a product of its partitions, which reads them where they are kept: pairs of blocks take time, but no disk. Vectors are
written three times, as they are given: placed below the tree, dealt to blocks, and as blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import connected_components, cut, spread_join

THRESHOLD = 0.95
#: Vectors that the centres are chosen from, and most lowest centres.
SAMPLE = 4096
MAX_NODES = 2048
#: Most vectors of a block; a tile compares two blocks.
BLOCK = 4096
#: Partitions of the table of blocks (up to ``PARTS``), and blocks of a partition beyond; each pair of partitions is a task.
PARTS, EACH = 24, 16
#: Slack for rounding in bounds.
_EPS = 1e-9


class Tree:
    """Nested nets: ``centres`` in order of their level, ``counts[l]`` of them on level l (radius 2 / 2**l)."""

    def __init__(self, sample: np.ndarray, max_nodes: int = MAX_NODES, least: float = 0.05):
        chosen: list[int] = [0] if len(sample) else []
        self.counts, self.parent = [len(chosen)], [0] * len(chosen)
        near = np.linalg.norm(sample - sample[0], axis=1) if len(sample) else np.zeros(0)
        of = np.zeros(len(sample), dtype=np.int64)  # nearest chosen centre so far
        radius = 1.0
        while len(chosen) and radius >= least and len(chosen) < max_nodes:
            grew = False
            above = of.copy()
            while len(chosen) < max_nodes:
                far = int(np.argmax(near))
                if near[far] <= radius:
                    break
                self.parent.append(int(above[far]))
                d = np.linalg.norm(sample - sample[far], axis=1)
                better = d < near
                of[better], near = len(chosen), np.minimum(near, d)
                chosen.append(far)
                grew = True
            self.counts.append(len(chosen))
            radius /= 2
            if not grew and not len(near[near > least]):
                break
        self.centres = sample[chosen] if chosen else sample[:0]

    def levels(self) -> list[np.ndarray]:
        """For each level the parent (on the level above) of each of its nodes."""
        out = [np.zeros(self.counts[0], dtype=np.int64)]
        for lo, hi in zip(self.counts[:-1], self.counts[1:], strict=True):
            out.append(np.array([i if i < lo else self._up(i, lo) for i in range(hi)], dtype=np.int64))
        return out

    def _up(self, i: int, lo: int) -> int:
        while i >= lo:
            i = self.parent[i]
        return i

    def lowest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest node of each vector, by descent to the nearest child, and its distance from it."""
        found = np.zeros(len(x), dtype=np.int64)
        levels = self.levels()[1:]
        for lo in range(0, len(x), 512):
            part, at = x[lo : lo + 512], found[lo : lo + 512]
            for up in levels:
                d = _distance(part, self.centres[: len(up)])
                d[up[None, :] != at[:, None]] = np.inf
                at[:] = d.argmin(axis=1)
        return found, np.linalg.norm(x - self.centres[found], axis=1)

    def order(self) -> np.ndarray:
        """The lowest nodes in the order of the tree, children beside each other."""
        path = [np.arange(self.counts[-1])]
        for up in reversed(self.levels()[1:]):
            path.append(up[path[-1]])
        return np.lexsort(path)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def dual_traversal(tree: Tree, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which pairs of lowest nodes may hold links: a symmetric boolean matrix.

    ``radius[i]``: covering radius of lowest node i (-1: empty).
    """
    levels = tree.levels()
    # covering radius of inner nodes: over the lowest nodes below them
    below = [np.arange(len(levels[-1]))]
    for up in reversed(levels[1:]):
        below.insert(0, up[below[0]])
    cover = []
    for n, _ in enumerate(levels):
        r = np.full(len(levels[n]), -1.0)
        d = np.linalg.norm(tree.centres - tree.centres[below[n]], axis=1) + radius
        ok = radius >= 0
        np.maximum.at(r, below[n][ok], d[ok])
        cover.append(r)
    cover[-1] = radius
    open_ = np.ones((1, 1), dtype=bool)
    for n, up in enumerate(levels):
        if n:
            open_ = open_[np.ix_(up, up)]
        for lo in range(0, len(up), 256):  # pairs of nodes by rows, as far as their parents are open
            apart = _distance(tree.centres[lo : min(lo + 256, len(up))], tree.centres[: len(up)])
            far = apart > cover[n][lo : lo + 256, None] + cover[n][None, :] + reach + _EPS
            open_[lo : lo + 256] &= ~far & (cover[n][lo : lo + 256, None] >= 0) & (cover[n] >= 0)
    return open_ | open_.T


def leaves(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The centre (a row) of each row of ``x``, at most ``radius`` away, and its distance; centres are further apart than that."""
    of, far = np.full(len(x), -1), np.zeros(len(x))
    least = 1 - radius * radius / 2
    for lo in range(0, len(x), 512):
        cos = x[lo : lo + 512] @ x.T
        for i in range(lo, min(lo + 512, len(x))):
            if of[i] < 0:
                mine = np.flatnonzero((cos[i - lo] >= least) & (of < 0))
                mine = mine[mine != i]
                of[mine], far[mine], of[i] = i, np.linalg.norm(x[mine] - x[i], axis=1), i
    return of, far


def open_leaves(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, reach: float) -> np.ndarray:
    """Which pairs of leaves (centres and covering radii) may hold links."""
    return _distance(a, b) <= ra[:, None] + rb[None, :] + reach + _EPS


def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin and end."""
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True]))) if len(k) else np.zeros(1, np.int64)
    return edge[:-1], edge[1:]


def _spanning(adj: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a boolean adjacency matrix."""
    out = []
    left = np.flatnonzero(adj.any(1))
    unmet = np.zeros(len(adj), dtype=bool)
    unmet[left] = True
    for s in left:
        if not unmet[s]:
            continue
        unmet[s] = False
        queue = [s]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(adj[i] & unmet)
            unmet[new] = False
            out += [(i, j) for j in new]
            queue += new.tolist()
    return out


class Block:
    """A block's vectors in order of their leaves: ids, weights, leaves, distances from their centres, and unit vectors."""

    def __init__(self, row: dict, kind: str):
        self.rep, self.n = np.frombuffer(row["rep"], "<i8"), np.frombuffer(row["n"], "<i8")
        self.leaf, self.off = np.frombuffer(row["leaf"], "<i4"), np.frombuffer(row["off"], "<f8")
        self.x = _unit(np.frombuffer(row["vec"], kind).reshape(len(self.rep), -1))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its stop, one after another."""
    size = stop - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _tile(one: Block, other: Block | None, threshold: float) -> tuple[list, list]:
    """Link counts ``(rep, n)`` and links ``(u, v)`` of a tile: a block against another one, or with itself."""
    alone = other is None
    both = [one] if alone else [one, other]
    x, rep, weight, leaf, off = (np.concatenate([getattr(b, name) for b in both]) for name in ("x", "rep", "n", "leaf", "off"))
    side = np.repeat(np.arange(len(both)), [len(b.rep) for b in both])
    # leaves are runs of rows; the first row of each is its centre
    edge = np.flatnonzero(np.concatenate(([True], (side[1:] != side[:-1]) | (leaf[1:] != leaf[:-1]), [True])))
    start, stop = edge[:-1], edge[1:]
    radius = np.maximum.reduceat(off, start)
    mine = np.flatnonzero(side[start] == 0)
    theirs = mine if alone else np.flatnonzero(side[start] == 1)
    reach = math.sqrt(2 - 2 * threshold)
    centres, widest = x[start[theirs]], radius[theirs].max()
    us, vs = [], []
    for lo in range(0, len(mine), 512):
        some = mine[lo : lo + 512]
        cos = x[start[some]] @ centres.T
        # by the widest leaves first, then each pair of leaves that may be open by its own
        bound = radius[some].max() + widest + reach + _EPS
        k, at = np.nonzero(cos >= 1 - bound * bound / 2 - 1e-12)
        open_ = np.sqrt(np.maximum(0, 2 - 2 * cos[k, at])) <= radius[some[k]] + radius[theirs[at]] + reach + _EPS
        if alone:
            open_ &= theirs[at] >= some[k]  # each pair of leaves once
        k, at = some[k[open_]], theirs[at[open_]]
        for first, last in zip(*_runs(k), strict=True):
            leaves_ = at[first:last]
            cols = _ranges(start[leaves_], stop[leaves_])
            own = k[first]
            for row in range(start[own], stop[own], 512):
                rows = np.arange(row, min(row + 512, stop[own]))
                cos_ = x[rows] @ x[cols].T
                hit = cos_ >= threshold
                near = np.abs(cos_ - threshold) < 1e-12
                if near.any():  # as exact as double precision can tell
                    for i, j in zip(*np.nonzero(near), strict=True):
                        hit[i, j] = math.fsum(x[rows[i]] * x[cols[j]]) >= threshold
                if alone:
                    hit &= rows[:, None] < cols[None, :]
                i, j = np.nonzero(hit)
                us.append(rows[i])
                vs.append(cols[j])
    if not us:
        return [], []
    u, v = np.concatenate(us), np.concatenate(vs)
    n = np.bincount(u, weights=weight[v], minlength=len(x)) + np.bincount(v, weights=weight[u], minlength=len(x))
    counts = [(int(rep[k]), int(n[k])) for k in np.flatnonzero(n)]
    met = np.unique(np.concatenate([u, v]))
    place = np.searchsorted(met, u), np.searchsorted(met, v)
    adj = np.zeros((len(met), len(met)), dtype=bool)
    adj[place[0], place[1]] = adj[place[1], place[0]] = True
    return counts, [(int(rep[met[a]]), int(rep[met[b]])) for a, b in _spanning(adj)]


def _valid(vec: str) -> F.Column:
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(batch: pa.Array) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dimension(source: DataFrame, groups: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Counts ``rep, n`` and links ``u, v`` among the vectors of one dimension: ``source(key, vec_id, vec)``, ``groups(key, rep, n)`` for each distinct vector.

    ``kind``: numpy's name of the numbers as they are given.
    """
    spark = source.sparkSession
    chosen = groups.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select(F.col("key").alias("_k"), "rep", F.xxhash64("rep").alias("_h"))
    drawn = source.join(F.broadcast(chosen), (F.col("key") == F.col("_k")) & (F.col("vec_id") == F.col("rep"))).select("_h", "rep", "vec").collect()
    sample = {(r["_h"], r["rep"]): r["vec"] for r in drawn}
    total = groups.count()
    x = _unit(np.array([sample[k] for k in sorted(sample)]))
    tree = spark.sparkContext.broadcast(Tree(x, max_nodes=max(1, min(MAX_NODES, total // 32))))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lowest node of each vector; of equal ones in a task the first is enough."""
        seen: set[bytes] = set()
        for batch in batches:
            new = [i for i, k in enumerate(batch.column(0).to_pylist()) if k not in seen and not seen.add(k)]
            if not new:
                continue
            batch = batch.take(pa.array(new))
            raw = _matrix(batch.column(1))
            at, far = tree.value.lowest(_unit(raw))
            flat = np.ascontiguousarray(raw.astype(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at.astype(np.int32)), pa.array(far), pa.array([v.tobytes() for v in flat], pa.binary())],
                names=["key", "node", "far", "vec"],
            )

    placed = cut(source.select("key", "vec").mapInArrow(descend, "key binary, node int, far double, vec binary"))
    placed = placed.withColumn("at", F.monotonically_increasing_id())
    # equal vectors of several tasks: one of them stands for all
    first = placed.groupBy("key").agg(F.min(F.struct("at", "node", "far")).alias("_p"))
    stand = cut(first.join(groups, "key").select("key", "_p.*", "rep", "n"))
    nodes = {r["node"]: r for r in stand.groupBy("node").agg(F.max("far").alias("r"), F.count("*").alias("k")).collect()}
    radius = np.full(len(tree.value.centres), -1.0)
    for k, r in nodes.items():
        radius[k] = r["r"]
    reach = math.sqrt(2 - 2 * threshold)
    may = dual_traversal(tree.value, radius, reach)
    # Nodes are packed into blocks in the order of the tree; a large one takes several. A block holds about `block` vectors.
    block = max(256, min(BLOCK, -(-total // 16)))
    # What the driver keeps is bounded by the nodes: groups of nodes, and how many blocks each group has.
    group, chunks, fill = {}, [], 0
    for k in (int(k) for k in tree.value.order() if k in nodes):
        size = nodes[k]["k"]
        if size > block or not chunks or fill + size > block:
            chunks.append(max(1, -(-size // block)))
            fill = size if size <= block else block  # nothing joins a group of several blocks
        else:
            fill += size
        group[k] = len(chunks) - 1
    member = np.zeros((len(chunks), len(radius)), dtype=np.int32)
    for k, g in group.items():
        member[g, k] = 1
    open_groups = (member @ may.astype(np.int32) @ member.T) > 0
    first_of = np.concatenate([[0], np.cumsum(chunks)])
    group_of = np.zeros(len(radius), dtype=np.int64)
    group_of[list(group)] = list(group.values())
    plan = spark.sparkContext.broadcast((group_of, np.array(chunks), first_of, open_groups))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block of each vector, from its ``node`` and a hash of its key (the first two columns)."""
        group_of, chunks, first_of, _ = plan.value
        for batch in batches:
            g = group_of[batch.column(0).to_numpy()]
            mixed = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(1)
            mine = first_of[g] + (mixed % chunks[g].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), *batch.columns[2:]], names=["block", *batch.schema.names[2:]])

    def grow(vectors: pa.Table, stand: pa.Table) -> pa.Table:
        """The leaves of a block, as one row."""
        _, _, first_of, open_ = plan.value
        if not stand.num_rows:  # all that came are equal to others elsewhere
            return pa.table({name: pa.array([], t) for name, t in zip(PACKED.names, PACKED.types, strict=True)})
        stand = stand.sort_by("rep").combine_chunks()
        places = vectors["at"].to_numpy()
        order = np.argsort(places)
        found = order[np.searchsorted(places, stand["at"].to_numpy(), sorter=order)]
        vecs = vectors["vec"].combine_chunks().take(pa.array(found)).to_pylist()
        raw = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1)
        of, off = leaves(_unit(raw), reach / 2)
        rep = stand["rep"].to_numpy()
        order = np.lexsort((rep, off, of))
        number = stand["block"][0].as_py()
        mine = int(np.searchsorted(first_of, number, side="right")) - 1
        pack = lambda v, t: [np.ascontiguousarray(v[order].astype(t)).tobytes()]
        return pa.table(
            [[number], [mine], [np.flatnonzero(open_[mine]).tolist()], pack(rep, "<i8"), pack(stand["n"].to_numpy(), "<i8"), pack(of, "<i4"), pack(off, "<f8"), pack(raw, kind)], schema=PACKED
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                one = Block({k[2:]: v for k, v in row.items() if k[:2] == "a_"}, kind)
                other = None if row["a_block"] == row["b_block"] else Block({k[2:]: v for k, v in row.items() if k[:2] == "b_"}, kind)
                counts, got = _tile(one, other, threshold)
                u = [a for a, _ in counts] + [a for a, _ in got]
                v = [-1] * len(counts) + [b for _, b in got]
                n = [n for _, n in counts] + [0] * len(got)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, n)], names=["u", "v", "n"])

    blocks = int(first_of[-1])
    parts = max(min(blocks, PARTS), -(-blocks // EACH))
    fine = 3 * parts  # put together again by threes, as hashes deal blocks unevenly
    mix = F.xxhash64("key").alias("mix")
    dealt = placed.select("node", mix, "at", "vec").mapInArrow(settle, "block int, at bigint, vec binary").repartition(fine, "block")
    named = stand.select("node", mix, "at", "rep", "n").mapInArrow(settle, "block int, at bigint, rep bigint, n bigint").repartition(fine, "block")
    packed = "block int, grp int, meets array<int>, rep binary, n binary, leaf binary, off binary, vec binary"
    grown = cut(dealt.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(grow, packed)).coalesce(parts)
    left, right = (grown.select(*[F.col(c).alias(f"{side}_{c}") for c in grown.columns]) for side in "ab")
    meet = (F.col("a_block") <= F.col("b_block")) & F.array_contains("a_meets", F.col("b_grp"))
    tiles = left.join(right.hint("shuffle_replicate_nl"), meet).drop("a_grp", "a_meets", "b_grp", "b_meets")
    out = cut(tiles.mapInArrow(compare, "u bigint, v bigint, n bigint"))
    return out.where("n > 0").select(F.col("u").alias("rep"), "n"), out.where("n = 0").select("u", "v")


#: A block as a row: its number, its group of nodes and those that this may have links with, its vectors as bytes.
PACKED = pa.schema(
    [("block", pa.int32()), ("grp", pa.int32()), ("meets", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("rep", "n", "leaf", "off", "vec")]]
)


def embedding_dedup(
    vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD
) -> DataFrame:
    """Link vectors with cosine >= threshold and name their components.

    Returns one row per vector: ``vec_id, n_links`` (other vectors linked directly), ``component_id`` (smallest vec_id
    reachable, itself included), ``kept`` (vec_id is that id). A vector that is null, empty, zero or has a null or
    non-finite component links with nothing; so do vectors of different dimension. Rows that repeat both id and
    vector count as one vector, and each comes out. A row without vec_id links with nothing and is kept. Equal vectors meet once,
    however many rows have them. Other columns aren't read; an empty table gives an empty result.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    own = vectors.schema[vec].dataType
    single = isinstance(own, T.ArrayType) and isinstance(own.elementType, T.FloatType)
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"), F.col(vec).alias("_own"))
    ok = _valid("vec") & F.col("vec_id").isNotNull()
    key = F.when(ok, F.unhex(F.md5(F.to_csv(F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"), F.hash("vec"), F.size("vec"))))))
    source = source.select("vec_id", key.alias("key"), F.size("vec").alias("dim"), F.col("_own" if single else "vec").alias("vec"))
    rows = cut(source.select("vec_id", "key", "dim"))
    groups = cut(
        rows.where("key is not null").select("key", "vec_id", "dim").distinct()
        .groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"))
    )
    dims = [r[0] for r in groups.select("dim").distinct().collect()]
    counts = links = None
    for d in dims:
        mine = groups.where(F.col("dim") == d).drop("dim")
        c, e = _by_dimension(source.where(F.col("key").isNotNull() & (F.col("dim") == d)).drop("dim"), mine, "<f4" if single else "<f8", threshold)
        counts = c if counts is None else counts.union(c)
        links = e if links is None else links.union(e)
    groups, rows = groups.drop("dim"), rows.drop("dim")
    if counts is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    comps = connected_components(links)
    per = (
        groups.join(counts.groupBy("rep").agg(F.sum("n").alias("_links")), "rep", "left")
        .join(comps, F.col("rep") == comps["id"], "left")
        .select("key", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "n")
    )
    joined = spread_join(rows, per, "key", "n")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
