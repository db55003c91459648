"""Duplicate removal against brute force, and the defined edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sievewright.llm import common, cover_tree, exact_dedup, line_dedup, simhash, substring_dedup

#: Clashing names, nulls, an empty and a blank text, ties and a repeated row.
EDGE = [
    (1, "same text here", "a", 5), (2, "same text here", None, 5), (3, None, "a", None), (4, "", "b", 0),
    (5, " \n\t", "b", 3), (6, "x" * 50_000 + " tail", "a", 1), (7, "unique words in this row", "c", 2),
    (7, "unique words in this row", "c", 2), (None, "no id at all", "c", 2),
]
SCHEMA = "doc_id long, text string, keep_id string, n int"


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def docs_of(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    edges_ = [e for e in edges if e[0] != e[1]]
    want = components({x for e in edges_ for x in e}, edges_)
    got = common.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.id: r.component for r in got.collect()} == want
    assert not common.connected_components(spark.createDataFrame([], "u long, v long")).collect()


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {
        i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    }


def test_exact(spark, tiny):
    df, rows = docs_of(spark, tiny)
    hot = [(10_000 + i, "hot text") for i in range(200)]
    df = df.select("doc_id", "text").union(spark.createDataFrame(hot, "doc_id long, text string"))
    got = exact_dedup.exact_dedup(df).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == exact_brute(rows + hot)
    assert len(got) == len(rows) + 200


def test_exact_edges(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame(EDGE, SCHEMA)).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert (by[1][0].kept, by[1][0].keep_id, by[2][0].kept) == (False, 2, True)
    assert by[3][0].keep_id == 4 and by[4][0].group_size == 2
    assert [r.kept for r in by[7]] == [True, True] and by[7][0].group_size == 2
    assert by[None][0].kept
    assert not exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).collect()


def brute_fingerprint(text):
    ws = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ")
          .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, tiny):
    df, rows = docs_of(spark, tiny)
    rng = random.Random(3)
    base = rows[5][1].split(" ")
    for i in range(60):  # a group of near copies with different words
        w = list(base)
        w[rng.randrange(len(w))] = f"w{i}"
        rows.append((50_000 + i, " ".join(w)))
    rows += [(60_000, None), (60_001, " "), (60_002, "é \x1c one")]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = components(fps, linked)
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want) - 20


def test_simhash_links_are_whole():
    """Random fingerprints at distance 0 to 6: the grid and the forest lose no component."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = [int(b) for b in base]
    for b in [*base, *base[:1].repeat(20)]:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            fp.append(x)
    arr = np.unique(np.array(fp, dtype=np.uint64))
    ids = np.arange(len(arr))
    got = simhash.cells(arr.view(np.int64))
    cell, f, r = got.ravel(), np.tile(arr.view(np.int64), len(got)), np.tile(ids, len(got))
    order = np.argsort(cell, kind="stable")
    u, v = simhash._links(cell[order], f[order], r[order], 4)
    want = components(ids.tolist(), [(a, b) for a, b in itertools.combinations(ids.tolist(), 2)
                                     if (int(arr[a]) ^ int(arr[b])).bit_count() <= 4])
    assert components(ids.tolist(), zip(u.tolist(), v.tolist(), strict=True)) == want


def test_manhattan_distance_bounds_hamming_distance():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    b[:250] = a[:250] ^ (np.uint64(1) << rng.integers(0, 63, 250, dtype=np.uint64))
    got = np.bitwise_count(simhash.unary(a) ^ simhash.unary(b))
    for x, y, d in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        by_hand = sum(abs((x >> s & 3).bit_count() - (y >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert d == by_hand <= (x ^ y).bit_count()


def test_a_large_cell_is_split_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "_LARGE", 20)
    test_simhash_links_are_whole()


def test_simhash_edges(spark):
    got = simhash.simhash_dedup(spark.createDataFrame(EDGE, SCHEMA)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16
    assert by[5].component_id == 3 and by[2].component_id == 1
    assert by[None].component_id is None
    assert not simhash.simhash_dedup(spark.createDataFrame([], SCHEMA)).collect()


def test_embeddings(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    rng = np.random.default_rng(2)
    for i in range(120):  # near and equal copies
        v = np.array(rows[i % 7][1]) + rng.normal(0, 0.02 * (i % 5), 64)
        rows.append((9000 + i, [float(x) for x in v.astype("f4")]))
    rows += [(9500, None), (9501, [0.0] * 64), (9502, [float("nan")] + [1.0] * 63), (9503, [None] + [1.0] * 63),
             (9504, [float("inf")] + [1.0] * 63), (9505, [1.0, 0.0]), (9506, [2.0, 0.0]), (9507, [])]
    ok = {i: np.array(v, dtype="f8") for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b])
              and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95]
    n = Counter(x for e in linked for x in e)
    want = components([i for i, _ in rows], linked)
    got = cover_tree.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        i: (n[i], want[i], want[i] == i) for i, _ in rows
    }
    empty = cover_tree.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect()
    assert not empty
    odd = spark.createDataFrame([(1, [1.0], 3), (1, [1.0], 4), (None, [1.0], 5), (2, [3.0], 6)], "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.embedding_dedup(odd).collect()}
    assert got == {1: (1, 1), 2: (1, 1), None: (0, None)} and cover_tree.embedding_dedup(odd).count() == 4


def test_a_node_of_several_blocks(spark):
    """One dense group larger than a block is dealt to several blocks and loses no link."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=64) + rng.normal(0, 0.16, (700, 64))
    x = np.concatenate([x, rng.normal(size=(300, 64))]).astype("f4").astype("f8")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.95).sum(1) - 1
    assert 0 < want[:700].mean() < 699
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = cover_tree.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))


def test_blocks_meet_without_copies_on_disk(spark):
    """Vectors without structure: every block meets every block, yet what is exchanged stays near the size of the table. Copies lie in all partitions."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3600, 64)).astype("f4")
    x[3000:3300] = x[:300] + rng.normal(0, 0.02, (300, 64)).astype("f4")
    x[3300:] = x[7]
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = sent()
    got = cover_tree.embedding_dedup(table).collect()
    assert sent() - before < 8 * x.nbytes
    want = components(range(len(x)), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True)])
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(linked[i].sum()) - 1, want[i]) for i in range(len(x))}


def test_traversal_prunes_only_what_it_may():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(0, 0.05, (30, 8)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.Tree(x[::3], 64)
    at, far = tree.lowest(x)
    radius = np.full(len(tree.centres), -1.0)
    np.maximum.at(radius, at, far)
    may = cover_tree.dual_traversal(tree, radius, np.sqrt(0.1))
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert may[at[i], at[j]].all()
    assert may.mean() < 0.5


def shares(x, nodes):
    """Share of open pairs among nodes that hold vectors, and among the leaves of all vectors."""
    tree = cover_tree.Tree(x[::2], nodes)
    at, far = tree.lowest(x)
    radius = np.full(len(tree.centres), -1.0)
    np.maximum.at(radius, at, far)
    may = cover_tree.dual_traversal(tree, radius, np.sqrt(0.1))[np.ix_(radius >= 0, radius >= 0)]
    of, off = cover_tree.leaves(x, np.sqrt(0.1) / 2)
    centre = np.unique(of)
    r = np.zeros(len(x))
    np.maximum.at(r, of, off)
    assert off.max() <= np.sqrt(0.1) / 2 + 1e-9 and (np.linalg.norm(x - x[of], axis=1) <= off + 1e-9).all()
    open_ = cover_tree.open_leaves(x[centre], r[centre], x[centre], r[centre], np.sqrt(0.1))
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert open_[np.searchsorted(centre, of[i]), np.searchsorted(centre, of[j])].all()
    return may.mean(), open_.mean(), len(centre) / len(x)


def test_share_of_open_pairs(tiny):
    """Clusters are pruned as nodes; vectors without structure only as leaves."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(120, 64)), 20, axis=0)
    x += rng.normal(0, 0.05, x.shape)
    nodes, leaf, kept = shares(x / np.linalg.norm(x, axis=1, keepdims=True), 256)
    assert nodes < 0.05 and leaf < 0.05 and kept < 0.2
    plain = np.array(pq.read_table(f"{tiny.replace('0.001', '0.1')}/embeddings.parquet")["embedding"].to_pylist())
    _, leaf, kept = shares(plain / np.linalg.norm(plain, axis=1, keepdims=True), 256)
    assert leaf < 0.01 and kept > 0.9


def substring_brute(rows):
    """Word by word: units, then runs of units that an earlier place has."""
    table = {}
    for i, t in sorted(r for r in rows if r[1] is not None):
        found, words, stop = [], [], False
        for m in re.finditer("[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+", t):
            if m[0].isspace() and m[0][0] in " \t\n\r\f\v":
                if words and ("\n" in m[0] or stop):
                    found.append(words)
                    words = []
                continue
            words.append((m.start(), m[0].lower()))
            stop = m[0][-1] in ".!?"
        table[i, t] = [*found, words] if words else found
    first = {}
    for k, found in table.items():
        for n, ws in enumerate(found):
            first.setdefault(" ".join(w for _, w in ws), (k, n))
    out = {}
    for k, found in table.items():
        late = [first[" ".join(w for _, w in ws)] != (k, n) for n, ws in enumerate(found)]
        starts = [0 if not n else ws[0][0] for n, ws in enumerate(found)] + [len(k[1])]
        spans, n = [], 0
        while n < len(found):
            m = n
            while m < len(found) and late[m]:
                m += 1
            if m > n:
                spans.append((starts[n], starts[m], sum(map(len, found[n:m]))))
            n = max(m, n + 1)
        out[k] = spans
    return out


def without(text, spans):
    for lo, hi in reversed(spans):
        text = text[:lo] + text[hi:]
    return text


def test_substring(spark, tiny):
    df, rows = docs_of(spark, tiny)
    passage = "One two three four five six. Seven!  Eight nine ten eleven twelve? A b c d.\nE f g h i j k l m n o p q r s t."
    rows += [(70_000 + i, f"Own words {i} here {passage} and own {i}") for i in range(80)]
    rows += [(71_000, "All rights reserved by the owner of it."), (71_001, "own\nAll rights reserved by the owner of it.\nown"), (71_002, ""), (71_003, " \n\t"), (71_004, None)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = substring_brute(rows)
    texts = dict(rows)
    assert {r.doc_id: [tuple(x) for x in r.removed] for r in got if r.doc_id != 71_004} == {i: [x[:2] for x in v] for (i, _), v in want.items()}
    for r in got:
        spans = [tuple(x) for x in r.removed]
        assert r.text == (None if texts[r.doc_id] is None else without(texts[r.doc_id], spans)) and bool(spans) == (r.n_removed > 0)
        assert r.repeats == any(2 * n >= substring_dedup.PASSAGE for *_, n in want.get((r.doc_id, texts[r.doc_id]), []))
    by = {r.doc_id: r for r in got}
    assert not by[70_000].repeats and all(by[70_000 + i].repeats for i in range(1, 80)) and not by[71_001].repeats
    assert by[71_000].text and by[71_001].text == "own\n" and by[71_001].n_removed == 2  # a lone line, and the second "own"
    units = [" ".join(w) for r in got if r.text for _, w in substring_dedup.units(r.text)]
    assert len(units) - len(set(units)) < 0.001 * len(units)  # what is left repeats only where removal joined the ends of lines
    assert by[70_001].text == "Own words 1 here One two three four five six. and own 1"


LINE = "a line of more than twenty words that stands in every one of these texts and is removed from all but the first of them"


def test_substring_different_texts_under_one_id_or_none(spark):
    rows = [(1, LINE), (2, f"first\nsecond\n{LINE}"), (2, "short"), (2, f"unique line\n{LINE}\nlast"), (None, f"x\n{LINE}"), (None, f"y\n{LINE}\nz"), (None, "w")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 9, r.text) for r in got) == sorted(
        [(1, LINE), (2, "first\nsecond\n"), (2, "short"), (2, "unique line\nlast"), (9, "x\n"), (9, "y\nz"), (9, "w")]
    )


def test_substring_edges(spark):
    long = "x y z w " * 9
    more = [(8, long, "a", 1), (9, long.upper(), "a", 1), (9, long.upper(), "a", 1), (10, "y" * 300_000, "a", 1)]
    got = substring_dedup.substring_dedup(spark.createDataFrame([*EDGE, *more], SCHEMA)).collect()
    assert len(got) == len(EDGE) + len(more)
    by = {r.doc_id: r for r in got}
    assert (by[3].text, by[3].n_units, by[3].repeats) == (None, 0, False) and (by[4].text, by[4].n_units) == ("", 0)
    assert (by[9].text, by[9].n_removed) == ("", 1) and by[8].text == long and by[1].text == "same text here" and by[2].text == "" and by[10].n_units == 1
    assert not substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).collect()
    assert substring_dedup.units("a\n\nB c\nd.\n \ne", "paragraph") == [(0, ["a"]), (3, ["b", "c", "d."]), (12, ["e"])]


def edit_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_brute(rows, least):
    occ = [(i, n, x.strip(" ")) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= least]
    drop = {}
    distinct = {}
    for i, n, x in occ:
        distinct[x] = min(distinct.get(x, (i, n)), (i, n))
    for i, n, x in occ:
        if any(edit_within_one(x, y) for y, r in distinct.items() if r < (i, n)):
            drop.setdefault(i, set()).add(n)
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop.get(i, ())) for i, t in rows}


def test_lines(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choice("ab c") for _ in range(rng.choice([20, 21, 22, 40, 41, 90, 700]))) for _ in range(12)]
    lines += ["aaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaa", "short"]
    rows = []
    for i in range(60):
        chosen = []
        for _ in range(rng.randrange(1, 5)):
            x = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p, what = rng.randrange(len(x)), rng.randrange(3)
                x[p : p + (what != 0)] = [] if what == 1 else [rng.choice("abé𝒳")]
            chosen.append("".join(x))
        rows.append((i, "\n".join(chosen)))
    rows += [(100, None), (101, "")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = line_brute(rows, line_dedup.MIN_CHARS)
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.n_removed for r in got) > 30


def test_short_lines(spark):
    rows = [(1, "Les.\n\nnineteen characters\n twenty characters x"), (2, "Les. \nLez.\n\nnineteen characterz"), (3, None),
            (4, "twenty characters xy\nLez.\nnineteen characters\n\nx"), (5, "twenty characters xz\nx\nLes")]
    rows += [(i, f"hot\nown {i}") for i in range(10, 90)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "Lez.\n\nnineteen characterz" and got[3].text is None
    assert (got[4].text, got[4].n_removed) == ("twenty characters xy\n\nx", 2) and (got[5].text, got[5].n_removed) == ("Les", 2)
    assert got[10].text == "hot\nown 10" and all(got[i].text == f"own {i}" for i in range(11, 90))


def test_lines_of_different_texts_under_one_id_or_none(spark):
    line = "a line that stands in all of them"
    rows = [(1, line), (2, f"only here, and long enough\n{line}"), (2, "short"), (None, f"nothing else has this line\n{line}"), (None, f"{line}s\nz")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()
    assert sorted((r.doc_id or 9, r.text) for r in got) == sorted(
        [(1, line), (2, "only here, and long enough"), (2, "short"), (9, "nothing else has this line"), (9, "z")]
    )


def test_filters_keep_exactly_one(spark):
    schema = "doc_id long, text string, row string, tie map<string,int>"
    rows = [(7, "A", "p", None), (7, "A", "q", {"k": 1}), (7, "A", "q", {"k": 1}), (5, "B", "r", None), (None, "A", "s", None), (None, "B", "t", None), (None, "C", "u", None),
            (None, "C", "v", None), (8, None, "w", None), (9, "", "x", None), (3, "B", "y", None)]
    df = spark.createDataFrame(rows, schema)
    kept = exact_dedup.deduplicated(df).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in kept) == [("", 9), ("A", 7), ("B", 5), ("C", 0)]
    assert {type(r.tie) for r in kept} <= {dict, type(None)} and exact_dedup.deduplicated(df).columns == df.columns
    near = simhash.deduplicated(df).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in near) == [("", 8), ("A", 7), ("B", 3), ("C", 0)]
    assert not simhash.deduplicated(df.limit(0)).collect() and not exact_dedup.deduplicated(df.limit(0)).collect()


def test_runs_are_sorted_and_merged(spark):
    """Several rounds, each of which sorts what arrives and merges in order; nothing is aggregated by hash."""
    import pyspark.sql.functions as F

    rank = F.struct(F.col("id").alias("doc_id"))
    ids = spark.range(0, 3000, 1, 7).withColumn("t", (F.col("id") % 100).cast("string"))
    ids = ids.select(exact_dedup.identity("t").alias("key"), rank.alias("rank"))
    merged = exact_dedup.merge_runs(ids)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("SortAggregate") >= 2
    got = merged.collect()
    assert len(got) == 100 and all(r.group_size == 30 for r in got) and sorted(r.keep.doc_id for r in got) == list(range(2900, 3000))


def test_line_edges(spark):
    got = line_dedup.line_dedup(spark.createDataFrame(EDGE, SCHEMA), min_chars=1).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[3].text is None and by[4].text == "" and by[2].n_removed == 1 and by[2].text == ""
    assert not line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).collect()


def test_lines_of_1_to_30_characters(spark):
    """One edit at every length, and one edit for 20 characters of the shorter line."""
    rng = random.Random(17)
    lines = ["".join(rng.choice("abc ") for _ in range(n)) for n in range(1, 31) for _ in range(3)]
    rows = []
    for i in range(150):
        x = list(rng.choice(lines))
        p, what = rng.randrange(len(x)), rng.randrange(4)
        x[p : p + (what < 2)] = rng.choice("abc") if what in (0, 2) else ""
        rows.append((i, "".join(x) + "\n" + rng.choice(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df, min_chars=1).collect()} == line_brute(rows, 1)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df, short=True).collect()}
    seen, want = [], {}
    for i, t in rows:
        left = []
        for raw in t.split("\n"):
            x = raw.strip(" ")
            near = lambda y: x == y or min(len(x), len(y)) >= line_dedup.MIN_CHARS and edit_within_one(x, y)  # noqa: B023, E731
            if not x or not any(map(near, seen)):
                left.append(raw)
            seen.append(x)
        want[i] = "\n".join(left)
    assert got == want
