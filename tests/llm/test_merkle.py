"""Merkle proofs against a tree built by hand."""

import hashlib

from pyspark.sql import functions as F

from sievewright.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root and, for each leaf, the siblings' (before, after) by level."""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for lo in range(0, len(nodes), 3):
            run = nodes[lo : lo + 3]
            for k in range(len(run)):
                for i in at[lo + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            held.append([i for x in at[lo : lo + 3] for i in x])
        nodes, at = up, held
    return nodes[0], proofs


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], h(*map(enc, r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    one = {g: tree([leaf for *_, leaf in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))]) for g in names}
    root, tops = tree([one[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, doc, leaf), proof in zip(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2])), one[g][1], strict=True):
            out.append((doc, g, leaf, one[g][0], root, tuple(proof + top)))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, level string, grp string, path string, `a.b` string"


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(df, claimed=F.lit(None).cast("string"))
    key = str
    assert sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((s["before"], s["after"]) for s in r.path)) for r in got.collect()), key=key) == sorted(by_hand(rows), key=key)
    folded = got.select(merkle.fold(F.col("leaf"), F.col("path")).alias("f"), "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("p"), "path")
    for r in folded.collect():
        assert r.f == r.root and r.p == h(*[s["before"] + s["after"] for s in r.path])


def test_groups_of_many_sizes(spark):
    rows = [(i, "big", "en", 3, f"t\n{i}") for i in range(250)] + [(i, "é", None, None, "x" * i) for i in range(10)]
    rows += [(i, None, "de", i, None) for i in range(4)] + [(7, "alone", "fr", 1, ""), (None, "none", None, None, None), (3, "Z", "a", 1, "b"), (3, "Z", "a", 2, "b")]
    check(spark, rows)


def test_repeated_rows(spark):
    check(spark, [(5, "s", "en", 1, "same")] * 30 + [(None, "s", "en", 1, None)] * 7 + [(i, "s", None, 0, "") for i in range(3)])


def test_one_group_and_one_leaf(spark):
    check(spark, [(1, "s", "en", 1, "only")])
    check(spark, [(i, "s", "en", 1, "y" * 40_000) for i in range(3)])


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_leaf_doesnt_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, "s", "en", 1, f"a\n{i}", "", "", "", "") for i in range(20)], SCHEMA)
    other = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit("")))
    got = merkle.manifest(df, claimed=other)
    assert got.where(merkle.fold(F.col("claimed"), F.col("path")) == F.col("root")).count() == 0
