"""Line dedup by a deletion-neighbourhood join, DataFrame functions only.

Two different lines are within one edit iff one is the other less a character, or
both become equal when the character at one place is taken out. So a line gives variants (less
the character at p, for every p) and itself; equal variants meet by hashed key. Those with the same p differ by a
substitution, a variant and a whole line by an insertion; both are verified by edit distance.

Most lines have no neighbour, so variants come out by narrowing: in a frame of n characters, a line
of n (or of n - 1, the shorter of a pair) keeps the half in which the edit lies only if the hash of the other half
is shared, then the quarter of that half, and so on. Parts shrink until SPAN characters are left, and the deletion variants at these places are made, each a digest of the whole
line less the character. No pair is lost: of two lines one edit apart, all but the part with the edit is the same in both, at every
level, so both keep that part, down to the place of the edit, whose variant they share. A hash that clashes on the way only keeps a line
longer; variants meet by 128 bits and are verified. Lines are met once however often they occur, and groups of equal
variants hold at most (length x alphabet) different lines. Parts that many lines share are split in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import cut, digest, row_identity, spread_join

#: The bound is one edit for so many characters of the shorter line: shorter lines stay as they are, or (``short``) go if equal to an earlier one.
MIN_CHARS = 20
#: The edit bound of all others.
EDITS = 1
#: Characters left when variants are made.
SPAN = 16
#: Parts that a place is split in at each level.
WAYS = 4
#: Lines whose keys are sent to all executors (16 bytes each); more of them meet by exchange.
MAX_BROADCAST = 500_000
_KEY = ["doc", "h1", "h2"]
_RANK = [*_KEY, "place"]


def _part(text: Column, lo: Column, hi: Column) -> Column:
    """Characters lo (0-based) to hi."""
    return F.substring(text, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def _occurrences(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """``doc, h1, h2, place, line, lid`` of every line that is long enough."""
    return (
        docs.select(*row_identity(doc_id, text), F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "line"))
        .select(*_RANK, F.trim("line").alias("line"))
        .where(F.char_length("line") >= min_chars)
        .withColumn("lid", digest("line"))
    )


def _parts(rows: DataFrame, key: Column) -> DataFrame:
    """Split each row's place of edit [a, b) in WAYS, keyed by what must then be equal: all before and after the part."""
    a, b = F.col("a"), F.col("b")
    shift = F.when(F.col("full"), 0).otherwise(1)  # a shorter line lacks the character at the edit
    edge = [a + F.floor((b - a) * i / WAYS) for i in range(WAYS + 1)]
    parts = [
        F.struct(
            lo.alias("a"), hi.alias("b"),
            F.xxhash64(key, lo, hi, _part(F.col("line"), a, lo), _part(F.col("line"), hi - shift, b - shift)).alias("key"),
        )
        for lo, hi in zip(edge[:-1], edge[1:], strict=True)
    ]
    return rows.withColumn("_h", F.explode(F.array(*parts))).where("_h.b > _h.a")


def _shared(rows: DataFrame, total: int) -> DataFrame:
    """Rows whose key another line has too, at least one of them in full length."""
    keys = rows.groupBy("key").agg(F.count("*").alias("_n"), F.max("full").alias("_f")).where("_n > 1 and _f")
    return spread_join(rows, keys.select("key", "_n"), "key", "_n", total).where("_n is not null")


def neighbours(lines: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``lid, best``: the smallest rank among the lines within one edit of a line; lines without any don't appear.

    ``lines``: ``lid, rank, n, halves`` per distinct line.
    """
    keyed = lines.select("lid", F.explode("halves").alias("_h")).select("lid", "_h.*")
    met = cut(_shared(keyed, 4 * lines.count()).select("lid", "frame", "full", "a", "b", "key"))
    lids = cut(met.select("lid").distinct())
    few = lids.count() <= MAX_BROADCAST
    texts = occurrences.join(F.broadcast(lids) if few else lids, "lid", "left_semi")
    texts = cut(
        texts.groupBy("lid").agg(F.min(F.struct(*_RANK)).alias("rank"), F.first("line").alias("line"))
    )
    rows = cut(met.join(texts, "lid"))
    wide = F.col("b") - F.col("a") > SPAN
    while many := rows.where(wide).count():
        halved = _parts(rows.where(wide), F.col("key")).select(
            "lid", "rank", "line", "frame", "full", "_h.a", "_h.b", "_h.key"
        )
        rows = cut(_shared(halved, WAYS * many).select("lid", "rank", "line", "frame", "full", "a", "b", "key").union(
            rows.where(~wide).select("lid", "rank", "line", "frame", "full", "a", "b", "key")
        ))
    line, a, b = F.col("line"), F.col("a"), F.col("b")

    def less(p: Column) -> Column:
        rest = F.concat(_part(line, F.lit(0), p), _part(line, p + 1, F.col("frame")))
        return F.struct(digest(rest).alias("variant"), p.cast("int").alias("p"))

    whole = F.array(F.struct(digest(line).alias("variant"), F.lit(-1).alias("p")))
    made = F.when(F.col("full"), F.transform(F.sequence(a.cast("int"), (b - 1).cast("int")), less)).otherwise(whole)
    out = rows.select("lid", F.struct("rank", "lid").alias("who"), F.explode(made).alias("_v")).select(
        "lid", "who", "_v.variant", "_v.p"
    )
    # the same place or the whole line meet; different places of one variant don't
    by_place = out.groupBy("variant", "p").agg(F.min("who").alias("low"))
    by_variant = by_place.groupBy("variant").agg(
        F.min(F.when(F.col("p") < 0, F.col("low"))).alias("short"),
        F.min(F.when(F.col("p") >= 0, F.col("low"))).alias("long"),
    )
    seen = out.join(by_place, ["variant", "p"]).join(by_variant, "variant")
    low = F.when(F.col("p") < 0, F.col("long")).otherwise(F.least("low", "short"))
    best = seen.groupBy("lid").agg(F.min(low).alias("best")).where("best is not null and best.lid != lid")
    mine = texts.select("lid", F.col("line").alias("_mine"))
    other = texts.select(F.col("lid").alias("_olid"), F.col("line").alias("_other"))
    proven = best.join(mine, "lid").join(other, F.col("best.lid") == F.col("_olid"))
    return proven.where(F.levenshtein("_mine", "_other", EDITS).between(0, EDITS)).select(
        "lid", F.col("best.rank").alias("best")
    )


def line_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, short: bool = False
) -> DataFrame:
    """Drop every line that has an earlier line within one edit (insert, delete or replace a character).

    Returns one row per row: ``doc_id, n_lines, n_removed, text``. Earlier is by doc_id, then by place; the earlier line
    counts even if it is dropped itself. Lines are compared without blanks at their ends; those of under ``min_chars``
    characters stay or, with ``short``, go if an equal line is earlier; empty ones stay always. A null text stays null with no lines. Rows that
    share a doc_id but not the text are different documents (ranked by a hash of the text), rows without one rank last and each counts; rows that
    repeat both id and text count as one and lose the same lines. Other columns aren't read; an empty table gives an empty result.
    """
    occurrences = _occurrences(docs, text, doc_id, 1 if short else min_chars)
    line = F.col("line")
    n = F.char_length("line").cast("long")

    def half(full: bool) -> list[Column]:
        frame = n if full else n + 1
        m = F.floor(frame / 2)
        s = F.lit(0 if full else 1)
        out = []
        for tag, lo, hi, a, b in (("R", F.lit(0), m, m, frame), ("L", m - s, n, F.lit(0).cast("long"), m)):
            key = F.xxhash64(F.lit(tag), frame, _part(line, lo, hi))
            out.append(
                F.struct(
                    frame.alias("frame"), F.lit(full).alias("full"),
                    a.cast("long").alias("a"), b.cast("long").alias("b"), key.alias("key"),
                )
            )
        return out

    made = occurrences.select("lid", *_RANK, n.alias("n"), *[
        h["key"].alias(f"k{i}") for i, h in enumerate(half(True) + half(False))
    ])
    grouped = cut(
        made.groupBy("lid").agg(
            F.min(F.struct(*_RANK)).alias("rank"),
            F.count("*").alias("n_seen"),
            F.first("n").alias("n"),
            *[F.first(f"k{i}").alias(f"k{i}") for i in range(4)],
        )
    )
    frame = [F.col("n"), F.col("n"), F.col("n") + 1, F.col("n") + 1]
    halves = F.array(*[
        F.struct(
            f.alias("frame"),
            F.lit(i < 2).alias("full"),
            (F.floor(f / 2) if i % 2 == 0 else F.lit(0).cast("long")).alias("a"),
            (f if i % 2 == 0 else F.floor(f / 2)).alias("b"),
            F.col(f"k{i}").alias("key"),
        )
        for i, f in enumerate(frame)
    ])
    near = neighbours(grouped.where(F.col("n") >= min_chars).select("lid", "rank", "n", halves.alias("halves")), occurrences)
    first = (
        grouped.join(near, "lid", "left")
        .withColumn("first", F.least("rank", "best"))
        .where("n_seen > 1 or first < rank")
        .select("lid", "first", "n_seen")
    )
    late = spread_join(occurrences.select("lid", *_RANK), first, "lid", "n_seen").where(
        F.col("first").isNotNull() & (F.struct(*_RANK) > F.col("first"))
    )
    drops = late.groupBy(*_KEY).agg(F.collect_set("place").alias("drops"))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), *row_identity(doc_id, text))
    both = base.join(drops, _KEY, "left")
    all_lines = F.split("_text", "\n", -1)
    kept = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("drops", i)), "\n")
    return both.select(
        "doc_id",
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(all_lines)).alias("n_lines"),
        F.when(F.col("_text").isNull() | F.col("drops").isNull(), 0).otherwise(F.size("drops")).alias("n_removed"),
        F.when(F.col("drops").isNull(), F.col("_text")).otherwise(kept).alias("text"),
    )
