"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import (
    byte_bpe,
    cover_tree,
    exact_dedup,
    impact_search,
    language_id,
    line_dedup,
    masked_lm,
    merkle,
    mixing,
    sharding,
    simhash,
    substring_dedup,
    url_filter,
)
from sievewright.llm.common import ensure_checkpoint_dir, table


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removed spans as text, ``start-end`` joined by commas."""
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return out.withColumn("removed", F.array_join(spans, ","))


def tokenizer() -> tuple[bytes, str]:
    """Content of the installed vocabulary file, and its splitting pattern."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern, ids=False)


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines: those of under MIN_CHARS characters go if an equal line is earlier."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), short=True)


def op10_line_dedup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines stay as they are."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards as files, and describe each record from them."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(sharding.shard(docs, row=F.struct("_metadata.file_name", "_metadata.row_index")), path)
    written = sharding.read_shards(spark, path, docs.schema)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return written.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, folded again from leaves of which half have lost their line breaks."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    broken = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit("")))
    got = merkle.manifest(docs, claimed=F.when(hit & F.contains("text", F.lit("\n")), broken))
    got = got.withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    proof = F.sha2(merkle.siblings(F.col("path")), 256)
    return got.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_neardup, op2_mix_sources, op3_language_id, op4_exact_dedup, op5_simhash_neardup,
        op6_url_filter, op7_substring_dedup, op8_byte_bpe, op9_masked_lm, op10_line_dedup, op10_line_dedup_long,
        op11_sharding, op12_merkle, op13_ranked_search, pipeline,
    )
}


def _rules_sql() -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)


def _listed_sql() -> str:
    return ", ".join(f"('{h}')" for h in url_filter.LISTED)


_OP4 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

_OP6 = f"""
WITH rules(verdict, h, p) AS (VALUES {_rules_sql()}),
listed(h) AS (VALUES {_listed_sql()}),
u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
best AS (
  SELECT page_id, host, path, max(struct_pack(n := length(r.h || r.p), k := length(r.h), rule := r.h || r.p, verdict := r.verdict)) AS r
  FROM (SELECT DISTINCT page_id, host, path FROM u) u JOIN rules r
    ON (u.host = r.h OR u.host LIKE '%.' || r.h) AND starts_with(u.path, r.p)
  GROUP BY page_id, host, path
)
SELECT u.page_id, u.host, u.path, b.r.rule AS rule,
       EXISTS (SELECT 1 FROM listed l WHERE u.host = l.h OR u.host LIKE '%.' || l.h) AS listed,
       coalesce(b.r.verdict, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE u.host = l.h OR u.host LIKE '%.' || l.h)
                                  THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best b ON u.page_id IS NOT DISTINCT FROM b.page_id AND u.host = b.host AND u.path = b.path
"""

_OP1 = f"""
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x : x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x : x <> 0))
),
unit AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM ok),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         AND list_dot_product(a.v, b.v) / (a.n * b.n) >= {cover_tree.THRESHOLD}),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.id),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
deg AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT comp.id AS vec_id, coalesce(deg.n, 0) AS n_links, component_id, comp.id = component_id AS kept FROM comp LEFT JOIN deg ON deg.id = comp.id
"""

_WS = " \\t\\n\\r\\f\\v"
_OP7 = f"""
WITH piece AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^{_WS}]+|[{_WS}]+')) AS piece,
                      generate_subscripts(regexp_extract_all(text, '[^{_WS}]+|[{_WS}]+'), 1) AS k FROM documents),
spot AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS lo,
                lag(contains(piece, chr(10)), 1, false) OVER (PARTITION BY doc_id ORDER BY k) AS newline FROM piece),
word AS (SELECT doc_id, k, lo, lower(piece) AS w, newline, regexp_matches(piece, '[.!?]$') AS stop,
                row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM spot WHERE NOT regexp_matches(piece, '^[{_WS}]')),
sent AS (SELECT *, coalesce(sum((stop_before OR newline)::INT) OVER (PARTITION BY doc_id ORDER BY k), 0) AS s
         FROM (SELECT *, lag(stop, 1, false) OVER (PARTITION BY doc_id ORDER BY k) AS stop_before FROM word)),
unit AS (SELECT doc_id, s AS u, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS norm, min(lo) AS lo FROM sent GROUP BY doc_id, s),
late AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, u) > 1 AS late,
                row_number() OVER (PARTITION BY doc_id ORDER BY u) AS place,
                lead(lo) OVER (PARTITION BY doc_id ORDER BY u) AS hi FROM unit),
run AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, late ORDER BY place) AS r FROM late),
gone AS (SELECT doc_id, r, count(*) AS n, sum(n) AS words, min(CASE WHEN place = 1 THEN 0 ELSE lo END) AS lo, max(place) AS last FROM run WHERE late GROUP BY doc_id, r),
span AS (SELECT g.doc_id, g.n, g.words, g.lo::BIGINT AS lo, coalesce(l.hi, length(d.text))::BIGINT AS hi
         FROM gone g JOIN late l ON l.doc_id = g.doc_id AND l.place = g.last JOIN documents d ON d.doc_id = g.doc_id),
cut AS (SELECT doc_id, sum(n)::INTEGER AS n, max(words) AS words, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed, list(struct_pack(lo := lo, hi := hi) ORDER BY lo) AS spans FROM span GROUP BY doc_id),
kept AS (SELECT c.doc_id, string_agg(substr(d.text, a.lo + 1, a.hi - a.lo), '' ORDER BY a.lo) AS text
         FROM cut c JOIN documents d ON d.doc_id = c.doc_id,
              LATERAL (SELECT unnest(list_concat([0::BIGINT], list_transform(c.spans, lambda x : x.hi))) AS lo,
                              unnest(list_concat(list_transform(c.spans, lambda x : x.lo), [length(d.text)::BIGINT])) AS hi) a
         GROUP BY c.doc_id),
units AS (SELECT doc_id, count(*)::INTEGER AS n FROM unit GROUP BY doc_id)
SELECT d.doc_id, coalesce(units.n, 0) AS n_units, coalesce(cut.n, 0) AS n_removed, coalesce(2 * cut.words >= {substring_dedup.PASSAGE}, false) AS repeats, coalesce(cut.removed, '') AS removed,
       CASE WHEN cut.n IS NULL THEN d.text ELSE kept.text END AS text
FROM documents d LEFT JOIN units USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP10_LONG = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS place FROM cut),
long AS (SELECT doc_id, place, trim(raw, ' ') AS t FROM line WHERE length(trim(raw, ' ')) >= {line_dedup.MIN_CHARS}),
own AS (SELECT t, min(struct_pack(d := doc_id, p := place)) AS r FROM long GROUP BY t),
pair AS (SELECT a.t, b.t AS u, b.r FROM own a JOIN own b ON left(a.t, 8) = left(b.t, 8) AND abs(length(a.t) - length(b.t)) <= 1
         UNION SELECT a.t, b.t, b.r FROM own a JOIN own b ON right(a.t, 8) = right(b.t, 8) AND abs(length(a.t) - length(b.t)) <= 1),
first AS (SELECT t, min(r) AS r FROM pair WHERE t = u OR levenshtein(t, u) <= 1 GROUP BY t),
late AS (SELECT l.doc_id, l.place FROM long l JOIN first f USING (t) WHERE struct_pack(d := l.doc_id, p := l.place) > f.r)
SELECT s.doc_id, count(*)::INTEGER AS n_lines, count(late.place)::INTEGER AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY s.place) FILTER (late.place IS NULL), '') AS text
FROM line s LEFT JOIN late ON late.doc_id = s.doc_id AND late.place = s.place GROUP BY s.doc_id
"""

_OP10 = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS place FROM cut),
long AS (SELECT doc_id, place, trim(raw, ' ') AS t FROM line WHERE length(trim(raw, ' ')) >= 1),
own AS (SELECT t, min(struct_pack(d := doc_id, p := place)) AS r FROM long GROUP BY t),
pair AS (SELECT a.t, b.t AS u, b.r FROM own a JOIN own b ON left(a.t, 8) = left(b.t, 8) AND abs(length(a.t) - length(b.t)) <= 1
         UNION SELECT a.t, b.t, b.r FROM own a JOIN own b ON right(a.t, 8) = right(b.t, 8) AND abs(length(a.t) - length(b.t)) <= 1),
first AS (SELECT t, min(r) AS r FROM pair WHERE t = u OR least(length(t), length(u)) >= {line_dedup.MIN_CHARS} AND levenshtein(t, u) <= 1 GROUP BY t),
late AS (SELECT l.doc_id, l.place FROM long l JOIN first f USING (t) WHERE struct_pack(d := l.doc_id, p := l.place) > f.r)
SELECT s.doc_id, count(*)::INTEGER AS n_lines, count(late.place)::INTEGER AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY s.place) FILTER (late.place IS NULL), '') AS text
FROM line s LEFT JOIN late ON late.doc_id = s.doc_id AND late.place = s.place GROUP BY s.doc_id
"""

#: crc32 of a short ASCII text: the table of 256 remainders follows from the polynomial.
_CRC = """crc AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda r, i : CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END) AS r
  FROM range(256) x(b)))"""
_OP12 = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, source, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
        CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head, text,
        list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x : ascii(x)::BIGINT)), lambda r, x : xor(t[((xor(r, x)) & 255) + 1], r >> 8)) AS c FROM documents, crc),
bad AS (SELECT *, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM d),
leaf AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS claimed FROM bad),
place AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaf),
node(source, level, idx, n, h) AS (SELECT source, 0, idx, n, leaf FROM place UNION ALL
  SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY source, level, idx // 3, n),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM node WHERE n = 1),
top(level, idx, n, h) AS (SELECT 0, k, n, subroot FROM sub UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 3, n),
root AS (SELECT h AS root FROM top WHERE n = 1),
run AS (SELECT source, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM node WHERE n > 1 GROUP BY 1, 2, 3),
toprun AS (SELECT level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY 1, 2),
step AS (SELECT p.doc_id, p.source, r.level, hs[:(p.idx // (3 ** r.level)::BIGINT) % 3] AS l, hs[(p.idx // (3 ** r.level)::BIGINT) % 3 + 2:] AS r
         FROM place p JOIN run r ON p.source IS NOT DISTINCT FROM r.source AND r.run = p.idx // (3 ** (r.level + 1))::BIGINT
         UNION ALL SELECT p.doc_id, p.source, 1000 + r.level, hs[:(k // (3 ** r.level)::BIGINT) % 3], hs[(k // (3 ** r.level)::BIGINT) % 3 + 2:]
         FROM place p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN toprun r ON r.run = k // (3 ** (r.level + 1))::BIGINT),
path AS (SELECT doc_id, list(struct_pack(l := array_to_string(l, ''), r := array_to_string(r, '')) ORDER BY level) AS steps FROM step GROUP BY doc_id),
fold(doc_id, k, h) AS (SELECT doc_id, 0, claimed FROM leaf UNION ALL
  SELECT f.doc_id, k + 1, sha256(steps[k + 1].l || h || steps[k + 1].r) FROM fold f JOIN path p ON p.doc_id = f.doc_id AND k < len(steps)),
last AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id)
SELECT p.doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x : x.l || x.r), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM place p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN root LEFT JOIN path USING (doc_id) JOIN last USING (doc_id)
"""

_WORDS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
_OP13 = f"""
WITH word AS (SELECT doc_id, {_WORDS} AS term FROM documents),
ask AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_WORDS} AS term FROM benchmark) GROUP BY 1, 2),
size AS (SELECT doc_id, count(*) AS n FROM word GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM ask) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS s FROM tf JOIN w USING (term) JOIN size USING (doc_id), whole),
score AS (SELECT item_id, doc_id, sum(times * s)::BIGINT AS score FROM ask JOIN impact USING (term) GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= {impact_search.TOP}
"""

ORACLES = {
    "op1_embedding_neardup": _OP1,
    "op4_exact_dedup": _OP4,
    "op6_url_filter": _OP6,
    "op7_substring_dedup": _OP7,
    "op10_line_dedup": _OP10,
    "op10_line_dedup_long": _OP10_LONG,
    "op12_merkle": _OP12,
    "op13_ranked_search": _OP13,
}
