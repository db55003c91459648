"""Registered queries over pages as crawled responses, probes and logs, each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievewright.functions import skills
from sievewright.operators import embedding, runlog, sampling
from sievewright.plans import catalogue
from sievewright.plans.registry import query
from sievewright.session import shared_folder, spread, table
from sievewright.sources import crawl, snapshots
from sievewright.streaming import timers

c = F.col

# --- pages as responses -----------------------------------------------------

_ADDRESS = "(SELECT page_id, 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || '?p=' || page_id AS url FROM pages)"
_RESPONSES = f"""a AS {_ADDRESS}, n AS (SELECT page_id, url, lead(url) OVER (ORDER BY page_id) AS up, lag(url) OVER (ORDER BY page_id) AS down FROM a),
r AS (SELECT *, CASE WHEN page_id % 23 = 1 THEN 'timeout' WHEN page_id % 29 = 2 THEN 'too_large' END AS fail, length(regexp_extract(target, '://([^/?#]*)', 1)) % 9 = 0 AS closed
 FROM (SELECT *, CASE WHEN page_id % 17 < 8 OR page_id % 17 = 11 THEN up WHEN page_id % 17 = 12 THEN down END AS target FROM n))"""


def _responses(spark, d):
    """Pages that redirect to the next one in runs of up to eight, some in circles, some too large or late, and the hosts that aren't public."""
    at = lambda p: F.regexp_extract("url", p, 1)
    a = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), F.lower(at("://([^/?#]*)")), at("://[^/?#]*([^?#]*)"), F.lit("?p="), c("page_id")).alias("url"))
    near = a.select((c("page_id") - 1).alias("page_id"), c("url").alias("up")).join(a, "page_id", "right").join(a.select((c("page_id") + 1).alias("page_id"), c("url").alias("down")), "page_id", "left")
    k = c("page_id") % 17
    target = F.when((k < 8) | (k == 11), c("up")).when(k == 12, c("down"))
    # every other location leaves the scheme out
    location = F.when(c("page_id") % 2 == 0, F.substring(target, 7, 10_000)).otherwise(target)
    responses = near.select(
        "page_id", "url", F.when(target.isNotNull(), 302).otherwise(200).alias("status"), location.alias("location"), F.when(c("page_id") % 29 == 2, 3_000_000).otherwise(1000).alias("size"),
        F.when(c("page_id") % 23 == 1, "ReadTimeout").alias("failure"),
    )
    host = crawl.host_of(c("url"))
    return responses, a.where(F.length(host) % 9 == 0).select(host.alias("host"))


@query(f"""WITH RECURSIVE {_RESPONSES},
walk AS (SELECT url AS start, url AS cur, 0 AS hops FROM a UNION ALL SELECT start, r.target, hops + 1 FROM walk JOIN r ON r.url = walk.cur WHERE r.target IS NOT NULL AND r.fail IS NULL AND NOT r.closed AND hops < 8),
e AS (SELECT start, max(hops) AS hops, arg_max(cur, hops) AS cur, count(DISTINCT cur) < count(*) AS looped FROM walk GROUP BY 1)
SELECT a.page_id, CASE WHEN hops <= 5 THEN e.cur END AS final_url, least(hops, 6) AS hops, looped,
 CASE WHEN hops > 5 THEN 'http_error' ELSE coalesce(r.fail, CASE WHEN r.target IS NOT NULL AND r.closed THEN 'private_host' END) END AS reason
FROM e JOIN a ON a.url = e.start JOIN r ON r.url = e.cur""")
def redirect_chains(spark, d):
    responses, private = _responses(spark, d)
    return crawl.follow(responses, private).join(responses.select("url", "page_id"), "url").select("page_id", "final_url", "hops", "looped", "reason")


_ROBOTS = "'User-agent: slowbot' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /en/1' || chr(10) || 'Disallow: /' || ['en/', 'fr/', 'es/'][length(host) % 3 + 1] || chr(10) || 'Disallow: /de/2'"


@query(f"""WITH a AS {_ADDRESS}, u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM a),
t AS (SELECT host, string_split({_ROBOTS}, chr(10)) AS ls FROM (SELECT DISTINCT host FROM u)), l AS (SELECT host, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM t),
g AS (SELECT *, last_value(CASE WHEN starts_with(line, 'User-agent: ') THEN line[13:] END IGNORE NULLS) OVER (PARTITION BY host ORDER BY k) AS agent FROM l),
r AS (SELECT host, line[1:5] = 'Allow' AS allow, regexp_extract(line, ': (.*)$', 1) AS rule FROM g WHERE agent = '*' AND NOT starts_with(line, 'User')),
m AS (SELECT page_id, arg_max(allow, length(rule)) AS allow FROM u JOIN r ON r.host = u.host AND starts_with(u.path, r.rule) GROUP BY 1)
SELECT u.page_id, coalesce(m.allow, true) AS robots_allowed FROM u LEFT JOIN m USING (page_id)""")
def robots_allowed(spark, d):
    responses, _ = _responses(spark, d)
    hosts = responses.select(crawl.host_of(c("url")).alias("host")).distinct()
    third = F.element_at(F.array(F.lit("en/"), F.lit("fr/"), F.lit("es/")), (F.length("host") % 3 + 1).cast("int"))
    text = F.concat(F.lit("User-agent: slowbot\nDisallow: /\nUser-agent: *\nAllow: /en/1\nDisallow: /"), third, F.lit("\nDisallow: /de/2"))
    rules = crawl.robots_rules(hosts.select("host", text.alias("text")), "sievewright")
    return crawl.allowed(responses.select("page_id", "url"), rules).select("page_id", "robots_allowed")


# --- sampling, probes, calibration -------------------------------------------

_DRAWN = f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{sampling.SEED}:' || vec_id), vec_id) AS place FROM e) WHERE place <= {sampling.PER_FAMILY}),
s AS (SELECT p.vec_id AS probe, p.label, p.label = x.label AS relevant, x.vec_id, round(list_dot_product(p.v, x.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(x.v, x.v)), 6) AS similarity
  FROM p JOIN e x ON p.vec_id <> x.vec_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= {sampling.TOP_K}),
b AS (SELECT probe, label, max(similarity) FILTER (relevant) AS rel, max(similarity) FILTER (NOT coalesce(relevant, false)) AS irr FROM h GROUP BY 1, 2)"""


def _corpus(spark, d):
    return table(spark, d, "embeddings").select(c("vec_id").alias("chunk_id"), c("embedding").alias("vec"), c("label").alias("family"))


@query(f"WITH {_DRAWN} SELECT label AS family, vec_id AS id, place FROM p")
def drawn_probes(spark, d):
    """A seeded sample of vectors of each family."""
    return sampling.draw(_corpus(spark, d), ["family"], ["chunk_id"], sampling.PER_FAMILY).select("family", c("chunk_id").alias("id"), "place")


@query(f"""WITH {_DRAWN} SELECT round(quantile_cont(irr, 0.1), 6) AS floor, round(quantile_cont(rel, 0.9), 6) AS ceiling, round(median(irr), 6) AS irrelevant_median, round(median(rel), 6) AS relevant_median,
 list_sort(list(irr) FILTER (irr IS NOT NULL))[round_even(0.95 * (count(irr) - 1), 0)::INTEGER + 1] AS irrelevant_p95, round(median(rel) - median(irr), 6) AS separation, count(*) AS probes FROM b""")
def probe_calibration(spark, d):
    """Probes drawn, retrieved and calibrated."""
    whole, _ = sampling.calibrate(_corpus(spark, d))
    return whole.select(*[F.round(x, 6).alias(x) for x in ("floor", "ceiling", "irrelevant_median", "relevant_median")], "irrelevant_p95", F.round("separation", 6).alias("separation"), "probes")


@query(f"WITH {_DRAWN} SELECT label AS family, round(median(rel), 6) AS relevant_median, round(median(irr), 6) AS irrelevant_median, count(rel) AS n FROM b GROUP BY 1")
def probe_families(spark, d):
    _, per = sampling.calibrate(_corpus(spark, d))
    return per.select("family", F.round("relevant_median", 6).alias("relevant_median"), F.round("irrelevant_median", 6).alias("irrelevant_median"), "n")


_TITLES = ["Data Engineer", "Analyst"]


@query(f"""WITH {catalogue._DOCS}, {catalogue._LEX}, {catalogue._DS}, f AS (SELECT DISTINCT lang AS family, canon AS skill FROM ds JOIN documents USING (doc_id) WHERE lang IS NOT NULL),
n AS (SELECT family, count(*) AS n FROM f GROUP BY 1), a AS (SELECT family, n, unnest(range({sampling.PER_FAMILY})) AS probe FROM n),
z AS (SELECT *, CASE WHEN n <= {sampling.LEAST} THEN n ELSE {sampling.LEAST} + ('0x' || md5('{sampling.SEED}:' || family || ':' || probe)[1:8])::BIGINT % (n - {sampling.LEAST} + 1) END AS size FROM a),
r AS (SELECT family, probe, size, skill, row_number() OVER (PARTITION BY family, probe ORDER BY md5('{sampling.SEED}:' || family || ':' || probe || ':' || skill), skill) AS place FROM z JOIN f USING (family))
SELECT family, probe::INTEGER AS probe, 'Job requirements: ' || string_agg(skill, ', ' ORDER BY place) || '. Job description excerpt: We are hiring a ' || {_TITLES}[probe % 2 + 1] ||
 ' to join our team and work on production systems.' AS query FROM r WHERE place <= size GROUP BY family, probe""")
def probe_corpus(spark, d):
    """Posting-like probes from the skills that documents of each language name."""
    found = catalogue.planted_documents(spark, d).select(c("lang").alias("family"), F.explode(skills.match_skills(c("text"))).alias("skill"))
    return sampling.probe_texts(found, _TITLES)


# --- streams, snapshots, logs ---------------------------------------------------


@query(catalogue.ORACLES["timing_gate"])
def timing_stream(spark, d):
    """The timing measure of events that arrive as a stream, paired in keyed state."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    phase = F.when(c("event_type").isin("view", "click"), " Baseline ").when(c("event_type") == "purchase", "assisted").otherwise("other")
    rows = stream.select(
        c("user_id").cast("string").alias("timer_id"), (c("event_id") % 20).cast("string").alias("case_id"), phase.alias("phase"), c("value").cast("string").alias("minutes"),
        F.lit("baseline_first").alias("first_exposure"), c("event_id").alias("ordinal"), c("ts").cast("timestamp").alias("at"),
    )
    truth = table(spark, d, "events").select((c("event_id") % 20).cast("string").alias("case_id"))
    base = f"{shared_folder(spark)}/timers-{uuid.uuid4().hex}"
    with timers.keyed_state(spark):
        timers.write_parts(timers.pairs(rows, truth), f"{base}/parts", f"{base}/state")
    g = runlog.gate(timers.read_pairs(spark, f"{base}/parts"))
    return g.select("status", "n_timers", "n_paired", "hits", F.round("median_reduction", 3).alias("median_reduction"), F.round("max_reduction", 3).alias("max_reduction"))


@query("SELECT vec_id, label, len(embedding)::INTEGER AS size, vec_id % 2 = 0 AS pinned FROM embeddings")
def index_snapshot(spark, d):
    """Two versions of the vectors: half of them, then all; a reader that pinned the first one still has it."""
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    first = snapshots.publish(e.where("vec_id % 2 = 0"), root)
    pinned = snapshots.read(spark, root)
    snapshots.publish(e, root)
    now, old = snapshots.read(spark, root), pinned.select("vec_id", F.lit(first).alias("first"))
    return now.join(old, "vec_id", "left").select("vec_id", "label", F.size("embedding").alias("size"), c("first").isNotNull().alias("pinned"))


@query("""SELECT page_id, length(html)::INTEGER AS html_chars, substr(sha256(html), 1, 8) AS html_sha256_8, length(url)::INTEGER AS url_chars, substr(sha256(url), 1, 8) AS url_sha256_8 FROM pages""")
def action_log(spark, d):
    """What the log of actions keeps of pages: lengths and prefixes of hashes."""
    got = snapshots.action_records(table(spark, d, "pages"), ["html", "url"], ["page_id"])
    return got.select("page_id", *[c(f"{t}.{x}").alias(f"{t}_{x}") for t in ("html", "url") for x in ("chars", "sha256_8")])


@query(catalogue._SPARSE + """, b AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM q GROUP BY 1) SELECT 'tfidf-corpus-fitted' AS backend, true AS downgraded, item_id AS id, term AS feature, round(w / n, 6) AS x FROM q JOIN b USING (item_id)""")
def embedded_postings(spark, d):
    """Postings embedded by what ``auto`` comes to without a sentence model: TF-IDF of the documents."""
    chosen = embedding.choose("auto", spread(table(spark, d, "documents")), "doc_id", "text")
    out = chosen.encode(table(spark, d, "benchmark"), "item_id", "text")
    return out.select(F.lit(chosen.info["backend"]).alias("backend"), F.lit(chosen.info["downgraded"]).alias("downgraded"), "id", "feature", F.round("x", 6).alias("x"))
