"""Redirect chains and robots rules over tables of responses."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.session import cut
from sievewright.sources.fetched import MAX_BYTES, MAX_REDIRECTS

# Statuses that redirect.
MOVED = (301, 302, 303, 307, 308)
#: Hosts with rules whose rules are sent to all tasks.
MAX_BROADCAST = 20_000
_RULES = "array<struct<size:int,allow:boolean,line:int,pattern:string>>"


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, target: pd.Series) -> pd.Series:
    """A location as seen from a page; null if it can't be one."""

    def one(b: str | None, t: str | None) -> str | None:
        try:
            return None if b is None or not t else urljoin(b, t)
        except ValueError:
            return None

    return pd.Series([one(b, t) for b, t in zip(base, target, strict=True)])


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def follow(responses: DataFrame, private: DataFrame | None = None, most: int = MAX_REDIRECTS) -> DataFrame:
    """Where each address ends: ``url, final_url, hops, looped, reason`` for ``responses(url, status, location, size, failure)``, one row per url.

    Chains are followed by pointer jumping: every address knows what lies 1, 2, 4, ... hops ahead, so that ``most`` hops take log2 rounds of one join
    each, whatever the number of addresses. ``reason`` is what happens first on the way: timeout or network_error (as ``failure`` tells, or if a target has no response), too_large,
    private_host or unsupported_scheme (of a target; ``private(host)`` lists hosts that aren't public), http_error beyond ``most`` hops; null if a
    response is reached. ``looped`` tells that a chain meets an address again. Null addresses are left out.
    """
    c = F.col
    moved = c("status").isin(*MOVED) & (F.length(F.coalesce("location", F.lit(""))) > 0)
    fails = F.when(c("failure").isNotNull(), F.when(c("failure").contains("Timeout"), "timeout").otherwise("network_error")).when(c("size") > MAX_BYTES, "too_large")
    start = responses.where("url IS NOT NULL").dropDuplicates(["url"]).select("url", fails.alias("fail"), F.when(moved, joined("url", "location")).alias("to"))
    if private is None:
        start = start.withColumn("closed", F.lit(False))
    else:
        listed = private.select(c("host").alias("_h")).distinct()
        start = start.join(listed, host_of(c("to")) == c("_h"), "left").withColumn("closed", c("_h").isNotNull()).drop("_h")
    bad = F.when(c("fail").isNotNull(), c("fail")).when(c("to").isNotNull() & ~c("to").rlike("(?i)^https?://[^/?#]"), "unsupported_scheme").when(c("closed"), "private_host")
    goes_on = c("to").isNotNull() & c("reason").isNull()
    at = start.withColumn("reason", bad).select("url", "reason", F.when(goes_on, c("to")).alias("to"))
    at = cut(at.select("url", "reason", "to", F.when(c("to").isNotNull(), 1).otherwise(0).alias("hops"), F.when(c("to").isNotNull(), F.array("url", "to")).otherwise(F.array("url")).alias("seen")))
    span = 1
    while span <= most:
        ahead = at.select(c("url").alias("_at"), c("reason").alias("_why"), c("to").alias("_to"), c("hops").alias("_hops"), c("seen").alias("_seen"))
        met = at.join(ahead, c("to") == c("_at"), "left")
        lost = c("to").isNotNull() & c("_at").isNull()
        at = cut(met.select(
            "url", F.when(lost, "network_error").otherwise(F.coalesce("reason", "_why")).alias("reason"),
            # the end of a chain stays as "to" of no further hop
            F.when(c("to").isNotNull() & ~lost, c("_to")).alias("to"), (c("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.concat("seen", F.coalesce(F.slice("_seen", 2, 2 * most + 2), F.array().cast("array<string>"))).alias("seen"),
        ))
        span *= 2
    long = c("hops") > most
    return at.select(
        "url", F.when(long, F.lit(None).cast("string")).otherwise(F.element_at("seen", -1)).alias("final_url"), F.least("hops", F.lit(most + 1)).alias("hops"),
        (F.size(F.array_distinct("seen")) < F.size("seen")).alias("looped"), F.when(long, "http_error").otherwise(c("reason")).alias("reason"),
    )


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``host, rules`` of ``robots(host, text)``: the rules of the groups that name ``agent``, of those for all (``*``) if none does.

    A group is a run of user-agent lines and what follows up to the next run. A group names an agent whose name holds its token, without case. Rules without a path
    allow everything and are left out. Lines of a host are read in order, and its text is one row.
    """
    c = F.col
    line = robots.select("host", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "raw"))
    line = line.select("host", "line", F.regexp_replace("raw", "#.*", "").alias("raw")).where(F.contains("raw", F.lit(":")))
    line = line.select("host", "line", F.lower(F.trim(F.split_part("raw", F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("value"))
    line = line.where(c("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("line")
    begins = (c("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = line.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(order)).where("part > 0")
    token = F.lower("value")
    fits = F.when(c("key") == "user-agent", F.when(token == "*", 1).when((token != "") & F.contains(F.lit(agent.split("/")[0].lower()), token), 2).otherwise(0))
    rules = F.collect_list(F.when((c("key") != "user-agent") & (c("value") != ""), F.struct(
        F.length("value").alias("size"), (c("key") == "allow").alias("allow"), c("line").alias("line"), c("value").alias("pattern"))))
    groups = grouped.groupBy("host", "part").agg(F.max(fits).alias("fit"), rules.alias("rules")).where("fit > 0")
    best = groups.withColumn("most", F.max("fit").over(Window.partitionBy("host"))).where("fit = most")
    return best.groupBy("host").agg(F.flatten(F.collect_list("rules")).cast(_RULES).alias("rules"))


def allowed(urls: DataFrame, rules: DataFrame, precedence: str = "longest") -> DataFrame:
    """``urls`` with ``robots_allowed``: by the longest rule of its host that the path and query begin with (an allowing one of equal ones); with ``precedence="first"`` by the
    first one in the text. ``*`` in a rule stands for any characters, ``$`` for the end. Hosts without rules allow everything, as do addresses that match none.
    """
    c = F.col
    path = F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    near = rules.select(c("host").alias("_host"), "rules")
    near = F.broadcast(near) if near.count() <= MAX_BROADCAST else near
    df = urls.withColumn("_path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))).join(near, host_of(c("url")) == c("_host"), "left")

    def regex(p):
        quoted = F.regexp_replace(F.regexp_replace(p, r"([\\.\[\]{}()+?^|])", r"\\$1"), r"\*+", ".*")
        return F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\$(?!$)", r"\\$"))

    # a rule without a pattern sign is compared as text
    plain = lambda r: ~r["pattern"].rlike(r"[*$]")
    fits = F.filter("rules", lambda r: F.when(plain(r), F.startswith(c("_path"), r["pattern"])).otherwise(F.rlike(c("_path"), regex(r["pattern"]))))
    key = (lambda r: F.struct(r["size"].alias("a"), r["allow"].cast("int").alias("b"))) if precedence == "longest" else (lambda r: F.struct((-r["line"]).alias("a"), r["allow"].cast("int").alias("b")))
    best = F.array_max(F.transform(fits, key))
    return df.withColumn("robots_allowed", F.coalesce(best["b"] == 1, F.lit(True))).select(*urls.columns, "robots_allowed")
