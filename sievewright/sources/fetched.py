"""What to make of a fetched page: the gates of address, status, size and type over a table of responses."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.sources import pages

# Limits, and signs that a short page is a gate rather than a posting.
MAX_BYTES, MAX_REDIRECTS, MIN_CHARS, LEAST_CHARS = 2_000_000, 5, 200, 40
GATES = (
    ("login_required", r"sign\s+in\s+to\s+(continue|view|apply)|log\s*in\s+to\s+(continue|view|apply)|already have an account|enter your password"),
    ("paywall", r"subscri(be|ption)\s+to\s+(read|continue|view)|article limit|premium content|members only"),
    ("captcha", r"verify you are human|are you a robot|recaptcha|hcaptcha|cf-browser-verification|checking your browser|just a moment"),
    ("blocked", r"access denied|request blocked|forbidden|unusual traffic|too many requests"),
)


@F.pandas_udf(T.StringType())
def blocked_address(address: pd.Series) -> pd.Series:
    """Why an address isn't public; null if it is."""

    def why(a: str | None) -> str | None:
        try:
            ip = ipaddress.ip_address(a or "")
        except ValueError:
            return "not an address"
        for kind in ("loopback", "private", "link_local", "reserved", "multicast", "unspecified"):
            if getattr(ip, f"is_{kind}"):
                return kind
        return None

    return address.map(why)


def judge_responses(responses: DataFrame) -> DataFrame:
    """``url, reason, title, text`` for ``url, status, content_type, body, resolved_ips, redirects, robots_allowed, failure``.

    The first gate that fails names the reason: unsupported_scheme, private_host, robots_disallowed, timeout or
    network_error (as given in ``failure``), too_large, http_error (too many redirects, or the status), login_required,
    paywall, blocked, not_html, a gate's sign on a short page, not_html for a page of hardly any text; else ok.
    """
    c = F.col
    why = responses.select("*", F.explode_outer("resolved_ips").alias("_ip")).select("*", F.when(c("_ip").isNotNull(), blocked_address("_ip")).alias("_why"))
    bad = why.groupBy("url").agg(F.max(c("_why").isNotNull()).alias("_private"))
    df = responses.join(bad, "url")
    html = c("body").cast("string")
    text = pages.plain_text(html)
    gate = F.when(F.char_length("_text") >= MIN_CHARS, F.lit(None).cast("string"))
    for reason, pattern in GATES:
        gate = gate.when(F.lower("_text").rlike(pattern), reason)
    df = df.withColumn("_text", text).withColumn("_gate", gate)
    reason = (
        F.when(~F.lower("url").rlike("^https?://[^/?#]+"), "unsupported_scheme")
        .when(c("_private") | (F.size("resolved_ips") <= 0), "private_host")
        .when(~F.coalesce("robots_allowed", F.lit(True)), "robots_disallowed")
        .when(c("failure").isNotNull(), F.when(c("failure").contains("Timeout"), "timeout").otherwise("network_error"))
        .when(F.octet_length("body") > MAX_BYTES, "too_large")
        .when(c("redirects") > MAX_REDIRECTS, "http_error")
        .when(c("status") == 401, "login_required")
        .when(c("status") == 402, "paywall")
        .when(c("status").isin(403, 429), "blocked")
        .when(c("status") >= 400, "http_error")
        .when(~F.lower(F.coalesce("content_type", F.lit(""))).rlike("html|text"), "not_html")
        .when(c("_gate").isNotNull(), c("_gate"))
        .when(F.char_length("_text") < LEAST_CHARS, "not_html")
        .otherwise("ok")
    )
    ok = reason == "ok"
    return df.select("url", reason.alias("reason"), F.when(ok, pages.title(html)).otherwise("").alias("title"), F.when(ok, c("_text")).otherwise("").alias("text"))
