"""Redirects followed one by one, and robots rules."""

import random

from sievewright.sources import crawl

SCHEMA = "url string, status int, location string, size long, failure string"


def walk(table, private, url, most=5):
    hops, seen = 0, [url]
    while True:
        row = table.get(url)
        if row is None:
            return None if hops > most else url, min(hops, most + 1), "http_error" if hops > most else "network_error"
        _, status, location, size, failure = row
        if failure:
            return url, hops, "timeout" if "Timeout" in failure else "network_error"
        if size > crawl.MAX_BYTES:
            return url, hops, "too_large"
        if status not in crawl.MOVED or not location:
            return url, hops, None
        if location.split("/")[2] in private:
            return url, hops, "private_host"
        url = location
        hops += 1
        seen.append(url)
        if hops > most:
            return None, most + 1, "http_error"


def test_chains_against_a_walk(spark):
    rng = random.Random(6)
    names = [f"https://h{i % 7}.example.org/{i}" for i in range(400)]
    rows = []
    for i, u in enumerate(names[:380]):
        kind = rng.random()
        to = names[min(399, i + rng.choice([1, 1, 1, 2, -3]))] if i > 5 else names[i + 1]
        moved = kind < 0.75
        rows.append((u, 301 if moved else 200, to if moved else None, 3_000_000 if kind > 0.97 else 10, rng.choice([None] * 30 + ["ReadTimeout", "Oops"])))
    rows += [("https://a.org/loop1", 302, "https://a.org/loop2", 1, None), ("https://a.org/loop2", 302, "https://a.org/loop1", 1, None), ("https://a.org/self", 308, "https://a.org/self", 1, None)]
    rows += [("https://a.org/d/x", 301, "../y?z", 1, None), ("https://a.org/y?z", 200, None, 1, None), ("https://a.org/q", 301, "//a.org/y?z", 1, None), ("https://a.org/f", 301, "ftp://a.org/", 1, None), (None, 200, None, 1, None)]
    table = {r[0]: r for r in rows}
    private = {"h3.example.org"}
    got = {r.url: r for r in crawl.follow(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(p,) for p in private], "host string")).collect()}
    assert len(got) == len(rows) - 1
    for u, *_ in rows[:382]:
        r, (end, hops, why) = got[u], walk(table, private, u)
        assert r.reason == why, (u, r, why)
        if why in (None, "http_error"):
            assert (r.final_url, r.hops) == (end, hops)
    assert got["https://a.org/loop1"].looped and got["https://a.org/self"].looped and got["https://a.org/self"].reason == "http_error"
    assert not any(got[u].looped for u in names[:300] if got[u].reason is None)
    assert got["https://a.org/d/x"].final_url == "https://a.org/y?z" == got["https://a.org/q"].final_url
    assert got["https://a.org/f"].reason == "unsupported_scheme"


def test_robots(spark):
    text = "# all\nDisallow: /before\nUser-agent: other\nDisallow: /\n\nUser-Agent: a\nUser-agent: *\nAllow: /en/12\nDisallow: /en/1 # not these\nDisallow:\nDisallow: /*.pdf$\nAllow: /x\nDisallow: /x\nDisallow: /cgi?a="
    named = "User-agent: *\nDisallow: /\nUser-agent: MyBot\nAllow: /\nDisallow: /private"
    rules = crawl.robots_rules(spark.createDataFrame([("a.org", text), ("b.org", named), ("c.org", None), ("d.org", "")], "host string, text string"), "MyBot/1.0")
    cases = [("https://a.org/en/12/z", True), ("https://a.org/en/13", False), ("http://a.org/en/2", True), ("https://a.org/d/f.pdf", False), ("https://a.org/d/f.pdf?x", True), ("https://a.org/x/y", True),
             ("https://a.org/cgi?a=1", False), ("https://a.org", True), ("https://a.org/before", True), ("https://b.org/private/1", False), ("https://b.org/", True), ("https://c.org/", True), ("https://d.org/x", True),
             ("https://none.org/x", True), ("no address", True), (None, True)]
    got = crawl.allowed(spark.createDataFrame([(u,) for u, _ in cases], "url string"), rules).collect()
    assert {r.url: r.robots_allowed for r in got} == dict(cases) and len(got) == len(cases)
    first = {r.url: r.robots_allowed for r in crawl.allowed(spark.createDataFrame([(u,) for u, _ in cases], "url string"), rules, "first").collect()}
    assert first["https://b.org/private/1"] and first["https://a.org/en/12/z"] and not first["https://a.org/en/13"]
