import random

import pytest

from loomtrace.llm import urls
from loomtrace.llm.urls import OWN_RULES, RULES, judged, rule_table


def plain(url, layers, default="allow"):
    """The contract in a loop over all rules."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].partition("?")[0].partition("#")[0]
    for layer, rules in enumerate(layers):
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
               if h and (p == "" or p[0] == "/") and (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return host, path, max(fit)[3], max(fit)[4]
    return host, path, None, default


ODD = [None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "http://xorg/", "http://.org/", "http://org./", "http://a..org/", "x://y://example.org/es/",
       "http://example.org/es/", "http://sub.Example.ORG/es/1?x=/en/1", "http://example.org/en/1", "http://example.org/en/15", "http://example.org?/es/", "http://a.com#/fr/",
       "http://é.com/fr/É", "http://É.example.org/en/1", "http://user@a.org:80/x", "http://spam-farm.example.org", "http://www.cheap-pills.example.com/en/", "a\nb://c.com/de/\n", "http://" + "a." * 3000 + "com/fr/" + "x" * 5000]


@pytest.mark.parametrize("short", [1, 8])
def test_equals_a_loop_over_all_rules(spark, short):
    rng = random.Random(3)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    paths = ["", *("/" + "/".join(rng.choice("xyz") for _ in range(rng.randrange(4))) for _ in range(30))]
    made = [[(rng.choice(hosts), rng.choice(paths)[:rng.randrange(1, 6)], rng.choice(["allow", "block"])) for _ in range(60)] for _ in range(2)]
    links = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    for layers, given in ((made, links + ODD), ((RULES, OWN_RULES), ODD * 2)):
        # Columns whose names the operator uses itself, null and repeated ids.
        rows = [(i % 7 or None, u, "h", "p", "r", "d", "s") for i, u in enumerate(given)]
        frame = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, best string, digest string, given string").repartition(3)
        got = judged(frame, rule_table(spark, *layers), short=short)
        seen = sorted((r.given.page_id or 0, r.given.url or "", r.given.host, r.host, r.path, r.rule or "", r.verdict) for r in got.collect())
        want = [(i % 7, u or "", "h", *(x or "" for x in plain(u, layers))) for i, u in enumerate(given)]
        assert seen == sorted(want)


def test_rules_that_fit_nothing(spark):
    rules = spark.createDataFrame([(0, None, "/", "block"), (0, "", "/", "block"), (0, "a.org", "x", "block"), (0, "A.org", None, "block"), (0, "a.org", "", "allow"), (0, "b.org", "", "other")],
                                  "layer int, host string, path string, verdict string")
    pages = spark.createDataFrame([("http://a.org/x",), ("http://b.org",)], "url string")
    assert sorted(r.verdict for r in judged(pages, rules).collect()) == ["allow", "block"]
    assert [r.verdict for r in judged(pages, rules.limit(0), default="block").collect()] == ["block"] * 2
    assert judged(pages.limit(0), rules).collect() == []


def test_large_rule_sets_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = judged(spark.createDataFrame([("http://a.example.org/en/12",)], "url string"), rule_table(spark, RULES))
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert [(r.rule, r.verdict) for r in out.collect()] == [("example.org/en/1", "block")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
