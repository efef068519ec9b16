"""Rules on urls against a direct reading of each rule, with nested, equal and unrelated rules and hot urls."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from corpuskit.llm import url_rules

HOSTS = ["", "net", "a.net", "b.a.net", "network", "a..net", "net.", "x.A.net", "org", "q.org"]
PATHS = ["", "/", "/en", "/en/", "/en/x", "/fr/1", "/de/"]
RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
    fit = [
        (len(h + p), h.count("."), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else default


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(3)
    found = [None, "", "a.net/en/", "://", "x://", "http://" + "a." * 3000 + "net/" + "p" * 500_000, "http://b.a.net/en/\n/?x"]
    found += [
        f"http://{rng.choice(HOSTS)}{rng.choice(PATHS)}{rng.choice(['', '?a=/en/', '#x', '://y'])}" for _ in range(2000)
    ]
    return [(i if i % 7 else None, u) for i, u in enumerate([*found, *["http://a.net/en/x"] * 2000])]


def table_of(spark, urls):
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(5)
    return df.withColumns({n: F.lit("extra") for n in ("host", "path", "row", "key", "part", "rule", "level", "verdict")})


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules(spark, urls, seed):
    rng = random.Random(seed)
    rules = [(rng.choice(HOSTS).lower(), rng.choice(PATHS), rng.choice(["block", "allow"])) for _ in range(25)]
    got = url_rules.judge_urls(table_of(spark, urls), spark.createDataFrame([*rules, (None, "/", "block"), ("net", "/", None)], RULES))
    want = [(i, *brute(u, rules)) for i, u in urls]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_many_rules(spark, urls):
    rng = random.Random(4)
    rules = list({(f"{rng.choice('abc')}.net", "/" + "".join(rng.choices("ab", k=rng.randint(0, 9)))): 0 for _ in range(2000)})
    rules = [(h, p, rng.choice(["block", "allow"])) for h, p in rules]
    asked = [(i, f"http://{rng.choice('abcd')}.{rng.choice('abc')}.net/{''.join(rng.choices('ab', k=12))}") for i in range(1000)]
    got = url_rules.judge_urls(table_of(spark, asked), spark.createDataFrame(rules, RULES), "block")
    assert sorted(map(tuple, got.collect())) == sorted((i, *brute(u, rules, "block")) for i, u in asked)


def test_nothing(spark, urls):
    empty = spark.createDataFrame([], RULES)
    got = url_rules.judge_urls(table_of(spark, urls), empty).collect()
    assert len(got) == len(urls) and all(r.rule is None and r.verdict == "allow" for r in got)
    assert url_rules.judge_urls(table_of(spark, urls).limit(0), empty).count() == 0


def test_equal_urls_are_spread(spark):
    """One url holds all of 60,000 rows; its rows are dealt evenly, its rules go to every part."""
    urls = spark.range(60_000).selectExpr("id AS row", "id AS page_id", "'a.net' AS host", "'/en/x' AS path")
    rules = spark.createDataFrame([("net?/", "net/", "block", 1)], "key string, rule string, verdict string, level int")
    got = url_rules.dealt(urls, rules, 8).groupBy("part").agg(
        F.count_if("is_url").alias("urls"), F.count_if(~F.col("is_url")).alias("rules")).collect()
    assert len(got) == 8 and all(r.rules == 1 and 5_000 < r.urls < 10_000 for r in got)
