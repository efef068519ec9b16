"""Host and path rules on urls by a sort-merge range join.

A key is a host's labels from the last one on, then `?`, then the path; neither part can hold a `?`. All keys that a
rule fits start with the rule's own key, so a rule is an interval of sorted keys, and intervals are nested or apart. A
rule also fits subdomains, so a url has one key for each number of leading labels that a rule may have. Urls and rules
are dealt by splitters of the key, a rule to every part that its interval reaches; in each part a sweep in key order
keeps the stack of rules that are open, the top of which is the longest rule of the key.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import bounded_sample, shuffle_parts, stage, table

#: Keys of the sample from which splitters are taken, for each part and at most; it only decides how even parts are.
SAMPLED, MOST_SAMPLED = 64, 50_000
#: Splitters are cut to this many characters, which again gives a splitter.
SPLITTER_CHARS = 200
SWEPT = "row long, page_id long, host string, path string, length long, level int, rule string, verdict string"


def host_and_path(url) -> tuple:
    """Columns host (A-Z lower-cased) and path of a column of urls; both empty without a `://`."""
    at = F.expr("locate('://', url)")
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host):
    return F.reverse(F.split(host, r"\."))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Urls with the longest open rule of their key; rows come by part and key, rules before urls."""
    part, stack = None, []
    for batch in batches:
        out = []
        for p, key, is_url, row, page_id, host, path, level, rule, verdict in zip(
            *(batch[c].tolist() for c in ("part", "key", "is_url", "row", "page_id", "host", "path", "level", "rule", "verdict")),
            strict=True,
        ):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, len(rule), rule, verdict))
            elif stack:
                out.append((row, page_id, host, path, stack[-1][1], level, *stack[-1][2:]))
            elif level == 1:
                out.append((row, page_id, host, path, None, level, None, None))
        found = pd.DataFrame(out, columns=["row", "page_id", "host", "path", "length", "level", "rule", "verdict"])
        yield found.astype({"page_id": "Int64", "length": "Int64"})


def dealt(urls: DataFrame, rules: DataFrame, parts: int) -> DataFrame:
    """Keys of `urls` (row, page_id, host, path) and of `rules` (key, rule, verdict, level) with the part of each.

    A rule is repeated for every part that its interval reaches: once, and once more for each splitter inside of it.
    """
    depth = rules.agg(F.max("level").alias("level")).first().level or 1
    labels = _labels(F.col("host"))
    keys = urls.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(labels)))).alias("level")).select(
        F.concat(F.array_join(F.slice(labels, 1, F.col("level")), "."), F.lit("?"), "path").alias("key"),
        F.xxhash64("row", F.lit("salt")).alias("salt"), "row", "level",  # not the hash that draws the sample
        *(F.when(F.col("level") == 1, F.col(c)).alias(c) for c in ("page_id", "host", "path")),
    )
    sample = keys.select(F.substring("key", 1, SPLITTER_CHARS).alias("key"), "salt", "row", "level")
    found = sorted((r.key, r.salt) for r in bounded_sample(sample, "row", min(SAMPLED * parts, MOST_SAMPLED)).collect())
    splitters = [found[len(found) * i // parts] for i in range(1, parts)] if found else []

    @F.pandas_udf("int")
    def part_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(splitters, pair) for pair in zip(key, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        heads = [k for k, _ in splitters]
        return pd.Series([
            list(range(bisect_left(heads, k), bisect_right([h[: len(k)] for h in heads], k) + 1)) for k in key
        ])

    nothing = {c: F.lit(None).cast(t) for c, t in (("page_id", "long"), ("host", "string"), ("path", "string"))}
    return keys.select(
        part_of("key", "salt").alias("part"), "key", F.lit(True).alias("is_url"), "row", "page_id", "host", "path", "level",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    ).unionByName(rules.select(
        F.explode(parts_of("key")).alias("part"), "key", F.lit(False).alias("is_url"), F.lit(0).cast("long").alias("row"),
        "level", "rule", "verdict",
    ).withColumns(nothing))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages`.

    `pages` has page_id and url, `rules` has host, path and verdict; further columns are ignored. A rule fits its host
    and all subdomains where the path starts with the rule's. The rule with the most characters wins, of equally long
    ones that with more labels, of equal ones `block`. Rules without host or verdict are left out, a null path is
    empty. A url without a rule has the verdict `default`; so has a null url and one without `://`, whose host and
    path are empty. Rows without an id and repeated rows are judged one by one. An empty table gives no rows, no rules
    give `default`. Urls of any length are read whole. Equal urls are spread over parts by their row.
    """
    spark = pages.sparkSession
    parts = shuffle_parts(spark)
    kept = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).distinct().select(
        F.concat(F.array_join(_labels(F.col("host")), "."), F.lit("?"), "path").alias("key"),
        F.concat("host", "path").alias("rule"), "verdict", F.size(_labels(F.col("host"))).alias("level"),
    )
    host, path = host_and_path(F.col("url"))
    urls = stage(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"), path.alias("path"),
    ), "urls")
    swept = dealt(urls, kept, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "is_url", "verdict")
    best = swept.mapInPandas(_sweep, SWEPT).groupBy("row").agg(
        F.max(F.when(F.col("level") == 1, F.struct("page_id", "host", "path"))).alias("page"),
        F.max(F.when(F.col("rule").isNotNull(), F.struct("length", "level", "verdict", "rule"))).alias("best"),
    )
    return best.select("page.page_id", "page.host", "page.path", "best.rule",
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query: host, path, verdict.
OP11_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    rules = spark.createDataFrame(OP11_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP11_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, OP11_RULES))}),
rests AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT any_value(u.page_id) AS page_id, any_value(u.host) AS host, any_value(u.path) AS path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
GROUP BY n
"""
