"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Only DataFrame functions are used. Each source's target is met by whole passes over the source and, for the
rest, by blocks of equally many words. The blocks go to the sources by highest quotients, then in the same way
to the shards of each source, so that every shard has an integer quota. A shard chooses its blocks from a seeded
starting point in a seeded order of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import stage, table, text_tag

WORDS = r"[^\x20\x09-\x0D]+"


def apportion(shares: DataFrame, group: list[str], unit: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Laguë: `shares` with a column `quota`, which adds up to `seats` in each group.

    `seats` must be equal within a group. Seats that any divisor near the fair one would give are given at once:
    at weight * (seats - n/2) / total the rounded numbers add up to `seats` at most, at (seats + n/2) to at least
    as many. Only the at most four quotients for each unit in between are ranked. Ties go to the smaller unit.
    A group without weight gets no seat.
    """
    by = Window.partitionBy(*group)
    fair = F.try_divide(F.col(weight), F.sum(weight).over(by))
    half = F.count(F.lit(1)).over(by) / 2
    known = shares.withColumns(
        {
            "_low": F.coalesce(F.greatest(F.floor(fair * (F.col(seats) - half) + 0.5) - 1, F.lit(0)), F.lit(0)),
            "_high": F.coalesce(F.floor(fair * (F.col(seats) + half) + 0.5) + 1, F.lit(0)),
        }
    ).withColumn("_open", F.col(seats) - F.sum("_low").over(by))
    quotients = (
        known.where(f"{weight} > 0 AND _high > _low")
        .select(*group, unit, weight, "_open", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
        .withColumn("_rank", F.row_number().over(by.orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), unit)))
        .where("_rank <= _open")
        .groupBy(*group, unit)
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    same = None
    for name in (*group, unit):
        equal = F.col(f"k.{name}").eqNullSafe(F.col(f"q.{name}"))
        same = equal if same is None else same & equal
    return (
        known.alias("k")
        .join(quotients.alias("q"), same, "left")
        .select(
            *[f"k.{c}" for c in shares.columns],
            (F.col("k._low") + F.coalesce(F.col("q._more"), F.lit(0))).cast("long").alias("quota"),
        )
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeat_cap: int) -> DataFrame:
    """source, rows, source_size, target: the sum of all sizes shared by weight, no source above its cap.

    One row for each source is ranked in a single task; sources are few against documents. Sorted by cap over
    weight, a source is capped until the level that the rest would get no longer exceeds its cap.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(every.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"rank": rank, "weight": weight.cast("long")})
    up = every.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    cap = repeat_cap * F.col("source_size")
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumns({"cap": cap, "pos": F.row_number().over(up), "level": left / weight_left})
    open_level = F.min_by(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")),
                          F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("pos"))).over(every)
    target = F.least(F.col("cap").cast("double"), open_level * F.col("weight"))
    return ranked.select("source", "rows", "source_size", target.alias("target"))


def _overlap(start: Column, end: Column) -> Column:
    """Words of a document's place [at, at + size) inside [start, end)."""
    return F.greatest(F.least(F.col("at") + F.col("size"), end) - F.greatest(F.col("at"), start), F.lit(0))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeat_cap: int = 3, block: int = 16,
    shard_rows: int = 2_000, seed: str = "mix-1",
) -> DataFrame:
    """One row per document: doc_id, tag (the text's hash), source, size, source_size, target, taken (words, repeats
    counted).

    A document's size is its number of words; null text has none. Sources are ordered by code point, null last,
    and weighed by `weights` in turn; a null source is a source. A source of target t and size s gives floor(t / s)
    passes and floor-or-ceiling blocks of `block` words for the rest. A hot source has more shards, of about
    `shard_rows` documents each, so that no window holds more. Rows with equal doc_id are told apart by size;
    fully equal rows may swap their results. Empty tables give no rows; other columns are ignored.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = stage(
        docs.select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            key.alias("draw"), text_tag().alias("tag"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, repeat_cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", whole.cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    every = Window.partitionBy(F.lit(0))
    targets = targets.withColumn("rest", F.greatest(rest, F.lit(0.0)))
    targets = targets.withColumn("blocks", F.round(F.sum("rest").over(every) / block).cast("long"))
    targets = apportion(targets.withColumn("mix", F.lit(0)), ["mix"], "source", "rest", "blocks")
    targets = targets.select(
        F.col("source").alias("t_source"), "source_size", "target", "passes", F.col("quota").alias("source_quota"),
        F.ceil(F.col("rows") / shard_rows).cast("long").alias("shards"),
    )
    placed = sizes.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    placed = placed.withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("shards"))
    in_shard = Window.partitionBy("source", "shard")
    order = in_shard.orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.sum("size").over(order) - F.col("size"))
    shards = placed.groupBy(F.col("source").alias("s_source"), F.col("shard").alias("s_shard")).agg(
        F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota")
    )
    shards = apportion(shards, ["s_source"], "s_shard", "shard_size", "source_quota")
    n_blocks = F.ceil(F.col("shard_size") / block)
    pick = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("s_source", F.lit("")), "s_shard").cast("binary"))
    pick = F.conv(F.substring(pick, 1, 8), 16, 10).cast("long")
    shards = shards.select(
        "s_source", "s_shard", "shard_size", F.least("quota", n_blocks).alias("quota"), n_blocks.alias("n_blocks"),
        F.when(n_blocks > 0, pick % n_blocks).otherwise(0).alias("first"),
    )
    mixed = placed.join(
        shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard"))
    )
    end = F.col("first") + F.col("quota")
    taken = (
        F.col("passes") * F.col("size")
        + _overlap(F.col("first") * block, F.least(end * block, F.col("shard_size")))
        + _overlap(F.lit(0), F.greatest(end - F.col("n_blocks"), F.lit(0)) * block)
    )
    return mixed.select("doc_id", "tag", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "tag")


def mixed_documents(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: taken / size times, rounded up or down by a seeded draw,
    so that the words taken from a source keep near its target. Documents that the mix leaves out go, among them all
    without words; repeats are equal rows."""
    part = F.md5(F.concat(F.lit(seed + ":copies:"), F.coalesce(F.col("m_id").cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(part, 1, 8), 16, 10).cast("double") / float(1 << 32)
    taken = mix_sources(docs, seed=seed).select(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag"), "size", "taken")
    taken = taken.where("taken > 0").withColumn("copies", F.floor(F.col("taken") / F.col("size") + draw).cast("int"))
    taken = taken.where("copies > 0").groupBy("m_id", "m_tag").agg(F.max("copies").alias("copies"))  # of repeated rows
    tagged = docs.select(F.struct("*").alias("own"), F.col("doc_id").alias("own_id"), text_tag().alias("own_tag"))
    same = F.col("own_id").eqNullSafe(F.col("m_id")) & (F.col("own_tag") == F.col("m_tag"))
    return tagged.join(taken, same).select("own", F.explode(F.sequence(F.lit(1), "copies"))).select("own.*")


def _apportioned(shares: str, group: str, unit: str, weight: str, seats: str) -> str:
    return f"""(
  WITH known AS (
    SELECT *, coalesce(greatest(floor({weight} / sum({weight}) OVER g * ({seats} - count(*) OVER g / 2.0) + 0.5) - 1, 0), 0)::BIGINT AS lo,
      coalesce(floor({weight} / sum({weight}) OVER g * ({seats} + count(*) OVER g / 2.0) + 0.5) + 1, 0)::BIGINT AS hi
    FROM {shares} WINDOW g AS (PARTITION BY {group})),
  quotients AS (
    SELECT {group}, {unit}, row_number() OVER (PARTITION BY {group} ORDER BY {weight} / (2 * k + 1) DESC, {unit} NULLS FIRST) AS r, open_seats
    FROM (SELECT *, {seats} - sum(lo) OVER (PARTITION BY {group}) AS open_seats FROM known),
      LATERAL (SELECT unnest(range(lo, hi)) AS k) WHERE {weight} > 0),
  more AS (SELECT {group}, {unit}, count(*) AS n FROM quotients WHERE r <= open_seats GROUP BY ALL)
  SELECT known.*, (lo + coalesce(n, 0))::BIGINT AS quota FROM known LEFT JOIN more
    ON known.{group} IS NOT DISTINCT FROM more.{group} AND known.{unit} IS NOT DISTINCT FROM more.{unit})"""


OP8_SQL = f"""
WITH sizes AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
totals AS (SELECT source, count(*) AS n_rows, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
levels AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER up AS pos,
    ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::BIGINT)::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS level
  FROM weighed WINDOW up AS (ORDER BY source_size::DOUBLE / weight, rank),
    before AS (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open_level AS (SELECT level FROM levels WHERE cap >= level * weight ORDER BY pos LIMIT 1),
targets AS (SELECT source, n_rows, source_size, least(cap::DOUBLE, (SELECT level FROM open_level) * weight) AS target FROM levels),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM targets),
shares AS (SELECT *, 0 AS mix, greatest(target - passes * source_size, 0.0)::DOUBLE AS rest FROM rests),
seats AS (SELECT *, round(sum(rest) OVER () / 16)::BIGINT AS blocks FROM shares),
quotas AS {_apportioned("seats", "mix", "source", "rest", "blocks")},
placed AS MATERIALIZED (
  SELECT s.*, source_size, target, passes, quota AS source_quota,
    ('0x' || substr(draw, 1, 8))::BIGINT % ceil(n_rows / 2000.0)::BIGINT AS shard
  FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
at_places AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id NULLS FIRST, size
  ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS at_word FROM placed),
shard_sizes AS (SELECT source, shard, sum(size)::DOUBLE AS shard_size, any_value(source_quota) AS source_quota FROM placed GROUP BY ALL),
shard_quotas AS (SELECT * EXCLUDE (quota), ceil(shard_size / 16)::BIGINT AS n_blocks, least(quota, ceil(shard_size / 16)::BIGINT) AS quota
  FROM {_apportioned("shard_sizes", "source", "shard", "shard_size", "source_quota")}),
picked AS (SELECT *, CASE WHEN n_blocks > 0
  THEN ('0x' || substr(md5('mix-1:' || coalesce(source, '') || ':' || shard), 1, 8))::BIGINT % n_blocks ELSE 0 END AS first_block FROM shard_quotas)
SELECT a.doc_id, a.size, a.source_size, a.target, (passes * size
  + greatest(least(at_word + size, (first_block + quota) * 16, shard_size::BIGINT) - greatest(at_word, first_block * 16), 0)
  + greatest(least(at_word + size, greatest(first_block + quota - n_blocks, 0) * 16) - at_word, 0))::BIGINT AS taken
FROM at_places a JOIN picked p ON a.source IS NOT DISTINCT FROM p.source AND a.shard = p.shard
"""
