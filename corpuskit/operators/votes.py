"""Preference tests between two clips: valid votes, one per listener, tallies, render grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import strip

NO_DIFF = "no_diff"


def valid_votes(votes: DataFrame, tests: DataFrame, options: DataFrame) -> DataFrame:
    """Votes on published tests whose choice is an option of the test or ``no_diff``."""
    published = tests.filter("published").select(F.col("id").alias("ab_test_id"))
    choices = options.select("ab_test_id", F.col("key").alias("choice")).join(published, "ab_test_id", "left_semi")
    none = published.select("ab_test_id", F.lit(NO_DIFF).alias("choice"))
    return votes.join(choices.unionByName(none), ["ab_test_id", "choice"], "left_semi").select(*votes.columns)


def upsert_votes(current: DataFrame, new: DataFrame) -> DataFrame:
    """One vote per (test, user): the last choice, the first time.

    Both inputs: ab_test_id, user_id, choice, created_at, voted_at, id. Ties on time go to the higher
    id. Applying the same votes again changes nothing.
    """
    key = ["ab_test_id", "user_id"]
    rows = current.unionByName(new)
    last = F.max_by(F.struct("choice", "voted_at", "id"), F.struct("voted_at", "id")).alias("last")
    return rows.groupBy(*key).agg(F.min("created_at").alias("created_at"), last).select(
        *key, F.col("last.choice").alias("choice"), "created_at",
        F.col("last.voted_at").alias("voted_at"), F.col("last.id").alias("id"),
    )


def vote_tally(tests: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes per test for A, B and no_diff; the total counts every choice. Newest test first."""
    counts = votes.groupBy(F.col("ab_test_id").alias("id")).agg(
        *(F.count_if(F.col("choice") == c).alias(f"n_{c}") for c in ("A", "B", NO_DIFF)),
        F.count(F.lit(1)).alias("total"),
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_A", "n_B", f"n_{NO_DIFF}", "total")]
    return tests.join(counts, "id", "left").select(
        F.col("id").alias("test_id"), "title", "published", "created_at", *filled
    ).orderBy(F.desc("created_at"), F.desc("test_id"))


def vote_share(tally: DataFrame) -> DataFrame:
    """Whole percentages of the total, halves up; null without votes."""

    def share(name: str) -> Column:
        return F.when(F.col("total") > 0, F.floor(F.col(name) / F.col("total") * 100 + 0.5))

    return tally.withColumns(
        {"pct_a": share("n_A"), "pct_b": share("n_B"), "pct_no_diff": share(f"n_{NO_DIFF}")}
    )


def tests_for_user(tests: DataFrame, options: DataFrame, votes: DataFrame, users: DataFrame) -> DataFrame:
    """Published tests with their options and the user's own vote, a row per (user, test, option).

    ``votes`` holds one row per (test, user); ``users`` lists the pairs to show (user_id, ab_test_id).
    Labels stay hidden until the user has voted; whether a clip exists is told by ``has_clip``.
    """
    open_tests = tests.filter("published").select(F.col("id").alias("ab_test_id"), "title", "created_at")
    mine = votes.select("user_id", "ab_test_id", F.col("choice").alias("my_vote"))
    return (
        users.join(open_tests, "ab_test_id")
        .join(mine, ["user_id", "ab_test_id"], "left")
        .join(options.drop("id"), "ab_test_id")
        .select(
            "user_id", "ab_test_id", "title", "created_at", "opt_order", "key",
            F.when(F.col("my_vote").isNotNull(), F.col("label")).alias("label"),
            F.col("audio_key").isNotNull().alias("has_clip"),
            "my_vote",
            F.coalesce(F.col("my_vote") == F.col("key"), F.lit(False)).alias("picked"),
        )
    )


def _listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def render_grid(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Voices times presets times takes of each request (id, voices, presets, takes, provider).

    A request that names a preset which the table ``presets`` (key) does not have is refused as a whole. The cells
    of a request come from its own lists, so no two tables are multiplied.
    """
    wanted = requests.withColumns({"_voices": _listed(F.col("voices")), "_presets": _listed(F.col("presets"))})
    named = wanted.select("id", F.explode("_presets").alias("key"))
    refused = named.join(presets.select("key"), "key", "left_anti").select("id").distinct()
    fine = wanted.join(refused, "id", "left_anti")
    cells = (
        fine.select("id", "provider", "takes", "_presets", F.explode("_voices").alias("voice"))
        .select("id", "provider", "takes", "voice", F.explode("_presets").alias("preset"))
        .select("id", "provider", "voice", "preset", F.explode(F.sequence(F.lit(1), F.col("takes"))).alias("take"))
    )
    name = F.concat_ws("__", "voice", "preset")
    suffix = F.when(F.col("take") > 1, F.concat(F.lit("__take"), F.col("take").cast("string"))).otherwise("")
    ext = F.when(F.col("provider") == "gemini", ".wav").otherwise(".mp3")
    return cells.select(
        "id", "provider", name.alias("name"), F.concat_ws(" / ", "voice", "preset").alias("label"), "take",
        F.concat(name, suffix, ext).alias("filename"),
    )


def blind_order(cells: DataFrame, seed: int) -> DataFrame:
    """A repeatable shuffle of each request's cells, lettered A, B, C, ... then AA, AB, ...

    A request's cells are bounded by its own lists (see ``render_grid``), so they are sorted together
    in one array per request.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), "filename").cast("binary"))
    drawn = F.struct(draw.alias("draw"), "filename", "label")
    shuffled = F.array_sort(F.collect_list(drawn)).alias("cells")

    def letter(i: Column) -> Column:
        low = F.char(F.lit(65) + i % 26)
        return F.when(i < 26, low).otherwise(F.concat(F.char(F.lit(64) + F.floor(i / 26)), low))

    return cells.groupBy("id").agg(shuffled).select("id", F.posexplode("cells").alias("pos", "cell")).select(
        "id", "pos", letter(F.col("pos")).alias("letter"), F.col("cell.filename").alias("filename"),
        F.col("cell.label").alias("label"),
    )


def grid_outcome(cells: DataFrame, results: DataFrame, keyed_providers: tuple[str, ...]) -> DataFrame:
    """Cells with their result: ok unless an error came back, no result came, or the provider has no key."""
    done = results.select("id", "filename", "error", F.lit(True).alias("_came"))
    has_key = F.col("provider").isin(*keyed_providers)
    ok = has_key & F.coalesce("_came", F.lit(False)) & F.col("error").isNull()
    return cells.join(done, ["id", "filename"], "left").select(
        "id", "provider", "filename", "error", has_key.alias("has_key"), ok.alias("ok")
    )


def grid_summary(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("provider").agg(
        F.count(F.lit(1)).alias("clips"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.bool_and("has_key").alias("has_key"),
    )


def delete_tests(tests: DataFrame, options: DataFrame, votes: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The three tables without the tests in ``ids`` (column ab_test_id), and the clip keys to remove."""
    return {
        "ab_tests": tests.join(ids.withColumnRenamed("ab_test_id", "id"), "id", "left_anti"),
        "ab_options": options.join(ids, "ab_test_id", "left_anti"),
        "ab_votes": votes.join(ids, "ab_test_id", "left_anti"),
        "keys": options.join(ids, "ab_test_id", "left_semi").filter(F.col("audio_key").isNotNull()).select("audio_key"),
    }


def create_tests(defs: DataFrame) -> dict[str, DataFrame]:
    """One definition (id, title, description, label_a, label_b, published) → a test and options A, B."""
    option = F.inline(
        F.array(
            F.struct(F.lit("A").alias("key"), F.col("label_a").alias("label"), F.lit(0).alias("opt_order")),
            F.struct(F.lit("B").alias("key"), F.col("label_b").alias("label"), F.lit(1).alias("opt_order")),
        )
    )
    options = defs.select(F.col("id").alias("ab_test_id"), option).withColumn(
        "id", F.col("ab_test_id") * 2 + F.col("opt_order")
    )
    return {
        "ab_tests": defs.select("id", "title", "description", "published"),
        "ab_options": options.select(
            "id", "ab_test_id", "key", "label",
            F.concat(F.lit("ab_tests/"), F.col("id").cast("string"), F.lit(".mp3")).alias("audio_key"),
            "opt_order",
        ),
    }
