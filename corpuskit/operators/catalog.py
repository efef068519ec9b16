"""The library: status counts, progress, narrations, search, playback positions, edits.

Columns are named as in ``corpuskit.schemas``. Per-book facts are aggregated before any join, so a
book with very many segments is combined on the map side and joins see one row per book. No join
carries a broadcast hint: Catalyst broadcasts a side by its measured size and AQE splits skewed ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import none_if_empty, strip
from ..schemas import BOOK_STATUSES
from .ranking import number_in_group

UNCATEGORIZED = "Uncategorized"
EXCERPT_CHARS = 600
PATCHABLE = ("title", "author", "genre", "year", "notes", "tts_narrator", "tts_instructions", "hidden")


def status_summary(books: DataFrame, statuses: Sequence[str] = BOOK_STATUSES) -> DataFrame:
    """Books per status; known statuses appear with zero, unknown ones and null are kept, plus a total row."""
    spark = books.sparkSession
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, statuses))).alias("status"))
    counts = books.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    full = known.join(counts, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    summed = full.rollup("status").agg(F.sum("n").alias("n"), F.grouping("status").alias("is_total"))
    return summed.select(F.when(F.col("is_total") == 1, "total").otherwise(F.col("status")).alias("status"), "n")


def segment_progress(segments: DataFrame) -> DataFrame:
    """Per book: segments in all, ready, in error."""
    return segments.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "error").alias("error"),
    )


def _with_progress(books: DataFrame, segments: DataFrame) -> DataFrame:
    """Books with total, ready and error counts, zero for books without segments."""
    seg = segment_progress(segments).withColumnRenamed("book_id", "id")
    zero = {name: F.coalesce(F.col(name), F.lit(0)) for name in ("total", "ready", "error")}
    return books.join(seg, "id", "left").withColumns(zero)


def admin_books(books: DataFrame, users: DataFrame, segments: DataFrame) -> DataFrame:
    """Every book with owner and segment counts, without any text, newest first (then id).

    Books without an owner get a join key of their own that no user has, so that they do not all
    meet in one partition.
    """
    owners = users.select(F.col("id").alias("_owner"), F.col("email").alias("owner_email"))
    owner_key = F.coalesce("uploaded_by", -F.col("id") - 1)
    table = books.select(
        "id", "title", "author", "status", "genre", "year", "hidden", "page_count", "created_at", "uploaded_by"
    )
    return (
        _with_progress(table, segments)
        .withColumn("_owner", owner_key)
        .join(owners, "_owner", "left")
        .select(
            "id", "title", "author", "status", "genre", "year", "hidden", "page_count", "created_at",
            "owner_email",
            F.col("total").alias("segments_total"),
            F.col("ready").alias("segments_ready"),
            F.col("error").alias("segments_error"),
        )
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def visible_books(books: DataFrame, is_admin: bool = False) -> DataFrame:
    """Hidden books are for admins only; newest first."""
    shown = books if is_admin else books.filter(~F.col("hidden"))
    return shown.orderBy(F.desc("created_at"), F.desc("id"))


def _genre() -> Column:
    return F.coalesce(none_if_empty(F.col("genre")), F.lit(UNCATEGORIZED))


def search_books(books: DataFrame, genre: str | None = None, query: str = "") -> DataFrame:
    """Genre by equality, then a trimmed lower-case substring of title or author (no wildcards)."""
    if genre:
        books = books.filter(_genre() == genre)
    needle = query.strip().lower()
    if needle:
        in_author = F.coalesce(F.lower("author").contains(needle), F.lit(False))
        books = books.filter(F.lower("title").contains(needle) | in_author)
    return books


def genre_facets(books: DataFrame) -> DataFrame:
    """Books per genre, and ``All``; sorted by name with ``All`` first."""
    counts = books.select(_genre().alias("genre")).rollup("genre").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("genre").alias("is_all")
    )
    return counts.select(
        F.when(F.col("is_all") == 1, "All").otherwise(F.col("genre")).alias("genre"), "n", "is_all"
    ).orderBy(F.desc("is_all"), "genre").drop("is_all")


def sort_books(table: DataFrame, key: str, direction: str = "asc") -> DataFrame:
    """Sort an ``admin_books`` table: text without case, progress as a fraction, nulls lowest."""
    if key == "progress":
        value = F.when(
            F.col("segments_total") > 0, F.col("segments_ready") / F.col("segments_total")
        ).otherwise(F.lit(-1.0))
    elif table.schema[key].dataType.simpleString() == "string":
        value = F.lower(key)
    else:
        value = F.col(key)
    ordered = value.asc_nulls_first() if direction == "asc" else value.desc_nulls_last()
    return table.orderBy(ordered, "id")


def alt_ready_counts(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """Ready takes per book and narrator. Narrator is counted per book after a partial count.

    Takes pass a table of their partition's segment ids, two numbers each, and are not sorted.
    """
    ready = takes.filter(F.col("status") == "ready").select("segment_id", "narrator")
    owner = segments.select(F.col("id").alias("segment_id"), "book_id").hint("shuffle_hash")
    return ready.join(owner, "segment_id").groupBy("book_id", "narrator").agg(F.count(F.lit(1)).alias("n"))


def resolve_narrator(books: DataFrame, registry: DataFrame, default: str) -> DataFrame:
    """Add the preset a book is read with: unknown or missing keys take the default's."""
    preset = F.struct("key", "provider", "label", "voice")
    fallback = registry.filter(F.col("key") == default).select(preset).scalar()
    own = registry.select(F.concat(F.lit("k"), "key").alias("_voice"), preset.alias("own"))
    # books without a narrator get join keys of their own, so that they do not meet in one partition
    wanted = F.coalesce(F.concat(F.lit("k"), "tts_narrator"), F.concat(F.lit("b"), F.col("id").cast("string")))
    joined = books.withColumn("_voice", wanted).join(own, "_voice", "left")
    chosen = F.coalesce(F.col("own"), fallback)
    return joined.withColumn("chosen", chosen).select(
        *books.columns,
        F.col("chosen.key").alias("preset"),
        F.coalesce("chosen.provider", F.lit("openai")).alias("provider"),
        F.col("chosen.label").alias("label"),
        F.col("chosen.voice").alias("voice"),
        none_if_empty(F.col("tts_instructions")).alias("instructions_override"),
    )


def narrations(
    books: DataFrame, segments: DataFrame, takes: DataFrame, registry: DataFrame, default: str
) -> DataFrame:
    """The voices of each book. ``pos`` sorts them: 0 the primary, then registry order.

    The primary shows its raw key even if the registry does not know it. Alternates count against
    the ready base segments and appear only with at least one ready take.
    """
    primary_key = F.coalesce(none_if_empty(F.col("tts_narrator")), F.lit(default))
    heard = _voices_heard(segments, takes).withColumnRenamed("book_id", "id")
    base = books.select("id", primary_key.alias("primary_key")).join(heard, "id", "left").select(
        "id", "primary_key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "base_ready")), "voices"
    )
    voice = "struct<narrator: string, primary: boolean, n: bigint>"
    own = F.array(F.struct(F.col("primary_key").alias("narrator"), F.lit(True), F.col("base_ready").alias("n"))).cast(f"array<{voice}>")
    others = F.transform(
        F.filter(F.coalesce("voices", F.array()), lambda x: x["narrator"] != F.col("primary_key")),
        lambda x: F.struct(x["narrator"], F.lit(False), F.least(x["n"], F.col("base_ready"))).cast(voice),
    )
    rows = base.select("id", "total", "base_ready", F.explode(F.concat(own, others)).alias("v"))
    named = registry.select(F.col("key"), F.struct("pos", "label", "voice").alias("preset"))
    fallback = registry.filter(F.col("key") == default).select(F.struct("pos", "label", "voice")).scalar()
    rows = rows.join(named, F.col("v.narrator") == F.col("key"), "left").filter("v.primary OR preset IS NOT NULL")
    shown = F.when(F.col("v.primary"), F.coalesce("preset", fallback)).otherwise(F.col("preset"))
    of = F.when(F.col("v.primary"), F.col("total")).otherwise(F.col("base_ready"))
    return rows.withColumns({"shown": shown, "of": of}).select(
        F.col("id").alias("book_id"),
        F.when(F.col("v.primary"), 0).otherwise(F.col("shown.pos") + 1).alias("pos"),
        F.col("v.narrator").alias("narrator"), "shown.label", "shown.voice", F.col("v.primary").alias("primary"),
        ((F.col("of") > 0) & (F.col("v.n") >= F.col("of"))).alias("ready"),
        F.col("v.n").alias("segments_ready"), F.col("of").alias("segments_total"),
    )


def _voices_heard(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """Per book: total, base_ready, voices ARRAY<STRUCT<narrator, n>>.

    Segments are counted by themselves, and takes as in ``alt_ready_counts``: only ids pass the join, and counting by
    book and narrator comes before collecting by book, so that a book with very many segments is combined on the map side.
    """
    counts = segments.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("base_ready")
    )
    heard = alt_ready_counts(segments, takes.filter(F.col("narrator").isNotNull()))
    voices = heard.groupBy("book_id").agg(F.collect_list(F.struct("narrator", "n")).alias("voices"))
    return counts.join(voices, "book_id", "left")


def library_list(
    books: DataFrame, segments: DataFrame, takes: DataFrame, registry: DataFrame, default: str, is_admin: bool = False
) -> DataFrame:
    """Visible books, newest first, with their voices in order: ARRAY<STRUCT<pos, narrator, label, primary, ready>>."""
    voices = narrations(books, segments, takes, registry, default).groupBy(F.col("book_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "narrator", "label", "primary", "ready"))).alias("voices")
    )
    shown = books if is_admin else books.filter(~F.col("hidden"))
    listed = shown.select("id", "title", "author", "status", "genre", "created_at")
    return visible_books(listed.join(voices, "id", "left"), is_admin=True)


def resolve_take(segments: DataFrame, takes: DataFrame, narrator: str | None) -> DataFrame:
    """The clip to play per segment: a ready take of the narrator with a path, else the primary one."""
    ready = takes.filter((F.col("status") == "ready") & (F.col("narrator") == F.lit(narrator))).select(
        F.col("segment_id"), none_if_empty(F.col("audio_path")).alias("take_path")
    )
    own = segments.select(F.col("id").alias("segment_id"), "audio_path")
    return own.join(ready, "segment_id", "left").select(
        "segment_id", F.coalesce("take_path", "audio_path").alias("path")
    )


def card_state(books: DataFrame, segments: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """What a book's card shows. ``progress`` (book_id, fraction) turns Play into Resume."""
    cards = _with_progress(books.select("id", "status"), segments)
    if progress is None:
        cards = cards.withColumn("fraction", F.lit(0.0))
    else:
        cards = cards.join(progress.withColumnRenamed("book_id", "id"), "id", "left")
    status = F.col("status")
    playable = (status == "complete") | ((status == "synthesizing") & (F.col("ready") > 0))
    working = status.isin("pending", "processing")
    heard = F.when(playable, F.coalesce("fraction", F.lit(0.0))).otherwise(F.lit(0.0))
    started = (heard > 0.01) & (heard < 0.995)
    return cards.select(
        F.col("id").alias("book_id"),
        "ready",
        F.col("error").alias("failed"),
        F.when(F.col("total") > 0, F.col("ready") / F.col("total")).otherwise(F.lit(0.0)).alias("progress"),
        playable.alias("playable"),
        ((status == "synthesizing") & (F.col("error") > 0)).alias("stuck"),
        working.alias("working"),
        (working | (status == "synthesizing")).alias("busy"),
        F.when(started, "Resume").otherwise("Play").alias("action"),
    )


def first_segment_excerpt(segments: DataFrame, n: int = EXCERPT_CHARS) -> DataFrame:
    """The opening of each book: its lowest-order segment, first ``n`` characters.

    The lowest order is found without texts. Texts then pass a table of their partition's books, so only the openings,
    not all segments, are held and sorted; a hot book is split by the join.
    """
    first = segments.groupBy("book_id").agg(F.min("seg_order").alias("_first")).hint("shuffle_hash")
    head = segments.select(F.col("book_id").alias("_book"), "seg_order", F.substring("text", 1, n).alias("head"))
    lowest = F.coalesce(F.col("seg_order") <= F.col("_first"), F.col("_first").isNull())
    opening = head.join(first, F.col("_book").eqNullSafe(F.col("book_id")) & lowest)
    return opening.groupBy("book_id").agg(F.min_by("head", "seg_order").alias("excerpt"))


def parse_metadata(df: DataFrame, column: str) -> DataFrame:
    """Author, genre, year and notes out of a JSON answer.

    Text is trimmed, blank and false values become null. A numeric year is truncated, a text year
    must be a plain integer.
    """
    doc = F.try_parse_json(F.col(column))

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))

    def text(name: str) -> Column:
        value = strip(F.try_variant_get(doc, f"$.{name}", "string"))
        falsy = (kind(name) != "STRING") & value.isin("0", "false", "[]", "{}")
        return F.when(~F.coalesce(falsy, F.lit(False)), none_if_empty(value)).alias(name)

    number = F.try_variant_get(doc, "$.year", "double").cast("int")
    written = strip(F.try_variant_get(doc, "$.year", "string"))
    year = F.when(kind("year") == "STRING", F.when(written.rlike(r"^[+-]?[0-9]+\z"), written.try_cast("int"))).otherwise(
        number
    )
    return df.withColumns(
        {"author": text("author"), "genre": text("genre"), "year": year, "notes": text("notes")}
    )


def apply_patch(books: DataFrame, patches: DataFrame) -> DataFrame:
    """Non-null fields of the patch (one row per id) overwrite; null never clears a value."""
    fields = [c for c in patches.columns if c in PATCHABLE and c in books.columns]
    renamed = patches.select("id", *(F.col(c).alias(f"_new_{c}") for c in fields))
    return books.join(renamed, "id", "left").select(
        *(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in books.columns)
    )


def edit_segments(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the text at (book_id, seg_order) and send the segment back to pending."""
    changes = edits.select("book_id", "seg_order", F.col("text").alias("_text"), F.lit(True).alias("_hit"))
    joined = segments.join(changes, ["book_id", "seg_order"], "left")
    return joined.withColumns(
        {
            "text": F.when(F.col("_hit"), F.col("_text")).otherwise(F.col("text")),
            "status": F.when(F.col("_hit"), F.lit("pending")).otherwise(F.col("status")),
        }
    ).select(*segments.columns)


def ready_positions(segments: DataFrame) -> DataFrame:
    """Ready segments with their play position: (book_id, id, idx, group_n, title, carried, duration)."""
    ready = segments.filter(F.col("status") == "ready").select(
        "book_id", "id", "seg_order", none_if_empty(F.col("chapter_title")).alias("title"), "duration"
    )
    return number_in_group(ready, "book_id", "seg_order", carry=F.col("title"))


def chapter_marks(segments: DataFrame) -> DataFrame:
    """Where chapters start, counted over the ready segments only."""
    return ready_positions(segments).filter(F.col("title").isNotNull()).select("book_id", "idx", "title")


def position_label(segments: DataFrame) -> DataFrame:
    """Title of the last chapter mark at or before a position, else ``Part i of n``."""
    part = F.format_string("Part %d of %d", F.col("idx") + 1, F.col("group_n"))
    return ready_positions(segments).select("book_id", "idx", F.coalesce("carried", part).alias("label"))


def _ready_count(segments: DataFrame) -> DataFrame:
    return segments.groupBy("book_id").agg(F.count_if(F.col("status") == "ready").alias("n_ready"))


def listening_fraction(progress: DataFrame, segments: DataFrame) -> DataFrame:
    """How far into the book a listener is, from saved (seg_idx, t) and the clip's duration."""
    clips = ready_positions(segments).select("book_id", F.col("idx").cast("int").alias("at"), "duration", "group_n")
    counts = clips.groupBy("book_id").agg(F.max("group_n").alias("n_ready"))
    clips = clips.drop("group_n")
    at = F.expr("try_cast(seg_idx AS INT)")
    inside = F.coalesce(F.try_divide("t", F.nullif("duration", F.lit(0.0))), F.lit(0.0))
    fraction = F.try_divide(F.col("at") + inside, F.col("n_ready"))
    return (
        progress.withColumn("at", at)
        .join(clips, ["book_id", "at"], "left")
        .join(counts, "book_id", "left")
        .withColumn("fraction", fraction)
        .withColumn("started", F.coalesce((F.col("fraction") > 0.01) & (F.col("fraction") < 0.995), F.lit(False)))
        .select(*progress.columns, "fraction", "started")
    )


def resume_position(progress: DataFrame, segments: DataFrame) -> DataFrame:
    """Saved position if it still exists in the book, else the start."""
    at = F.expr("try_cast(seg_idx AS INT)")
    valid = F.coalesce((at >= 0) & (at < F.col("n_ready")), F.lit(False))
    return progress.join(_ready_count(segments), "book_id", "left").select(
        "user_id", "book_id",
        F.when(valid, at).otherwise(0).alias("idx"),
        F.when(valid, F.coalesce("t", F.lit(0.0))).otherwise(F.lit(0.0)).alias("t"),
    )


def initial_narrator(voices: DataFrame, saved: DataFrame) -> DataFrame:
    """The voice a listener starts with: the saved one if playable, else primary, else the first."""
    playable = voices.filter("ready").groupBy("book_id").agg(
        F.min_by("narrator", "pos").alias("first_voice"), F.collect_set("narrator").alias("offered")  # one per voice
    )
    kept = F.array_contains("offered", F.col("narrator"))
    return saved.join(playable, "book_id", "left").select(
        "user_id", "book_id", F.when(kept, F.col("narrator")).otherwise(F.col("first_voice")).alias("narrator")
    )


def addable_narrators(books: DataFrame, voices: DataFrame, registry_keys: Sequence[str]) -> DataFrame:
    """Voices a complete book does not have yet. A book holds at most one row per registry key."""
    taken = voices.groupBy("book_id").agg(F.collect_set("narrator").alias("taken"))
    complete = books.filter(F.col("status") == "complete").select(F.col("id").alias("book_id"))
    keys = F.array(*map(F.lit, registry_keys))
    left = F.array_except(keys, F.coalesce("taken", F.array().cast("array<string>")))
    return complete.join(taken, "book_id", "left").select("book_id", F.explode(left).alias("narrator"))


def allowed_sign_ins(people: DataFrame, allow: DataFrame | None = None, admin_email: str | None = None) -> DataFrame:
    """Rows whose e-mail is on the allow-list (column email); without a list everyone is.

    The administrator is always on it, case does not matter.
    """
    if allow is None:
        return people
    listed = allow.select(F.lower(strip(F.col("email"))).alias("_email")).filter(F.col("_email") != "")
    if admin_email:
        admin = allow.sparkSession.range(1).select(F.lit(admin_email.strip().lower()).alias("_email"))
        listed = listed.unionByName(admin)
    return people.join(listed, F.lower(F.coalesce(people["email"], F.lit(""))) == F.col("_email"), "left_semi")


def ab_eligible_users(
    users: DataFrame, allow: DataFrame | None = None, admin_email: str | None = None
) -> DataFrame:
    """Admins and users with the grant, among those who may sign in."""
    entitled = users.filter((F.col("role") == "admin") | F.col("ab_test_access"))
    return allowed_sign_ins(entitled, allow, admin_email)


def apply_access(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Set the grant flag of the listed users (one row per id); all users, by id."""
    flags = grants.select("id", F.col("ab_test_access").alias("_flag"))
    return (
        users.join(flags, "id", "left")
        .withColumn("ab_test_access", F.coalesce("_flag", "ab_test_access"))
        .select(*users.columns)
        .orderBy("id")
    )


def list_narrators(registry: DataFrame, default: str) -> DataFrame:
    return registry.select(
        "key", "label", "voice", F.coalesce("provider", F.lit("openai")).alias("provider"),
        (F.col("key") == default).alias("is_default"),
    )


def _primary_of(books: DataFrame, default: str) -> Column:
    return F.coalesce(none_if_empty(books["tts_narrator"]), F.lit(default))


def drop_narration(
    takes: DataFrame, segments: DataFrame, books: DataFrame, requests: DataFrame, default: str
) -> DataFrame:
    """Takes left after removing the requested (book_id, narrator) pairs; a primary is refused."""
    allowed = (
        requests.join(books.select(F.col("id").alias("book_id"), _primary_of(books, default).alias("_primary")), "book_id")
        .filter(F.col("narrator") != F.col("_primary"))
        .select("book_id", "narrator")
    )
    doomed = segments.select(F.col("id").alias("segment_id"), "book_id").join(allowed, "book_id").select(
        "segment_id", "narrator"
    )
    return takes.join(doomed, ["segment_id", "narrator"], "left_anti")


def delete_books(
    books: DataFrame, segments: DataFrame, takes: DataFrame, events: DataFrame, ids: DataFrame
) -> dict[str, DataFrame]:
    """What is left of the four tables; events outlive their book with a null book_id.

    ``ids`` has one column ``book_id`` with unique values.
    """
    kept_segments = segments.join(ids, "book_id", "left_anti")
    gone = segments.join(ids, "book_id", "left_semi").select(F.col("id").alias("segment_id"))
    # events without a book get join keys of their own
    gone_ids = ids.select(F.concat(F.lit("b"), F.col("book_id").cast("string")).alias("_book"), F.lit(True).alias("_gone"))
    own_key = F.coalesce(F.concat(F.lit("b"), F.col("book_id").cast("string")), F.concat(F.lit("e"), F.col("id").cast("string")))
    marked = events.withColumn("_book", own_key).join(gone_ids, "_book", "left")
    return {
        "books": books.join(ids.withColumnRenamed("book_id", "id"), "id", "left_anti"),
        "segments": kept_segments,
        "segment_audio": takes.join(gone, "segment_id", "left_anti"),
        "pipeline_events": marked.withColumn("book_id", F.when(F.col("_gone").isNull(), F.col("book_id"))).select(
            *events.columns
        ),
    }


def upsert_users(users: DataFrame, logins: DataFrame, admin_email: str | None = None) -> DataFrame:
    """Add unseen google_ids (first login wins), keep known rows, promote the administrator.

    ``logins``: login_id, google_id, email?, display_name?, already cut to ``allowed_sign_ins``. New
    rows have no id yet: the table's own sequence gives it.
    """
    first = (
        logins.filter(F.col("google_id").isNotNull() & (F.col("google_id") != ""))
        .groupBy("google_id")
        .agg(F.min_by(F.struct("email", "display_name"), "login_id").alias("who"))
    )
    new = first.join(users, "google_id", "left_anti").select(
        F.lit(None).cast("bigint").alias("id"),
        "google_id",
        F.coalesce("who.email", F.lit("")).alias("email"),
        F.col("who.display_name").alias("display_name"),
        F.lit("user").alias("role"),
        F.lit(False).alias("ab_test_access"),
    )
    seen = first.select("google_id", F.lit(True).alias("_seen"))
    current = users.join(seen, "google_id", "left")
    everyone = current.unionByName(new.withColumn("_seen", F.lit(True)))
    if not admin_email:
        return everyone.select(*users.columns)
    is_admin = F.coalesce("_seen", F.lit(False)) & (F.lower("email") == admin_email.strip().lower())
    return everyone.withColumn("role", F.when(is_admin, "admin").otherwise(F.col("role"))).select(*users.columns)


def accept_uploads(files: DataFrame) -> DataFrame:
    return files.withColumn("accepted", F.endswith(F.lower("filename"), F.lit(".pdf")))
