"""What still has to be rendered, where it goes, and how results fold back into a book's status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import none_if_empty

# Queue per provider; anything else goes to the shared queue.
PROVIDER_QUEUE = {"openai": "synth", "elevenlabs": "synth_el"}
SHARED_QUEUE = "synth"
LOCAL_PREFIX = "storage/"
PURGE_KINDS = ("audio", "audio-archive", "pdfs")


def plan_primary(segments: DataFrame) -> DataFrame:
    """Segments still to render per book; stuck ones go back to pending first. Order by book and seg_order to show them."""
    status = F.when(F.col("status") == "processing", "pending").otherwise(F.col("status"))
    return (
        segments.select("book_id", F.col("id").alias("segment_id"), "seg_order", status.alias("status"))
        .filter(F.col("status") != "ready")
    )


def plan_alternate(segments: DataFrame, takes: DataFrame, narrator: str, registry: DataFrame) -> DataFrame:
    """Per ready segment: create a missing take, skip a paid one, reset any other.

    An unknown narrator plans nothing.
    """
    known = registry.filter(F.col("key") == narrator).agg(F.count(F.lit(1)) > 0).scalar()
    ready = segments.filter((F.col("status") == "ready") & known).select(F.col("id").alias("segment_id"))
    own = takes.filter(F.col("narrator") == narrator).select(
        "segment_id", F.col("status").alias("take_status"), none_if_empty(F.col("audio_path")).alias("take_path")
    )
    action = (
        F.when(F.col("take_status").isNull(), "create")
        .when((F.col("take_status") == "ready") & F.col("take_path").isNotNull(), "skip")
        .otherwise("reset")
    )
    return ready.join(own, "segment_id", "left").select("segment_id", action.alias("action"))


def queue_of(provider: Column, queues: Mapping[str, str] = PROVIDER_QUEUE) -> Column:
    known = F.create_map(*(F.lit(x) for pair in queues.items() for x in pair))
    return F.coalesce(F.element_at(known, F.coalesce(none_if_empty(provider), F.lit("openai"))), F.lit(SHARED_QUEUE))


def route(plan: DataFrame, queues: Mapping[str, str] = PROVIDER_QUEUE) -> DataFrame:
    """Add the queue for the row's provider."""
    return plan.withColumn("queue", queue_of(F.col("provider"), queues))


def queue_load(routed: DataFrame) -> DataFrame:
    return routed.groupBy("queue").agg(F.count(F.lit(1)).alias("n"))


def clip_key(book_id: Column, seg_order: Column, narrator: Column | None = None) -> Column:
    """Object key of a rendered clip; an alternate voice has a folder of its own."""
    parts = [F.lit("audio"), book_id.cast("string")]
    if narrator is not None:
        parts.append(narrator)
    return F.concat_ws("/", *parts, F.format_string("%04d.mp3", seg_order))


def output_keys(plan: DataFrame, narrator: str | None = None) -> DataFrame:
    voice = None if narrator is None else F.lit(narrator)
    return plan.withColumn("key", clip_key(F.col("book_id"), F.col("seg_order"), voice))


def finalize(books: DataFrame, segments: DataFrame) -> DataFrame:
    """Complete if every segment is ready, else error. A book without segments is complete."""
    folded = segments.groupBy(F.col("book_id").alias("id")).agg(F.bool_and(F.col("status") == "ready").alias("ok"))
    done = F.coalesce("ok", F.lit(True))
    return books.select("id").join(folded, "id", "left").select(
        F.col("id").alias("book_id"), F.when(done, "complete").otherwise("error").alias("status")
    )


def can_narrate(
    requests: DataFrame, segments: DataFrame, books: DataFrame, registry: DataFrame, default: str
) -> DataFrame:
    """Check (book_id, narrator) requests; ``reason`` names the first rule that fails."""
    heard = segments.filter(F.col("status") == "ready").groupBy("book_id").agg(F.lit(True).alias("heard"))
    known = registry.select(F.col("key").alias("narrator"), F.lit(True).alias("known"))
    primary = books.select(
        F.col("id").alias("book_id"),
        F.coalesce(none_if_empty(F.col("tts_narrator")), F.lit(default)).alias("primary_key"),
    )
    reason = (
        F.when(F.col("primary_key").isNull(), "no such book")
        .when(F.col("known").isNull(), "unknown narrator")
        .when(F.col("narrator") == F.col("primary_key"), "already the primary narrator")
        .when(F.col("heard").isNull(), "no rendered audio")
    )
    return (
        requests.join(primary, "book_id", "left")
        .join(known, "narrator", "left")
        .join(heard, "book_id", "left")
        .select("book_id", "narrator", reason.isNull().alias("ok"), reason.alias("reason"))
    )


def fill_source(books: DataFrame, inventory: DataFrame) -> DataFrame:
    """Is the source file of each book in the inventory? If not it needs a new upload."""
    asked = books.select("pdf_path").filter(F.col("pdf_path").isNotNull())
    present = inventory.select(F.col("key").alias("pdf_path")).join(asked, "pdf_path", "left_semi").distinct()
    present = present.withColumn("_present", F.lit(True))
    return books.join(present, "pdf_path", "left").select(
        F.col("id").alias("book_id"), "pdf_path", F.coalesce("_present", F.lit(False)).alias("available")
    )


def classify_path(path: Column, remote_on: bool = True) -> Column:
    """``remote`` for an object key, ``local`` for a path under storage/ or without a remote store."""
    return F.when(F.lit(remote_on) & ~F.startswith(path, F.lit(LOCAL_PREFIX)), "remote").otherwise("local")


def purge_prefixes(
    inventory: DataFrame, ids: DataFrame, kinds: tuple[str, ...] = PURGE_KINDS, narrator: str | None = None
) -> DataFrame:
    """Keys to delete for the books in ``ids`` (column book_id): everything under ``kind/{id}/``.

    With ``narrator`` only ``audio/{id}/{narrator}/``. Joined on the id part of the key, not by LIKE.
    """
    parts = F.split("key", "/")
    keyed = inventory.withColumn("_id", F.get(parts, F.lit(1)))
    if narrator is None:
        under = F.get(parts, F.lit(0)).isin(*kinds) & (F.size(parts) >= 3)
    else:
        under = (
            (F.get(parts, F.lit(0)) == "audio") & (F.get(parts, F.lit(2)) == narrator) & (F.size(parts) >= 4)
        )
    wanted = ids.select("book_id", F.col("book_id").cast("string").alias("_id"))
    return keyed.filter(under).join(wanted, "_id").select("key", "book_id")


def plan_reprocess(
    books: DataFrame, segments: DataFrame, takes: DataFrame, inventory: DataFrame, requests: DataFrame, stamp: str
) -> dict[str, DataFrame]:
    """Plan to rebuild books from their source.

    ``requests``: book_id (unique), new_file (STRING or null). A request is refused if its source is
    missing and no PDF comes with it, or if the new file is not a PDF. For the others the segments and their takes go,
    audio keys move to the archive under ``stamp``, the old source of a replaced file is purged, and
    the book is pending without a page count.
    """
    asked = requests.join(books.withColumnRenamed("id", "book_id"), "book_id").select(
        F.col("book_id").alias("id"), "pdf_path", "new_file"
    )
    available = fill_source(asked, inventory).select(F.col("book_id").alias("id"), "available")
    checked = asked.join(available, "id")
    is_pdf = F.endswith(F.lower("new_file"), F.lit(".pdf"))
    ok = F.when(F.col("new_file").isNotNull(), is_pdf).otherwise(F.col("available"))
    decided = checked.select(F.col("id").alias("book_id"), "new_file", ok.alias("accepted"))
    accepted = decided.filter("accepted")
    book_part = F.get(F.split("key", "/"), F.lit(1))
    audio = inventory.filter(F.startswith("key", F.lit("audio/"))).withColumn("_book", book_part)
    moves = audio.join(accepted.select("book_id", F.col("book_id").cast("string").alias("_book")), "_book")
    tail = F.substring(F.col("key"), F.length("_book") + len("audio/") + 2, F.length("key"))
    moves = moves.select(
        "book_id", "key", F.concat(F.lit("audio-archive/"), F.col("_book"), F.lit(f"/{stamp}/"), tail).alias("new_key")
    )
    attached = F.concat_ws("/", F.lit("pdfs"), F.col("id").cast("string"), F.col("new_file"))
    after = books.join(accepted.withColumnRenamed("book_id", "id"), "id").select(
        "id", F.coalesce("new_file", "filename").alias("filename"),
        F.when(F.col("new_file").isNotNull(), attached).otherwise(F.col("pdf_path")).alias("pdf_path"),
        F.lit("pending").alias("status"), F.lit(None).cast("int").alias("page_count"),
    )
    replaced = accepted.filter(F.col("new_file").isNotNull()).select("book_id")
    gone = segments.join(accepted.select("book_id"), "book_id", "left_semi").select(F.col("id").alias("segment_id"))
    return {
        "decisions": decided.select("book_id", "accepted"),
        "books": after,
        "segments": segments.join(accepted.select("book_id"), "book_id", "left_anti"),
        "takes": takes.join(gone, "segment_id", "left_anti"),
        "moves": moves,
        "purge": purge_prefixes(inventory, replaced, ("pdfs",)),
    }
