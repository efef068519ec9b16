"""Moving books between stores: new ids, owners, object keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.planning import clip_key

#: What a path of the old store contains, and the form of every key that ``clip_key`` makes.
LOCAL = "storage/audio"
CLIP = r"\Aaudio/(?:[^/]*/)?[^/]*\.mp3\z"


def remap_ids(
    books: DataFrame, segments: DataFrame, local_files: DataFrame, remote: DataFrame, offset: int
) -> dict[str, DataFrame]:
    """Shift ids; local clips that exist get their new object key, missing ones null, others stay.

    ``counts`` tells how many clips to upload, how many the target has already, how many are missing.
    """
    new_key = clip_key(F.col("book_id") + offset, F.col("seg_order"))
    is_local = F.coalesce(F.contains("audio_path", F.lit(LOCAL)), F.lit(False))
    # keys that no local path, or no key of a clip, can equal are not worth a place in the joins
    here = local_files.select(F.col("key").alias("_path")).filter(F.contains("_path", F.lit(LOCAL))).distinct().withColumn(
        "_here", F.lit(True))
    there = remote.select(F.col("key").alias("_new_key")).filter(F.col("_new_key").rlike(CLIP)).distinct().withColumn(
        "_there", F.lit(True))
    found = is_local & F.col("_here").isNotNull()
    # only local paths can match: any other segment, above all one without a path, gets a key of its own
    path = F.when(is_local, F.col("audio_path")).otherwise(F.concat(F.lit("\0"), F.col("id").cast("string")))
    moved = segments.withColumns({"_new_key": new_key, "_path": path}).join(here, "_path", "left").select(
        (F.col("id") + offset * 1000).alias("id"),
        (F.col("book_id") + offset).alias("book_id"),
        "seg_order", "text",
        F.when(found, F.col("_new_key")).when(~is_local, F.col("audio_path")).alias("audio_path"),
        "status", "duration",
    )
    clips = segments.filter(is_local).select(new_key.alias("_new_key"), F.col("audio_path").alias("_path"))
    known = clips.join(here, "_path", "left").join(there, "_new_key", "left")
    on_disk, uploaded = F.col("_here").isNotNull(), F.col("_there").isNotNull()
    states = {"uploaded": on_disk & ~uploaded, "skipped": on_disk & uploaded, "missing": ~on_disk}
    return {
        "books": books.withColumn("id", F.col("id") + offset),
        "segments": moved,
        "counts": known.agg(*(F.count_if(state).alias(name) for name, state in states.items())),
    }


def backfill_owner(books: DataFrame, users: DataFrame, email: str) -> DataFrame:
    """Books without an owner go to the user with this e-mail; without such a user they stay so."""
    owner = users.filter(F.lower("email") == email.lower()).agg(F.min("id")).scalar()
    return books.withColumn("uploaded_by", F.coalesce(F.col("uploaded_by"), owner))


def rekey_prefix(inventory: DataFrame, src: str, dst: str) -> DataFrame:
    """Plan of a move: keys under ``src`` get the prefix ``dst``, others keep their key."""
    moved = F.startswith("key", F.lit(src))
    tail = F.substring(F.col("key"), F.lit(len(src) + 1), F.length("key"))
    return inventory.select(
        "key", F.when(moved, F.concat(F.lit(dst), tail)).otherwise(F.col("key")).alias("new_key"), moved.alias("moved")
    )
