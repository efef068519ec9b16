"""From layout or raw text to narration chunks, and the reports on them.

``prepare_corpus`` is one projection: a document is a row, and everything between its text and its
chunks happens inside that row. There is no shuffle in it, so the work spreads with the input files
whatever the distribution of sources or document sizes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chapters, chunks, layout, text
from ..functions.base import let

# --- fixed values ---------------------------------------------------------------------------
FALLBACK_MESSAGE = "%d/%d chunks kept heuristic text (LLM polish unavailable)."
SCANNED_MESSAGE = "Looks scanned: only %d chars across %d pages — likely needs OCR."
# --------------------------------------------------------------------------------------------
#: Calls of a polishing service that a partition keeps under way.
POLISH_THREADS = 8


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows evenly over ``partitions``, whatever the input; None leaves them where they are.

    For texts that lie in few or uneven files: the work per row is large against the cost of moving it.
    """
    return df if partitions is None else df.repartition(partitions)


def nest_spans(spans: DataFrame) -> DataFrame:
    """Flat spans to one layout row per page (``schemas.PAGE_LAYOUT``); a page fits a row."""
    span = F.struct("block_no", "line_no", "span_no", "block_type", "y0", "y1", "text", "size")
    pages = spans.groupBy("doc_id", "page_no").agg(
        F.first("page_h").alias("page_h"), F.array_sort(F.collect_list(span)).alias("spans")
    )

    def blocks(all_spans):
        def lines_of(block):
            return F.transform(
                F.array_distinct(block["line_no"]),
                lambda n: F.transform(
                    F.filter(block, lambda s: s["line_no"] == n),
                    lambda s: F.struct(s["text"].alias("text"), s["size"].alias("size")),
                ),
            )

        def one(no):
            return let(
                F.filter(all_spans, lambda s: s["block_no"] == no),
                lambda b: F.struct(
                    no.alias("block_no"),
                    F.get(b, F.lit(0))["block_type"].alias("block_type"),
                    F.array_min(b["y0"]).alias("y0"),
                    F.array_max(b["y1"]).alias("y1"),
                    lines_of(b).alias("lines"),
                ),
            )

        return F.transform(F.array_distinct(all_spans["block_no"]), one)

    return pages.select("doc_id", "page_no", "page_h", let(F.col("spans"), blocks).alias("blocks"))


def page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) by all layout rules."""
    return pages.select("doc_id", "page_no", layout.page_text(F.col("blocks"), F.col("page_h")).alias("text"))


def doc_text(page_texts: DataFrame) -> DataFrame:
    """(doc_id, page_count, text): non-empty pages in order, an empty line between, no NUL characters."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = page_texts.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"), ordered.alias("pages"))
    full = F.array_join(F.filter(F.col("pages")["text"], lambda t: t != ""), "\n\n")
    return joined.select("doc_id", "page_count", F.translate(full, "\0", "").alias("text"))


def segment_regions(texts: DataFrame, *keep: str) -> DataFrame:
    """Kept columns and ``regions`` ARRAY<STRUCT<chapter_title, body>> of normalized texts."""
    lines, cands, heads = F.col("lines"), F.col("cands"), F.col("heads")
    return (
        texts.select(*keep, F.split("text", "\n").alias("lines"))
        .select(*keep, "lines", let(lines, lambda rows: chapters.body_gap(rows, chapters.heading_candidates(rows))).alias("cands"))
        .select(*keep, "lines", chapters.judge_headings(cands).alias("heads"))
        .select(*keep, chapters.cut_regions(lines, heads).alias("regions"))
    )


def prepare_corpus(docs: DataFrame) -> DataFrame:
    """docs (doc_id, page_count, text) → (doc_id, page_count, chunks).

    ``chunks`` is ARRAY<STRUCT<seg_order, chapter_title, text, is_last>>.
    """
    keep = ("doc_id", "page_count")
    # Small steps keep the analysis of nested lambdas short; Catalyst joins them into one projection
    # wherever a step is used once.
    staged = docs.select(*keep, text.normalize_text(F.col("text")).alias("text"))
    staged = segment_regions(staged, *keep)
    staged = staged.select(*keep, chunks.emit_chunks(F.col("regions")).alias("chunks"))

    def number(all_chunks):
        return F.transform(
            all_chunks,
            lambda c, i: F.struct(
                i.alias("seg_order"),
                c["chapter_title"].alias("chapter_title"),
                c["text"].alias("text"),
                (i == F.size(all_chunks) - 1).alias("is_last"),
            ),
        )

    return staged.select(*keep, let(F.col("chunks"), number).alias("chunks"))


def unroll(df: DataFrame, *keep: str, array: Column, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes Catalyst put ``size(array) > 0`` below it, which computes the array again
    for the test. The outer form does not, and its row for an empty array is dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def chunk_rows(prepared: DataFrame) -> DataFrame:
    """One row per chunk."""
    return unroll(prepared, "doc_id", array=F.col("chunks")).select("doc_id", "item.*")


def _in_order(pool: ThreadPoolExecutor, call: Callable, items: Iterator, ahead: int) -> Iterator:
    """Results of ``call`` in the order of ``items``, of which at most ``ahead`` are under way."""
    waiting: deque = deque()
    for item in items:
        waiting.append(pool.submit(call, item))
        if len(waiting) >= ahead:
            yield waiting.popleft().result()
    while waiting:
        yield waiting.popleft().result()


def apply_polish(rows: DataFrame, polish: Callable[[str], str | None], threads: int = POLISH_THREADS) -> DataFrame:
    """Add ``cleaned``: what a user function makes of each text, one call per row.

    Calls wait for a service, so ``threads`` of them run at once in a partition; rows keep their order, and at most
    twice as many calls are under way, whatever the partition's size. A call that raises, or gives no text, leaves a
    null for its own row only, which the guard turns into a fallback. Blank and null texts are not sent.
    """

    def attempt(value: str | None) -> str | None:
        try:
            result = polish(value) if value and value.strip() else None
        except Exception:
            return None
        return result if isinstance(result, str) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[pd.DataFrame] = deque()  # batches whose calls are under way

        def texts() -> Iterator[str | None]:
            for batch in batches:
                if len(batch):
                    held.append(batch)
                    yield from batch["text"].tolist()

        cleaned: list[str | None] = []
        with ThreadPoolExecutor(threads) as pool:
            for result in _in_order(pool, attempt, texts(), 2 * threads):
                cleaned.append(result)
                if len(cleaned) == len(held[0]):
                    yield held.popleft().assign(cleaned=pd.Series(cleaned, dtype=object).values)
                    cleaned = []

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("cleaned", T.StringType())]))


def polish_guard(rows: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """Take the polished text where it is sound, else keep the chunk; ``used`` tells which.

    The candidates are the column ``cleaned`` of the rows, as ``apply_polish`` leaves it, or come
    from a table (doc_id, seg_order, cleaned). Only the latter needs a join.
    """
    if cleaned is not None:
        keys = ["doc_id", "seg_order"]
        rows = rows.join(cleaned.select(*keys, "cleaned"), keys, "left")
    verdict = chunks.accept_polish(F.col("text"), F.col("cleaned"))
    kept = [c for c in rows.columns if c != "cleaned"]
    return rows.withColumn("verdict", verdict).select(
        *(F.col("verdict.text").alias("text") if c == "text" else F.col(c) for c in kept),
        F.col("verdict.used").alias("used"),
    )


def fallback_report(guarded: DataFrame) -> DataFrame:
    """Per document: chunks that kept their own text, and all chunks."""
    return guarded.groupBy("doc_id").agg(
        F.count_if(~F.col("used")).alias("fallbacks"), F.count(F.lit(1)).alias("total")
    )


def fallback_events(report: DataFrame) -> DataFrame:
    """A warning event for each document with fallbacks."""
    message = F.format_string(FALLBACK_MESSAGE, F.col("fallbacks"), F.col("total"))
    return report.filter(F.col("fallbacks") > 0).select(
        F.col("doc_id").alias("book_id"), F.lit("ingest_book").alias("task"), F.lit("warning").alias("level"),
        message.alias("message"),
    )


def qa_flags(rows: DataFrame) -> DataFrame:
    """Add flags, length, noise_ratio and short_ratio to chunk rows (they carry ``is_last``)."""
    return rows.withColumn("qa", chunks.qa_flags(F.col("text"), F.col("is_last"))).select(*rows.columns, "qa.*")


def duplicate_orders(segments: DataFrame) -> DataFrame:
    """(book_id, seg_order) that occur more than once: what an appended second run leaves behind."""
    return segments.groupBy("book_id", "seg_order").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def extract_report(prepared: DataFrame) -> DataFrame:
    """Per document: pages, segments, chapters, character counts, flagged chunks, scanned or not."""
    lengths = F.transform("chunks", lambda c: F.length(c["text"]))
    chaptered = F.size(F.filter("chunks", lambda c: c["chapter_title"].isNotNull() & (c["chapter_title"] != "")))
    flagged = F.size(
        F.filter("chunks", lambda c: F.size(chunks.qa_flags(c["text"], c["is_last"])["flags"]) > 0)
    )
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    measured = prepared.select(
        "doc_id", F.col("page_count").alias("pages"), lengths.alias("lengths"), chaptered.alias("chapters"),
        flagged.alias("flagged"),
    ).withColumns({"segments": F.size("lengths"), "total": total})
    pages, total_c = F.col("pages"), F.col("total")
    return measured.select(
        "doc_id", "pages", "segments", "chapters", "total",
        F.coalesce(F.array_min("lengths"), F.lit(0)).alias("min"),
        F.coalesce(F.array_max("lengths"), F.lit(0)).alias("max"),
        F.when(F.col("segments") > 0, F.floor(total_c / F.col("segments"))).otherwise(0).alias("mean"),
        F.when(F.coalesce(pages, F.lit(0)) != 0, F.floor(total_c / pages)).otherwise(total_c).alias("per_page"),
        "flagged",
        chunks.looks_scanned(F.coalesce(pages, F.lit(0)), total_c).alias("scanned"),
    )


def scanned_events(report: DataFrame) -> DataFrame:
    """A warning event for each document that looks scanned.

    An event is the element of an array: a plain filter would be moved below the report and below the exchange that
    deals the texts, and the whole preparation would run once for it, in as many tasks as files, and once more.
    """
    message = F.format_string(SCANNED_MESSAGE, F.col("total"), F.col("pages"))
    event = F.struct(
        F.col("doc_id").alias("book_id"), F.lit("ingest_book").alias("task"), F.lit("warning").alias("level"),
        message.alias("message"),
    )
    return unroll(report, array=F.when(F.col("scanned"), F.array(event))).select("item.*")


def review_summary(books: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments and characters per book, and the reviewer's rule for scans (no floor on the total)."""
    text_size = segments.groupBy(F.col("book_id").alias("id")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("segments", "chars")]
    pages = F.coalesce("page_count", F.lit(0))
    thin = (pages > 0) & F.coalesce(F.try_divide("chars", pages) < chunks.MIN_CHARS_PER_PAGE, F.lit(False))
    return books.select("id", "page_count").join(text_size, "id", "left").select(
        "id", "page_count", *zero
    ).select(F.col("id").alias("book_id"), "segments", "chars", thin.alias("likely_scanned"))
