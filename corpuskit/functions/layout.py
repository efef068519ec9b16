"""Page layout to page text, on one nested row per page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import SP, WS, let, strip
from .text import smart_titlecase

# --- fixed values ---------------------------------------------------------------------------
MARGIN_FRACTION = 0.08
MARGIN_MAX_CHARS = 80
HEADING_RATIO = 1.2
FOOTNOTE_RATIO = 0.85
FOOTNOTE_ZONE = 0.65
PAGE_NUMBER = rf"^[\p{{Nd}}{WS}\-–—|·•ivxlcdmIVXLCDM]+\z"
PAGE_NUMBER_CHARS = 25
PAGE_COUNTER = rf"(?i)^(?:page{SP}+)?\p{{Nd}}+{SP}+of{SP}+\p{{Nd}}+\.?\z"
# --------------------------------------------------------------------------------------------


def _rounded_sizes(lines: Column) -> Column:
    """Half-even rounded sizes of the non-blank spans, in reading order."""
    spans = F.filter(F.flatten(lines), lambda s: strip(s["text"]) != "")
    return F.transform(spans, lambda s: F.bround(s["size"]).cast("int"))


def _most_common(sizes: Column) -> Column:
    """The most frequent value, the first seen of equals; null for none."""

    def pick(all_sizes: Column) -> Column:
        tallies = F.transform(
            F.array_distinct(all_sizes),
            lambda d, i: F.struct(
                F.size(F.filter(all_sizes, lambda x: x == d)).alias("n"), (-i).alias("earlier"), d.alias("size")
            ),
        )
        return F.array_max(tallies)["size"]

    return let(sizes, pick)


def body_size(blocks: Column) -> Column:
    """The page's usual text size, over its text blocks."""
    text_blocks = F.filter(blocks, lambda b: b["block_type"] == 0)
    return _most_common(F.flatten(F.transform(text_blocks, lambda b: _rounded_sizes(b["lines"]))))


def dominant_size(lines: Column) -> Column:
    return F.coalesce(_most_common(_rounded_sizes(lines)), F.lit(0))


def block_text(lines: Column) -> Column:
    """Lines of a block joined with blanks; a line ending in ``-`` is glued to the next one.

    A glued line keeps its own end hyphen and does not ask for another glue.
    """
    joined = F.filter(
        F.transform(lines, lambda spans: strip(F.array_join(F.transform(spans, lambda s: s["text"]), ""))),
        lambda t: t != "",
    )
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("hyphen"), F.lit(True).alias("first"))

    def step(state: Column, line: Column) -> Column:
        ends = F.endswith(line, F.lit("-")) & ~state["hyphen"]
        shown = F.when(ends, line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
        glue = F.when(state["hyphen"] | state["first"], "").otherwise(" ")
        return F.struct(
            F.concat(state["text"], glue, shown).alias("text"), ends.alias("hyphen"), F.lit(False).alias("first")
        )

    return strip(F.aggregate(joined, zero, step, lambda s: s["text"]))


def read_blocks(blocks: Column) -> Column:
    """ARRAY<STRUCT<block_no, y_center, text, size>> of the text blocks that have any text."""

    def read(b: Column) -> Column:
        return F.struct(
            b["block_no"].alias("block_no"),
            ((b["y0"] + b["y1"]) / 2).alias("y_center"),
            block_text(b["lines"]).alias("text"),
            dominant_size(b["lines"]).alias("size"),
        )

    text_blocks = F.filter(blocks, lambda b: b["block_type"] == 0)
    return F.filter(F.transform(text_blocks, read), lambda b: b["text"] != "")


def in_margin(block: Column, page_h: Column) -> Column:
    """Running header or footer: short text in the top or bottom 8% of the page."""
    low, high = page_h * F.lit(MARGIN_FRACTION), page_h * F.lit(1 - MARGIN_FRACTION)
    edge = (block["y_center"] < low) | (block["y_center"] > high)
    return edge & (F.length(block["text"]) < MARGIN_MAX_CHARS)


def is_page_number(block: Column) -> Column:
    return block["text"].rlike(PAGE_NUMBER) & (F.length(block["text"]) < PAGE_NUMBER_CHARS)


def is_page_counter(block: Column) -> Column:
    return block["text"].rlike(PAGE_COUNTER)


def is_footnote(block: Column, page_h: Column, body: Column) -> Column:
    return (block["size"] < body * F.lit(FOOTNOTE_RATIO)) & (block["y_center"] > page_h * F.lit(FOOTNOTE_ZONE))


def format_heading(block: Column, body: Column) -> Column:
    """Larger text becomes a spoken heading on lines of its own, in title case if it was all caps."""
    text = block["text"]
    shown = F.when(text == F.upper(text), smart_titlecase(text)).otherwise(text)
    return F.when(
        block["size"] > body * F.lit(HEADING_RATIO), F.concat(F.lit("\n"), shown, F.lit(".\n"))
    ).otherwise(text)


def page_text(blocks: Column, page_h: Column) -> Column:
    """All rules for a page; an empty string when no span has text."""

    def compose(bs: Column, height: Column, body: Column) -> Column:
        kept = F.filter(
            read_blocks(bs),
            lambda b: ~(
                in_margin(b, height) | is_page_number(b) | is_page_counter(b) | is_footnote(b, height, body)
            ),
        )
        text = F.array_join(F.transform(kept, lambda b: format_heading(b, body)), "\n")
        return F.when(body.isNull(), "").otherwise(text)

    return let(
        blocks, lambda bs: let(page_h, lambda h: let(body_size(bs), lambda body: compose(bs, h, body)))
    )
