"""Chapter detection on the lines of one document.

The lines of a document already sit in one row, so headings, gaps and runs are found with array
functions there. Nothing is exploded, nothing is shuffled, and a corpus with one dominating source
spreads like any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import SP, let, none_if_empty, strip
from .text import chapter_number, clean_title

# --- fixed values ---------------------------------------------------------------------------
MIN_CHAPTER_CHARS = 600
GAP_LINE_CHARS = 60
HEADING = (
    rf"(?iU)^(?:(chapter|book|part|section|letter|essay|canto){SP}+([0-9]+|[ivxlcdm]+)\b"
    rf"|(federalist){SP}+no\.?{SP}*([0-9]+)\b)"
)
LONE_KEYWORD = rf"(?i)^(?:chapter|book|part|section|letter|essay|canto|federalist){SP}*[.:]?\z"
# --------------------------------------------------------------------------------------------
#: Numbers of a piece that a fold goes through at once.
PIECE = 256


def heading_candidates(lines: Column) -> Column:
    """ARRAY<STRUCT<line_no, type, num, raw>> of the lines that read like a numbered heading.

    A line with the keyword alone is tried together with the next non-empty line.
    """

    def scan(filled: Column) -> Column:
        def raw_of(line: Column, at: Column) -> Column:
            follower = F.get(filled, at + 1)["text"]
            joined = F.concat_ws(" ", line["text"], follower)
            text = F.when(line["text"].rlike(HEADING), line["text"]).when(
                line["text"].rlike(LONE_KEYWORD) & follower.isNotNull(), joined
            )
            return F.struct(line["line_no"].alias("line_no"), text.alias("raw"))

        return F.filter(F.transform(filled, raw_of), lambda x: x["raw"].rlike(HEADING))

    def parse(found: Column) -> Column:
        raw = found["raw"]
        kind = F.coalesce(none_if_empty(F.regexp_extract(raw, HEADING, 1)), F.regexp_extract(raw, HEADING, 3))
        num = F.coalesce(none_if_empty(F.regexp_extract(raw, HEADING, 2)), F.regexp_extract(raw, HEADING, 4))
        return F.struct(
            found["line_no"].alias("line_no"),
            F.lower(kind).alias("type"),
            chapter_number(num).alias("num"),
            raw.alias("raw"),
        )

    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), strip(x).alias("text")))
    filled = F.filter(numbered, lambda x: x["text"] != "")
    return F.filter(F.transform(let(filled, scan), parse), lambda x: x["num"].isNotNull())


def _is_gap_prose(line: Column) -> Column:
    return let(
        strip(line),
        lambda s: (F.length(s) >= GAP_LINE_CHARS) & s.rlike(r"\p{Ll}") & ~s.rlike(r"\p{Nd}\z"),
    )


def body_gap(lines: Column, candidates: Column) -> Column:
    """Add ``gap``: characters of prose lines between a candidate and the next one (or the end)."""

    def measure(rows: Column, cands: Column) -> Column:
        def one(cand: Column, at: Column) -> Column:
            end = F.coalesce(F.get(cands, at + 1)["line_no"], F.size(rows))
            between = F.slice(rows, cand["line_no"] + 2, end - cand["line_no"] - 1)
            gap = F.aggregate(
                between,
                F.lit(0),
                lambda total, line: total + F.when(_is_gap_prose(line), F.length(line)).otherwise(0),
            )
            return F.struct(
                *(cand[name].alias(name) for name in ("line_no", "type", "num", "raw")), gap.alias("gap")
            )

        return F.transform(cands, one)

    return let(lines, lambda rows: let(candidates, lambda cands: measure(rows, cands)))


def filter_by_gap(candidates: Column, minimum: int = MIN_CHAPTER_CHARS) -> Column:
    """Candidates with a body of their own; table-of-contents runs and stacked titles fall out."""
    return F.filter(candidates, lambda x: x["gap"] >= minimum)


def dedup_headings(candidates: Column) -> Column:
    """First heading of a (type, number) wins. Apply after the gap filter: a failed one is not seen.

    Sorted by key, the first of each key follows another key.
    """

    keyed = F.array_sort(F.transform(candidates, lambda x: F.struct(
        x["type"].alias("type"), x["num"].alias("num"), x["line_no"].alias("line_no"), x.alias("row"))))

    def is_first(x: Column, before: Column) -> Column:
        return before.isNull() | (before["type"] != x["type"]) | (before["num"] != x["num"])

    firsts = let(keyed, lambda ks: F.filter(ks, lambda x, i: is_first(x, F.get(ks, i - 1))))
    return F.array_sort(firsts["row"])


def _are_among(cands: Column, line_nos: Column) -> Column:
    """ARRAY<BOOLEAN>: for each candidate, in line order, whether its line is among ``line_nos``, by one sort."""
    marks = F.transform(line_nos, lambda n: F.struct(n.alias("line_no"), F.lit(-1).alias("at")))
    places = F.transform(cands, lambda x, i: F.struct(x["line_no"].alias("line_no"), i.alias("at")))

    def marked(both: Column) -> Column:
        def hit(x: Column, i: Column) -> Column:
            before = F.get(both, i - 1)
            return F.when(x["at"] >= 0, F.coalesce((before["at"] < 0) & (before["line_no"] == x["line_no"]), F.lit(False)))

        return F.array_compact(F.transform(both, hit))

    return let(F.array_sort(F.concat(marks, places)), marked)


def _run_lengths(heads: Column) -> Column:
    """ARRAY<INT>: for each heading the length of a longest rising run of ``num`` that ends there, by patience piles.

    The state is the least number that ends a run of each length, ``tails``. Spark copies a fold's whole state at every
    step, so the results are no part of it: a first fold keeps the tails before each piece of PIECE numbers, then every
    piece is gone through again from there. A step costs the piles and a piece.
    """

    def below(tails: Column, num: Column) -> Column:
        return F.filter(tails, lambda t: t < num)

    def put(tails: Column, num: Column) -> Column:
        return F.concat(below(tails, num), F.array(num), F.slice(F.filter(tails, lambda t: t >= num), 2, F.size(tails)))

    def keep_tails(s: Column, piece: Column) -> Column:
        return F.struct(
            F.aggregate(piece, s["tails"], put).alias("tails"), F.array_append(s["before"], s["tails"]).alias("before"))

    def lengths(piece: Column, tails: Column) -> Column:
        def step(s: Column, num: Column) -> Column:
            found = F.array_append(s["lengths"], F.size(below(s["tails"], num)) + 1)
            return F.struct(put(s["tails"], num).alias("tails"), found.alias("lengths"))

        zero = F.struct(tails.alias("tails"), F.array().cast("array<int>").alias("lengths"))
        return F.aggregate(piece, zero, step, lambda s: s["lengths"])

    def run(pieces: Column) -> Column:
        zero = F.struct(
            F.array().cast("array<bigint>").alias("tails"), F.array().cast("array<array<bigint>>").alias("before"))
        before = F.aggregate(pieces, zero, keep_tails, lambda s: s["before"])
        return F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), before.alias("tails")),
                                     lambda x: lengths(x["piece"], x["tails"])))

    starts = F.sequence(F.lit(1), F.greatest(F.size(heads), F.lit(1)), F.lit(PIECE))
    return let(F.transform(starts, lambda at: F.slice(heads, at, F.lit(PIECE))["num"]), run)


def _run_lines(heads: Column) -> Column:
    """Line numbers of a longest strictly increasing run of ``num`` in one type's headings.

    Ties: the run that ends first, and at each step the first predecessor that reaches the length. From the last
    length down, the first heading of a length whose number is below is that predecessor, so each is looked at once.
    """

    def walk_back(placed: Column, starts: Column) -> Column:
        def back(kept: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(placed))
            pile = F.slice(placed, F.get(starts, k) + 1, end - F.get(starts, k))
            last = F.get(kept, F.size(kept) - 1)["num"]
            return F.array_append(kept, F.get(F.filter(pile, lambda p: F.coalesce(p["num"] < last, F.lit(True))), F.lit(0)))

        none = F.array().cast("array<struct<len:int,at:int,num:bigint,line_no:int>>")
        return F.aggregate(F.sequence(F.size(starts) - 1, F.lit(0)), none, back, lambda kept: kept["line_no"])

    def piles(placed: Column) -> Column:
        new = F.transform(placed, lambda p, i: F.when((i == 0) | (F.get(placed, i - 1)["len"] != p["len"]), i))
        return let(F.array_compact(new), lambda starts: walk_back(placed, starts))

    def by_length(hs: Column, lengths: Column) -> Column:
        return F.array_sort(F.transform(hs, lambda h, i: F.struct(
            F.get(lengths, i).alias("len"), i.alias("at"), h["num"].alias("num"), h["line_no"].alias("line_no"))))

    def longest(hs: Column) -> Column:
        rising = F.aggregate(
            hs,
            F.struct(F.lit(-1).cast("bigint").alias("last"), F.lit(True).alias("ok")),
            lambda s, h: F.struct(h["num"].alias("last"), (s["ok"] & (h["num"] > s["last"])).alias("ok")),
            lambda s: s["ok"],
        )
        full = let(let(_run_lengths(hs), lambda lengths: by_length(hs, lengths)), piles)
        return F.when(rising, hs["line_no"]).otherwise(full)

    return let(heads, longest)


def longest_increasing_run(candidates: Column) -> Column:
    """The headings kept as chapter starts: per type, a longest increasing run of numbers."""

    def keep(cands: Column) -> Column:
        kept = F.flatten(
            F.transform(
                F.array_distinct(cands["type"]),
                lambda kind: _run_lines(F.filter(cands, lambda x: x["type"] == kind)),
            )
        )
        return let(_are_among(cands, kept), lambda real: F.filter(cands, lambda x, i: F.get(real, i)))

    return let(candidates, keep)


def judge_headings(candidates: Column) -> Column:
    """ARRAY<STRUCT<line_no, title, is_boundary>> of all candidates (with gap), in line order."""

    def judge(cands: Column) -> Column:
        kept = longest_increasing_run(dedup_headings(filter_by_gap(cands)))

        def mark(x: Column, real: Column) -> Column:
            title = F.when(real, clean_title(x["raw"]))
            return F.struct(x["line_no"].alias("line_no"), title.alias("title"), real.alias("is_boundary"))

        return let(
            _are_among(cands, F.transform(kept, lambda x: x["line_no"])),
            lambda real: F.transform(cands, lambda x, i: mark(x, F.get(real, i))),
        )

    return let(candidates, judge)


def headings(lines: Column) -> Column:
    """All heading candidates of the lines, judged."""
    return let(lines, lambda rows: judge_headings(body_gap(rows, heading_candidates(rows))))


def cut_regions(lines: Column, heads: Column) -> Column:
    """ARRAY<STRUCT<chapter_title, body>>: a region per chapter start, noise headings removed.

    Text before the first start is an untitled region; without any start the text stays as it is.
    """

    def region(title: Column, parts: Column) -> Column:
        body = strip(F.array_join(F.flatten(parts), "\n"))
        return F.struct(title.cast("string").alias("chapter_title"), body.alias("body"))

    def build(rows: Column, found: Column) -> Column:
        def stretch(head: Column, at: Column) -> Column:
            end = F.coalesce(F.get(found, at + 1)["line_no"], F.size(rows))
            first = head["line_no"] + F.when(head["is_boundary"], 0).otherwise(1)
            return F.struct(head["title"].alias("title"), F.slice(rows, first + 1, end - first).alias("part"))

        def cut(stretches: Column, at: Column) -> Column:
            lead = F.slice(rows, F.lit(1), F.get(found, F.lit(0))["line_no"])
            before = F.concat(F.array(lead), F.slice(stretches, F.lit(1), F.get(at, F.lit(0)))["part"])

            def chapter(pos: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(at, k + 1), F.size(stretches))
                return region(F.get(stretches, pos)["title"], F.slice(stretches, pos + 1, stop - pos)["part"])

            opened = F.concat(F.array(region(F.lit(None), before)), F.transform(at, chapter))
            return F.filter(opened, lambda r: r["body"] != "")

        starts = F.filter(
            F.transform(found, lambda h, i: F.when(h["is_boundary"], i)), lambda i: i.isNotNull()
        )
        whole = F.array(
            F.struct(F.lit(None).cast("string").alias("chapter_title"), F.array_join(rows, "\n").alias("body"))
        )
        return let(
            starts,
            lambda at: F.when(F.size(at) == 0, whole).otherwise(
                let(F.transform(found, stretch), lambda stretches: cut(stretches, at))
            ),
        )

    return let(lines, lambda rows: let(heads, lambda found: build(rows, found)))


def segment_chapters(text: Column) -> Column:
    """The regions of a text in one expression."""
    return let(F.split(text, "\n"), lambda rows: cut_regions(rows, headings(rows)))
