"""Normalization of running text, in the order a document goes through it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SP, WS, collapse_spaces, let, none_if_empty, strip, words

# --- fixed values ---------------------------------------------------------------------------
PROSE_MIN_CHARS = 60
REFERENCES_TAIL = 0.7
TITLE_MAX_CHARS = 96
BANNER_START = rf"\*\*\*{SP}*START{SP}+OF{SP}+TH(?:E|IS){SP}+PROJECT{SP}+GUTENBERG.*?\*\*\*"
BANNER_END = rf"\*\*\*{SP}*END{SP}+OF{SP}+TH(?:E|IS){SP}+PROJECT{SP}+GUTENBERG.*?\*\*\*"
CONTENTS_LINE = rf"(?i)^(?:table{SP}+of{SP}+)?contents{SP}*[.,:;]*\z"
REFERENCES_LINE = r"(?i)^(?:references|bibliography|works cited)\.?\z"
CITATION = rf"\[\p{{Nd}}+(?:{SP}*[,–-]{SP}*\p{{Nd}}+)*\]"
# The first character is looked for in a plain class, before word boundaries and case folding are tried.
URL = rf"(?=[hHdD1])(?iU)(?:https?://[^{WS}]+|\bdoi:{SP}*[^{WS}]+|\b10\.\p{{Nd}}{{4,}}/[^{WS}]+)"
# what stands before the last dot, its characters, the last two in upper case (None: any others), spoken form
ABBREVIATIONS = (
    (r"e\.g", 3, ".G", "for example"),
    (r"i\.e", 3, ".E", "that is"),
    ("et al", 5, "AL", "and colleagues"),
    ("cf", 2, "CF", "compare"),
    ("Fig", 3, None, "Figure"),  # its i may be one without a dot, or with one in upper case
    ("vs", 2, "VS", "versus"),
)
# the last dot of an abbreviation; what is before it is looked at from dots only
ABBREVIATION_DOT = rf"\.(?iU)(?<=\b(?:{'|'.join(a[0] for a in ABBREVIATIONS)})\.)"
# what lower() leaves of letters that a case-blind pattern takes for i or s
ODD_CASE = ("ı", "\u0307", "ſ")
ROMAN_HUNDREDS = ("c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm")
ROMAN_TENS = ("x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
ROMAN_UNITS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
ROMAN = r"(m*)(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"
# --------------------------------------------------------------------------------------------

_WORD_PUNCTUATION = r"[.,:;()\[\]*]*"
_ROMAN_WORD = rf"(?i)^{_WORD_PUNCTUATION}(?=[ivxlcdm]){ROMAN}{_WORD_PUNCTUATION}\z"


def _nfkc_udf():
    # Defined inside a function so that it travels to the executors by value.
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(normalize, T.StringType())


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Spark has no such function; every row crosses to Python, ASCII texts as a null.

    ``c`` should be a plain column: an expression is evaluated for the test, the call and the fallback.
    """
    return F.coalesce(_nfkc_udf()(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def _where(test: Callable[[Column], Column], c: Column, change: Callable[[Column], Column]) -> Column:
    """Run a costly pattern only on texts that pass a plain substring test."""
    return let(c, lambda t: F.when(test(t), change(t)).otherwise(t))


def _has_odd_case(t: Column) -> Column:
    return t.contains(ODD_CASE[0]) | t.contains(ODD_CASE[1]) | t.contains(ODD_CASE[2])


def strip_banners(c: Column) -> Column:
    """Keep what follows the first START banner and precedes the first END banner."""
    return _where(
        lambda t: t.contains("***"),
        c,
        lambda t: F.regexp_replace(
            F.regexp_replace(t, rf"(?is)\A.*?{BANNER_START}", ""), rf"(?is){BANNER_END}.*\z", ""
        ),
    )


def is_prose_line(c: Column) -> Column:
    """Long, with lower case, not ending in a digit, at most one free-standing short number."""
    return let(
        strip(c),
        lambda s: (F.length(s) >= PROSE_MIN_CHARS)
        & s.rlike(r"\p{Ll}")
        & ~s.rlike(r"\p{Nd}\z")
        & (F.regexp_count(s, F.lit(r"(?U)\b\p{Nd}{1,3}\b")) <= 1),
    )


def strip_front_matter(c: Column) -> Column:
    """Drop from a Contents line near the top up to the first of two consecutive prose lines."""

    def cut(text: Column, lines: Column) -> Column:
        n = F.size(lines)
        top = F.slice(lines, F.lit(1), F.greatest(F.lit(1), (n / 6).cast("int")))
        contents = F.array_position(F.transform(top, lambda x: strip(x).rlike(CONTENTS_LINE)), True)

        def from_body(at: Column) -> Column:
            prose = F.transform(F.slice(lines, at + 1, n), is_prose_line)
            pairs = let(
                prose,
                lambda p: F.zip_with(
                    p, F.slice(p, F.lit(2), n), lambda a, b: a & F.coalesce(b, F.lit(False))
                ),
            )
            return let(
                F.array_position(pairs, True),
                lambda body: F.when(body == 0, text).otherwise(
                    F.array_join(
                        F.concat(F.slice(lines, F.lit(1), at - 1), F.slice(lines, at + body, n)), "\n"
                    )
                ),
            )

        return let(
            contents.cast("int"), lambda at: F.when(at == 0, text).otherwise(from_body(at))
        )

    return let(c, lambda text: let(F.split(text, "\n"), lambda lines: cut(text, lines)))


def strip_references(c: Column) -> Column:
    """Cut at the first references-only line whose match begins in the last 30% of the text.

    The match of such a line begins at the blank lines before it, as far as an earlier match has
    not used them up; the fold keeps that start while it walks over the lines.
    """

    def cut(text: Column) -> Column:
        floor = F.length(text) * F.lit(REFERENCES_TAIL)
        zero = F.struct(
            F.lit(0).alias("at"),
            F.lit(None).cast("int").alias("blank_from"),
            F.lit(False).alias("after_heading"),
            F.lit(None).cast("int").alias("cut"),
        )

        def step(state: Column, line: Column) -> Column:
            def on_line(s: Column) -> Column:
                blank, heading = s == "", s.rlike(REFERENCES_LINE)
                start = F.coalesce(state["blank_from"], state["at"])
                free = F.when(line == "", state["at"])
                return F.struct(
                    (state["at"] + F.length(line) + 1).alias("at"),
                    F.when(blank, F.when(state["after_heading"], free).otherwise(start)).alias("blank_from"),
                    F.when(blank, state["after_heading"]).otherwise(heading).alias("after_heading"),
                    F.coalesce(state["cut"], F.when(heading & (start >= floor), start)).alias("cut"),
                )

            return let(strip(line), on_line)

        found = F.aggregate(F.split(text, "\n"), zero, step, lambda state: state["cut"])
        return let(found, lambda at: F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at)))

    def mentioned(low: Column) -> Column:
        return low.contains("references") | low.contains("bibliography") | low.contains("works cited")

    return let(c, lambda text: F.when(let(F.lower(text), mentioned), cut(text)).otherwise(text))


def strip_citations(c: Column) -> Column:
    return _where(lambda t: t.contains("["), c, lambda t: F.regexp_replace(t, CITATION, ""))


def strip_urls(c: Column) -> Column:
    def suspect(t: Column) -> Column:
        low = F.lower(t)
        return t.contains("://") | t.contains("10.") | low.contains("doi:") | _has_odd_case(low)

    return _where(suspect, c, lambda t: F.regexp_replace(t, URL, ""))


def expand_abbreviations(c: Column) -> Column:
    """Spoken forms, in the fixed order. No replacement spells a later abbreviation.

    One pass cuts the text after each abbreviation, then the last two characters of a part tell which. Order matters
    where another word follows one without a blank (e.g.cf.); such texts take the patterns one by one.
    """

    def in_order(t: Column) -> Column:
        for stem, _, _, spoken in ABBREVIATIONS:
            t = F.regexp_replace(t, rf"(?iU)\b{stem}\.", spoken)
        return t

    def expand(part: Column) -> Column:
        def end(last: Column) -> Column:
            forms = {tail: F.concat(F.substring(part, F.lit(1), F.length(part) - n), F.lit(spoken))
                     for _, n, tail, spoken in ABBREVIATIONS}
            found = forms.pop(None)
            for tail, form in forms.items():
                found = F.when(last == tail, form).otherwise(found)
            return found

        return let(F.upper(F.substring(part, -2, 2)), end)

    def join(t: Column, parts: Column) -> Column:
        n = F.size(parts)
        glued = F.exists(F.slice(parts, 2, n), lambda p: F.substring(p, 1, 1).rlike(r"(?U)\w"))
        spoken = F.transform(parts, lambda p, i: F.when(i == n - 1, p).otherwise(expand(p)))
        return F.when(n <= 1, t).when(glued, in_order(t)).otherwise(F.array_join(spoken, ""))

    return let(c, lambda t: let(F.split(t, ABBREVIATION_DOT), lambda parts: join(t, parts)))


def normalize_text(c: Column) -> Column:
    """The whole cleanup of one document, one map-only projection."""
    c = nfkc(c)
    for step in (strip_banners, strip_front_matter, strip_references, strip_citations, strip_urls):
        c = step(c)
    return expand_abbreviations(c)


def chapter_number(c: Column) -> Column:
    """Arabic or canonical roman number as BIGINT, null for anything else."""

    def value(s: Column) -> Column:
        def digit(group: int, scale: int, table: tuple[str, ...]) -> Column:
            found = F.regexp_extract(s, f"^{ROMAN}\\z", group)
            return F.array_position(F.array(*map(F.lit, table)), found) * scale

        roman = (
            F.length(F.regexp_extract(s, f"^{ROMAN}\\z", 1)) * 1000
            + digit(2, 100, ROMAN_HUNDREDS)
            + digit(3, 10, ROMAN_TENS)
            + digit(4, 1, ROMAN_UNITS)
        )
        return F.when(s.rlike(r"^[0-9]+\z"), s.try_cast("bigint")).when(
            s.rlike(f"^(?=[ivxlcdm]){ROMAN}\\z"), roman.cast("bigint")
        )

    return let(F.lower(strip(c)), value)


def restore_romans(c: Column) -> Column:
    """Upper-case the words that are canonical roman numbers; single blanks between words."""
    return F.array_join(
        F.transform(words(c), lambda w: F.when(w.rlike(_ROMAN_WORD), F.upper(w)).otherwise(w)), " "
    )


def smart_titlecase(c: Column) -> Column:
    """Title case after every non-letter (initcap starts words at blanks only), romans kept upper."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    titled = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
    )
    return restore_romans(F.array_join(titled, ""))


def clean_title(c: Column, max_chars: int = TITLE_MAX_CHARS) -> Column:
    """One-line label: blanks collapsed, end dots dropped, cut at a word beyond ``max_chars`` characters."""
    flat = F.rtrim(strip(collapse_spaces(c)), F.lit("."))
    head = F.substring(flat, 1, max_chars)
    short = F.concat(F.regexp_replace(head, r" [^ ]*\z", ""), F.lit("…"))
    return restore_romans(F.when(F.length(flat) > max_chars, short).otherwise(flat))


__all__ = [
    "nfkc", "strip_banners", "is_prose_line", "strip_front_matter", "strip_references",
    "strip_citations", "strip_urls", "expand_abbreviations", "normalize_text", "chapter_number",
    "restore_romans", "smart_titlecase", "clean_title", "none_if_empty",
]
