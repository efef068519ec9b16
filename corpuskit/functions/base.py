"""Small building blocks shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Unicode counts as white space (str.isspace), as a regex class body.
# Java's \s knows ASCII only, so every pattern here spells the class out.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same as a class of its own: letters fail the two outer ranges before the list is tried.
SP = rf"[\x00-\x20\x85-\x{{3000}}&&[{WS}]]"
_WS_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WS_CHARS = "".join(map(chr, _WS_CODES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    A column that a lambda refers to is evaluated again for every array element once Catalyst has
    collapsed the projections, so arrays used inside lambdas are always bound this way first.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Remove surrounding white space of any kind; the SQL trim removes blanks only."""
    return F.trim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    """The white-space separated tokens, without empty ones."""
    return F.filter(F.split(c, f"{SP}+"), lambda w: w != "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{SP}+", " ")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
