"""Colour columns. Stored form is text "r,g,b,a" with parts in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour shown for a user without one, default of a new user,
# colour of an unknown login, line colour of last resort, series palette.
NO_COLOUR_CSS = "rgba(47, 47, 47, 1)"
NEW_USER_COLOUR = "0.5,0.5,0.5,1"
NO_LOGIN_COLOUR = "rgba(1,1,1,0)"
FALLBACK_HEX = "#000000"
PALETTE = [
    "#66C2A5",
    "#FC8D62",
    "#8DA0CB",
    "#E78AC3",
    "#A6D854",
    "#FFD92F",
    "#E5C494",
    "#B3B3B3",
]


def _part(stored: Column, i: int) -> Column:
    return F.trim(F.get(F.split(stored, ","), F.lit(i))).try_cast("double")


def _all_numeric(stored: Column) -> Column:
    parts = F.split(stored, ",")
    return F.forall(parts, lambda p: F.trim(p).try_cast("double").isNotNull())


def _hex_pair(channel: Column) -> Column:
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.bround(channel * 255, 0).cast("int")))
    return F.lpad(F.lower(F.hex(level)), 2, "0")


def is_colour(stored: Column) -> Column:
    """True when the text holds at least three numbers and nothing but numbers."""
    return (F.size(F.split(stored, ",")) >= 3) & _all_numeric(stored)


def to_hex(stored: Column) -> Column:
    """`#rrggbb`, channels rounded half to even and clamped; NULL for a bad or missing colour."""
    pairs = [_hex_pair(_part(stored, i)) for i in range(3)]
    return F.when(is_colour(stored), F.concat(F.lit("#"), *pairs))


def to_css(stored: Column) -> Column:
    """`rgba(R, G, B, a)`, channels cut off towards zero, grey when there is no colour."""
    channels = [F.floor(_part(stored, i) * 255).cast("string") for i in range(3)]
    body = F.concat_ws(", ", *channels, _part(stored, 3).cast("string"))
    css = F.when(
        is_colour(stored) & _part(stored, 3).isNotNull(),
        F.concat(F.lit("rgba("), body, F.lit(")")),
    )
    return F.when(stored.isNull(), F.lit(NO_COLOUR_CSS)).otherwise(css)


def is_hex(text: Column) -> Column:
    return F.regexp_like(text, F.lit("^#*[0-9A-Fa-f]{6}$"))


def from_hex(text: Column) -> Column:
    """Stored form of a picked `#rrggbb`, three decimals, full alpha; NULL when it is no such text."""
    digits = F.regexp_replace(text, "^#+", "")
    channels = [
        F.round(F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("double") / 255, 3).cast("string")
        for i in range(3)
    ]
    return F.when(is_hex(text), F.concat_ws(", ", *channels, F.lit("1.0")))
