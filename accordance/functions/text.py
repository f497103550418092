"""Column builders for report text: white space, line classes, display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as it is stripped from both ends of values and lines: Unicode's and the four separators.
SPACE = r"[\s\x1c-\x1f]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Characters of typeset reports and what plain text has for them.
REPLACEMENTS = {
    "µ": "u",
    "±": "+/-",
    "–": "-",
    "—": "-",
    "’": "'",
    "“": '"',
    "”": '"',
    "°": " grader",
    "≥": ">=",
    "≤": "<=",
    "×": "x",
}


def strip(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.btrim(c, F.lit(_SPACES))


def plain_characters(c: Column) -> Column:
    """Typographic characters replaced by plain ones."""
    one = {k: v for k, v in REPLACEMENTS.items() if len(v) == 1}
    c = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in REPLACEMENTS.items():
        if k not in one:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def normalize_report(c: Column, keep_newlines: bool = True) -> Column:
    """White space to single blanks, control characters removed, ends stripped.

    Line ends stay unless ``keep_newlines`` is off; then they are removed like other control characters,
    so that words at line ends fuse.
    """
    c = F.regexp_replace(c, r"(?U)[^\S\n]|[\x1c-\x1f]", " ")
    c = F.regexp_replace(c, r"[\x00-\x09\x0b-\x1f\x7f-\x9f]" if keep_newlines else r"[\x00-\x1f\x7f-\x9f]", "")
    return strip(F.regexp_replace(c, " {2,}", " "))


def normalize_clean(c: Column) -> Column:
    """White space but line ends to single blanks, three or more line ends to two, ends stripped."""
    c = F.regexp_replace(c, r"(?U)[^\S\n]|[\x1c-\x1f]", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, " +", " "), r"\n{3,}", "\n\n"))


def has_letters(c: Column) -> Column:
    return c.rlike("[a-zA-ZæøåÆØÅ]")


def is_numeric_line(c: Column) -> Column:
    return c.rlike(rf"(?U)^(?:[\d.,]|{SPACE})+$")


def should_deduplicate(c: Column) -> Column:
    """If a line is metadata (letters and a colon) and not a measurement (minutes, per cent, only numbers)."""
    low = F.lower(strip(c))
    return ~low.contains("min") & ~low.contains("%") & ~is_numeric_line(low) & has_letters(low) & low.contains(":")


def shortened(c: Column, longest: int = 46) -> Column:
    """Long labels as an ellipsis and their end."""
    return F.when(F.length(c) > longest, F.concat(F.lit("…"), F.right(c, F.lit(longest - 1)))).otherwise(c)


def last_segments(c: Column, n: int = 1) -> Column:
    return F.substring_index(c, ".", -n)


def file_label(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("output-"), F.lit("")), F.lit(".json"), F.lit(""))


def first_number(c: Column) -> Column:
    """The first run of digits as a number; null if there is none or it is too large."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit("")).try_cast("bigint")


def progress_bar(c: Column, cells: int = 30) -> Column:
    """A score from 0 to 1 as filled and empty cells."""
    filled = F.greatest(F.lit(0), F.least(F.lit(cells), F.floor(F.coalesce(c, F.lit(0.0)) * cells).cast("int")))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(cells) - filled))


def traffic_light(rate: Column) -> Column:
    """green from .75, yellow from .5, red below, grey without a rate."""
    return F.when(rate.isNull(), "grey").when(rate >= 0.75, "green").when(rate >= 0.5, "yellow").otherwise("red")


def symbol(rate: Column) -> Column:
    """As traffic_light, as a sign; what lies outside 0 to 1.01 has the sign of no rate."""
    return F.when((rate >= 0) & (rate < 0.5), "🔴").when((rate >= 0.5) & (rate < 0.75), "🟡").when((rate >= 0.75) & (rate < 1.01), "🟢").otherwise("⚪")
