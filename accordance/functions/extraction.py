"""Column builders for the value rules of report extraction: usable without a model, and to check one's answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordance.functions.text import strip
from accordance.functions.values import to_number

# Old names of sleep stages and where they go; stage 4 goes nowhere.
LEGACY_STAGES = {"S1": "n1", "S2": "n2", "S3": "n3", "REM": "rem"}


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def missing_to_null(c: Column) -> Column:
    """A lone dash or nothing is a missing value."""
    return F.when(~strip(c).isin("-", ""), c)


def plain_number(c: Column) -> Column:
    """A number without its per cent sign and with a decimal point."""
    return to_number(F.replace(F.replace(c, F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))


def first_date(c: Column) -> Column:
    """The first of two dates, with the year of the second: ``25/9 - 26/9 2007`` is ``25/9 2007``."""
    pattern = r"^\s*([0-9]{1,2}/[0-9]{1,2})(?:\s*[-–]\s*[0-9]{1,2}/[0-9]{1,2})?\s+([0-9]{4})\s*$"
    return F.when(c.rlike(pattern), F.concat_ws(" ", _group(c, pattern, 1), _group(c, pattern, 2))).otherwise(strip(c))


def clock_time(c: Column) -> Column:
    """The clock time of a text that may begin with a date."""
    return _group(c, r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)")


def start_and_end(c: Column) -> Column:
    """A range ``start-end`` as a struct of start and end; the end is null without a dash."""
    return F.struct(strip(_group(c, r"^([^-–]+)")).alias("start"), strip(_group(c, r"[-–](.+)$")).alias("end"))


def minutes(c: Column) -> Column:
    """Clock durations as they are, ``461 min`` as the number."""
    c = strip(c)
    return F.when(c.rlike(r"^[0-9]+:[0-9]{2}(:[0-9]{2})?$"), c).otherwise(F.coalesce(_group(c, r"(?i)^([0-9]+(?:[.,][0-9]+)?)\s*min\.?$"), c))


def total_and_index(c: Column) -> Column:
    """``117 (24,1)`` as a struct of total and index; a lone number is the total."""
    both = r"^\s*([0-9.,]+)\s*\(\s*([0-9.,]+)\s*\)\s*$"
    return F.struct(
        plain_number(F.coalesce(_group(c, both, 1), _group(c, r"^\s*([0-9.,]+)\s*$"))).alias("total"),
        plain_number(_group(c, both, 2)).alias("index"),
    )


def mean_of_spread(c: Column) -> Column:
    """``82 +/- 5`` as 82."""
    return plain_number(_group(c, r"^\s*([0-9.,]+)"))


def stage_percentage(stage: Column, duration: Column, percentage: Column) -> Column:
    """No share for waking; 0 for a third stage of no minutes."""
    return F.when(F.lower(stage) == "vaagen", None).when((F.lower(stage) == "n3") & (duration == 0), 0.0).otherwise(percentage)


def modern_stage(stage: Column) -> Column:
    """n1, n2, n3 or rem for an old name; null for stage 4 and others."""
    names = F.create_map(*(F.lit(x) for pair in LEGACY_STAGES.items() for x in pair))
    return F.try_element_at(names, F.upper(strip(stage)))


def personal_number(c: Column) -> Column:
    """A personal number of the form DDMMYY-XXXX, else null."""
    return _group(c, r"(?<![0-9])([0-9]{6}-[0-9]{4})(?![0-9])")


def check_box(c: Column) -> Column:
    """``Ja: X`` is true, ``Nej: X`` false; prose and two crosses say nothing."""
    yes, no = c.rlike(r"(?i)\bja\s*:\s*x\b"), c.rlike(r"(?i)\bnej\s*:\s*x\b")
    return F.when(yes & ~no, True).when(no & ~yes, False)


def no_apnoea(c: Column) -> Column:
    """If a text says that there are none: its empty respiration fields are 0 then."""
    return F.coalesce(c.rlike(r"(?i)\b(0|ingen)\s+(apn[øo]|hypopn[øo])"), F.lit(False))


def zero_if_none(value: Column, none: Column) -> Column:
    """An empty respiration field as 0 where a text says that there are none."""
    return F.coalesce(value, F.when(none, 0.0))


def low_saturation_row(rows: Column) -> Column:
    """Of rows with a band, duration and percent, the one of the band 88-90 %."""
    return F.try_element_at(F.filter(rows, lambda r: F.replace(F.replace(r["band"], F.lit(" "), F.lit("")), F.lit("–"), F.lit("-")).rlike(r"^88-90%?$")), F.lit(1))


def diagnosis(c: Column) -> Column:
    """``code/text`` as a struct of code and text, which is null if missing."""
    return F.struct(
        F.nullif(strip(F.split_part(c, F.lit("/"), F.lit(1))), F.lit("")).alias("code"),
        F.nullif(strip(F.regexp_extract(c, r"(?s)^[^/]*/(.*)$", 1)), F.lit("")).alias("text"),
    )
