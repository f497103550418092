"""Column builders for untyped values: normalisation, numbers, clock times, flags, comparison.

A normalised value is a struct of kind (null, bool, num or str), num and txt, the text that comparisons
by equality use. All casts are tried ones, so no value raises, also with ANSI mode on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.text import SPACE, strip

#: Texts that mean a missing value, as they are written.
SENTINELS = ("", "-", "N/A", "n/a", "None", "null")
#: Units at the end of a value, of which one is dropped.
UNITS = r"(cm|kg|%|/h|/t|min\.|min|slag per minut|kg/m²|kPa)"
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
#: Fixed value: what dates look like.
_DATE = r"^([0-9]{1,4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,4})$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _number(text: Column) -> Column:
    """A number, of a text without white space at its ends."""
    number = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def to_number(text: Column) -> Column:
    """A number that is written out whole, with an exponent or underscores if need be; infinity and nan are no numbers."""
    return _number(strip(text))


def number_text(number: Column) -> Column:
    """Whole numbers without a fraction, others as they print."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e16)
    return F.when(whole, number.try_cast("decimal(20,0)").cast("string")).otherwise(number.cast("string"))


def _date_parts(text: Column) -> Column:
    """The three numbers of what looks like a date, as texts."""
    return F.when(text.rlike(_DATE), F.split(text, "[-/.]"))


def _date(parts: Column) -> Column:
    a, b, c = (parts[k] for k in range(3))
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(F.length(a) == 4, F.concat_ws("-", two(c), two(b), a)).when(F.length(c) == 4, F.concat_ws("-", two(a), two(b), c))


def rewritten_date(text: Column) -> Column:
    """Dates with a year of four digits as dd-mm-yyyy; null for other texts. The calendar isn't asked."""
    return let(_date_parts(text), _date)


def without_unit(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?iU){SPACE}*{UNITS}{SPACE}*$", ""))


def _with_point(bare: Column) -> Column:
    """A decimal comma as a point."""
    return F.when(bare.rlike("^-?[0-9]+,[0-9]+$"), F.replace(bare, F.lit(","), F.lit("."))).otherwise(bare)


def _value(raw: Column, jtype: Column, text: Column, clean: Column, number: Column, date: Column) -> dict:
    """kind, and num and txt as functions of it; ``text``: raw stripped, ``clean``: without its unit and with a decimal point, ``date``: its parts."""
    kind = (
        F.when(raw.isNull() | (jtype == "VOID"), "null")
        .when(jtype == "BOOLEAN", "bool")
        .when(jtype.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "json")
        .when(text.isin(*SENTINELS), "null")
        .when(number.isNotNull(), "num")
        .otherwise("str")
    )
    image = F.when(jtype.rlike(r"^DECIMAL\([0-9]+,0\)$") & ~raw.contains("."), F.concat(raw, F.lit(".0"))).otherwise(raw)
    return {
        "kind": kind,
        "num": lambda kind: F.when(kind == "json", raw.try_cast("double")).when(kind == "num", number),
        "txt": lambda kind: F.when(kind == "bool", F.lower(raw)).when(kind == "json", image).when(kind == "num", number_text(number)).when(kind == "str", F.coalesce(_date(date), F.lower(clean))),
    }


def with_normalized(rows: DataFrame, raw: str = "raw", jtype: str | None = None) -> DataFrame:
    """``rows`` with kind, num and txt, the normalised value of a leaf with text ``raw`` and type ``jtype`` (as flatten gives it; a string if missing).

    Null stays null, booleans and numbers keep their value. Of strings: white space and one unit at the end
    go, texts that mean nothing become null (before the unit goes), a decimal comma becomes a point, numbers
    become numbers, dates dd-mm-yyyy, the rest lower case. Columns of these three names are replaced.

    The steps are columns of their own, which the optimizer doesn't merge where they are used more than once.
    """
    kept = [F.col(c) for c in rows.columns if c not in ("kind", "num", "txt")]
    at = rows.select("*", strip(F.col(raw)).alias("_text"))
    at = at.withColumn("_clean", without_unit(F.col("_text"))).withColumn("_clean", _with_point(F.col("_clean")))
    at = at.withColumns({"_number": _number(F.col("_clean")), "_date": _date_parts(F.col("_clean"))})
    parts = _value(F.col(raw), F.lit("STRING") if jtype is None else F.col(jtype), *(F.col(c) for c in ("_text", "_clean", "_number", "_date")))
    kind = F.col("_kind")
    at = at.withColumn("_kind", parts["kind"])
    return at.select(*kept, F.when(kind == "json", "num").otherwise(kind).alias("kind"), parts["num"](kind).alias("num"), parts["txt"](kind).alias("txt"))


def normalized(raw: Column, jtype: Column | None = None) -> Column:
    """The value that with_normalized gives, as one column: a struct of kind, num and txt."""
    jtype = F.lit("STRING") if jtype is None else jtype

    def value(text: Column) -> Column:
        def of(s: Column) -> Column:
            parts = _value(raw, jtype, text, s["clean"], s["number"], s["date"])
            return let(parts["kind"], lambda kind: F.struct(F.when(kind == "json", "num").otherwise(kind).alias("kind"), parts["num"](kind).alias("num"), parts["txt"](kind).alias("txt")))

        clean = let(without_unit(text), _with_point)
        return let(let(clean, lambda c: F.struct(c.alias("clean"), _number(c).alias("number"), _date_parts(c).alias("date"))), of)

    return let(strip(raw), value)


def hms_to_minutes(text: Column) -> Column:
    """h:mm:ss to minutes with four decimals, h:mm to minutes, numbers as they are; null for other texts."""
    text = strip(text)
    part = lambda k: F.regexp_extract(text, r"^([0-9]+):([0-9]{2}):([0-9]{2})$", k).try_cast("double")
    short = lambda k: F.regexp_extract(text, r"^([0-9]+):([0-9]{2})$", k).try_cast("double")
    return F.coalesce(F.round(part(1) * 60 + part(2) + part(3) / 60, 4), short(1) * 60 + short(2), to_number(text))


def to_boolean(value: Column, kind: Column | None = None) -> Column:
    """Danish and English words for yes and no; numbers are true unless 0; null for the rest."""
    word = F.lower(strip(value))
    by_word = F.when(word.isin("ja", "yes", "true", "1", "j"), True).when(word.isin("nej", "no", "false", "0", "n"), False)
    return by_word if kind is None else F.when(kind == "num", to_number(value) != 0).otherwise(by_word)


def to_flag_text(value: Column, kind: Column) -> Column:
    """Booleans and whole numbers as ja or nej; other values as they are."""
    whole = (kind == "num") & value.rlike("^[+-]?[0-9]+$")
    truth = F.when(kind == "bool", F.lower(value) == "true").when(whole, to_number(value) != 0)
    return F.when(truth, "ja").when(~truth, "nej").otherwise(value)


def as_number(value: Column, kind: Column | None = None) -> Column:
    """The first number anywhere in a text, for range checks; booleans are 1 and 0."""
    text = F.replace(F.replace(strip(value), F.lit(","), F.lit(".")), F.lit("%"), F.lit(""))
    found = F.nullif(F.regexp_extract(text, r"[-+]?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")
    return found if kind is None else F.when(kind == "bool", F.when(F.lower(value) == "true", 1.0).otherwise(0.0)).otherwise(found)


#: Fixed value: what a lenient number drops.
_NOT_NUMERIC = r"[^0-9.\-]"


def lenient_number(value: Column) -> Column:
    """What is left of a text without all but digits, points and minus signs, if it is a number."""
    return to_number(F.regexp_replace(value, _NOT_NUMERIC, ""))


def tolerance_match(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """If two numbers differ by at most ``tolerance`` of the larger one; with a zero, by ``tolerance`` itself."""
    a, b = a.cast("double"), b.cast("double")
    gap = F.abs(a - b)
    near = F.when((a == 0) | (b == 0), gap <= tolerance).otherwise(F.try_divide(gap, F.greatest(F.abs(a), F.abs(b))) <= tolerance)
    return F.when(a.isNotNull() & b.isNotNull(), near)


def tokens(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), rf"(?U){SPACE}+"), lambda w: w != ""))


def token_f1(a: Column, b: Column) -> Column:
    """precision, recall and f1 of the words of ``b`` against those of ``a``. Two missing texts agree, one doesn't."""
    empty_a, empty_b = (F.coalesce(x, F.lit("")) == "" for x in (a, b))
    triple = lambda p, r, f: F.struct(p.cast("double").alias("precision"), r.cast("double").alias("recall"), f.cast("double").alias("f1"))
    one, zero = F.lit(1.0), F.lit(0.0)

    def of(n: Column) -> Column:
        p, r = F.try_divide(n["both"], n["b"]), F.try_divide(n["both"], n["a"])
        return F.when(empty_a & empty_b, triple(one, one, one)).when(empty_a | empty_b | (n["both"] == 0), triple(zero, zero, zero)).otherwise(triple(p, r, F.try_divide(2 * p * r, p + r)))

    words = F.struct(tokens(a).alias("a"), tokens(b).alias("b"))
    return let(let(words, lambda w: F.struct(F.size(F.array_intersect(w["a"], w["b"])).cast("double").alias("both"), F.size(w["a"]).alias("a"), F.size(w["b"]).alias("b"))), of)


def response_json(raw: Column) -> Column:
    """The JSON object in a model's response: without a code fence, from the first brace to the last; null without braces."""
    text = strip(raw)
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    body = F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)
    first, last = F.locate("{", body), F.length(body) - F.locate("}", F.reverse(body)) + 1
    return F.when((first > 0) & (F.locate("}", body) > 0) & (last > first), F.substring(body, first, last - first + 1))
