"""Field by field comparison of paired records.

Both sides are long tables with pair_id, path, kind, num and txt (a path once a record). A missing path
equals null. Values are compared by the type of their field: free text by the F1 of its words, numbers by
equality and tolerance, the rest by equality of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.fields import field_type, is_skipped, topic
from accordance.functions.values import to_number, token_f1, tolerance_match
from accordance.operators.dealing import dealt


def aligned(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("pair_id",), rows: int | None = None) -> DataFrame:
    """keys, path, and kind, num and txt of both sides (l_ and r_) of every path that either has; skipped paths go.

    ``rows``: about how many both sides have. The join is dealt to as many tasks as hold them, by the session without it.
    """
    sides = [
        side.where(~is_skipped(F.col("path"))).select(*keys, "path", *(F.col(c).alias(f"{p}_{c}") for c in ("kind", "num", "txt")))
        for side, p in ((left, "l"), (right, "r"))
    ]
    left, right = (dealt(side, rows, *keys, "path") for side in sides)
    both = left.join(right, [*keys, "path"], "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit("null")) for c in ("l_kind", "r_kind")})


def _numeric() -> Column:
    """If either side holds a number or a boolean."""
    return F.col("l_kind").isin("num", "bool") | F.col("r_kind").isin("num", "bool")


def _strict(side: str) -> Column:
    """A value as a number where it is one, with a decimal comma if need be; booleans are none. To be a column, since it is used often."""
    return F.when(F.col(f"{side}_kind") != "bool", F.coalesce(f"{side}_num", to_number(F.replace(F.col(f"{side}_txt"), F.lit(","), F.lit(".")))))


def _image(side: str) -> Column:
    return F.lower(F.trim(F.col(f"{side}_txt")))


def compare_fields(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("pair_id",), tolerance: float = 0.05, least_f1: float = 0.8, rows: int | None = None) -> DataFrame:
    """status, agrees, f1, tolerance and deviation of every field of every pair, with its topic and type.

    status: filled, left_missing, right_missing or both_missing, which isn't compared (agrees is null); a
    value missing on one side disagrees. Free text agrees from an F1 of ``least_f1`` on. Numbers agree if
    equal, and have a tolerance match and their difference; where one can't be read, texts are compared.
    ``rows``: see aligned.
    """
    rows = aligned(left, right, keys, rows).withColumns({"field_type": field_type(F.col("path"), _numeric()), "_a": _strict("l"), "_b": _strict("r")})
    no_l, no_r = F.col("l_kind") == "null", F.col("r_kind") == "null"
    status = F.when(no_l & no_r, "both_missing").when(no_l, "left_missing").when(no_r, "right_missing").otherwise("filled")
    filled = F.col("status") == "filled"
    a, b = F.col("_a"), F.col("_b")
    numbers = filled & (F.col("field_type") == "numeric") & a.isNotNull() & b.isNotNull()
    rows = rows.withColumns({"topic": topic(F.col("path")), "status": status})
    rows = rows.withColumn("f1", F.when(filled & (F.col("field_type") == "free_text"), token_f1(F.col("l_txt"), F.col("r_txt"))["f1"]))
    agrees = (
        F.when(F.col("status") == "both_missing", None)
        .when(~filled, False)
        .when(F.col("field_type") == "free_text", F.col("f1") >= least_f1)
        .when(numbers, a == b)
        .otherwise(_image("l") == _image("r"))
    )
    return rows.select(
        *keys, "path", "topic", "field_type", "status",
        agrees.alias("agrees"), "f1",
        F.when(numbers, tolerance_match(a, b, tolerance)).alias("tolerance"),
        F.when(numbers, F.round(F.abs(a - b), 4)).alias("deviation"),
        F.col("l_txt").alias("left_value"), F.col("r_txt").alias("right_value"),
    )


def score_fields(model: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("model", "pair_id"), tolerance: float = 0.05, rows: int | None = None) -> DataFrame:
    """A score from 0 to 1 of every field of every pair of a model's record (left) and the truth (right).

    Null where the truth is missing; 0 where only the model's value is. Free text: F1 to three decimals.
    Numbers: 1 if equal, .7 within the tolerance, else 0. The rest: 1 if equal, else 0. ``rows``: see aligned.
    """
    rows = aligned(model, truth, keys, rows).withColumns({"field_type": field_type(F.col("path"), _numeric()), "_a": _strict("l"), "_b": _strict("r")})
    no_m, no_t = F.col("l_kind") == "null", F.col("r_kind") == "null"
    a, b = F.col("_a"), F.col("_b")
    numbers = (F.col("field_type") == "numeric") & a.isNotNull() & b.isNotNull()
    score = (
        F.when(no_t, None)
        .when(no_m, 0.0)
        .when(F.col("field_type") == "free_text", F.round(token_f1(F.col("l_txt"), F.col("r_txt"))["f1"], 3))
        .when(numbers, F.when(a == b, 1.0).when(tolerance_match(a, b, tolerance), 0.7).otherwise(0.0))
        .otherwise(F.when(_image("l") == _image("r"), 1.0).otherwise(0.0))
    )
    return rows.select(*keys, "path", topic(F.col("path")).alias("topic"), "field_type", score.alias("score"), no_m.alias("model_missing"), no_t.alias("truth_missing"))
