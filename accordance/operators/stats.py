"""Statistics of comparisons and scores, by field, topic, model and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(a: str | Column, b: str | Column, digits: int = 3) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.round(F.try_divide(a, b), digits)


def mean_of_rounded(c: str | Column, digits: int = 3) -> Column:
    """The mean of numbers of so many decimals, rounded half up to as many: sums of whole numbers, so no order of rows matters."""
    c = F.col(c) if isinstance(c, str) else c
    total, n = F.sum(F.round(c * 10**digits).cast("long")), F.count(c)
    return F.floor(F.try_divide((2 * total + n).cast("decimal(38,0)"), (2 * n).cast("decimal(20,0)"))).cast("double") / 10**digits


def field_stats(compared: DataFrame, order: str | None = None) -> DataFrame:
    """Counters and rates of each path over all pairs.

    ``order``: a column by which the last pair decides a field's type, which can differ between pairs;
    without it the smallest type name does. Rates are null where nothing was compared.
    """
    kind = F.max_by("field_type", order) if order else F.min("field_type")
    counts = compared.groupBy("path").agg(
        kind.alias("field_type"),
        F.min("topic").alias("topic"),
        F.count("agrees").alias("n_compared"),
        F.count_if("agrees").alias("n_agree"),
        F.count_if(~F.col("agrees")).alias("n_disagree"),
        F.count_if(F.col("status") == "left_missing").alias("n_left_missing"),
        F.count_if(F.col("status") == "right_missing").alias("n_right_missing"),
        F.count_if(F.col("status") == "both_missing").alias("n_both_missing"),
        F.coalesce(F.sum(F.round("f1", 3)), F.lit(0.0)).alias("f1_sum"),
        F.count("f1").alias("f1_n"),
        F.count_if("tolerance").alias("n_tolerance"),
        F.count("tolerance").alias("tolerance_n"),
        F.round(F.avg("deviation"), 4).alias("mean_deviation"),
    )
    return counts.withColumns({
        "agreement_rate": _rate("n_agree", "n_compared"),
        "disagreement_rate": _rate("n_disagree", "n_compared"),
        "mean_f1": _rate("f1_sum", "f1_n"),
        "tolerance_rate": _rate("n_tolerance", "tolerance_n"),
    })


_SUMS = ("n_compared", "n_agree", "n_disagree", "n_left_missing", "n_right_missing", "n_both_missing", "f1_sum", "f1_n")


def topic_stats(fields: DataFrame) -> DataFrame:
    """The sums of the fields' counters for each topic, and their rates; fields that nobody filled count in n_fields."""
    sums = fields.groupBy("topic").agg(F.count("*").alias("n_fields"), *(F.sum(c).alias(c) for c in _SUMS))
    return sums.withColumns({"agreement_rate": _rate("n_agree", "n_compared"), "mean_f1": _rate("f1_sum", "f1_n")})


def grand_totals(fields: DataFrame) -> DataFrame:
    """One row over all fields: sums, percentages to one decimal, and the mean of the fields' mean F1."""
    sums = fields.agg(F.count("*").alias("n_fields"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS if not c.startswith("f1")), mean_of_rounded("mean_f1").alias("mean_f1"))
    percent = lambda c: F.round(F.try_divide(100 * F.col(c), F.col("n_compared")), 1)
    return sums.withColumns({"agree_percent": percent("n_agree"), "disagree_percent": percent("n_disagree")})


def rollup_stats(compared: DataFrame) -> DataFrame:
    """Counters by field, by topic and over all, from one pass; topic or path is null in the rows above it, and level says which."""
    sums = compared.rollup("topic", "path").agg(F.grouping_id().alias("gid"), F.count("agrees").alias("n_compared"), F.count_if("agrees").alias("n_agree"))
    level = F.when(F.col("gid") == 0, "field").when(F.col("gid") == 1, "topic").otherwise("total")
    return sums.select(level.alias("level"), "topic", "path", "n_compared", "n_agree", _rate("n_agree", "n_compared").alias("agreement_rate"))


def by_disagreement(fields: DataFrame, n: int | None = None) -> DataFrame:
    """Fields with any disagreement, the most first, of these the ones with the lowest rate, then by path."""
    out = fields.where("n_disagree > 0").orderBy(F.desc("n_disagree"), F.coalesce("agreement_rate", F.lit(1.0)), "path")
    return out if n is None else out.limit(n)


def worst_topics(topics: DataFrame, zero_last: bool = False) -> DataFrame:
    """Topics by agreement rate, those without one last. ``zero_last``: a rate of 0 sorts as 1, as older reports had it."""
    rate = F.coalesce("agreement_rate", F.lit(1.0))
    return topics.orderBy(F.when(rate == 0, 1.0).otherwise(rate) if zero_last else rate, "topic")


def worst_texts(fields: DataFrame) -> DataFrame:
    """Free text fields by mean F1."""
    return fields.where("field_type = 'free_text'").orderBy(F.coalesce("mean_f1", F.lit(1.0)), "path")


def needs_detail(fields: DataFrame) -> DataFrame:
    """Fields that disagree twice or in more than half of all pairs."""
    return fields.where((F.col("n_disagree") >= 2) | (F.col("agreement_rate") < 0.5))


def always_missing(fields: DataFrame, n_pairs: int, side: str = "left") -> DataFrame:
    """Fields that one side never fills where the other does."""
    return fields.where(F.col(f"n_{side}_missing") == n_pairs)


def perfect(fields: DataFrame) -> DataFrame:
    """Fields whose rounded rate is 1."""
    return fields.where("agreement_rate = 1.0")


def model_field_stats(scores: DataFrame) -> DataFrame:
    """model, path: records, mean score to three decimals (null if the truth never has the field), missing counts."""
    return scores.groupBy("model", "path").agg(
        F.min("topic").alias("topic"),
        F.count("*").alias("n"),
        F.count("score").alias("n_scored"),
        F.count_if(F.col("model_missing") & ~F.col("truth_missing")).alias("n_missing"),
        F.count_if(F.col("model_missing") & F.col("truth_missing")).alias("n_both_missing"),
        mean_of_rounded("score").alias("mean_score"),
    )


def model_topic_stats(scores: DataFrame) -> DataFrame:
    """model, topic: mean over records; topics without a score keep a row."""
    return scores.groupBy("model", "topic").agg(F.count("score").alias("n_scored"), mean_of_rounded("score").alias("mean_score"))


def model_totals(fields: DataFrame) -> DataFrame:
    """model and score: the mean of the fields' rounded means, to three decimals."""
    return fields.groupBy("model").agg(mean_of_rounded("mean_score").alias("score"))


def ranked(totals: DataFrame, models: list[str] | None = None) -> DataFrame:
    """totals with rank from 1, the highest score first; no score counts as 0; ties by the order of ``models``, else by name."""
    order = F.array_position(F.array(*(F.lit(m) for m in models)), F.col("model")) if models else F.col("model")
    # a row a model: few, so that one task ranks them
    return totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), order)))


def radar(fields: DataFrame) -> DataFrame:
    """model, topic: the mean of the fields' means (not of the records)."""
    return fields.groupBy("model", "topic").agg(mean_of_rounded("mean_score").alias("mean_score"))


def radar_table(fields: DataFrame, models: list[str]) -> DataFrame:
    """A row for each topic and a column for each of ``models``, 0 where one has no score; no rows for fewer than three topics."""
    table = radar(fields).groupBy("topic").pivot("model", models).agg(F.first("mean_score")).na.fill(0.0)
    n = table.agg(F.count("*").alias("_n"))
    return table.crossJoin(F.broadcast(n)).where("_n >= 3").drop("_n")  # one row


def cross_model(fields: DataFrame) -> DataFrame:
    """For each path that at least two models have a score of: mean, spread, best and worst model, and all scores.

    Ties go to the first model by name.
    """
    scored = fields.where("mean_score is not null").groupBy("path").agg(
        F.min("topic").alias("topic"),
        F.count("*").alias("n_models"),
        mean_of_rounded("mean_score").alias("mean_score"),
        F.round(F.max("mean_score") - F.min("mean_score"), 3).alias("spread"),
        F.array_sort(F.collect_list(F.struct((-F.col("mean_score")).alias("minus"), "model"))).alias("_all"),
        F.min(F.struct("mean_score", "model")).alias("_worst"),
    )
    return scored.where("n_models > 1").select(
        "path", "topic", "n_models", "mean_score", "spread",
        F.col("_all")[0]["model"].alias("best_model"),
        F.col("_worst.model").alias("worst_model"),
        F.map_from_entries(F.transform("_all", lambda x: F.struct(x["model"], -x["minus"]))).alias("scores"),
    )


def hard_fields(cross: DataFrame, n_models: int, below: float = 0.5, n: int = 20) -> DataFrame:
    """The first ``n`` fields by mean score, of those that every model has a score of and whose mean is low."""
    return cross.where((F.col("n_models") == n_models) & (F.col("mean_score") < below)).orderBy("mean_score", "path").limit(n)


def spread_fields(cross: DataFrame, least: float = 0.3, n: int = 15) -> DataFrame:
    """The first ``n`` fields by the gap between the best and the worst model."""
    return cross.where(F.col("spread") >= least).orderBy(F.desc("spread"), "path").limit(n)
