"""The tables behind reports and figures; drawing is left to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.text import last_segments, progress_bar, shortened, symbol, traffic_light
from accordance.operators import stats
from accordance.operators.dealing import dealt
from accordance.operators.stats import mean_of_rounded
from accordance.sources.staging import stored


def heat_cell(status: Column, agrees: Column, f1: Column) -> Column:
    """A cell from 0 to 1: both missing 0, one missing .65, agreement 1, else by F1 from .5."""
    code = F.when(status == "both_missing", -1.0).when(status != "filled", 0.3).when(agrees, 1.0).otherwise(F.coalesce(f1, F.lit(0.0)))
    return (code + 1) / 2


def heatmap(compared: DataFrame, pair: str = "pair_id") -> DataFrame:
    """path, pair and cell; a pair that lacks the path has no row and is drawn as missing."""
    return compared.select("path", pair, heat_cell(F.col("status"), F.col("agrees"), F.col("f1")).alias("cell"))


def heatmap_matrix(compared: DataFrame, pairs: list, fields: DataFrame | None = None, pair: str = "pair_id", rows: int | None = None) -> DataFrame:
    """A row for each path of ``fields`` (of ``compared`` without it) and a column for each of ``pairs`` (a few); 0 where a pair lacks the path.

    ``rows``: about how many ``compared`` has. Its cells are dealt by path to as many tasks as hold them, by the session without it.
    """
    cells = heatmap(compared, pair)
    if fields is not None:
        cells = cells.join(fields.select("path").distinct(), "path", "left_semi")
    # narrow rows are shuffled once; a pivot would shuffle them by path and pair, and then as wide as there are pairs
    columns = (F.coalesce(F.max(F.when(F.col(pair).eqNullSafe(F.lit(p)), F.col("cell"))), F.lit(0.0)).alias(str(p)) for p in pairs)
    return dealt(cells, rows, "path").groupBy("path").agg(*columns)


def topic_bars(topics: DataFrame) -> DataFrame:
    """Topics by rate with their color."""
    return topics.select("topic", "agreement_rate", traffic_light(F.col("agreement_rate")).alias("color"), symbol(F.col("agreement_rate")).alias("symbol")).orderBy(F.coalesce("agreement_rate", F.lit(0.0)), "topic")


def status_shares(topics: DataFrame) -> DataFrame:
    """topic, n_agree, n_differ (filled but different) and n_missing."""
    return topics.select("topic", "n_agree", F.greatest(F.lit(0), F.col("n_disagree") - F.col("n_left_missing")).alias("n_differ"), F.col("n_left_missing").alias("n_missing"))


def status_total(topics: DataFrame) -> DataFrame:
    """n_agree, n_differ and n_missing over all topics; n_differ is at least 0 as a whole, not topic by topic."""
    sums = topics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_agree", "n_disagree", "n_left_missing")))
    return sums.select("n_agree", F.greatest(F.lit(0), F.col("n_disagree") - F.col("n_left_missing")).alias("n_differ"), F.col("n_left_missing").alias("n_missing"))


def deviations(fields: DataFrame, n: int = 20) -> DataFrame:
    """Numeric fields with the largest mean deviation, and how many of their pairs are within the tolerance."""
    return fields.where("mean_deviation is not null").orderBy(F.desc("mean_deviation"), "path").limit(n).select("path", "mean_deviation", "tolerance_rate")


def ranking_lines(ranked: DataFrame) -> DataFrame:
    """rank, model, score and a bar of the score."""
    return ranked.select("rank", "model", "score", progress_bar(F.col("score")).alias("bar"))


def topic_pivot(topics: DataFrame, models: list[str]) -> DataFrame:
    """A row for each topic and a column for each model."""
    return topics.groupBy("topic").pivot("model", models).agg(F.first("mean_score"))


def metric_by_trial(metrics: DataFrame, trials: list, metric: str = "metric", trial: str = "trial", value: str = "value") -> DataFrame:
    """A row for each metric, a column for each trial, and their mean (nulls left out, to three decimals)."""
    means = metrics.groupBy(metric).agg(mean_of_rounded(value).alias("mean"))
    return metrics.groupBy(metric).pivot(trial, trials).agg(F.first(value)).join(means, metric)


def low_alpha(interval: Column, nominal: Column, below: float = 0.6) -> Column:
    """If the first alpha there is is low."""
    return F.coalesce(F.coalesce(interval, nominal) < below, F.lit(False))


def labelled(fields: DataFrame) -> DataFrame:
    """``fields`` with a short label, the last segment and the last two of the path."""
    return fields.withColumns({"label": shortened(F.col("path")), "name": last_segments(F.col("path")), "name2": last_segments(F.col("path"), 2)})


def report_json(frame: DataFrame, *columns: str) -> DataFrame:
    """A JSON text for each row, with nulls written out."""
    return frame.select(F.to_json(F.struct(*(columns or frame.columns)), {"ignoreNullFields": "false"}).alias("json"))


def overview(fields: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """What an evaluation's overview shows, from its field statistics: topics by rate, the fields with most disagreements,
    texts by F1, and the total of the status shares."""
    topics = stats.topic_stats(fields)
    return {"topics": topic_bars(topics), "disagreements": stats.by_disagreement(fields, n), "texts": stats.worst_texts(fields), "status": status_total(topics)}


def model_overview(scores: DataFrame, models: list[str]) -> dict[str, DataFrame]:
    """What a comparison of models shows, from their scores: the ranking, topics by model, and the fields that are hard for all or
    differ most."""
    fields = stats.model_field_stats(scores)
    cross = stats.cross_model(fields)
    return {
        "ranking": ranking_lines(stats.ranked(stats.model_totals(fields), models)),
        "topics": topic_pivot(stats.model_topic_stats(scores), models),
        "hard": stats.hard_fields(cross, len(models)),
        "spread": stats.spread_fields(cross),
    }


def report_lines(fields: DataFrame, n_pairs: int) -> DataFrame:
    """The printed report of an evaluation, from its field statistics: section, place (by which a section's lines are ordered,
    then by path), path and line. Sections: detail (fields with disagreements, most first), missing (fields that the left side
    never fills in any of ``n_pairs``), texts (free texts by mean F1, lowest first), perfect, and total (no path)."""
    fields, zero = stored(fields), F.lit(0.0)  # every section reads it

    def section(name: str, rows: DataFrame, place: Column, line: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), place.cast("double").alias("place"), "path", line.alias("line"))

    text = fields.where("field_type = 'free_text' and mean_f1 is not null")
    total = stats.grand_totals(fields).withColumn("path", F.lit(None).cast("string"))
    shares = lambda c, p: F.format_string("%d (%.1f %%)", F.col(c), F.coalesce(F.col(p), zero))
    entries = F.array(
        F.concat(F.lit("compared: "), F.col("n_compared").cast("string")),
        F.concat(F.lit("agree: "), shares("n_agree", "agree_percent")),
        F.concat(F.lit("disagree: "), shares("n_disagree", "disagree_percent")),
        F.concat(F.lit("left missing: "), F.col("n_left_missing").cast("string")),
    )
    lines = total.select("path", F.posexplode(entries).alias("place", "line"))
    parts = [
        section("detail", stats.needs_detail(fields), -F.col("n_disagree"), F.concat(F.col("path"), F.lit(": "), F.col("n_disagree").cast("string"), F.lit(" disagreements"))),
        section("missing", stats.always_missing(fields, n_pairs), zero, F.col("path")),
        section("texts", text, F.col("mean_f1"), F.concat(symbol(F.col("mean_f1")), F.lit(" "), F.col("path"), F.format_string(" %.3f", F.col("mean_f1")))),
        section("perfect", stats.perfect(fields), zero, F.col("path")),
        section("total", lines, F.col("place"), F.col("line")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
