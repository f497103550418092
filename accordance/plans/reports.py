"""More queries of the same kind: agreement of raters, scores of models, report tables, repair and extraction rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.functions import extraction as X
from accordance.functions import text as T
from accordance.operators import agreement, compare, generate, match, records, stats, views
from accordance.plans.driver import _COMPARED, _CROSS, _FIELD_STATS, _MODELS, _NESTED, ORACLE_SQL, QUERIES, _compared, _mean, _n_fields, _query, _scores, _sides, _sql, _tables

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- raters ----

#: Three raters of each set: a numeric field with numbers, texts, booleans and gaps, a nominal one, free text, and a numeric one that the third rater lacks.
_ANN = """
select trial, rater, path, kind, case when kind = 'num' then n end as num,
  case kind when 'null' then null when 'num' then cast(cast(n as bigint) as string) else t end as txt from (
  select {trial} as trial, r.rater as rater, 'respirations_analyse.{leaf}' as path,
    case when (o_orderkey + r.rater) % 7 = 0 then 'null' when (o_orderkey + 2 * r.rater) % 5 = 0 then 'str' when (o_orderkey + r.rater) % 11 = 0 then 'bool' else 'num' end as kind,
    cast(o_orderkey % 50 + r.rater * (o_orderkey % 3) as double) as n,
    case when (o_orderkey + 2 * r.rater) % 5 <> 0 then case when o_orderkey % 2 = 0 then 'true' else 'false' end
      when o_orderkey % 3 = 0 then cast(o_orderkey % 50 as string) || ',0 /t' when o_orderkey % 3 = 1 then 'ukendt' else 'ca. 5' end as t
  from orders, (select 1 as rater union all select 2 union all select 3) as r
  union all
  select {trial}, r.rater, 'hjerte.{leaf}', case when (o_orderkey + r.rater) % 4 = 0 then 'null' else 'str' end, null,
    case when o_orderkey % 6 < r.rater then lower(o_orderpriority) else o_orderstatus end
  from orders, (select 1 as rater union all select 2 union all select 3) as r
  {more}
)
"""
_MORE = """
  union all
  select o_orderkey, r.rater, 'konklusion_og_plan.plan', case when (o_orderkey + r.rater) % 9 = 0 then 'null' else 'str' end, null,
    'plan ' || case when o_orderkey % 4 = r.rater then 'for control ' else 'a b ' end || lower(o_orderpriority)
  from orders, (select 1 as rater union all select 2 union all select 3) as r
  union all
  select o_orderkey, r.rater, 'patient.BMI', 'num', cast(20 + o_orderkey % 9 + case when r.rater = 2 and o_orderkey % 5 = 0 then 1 else 0 end as double), null
  from orders, (select 1 as rater union all select 2) as r
"""
_RATED = _ANN.format(trial="o_orderkey", leaf="felt", more=_MORE)
#: As many fields as orders, in twenty sets.
_SETS = _ANN.format(trial="o_orderkey % 20", leaf="f' || cast(o_orderkey as string) || '", more="")

_TYPED = """ann as ({ann}), t as (select *, case when path = 'konklusion_og_plan.plan' then 'free_text' when bool_or(kind in ('num', 'bool')) over (partition by trial, path) then 'numeric' else 'nominal' end as field_type from ann),
d as (select g.trial, g.path, g.field_type, r.rater, coalesce(t.kind, 'null') as kind, t.num, t.txt from (select distinct trial, path, field_type from t) g join (select distinct trial, rater from t) r using (trial)
  left join t on t.trial = g.trial and t.path = g.path and t.rater = r.rater),
v as (select *, case when field_type = 'numeric' then case kind when 'bool' then (txt = 'true')::int::double when 'num' then num when 'str' then try_cast(nullif(regexp_replace(replace(txt, ',', '.'), '[^0-9.-]', '', 'g'), '') as double) end end as x,
  case when field_type <> 'numeric' and kind <> 'null' then lower(trim(txt)) end as s from d)"""
_FIELDS = f"""with {_TYPED.format(ann=_RATED)},
p as (select a.trial, a.path, a.field_type, a.x as ax, b.x as bx, a.s as "as", b.s as bs from v a join v b on a.trial = b.trial and a.path = b.path and a.rater < b.rater where coalesce(a.x::varchar, a.s, b.x::varchar, b.s) is not null),
w as (select *, list_distinct(string_split("as", ' ')) as la, list_distinct(string_split(bs, ' ')) as lb from p),
q as (select *, case when field_type = 'numeric' then coalesce(ax = bx, false) else coalesce("as" = bs, false) end as exact,
  case when field_type = 'numeric' then coalesce(case when ax = 0 and bx = 0 then true when ax = 0 or bx = 0 then abs(ax - bx) <= 0.05 else abs(ax - bx) / greatest(abs(ax), abs(bx)) <= 0.05 end, false) end as near,
  case when field_type = 'free_text' then case when "as" is null or bs is null or len(list_intersect(la, lb)) = 0 then 0.0 else
    2 * (len(list_intersect(la, lb)) / len(lb)) * (len(list_intersect(la, lb)) / len(la)) / (len(list_intersect(la, lb)) / len(lb) + len(list_intersect(la, lb)) / len(la)) end end as f1 from w),
f as (select trial, path, field_type, count(*) as n_pairs, count_if(exact)::bigint as n_exact, coalesce(count_if(near), 0)::bigint as n_tolerance, bool_and(exact) as exact_match, bool_and(near) as tolerance_match, sum(f1) as f1_sum, avg(f1) as f1_avg from q group by all)
"""


def _typed(spark, sf) -> DataFrame:
    # three raters of three fields, and two of one
    return agreement.typed(_sql(spark, sf, _RATED, "orders"), ("trial",), 11 * _tables(spark, sf, "orders")["orders"].count())


def _rater_fields(spark, sf) -> DataFrame:
    rows = _sql(spark, sf, _RATED, "orders")
    return agreement.pairwise_fields(rows, "rater", ("trial",), raters=rows)


def _wide(spark, sf, ann: str = _RATED) -> DataFrame:
    return agreement.wide(_sql(spark, sf, ann, "orders"), "rater", ("trial",))


@_query(f"with {_TYPED.format(ann=_RATED)} select trial, path, rater, field_type from t")
def rater_field_types(spark, sf):
    return _typed(spark, sf).select("trial", "path", "rater", "field_type")


@_query(f"with {_TYPED.format(ann=_RATED)} select trial, path, rater, kind, x as number from v")
def rater_values(spark, sf):
    return _wide(spark, sf).select("trial", "path", F.inline("cells")).select("trial", "path", "rater", "kind", F.col("v").alias("number"))


@_query(f"{_FIELDS} select * exclude (f1_avg) replace (round(f1_sum, 6)::double as f1_sum), round(f1_avg, 3)::double as mean_f1 from f")
def rater_fields(spark, sf):
    return _rater_fields(spark, sf).withColumn("f1_sum", F.round("f1_sum", 6))


@_query(f"""{_FIELDS} select field_type, sum(n_pairs)::bigint as n_pairs, round(100 * sum(n_exact) / sum(n_pairs), 1)::double as exact_percent, case when field_type = 'numeric' then round(100 * sum(n_tolerance) / sum(n_pairs), 1)::double end as tolerance_percent,
  case when field_type = 'free_text' then round(sum(f1_sum) / sum(n_pairs), 3)::double end as mean_f1 from f group by field_type""")
def rater_summary(spark, sf):
    return agreement.pairwise_summary(_rater_fields(spark, sf))


@_query(f"with {_TYPED.format(ann=_RATED)} select trial, path, string_agg(rater::varchar || '=' || coalesce(case when kind <> 'null' then txt end, '?'), ';' order by rater) as by_rater from d group by trial, path")
def rater_value_maps(spark, sf):
    entries = F.transform("cells", lambda c: F.concat_ws("=", c["rater"].cast("string"), F.coalesce(F.when(c["kind"] != "null", c["txt"]), F.lit("?"))))
    return _wide(spark, sf).select("trial", "path", F.array_join(entries, ";").alias("by_rater"))


@_query(f"""with {_TYPED.format(ann=_RATED)}, r as (select distinct trial, rater from d), p as (select a.trial, a.rater as x, b.rater as y from r a join r b on a.trial = b.trial and a.rater < b.rater)
select p.x::varchar || ' vs ' || p.y::varchar as scope, d.rater, count(*) as n, count_if(d.kind <> 'null')::bigint as n_filled from p join d on d.trial = p.trial and d.rater in (p.x, p.y) group by 1, 2""")
def rater_scopes(spark, sf):
    pairs = agreement.scopes(_wide(spark, sf), "rater", ("trial",), whole=False).select("scope", F.inline("cells"))
    return pairs.groupBy("scope", "rater").agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "null").alias("n_filled"))


_ALPHAS = f"""with {_TYPED.format(ann=_SETS)},
u as (select trial, 'interval' as level, path, count(*) as k, count(x) as m, null as one from v where field_type = 'numeric' group by trial, path union all select trial, 'nominal', path, count(*), count(s), null from v where field_type = 'nominal' group by trial, path),
counts as (select trial, level, count_if(m >= k)::bigint as n_complete, count_if(m = 0)::bigint as n_empty, count_if(m > 0 and m < k)::bigint as n_partial, count_if(m >= k) >= 10 as reliable from u group by trial, level),
i as (select trial, path, count(x) as m, var_pop(x) as var, sum(x) as sx, sum(x * x) as sxx from v where field_type = 'numeric' group by trial, path having count(x) > 1),
ai as (select trial, 'interval' as level, sum(m)::double as n, sum(2.0 * m * m * var / (m - 1)) as o, 2 * (sum(m)::double * sum(sxx) - sum(sx) * sum(sx)) as e from i group by trial),
c as (select trial, path, s, count(*) as n from v where field_type = 'nominal' and s is not null group by all), m as (select *, sum(n) over (partition by trial, path) as m from c),
o as (select trial, sum(n)::double as n, sum(n * (m - n) / (m - 1)) as o from m where m > 1 group by trial), e as (select trial, sum(t * t) as s from (select trial, s, sum(n)::double as t from m where m > 1 group by trial, s) group by trial),
an as (select o.trial, 'nominal' as level, o.n, o.o, o.n * o.n - e.s as e from o join e using (trial)),
a as (select trial, level, 1 - (o / n) / nullif(e / (n * (n - 1)), 0) as alpha from (select * from ai union all select * from an)),
report as (select counts.*, round(a.alpha, 3)::double as alpha from counts left join a using (trial, level))
"""


def _alphas(spark, sf) -> DataFrame:
    return agreement.cell_alphas(_wide(spark, sf, _SETS), ("trial",))


@_query(f"{_ALPHAS} select * from report")
def alpha_of_sets(spark, sf):
    return _alphas(spark, sf)


@_query(f"""{_ALPHAS} select trial, level, case when alpha is null then 'N/A' else format('{{:.3f}}', alpha) || case when reliable then '' else ' ⚠' end end as alpha_text, coalesce(alpha < 0.6, false) as low from report""")
def alpha_lines(spark, sf):
    return _alphas(spark, sf).select("trial", "level", agreement.alpha_text(F.col("alpha"), F.col("reliable")).alias("alpha_text"), views.low_alpha(F.col("alpha"), F.lit(None)).alias("low"))


@_query(f"{_ALPHAS} select level, {_mean('alpha')}::double as mean, count(alpha) as n from report group by level")
def alpha_means(spark, sf):
    return _alphas(spark, sf).groupBy("level").agg(stats.mean_of_rounded("alpha").alias("mean"), F.count("alpha").alias("n"))


_FOLDER_ANN = f"select * from ({_RATED}) as a where not (rater = 3 and trial % 4 = 0)"


@_query(f"""with {_TYPED.format(ann=_FOLDER_ANN)}, full_sets as (select trial from t group by trial having count(distinct rater) = 3),
k as (select d.*, 'all' as scope from d join full_sets using (trial) union all select d.*, p.x || ' vs ' || p.y from d join full_sets using (trial) join (values (1, 2), (1, 3), (2, 3)) as p(x, y) on d.rater in (p.x, p.y))
select scope, rater, sum(has)::bigint as n_filled, count(*) as n_units from (select trial, scope, rater, path, (kind <> 'null')::int as has from k) group by scope, rater""")
def trial_report_coverage(spark, sf):
    ann = _sql(spark, sf, _FOLDER_ANN, "orders")
    found = agreement.trial_report(ann.withColumnRenamed("rater", "folder"), 3)["coverage"]
    return found.groupBy("scope", F.col("folder").alias("rater")).agg(F.sum("n_filled").alias("n_filled"), F.sum("n_units").alias("n_units"))


# ---- models against the truth ----

_SCORED = f"""{_COMPARED}, scored as (select 'm' || (pair_id % 3)::varchar as model, pair_id, path, topic, field_type, lk = 'null' as model_missing, rk = 'null' as truth_missing,
  case when rk = 'null' then null when lk = 'null' then 0.0 when field_type = 'free_text' then round(f1, 3)
    when numbers then case when ln = rn then 1.0 when case when ln = 0 or rn = 0 then abs(ln - rn) <= 0.05 else abs(ln - rn) / greatest(abs(ln), abs(rn)) <= 0.05 end then 0.7 else 0.0 end
    when lt = rt then 1.0 else 0.0 end::double as score from g),
sf as (select model, path, min(topic) as topic, count(*) as n, count(score) as n_scored, count_if(model_missing and not truth_missing)::bigint as n_missing, count_if(model_missing and truth_missing)::bigint as n_both_missing, {_mean('score')}::double as mean_score from scored group by model, path)
"""


def _model_scores(spark, sf) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("pair_id") % 3).cast("string"))
    return compare.score_fields(*(s.withColumn("model", model) for s in _sides(spark, sf)), rows=_n_fields(spark, sf))


@_query(f"{_SCORED} select * from scored")
def model_compare(spark, sf):
    return _model_scores(spark, sf)


@_query(f"{_SCORED} select * from sf")
def model_compare_fields(spark, sf):
    return stats.model_field_stats(_model_scores(spark, sf))


@_query(f"{_SCORED}, totals as (select model, {_mean("mean_score")}::double as score from sf group by model) select row_number() over (order by score desc, model)::integer as rank, model, score, repeat('█', floor(score * 30)::int) || repeat('░', 30 - floor(score * 30)::int) as bar from totals")
def model_compare_ranking(spark, sf):
    return views.ranking_lines(stats.ranked(stats.model_totals(stats.model_field_stats(_model_scores(spark, sf)))))


_EVENT_MODELS = ["click", "error", "purchase", "signup", "view"]
_PIVOT = ", ".join(f"max(mean_score) filter (model = '{m}') as \"{m}\"" for m in _EVENT_MODELS)


@_query(f"{_MODELS}, t as (select model, topic, {_mean('score')}::double as mean_score from s group by model, topic) select topic, {_PIVOT} from t group by topic")
def topic_pivot(spark, sf):
    return views.topic_pivot(stats.model_topic_stats(_scores(spark, sf)), _EVENT_MODELS)


_RADAR = ", ".join(f"coalesce(max(mean_score) filter (model = '{m}'), 0) as \"{m}\"" for m in [*_EVENT_MODELS, "none"])


@_query(f"{_MODELS}, t as (select model, topic, {_mean('mean_score')}::double as mean_score from fields group by model, topic) select topic, {_RADAR} from t where (select count(distinct topic) from t) >= 3 group by topic")
def radar_table(spark, sf):
    return stats.radar_table(stats.model_field_stats(_scores(spark, sf)), [*_EVENT_MODELS, "none"])


@_query(f"{_MODELS}, t as (select model, topic, {_mean('score')}::double as mean_score from s group by model, topic) select topic as metric, {_PIVOT}, {_mean('mean_score')}::double as mean from t group by topic")
def metric_by_trial(spark, sf):
    topics = stats.model_topic_stats(_scores(spark, sf)).select(F.col("topic").alias("metric"), F.col("model").alias("trial"), F.col("mean_score").alias("value"))
    return views.metric_by_trial(topics, _EVENT_MODELS)


@_query(f"{_CROSS} select path, (select string_agg(model || ':' || mean_score::varchar, ',' order by mean_score desc, model) from fields f where f.path = x.path and mean_score is not null) as scores from x")
def cross_model_scores(spark, sf):
    cross = stats.cross_model(stats.model_field_stats(_scores(spark, sf)))
    return cross.select("path", F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("scores"))


# ---- report tables ----

_RATES = f"""{_FIELD_STATS}, rated as (select *, round(n_agree / nullif(n_compared, 0), 3)::double as agreement_rate, round(f1_sum / nullif(f1_n, 0), 3)::double as mean_f1 from fields),
topics as (select topic, sum(n_agree)::bigint as n_agree, sum(n_disagree)::bigint as n_disagree, sum(n_left_missing)::bigint as n_left_missing, round(sum(n_agree) / nullif(sum(n_compared), 0), 3)::double as agreement_rate from fields group by topic)
"""


def _fields(spark, sf) -> DataFrame:
    return stats.field_stats(_compared(spark, sf))


@_query(f"{_RATES} select topic, n_agree, greatest(0, n_disagree - n_left_missing) as n_differ, n_left_missing as n_missing from topics")
def status_shares(spark, sf):
    return views.status_shares(stats.topic_stats(_fields(spark, sf)))


@_query(f"{_RATES} select sum(n_agree)::bigint as n_agree, greatest(0, sum(n_disagree) - sum(n_left_missing))::bigint as n_differ, sum(n_left_missing)::bigint as n_missing from topics")
def status_total(spark, sf):
    return views.status_total(stats.topic_stats(_fields(spark, sf)))


@_query(f"""{_RATES} select topic, agreement_rate, case when agreement_rate is null then 'grey' when agreement_rate >= 0.75 then 'green' when agreement_rate >= 0.5 then 'yellow' else 'red' end as color,
  case when agreement_rate >= 0.75 then '🟢' when agreement_rate >= 0.5 then '🟡' when agreement_rate >= 0 then '🔴' else '⚪' end as symbol from topics""")
def topic_bars(spark, sf):
    return views.topic_bars(stats.topic_stats(_fields(spark, sf)))


@_query(f"{_RATES} select topic, agreement_rate from topics")
def worst_topics(spark, sf):
    return stats.worst_topics(stats.topic_stats(_fields(spark, sf))).select("topic", "agreement_rate")


@_query(f"{_RATES} select path, mean_f1 from rated where field_type = 'free_text'")
def worst_texts(spark, sf):
    return stats.worst_texts(_fields(spark, sf)).select("path", "mean_f1")


@_query(f"{_RATES} select path, round(mean_deviation, 1) as mean_deviation, round(n_tolerance / nullif(tolerance_n, 0), 3)::double as tolerance_rate from rated where mean_deviation is not null order by mean_deviation desc, path limit 1")
def worst_deviations(spark, sf):
    return views.deviations(_fields(spark, sf), 1).withColumn("mean_deviation", F.round("mean_deviation", 1))


_PERIODS = f"{_COMPARED}, c2 as (select pair_id % 3000 as part, * from compared), fields as (select part, path, min(field_type) as field_type, count(agrees) as n_compared, count_if(agrees)::bigint as n_agree, count_if(not agrees)::bigint as n_disagree, count_if(status = 'left_missing')::bigint as n_left_missing, count(*) as n from c2 group by part, path), rated as (select *, round(n_agree / nullif(n_compared, 0), 3)::double as agreement_rate from fields)"


def _by_part(spark, sf) -> DataFrame:
    """Field statistics of many small sets, whose paths carry the set's number."""
    part = (F.col("pair_id") % 3000).cast("string")
    return stats.field_stats(_compared(spark, sf).withColumn("path", F.concat_ws("#", part, "path")))


@_query(f"{_PERIODS} select part::varchar || '#' || path as path, n_disagree from rated where n_disagree >= 2 or agreement_rate < 0.5")
def needs_detail(spark, sf):
    return stats.needs_detail(_by_part(spark, sf)).select("path", "n_disagree")


@_query(f"{_PERIODS} select part::varchar || '#' || path as path from rated where agreement_rate = 1")
def perfect_fields(spark, sf):
    return stats.perfect(_by_part(spark, sf)).select("path")


@_query(f"{_PERIODS} select part::varchar || '#' || path as path, n_left_missing from rated where n_left_missing = 1")
def always_missing(spark, sf):
    return stats.always_missing(_by_part(spark, sf), 1).select("path", "n_left_missing")


_FORMAT = lambda x: f"format('{{:.1f}}', {x})"


@_query(f"""{_PERIODS}, named as (select *, part::varchar || '#' || path as name from rated),
totals as (select sum(n_compared) as c, sum(n_agree) as a, sum(n_disagree) as d, sum(n_left_missing) as l from rated)
select 'detail' as section, (-n_disagree)::double as place, name as path, name || ': ' || n_disagree || ' disagreements' as line from named where n_disagree >= 2 or agreement_rate < 0.5
union all select 'missing', 0, name, name from named where n_left_missing = 1
union all select 'perfect', 0, name, name from named where agreement_rate = 1
union all select 'total', 0, null, 'compared: ' || c from totals
union all select 'total', 1, null, 'agree: ' || a || ' (' || {_FORMAT("round(100 * a / c, 1)::double")} || ' %)' from totals
union all select 'total', 2, null, 'disagree: ' || d || ' (' || {_FORMAT("round(100 * d / c, 1)::double")} || ' %)' from totals
union all select 'total', 3, null, 'left missing: ' || l from totals""")
def report_lines(spark, sf):
    """The printed report of many small sets; texts have a row of their own in worst_texts."""
    return views.report_lines(_by_part(spark, sf), 1).where("section <> 'texts'")


@_query(f"""{_ALPHAS}, by_trial as (select trial, max(alpha) filter (level = 'interval') as i, max(alpha) filter (level = 'nominal') as n from report group by trial)
select trial, i, n, coalesce(coalesce(i, n) < 0.6, false) as low from by_trial""")
def low_alpha_trials(spark, sf):
    """Trials whose interval alpha is low, or the nominal one where there is no other."""
    wide = _alphas(spark, sf).groupBy("trial").agg(*(F.max(F.when(F.col("level") == level, F.col("alpha"))).alias(c) for level, c in (("interval", "i"), ("nominal", "n"))))
    return wide.withColumn("low", views.low_alpha(F.col("i"), F.col("n")))


_PAIRS = list(range(20))
_CELLS = ", ".join(f"coalesce(max((case when status = 'both_missing' then -1 when status <> 'filled' then 0.3 when agrees then 1 else coalesce(f1, 0) end + 1) / 2) filter (pair_id % 20 = {k}), 0)::double as \"{k}\"" for k in _PAIRS)


@_query(f"{_COMPARED} select (pair_id // 20)::varchar || '#' || path as path, {_CELLS} from compared group by 1")
def heatmap_matrix(spark, sf):
    """All pairs, twenty to a matrix, whose paths carry its number."""
    compared = _compared(spark, sf)
    parts = compared.withColumns({"path": F.concat_ws("#", F.expr("pair_id div 20").cast("string"), "path"), "pair_id": F.col("pair_id") % 20})
    return views.heatmap_matrix(parts, _PAIRS, rows=_n_fields(spark, sf))


_LABELS = "select path, case when length(path) > 46 then '…' || right(path, 45) else path end as label, string_split(path, '.')[-1] as name, array_to_string(string_split(path, '.')[-2:], '.') as name2"


@_query(f"{_LABELS} from (select p_name || '.' || p_brand || '.' || p_type || '.' || repeat('x', p_size) as path from part)")
def field_labels(spark, sf):
    return views.labelled(_sql(spark, sf, "select p_name || '.' || p_brand || '.' || p_type || '.' || repeat('x', p_size) as path from part", "part"))


# ---- files ----

_NAMES = "select 'output-trial' || cast(doc_id % 300 as string) || case when doc_id % 2 = 0 then '.json' else '-b.json' end as file_name, doc_id from documents union all select 'trial' || cast(doc_id as string) || '.json', doc_id from labels"


@_query(f"select file_name, try_cast(nullif(regexp_extract(file_name, '^output-trial([0-9]+)', 1), '') as bigint) as trial, replace(replace(file_name, 'output-', ''), '.json', '') as label from ({_NAMES})")
def trial_names(spark, sf):
    rows = _sql(spark, sf, _NAMES, "documents", "labels")
    return rows.select("file_name", match.trial_number().alias("trial"), T.file_label(F.col("file_name")).alias("label"))


@_query(f"with n as (select file_name, doc_id, row_number() over (partition by file_name order by doc_id desc) as k from ({_NAMES})) select file_name, doc_id from n where k = 1 order by file_name limit 50")
def last_of_first_files(spark, sf):
    return match.in_name_order(match.last_of(_sql(spark, sf, _NAMES, "documents", "labels"), "file_name", "doc_id"), 50)


@_query(f"""with f as (select distinct doc_id % 101 as trial, case when doc_id % 2 = 0 then 'a' else 'b' end as folder from documents) select trial, folder from f where trial in (select trial from f group by trial having count(distinct folder) = 2)""")
def complete_trials(spark, sf):
    rows = _sql(spark, sf, "select distinct doc_id % 101 as trial, case when doc_id % 2 = 0 then 'a' else 'b' end as folder from documents", "documents")
    return match.complete_trials(rows, 2)


# ---- records ----

_BROKEN = "select event_id, case event_id % 5 when 0 then '{\"a\": ' when 1 then '[1]' when 2 then null else props end as raw from events"


@_query(f"select event_id, case when raw is null then 'no text' when not json_valid(raw) then 'no JSON' else 'no object' end as reason from ({_BROKEN}) where event_id % 5 < 3")
def dead_letters(spark, sf):
    return records.parse(_sql(spark, sf, _BROKEN, "events"))[1].select("event_id", "reason")


@_query(f"""select event_id, '{{"a":{{"b":{{"k":' || (json(raw)->>'$.a.b.k') || '}},"list":[1,2],"none":null}},"type":"' || (json(raw)->>'$.type') || '"}}' as raw from ({_NESTED})""")
def nested_json(spark, sf):
    good, _ = records.parse(_sql(spark, sf, _NESTED, "events"))
    return records.nested(records.flatten(good, ["event_id"]), ["event_id"])


_LEAVES = """
select event_id, 'oget_muskelaktivitet_rem.chin' as path, case event_id % 4 when 0 then 'Ja' when 1 then 'nej' when 2 then 'true' else '1' end as raw, case event_id % 4 when 2 then 'BOOLEAN' when 3 then 'BIGINT' else 'STRING' end as jtype from events
union all select event_id, 'soevn_opsummering.soevnlatens_min', case event_id % 3 when 0 then '1:30' when 1 then 'ukendt' else '00:45:30' end, 'STRING' from events
union all select event_id, 'sammenfatning.anfald', case event_id % 3 when 0 then 'true' when 1 then '0' else 'Ingen set' end, case event_id % 3 when 0 then 'BOOLEAN' when 1 then 'BIGINT' else 'STRING' end from events
union all select event_id, 'patient.navn', 'A', 'STRING' from events
"""
_REPAIRED = f"""
with r as (select *, case path when 'oget_muskelaktivitet_rem.chin' then case raw when 'Ja' then 'true' when 'nej' then 'false' else raw end
  when 'soevn_opsummering.soevnlatens_min' then case raw when '1:30' then '90.0' when '00:45:30' then '45.5' else raw end
  when 'sammenfatning.anfald' then case raw when 'true' then 'ja' when '0' then 'nej' else raw end else raw end as new_raw from ({_LEAVES}))
"""


@_query(f"{_REPAIRED} select event_id, path, raw as old, new_raw as \"new\" from r where raw <> new_raw")
def repair_log(spark, sf):
    return records.change_log(records.repair(_sql(spark, sf, _LEAVES, "events")), ["event_id"])


@_query(f"{_REPAIRED} select event_id, count_if(raw <> new_raw)::bigint as n_changed from r group by event_id")
def repair_counts(spark, sf):
    return records.change_counts(records.repair(_sql(spark, sf, _LEAVES, "events")), ["event_id"])


# ---- texts ----

_TYPESET = "select doc_id, '  ' || replace(replace(text, ' de ', ' – '), ' the ', ' ≥ ') || ' 5 µ ± 2 ° x ' as text from documents"


@_query(f"select doc_id, md5(replace(replace(replace(replace(replace(text, '–', '-'), 'µ', 'u'), '±', '+/-'), '°', ' grader'), '≥', '>=')) as digest from ({_TYPESET})")
def plain_characters(spark, sf):
    return _sql(spark, sf, _TYPESET, "documents").select("doc_id", F.md5(T.plain_characters(F.col("text"))).alias("digest"))


@_query(f"select doc_id, md5(trim(regexp_replace(text, ' +', ' ', 'g'), e' \\n')) as kept, md5(trim(regexp_replace(replace(text, e'\\n', ''), ' +', ' ', 'g'))) as fused from ({_TYPESET})")
def normalize_report(spark, sf):
    rows = _sql(spark, sf, _TYPESET, "documents")
    return rows.select("doc_id", F.md5(T.normalize_report(F.col("text"))).alias("kept"), F.md5(T.normalize_report(F.col("text"), False)).alias("fused"))


@_query("select doc_id, md5('system' || chr(10) || chr(10) || 'Report: ' || coalesce(text, '') || ' end') as digest from documents")
def prompts(spark, sf):
    docs = _sql(spark, sf, "select doc_id, text from documents", "documents")
    return docs.select("doc_id", F.md5(generate.prompt(F.col("text"), "system", "Report: {text} end")).alias("digest"))


_CELLS_OF_REPORTS = """
select event_id, cast(floor(value) as bigint) as n, user_id,
  case event_id % 3 when 0 then '-' when 1 then cast(cast(floor(value) as bigint) as string) || ',5 %' else 'tekst' end as number,
  case event_id % 2 when 0 then '25/9 - 26/9 2007' else ' 3/4 2008 ' end as dates,
  case event_id % 2 when 0 then '25/9 07:41:30' else '7:41' end as clock,
  case event_id % 2 when 0 then cast(user_id as string) || ' min.' else '07:41' end as duration,
  case event_id % 2 when 0 then cast(user_id as string) || ' (24,1)' else cast(user_id as string) end as both,
  cast(user_id as string) || ' +/- 5' as spread,
  case event_id % 3 when 0 then 'Ja: X Nej:' when 1 then 'Ja: Nej: X' else 'måske' end as box,
  case event_id % 2 when 0 then 'Ingen apnøer' else 'apnøer set' end as apnoea,
  case event_id % 4 when 0 then 'S1' when 1 then 'rem' when 2 then 'S4' else 's3' end as stage,
  case event_id % 2 when 0 then 'G47.3 / Apnø' else 'G47' end as diagnosis,
  case event_id % 2 when 0 then 'cpr 010203-1234.' else '010203-12345' end as person
from events
"""


@_query(f"""select event_id, case when number <> '-' then number end as present, case when event_id % 3 = 1 then n + 0.5 end::double as number, case when event_id % 2 = 0 then '25/9 2007' else '3/4 2008' end as first_date,
  case when event_id % 2 = 0 then '07:41:30' else '7:41' end as clock, case when event_id % 2 = 0 then user_id::varchar else '07:41' end as minutes, user_id::double as total, case when event_id % 2 = 0 then 24.1 end::double as index,
  user_id::double as mean, case event_id % 3 when 0 then true when 1 then false end as box, event_id % 2 = 0 as none, case when event_id % 2 = 0 then 0.0 end::double as filled,
  case event_id % 4 when 0 then 'n1' when 1 then 'rem' when 3 then 'n3' end as stage, case when event_id % 2 = 0 then 'G47.3' else 'G47' end as code, case when event_id % 2 = 0 then 'Apnø' end as diagnosis,
  case when event_id % 2 = 0 then '010203-1234' end as person from ({_CELLS_OF_REPORTS})""")
def extraction_rules(spark, sf):
    c = F.col
    both, code = X.total_and_index(c("both")), X.diagnosis(c("diagnosis"))
    return _sql(spark, sf, _CELLS_OF_REPORTS, "events").select(
        "event_id", X.missing_to_null(c("number")).alias("present"), X.plain_number(c("number")).alias("number"), X.first_date(c("dates")).alias("first_date"), X.clock_time(c("clock")).alias("clock"),
        X.minutes(c("duration")).alias("minutes"), both["total"].alias("total"), both["index"].alias("index"), X.mean_of_spread(c("spread")).alias("mean"), X.check_box(c("box")).alias("box"),
        X.no_apnoea(c("apnoea")).alias("none"), X.zero_if_none(F.lit(None).cast("double"), X.no_apnoea(c("apnoea"))).alias("filled"), X.modern_stage(c("stage")).alias("stage"),
        code["code"].alias("code"), code["text"].alias("diagnosis"), X.personal_number(c("person")).alias("person"),
    )
