"""More queries of the same kind: ordered records, files that are written and read back, states that are kept, reports of trials."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.operators import agreement, checks, records
from accordance.plans.driver import _LOG, ORACLE_SQL, QUERIES, _mean, _query, _sql, _tables
from accordance.plans.reports import _FOLDER_ANN, _TYPED
from accordance.sources import files, named, word
from accordance.sources.staging import shared_folder

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- ordered records ----

_ORDERED = """
select o_orderkey as id, case when o_orderkey % 50 = 0 then '{}' when o_orderkey % 50 = 1 then '{"x":{}}' else
  '{"z":' || cast(o_orderkey as string) || ',"a.b":{"e":{},"' || o_orderstatus || '":[1,{"q":"x","c":[]}],"":"' || o_orderpriority || '"},"m":' ||
  case o_orderkey % 4 when 0 then 'null' when 1 then '{}' when 2 then '{"x":{"y":{"w":{"v":{"u":"' || o_orderpriority || '","t":{}}}}}}' else '"' || cast(o_orderkey as string) || '"' end ||
  ',"b":true,"a":{"b":1.5,"A":"true"}}' end as raw from orders
"""


@_query(f"select id, raw from ({_ORDERED})")
def ordered_records(spark, sf):
    """Every record comes back from its leaves as it was."""
    return records.nested(records.leaves(_sql(spark, sf, _ORDERED, "orders"), ["id"]), ["id"])


_REPAIR = """
select o_orderkey as id, case when o_orderkey % 40 = 0 then '{}' else '{"oget_muskelaktivitet_rem":{"tib":' || case o_orderkey % 3 when 0 then '"Ja"' when 1 then '"nej"' else '1' end || ',"chin":true,"e":{}},"n":"' || cast(o_orderkey as string) ||
  '","soevnstadier":{"n1":{"latens_min":"1:30","x":"1:30"},"a.b":{"latens_min":"1:30"}},"l":[1,{"tib":"Ja"}]}' end as raw from orders
"""


@_query(f"""select id, replace(replace(replace(raw, '"tib":"Ja","chin"', '"tib":true,"chin"'), '"tib":"nej","chin"', '"tib":false,"chin"'), '"n1":{{"latens_min":"1:30"', '"n1":{{"latens_min":90.0') as raw from ({_REPAIR})""")
def repaired_json(spark, sf):
    """No record is lost, and only the repaired leaves change."""
    return records.repaired_records(_sql(spark, sf, _REPAIR, "orders"), ["id"])[0]


_STAMP = """
select o_orderkey as id, '{"p":' || cast(o_orderkey as string) || ',"metadata":' || case o_orderkey % 4 when 0 then 'null' when 1 then '{}' when 2 then '{"n":5,"filnavn":null,"t":"7"}' else '{"udfyldt_af":"x","filnavn":"y"}' end || ',"s":"' || cast(o_orderkey as string) || '","d":{"y":[1],"x":{}}}' as raw from orders
"""


@_query(f"""select id, case when id % 4 <> 0 then replace(replace(replace(raw, '"metadata":{{}}', '"metadata":{{"filnavn":"f' || id || '","udfyldt_af":"m"}}'), '"filnavn":null,"t":"7"', '"filnavn":"f' || id || '","t":"7","udfyldt_af":"m"'),
  '"udfyldt_af":"x","filnavn":"y"', '"udfyldt_af":"m","filnavn":"f' || id || '"') end as raw from ({_STAMP})""")
def stamped_json(spark, sf):
    return records.stamped(_sql(spark, sf, _STAMP, "orders"), F.concat(F.lit("f"), F.col("id").cast("string")), F.lit("m"))


_DEEP = "select o_orderkey as id, o_orderkey % 12 + 1 as d, repeat('{\"s\":1,\"k\":', cast(o_orderkey % 12 + 1 as int)) || cast(o_orderkey as string) || repeat('}', cast(o_orderkey % 12 + 1 as int)) as raw from orders"


@_query(f"""with r as ({_DEEP}) select id, repeat('k.', (l - 1)::int) || 's' as path, '1' as raw from (select id, unnest(range(1, d + 1)) as l from r)
union all select id, repeat('k.', (d - 1)::int) || 'k', id::varchar from r""")
def flatten_deep(spark, sf):
    """Objects of one to twelve levels."""
    good, _ = records.parse(_sql(spark, sf, _DEEP, "orders"))
    return records.flatten(good, ["id"]).select("id", "path", "raw")


# ---- files ----

_BODY = "select doc_id, '  ' || replace(coalesce(text, ''), ' de ', ' – ') || chr(10) || 'end' as text from documents"


@_query(f"select 'd' || doc_id || '.txt' as file_name, md5(text) as digest from ({_BODY})")
def named_files_read_back(spark, sf):
    """A file for each document, written in one commit and scanned again."""
    folder = shared_folder(spark)
    docs = _sql(spark, sf, _BODY, "documents")
    files.write_texts(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("file_name"), "text"), folder)
    return files.texts(spark, folder).select("file_name", F.md5("text").alias("digest"))


def _as_word(docs: DataFrame) -> DataFrame:
    """name and value: Word files with a paragraph for each line of ``text``."""
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for text in rows["text"]:
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", head + "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n")) + "</w:body></w:document>")
                found.append(data.getvalue())
            yield pd.DataFrame({"name": [f"d{d}.docx" for d in rows["doc_id"]], "value": found})

    return docs.select("doc_id", "text").mapInPandas(made, "name string, value binary")


@_query(f"""with l as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos from (select doc_id, trim(regexp_replace(text, ' +', ' ', 'g'), e' \\n') as t from ({_BODY}))),
f as (select doc_id, trim(line) as line, min(pos) as pos from l where trim(line) <> '' group by all),
j as (select doc_id, string_agg(line, chr(10) order by pos) as body from f group by doc_id)
select 'd' || doc_id || '.docx' as file_name, md5('=== PSG RAPPORT ===' || chr(10) || 'Filnavn: d' || doc_id || '.docx' || chr(10) || chr(10) || body || chr(10) || chr(10) || '=== SLUT ===') as digest from j""")
def word_files_read_back(spark, sf):
    """A Word file for each document, written in one commit and read by the data source."""
    folder = shared_folder(spark)
    named.register(spark)
    _as_word(_sql(spark, sf, _BODY, "documents")).write.format("named_files").mode("append").save(folder)
    return word.scan(spark, folder).select("file_name", F.md5("text").alias("digest"))


# ---- what is kept between runs ----


@_query(ORACLE_SQL["resume_anti_join"])
def resume_by_filter(spark, sf):
    """As resume_anti_join, by a filter grown in two steps."""
    t = _tables(spark, sf, "documents", "labels")
    parts = [checks.done_filter(t["labels"].where(F.col("doc_id") % 2 == k), "doc_id") for k in (0, 1)]
    return checks.not_done_by_filter(t["documents"].select("doc_id", "lang"), t["labels"], "doc_id", checks.grown_filter(*parts))


@_query(ORACLE_SQL["alpha_nominal_multi"])
def alpha_nominal_of_batches(spark, sf):
    items = _tables(spark, sf, "lineitem")["lineitem"]
    states = [agreement.nominal_state(items.where(F.col("l_linenumber") % 3 == k), "l_orderkey", "l_returnflag") for k in (2, 0, 1)]
    return agreement.nominal_alpha(agreement.merged_states(states, "l_orderkey"), "l_orderkey").withColumn("alpha", F.round("alpha", 6))


@_query(ORACLE_SQL["alpha_interval_multi"])
def alpha_interval_of_batches(spark, sf):
    items = _tables(spark, sf, "lineitem")["lineitem"]
    states = [agreement.interval_state(items.where(F.col("l_linenumber") % 3 == k), "l_orderkey", "l_quantity") for k in (2, 0, 1)]
    return agreement.interval_alpha(agreement.merged_states(states, "l_orderkey"), "l_orderkey").withColumn("alpha", F.round("alpha", 6))


@_query(f"""select count_if(status = 'ok')::bigint as n_ok, count_if(status = 'error')::bigint as n_error, count_if(status = 'skipped')::bigint as n_skipped, sum(tokens)::bigint as tokens, sum(seconds) as seconds,
  (select count(*) from ({_LOG}) where status = 'error') as n_written_errors from ({_LOG})""")
def observed_batch(spark, sf):
    """Counts taken while a batch is written, and its dead letters read back."""
    folder = shared_folder(spark)
    seen = checks.write_batch(_sql(spark, sf, _LOG, "events"), folder)
    dead = spark.read.parquet(folder).where("status = 'error'").agg(F.count("*").alias("n_written_errors"))
    return dead.select(*(F.lit(seen[c]).cast("double" if c == "seconds" else "long").alias(c) for c in ("n_ok", "n_error", "n_skipped", "tokens", "seconds")), "n_written_errors")


# ---- reports of trials ----

_TRIALS = f"""with {_TYPED.format(ann=_FOLDER_ANN)}, full_sets as (select trial from t group by trial having count(distinct rater) = 3), vv as (select v.* from v join full_sets using (trial)),
p as (select a.trial, a.path, a.field_type, a.rater as ar, b.rater as br, a.x as ax, b.x as bx, a.s as sa, b.s as sb from vv a join vv b on a.trial = b.trial and a.path = b.path and a.rater < b.rater where coalesce(a.x::varchar, a.s, b.x::varchar, b.s) is not null),
w as (select *, list_distinct(string_split(sa, ' ')) as la, list_distinct(string_split(sb, ' ')) as lb from p),
q as (select *, case when field_type = 'numeric' then coalesce(ax = bx, false) else coalesce(sa = sb, false) end as exact,
  case when field_type = 'numeric' then coalesce(case when ax = 0 and bx = 0 then true when ax = 0 or bx = 0 then abs(ax - bx) <= 0.05 else abs(ax - bx) / greatest(abs(ax), abs(bx)) <= 0.05 end, false) end as near,
  case when field_type = 'free_text' then case when sa is null or sb is null or len(list_intersect(la, lb)) = 0 then 0.0 else 2 * len(list_intersect(la, lb)) / (len(la) + len(lb)) end end as f1 from w),
k as (select *, 'all' as scope from q union all select *, ar || ' vs ' || br from q),
f as (select trial, scope, path, field_type, count(*) as n_pairs, count_if(exact)::bigint as n_exact, coalesce(count_if(near), 0)::bigint as n_tolerance, bool_and(exact) as exact_match, bool_and(near) as tolerance_match, sum(f1) as f1_sum from k group by all),
s as (select trial, scope, field_type, round(100 * sum(n_exact) / sum(n_pairs), 1)::double as exact_percent, case when field_type = 'numeric' then round(100 * sum(n_tolerance) / sum(n_pairs), 1)::double end as tolerance_percent,
  case when field_type = 'free_text' then round(sum(f1_sum) / sum(n_pairs), 3)::double end as mean_f1 from f group by trial, scope, field_type),
m as (select trial, scope, field_type || '_' || kind as metric, val as value from (unpivot s on exact_percent, tolerance_percent, mean_f1 into name kind value val))
"""


#: Alphas from the counts of values and from the sums of numbers and squares; rounded as decimals, so that ties are those of the numbers.
_TRIAL_ALPHAS = """r as (select distinct trial, rater from vv), sc as (select trial, rater, 'all' as scope from r union all
  select a.trial, unnest([a.rater, b.rater]), a.rater || ' vs ' || b.rater from r a join r b on a.trial = b.trial and a.rater < b.rater),
g as (select vv.*, scope from vv join sc using (trial, rater)),
c as (select trial, scope, path, s, count(*) as c from g where field_type = 'nominal' and s is not null group by all), cm as (select *, sum(c) over (partition by trial, scope, path) as m from c),
nv as (select trial, scope, s, sum(c)::double as n, sum(c * (m - c) / (m - 1)) as o from cm where m > 1 group by all),
iv as (select trial, scope, path, count(x)::double as m, sum(x) as sx, sum(x * x) as sxx from g where field_type = 'numeric' group by all having count(x) > 1),
al as (select trial, scope, 'alpha_nominal' as metric, sum(n) as n, sum(o) as o, sum(n) * sum(n) - sum(n * n) as e from nv group by trial, scope
  union all select trial, scope, 'alpha_interval', sum(m), sum(2 * (m * sxx - sx * sx) / (m - 1)), 2 * (sum(m) * sum(sxx) - sum(sx) * sum(sx)) from iv group by trial, scope)
"""


def _trials(spark, sf) -> dict[str, DataFrame]:
    return agreement.trial_report(_sql(spark, sf, _FOLDER_ANN, "orders").withColumnRenamed("rater", "folder"), 3)


@_query(f"{_TRIALS} select trial, scope, path, field_type, n_pairs, n_exact, n_tolerance, exact_match, tolerance_match, round(f1_sum, 6)::double as f1_sum from f")
def trial_report_fields(spark, sf):
    return _trials(spark, sf)["fields"].withColumn("f1_sum", F.round("f1_sum", 6)).drop("mean_f1")


@_query(f"{_TRIALS}, {_TRIAL_ALPHAS} select trial, scope, metric, value from m union all select trial, scope, metric, round((1 - o * (n - 1) / e)::decimal(18, 12), 3)::double from al where e > 0")
def trial_report_metrics(spark, sf):
    """Alphas and percentages."""
    return _trials(spark, sf)["metrics"]


@_query(f"{_TRIALS} select scope, metric, {_mean('value')}::double as mean, count(value) as n_trials from m group by scope, metric")
def trial_report_means(spark, sf):
    return _trials(spark, sf)["means"].where("metric not like 'alpha%'")


@_query(f"""{_TRIALS} select vv.trial, 'all' as scope, path, string_agg(rater::varchar || '=' || coalesce(case when kind <> 'null' then txt end, '?'), ';' order by rater) as by_rater from vv group by all
union all select a.trial, a.rater || ' vs ' || b.rater, a.path, a.rater || '=' || coalesce(case when a.kind <> 'null' then a.txt end, '?') || ';' || b.rater || '=' || coalesce(case when b.kind <> 'null' then b.txt end, '?') from vv a join vv b on a.trial = b.trial and a.path = b.path and a.rater < b.rater""")
def trial_report_values(spark, sf):
    entries = F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"].cast("string"), F.coalesce(e["value"], F.lit("?"))))
    return _trials(spark, sf)["values"].select("trial", "scope", "path", F.array_join(entries, ";").alias("by_rater"))


_LEVELS = """select trial, scope, case field_type when 'numeric' then 'interval' else 'nominal' end as level, path, count(*) as k, count(coalesce(x::varchar, s)) as m from
  (select *, 'all' as scope from vv union all select vv.*, p.x || ' vs ' || p.y from vv join (values (1, 2), (1, 3), (2, 3)) as p(x, y) on vv.rater in (p.x, p.y)) where field_type <> 'free_text' group by all"""


@_query(f"{_TRIALS}, u as ({_LEVELS}) select trial, scope, level, count_if(m >= k)::bigint as n_complete, count_if(m = 0)::bigint as n_empty, count_if(m > 0 and m < k)::bigint as n_partial from u group by trial, scope, level")
def trial_report_units(spark, sf):
    return _trials(spark, sf)["alpha"].select("trial", "scope", "level", "n_complete", "n_empty", "n_partial")
