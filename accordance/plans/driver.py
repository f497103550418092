"""Queries over the driver tables, each with SQL that gives the same rows.

The tables hold no records of the library's own shape, so queries make them: a piece of portable SQL
(``_..._SQL``) prepares the same input for both engines, and only the operator itself differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions import text as T
from accordance.functions import values as V
from accordance.operators import agreement, checks, cleaning, compare, match, records, stats, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _mean(c: str) -> str:
    """SQL of stats.mean_of_rounded with three decimals."""
    return f"floor((2 * sum(round({c} * 1000)::bigint) + count({c})) / nullif(2 * count({c}), 0)) / 1000"


def _tables(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names}


def _sql(spark: SparkSession, sf: str, query: str, *names: str) -> DataFrame:
    """The portable SQL over driver tables, whose names stand in braces for Spark."""
    query = query.replace("{", "{{").replace("}", "}}")
    for n in names:
        query = query.replace(f" {n}", f" {{{n}}}")
    return spark.sql(query, **_tables(spark, sf, *names))


# ---- text ----

_SPACED = "select doc_id, case when doc_id % 2 = 0 then replace(text, ' ', '  ') else '  ' || text || '  ' end as text from documents"


@_query(f"select doc_id, trim(regexp_replace(text, ' +', ' ', 'g'), e' \\n') as text from ({_SPACED})")
def clean_normalize_text(spark, sf):
    docs = _sql(spark, sf, _SPACED, "documents")
    return docs.select("doc_id", T.normalize_clean(F.col("text")).alias("text"))


_LINES = "select doc_id, unnest(string_split(coalesce(text, ''), e'\\n')) as line, unnest(range(len(string_split(coalesce(text, ''), e'\\n')))) as pos from documents"


def _lines(spark, sf) -> DataFrame:
    return cleaning.split_lines(_tables(spark, sf, "documents")["documents"])


@_query(f"""
with l as ({_LINES}), c as (
  select doc_id, pos, case when contains(line, '|') then list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') else [line] end as cells from l),
e as (select doc_id, unnest(cells) as line from c)
select doc_id, count(*) as n_lines, sum(length(line))::bigint as n_chars, md5(string_agg(line, '|' order by line)) as digest from e group by doc_id
""")
def clean_split_tables(spark, sf):
    lines = cleaning.split_tables(_lines(spark, sf))
    digest = F.md5(F.array_join(F.array_sort(F.collect_list("line")), "|"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), digest.alias("digest"))


@_query(f"""
with l as ({_LINES}), f as (select doc_id, trim(line) as line, min(pos) as pos from l where trim(line) <> '' group by all)
select doc_id, string_agg(line, e'\\n' order by pos) as text from f group by doc_id
""")
def clean_dedup_lines(spark, sf):
    return cleaning.join_lines(cleaning.dedup_lines(_lines(spark, sf)))


_MARKED = "select doc_id, case when doc_id % 3 = 0 then 'src: ' || replace(text, chr(10), chr(10) || 'src: ') else text end as text from documents"
_MARKED_LINES = f"select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from ({_MARKED})"
_IS_META = "not contains(lower(line), 'min') and not contains(line, '%') and regexp_matches(line, '[a-zA-ZæøåÆØÅ]') and contains(line, ':')"


@_query(f"""
with l as (select doc_id, trim(line) as line, pos from ({_MARKED_LINES}) where trim(line) <> ''),
r as (select *, row_number() over (partition by doc_id, line order by pos) as k from l)
select doc_id, string_agg(line, chr(10) order by pos) as text from r where k = 1 or not ({_IS_META}) group by doc_id
""")
def clean_dedup_controlled(spark, sf):
    return cleaning.join_lines(cleaning.dedup_metadata(cleaning.split_lines(_sql(spark, sf, _MARKED, "documents"))))


@_query(f"""
with l as ({_LINES}), n as (select *, count(*) over (partition by doc_id, line) as n from l)
select doc_id, count(*) as n_lines, sum(length(line))::bigint as n_chars from n where not (n >= 3 and length(trim(line)) > 10) group by doc_id
""")
def clean_repeated_blocks(spark, sf):
    kept = cleaning.drop_repeated_blocks(_lines(spark, sf), min_repeats=3, longer_than=10)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@_query(f"""
with l as (select doc_id, pos, line from ({_MARKED_LINES})),
c as (select doc_id, pos, case when contains(line, '|') then list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') else [line] end as cells from l),
e as (select doc_id, pos, unnest(cells) as line, unnest(range(len(cells))) as sub from c),
n as (select *, count(*) over (partition by doc_id, line) as n from e),
k as (select doc_id, pos, sub, trim(line) as line from n where not (n >= 5 and length(trim(line)) > 30) and trim(line) <> ''),
r as (select *, row_number() over (partition by doc_id, line order by pos, sub) as k from k),
j as (select doc_id, string_agg(line, chr(10) order by pos, sub) as text from r where k = 1 or not ({_IS_META}) group by doc_id)
select d.doc_id, coalesce(regexp_replace(j.text, ' +', ' ', 'g'), '') as text from documents d left join j using (doc_id)
""")
def clean_report_text(spark, sf):
    return cleaning.clean_texts(_sql(spark, sf, _MARKED, "documents"))


# ---- values ----

_RAW = """
select p_partkey as id, cast(p_size as string) || ' cm' as raw from part
union all select p_partkey + 1000000, cast(p_size as string) || ',5 %' from part
union all select p_partkey + 2000000, '2020-' || cast(p_size % 12 + 1 as string) || '-' || cast(p_size % 28 + 1 as string) from part
union all select p_partkey + 3000000, cast(p_size % 28 + 1 as string) || '/' || cast(p_size % 12 + 1 as string) || '/2019' from part
union all select p_partkey + 4000000, case p_size % 8 when 0 then ' - ' when 1 then 'N/A' when 2 then 'NULL' when 3 then '' when 4 then 'null' when 5 then '1e3' when 6 then 'Benjamin' else '1_000' end from part
union all select p_partkey + 5000000, '  ' || p_name || '  ' from part
"""


@_query(f"""
with r as (select id, raw, trim(raw) as t from ({_RAW})),
u as (select *, trim(regexp_replace(t, '\\s*(cm|kg|%|/h|/t|min\\.|min|slag per minut|kg/m²|kPa)\\s*$', '', 'i')) as b from r),
c as (select *, case when regexp_full_match(b, '-?[0-9]+,[0-9]+') then replace(b, ',', '.') else b end as v from u),
n as (select *, case when regexp_full_match(v, '[+-]?([0-9](_?[0-9])*\\.?([0-9](_?[0-9])*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(replace(v, '_', '') as double) end as x,
  regexp_extract(v, '^([0-9]{{1,4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,4}})$', ['a', 'b', 'c']) as d from c)
select id,
  case when t in ('', '-', 'N/A', 'n/a', 'None', 'null') then 'null' when x is not null then 'num' else 'str' end as kind,
  case when t not in ('', '-', 'N/A', 'n/a', 'None', 'null') then x end as num,
  case when t in ('', '-', 'N/A', 'n/a', 'None', 'null') then null when x is not null then case when x = floor(x) then x::bigint::varchar else x::varchar end
    when length(d.a) = 4 then lpad(d.c, 2, '0') || '-' || lpad(d.b, 2, '0') || '-' || d.a
    when length(d.c) = 4 then lpad(d.a, 2, '0') || '-' || lpad(d.b, 2, '0') || '-' || d.c
    else lower(v) end as txt
from n
""")
def normalize_value_cascade(spark, sf):
    return V.with_normalized(_sql(spark, sf, _RAW, "part")).drop("raw")


@_query("""
select event_id, round(hour(ts) * 60 + minute(ts) + second(ts) / 60.0, 4)::double as minutes, (hour(ts) * 60 + minute(ts))::double as short_minutes from events
""")
def hms_to_minutes(spark, sf):
    ev = _tables(spark, sf, "events")["events"]
    long, short = F.date_format("ts", "HH:mm:ss"), F.date_format("ts", "HH:mm")
    return ev.select("event_id", V.hms_to_minutes(long).alias("minutes"), V.hms_to_minutes(short).alias("short_minutes"))


_FLAGS = "select doc_id, quality, case (doc_id + quality) % 7 when 0 then 'Ja' when 1 then 'nej' when 2 then ' J ' when 3 then 'måske' when 4 then '1' when 5 then 'NO' else null end as word from labels"


@_query(f"""
select doc_id, case when lower(trim(word)) in ('ja', 'yes', 'true', '1', 'j') then true when lower(trim(word)) in ('nej', 'no', 'false', '0', 'n') then false end as flag,
  case when quality = 0 then 'nej' else 'ja' end as flag_text from ({_FLAGS})
""")
def to_boolean(spark, sf):
    rows = _sql(spark, sf, _FLAGS, "labels")
    return rows.select("doc_id", V.to_boolean(F.col("word")).alias("flag"), V.to_flag_text(F.col("quality").cast("string"), F.lit("num")).alias("flag_text"))


_NESTED = "select event_id, '{\"a\": {\"b\": ' || props || ', \"list\": [1, 2], \"none\": null, \"empty\": {}}, \"type\": \"' || event_type || '\"}' as raw from events"


@_query(f"""
with n as (select event_id, json(raw) as j from ({_NESTED}))
select event_id, 'a.b.k' as path, j->>'$.a.b.k' as raw, 'BIGINT' as jtype from n
union all select event_id, 'a.list', '[1,2]', 'ARRAY' from n
union all select event_id, 'a.none', null, 'VOID' from n
union all select event_id, 'type', j->>'$.type', 'STRING' from n
""")
def flatten_json(spark, sf):
    good, _ = records.parse(_sql(spark, sf, _NESTED, "events"))
    return records.flatten(good, ["event_id"])


_RESPONSES = "select event_id, case event_id % 4 when 0 then '```json' || chr(10) || props || chr(10) || '```' when 1 then 'Here: ' || props || ' done.' when 2 then props else 'no object' end as response, props from events"


@_query(f"select event_id, case when event_id % 4 <> 3 then props end as body from ({_RESPONSES})")
def json_response_slice(spark, sf):
    return _sql(spark, sf, _RESPONSES, "events").select("event_id", V.response_json(F.col("response")).alias("body"))


_MEASURES = """
select c_custkey as id, 'patient.BMI' as path, cast(cast(floor(c_acctbal / 50) as bigint) as string) || ' kg/m²' as raw from customer
union all select p_partkey, 'patient.ESS', cast(p_size as string) from part
union all select event_id, 'respirations_analyse.ahi_total', cast(cast(floor(value) as bigint) as string) || ',5' from events
"""


@_query(f"""
with m as (select *, try_cast(regexp_extract(replace(raw, ',', '.'), '[-+]?[0-9]+(\\.[0-9]+)?') as double) as number from ({_MEASURES}))
select id, path, raw as value, number from m
where (path = 'patient.BMI' and not (number > 10 and number < 80)) or (path = 'patient.ESS' and (number < 0 or number > 24)) or (path = 'respirations_analyse.ahi_total' and number > 150)
""")
def range_validation(spark, sf):
    return checks.range_warnings(_sql(spark, sf, _MEASURES, "customer", "part", "events"), ["id"])


_TURNS = "select conv_id, turn, text, lead(text) over (partition by conv_id order by turn, text) as next from conversations"


@_query(f"""
with p as (select conv_id, turn, text, next, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(next), '\\s+'), lambda w: w <> '')) as b from ({_TURNS})),
s as (select *, len(list_intersect(a, b))::double as common from p)
select conv_id, turn, round(case when coalesce(text, '') = '' and coalesce(next, '') = '' then 1.0 when coalesce(text, '') = '' or coalesce(next, '') = '' or common = 0 then 0.0
  else 2 * (common / len(b)) * (common / len(a)) / (common / len(b) + common / len(a)) end, 6)::double as f1 from s
""")
def token_f1_pairs(spark, sf):
    pairs = _sql(spark, sf, _TURNS, "conversations")
    return pairs.select("conv_id", "turn", F.round(V.token_f1(F.col("text"), F.col("next"))["f1"], 6).alias("f1"))


_PRICES = "select l_orderkey, l_linenumber, l_extendedprice / l_quantity as price, p_retailprice as listed from lineitem l join part p on l.l_partkey = p.p_partkey"


@_query(f"""
select l_orderkey, l_linenumber, count(*) as n, count_if(case when price = 0 and listed = 0 then true when price = 0 or listed = 0 then abs(price - listed) <= 0.05
  else abs(price - listed) / greatest(abs(price), abs(listed)) <= 0.05 end)::bigint as n_match from ({_PRICES}) group by all
""")
def tolerance_match(spark, sf):
    rows = _sql(spark, sf, _PRICES, "lineitem", "part").withColumn("near", V.tolerance_match(F.col("price"), F.col("listed")))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if("near").alias("n_match"))


# ---- files ----

_LEFT_FILES = "select case when doc_id % 3 = 0 then 'a' || cast(doc_id as string) when doc_id % 3 = 1 then 'trial' || cast(doc_id as string) else 'x' end || '.json' as file_name from documents"
_RIGHT_FILES = "select case when doc_id % 3 = 0 then 'a' || cast(doc_id as string) when doc_id % 5 = 1 then 'patient' || cast(doc_id as string) else 'other' || cast(doc_id % 4 as string) end || '.json' as file_name from documents"
_MATCH = f"""
with l as (select distinct file_name from ({_LEFT_FILES})), r as (select distinct file_name from ({_RIGHT_FILES})),
x as (select l.file_name as left_file, r.file_name as right_file from l join r using (file_name)),
lr as (select file_name, nullif(regexp_extract(file_name, '[0-9]+'), '')::bigint as number from l where file_name not in (select left_file from x)),
rr as (select file_name, nullif(regexp_extract(file_name, '[0-9]+'), '')::bigint as number from r where file_name not in (select right_file from x)),
n as (select a.f as left_file, b.f as right_file from (select number, max(file_name) as f from lr where number is not null group by 1) a join (select number, max(file_name) as f from rr where number is not null group by 1) b using (number))
select left_file, right_file, 'exact' as match_kind from x union all select left_file, right_file, 'number' from n
union all select file_name, null, 'unpaired' from lr where file_name not in (select left_file from n)
union all select null, file_name, 'unpaired' from rr where file_name not in (select right_file from n)
"""


@_query(_MATCH)
def file_match(spark, sf):
    return match.match_files(_sql(spark, sf, _LEFT_FILES, "documents"), _sql(spark, sf, _RIGHT_FILES, "documents")).drop("pair_ord")


_FOLDERS = "select doc_id as trial, 'documents' as folder from documents union all select doc_id, 'labels' from labels union all select item_id, 'benchmark' from benchmark"


@_query(f"select trial, count(distinct folder)::bigint as n_present, count(distinct folder) = 3 as complete from ({_FOLDERS}) group by trial")
def trial_alignment(spark, sf):
    return match.align_trials(_sql(spark, sf, _FOLDERS, "documents", "labels", "benchmark"), 3)


@_query(f"""
with t as (select distinct trial, folder from ({_FOLDERS})), f as (select unnest(['documents', 'labels', 'benchmark']) as folder)
select a.trial, f.folder from (select distinct trial from t) a, f where (a.trial, f.folder) not in (select (trial, folder) from t)
""")
def trial_missing(spark, sf):
    return match.missing_trials(_sql(spark, sf, _FOLDERS, "documents", "labels", "benchmark"), ["documents", "labels", "benchmark"])


@_query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def resume_anti_join(spark, sf):
    t = _tables(spark, sf, "documents", "labels")
    return checks.not_done(t["documents"].select("doc_id", "lang"), t["labels"], "doc_id")


_LOG = "select event_type as model, case event_id % 10 when 0 then 'error' when 1 then 'skipped' else 'ok' end as status, cast(user_id as bigint) as tokens, cast(1 + event_id % 3 as double) as seconds from events"


@_query(f"""
select model, count_if(status = 'ok')::bigint as n_ok, count_if(status = 'error')::bigint as n_error, count_if(status = 'skipped')::bigint as n_skipped,
  sum(tokens)::bigint as tokens, sum(seconds) as seconds, round(sum(tokens) / sum(seconds), 4) as tokens_a_second from ({_LOG}) group by model
""")
def batch_status(spark, sf):
    log = _sql(spark, sf, _LOG, "events")
    speed = checks.throughput(log, by=("model",)).withColumn("tokens_a_second", F.round("tokens_a_second", 4))
    return checks.status_counts(log, ("model",)).join(speed, "model")


# ---- comparison ----

#: An evaluated record and a reference for each order, with numbers, words, free text, a skipped path and one without a topic.
_SIDE = """
select o_orderkey as pair_id, 'respirations_analyse.ahi_total' as path, {number} as raw from orders
union all select o_orderkey, 'hjerte.ekg_bemaerkninger', {word} from orders
union all select o_orderkey, 'konklusion_og_plan.plan', {free} from orders
union all select o_orderkey, 'patient.BMI', {body} from orders where o_orderkey % {gap} <> 0
union all select o_orderkey, 'metadata.filnavn', 'file' from orders
union all select o_orderkey, 'kommentar', {lone} from orders
"""
_PRICE = "cast(o_totalprice as decimal(18,2))"
_L = _SIDE.format(number=f"cast({_PRICE} as string)", word="o_orderpriority", free="o_orderpriority || ' ' || o_orderstatus || ' plan for control'", body="cast(o_orderkey % 40 + 10 as string) || ' kg/m²'", gap=11, lone="case when o_orderkey % 2 = 0 then 'ja' else 'N/A' end")
_R = _SIDE.format(
    number=f"case o_orderkey % 5 when 0 then cast({_PRICE} as string) when 1 then cast({_PRICE} + 1 as string) when 2 then null when 3 then cast({_PRICE} * 2 as string) else 'ca. 5' end",
    word="case o_orderkey % 4 when 0 then upper(o_orderpriority) when 1 then '-' when 2 then 'other' else ' ' || o_orderpriority end",
    free="case o_orderkey % 4 when 0 then 'plan for control' when 1 then o_orderpriority || ' ' || o_orderstatus || ' Plan for control' when 2 then '' else 'none' end",
    body="cast(o_orderkey % 40 + 10 + case when o_orderkey % 6 = 0 then 1 else 0 end as string)", gap=13, lone="'Ja'",
)


def _norm(sql: str) -> str:
    """The values of a side as the cascade makes them of these few forms."""
    return f"""(select pair_id, path, case when raw is null or trim(raw) in ('', '-', 'N/A') then 'null' when try_cast(regexp_replace(trim(raw), ' kg/m²$', '') as double) is not null then 'num' else 'str' end as kind,
      case when trim(raw) not in ('', '-', 'N/A') then try_cast(regexp_replace(trim(raw), ' kg/m²$', '') as double) end as num, lower(trim(raw)) as txt from ({sql}) where path <> 'metadata.filnavn')"""


_COMPARED = f"""
with l as {_norm(_L)}, r as {_norm(_R)},
b as (select coalesce(l.pair_id, r.pair_id) as pair_id, coalesce(l.path, r.path) as path, coalesce(l.kind, 'null') as lk, coalesce(r.kind, 'null') as rk, l.num as ln, r.num as rn,
  case when l.kind <> 'null' then l.txt end as lt, case when r.kind <> 'null' then r.txt end as rt from l full join r on l.pair_id = r.pair_id and l.path = r.path),
t as (select *, case when path = 'konklusion_og_plan.plan' then 'free_text' when path = 'hjerte.ekg_bemaerkninger' then 'nominal' when lk = 'num' or rk = 'num' then 'numeric' else 'nominal' end as field_type,
  case path when 'respirations_analyse.ahi_total' then 'Respirationsanalyse' when 'hjerte.ekg_bemaerkninger' then 'Hjerte' when 'konklusion_og_plan.plan' then 'Konklusion og plan' when 'patient.BMI' then 'Patient & metadata' else 'Andet' end as topic,
  case when lk = 'null' and rk = 'null' then 'both_missing' when lk = 'null' then 'left_missing' when rk = 'null' then 'right_missing' else 'filled' end as status,
  list_distinct(string_split(lt, ' ')) as la, list_distinct(string_split(rt, ' ')) as ra from b),
f as (select *, len(list_intersect(la, ra))::double as common from t),
g as (select *, case when status = 'filled' and field_type = 'free_text' then case when common = 0 then 0.0 else 2 * (common / len(ra)) * (common / len(la)) / (common / len(ra) + common / len(la)) end end as f1,
  status = 'filled' and field_type = 'numeric' and ln is not null and rn is not null as numbers from f),
compared as (select pair_id, path, topic, field_type, status,
  case when status = 'both_missing' then null when status <> 'filled' then false when field_type = 'free_text' then f1 >= 0.8 when numbers then ln = rn else lt = rt end as agrees, f1,
  case when numbers then case when ln = 0 and rn = 0 then true when ln = 0 or rn = 0 then abs(ln - rn) <= 0.05 else abs(ln - rn) / greatest(abs(ln), abs(rn)) <= 0.05 end end as tolerance,
  case when numbers then round(abs(ln - rn), 4) end as deviation from g)
"""


def _sides(spark, sf) -> list[DataFrame]:
    return [records.with_values(_sql(spark, sf, q, "orders").withColumn("jtype", F.lit("STRING"))) for q in (_L, _R)]


def _n_fields(spark, sf) -> int:
    """Rows of both sides: six each an order."""
    return 12 * _tables(spark, sf, "orders")["orders"].count()


def _compared(spark, sf) -> DataFrame:
    return compare.compare_fields(*_sides(spark, sf), rows=_n_fields(spark, sf))


@_query(f"{_COMPARED} select pair_id, path, topic, field_type, status, agrees, round(f1, 6)::double as f1, tolerance, round(deviation, 2) as deviation from compared")
def field_compare(spark, sf):
    return _compared(spark, sf).drop("left_value", "right_value").withColumns({"f1": F.round("f1", 6), "deviation": F.round("deviation", 2)})


_FIELD_STATS = f"""{_COMPARED}, fields as (
  select path, min(field_type) as field_type, min(topic) as topic, count(agrees) as n_compared, count_if(agrees)::bigint as n_agree, count_if(not agrees)::bigint as n_disagree,
    count_if(status = 'left_missing')::bigint as n_left_missing, count_if(status = 'right_missing')::bigint as n_right_missing, count_if(status = 'both_missing')::bigint as n_both_missing,
    coalesce(sum(round(f1, 3)), 0.0)::double as f1_sum, count(f1) as f1_n, coalesce(count_if(tolerance), 0)::bigint as n_tolerance, count(tolerance) as tolerance_n, avg(deviation) as mean_deviation from compared group by path)
"""


@_query(f"""{_FIELD_STATS} select * replace (round(f1_sum, 3) as f1_sum, round(mean_deviation, 1) as mean_deviation), round(n_agree / n_compared, 3)::double as agreement_rate, round(n_disagree / n_compared, 3)::double as disagreement_rate,
  round(f1_sum / nullif(f1_n, 0), 3)::double as mean_f1, round(n_tolerance / nullif(tolerance_n, 0), 3)::double as tolerance_rate from fields""")
def field_stats(spark, sf):
    return stats.field_stats(_compared(spark, sf)).withColumns({"f1_sum": F.round("f1_sum", 3), "mean_deviation": F.round("mean_deviation", 1)})


@_query(f"""{_FIELD_STATS} select topic, count(*) as n_fields, sum(n_compared)::bigint as n_compared, sum(n_agree)::bigint as n_agree, sum(n_disagree)::bigint as n_disagree, sum(n_left_missing)::bigint as n_left_missing,
  sum(n_right_missing)::bigint as n_right_missing, sum(n_both_missing)::bigint as n_both_missing, round(sum(f1_sum), 3) as f1_sum, sum(f1_n)::bigint as f1_n,
  round(sum(n_agree) / sum(n_compared), 3)::double as agreement_rate, round(sum(f1_sum) / nullif(sum(f1_n), 0), 3)::double as mean_f1 from fields group by topic""")
def group_stats(spark, sf):
    return stats.topic_stats(stats.field_stats(_compared(spark, sf))).withColumn("f1_sum", F.round("f1_sum", 3))


@_query(f"""{_FIELD_STATS} select count(*) as n_fields, sum(n_compared)::bigint as n_compared, sum(n_agree)::bigint as n_agree, sum(n_disagree)::bigint as n_disagree, sum(n_left_missing)::bigint as n_left_missing,
  sum(n_right_missing)::bigint as n_right_missing, sum(n_both_missing)::bigint as n_both_missing, {_mean('round(f1_sum / nullif(f1_n, 0), 3)')}::double as mean_f1,
  round(100 * sum(n_agree) / sum(n_compared), 1)::double as agree_percent, round(100 * sum(n_disagree) / sum(n_compared), 1)::double as disagree_percent from fields""")
def grand_totals(spark, sf):
    return stats.grand_totals(stats.field_stats(_compared(spark, sf)))


@_query(f"""{_COMPARED} select case when grouping(path) = 0 then 'field' when grouping(topic) = 0 then 'topic' else 'total' end as level, topic, path, count(agrees) as n_compared, count_if(agrees)::bigint as n_agree,
  round(count_if(agrees) / count(agrees), 3)::double as agreement_rate from compared group by rollup (topic, path)""")
def rollup_stats(spark, sf):
    return stats.rollup_stats(_compared(spark, sf))


@_query(f"{_FIELD_STATS} select path, n_disagree, round(n_agree / n_compared, 3)::double as agreement_rate from fields where n_disagree > 0 order by n_disagree desc, n_agree / n_compared, path limit 3")
def top_disagreements(spark, sf):
    return stats.by_disagreement(stats.field_stats(_compared(spark, sf)), 3).select("path", "n_disagree", "agreement_rate")


@_query(f"""{_COMPARED} select path, pair_id, round((case when status = 'both_missing' then -1 when status <> 'filled' then 0.3 when agrees then 1 else coalesce(f1, 0) end + 1) / 2, 6)::double as cell from compared""")
def heatmap_cells(spark, sf):
    return views.heatmap(_compared(spark, sf)).withColumn("cell", F.round("cell", 6))


# ---- agreement ----

_ALPHA_N = """
c as (select unit, v, count(*) as n from r where v is not null group by all),
m as (select *, sum(n) over (partition by unit) as m from c), k as (select * from m where m > 1),
o as (select sum(n) as n, sum(n * (m - n) / (m - 1)) as d from k), e as (select sum(t * t)::double as s from (select v, sum(n)::double as t from k group by v))
select o.n::bigint as n_values, round(1 - (o.d / o.n) / nullif((o.n::double * o.n - e.s) / (o.n::double * (o.n - 1)), 0), 6)::double as alpha from o, e
"""


@_query("with r as (select doc_id as unit, quality as v from labels union all select doc_id, toxic from labels)," + _ALPHA_N)
def alpha_nominal_labels(spark, sf):
    labels = _tables(spark, sf, "labels")["labels"]
    both = labels.select("doc_id", F.explode(F.array("quality", "toxic")).alias("v"))
    return agreement.alpha_nominal(both, "doc_id", "v").withColumn("alpha", F.round("alpha", 6))


@_query("with r as (select l_orderkey as unit, l_returnflag as v from lineitem)," + _ALPHA_N)
def alpha_nominal_multi(spark, sf):
    return agreement.alpha_nominal(_tables(spark, sf, "lineitem")["lineitem"], "l_orderkey", "l_returnflag").withColumn("alpha", F.round("alpha", 6))


@_query("""
with u as (select l_orderkey, count(l_quantity) as m, var_pop(l_quantity) as v from lineitem group by 1 having count(l_quantity) > 1),
a as (select count(*) as n, var_pop(l_quantity) as v from lineitem where l_quantity is not null and l_orderkey in (select l_orderkey from u)),
o as (select sum(2.0 * m * m * v / (m - 1)) as d from u)
select a.n as n_values, round(1 - (o.d / a.n) / (2.0 * a.n * a.n * a.v / (a.n::double * (a.n - 1))), 6)::double as alpha from a, o
""")
def alpha_interval_multi(spark, sf):
    return agreement.alpha_interval(_tables(spark, sf, "lineitem")["lineitem"], "l_orderkey", "l_quantity").withColumn("alpha", F.round("alpha", 6))


_RATED = "select o_orderkey as unit, k as rater, case when o_orderkey % (k + 5) <> 0 then o_orderstatus end as v from orders, (select 1 as k union all select 2 union all select 3) as r"


@_query(f"select rater, count(v) as n_filled, (select count(distinct unit) from ({_RATED})) as n_units, round(100 * count(v) / (select count(distinct unit) from ({_RATED})), 1)::double as percent from ({_RATED}) group by rater")
def coverage(spark, sf):
    return agreement.coverage(_sql(spark, sf, _RATED, "orders"), "unit", "rater", "v")


@_query(f"""with u as (select unit, count(v) as m from ({_RATED}) group by 1)
select count_if(m >= 3)::bigint as n_complete, count_if(m = 0)::bigint as n_empty, count_if(m < 3 and m > 0)::bigint as n_partial, count_if(m >= 3) >= 10 as reliable from u""")
def alpha_unit_counts(spark, sf):
    return agreement.unit_counts(_sql(spark, sf, _RATED, "orders"), "unit", "v", 3)


_ITEMS = "select l_orderkey as unit, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as rater, l_returnflag as v from lineitem"


@_query(f"""with r as ({_ITEMS}) select a.rater as a_rater, b.rater as b_rater, count(*) as n_pairs, count_if(a.v = b.v)::bigint as n_exact from r a join r b on a.unit = b.unit and a.rater < b.rater group by all""")
def pairwise_exact(spark, sf):
    pairs = agreement.rater_pairs(_sql(spark, sf, _ITEMS, "lineitem"), "unit", "rater", ["v"])
    return pairs.groupBy("a_rater", "b_rater").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("a_v") == F.col("b_v")).alias("n_exact"))


# ---- models ----

#: A score of each event's value against the smallest value of its user; the event's type is the model, the user the field.
_SCORES = """
select event_type as model, 'f' || cast(user_id % 40 as string) || '.x' as path, 'g' || cast(user_id % 4 as string) as topic, round(cast(event_id % 101 as double) / 101, 3) as s, event_id % 17 = 0 as model_missing, event_id % 13 = 0 as truth_missing from events
"""
_MODELS = f"""
with s as (select *, case when truth_missing then null when model_missing then 0.0 else s end as score from ({_SCORES})),
fields as (select model, path, min(topic) as topic, count(*) as n, count(score) as n_scored, count_if(model_missing and not truth_missing)::bigint as n_missing, count_if(model_missing and truth_missing)::bigint as n_both_missing, {_mean('score')}::double as mean_score from s group by model, path)
"""


def _scores(spark, sf) -> DataFrame:
    rows = _sql(spark, sf, _SCORES, "events")
    return rows.withColumn("score", F.when(F.col("truth_missing"), None).when(F.col("model_missing"), 0.0).otherwise(F.col("s")))


@_query(f"{_MODELS} select * from fields")
def model_scores(spark, sf):
    return stats.model_field_stats(_scores(spark, sf))


@_query(f"{_MODELS}, t as (select model, {_mean('mean_score')}::double as score from fields group by model) select model, score, row_number() over (order by coalesce(score, 0) desc, model)::integer as rank from t")
def model_ranking(spark, sf):
    return stats.ranked(stats.model_totals(stats.model_field_stats(_scores(spark, sf))))


@_query(f"{_MODELS} select model, topic, count(score) as n_scored, {_mean('score')}::double as mean_score from s group by model, topic")
def model_group_scores(spark, sf):
    return stats.model_topic_stats(_scores(spark, sf))


_CROSS = f"""{_MODELS}, x as (select path, min(topic) as topic, count(*) as n_models, {_mean('mean_score')}::double as mean_score, round(max(mean_score) - min(mean_score), 3)::double as spread,
  min({{'s': -mean_score, 'm': model}}).m as best_model, min({{'s': mean_score, 'm': model}}).m as worst_model from fields where mean_score is not null group by path having count(*) > 1)
"""


@_query(f"{_CROSS} select * from x")
def cross_model(spark, sf):
    return stats.cross_model(stats.model_field_stats(_scores(spark, sf))).drop("scores")


@_query(f"{_CROSS} select * from x where n_models = (select count(distinct model) from s) and mean_score < 0.5 order by mean_score, path limit 20")
def hard_fields(spark, sf):
    fields = stats.model_field_stats(_scores(spark, sf))
    n_models = fields.select("model").distinct().count()
    return stats.hard_fields(stats.cross_model(fields), n_models).drop("scores")


@_query(f"{_CROSS} select * from x where spread >= 0.05 order by spread desc, path limit 15")
def spread_fields(spark, sf):
    return stats.spread_fields(stats.cross_model(stats.model_field_stats(_scores(spark, sf))), 0.05).drop("scores")


@_query(f"{_MODELS} select model, topic, {_mean('mean_score')}::double as mean_score from fields group by model, topic")
def radar_groups(spark, sf):
    return stats.radar(stats.model_field_stats(_scores(spark, sf)))
