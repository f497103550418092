"""Nested JSON records as one long table of leaves, their normalisation and repair."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.values import hms_to_minutes, let, to_boolean, to_flag_text, with_normalized
from accordance.sources.staging import stored

# Paths that ground truth repair gives a type.
FLAG_PATHS = ("oget_muskelaktivitet_rem.chin", "oget_muskelaktivitet_rem.tib", "oget_muskelaktivitet_rem.fds")
MINUTE_PATHS = (
    "soevn_opsummering.tid_i_seng_trt_min",
    "soevn_opsummering.total_soevntid_tst_min",
    "soevn_opsummering.soveperiode_min",
    "soevn_opsummering.soevnlatens_min",
    "soevn_opsummering.rem_latens_min",
)
STAGE_MINUTES = r"^soevnstadier\.[^.]+\.(latens_min|varighed_min)$"
YES_NO_PATHS = ("sammenfatning.anfald", "sammenfatning.fokal", "sammenfatning.paroksystisk_aktivitet")


def parse(records: DataFrame, raw: str = "raw", fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records whose text is a JSON object, with it as the column v; and the others, with a reason, for a dead letter table.

    Texts with a repeated key, NaN or anything after the value are no JSON here. Null texts are dead letters too. ``fail_fast``: the first text that
    is no JSON ends the job.
    """
    parsed = _parsed(records, raw, fail_fast)
    return parsed.where("reason is null").drop(raw, "reason"), parsed.where("reason is not null").drop("v")


def _variant(text: Column, fail_fast: bool = False) -> Column:
    """The one JSON value that a text is; null for any other text. A parser stops after the first value, so what follows is
    found by reading the text as the only member of an array, and where it could end that, of an object too."""
    parse = F.parse_json if fail_fast else F.try_parse_json
    closing = text.rlike(r"[\]][\s]*,[\s]*[\[]")
    member = F.when(closing, F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()).otherwise(True)
    alone = lambda whole: F.try_variant_get(whole, "$[1]", "variant").isNull() & member
    return let(parse(F.concat(F.lit("["), text, F.lit("]"))), lambda whole: F.when(alone(whole), F.try_variant_get(whole, "$[0]", "variant")))


def _parsed(records: DataFrame, raw: str, fail_fast: bool = False) -> DataFrame:
    """``records`` with v, and with the reason why a text is no object; null for an object."""
    v = _variant(F.col(raw), fail_fast)
    kind = lambda x: F.when(x.isNull(), "no JSON").when(~F.schema_of_variant(x).startswith("OBJECT"), "no object")
    return records.withColumns({"v": v, "reason": F.when(F.col(raw).isNull(), "no text").otherwise(let(v, kind))})


def with_context(dead: DataFrame, raw: str = "raw", lines: int = 2) -> DataFrame:
    """``dead`` with error, line, column and context: what is wrong with each text, where, and so many lines before and after. Null if nothing is."""

    @F.pandas_udf("error string, line int, column int, context string")
    def explain(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            try:
                json.loads(text or "")
                found.append((None, None, None, None))
            except json.JSONDecodeError as e:
                all_lines = (text or "").split("\n")
                first = max(0, e.lineno - 1 - lines)
                context = "\n".join(f"{k:5d}: {t}" for k, t in enumerate(all_lines[first : e.lineno + lines], first + 1))
                found.append((e.msg, e.lineno, e.colno, context))
        return pd.DataFrame(found, columns=["error", "line", "column", "context"]).astype({"line": "Int32", "column": "Int32"})

    return dead.withColumn("_e", explain(F.col(raw))).select(*dead.columns, "_e.*")


#: What the type of a leaf is told by: its JSON is written as it stands, or in quotes.
_PLAIN = "^(ARRAY|OBJECT|BOOLEAN|BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"
#: Where a leaf is: at each level its place among the object's members, from 0, and its name.
SEGMENTS = "array<struct<ordinal:int,key:string>>"
#: Levels of objects that are opened before the rest is looked at.
LEVELS = 4


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return let(F.to_json(F.array(text)), lambda j: F.substring(j, 2, F.length(j) - 2))


def json_value(raw: Column, jtype: Column) -> Column:
    """The JSON of a leaf by its type, so that the text 123 and the number 123 stay apart."""
    return F.when(raw.isNull() | (jtype == "VOID"), "null").when(jtype.rlike(_PLAIN), raw).otherwise(_quoted(raw))


def _jtype(v: Column) -> Column:
    """The type of a variant: that of a number in full, ARRAY, OBJECT, or OBJECT<> for an empty one."""
    of = lambda name: F.when(name.startswith("ARRAY"), "ARRAY").when(name == "OBJECT<>", name).when(name.startswith("OBJECT"), "OBJECT").otherwise(name)
    return let(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), of)


def members(text: Column) -> Column:
    """The members of an object's JSON in their order: ordinal, key, raw (text, number or JSON; null for null) and jtype."""
    raws = F.map_values(F.from_json(text, "map<string,string>"))
    zipped = let(F.from_json(text, "map<string,variant>"), lambda values: F.arrays_zip(F.map_keys(values).alias("key"), raws.alias("raw"), F.transform(F.map_values(values), _jtype).alias("jtype")))
    return F.transform(zipped, lambda m, k: F.struct(k.alias("ordinal"), m["key"].alias("key"), m["raw"].alias("raw"), m["jtype"].alias("jtype")))


def leaves(records: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, segments, path, raw and jtype of every leaf of the objects in ``raw``, at any depth.

    Arrays and empty objects are leaves; an empty record is one without segments. Segments tell the order of all members and
    names with points apart; path joins the names by points. Other texts than objects, also null, have no leaves. Each round
    opens LEVELS levels and writes what it finds; rounds go on with the objects that are left, until none is.
    """
    whole = _variant(F.col(raw))
    at = records.select(*keys, F.array().cast(SEGMENTS).alias("segments"), F.col(raw).alias("raw"), _jtype(whole).alias("jtype"))
    at, found = at.where(F.startswith("jtype", F.lit("OBJECT"))), None
    while True:
        for _ in range(LEVELS):
            inner = at.withColumn("_m", F.explode_outer(F.when(F.col("jtype") == "OBJECT", members(F.col("raw")))))
            has = F.col("_m").isNotNull()
            step = F.concat("segments", F.array(F.struct("_m.ordinal", "_m.key")))
            at = inner.select(*keys, F.when(has, step).otherwise(F.col("segments")).alias("segments"), F.when(has, F.col("_m.raw")).otherwise(F.col("raw")).alias("raw"), F.when(has, F.col("_m.jtype")).otherwise(F.col("jtype")).alias("jtype"))
        at = stored(at)
        part = at.where("jtype <> 'OBJECT'")
        found, at = part if found is None else found.unionByName(part), at.where("jtype = 'OBJECT'")
        if at.isEmpty():
            break
    return found.withColumn("path", F.array_join(F.transform("segments", lambda s: s["key"]), "."))


def _shared(a: Column, b: Column) -> Column:
    """How many segments two leaves begin with alike; of either's own last one there is no question."""
    most = F.least(F.size(a), F.size(b)) - 1
    count = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & F.get(a, k - 1).eqNullSafe(F.get(b, k - 1)), k).otherwise(n))
    return F.when(most < 1, 0).otherwise(count)


def nested(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """keys and raw, the compact JSON of each record, from its leaves (segments or path, raw, jtype), at any depth.

    With segments, as ``leaves`` gives them, members have their order, and empty objects and names with points are as they
    were; with a path only, points part the names and members stand in the order of their names. Neighbours in the order
    tell which objects end and begin between them, so a record is one sorted list of its leaves and nothing is nested.
    """
    by_path = F.transform(F.split("path", r"\."), lambda n: F.struct(F.lit(0).alias("ordinal"), n.alias("key")))
    at = F.col("segments") if "segments" in leaves.columns else by_path
    rows = leaves.select(*keys, F.struct(at.alias("at"), json_value(F.col("raw"), F.col("jtype")).alias("value")).alias("leaf"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("leaf")).alias("_all"))

    def piece(leaf: Column, k: Column) -> Column:
        before = F.get("_all", k - 1)["at"]

        def after(common: Column) -> Column:
            ends = F.when(k == 0, "{").otherwise(F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - common), F.lit(",")))
            names = F.transform(F.slice(leaf["at"], common + 1, F.size(leaf["at"]) - common), lambda s: F.concat(_quoted(s["key"]), F.lit(":")))
            return F.concat(ends, F.array_join(names, "{"), leaf["value"])

        return let(F.when(k == 0, 0).otherwise(_shared(before, leaf["at"])), after)

    last = F.size(F.element_at("_all", -1)["at"])
    made = F.concat(F.array_join(F.transform("_all", piece), ""), F.repeat(F.lit("}"), last))
    return rows.select(*keys, F.when(last == 0, F.element_at("_all", -1)["value"]).otherwise(made).alias("raw"))


def repaired_records(records: DataFrame, keys: list[str], raw: str = "raw") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The repaired records as JSON (keys, raw), the log of changes, and the records that can't be read.

    Every record is in the first or the last. But for the repaired leaves, records keep their members, order and types.
    """
    parsed = _parsed(records, raw)
    at = leaves(parsed.where("reason is null"), keys, raw)
    pointed = F.exists("segments", lambda s: s["key"].contains("."))  # no name with a point is one of the repaired ones
    repaired = repair(at.withColumn("path", F.when(~pointed, F.col("path"))))
    made = nested(repaired.select(*keys, "segments", F.col("new_raw").alias("raw"), F.col("new_jtype").alias("jtype")), keys)
    return made, change_log(repaired, keys), parsed.where("reason is not null").drop("v")


def flatten(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path (dotted), raw (the leaf's text) and jtype of every leaf of the objects in v, at any depth.

    Arrays are leaves, with their JSON as text; empty objects have none. Each round opens LEVELS levels in one pass, all in
    the JVM, and writes what it finds; rounds go on with the objects that are left, until none is.
    """
    spark = parsed.sparkSession
    names = ", ".join(f"`{k}`" for k in keys)
    own = [f"`{k}`" for k in keys]
    at, found = parsed.selectExpr(*own, "cast('' as string) as path", "v"), None
    while True:
        for _ in range(LEVELS):
            at = spark.sql(
                f"""
                select {names}, path, v, open, key, value from (
                  select *, coalesce(schema_of_variant(v) like 'OBJECT%', false) as open from {{at}}) as t,
                lateral variant_explode_outer(case when open then v end)
                """,
                at=at,
            )
            at = at.where("not open or key is not null").selectExpr(
                *own,
                "case when not open then path when path = '' then key else concat(path, '.', key) end as path",
                "case when open then value else v end as v",
            )
        jtype = _jtype(F.col("v"))
        text = F.when(jtype == "VOID", None).when(jtype.rlike("^(ARRAY|OBJECT)"), F.to_json("v")).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
        at = stored(at.select(*keys, "path", text.alias("raw"), jtype.alias("jtype")).where("jtype <> 'OBJECT<>'"))
        part = at.where("jtype <> 'OBJECT'")
        found, at = part if found is None else found.unionByName(part), at.where("jtype = 'OBJECT'")
        if at.isEmpty():
            return found
        at = at.select(*keys, "path", F.parse_json("raw").alias("v"))


def with_values(leaves: DataFrame) -> DataFrame:
    """``leaves`` with kind, num and txt of each value instead of raw and jtype."""
    return with_normalized(leaves, "raw", "jtype").drop("raw", "jtype")


def annotations(records: DataFrame, keys: list[str], raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Records as a long table of normalised values, and the records that can't be read."""
    good, bad = parse(records, raw)
    return with_values(flatten(good, keys)), bad


def _kind(jtype: Column) -> Column:
    return F.when(jtype == "BOOLEAN", "bool").when(jtype == "VOID", "null").when(jtype.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "num").otherwise("str")


def repair(leaves: DataFrame) -> DataFrame:
    """``leaves`` (path, raw, jtype) with new_raw, new_jtype and changed.

    Muscle flags become booleans (null if unclear), stage and summary times minutes, and three summary
    texts yes or no in Danish. Times that can't be read stay. A flag of 1 or 0 equals its boolean and stays.
    """
    path, raw, kind = F.col("path"), F.col("raw"), _kind(F.col("jtype"))
    flag = F.when(kind == "bool", F.lower(raw) == "true").otherwise(to_boolean(raw, kind))
    same_flag = (kind == "num") & raw.try_cast("double").isin(0.0, 1.0)
    time = hms_to_minutes(raw)
    is_flag, is_text = path.isin(*FLAG_PATHS), path.isin(*YES_NO_PATHS)
    is_time = (path.isin(*MINUTE_PATHS) | path.rlike(STAGE_MINUTES)) & (kind == "str") & time.isNotNull()
    text = F.when(kind == "null", None).otherwise(to_flag_text(raw, kind))
    nothing = F.lit(None).cast("string")
    new_raw = F.when(is_flag & ~same_flag, flag.cast("string")).when(is_time, time.cast("string")).when(is_text, text).otherwise(raw)
    new_type = F.when(is_flag & ~same_flag, F.when(flag.isNull(), "VOID").otherwise("BOOLEAN")).when(is_time, "DOUBLE").when(is_text & (kind != "null"), "STRING").otherwise(F.col("jtype"))
    out = leaves.withColumns({"new_raw": F.when(F.lit(True), new_raw).otherwise(nothing), "new_jtype": new_type})
    numbers = (kind == "num") & (_kind(F.col("new_jtype")) == "num")
    equal = F.col("raw").eqNullSafe(F.col("new_raw")) & (_kind(F.col("jtype")) == _kind(F.col("new_jtype")))
    return out.withColumn("changed", ~F.when(numbers, raw.try_cast("double").eqNullSafe(F.col("new_raw").try_cast("double"))).otherwise(equal))


def change_log(repaired: DataFrame, keys: list[str]) -> DataFrame:
    """The changed leaves: keys, path, old and new."""
    return repaired.where("changed").select(*keys, "path", F.col("raw").alias("old"), F.col("new_raw").alias("new"))


def change_counts(repaired: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n_changed of every record, 0 included."""
    return repaired.groupBy(*keys).agg(F.count_if("changed").alias("n_changed"))


def stamped(records: DataFrame, name: Column, author: Column, raw: str = "raw") -> DataFrame:
    """``records`` with the file's name and the author written into the record's metadata; null where that section is no object.

    Members keep their order and types; the two take the place of those that are there, else they come last.
    """
    fresh = F.array(*(F.struct(F.lit(key).alias("key"), F.coalesce(_quoted(value), F.lit("null")).alias("value")) for key, value in (("filnavn", name), ("udfyldt_af", author))))
    pair = lambda m: F.struct(m["key"].alias("key"), json_value(m["raw"], m["jtype"]).alias("value"))
    written = lambda pairs: F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))
    is_meta = lambda m: (m["key"] == "metadata") & m["jtype"].startswith("OBJECT")

    def section(old: Column) -> Column:
        """The JSON of the metadata, from the pairs that are there."""
        new = lambda p: F.array_max(F.transform(F.filter("_fresh", lambda f: f["key"] == p["key"]), lambda f: f["value"]))
        kept = F.transform(old, lambda p: F.struct(p["key"].alias("key"), F.coalesce(new(p), p["value"]).alias("value")))
        return written(F.concat(kept, F.filter("_fresh", lambda f: ~F.exists(old, lambda p: p["key"] == f["key"]))))

    def body(sections: Column) -> Column:
        one = lambda m: F.struct(m["key"].alias("key"), F.when(is_meta(m), let(F.transform(members(m["raw"]), pair), section)).otherwise(json_value(m["raw"], m["jtype"])).alias("value"))
        return F.when(F.exists(sections, is_meta), written(F.transform(sections, one)))

    # each section is read once: what a lambda uses is a lambda's own value or a column
    at = records.withColumns({"_fresh": fresh, "_sections": members(F.when(_variant(F.col(raw)).isNotNull(), F.col(raw)))})
    return at.withColumn(raw, body(F.col("_sections"))).select(*records.columns)
