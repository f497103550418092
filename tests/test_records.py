"""Ordered records: leaves at any depth, writing back, repair and stamping, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from accordance.operators import records

NAMES = ["a", "b", "a.b", "", "é", 'q"', "n\n", "A", "10", "2", "metadata", "filnavn"]


def value(rng, depth):
    kind = rng.randrange(9 if depth else 7)
    if kind >= 7:
        return {rng.choice(NAMES): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [None, True, rng.randrange(-5, 10**12), rng.choice(["", "123", "true", "null", "[note] x", "1e3", "x\\y", "{", "tab\t"]), 1.5, [1, {"y": "2", "c": []}], {}][kind]


def record(rng, depth=4):
    return {rng.choice(NAMES): value(rng, depth) for _ in range(rng.randrange(6))}


def compact(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def flat(d, prefix=""):
    out = {}
    for k, v in d.items():
        key = f"{prefix}.{k}" if prefix else k
        out |= flat(v, key) if isinstance(v, dict) else {key: v}
    return out


def test_random_records_come_back_as_they_were(spark):
    rng = random.Random(1)
    texts = ["{}", '{"x":{}}', '{"a.b":{"c.d":1},"a":{"b":{"c.d":2}}}'] + [compact(record(rng)) for _ in range(1500)]
    rows = spark.createDataFrame([(k, json.dumps(json.loads(t), indent=rng.choice([None, 2]))) for k, t in enumerate(texts)], "id int, raw string")
    made = {r.id: r.raw for r in records.nested(records.leaves(rows, ["id"]), ["id"]).collect()}
    assert made == dict(enumerate(texts))


def test_leaves_of_any_depth(spark):
    deep = {k: json.loads('{"k":' * k + '{"s":1,"e":{}}' + "}" * k) for k in range(1, 13)}
    rows = spark.createDataFrame([(k, compact(d)) for k, d in deep.items()] + [(90, None), (91, "[1]"), (92, "{"), (93, "{}")], "id int, raw string")
    got = {}
    for r in records.leaves(rows, ["id"]).collect():
        got.setdefault(r.id, []).append((r.path, r.raw, r.jtype, [s.ordinal for s in r.segments]))
    assert got.pop(93) == [("", "{}", "OBJECT<>", [])]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted([("k." * k + "s", "1", "BIGINT", [0] * k + [0]), ("k." * k + "e", "{}", "OBJECT<>", [0] * k + [1])]) for k in deep}
    assert {r.id: r.raw for r in records.nested(records.leaves(rows, ["id"]), ["id"]).collect()} == {k: compact(d) for k, d in deep.items()} | {93: "{}"}


def test_flatten_equals_recursion(spark):
    rng = random.Random(2)

    def tree(depth):
        return {f"k{k}": tree(depth - 1) if depth and rng.random() < 0.7 else rng.choice([1, "t", None, True, [1, {"z": 1}]]) for k in range(rng.randrange(1, 4))}

    found = {k: tree(k % 12 + 1) for k in range(60)}
    good, bad = records.parse(spark.createDataFrame([(k, compact(v)) for k, v in found.items()], "id int, raw string"))
    got = {(r.id, r.path): (r.raw, r.jtype) for r in records.flatten(good, ["id"]).collect()}
    text = lambda v: None if v is None else "true" if v is True else compact(v) if isinstance(v, list) else str(v)
    assert {k: v[0] for k, v in got.items()} == {(k, p): text(v) for k, d in found.items() for p, v in flat(d).items()} and bad.count() == 0
    assert max(p.count(".") for _, p in got) >= 9


def test_repair_loses_no_record(spark):
    texts = ["{}", '{"x":{}}', '{"b":1,"a":"5","oget_muskelaktivitet_rem":{"tib":"nej","chin":"Ja","e":{}},"oget_muskelaktivitet_rem.chin":"Ja","l":[1,{"y":2}]}', '{"soevnstadier":{"n1":{"latens_min":"1:30","x":"1:30"}}}']
    rows = spark.createDataFrame([*enumerate(texts), (10, "{"), (11, None), (12, "[]")], "id int, raw string")
    made, log, bad = records.repaired_records(rows, ["id"])
    want = [*texts[:2], texts[2].replace('"tib":"nej","chin":"Ja"', '"tib":false,"chin":true'), texts[3].replace('"latens_min":"1:30"', '"latens_min":90.0')]
    assert {r.id: r.raw for r in made.collect()} == dict(enumerate(want))
    assert sorted(r.path for r in log.collect()) == ["oget_muskelaktivitet_rem.chin", "oget_muskelaktivitet_rem.tib", "soevnstadier.n1.latens_min"]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(10, "no JSON"), (11, "no text"), (12, "no object")]
    none = records.repaired_records(rows.where("false"), ["id"])
    assert [t.count() for t in none] == [0, 0, 0]


def test_stamp_keeps_types_and_order(spark):
    raw = '{"z":1,"metadata":{"n":5,"filnavn":null,"t":"123"},"a":"123","b":"[note] x","c":"true","d":{"y":[1],"x":{}},"e":null,"f":false}'
    texts = [raw, '{"metadata":{}}', '{"metadata":{"udfyldt_af":"old","x":{"metadata":1}}}', '{"metadata":null}', '{"metadata":"x"}', "{}", None, "[", '{"a":{"metadata":{}}}']
    rows = spark.createDataFrame([(k, t, 'f"1' if k % 2 == 0 else None) for k, t in enumerate(texts)], "id int, raw string, f string")
    got = {r.id: r.raw for r in records.stamped(rows, F.col("f"), F.lit("m")).collect()}
    for k, t in enumerate(texts):
        try:
            want = json.loads(t or "")
            want["metadata"]["filnavn"] = 'f"1' if k % 2 == 0 else None
            want["metadata"]["udfyldt_af"] = "m"
        except (ValueError, TypeError, KeyError):
            want = None
        assert got[k] == (want and compact(want)), t


def test_nested_by_path(spark):
    rows = [(1, "b.c", "1", "BIGINT"), (1, "b.a", "x", "STRING"), (1, "a", None, "VOID"), (2, "x.y.z.w.v.u", "true", "BOOLEAN")]
    made = records.nested(spark.createDataFrame(rows, "id int, path string, raw string, jtype string"), ["id"])
    assert {r.id: r.raw for r in made.collect()} == {1: '{"a":null,"b":{"a":"x","c":1}}', 2: '{"x":{"y":{"z":{"w":{"v":{"u":true}}}}}}'}


def test_what_follows_a_value_is_no_json(spark):
    """As json.loads has it, but that a repeated key and NaN are none either."""
    texts = ['{"a":1}', ' {"a":1} \n', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1},null', '{"a":1}],[{"b":2}', '{"a":1}},{"b":{}', '{"a":[[1],[2]]}', '{"a":"],["}', "", " ", "null", "1", "1,2", "[1]", "[1],[2]", "]", "}", '{"a":1', '{"a":"\\u00e6"}', '"x"', "{,}", '{"a":1,}']
    good, bad = records.parse(spark.createDataFrame(list(enumerate(texts)), "id int, raw string"))

    def of(text):
        try:
            return None if isinstance(json.loads(text), dict) else "no object"
        except ValueError:
            return "no JSON"

    got = {r.id: None for r in good.collect()} | {r.id: r.reason for r in bad.collect()}
    assert got == {k: of(t) for k, t in enumerate(texts)}
    assert {r.id for r in records.leaves(spark.createDataFrame(list(enumerate(texts)), "id int, raw string"), ["id"]).select("id").distinct().collect()} == {k for k, t in enumerate(texts) if of(t) is None}


def test_stamping_reads_each_section_once(spark):
    """The record's members and those of its metadata, each as texts and as variants: four readings, however often they are used."""
    rows = spark.createDataFrame([(1, '{"metadata":{}}')], "id int, raw string")
    plan = records.stamped(rows, F.lit("f"), F.lit("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 4
