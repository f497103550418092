"""Scalar cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from accordance.functions import extraction as X
from accordance.functions import fields
from accordance.functions import text as T
from accordance.functions import values as V


def _each(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("v"))).collect()]


def test_normalised_values(spark):
    cases = {
        "  - ": None, "": None, "N/A": None, "null": None, "None": None, "NULL": "null", "—": "—", "35,5": 35.5, "85.3%": 85.3, "461 min.": 461.0,
        "82 slag per minut": 82.0, "28 kg/m²": 28.0, "5 min %": "5 min", "%": "", "Benjamin": "benja", "5.0": 5.0, "inf": "inf", "1e400": "1e400",
        "2020-1-5": "05-01-2020", "5/1/2020": "05-01-2020", "15.01.2020": "15-01-2020", "1.2.20": "1.2.20", "25/9 2007": "25/9 2007", "07:41:30": "07:41:30",
        "Nej": "nej", "117 (24,1)": "117 (24,1)", "nan": "nan", "1e3": 1000.0, "1_000": 1000.0, "1.234,5": "1.234,5", "1d": "1d",
    }
    found = _each(spark, V.normalized, list(cases))
    got = [None if v.kind == "null" else v.num if v.kind == "num" else v.txt for v in found]
    assert dict(zip(cases, got)) == cases
    assert [v.txt for v in _each(spark, V.normalized, ["5.0", "2.50"])] == ["5", "2.5"]


def test_json_types_keep_their_values(spark):
    rows = spark.createDataFrame([("true", "BOOLEAN"), ("5", "BIGINT"), ("5", "DECIMAL(1,0)"), (None, "VOID")], "raw string, jtype string")
    found = [r[0] for r in rows.select(V.normalized(F.col("raw"), F.col("jtype"))).collect()]
    assert [(v.kind, v.num, v.txt) for v in found] == [("bool", None, "true"), ("num", 5.0, "5"), ("num", 5.0, "5.0"), ("null", None, None)]


def test_tolerance(spark):
    cases = [(100, 95, True), (100, 94, False), (0, 0.05, True), (0, 1, False), (0, 0, True), (-10, 10, False), (42.5, 43, True), (None, 1, None)]
    rows = spark.createDataFrame([(k, None if a is None else float(a), float(b)) for k, (a, b, _) in enumerate(cases)], "k int, a double, b double")
    assert [r[0] for r in rows.orderBy("k").select(V.tolerance_match(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_minutes_flags_numbers(spark):
    assert _each(spark, V.hms_to_minutes, ["07:41:30", "07:41", "12.5", "12,5", None]) == [461.5, 461.0, 12.5, None, None]
    assert _each(spark, V.to_boolean, ["ja", "J", " Yes ", "1", "nej", "n", "0", "måske", None]) == [True] * 4 + [False] * 3 + [None] * 2
    assert _each(spark, V.as_number, ["35,5%", "07:41:30", "-", "", "ca. -3", None]) == [35.5, 7.0, None, None, -3.0, None]
    assert _each(spark, V.lenient_number, ["07:41:30", "abc", "1-2", "12 cm"]) == [74130.0, None, None, 12.0]


def test_flag_text(spark):
    rows = spark.createDataFrame([("true", "bool"), ("0", "num"), ("1.5", "num"), ("Nej, ingen", "str")], "v string, k string")
    assert [r[0] for r in rows.select(V.to_flag_text(F.col("v"), F.col("k"))).collect()] == ["ja", "nej", "1.5", "Nej, ingen"]


@pytest.mark.parametrize("a,b,expected", [("normal søvn uden apnø", "normal søvn med let apnø", (0.6, 0.75, 2 / 3)), ("", None, (1, 1, 1)), ("a", "", (0, 0, 0)), ("a A b", "b a", (1, 1, 1)), (" ", "a", (0, 0, 0))])
def test_token_f1(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(V.token_f1(F.col("a"), F.col("b")).alias("f")).first().f
    assert tuple(row) == pytest.approx(expected)


def test_response_json(spark):
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', 'x {"a": 1} y', "none", '{"a": 1} {"b": 2}', "}{", None]
    assert _each(spark, V.response_json, cases) == ['{"a": 1}'] * 3 + [None, '{"a": 1} {"b": 2}', None, None]


def test_text(spark):
    assert _each(spark, T.normalize_clean, ["a \tb\n\n\n\nc ", None]) == ["a b\n\nc", None]
    assert _each(spark, lambda c: T.normalize_report(c, False), ["a\nb\nb"]) == ["abb"]
    assert _each(spark, T.normalize_report, ["a  \x07b\nc"]) == ["a b\nc"]
    assert _each(spark, T.plain_characters, ["5 µ ± ≥ 3°"]) == ["5 u +/- >= 3 grader"]
    assert _each(spark, T.should_deduplicate, ["Navn: A", "TST: 400 min", "12,5", "abc", "Andel: 3 %", "12:30"]) == [True, False, False, False, False, False]
    assert _each(spark, T.first_number, ["trial12x3", "none", "9" * 30]) == [12, None, None]
    assert _each(spark, T.symbol, [0.2, 0.6, 0.9, None], "double") == ["🔴", "🟡", "🟢", "⚪"]
    assert _each(spark, T.progress_bar, [0.5, None], "double") == ["█" * 15 + "░" * 15, "░" * 30]


def test_extraction_rules(spark):
    assert _each(spark, X.first_date, ["25/9 - 26/9 2007", "3/4 2010", "x"]) == ["25/9 2007", "3/4 2010", "x"]
    assert _each(spark, X.clock_time, ["25/9 22:41:30", "none"]) == ["22:41:30", None]
    assert [tuple(v) for v in _each(spark, X.total_and_index, ["117 (24,1)", "12"])] == [(117.0, 24.1), (12.0, None)]
    assert _each(spark, X.mean_of_spread, ["82 +/- 5"]) == [82.0]
    assert _each(spark, X.minutes, ["461 min", "07:41:30"]) == ["461", "07:41:30"]
    assert _each(spark, X.check_box, ["Ja: X Nej:", "Nej: X", "måske", "Ja: X Nej: X"]) == [True, False, None, None]
    assert _each(spark, X.modern_stage, ["S1", "rem", "S4"]) == ["n1", "rem", None]
    assert _each(spark, X.personal_number, ["010203-1234", "0102031234"]) == ["010203-1234", None]
    assert [tuple(v) for v in _each(spark, X.diagnosis, ["DG473/Apnø", "DG473"])] == [("DG473", "Apnø"), ("DG473", None)]


def test_fields(spark):
    paths = fields.template_paths()
    assert len(paths) == len(set(paths)) == 106
    assert fields.template()["soevnstadier"]["n1"] == {"latens_min": None, "varighed_min": None, "procent_af_tst": None}
    assert _each(spark, fields.topic, ["patient.BMI", "hjerte", "x.y", "metadata.filnavn"]) == ["Patient & metadata", "Andet", "Andet", "Patient & metadata"]
    assert fields.classification(spark).where("fixed_type is null").count() == 68
