"""Operators over small tables with known results."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from accordance.operators import agreement, checks, cleaning, compare, dealing, generate, match, records, stats, views
from accordance.sources import docx, files
from accordance.streaming import incremental


def test_cleaning(spark):
    h = "H" * 31
    lines = ["Navn: Test Person", h, "A | B |  | C", "12,5", "12,5", "Navn: Test Person", "TST: 400 min", "TST: 400 min", h, h, h, h, "", "ok", "ok"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (None, "x\n")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in cleaning.clean_texts(docs).collect()}
    assert found == {1: "Navn: Test Person\nA\nB\nC\n12,5\n12,5\nTST: 400 min\nTST: 400 min\nok\nok", 2: "", 3: "", None: "x"}
    first = cleaning.dedup_text(spark.createDataFrame([("a\n b\n\na\nb ",)], "text string")).first().text
    assert first == "a\nb"


def test_flatten_and_dead_letters(spark):
    rows = [("a", '{"s": {"x": 1, "y": {"z": "t", "e": {}}}, "l": [1, "b"], "n": null, "f": 5.0, "d": true}'), ("b", "{broken"), ("c", None), ("d", "[1]"), ("e", '{"a":{"b":{"c":{"d":1}}}}'), ("f", "{}")]
    good, bad = records.parse(spark.createDataFrame(rows, "file_name string, raw string"))
    found = {(r.file_name, r.path): (r.raw, r.jtype) for r in records.flatten(good, ["file_name"]).collect()}
    assert found[("a", "s.x")] == ("1", "BIGINT") and found[("a", "s.y.z")] == ("t", "STRING")
    assert found[("a", "l")] == ('[1,"b"]', "ARRAY") and found[("a", "n")] == (None, "VOID") and found[("a", "d")] == ("true", "BOOLEAN")
    assert found[("a", "f")][1].startswith("DECIMAL") and not any(k[0] == "f" or k[1] == "s.y.e" for k in found)
    assert found[("e", "a.b.c.d")] == ("1", "BIGINT")
    assert {(r.file_name, r.reason) for r in bad.collect()} == {("b", "no JSON"), ("c", "no text"), ("d", "no object")}


def test_repair(spark):
    rows = [
        ("oget_muskelaktivitet_rem.chin", "Ja", "STRING", "true", True), ("oget_muskelaktivitet_rem.tib", "1", "BIGINT", "1", False), ("oget_muskelaktivitet_rem.fds", "måske", "STRING", None, True),
        ("soevnstadier.n1.latens_min", "07:41:30", "STRING", "461.5", True), ("soevn_opsummering.soveperiode_min", "12,5", "STRING", "12,5", False), ("soevnstadier.n1.latens_min", "5", "BIGINT", "5", False),
        ("sammenfatning.anfald", "true", "BOOLEAN", "ja", True), ("sammenfatning.fokal", "Nej, ingen", "STRING", "Nej, ingen", False), ("patient.BMI", "28", "STRING", "28", False),
    ]
    leaves = spark.createDataFrame([(str(k), *r[:3]) for k, r in enumerate(rows)], "file_name string, path string, raw string, jtype string")
    found = sorted(records.repair(leaves).collect(), key=lambda r: int(r.file_name))
    assert [(r.new_raw, r.changed) for r in found] == [r[3:] for r in rows]
    assert records.change_log(records.repair(leaves), ["file_name"]).count() == 4


def test_stamp(spark):
    rows = spark.createDataFrame([('{"metadata": {"filnavn": null}, "a": {"b": [1]}, "c": "d\\"e"}',), ('{"a": 1}',)], "raw string")
    made = [r[0] for r in records.stamped(rows, F.lit("f"), F.lit("m")).collect()]
    assert made[1] is None
    import json

    assert json.loads(made[0]) == {"metadata": {"filnavn": "f", "udfyldt_af": "m"}, "a": {"b": [1]}, "c": 'd"e'}


def test_match(spark):
    side = lambda *names: spark.createDataFrame([(n,) for n in names], "file_name string")
    found = match.match_files(side("a.json", "trial1.json", "x7.json", "y7.json", "nodigits.json", None), side("a.json", "patient1.json", "z07.json", "other.json"))
    assert {tuple(r) for r in found.select("left_file", "right_file", "match_kind").collect()} == {
        ("a.json", "a.json", "exact"), ("trial1.json", "patient1.json", "number"), ("y7.json", "z07.json", "number"),
        ("x7.json", None, "unpaired"), ("nodigits.json", None, "unpaired"), (None, "other.json", "unpaired"),
    }


def test_trials(spark):
    held = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (2, "b"), (3, "b"), (1, "c"), (3, "c")], "trial int, folder string")
    assert [r.trial for r in match.complete_trials(held, 3).select("trial").distinct().collect()] == [3]
    assert {tuple(r) for r in match.missing_trials(held, ["a", "b", "c"]).collect()} == {(1, "b"), (2, "c")}


def _ann(spark, rows):
    return spark.createDataFrame(rows, "pair_id int, path string, kind string, num double, txt string")


def test_compare_and_scores(spark):
    left = [(1, "hjerte.x", "num", 10.0, "10"), (1, "patient.BMI", "num", 10.0, "10"), (1, "patient.navn", "str", None, "a"), (1, "konklusion_og_plan.plan", "str", None, "a b c"), (1, "p.q", "null", None, None), (1, "metadata.filnavn", "str", None, "f"), (1, "p.t", "num", 5.0, "5")]
    right = [(1, "hjerte.x", "num", 10.4, "10.4"), (1, "patient.BMI", "num", 10.0, "10"), (1, "patient.navn", "str", None, "A "), (1, "konklusion_og_plan.plan", "str", None, "a b c d"), (1, "p.r", "str", None, "z"), (1, "p.t", "str", None, "ca. 5")]
    found = {r.path: r for r in compare.compare_fields(_ann(spark, left), _ann(spark, right)).collect()}
    assert "metadata.filnavn" not in found
    assert (found["hjerte.x"].agrees, found["hjerte.x"].tolerance, found["hjerte.x"].deviation) == (False, True, 0.4)
    assert found["patient.BMI"].agrees and found["patient.navn"].agrees and found["konklusion_og_plan.plan"].agrees
    assert (found["p.q"].status, found["p.q"].agrees, found["p.r"].status, found["p.r"].agrees) == ("both_missing", None, "left_missing", False)
    assert (found["p.t"].agrees, found["p.t"].tolerance) == (False, None)
    as_model = lambda rows: _ann(spark, rows).withColumn("model", F.lit("m"))
    score = {r.path: r.score for r in compare.score_fields(as_model(left), as_model(right)).collect()}
    assert score == {"hjerte.x": 0.7, "patient.BMI": 1.0, "patient.navn": 1.0, "konklusion_og_plan.plan": 0.857, "p.q": None, "p.r": 0.0, "p.t": 0.0}
    fields = stats.field_stats(compare.compare_fields(_ann(spark, left), _ann(spark, right)))
    total = stats.grand_totals(fields).first()
    assert total.n_agree + total.n_disagree == total.n_compared == 6
    assert stats.worst_topics(stats.topic_stats(fields)).count() == 4 and views.report_json(fields).count() == 7


def test_fields_are_dealt_by_rows(spark):
    assert [dealing.tasks(n) for n in (0, 1, 500_000, 500_001, 10**8, 8 * 10**8, 8 * 10**8 + 1)] == [1, 1, 1, 2, 200, 200, 201]
    rows = spark.range(300).select(F.col("id").alias("pair_id"), F.expr("'patient.' || id % 3").alias("path"), F.lit("num").alias("kind"), F.col("id").cast("double").alias("num"), F.col("id").cast("string").alias("txt"))
    left, right = rows.where("pair_id % 3 <> 0"), rows.where("pair_id % 5 <> 0")
    dealt = compare.compare_fields(left, right, rows=9_000_000)
    assert dealt.rdd.getNumPartitions() == 18  # tasks of half a million rows, however few bytes they have
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, compare.compare_fields(left, right).collect()))
    scored = [x.withColumn("model", F.expr("'m' || pair_id % 2")) for x in (left, right)]
    assert compare.score_fields(*scored, rows=9_000_000).rdd.getNumPartitions() == 18


def test_empty_tables(spark):
    none = _ann(spark, [])
    fields = stats.field_stats(compare.compare_fields(none, none))
    assert fields.count() == 0 and stats.grand_totals(fields).first().n_compared == 0
    assert agreement.alpha_nominal(none, "path", "txt").first().alpha is None
    assert agreement.alpha_interval(none, "path", "num").count() == 0


def _matrix(spark, *raters):
    rows = [(u, r, float(v) if isinstance(v, int) else v) for r, values in enumerate(raters) for u, v in enumerate(values)]
    return spark.createDataFrame(rows, f"u int, r int, v {'string' if any(isinstance(v, str) for x in raters for v in x) else 'double'}")


def test_alpha(spark):
    n = _matrix(spark, ["a", "a", "b", "b", None, "c"], ["a", "b", "b", "b", "c", None], ["a", "a", "b", "a", "c", "c"])
    row = agreement.alpha_nominal(n, "u", "v").first()
    assert row.n_values == 16 and row.alpha == pytest.approx(0.642857, abs=1e-6)
    two = _matrix(spark, [1.0, 2, 3, 3, 2, 1, 4, 1, 2, None], [1.0, 2, 3, 3, 2, 2, 4, 1, 2, 5])
    three = _matrix(spark, [1.0, 2, 3, None], [1.0, 2, 4, 5], [None, 2.0, 3, 5])
    assert agreement.alpha_interval(two, "u", "v").first().alpha == pytest.approx(0.942760, abs=1e-6)
    assert agreement.alpha_interval(three, "u", "v").first().alpha == pytest.approx(0.954081, abs=1e-6)
    far = three.withColumn("v", F.col("v") * 3 + 1e7)
    assert agreement.alpha_interval(far, "u", "v").first().alpha == pytest.approx(0.954081, abs=1e-6)
    assert agreement.alpha_nominal(_matrix(spark, ["a", "a"], ["a", "a"]), "u", "v").first().alpha is None
    assert tuple(agreement.unit_counts(n, "u", "v", 3).first()) == (4, 0, 2, False)


def test_rater_report(spark):
    rows = [("t", r, p, k, n, x) for r, vals in (("A", (("s.n", "num", 10.0, "10"), ("patient.navn", "str", None, "a"))), ("B", (("s.n", "num", 10.4, "10.4"), ("patient.navn", "str", None, "A"))), ("C", (("s.n", "num", 10.0, "10"),))) for p, k, n, x in vals]
    ann = spark.createDataFrame(rows, "trial string, rater string, path string, kind string, num double, txt string")
    typed = agreement.typed(ann, ("trial",))
    grid = agreement.densified(typed, ann, "rater", ("trial",))
    assert grid.count() == 6
    fields = {r.path: r for r in agreement.pairwise_fields(grid, "rater", ("trial",)).collect()}
    assert (fields["s.n"].n_pairs, fields["s.n"].n_exact, fields["s.n"].n_tolerance) == (3, 1, 3)
    assert (fields["patient.navn"].n_pairs, fields["patient.navn"].n_exact, fields["patient.navn"].exact_match) == (3, 1, False)
    assert agreement.alpha_report(grid, 3, ("trial",)).count() == 2
    assert {r.scope for r in agreement.file_pairs(grid, "rater", ("trial",)).select("scope").distinct().collect()} == {"A vs B", "A vs C", "B vs C"}
    assert agreement.pairwise_summary(agreement.pairwise_fields(grid, "rater", ("trial",)), ("trial",)).count() == 2


def test_models(spark):
    fields = spark.createDataFrame([(m, "p", "t", s) for m, s in (("A", 0.4), ("B", 0.4), ("C", 0.1))] + [("A", "q", "t", 0.9)], "model string, path string, topic string, mean_score double")
    row = stats.cross_model(fields).first()
    assert (row.path, row.mean_score, row.spread, row.best_model, row.worst_model, row.n_models) == ("p", 0.3, 0.3, "A", "C", 3)
    assert stats.hard_fields(stats.cross_model(fields), 3).count() == 1 and stats.spread_fields(stats.cross_model(fields)).count() == 1
    totals = spark.createDataFrame([("A", 0.5), ("B", None), ("C", 0.5)], "model string, score double")
    assert [(r.model, r["rank"]) for r in stats.ranked(totals, ["C", "A", "B"]).orderBy("rank").collect()] == [("C", 1), ("A", 2), ("B", 3)]


def test_overviews(spark):
    rows = [(k, p, t, "free_text" if p == "b" else "nominal", "filled", a, f, None, None) for k, (p, t, a, f) in enumerate([("a", "T", True, None), ("a", "T", False, None), ("b", "U", False, 0.25), ("c", "U", True, None)])]
    compared = spark.createDataFrame(rows, "pair_id int, path string, topic string, field_type string, status string, agrees boolean, f1 double, tolerance boolean, deviation double")
    tables = views.overview(stats.field_stats(compared))
    assert [r.path for r in tables["disagreements"].collect()] == ["b", "a"] and [r.path for r in tables["texts"].collect()] == ["b"]
    assert [(r.topic, r.color) for r in tables["topics"].collect()] == [("T", "yellow"), ("U", "yellow")] and tuple(tables["status"].first()) == (2, 2, 0)
    scores = spark.createDataFrame([(m, "p", "T", s, False, False) for m, s in (("A", 0.4), ("B", 0.1))] + [("A", "q", "U", 1.0, False, False)], "model string, path string, topic string, score double, model_missing boolean, truth_missing boolean")
    tables = views.model_overview(scores, ["B", "A"])
    assert [(r["rank"], r.model, r.score) for r in tables["ranking"].orderBy("rank").collect()] == [(1, "A", 0.7), (2, "B", 0.1)]
    assert sorted(map(tuple, tables["topics"].collect())) == [("T", 0.1, 0.4), ("U", None, 1.0)]
    assert [r.path for r in tables["hard"].collect()] == [r.path for r in tables["spread"].collect()] == ["p"]


def test_heatmap_matrix(spark):
    rows = [(1, "a", "filled", True, None), (2, "a", "filled", False, 0.5), (1, "b", "both_missing", None, None), (2, "b", "left_missing", False, None), (3, "c", "filled", True, None), (1, None, "filled", True, None)]
    compared = spark.createDataFrame(rows, "pair_id int, path string, status string, agrees boolean, f1 double")
    want = {("a", 1.0, 0.75), ("b", 0.0, 0.65), ("c", 0.0, 0.0), (None, 1.0, 0.0)}
    for n in (None, 9_000_000):
        table = views.heatmap_matrix(compared, [1, 2], rows=n)
        assert table.columns == ["path", "1", "2"] and set(map(tuple, table.collect())) == want
    assert table.rdd.getNumPartitions() == 18
    few = views.heatmap_matrix(compared, [1, 2], compared.where("path <> 'c'"))
    assert {r.path for r in few.collect()} == {"a", "b"}


def test_range_warnings(spark):
    rows = [("patient.BMI", "10"), ("patient.BMI", "80"), ("patient.BMI", "10.1"), ("patient.ESS", "24"), ("patient.ESS", "25"), ("soevn_opsummering.soevneffektivitet_procent", "100"), ("soevn_opsummering.total_soevntid_tst_min", "700"), ("respirations_analyse.ahi_total", "150"), ("spo2_oversigt.minimum_procent.total", "50"), ("spo2_oversigt.minimum_procent.total", "49,5%"), ("patient.BMI", None)]
    found = checks.range_warnings(spark.createDataFrame(rows, "path string, raw string"), [])
    assert sorted(r.value for r in found.collect()) == ["10", "25", "49,5%", "80"]


def test_generate(spark):
    def make():
        def model(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [('x {"a": 1}' if "json" in p else "none", 3) for p in prompts]

        return model

    rows = spark.createDataFrame([(1, "json"), (2, "bad"), (3, "plain"), (4, None)], "doc_id long, text string")
    prompts = rows.withColumn("prompt", generate.prompt(F.col("text"), "system", "T: {text}"))
    good, dead = generate.records(generate.generate(prompts, make))
    assert [tuple(r) for r in good.collect()] == [(1, '{"a": 1}')]
    assert {(r.doc_id, r.reason) for r in dead.collect()} == {(2, "ValueError: no"), (3, "no braces"), (4, "no braces")}


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, merge="": f"<w:tc><w:tcPr>{merge}</w:tcPr>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('')}{cell('A')}{cell('')}{cell('B')}</w:tr><w:tr>{cell('x', '<w:vMerge/>')}{cell('C')}</w:tr><w:tr>{cell('')}</w:tr></w:tbl>"
    wps, wpc = ("http://schemas.microsoft.com/office/word/2010/wordprocessing" + kind for kind in ("Shape", "Canvas"))
    box = f'<w:p><w:r><w:t>own</w:t><x:txbx xmlns:x="{wps}"><w:txbxContent>{p("boxed")}</w:txbxContent></x:txbx><x:txbx xmlns:x="{wpc}">{p("canvas")}</x:txbx></w:r></w:p>'
    inner = f"<w:tbl><w:tr>{cell('in1')}{cell('in2')}</w:tr></w:tbl>"
    outer = f"<w:tbl><w:tr><w:tc>{p('o')}{inner}</w:tc>{cell('x')}{cell('y', '<w:hMerge w:val=&quot;continue&quot;/>'.replace('&quot;', chr(34)))}</w:tr></w:tbl>"
    link = "<w:p><w:hyperlink><w:r><w:t>li</w:t></w:r></w:hyperlink><w:r><w:noBreakHyphen/><w:t>nk</w:t></w:r></w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("first")}{table}{p("first")}{box}{outer}{link}</w:body></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}">{p("head")}</w:hdr>')
    (tmp_path / "r.docx").write_bytes(data.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    found = {r.file_name: r for r in docx.read_docx(files.documents(spark, str(tmp_path))).collect()}
    assert found["r.docx"].text == "=== PSG RAPPORT ===\nFilnavn: r.docx\n\nfirst\nA | — | B\nC\nown\no | x\nli-nk\n[TEKSTBOKSE]\nboxed\ncanvas\n\n=== SLUT ==="
    assert found["broken.docx"].text is None and found["broken.docx"].error.startswith("BadZipFile")
    fast = {r.file_name: r.text for r in docx.read_docx(files.documents(spark, str(tmp_path)), fast=True).collect()}
    assert fast["r.docx"] == "=== PSG RAPPORT ===\nFilnavn: r.docx\n\nheadfirstABxCfirstownboxedcanvasoin1in2xylink\n\n=== SLUT ==="


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.docx", "old", 1), ("a.doc", "new", 2), ("b.c.txt", None, 1), (None, "x", 1)], "file_name string, text string, at int")
    assert files.write_texts(rows, str(tmp_path / "t"), order="at") == 2
    assert {f.name: f.read_text() for f in (tmp_path / "t").iterdir()} == {"a.txt": "new", "b.c.txt": ""}
    assert files.write_json(rows.where("file_name = 'a.doc'"), str(tmp_path / "j"), raw="text") == 1 and (tmp_path / "j" / "a.json").read_text() == "new"
    table = spark.createDataFrame([(1, None)], "k int, v string")
    files.write_report({"fields": table}, str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r"), "fields").collect() == table.collect()
    for _ in range(2):
        files.log_errors(table, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    names = spark.createDataFrame([("hdfs://host:8020/a/b%20c.txt",), ("file:/x.txt",)], "file_path string")
    for path, n in (("/a/b c.txt", 1), ("hdfs://host:8020/a/b c.txt", 1), ("hdfs://other/a/b c.txt", 0), ("file:///x.txt", 1), ("/x.txt", 1)):
        assert files.listed(names, spark.createDataFrame([(path,), (path,)], "path string")).count() == n, path
    for k in (1, 2):
        folder = tmp_path / f"f{k}"
        folder.mkdir()
        (folder / "output-trial7.json").write_text("{}")
        (folder / "other.json").write_text("{}")
    assert sorted((r.source, r.trial) for r in files.trial_records(spark, [str(tmp_path / "f1"), str(tmp_path / "f2")]).collect()) == [("0", 7), ("1", 7)]


def test_nested_records(spark):
    raw = '{"patient": {"navn": "A \\"b\\"", "BMI": 5, "x": [1, {"y": 2}]}, "oget_muskelaktivitet_rem": {"chin": "Ja"}, "n": null, "deep": {"a": {"b": {"c": 1}}}}'
    rows = spark.createDataFrame([(1, raw), (2, "{"), (3, '{"patient": {\n"navn": }}')], "id int, raw string")
    made, log, bad = records.repaired_records(rows, ["id"])
    want = json.loads(raw)
    want["oget_muskelaktivitet_rem"]["chin"] = True
    assert [(r.id, json.loads(r.raw)) for r in made.collect()] == [(1, want)]
    assert [tuple(r) for r in log.collect()] == [(1, "oget_muskelaktivitet_rem.chin", "Ja", "true")]
    dead = {r.id: r for r in records.with_context(rows).collect()}
    assert dead[1].error is None and dead[3].line == 2 and "    2: \"navn\": }}" in dead[3].context and dead[2].line == 1
    with pytest.raises(Exception):
        records.parse(rows, fail_fast=True)[0].collect()


def test_reports_of_raters(spark):
    values = {"A": ("10", True, "ja", "a b"), "B": ("ca 10,5", True, "Ja ", "a c"), "C": (None, False, "nej", "a b")}
    rows = []
    for trial in (1, 2):
        for rater, (n, flag, word, text) in values.items():
            if trial == 2 and rater == "C":
                continue
            rows += [(trial, rater, "s.n", "null" if n is None else "num" if n == "10" else "str", 10.0 if n == "10" else None, n), (trial, rater, "s.flag", "bool", None, str(flag).lower()), (trial, rater, "hjerte.x", "str", None, word), (trial, rater, "konklusion_og_plan.plan", "str", None, text)]
    ann = spark.createDataFrame(rows, "trial int, folder string, path string, kind string, num double, txt string")
    tables = agreement.trial_report(ann, 3)
    fields = {(r.scope, r.path): r for r in tables["fields"].collect()}
    assert {s for s, _ in fields} == {"all", "A vs B", "A vs C", "B vs C"} and {r.trial for r in tables["fields"].collect()} == {1}
    assert (fields["A vs B", "s.n"].n_exact, fields["A vs B", "s.n"].n_tolerance, fields["A vs C", "s.n"].tolerance_match) == (0, 1, False)
    assert fields["all", "s.flag"].field_type == "numeric" and fields["all", "s.flag"].n_exact == 1
    assert fields["all", "hjerte.x"].n_exact == 1 and fields["all", "konklusion_og_plan.plan"].mean_f1 == pytest.approx(0.667)
    assert {(r.scope, r.folder, r.n_filled, r.n_units) for r in tables["coverage"].where("scope = 'all'").collect()} == {("all", "A", 4, 4), ("all", "B", 4, 4), ("all", "C", 3, 4)}
    assert next(r.values for r in tables["values"].where("scope = 'B vs C' and path = 's.n'").select(F.col("values").alias("values")).collect()) == {"B": "ca 10,5", "C": None}
    alphas = {(r.scope, r.level): r for r in tables["alpha"].collect()}
    assert alphas["all", "nominal"].n_complete == 1 and not alphas["all", "interval"].reliable
    means = {(r.scope, r.metric): r["mean"] for r in tables["means"].collect()}
    assert means["all", "free_text_mean_f1"] == pytest.approx(0.667) and ("A vs B", "numeric_exact_percent") in means
    by_trial = views.metric_by_trial(tables["metrics"].where("scope = 'A vs B'"), [1, 2]).where("metric = 'free_text_mean_f1'").first()
    assert (by_trial["1"], by_trial["2"], by_trial["mean"]) == (0.5, None, 0.5)
    texts = spark.createDataFrame([(0.5, True), (0.25, False), (None, True)], "a double, r boolean").select(agreement.alpha_text(F.col("a"), F.col("r"))).collect()
    assert [t[0] for t in texts] == ["0.500", "0.250 ⚠", "N/A"]


def test_means_of_rounded_values(spark):
    rows = spark.createDataFrame([(k, v) for k, vs in enumerate(([0.432, 0.433], [0.4325 - 0.0005, 0.433, 0.432, 0.433], [1.0], [None], [-0.001, -0.002])) for v in vs], "k int, v double")
    assert [r.m for r in rows.groupBy("k").agg(stats.mean_of_rounded("v").alias("m")).orderBy("k").collect()] == [0.433, 0.433, 1.0, None, -0.001]


def test_prompts_within_tokens(spark):
    def make():
        class Words:
            encode = staticmethod(lambda text: text.split())
            decode = staticmethod(" ".join)

        return Words

    rows = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, None)], "doc_id int, prompt string")
    assert [tuple(r) for r in generate.within_tokens(rows, make, 3).orderBy("doc_id").collect()] == [(1, "a b c", 4), (2, "a", 1), (3, None, 0)]
    few = lambda: lambda prompts: [("{}", 1)] * max(1, len(prompts) - 1)
    made = generate.generate(spark.createDataFrame([(k, "x") for k in range(5)], "doc_id int, prompt string").coalesce(1), few)
    assert [(r.doc_id, r.response, r.attempts) for r in made.orderBy("doc_id").collect()] == [(k, "{}", 2) for k in range(5)]


def test_latest_scores(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", "a", 0.5), ("2024-01-01 11:00:00", "a", 1.0)], "at string, model string, score double").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, model string, score double").json(str(tmp_path / "in"))
    query = incremental.latest_scores(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.model, r.n, r.mean_score) for r in spark.table("latest").collect()] == [("a", 2, 0.75)]


def test_files_and_streams(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_text("Navn: x\nNavn: x\n")
    (folder / "a.json").write_text('{"a": {"b": 1}}')
    (folder / "b.json").write_text("{")
    (tmp_path / "list.txt").write_text(f"{folder}/a.txt;x\n\n{folder}/none.txt\n")
    paths = files.path_list(spark, str(tmp_path / "list.txt"))
    assert paths.count() == 2 and files.listed(files.texts(spark, str(folder)), paths).count() == 1
    assert files.json_records(spark, str(folder), "s").count() == 2
    for _ in range(2):
        incremental.clean_new(spark, str(folder), out, str(tmp_path / "c1"))
        incremental.flatten_new(spark, str(folder), f"{out}2", f"{out}3", str(tmp_path / "c2"))
    assert [r.text for r in spark.read.parquet(out).collect()] == ["Navn: x"]
    assert [r.path for r in spark.read.parquet(f"{out}2").collect()] == ["a.b"] and spark.read.parquet(f"{out}3").count() == 1


def test_native_plans(spark):
    rows = spark.createDataFrame([("a", '{"a": 1}')], "file_name string, raw string")
    plan = records.annotations(rows, ["file_name"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_report_lines_and_low_alpha(spark):
    sums = "n_compared long, n_agree long, n_disagree long, n_left_missing long, n_right_missing long, n_both_missing long, f1_sum double, f1_n long"
    rows = [
        ("a.x", "numeric", 1.0, None, 2, 2, 0, 0, 0, 0, 0.0, 0), ("a.y", "nominal", 0.0, None, 2, 0, 2, 0, 0, 0, 0.0, 0),
        ("b", "free_text", 0.5, 0.625, 2, 1, 1, 0, 0, 0, 1.25, 2), ("c", "free_text", None, None, 0, 0, 0, 2, 0, 0, 0.0, 0),
    ]
    fields = spark.createDataFrame(rows, f"path string, field_type string, agreement_rate double, mean_f1 double, {sums}")
    found = [(r.section, r.line) for r in views.report_lines(fields, 2).orderBy("section", "place", "path").collect()]
    assert found == [
        ("detail", "a.y: 2 disagreements"), ("missing", "c"), ("perfect", "a.x"), ("texts", "🟡 b 0.625"),
        ("total", "compared: 6"), ("total", "agree: 3 (50.0 %)"), ("total", "disagree: 3 (50.0 %)"), ("total", "left missing: 2"),
    ]
    nothing = views.report_lines(fields.where("path is null"), 2).orderBy("place").collect()
    assert [r.line for r in nothing] == ["compared: 0", "agree: 0 (0.0 %)", "disagree: 0 (0.0 %)", "left missing: 0"]
    alphas = spark.createDataFrame([(0.7, 0.1), (None, 0.1), (None, None), (0.2, 0.9)], "i double, n double")
    assert [r.low for r in alphas.select(views.low_alpha(F.col("i"), F.col("n")).alias("low")).collect()] == [False, True, False, True]
