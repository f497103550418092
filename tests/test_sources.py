"""Data sources of named files and Word files."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from accordance.sources import docx, files, named, word


def docx_bytes(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)}</w:body></w:document>')
    return data.getvalue()


def held(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "old.txt").write_text("old")
    (out / "f3.txt").write_text("before")
    named.register(spark)
    rows = spark.range(0, 40, 1, 8).select(F.format_string("f%d.txt", "id").alias("name"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("value"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            rows.write.format("named_files").mode(mode).save(str(out))
        assert held(out) == {"old.txt": "old", "f3.txt": "before"}
    good = rows.where("id <> 37")
    good.write.format("named_files").mode("append").save(str(out))
    want = {f"f{k}.txt": str(k) for k in range(40) if k != 37}
    assert held(out) == want | {"old.txt": "old"}
    good.where("id < 3").write.format("named_files").mode("overwrite").save(str(out))
    assert held(out) == {f"f{k}.txt": str(k) for k in range(3)}


def test_names(spark, tmp_path):
    named.register(spark)
    for bad in (None, "", "a/b", "_x", ".x"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad, "v")], "name string, value string").write.format("named_files").mode("append").save(str(tmp_path / "n"))
    with pytest.raises(Exception):
        spark.createDataFrame([("a", "1"), ("a", "2")], "name string, value string").repartition(2).write.format("named_files").mode("append").save(str(tmp_path / "n"))
    assert held(tmp_path / "n") == {}
    spark.createDataFrame([("a.bin", b"\x01"), ("b.bin", None)], "name string, value binary").write.format("named_files").mode("append").save(f"file://{tmp_path}/n")
    assert (tmp_path / "n" / "a.bin").read_bytes() == b"\x01" and (tmp_path / "n" / "b.bin").read_bytes() == b""


def test_word_source(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"r{k}.docx").write_bytes(docx_bytes(f"line {k}", "x" * k, "line", "line"))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "empty.docx").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "deep.docx").write_bytes(docx_bytes("deep"))
    for fast in (False, True):
        found = {tuple(r) for r in word.scan(spark, str(tmp_path), fast, partition_bytes=20_000).collect()}
        mine = {r for r in found if r[0] != "empty.docx"}  # Spark's own scan leaves out files without a byte
        assert mine == {tuple(r) for r in docx.read_docx(files.documents(spark, str(tmp_path)), fast).collect()} and len(found) == 14
    source = lambda **o: spark.read.format("word").options(partition_bytes=10_000, **o)
    assert source().load(str(tmp_path)).rdd.getNumPartitions() > 1
    assert source(recursive=True).load(str(tmp_path)).count() == 15
    assert source(pattern="r1*.docx").load(str(tmp_path)).count() == 3
    assert source().schema("file_name string").load(str(tmp_path)).count() == 14
    assert spark.read.format("word").option("pattern", "none").load(str(tmp_path)).count() == 0


def test_partitions_by_size():
    sizes = [(f"f{k}", 10 * k) for k in range(50)] + [("large", 10**6)]
    groups = word.dealt(sizes, 500, 0)
    assert sorted(p for g in groups for p in g) == sorted(p for p, _ in sizes) and ["large"] in groups
    assert all(len(g) == 1 or sum(dict(sizes)[p] for p in g) <= 500 for g in groups) and len(groups) < 35


def test_texts_are_read_as_bytes_unless_compressed(spark, tmp_path, capsys):
    for name, content in {"a.txt": b"\xef\xbb\xbfx\r\n\xff\xc3", "b b+%41.txt": "æ\n\n".encode(), "none.txt": b"", "_h.txt": b"h", "c.json": b"{}", "in/d.txt": b"d", "e.txt.gz": gzip.compress(b"e")}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for pattern, recursive, n in (("*.txt", False, 2), ("*.txt", True, 3), ("*.json", False, 1), ("*.gz", False, 1), ("*.t*", False, 3)):
        whole = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(str(tmp_path), wholetext=True)
        want = whole.select("_metadata.file_name", "_metadata.file_path", F.hex("value"), F.length("value"))
        found = files.texts(spark, str(tmp_path), pattern, recursive)
        assert found.columns == ["file_name", "file_path", "text"] and found.schema["text"].dataType.simpleString() == "string"
        assert sorted(map(tuple, found.select("file_name", "file_path", F.hex("text"), F.length("text")).collect())) == sorted(map(tuple, want.collect()))
        assert found.count() == n
        capsys.readouterr()
        found.explain("formatted")
        assert ("binaryFile" in capsys.readouterr().out) == pattern.endswith((".txt", ".json"))


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f{k}.txt").write_text(str(k))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a task a file
    try:
        found = files.texts(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() == 32 * spark.sparkContext.defaultParallelism
        assert {r.file_name: r.text for r in found.collect()} == {f"f{k}.txt": str(k) for k in range(300)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
