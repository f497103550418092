"""The manifest against a tree built in plain Python."""

import hashlib
import zlib

from pyspark.sql import functions as F

from accordance.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, fanout):
    """The last node, and of each leaf the (left, right) digests level by level."""
    at, proofs, nodes = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(nodes) > 1:
        for k, p in enumerate(at):
            first = p // fanout * fanout
            proofs[k].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], proofs


def brute(rows, fanout=3):
    """Of rows (doc_id, source, lang, n_chars, text): sorted rows of the query."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in groups[s]], fanout)
    root, above = tree([trees[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, above):
        for (_, _, digest, r), proof in zip(groups[s], trees[s][1]):
            steps = proof + top
            now = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = leaf(*r[:4], r[4].replace("\n", ""))
            for left, right in steps:
                now = h(left, now, right)
            out.append((-1 if r[0] is None else r[0], digest, trees[s][0], root, h(*(x for p in steps for x in p)), now, now == root))
    return sorted(out)


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.select(*names).collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_small_tables(spark):
    """Groups of 1 to 28 rows, names and values null or empty, ties, repeated rows, a long text."""
    rows = [(k * 7 % 101, f"s{n}", "en" if k % 3 else None, k if k % 5 else None, f"a\nb{k}" if k % 4 else None) for n in (1, 2, 3, 4, 9, 10, 28) for k in range(n)]
    rows += [(5, None, None, None, None), (6, "", "", 0, ""), (7, "é", "x", 1, "\n"), (7, "Z", "x", 1, "x" * 300_000 + "\n")]
    rows += [(7, "t", "x", 1, "a"), (7, "t", "x", 1, "b"), (7, "t", "x", 1, "b\n"), (None, "t", "x", 1, "b"), (8, "t", "x", 1, "same"), (8, "t", "x", 1, "same")]
    assert found(merkle.document_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert found(merkle.document_manifest(spark.createDataFrame(rows, SCHEMA), fanout=5)) == brute(rows, 5)


def test_one_row_and_none(spark):
    one = [(2, "a", "en", 3, "x\ny")]
    assert found(merkle.document_manifest(spark.createDataFrame(one, SCHEMA))) == brute(one)
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lone_groups(spark):
    rows = [(k, f"g{k:02d}", None, None, "\n") for k in range(11)]
    assert found(merkle.document_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_equal_rows_in_many_ranges(spark):
    """A group of one repeated row over several ranges: places are still gapless."""
    table = spark.range(0, 5000, 1, 8).select(F.lit("g").alias("key"), F.lit(1).alias("o"))
    path_order = merkle.numbered(merkle.staged(table), "key", ["o"])
    assert sorted(r.pos for r in path_order.collect()) == list(range(5000)) and {r.n for r in path_order.collect()} == {5000}


def test_clashing_columns(spark):
    rows = [(k, f"s{k % 2}", "en", k, f"{k}\n") for k in range(9)]
    docs = spark.createDataFrame([(*r, "k", 1, 2, 3, "p", True) for r in rows], SCHEMA + ", key string, pos int, n int, digest int, payload string, verified boolean")
    assert found(merkle.document_manifest(docs)) == brute(rows)
    made = merkle.manifest(docs, F.col("source"), [F.col("doc_id")], merkle.leaf(F.col("text")), {"key": F.col("key"), "pos": F.col("pos"), "children": F.col("digest")})
    assert made.columns == ["key", "pos", "children", "leaf", "subroot", "root", "proof"] and {tuple(r)[:3] for r in made.collect()} == {("k", 1, 3)}


def test_verify(spark):
    """A changed, an unchanged and an unknown row against a stored manifest."""
    docs = spark.createDataFrame([(k, f"s{k % 2}", f"t{k}") for k in range(20)], "doc_id long, source string, text string")
    of = lambda: merkle.leaf(F.col("doc_id"), F.col("text"))
    stored = merkle.staged(merkle.manifest(docs, F.col("source"), [F.col("doc_id")], of(), {"doc_id": F.col("doc_id")}))
    later = docs.withColumn("text", F.when(F.col("doc_id") == 3, "else").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "s0", "new")], docs.schema))
    got = {r.doc_id: r.verified for r in merkle.verify(later, stored, ["doc_id"], of()).collect()}
    assert got == {**{k: k != 3 for k in range(20)}, 99: None}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(queries.op11_merkle_manifest(spark, sf)) == brute(rows)
