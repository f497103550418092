"""A manifest of a table as a tree of hashes: each row's leaf, its group's subroot, the root of all, and a proof of the row.

Leaves of a group stand in a given order; every so many consecutive nodes (the last run may be shorter, also one) become the
hash of their digests, until one is left, the group's subroot. Subroots, in the order of the groups' names (a null name
first, then by UTF-8 bytes), become the root in the same way. A row's proof holds its siblings of each level, so leaf and
proof alone give the root again, and a changed row doesn't.

Levels are DataFrames: a node's place divided by the fan-out is its parent's place, so a level is one grouping by group and
place, however large a group is, and is written before the next is made from it. Proofs go down the same levels: each join
of parents with their children puts the children's siblings before what the parent has; the rows of all levels together are
half as many as the leaves. Places come from a sort by ranges of group and order: rows are counted by group and range, and
the counts before a range are added to the places in it, so no group meets in one task.

Rows that are equal in the order stand by their leaves; equal rows get places of their own and differ only in their proofs.
A null in the order comes first. An empty table has no rows and no root. Further columns are kept in ``keep`` only and may
have any name, those of the result but for ``leaf``, ``subroot``, ``root`` and ``proof`` included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm.storage import staged

#: A level's siblings: the digests left and right of the node, each joined.
_STEP = "array<struct<l:string,r:string>>"


def h(*parts: Column) -> Column:
    """The lower-case hex SHA-256 of the parts' UTF-8 in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*columns: Column) -> Column:
    """The hash of some values: ``-`` for null, else the length of their text in bytes, a colon and the text."""
    texts = [c.cast("string") for c in columns]
    return h(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def numbered(table: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``table`` (stored, so that it is the same when read again) with pos, a row's place from 0 in its group by ``order``,
    and n, the rows of the group. ``by`` isn't null. Groups of any size: no window goes over more than their ranges."""
    keys = [F.col(c).asc_nulls_first() for c in (by, *order, "_row")]
    rows = table.withColumn("_row", F.monotonically_increasing_id())  # so that equal rows can lie in several ranges
    dealt = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))  # the number of the partition
    counts = dealt.groupBy(by, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(by)
    before = F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")
    counts = counts.select(by, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return dealt.join(counts, [by, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _grown(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels over ``nodes`` (key, pos, n, digest, payload) as tables of parents (key, pos, n, digest, children), and of
    each key the digest and height of its last node."""
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number
    levels, roots = [], None
    while True:
        done = nodes.where("n = 1").select("key", "digest", F.lit(len(levels)).alias("height"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1:
            return levels, roots
        child = F.struct("pos", "digest", *(["payload"] if "payload" in nodes.columns else []))
        parent = [F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")]
        runs = nodes.where("n > 1").groupBy("key", *parent).agg(F.array_sort(F.collect_list(child)).alias("children"))
        level = staged(runs.withColumn("digest", F.sha2(F.array_join("children.digest", "").cast("binary"), 256)), "level")
        levels.append(level)
        nodes, most = level.select("key", "pos", "n", "digest"), -(-most // fanout)


def _proved(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """key, pos, subroot, proof and child of every node under the levels. ``tops``: key, height, subroot and proof of each
    key's last node; a key whose height is 0 has no level and isn't in the result."""
    above = None
    for k in reversed(range(len(levels))):
        entering = tops.where(F.col("height") == k + 1).select("key", F.lit(0).cast("long").alias("pos"), "subroot", "proof")
        above = entering if above is None else above.select(*entering.columns).unionByName(entering)
        children = above.join(levels[k].select("key", "pos", "children"), ["key", "pos"])
        each = children.select("key", "pos", "subroot", "proof", "children", F.posexplode("children").alias("_k", "child"))
        side = lambda start, size: F.array_join(F.slice(F.col("children.digest"), start, size), "")
        own = F.struct(side(F.lit(1), F.col("_k")).alias("l"), side(F.col("_k") + 2, F.size("children")).alias("r"))
        above = each.select("key", (F.col("pos") * fanout + F.col("_k")).alias("pos"), "subroot", F.concat(F.array(own), "proof").cast(_STEP).alias("proof"), "child")
    return above


def manifest(rows: DataFrame, by: Column, order: list[Column], leaf: Column, keep: dict[str, Column], fanout: int = 3) -> DataFrame:
    """``keep``'s columns with leaf, subroot, root and proof of every row; see above. proof: of each level, from the leaf's up,
    the digests left and right of the node."""
    key = F.coalesce(F.concat(F.lit("="), by.cast("string")), F.lit(""))
    places = {f"_o{k}": c for k, c in enumerate(order)}
    payload = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(keep.values()))) if keep else F.struct(F.lit(0).alias("c"))
    leaves = staged(rows.select(key.alias("key"), leaf.alias("digest"), *(c.alias(name) for name, c in places.items()), payload.alias("payload")), "leaves")
    nodes = numbered(leaves, "key", [*places, "digest"]).drop(*places)
    levels, roots = _grown(nodes, fanout)
    roots = staged(roots, "roots")

    upper = numbered(roots.withColumns({"all": F.lit(0), "payload": F.struct("key", "height")}).drop("key", "height"), "all", ["payload"])
    upper = upper.withColumnRenamed("all", "key")
    above, last = _grown(upper, fanout)
    root = last.first()
    none = F.array().cast(_STEP)
    tops = _proved(above, last.select("key", "height", F.lit(None).cast("string").alias("subroot"), none.alias("proof")), fanout) if above else upper.select(F.struct("digest", "payload").alias("child"), none.alias("proof"))
    tops = staged(tops.select("child.payload.key", "child.payload.height", F.col("child.digest").alias("subroot"), "proof"), "tops")

    lone = nodes.where("n = 1").join(tops.where("height = 0"), "key").select("subroot", "proof", "digest", "payload")
    found = _proved(levels, tops, fanout).select("subroot", "proof", "child.digest", "child.payload").unionByName(lone) if levels else lone
    return found.select(*(F.col(f"payload.c{k}").alias(name) for k, name in enumerate(keep)), F.col("digest").alias("leaf"), "subroot", F.lit(root.digest if root else None).alias("root"), "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by its proof."""
    return F.aggregate(proof, leaf, lambda node, step: h(step["l"], node, step["r"]))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["l"], step["r"])), "").cast("binary"), 256)


def verify(rows: DataFrame, stored: DataFrame, on: list[str], leaf: Column) -> DataFrame:
    """``on``, and verified: if each of the ``rows`` still is what the ``stored`` manifest says; null for a row that isn't in it."""
    now = rows.select(*on, leaf.alias("_leaf"))
    same = F.when(F.col("root").isNotNull(), folded(F.col("_leaf"), F.col("proof")) == F.col("root"))
    return now.join(stored.select(*on, "proof", "root"), on, "left").select(*on, same.alias("verified"))


def document_manifest(docs: DataFrame, fanout: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and folded_root and verified after tampering with every document whose id's
    crc32 is even: its line ends are deleted. Documents without any stay as they are."""
    ident, text = F.col("doc_id").cast("long"), F.col("text")
    of = lambda t: leaf(ident, F.col("source"), F.col("lang"), F.col("n_chars"), t)
    hit = (F.crc32(ident.cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    tampered = F.when(hit, of(F.replace(text, F.lit("\n"), F.lit(""))))  # null where nothing changes
    made = manifest(docs, F.col("source"), [ident], of(text), {"doc_id": ident, "tampered": tampered}, fanout)
    end = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), end.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
