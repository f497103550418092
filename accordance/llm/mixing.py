"""Mixing sources to target weights by hierarchical budgeting.

The levels of a tree (say domain, language, source) lead to leaves. A budget of tokens goes down the
tree: at each node it is shared among the children in proportion to their weights, but none gets more
than its subtree can give (its tokens times ``max_epochs``); what one lacks goes to its siblings in
proportion to theirs. So a leaf's shortage stays with its siblings while they have room, and reaches
the parent's siblings only then. Shares are whole tokens and add up to the budget.

A leaf gives whole epochs and, of the next, the prefix that fits: its documents in the order of a
seeded hash of epoch and id, as far as their tokens add up to at most what is left. The prefix is found
from sums over slices of that order, so no leaf, however large, is sorted in one task.

Documents are never cut, so a leaf gives less than its share by what is left before the first document of its order that
doesn't fit. A leaf is blocked if that document is longer than what all leaves have left together, so that nothing they
could pass on would let it go on. Blocked leaves stay at what they give, and the budget is given a second time with that as
their limit: what they can't use goes to their siblings first, then to their parent's, by the same rule. What is left over
after that stays so.

Null levels form a child of their own named "". Documents of one id have one place and are taken or
left together; documents without tokens come with the prefix they lie in. Null and empty texts have
no tokens. Repeated rows
count each. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm.storage import staged

#: Leaves are joined as a broadcast up to so many.
MAX_BROADCAST_LEAVES = 100_000
#: Hexadecimal digits of the hash that make a slice of a leaf (4096 slices).
SLICE_DIGITS = 3


def word_count(text: str = "text") -> Column:
    """Runs without blank, tab or line end; the default measure of tokens."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    made = F.lit(weights.get("*", 1))
    for key, weight in weights.items():
        made = F.when(F.col(column) == key, F.lit(weight)).otherwise(made)
    return made.cast("long")


def allocate(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (the levels and tokens, one row each) with share, the whole tokens that each leaf is to give.

    ``weights``: for each level positive whole weights by child; "*" is for those not named, 1 if missing.
    ``budget``: of tokens, given the sum of all as the column total. Whole numbers throughout. A leaf gives at most its
    column most, if there is one and it isn't null.
    """
    number = "decimal(38,0)"
    cap = F.col("tokens") * max_epochs
    caps = leaves.withColumn("cap", (F.least(cap, "most") if "most" in leaves.columns else cap).cast(number))
    root = caps.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("cap"), F.lit(0)).cast(number).alias("cap"))
    above = root.select(F.lit(1).alias("_root"), F.least(budget.cast("long").cast(number), F.col("cap")).alias("share"))
    parent: list[str] = ["_root"]
    for depth, level in enumerate(levels):
        nodes = caps.withColumn("_root", F.lit(1)).groupBy("_root", *levels[: depth + 1]).agg(F.sum("cap").cast(number).alias("cap"))
        nodes = nodes.join(above, parent).withColumn("w", _weight(level, weights[depth]).cast("decimal(18,0)"))
        # children fill up in the order of cap by weight: the full ones come first
        order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("w")), level)
        nodes = nodes.withColumns({
            "given": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(number),
            "open": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(18,0)"),
        })
        nodes = nodes.withColumn("full", F.col("cap").cast("decimal(19,0)") * F.col("open") <= (F.col("share") - F.col("given")).cast("decimal(19,0)") * F.col("w"))
        family = Window.partitionBy(*parent)
        nodes = nodes.withColumns({
            "left": F.col("share") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)),
            "wide": F.sum(F.when(~F.col("full"), F.col("w"))).over(family),
        })
        nodes = nodes.withColumn("own", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(cast(left as decimal(19,0)) * w div wide as decimal(19,0))")).cast("decimal(19,0)"))
        nodes = nodes.withColumns({
            "over": F.col("share") - F.sum("own").over(family),
            "place": F.row_number().over(Window.partitionBy(*parent, "full").orderBy(level)),
        })
        mine = F.col("own") + F.when(~F.col("full") & (F.col("place") <= F.col("over")), F.lit(1)).otherwise(F.lit(0))
        above = nodes.select("_root", *levels[: depth + 1], mine.cast(number).alias("_mine")).withColumnRenamed("_mine", "share")
        parent = ["_root", *levels[: depth + 1]]
    return leaves.join(above.drop("_root").withColumn("share", F.col("share").cast("long")), levels)


def _place(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: Column, max_epochs: int = 2, seed: int = 11, tokens: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs`` with epoch (from 0) and tokens, once for each epoch they are chosen in.

    ``levels``: names and columns of the tree's levels from the top. ``budget``: tokens to give, as a column
    of total (all tokens). Columns of ``docs`` named epoch or tokens are replaced; others of any name stay as they are.
    """
    names = [f"_{name}" for name in levels]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("epoch", "tokens"))).alias("row")  # so that no name of ours meets one of the table's
    measure = word_count() if tokens is None else tokens
    placed = docs.select(row, F.col("doc_id").alias("doc_id"), measure.alias("tokens"), *(F.coalesce(column.cast("string"), F.lit("")).alias(f"_{name}") for name, column in levels.items()))
    thin = staged(placed.select(*names, "doc_id", "tokens"), "sizes")
    trees = thin.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    few = trees.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    def given(trees: DataFrame) -> DataFrame:
        """Of each leaf its tokens, share, whole epochs, the rest beyond them, the last place whose sum fits the rest, that sum
        (used) and the tokens of what comes next."""
        shared = allocate(trees, names, weights, budget, max_epochs)
        part = lambda by: F.when(F.col("tokens") > 0, F.expr(f"share {by} tokens")).otherwise(F.lit(0))
        leaves = staged(shared.select(*names, "tokens", part("div").alias("whole"), part("%").alias("rest")), "leaves")
        hashed = thin.join(small(leaves.drop("tokens")), names).where("rest > 0").withColumn("place", _place(seed, F.col("whole"))).withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
        slices = hashed.groupBy(*names, "slice", "rest").agg(F.sum("tokens").alias("n"))
        slices = slices.withColumn("to", F.sum("n").over(Window.partitionBy(*names).orderBy("slice")))
        # the slice in which the budget ends, and the last place in it that still fits
        ends = slices.where("to > rest and to - n <= rest").select(*names, "slice", (F.col("to") - F.col("n")).alias("before"))
        inside = hashed.join(small(ends), [*names, "slice"]).withColumn("sum", F.col("before") + F.sum("tokens").over(Window.partitionBy(*names, "slice").orderBy("place")))
        fits = F.col("sum") <= F.col("rest")
        found = inside.groupBy(*names).agg(F.max(F.when(fits, F.col("place"))).alias("last"), F.max(F.when(fits, F.col("sum"))).alias("used"), F.min(F.when(~fits, F.col("sum"))).alias("next"))
        last = ends.join(found, names).select(*names, F.coalesce("last", F.col("slice")).alias("last"), F.coalesce("used", F.col("before")).alias("used"), "next")
        return leaves.join(last, names, "left").select(*names, "tokens", "whole", "rest", "last", F.coalesce("used", F.lit(0)).alias("used"), (F.col("next") - F.coalesce("used", F.lit(0))).alias("next"))

    leaves = staged(given(staged(trees, "trees")), "given")
    over = leaves.agg(F.coalesce(F.sum(F.col("rest") - F.col("used")), F.lit(0))).first()[0]  # one number
    blocked = (F.col("rest") > F.col("used")) & (F.col("next") > over)
    again = staged(leaves.select(*names, "tokens", F.when(blocked, F.col("whole") * F.col("tokens") + F.col("used")).alias("most")), "limits")
    if not again.where("most is not null").isEmpty():
        leaves = given(again)
    last = leaves.select(*names, "whole", "rest", "last")
    chosen = last.withColumn("last", F.coalesce("last", F.lit("")))
    epochs = F.col("whole") + ((F.col("rest") > 0) & (_place(seed, F.col("whole")) <= F.col("last"))).cast("long")
    found = placed.join(small(staged(chosen, "chosen")), names).withColumn("_epochs", epochs).where("_epochs > 0")
    return found.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_epochs") - 1).cast("int")))).select("row.*", "epoch", "tokens")
