"""Operator 10, mixing sources to target weights: hierarchical budgeting in DataFrame operations only.

A tree domain > language > source has a weight at each node (1 where none is given). The
token budget goes down the tree in proportion to weights. A child whose subtree holds less
than its share (tokens times max_epochs) is filled, and its shortage goes to its siblings;
only what a whole family can't hold goes back to its ancestors, because each parent's own
share is limited by what its subtree holds before its children get theirs. Shares are
computed in whole numbers, by windows over siblings; no table is collected.

A leaf takes whole epochs, then a prefix of the next one: its documents in the order of
md5(seed:epoch:doc_id), as long as their tokens fit. Running sums go over hash buckets first
and over rows only inside the one bucket where the budget ends, so a leaf with a third of
all rows isn't sorted by one task.

Null domain, language or source is a node of its own, "(null)". Null text has 0 tokens.
Rows that repeat an id stand or fall together. A leaf with a budget of zero (no words, weight
or total budget) and an empty table give no rows. Other columns, whatever their names, are kept
by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spare_names

LEVELS = ("domain", "lang", "source")
BIG = "decimal(38,0)"


def words(text: Column) -> Column:
    """Number of words: the token measure of this operator."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def weight_of(level: int, path: list[str], weights: dict[str, int]) -> Column:
    """weights: {"domain", "domain/lang" or "*/lang", "domain/lang/source" or "*/*/source": whole number}."""
    here = {k: v for k, v in weights.items() if k.count("/") == level}
    if not here:
        return F.lit(1).cast(BIG)
    table = F.create_map(*[F.lit(x) for kv in here.items() for x in kv])
    own = F.concat_ws("/", *path[: level + 1])
    any_parent = F.concat_ws("/", *[F.lit("*")] * level, path[level])
    return F.coalesce(F.element_at(table, own), F.element_at(table, any_parent), F.lit(1)).cast(BIG)


def fill(nodes: DataFrame, parent: list[str], budget: str, cap: str, weight: str, out: str) -> DataFrame:
    """Shares of siblings: proportional to weight, none above cap; what filled ones leave goes to the rest.

    Siblings in the order of cap / weight; the first k are filled, the others share what is
    left. The k-th is filled if its cap is at most its share of what those before it leave.
    """
    nodes = nodes.withColumn("_w", F.col(weight)).withColumn("_ratio", F.when(F.col("_w") > 0, F.col(cap).cast("double") / F.col("_w").cast("double")).otherwise(F.lit(float("inf"))))
    up = Window.partitionBy(*parent).orderBy("_ratio", *[c for c in LEVELS if c in nodes.columns])
    nodes = nodes.withColumn("_before", F.coalesce(F.sum(cap).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(BIG))
    ahead = F.coalesce(F.sum("_w").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = nodes.withColumn("_rest", (F.sum("_w").over(Window.partitionBy(*parent)) - ahead).cast(BIG))
    room = F.greatest(F.col(budget) - F.col("_before"), F.lit(0).cast(BIG))
    full = (F.col("_w") > 0) & F.coalesce(F.col(cap) * F.col("_rest") <= room * F.col("_w"), F.lit(False))
    family = Window.partitionBy(*parent)
    nodes = nodes.withColumn("_full", full)
    # The filled ones are a prefix; the others share what the prefix leaves, by their weights.
    nodes = nodes.withColumn("_spent", F.coalesce(F.sum(F.when(F.col("_full"), F.col(cap))).over(family), F.lit(0)).cast(BIG)).withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(family).cast(BIG))
    share = F.expr(f"(greatest({budget} - _spent, cast(0 as {BIG})) * _w) div nullif(_open, 0)")
    return nodes.withColumn(out, F.when(F.col("_full"), F.col(cap)).otherwise(F.coalesce(share, F.lit(0))).cast(BIG)).drop("_w", "_ratio", "_before", "_rest", "_full", "_spent", "_open")


def budgets(leaves: DataFrame, weights: dict[str, int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget; share: the total budget as a fraction of all tokens."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(BIG))
    for depth in (2, 1):
        leaves = leaves.withColumn(f"cap{depth}", F.sum("cap").over(Window.partitionBy(*LEVELS[:depth])).cast(BIG))
    one = leaves.groupBy("domain").agg(F.first("cap1").alias("cap1"), F.sum("tokens").alias("t1")).withColumn("_root", F.lit(0))
    one = one.withColumn("_all", F.sum("t1").over(Window.partitionBy("_root")).cast(BIG)).withColumn("budget0", F.expr(f"_all * {share[0]} div {share[1]}").cast(BIG))
    one = fill(one.withColumn("w", weight_of(0, ["domain"], weights)), ["_root"], "budget0", "cap1", "w", "budget1")
    two = leaves.groupBy("domain", "lang").agg(F.first("cap2").alias("cap2")).join(one.select("domain", "budget1"), "domain")
    two = fill(two.withColumn("w", weight_of(1, ["domain", "lang"], weights)), ["domain"], "budget1", "cap2", "w", "budget2")
    three = leaves.select(*LEVELS, "tokens", "cap").join(two.select("domain", "lang", "budget2"), ["domain", "lang"])
    three = fill(three.withColumn("w", weight_of(2, list(LEVELS), weights)), ["domain", "lang"], "budget2", "cap", "w", "budget")
    return three.select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, int], share: tuple[int, int] = (7, 10), max_epochs: int = 2, seed: int = 7, bucket_digits: int = 3) -> DataFrame:
    """The selected rows of docs with _domain, _epoch, _tokens, _budget added; a row returns once for each epoch that takes it.

    Where docs has a column of such a name, the added one has one more underscore.
    """
    null = F.lit("(null)")
    path = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    thin = docs.select("doc_id", *[F.coalesce(v.cast("string"), null).alias(k) for k, v in path.items()], words(F.col("text")).alias("tokens"))
    thin = materialize(thin, "mix")
    leaves = materialize(budgets(thin.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, share, max_epochs), "leaves")
    # Whole epochs that fit, and the tokens left for a prefix of the next.
    leaves = leaves.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(max_epochs)).cast("int")).withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens"))
    part = leaves.where(f"left > 0 and whole < {max_epochs}").select(*LEVELS, "whole", "left")
    keyed = thin.join(part, list(LEVELS)).withColumn("key", order_key(seed, F.col("whole"))).withColumn("bucket", F.substring("key", 1, bucket_digits))
    sums = keyed.groupBy(*LEVELS, "left", "bucket").agg(F.sum("tokens").alias("n"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    # The first bucket that goes beyond the budget; rows of buckets before it all fit.
    edge = sums.where("upto > left").groupBy(*LEVELS).agg(F.min("bucket").alias("bucket"), F.min("upto").alias("upto"))
    edge = edge.join(sums.select(*LEVELS, "bucket", "n"), [*LEVELS, "bucket"]).select(*LEVELS, "bucket", (F.col("upto") - F.col("n")).alias("before"))
    inside = keyed.join(edge, [*LEVELS, "bucket"])
    rows = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    beyond = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(rows)).where("upto > left").groupBy(*LEVELS).agg(F.min("key").alias("stop"))
    names = spare_names(docs.columns, "d", "l", "s", "budget", "whole", "left", "stop")
    d, l, s, budget, whole, left, stop = names  # noqa: E741
    plan = leaves.join(beyond, list(LEVELS), "left").select(*LEVELS, "budget", "whole", "left", "stop").toDF(*names)
    plan = materialize(plan, "plan")
    own = spare_names([*docs.columns, *names], *LEVELS)
    mine = docs.select("*", *[F.coalesce(v.cast("string"), null).alias(k) for k, v in zip(own, path.values())])
    joined = mine.join(plan, (F.col(own[0]) == F.col(d)) & (F.col(own[1]) == F.col(l)) & (F.col(own[2]) == F.col(s)))
    last = (F.col(left) > 0) & (F.col(whole) < max_epochs) & (F.col(stop).isNull() | (order_key(seed, F.col(whole)) < F.col(stop)))
    last = last & (F.col(budget) > 0)
    full = F.when(F.col(whole) > 0, F.sequence(F.lit(0), F.col(whole) - 1)).otherwise(F.array().cast("array<int>"))
    epochs = F.concat(full, F.when(last, F.array(whole)).otherwise(F.array().cast("array<int>")))
    added = spare_names(docs.columns, "_domain", "_epoch", "_tokens", "_budget")
    values = [F.col(d), F.explode(F.when(F.col(budget) > 0, epochs)), words(F.col("text")), F.col(budget)]
    return joined.select(*docs.columns, *[v.alias(k) for k, v in zip(added, values)])
