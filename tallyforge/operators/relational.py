"""Relational operators behind the receipt service's loops, over any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_match(df: DataFrame, key: str, order: list[str], is_label: Column, is_value: Column, value: str) -> DataFrame:
    """Forward as-of: each label row with the first value after it in its key, before the next label."""
    # Backwards, so that a running frame does: the last one seen is the next one in order.
    seen = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.struct(*order)
    out = df.withColumn("_label", F.last(F.when(is_label, mark), ignorenulls=True).over(seen)).withColumn("_value", F.last(F.when(is_value, F.struct(mark.alias("at"), F.col(value).alias("v"))), ignorenulls=True).over(seen))
    hit = F.col("_value").isNotNull() & (F.col("_label").isNull() | (F.col("_value.at") < F.col("_label")))
    return out.where(is_label).withColumn("matched", F.when(hit, F.col("_value.v"))).drop("_label", "_value")


def islands(df: DataFrame, key: str, order: list[str], gap: Column) -> DataFrame:
    """Adds island: runs of rows of a key without a gap; gap may use _prev, the row before as a struct."""
    seq = Window.partitionBy(key).orderBy(*order)
    out = df.withColumn("_prev", F.lag(F.struct(*df.columns)).over(seq))
    return out.withColumn("island", F.sum(F.when(F.col("_prev").isNull() | gap, 1).otherwise(0)).over(seq.rowsBetween(Window.unboundedPreceding, 0))).drop("_prev")


def newest(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The n newest rows, newest first."""
    return df.orderBy(*order).limit(n)


def last_items(df: DataFrame, order: list[str], n: int | None = 100) -> DataFrame:
    """The last n rows in the order, oldest first; all where n is 0 or None."""
    return df.orderBy(*order) if not n else df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def nearest(df: DataFrame, other: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row of df with the value of other's row in the same key that is nearest by `at`; of equally near ones the earlier.

    One union and two running frames, forwards and backwards: no pairs are made.
    """
    cols = df.columns
    both = df.select("*", F.lit(None).cast(other.schema[value].dataType).alias("_v"), F.lit(True).alias("_own")).unionByName(other.select(key, at, F.col(value).alias("_v"), F.lit(False).alias("_own")), allowMissingColumns=True)
    seen = F.when(~F.col("_own"), F.struct(at, "_v"))
    up, down = Window.partitionBy(key).orderBy(F.col(at), F.col("_own")), Window.partitionBy(key).orderBy(F.desc(at), F.col("_own"))
    out = both.withColumn("_a", F.last(seen, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(seen, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))).where("_own")
    before = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col(at) - F.col(f"_a.{at}") <= F.col(f"_b.{at}") - F.col(at)))
    return out.select(*cols, F.when(before, F.col("_a._v")).otherwise(F.col("_b._v")).alias("nearest"))


def looking_ahead(df: DataFrame, key: str, order: list[str], is_label: Column, is_value: Column, value: str, reach: int = 8) -> DataFrame:
    """Each label row with the first value among the `reach` rows after it in its key."""
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(1, reach)
    return df.withColumn("found", F.first(F.when(is_value, F.col(value)), ignorenulls=True).over(ahead)).where(is_label)


def top_in_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def update_known(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """df with the values of updates where its key matches and they aren't null; unknown keys and columns are ignored."""
    cols = [c for c in updates.columns if c in df.columns and c != key]
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return df.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else c for c in df.columns])
