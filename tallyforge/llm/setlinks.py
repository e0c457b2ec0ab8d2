"""Links between sets by their exact similarity, inside groups of candidates.

A link joins two sets that share at least num / den of their union. Groups come as a table
(node, root, lead) of candidates: all links lie inside a group, a node may be in several, and
lead is the least node of the group root. Groups of up to `dense`
members and HELD elements are compared whole, in one task. In larger ones all that are
similar enough to the least member are linked to it, and only the others are compared with
the group, block by block. Both ways give back a spanning forest of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, likely_in, materialize, sweep

#: Elements of a group compared in one task and of one side of a block, members of that, elements indexed at once.
HELD, BLOCK, INDEXED = 1 << 21, 4096, 1 << 18


def forest(a: np.ndarray, sa: list[np.ndarray], b: np.ndarray, sb: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between nodes a and b; sets are arrays of distinct longs. Of b, INDEXED elements at a time are indexed."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own, other = at[: len(a)], at[len(a) :]
    label, out, lo = np.arange(len(nodes)), [], 0
    while lo < len(sb):
        hi, held = lo + 1, len(sb[lo])
        while hi < len(sb) and held + len(sb[hi]) <= INDEXED:
            held += len(sb[hi])
            hi += 1
        size = np.array([len(s) for s in sb[lo:hi]], np.int64)
        values, owner = np.concatenate(sb[lo:hi]), np.repeat(np.arange(hi - lo, dtype=np.int32), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for i, s in enumerate(sa):
            left, right = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = right - left
            which = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[which], minlength=hi - lo)
            hits = other[lo:hi][den * shared >= num * (len(s) + size - shared)]
            labels, first = np.unique(label[hits], return_index=True)
            new = labels != label[own[i]]
            if new.any():
                out += [(int(nodes[own[i]]), int(nodes[hits[k]])) for k in first[new]]
                label[np.isin(label, labels)] = label[own[i]]
        lo = hi
    return out


def _met(rows: tuple, cols: tuple, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of a block's rows and columns, each (nodes, sets)."""
    return forest(np.array(rows[0]), rows[1], np.array(cols[0]), cols[1], num, den) if rows[0] and cols[0] else []


def _edges(found: list) -> pa.RecordBatch:
    xy = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=["x", "y"])


def _short(rows: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        last, nodes, sets = None, [], []
        for batch in batches:
            found = []
            values = batch.column(2).flatten().to_numpy()
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
            for k, (root, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if root != last:
                    if len(nodes) > 1:
                        found += forest(np.array(nodes), sets, np.array(nodes), sets, num, den)
                    last, nodes, sets = root, [], []
                nodes.append(node)
                sets.append(values[ends[k - 1] if k else 0 : ends[k]].copy())
            yield _edges(found)
        if len(nodes) > 1:
            yield _edges(forest(np.array(nodes), sets, np.array(nodes), sets, num, den))

    return rows.select("root", "node", "items").repartition("root").sortWithinPartitions("root").mapInArrow(run, "x long, y long")


def _led(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The members of long groups, and if they are far (not similar enough to the least member), written."""
    first = rows.where("node = lead").select("root", F.col("items").alias("own"))
    shared = F.size(F.array_intersect("items", "own"))
    far = den * shared < num * (F.size("items") + F.size("own") - shared)
    return materialize(rows.join(first, "root").withColumn("far", far).drop("own"), "led")


def _blocks(led: DataFrame) -> DataFrame:
    """root, node, items, row, c, r: the far members (row) of each group, and all, at the blocks where they meet.

    Blocks are dealt one by one: left to itself, Spark keeps the partitions of the join by
    root, and one task gets all blocks of a group.
    """
    n, size = F.count("*"), F.sum(F.size("items"))
    m, rest = F.count_if("far"), F.sum(F.when(F.col("far"), F.size("items")).otherwise(0))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / HELD)).cast("int")
    parts = led.groupBy("root").agg(blocks(n, size).alias("nc"), blocks(m, rest).alias("nr")).where("nr > 0")
    dealt = led.join(parts, "root")
    r, c = F.pmod(F.xxhash64("node", F.lit("r")), "nr").cast("int"), F.pmod(F.xxhash64("node", F.lit("c")), "nc").cast("int")
    every = dealt.select("root", "node", "items", F.lit(False).alias("row"), c.alias("c"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"))
    odd = dealt.where("far").select("root", "node", "items", F.lit(True).alias("row"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("c"), r.alias("r"))
    return every.unionByName(odd.select(every.columns)).repartition("root", "r", "c")


def _long(led: DataFrame, num: int, den: int) -> DataFrame:
    direct = led.where("not far and node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))

    # Blocks pass Python in small batches: as groups of pandas each would be one batch, outside the heap.
    def run(batches):
        last, rows, cols = None, ([], []), ([], [])
        for batch in batches:
            found = []
            values = batch.column(5).flatten().to_numpy()
            ends = np.cumsum(batch.column(5).value_lengths().to_numpy())
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for k, (key, node, row) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if key != last:
                    found += _met(rows, cols, num, den)
                    last, rows, cols = key, ([], []), ([], [])
                nodes, sets = rows if row else cols
                nodes.append(node)
                sets.append(values[ends[k - 1] if k else 0 : ends[k]].copy())
            yield _edges(found)
        yield _edges(_met(rows, cols, num, den))

    dealt = _blocks(led).select("root", "r", "c", "node", "row", "items").sortWithinPartitions("root", "r", "c")
    return direct.unionByName(dealt.mapInArrow(run, "x long, y long"))


def set_links(sets: DataFrame, groups: DataFrame, num: int, den: int, dense: int) -> DataFrame:
    """x, y: what joins the similar sets of each group; sets: node, items (distinct longs); groups: node, root, lead."""
    rows = materialize(likely_in(sets, "node", groups).join(groups, "node").select("root", "node", "lead", "items"), "members")
    small = (F.count("*") <= dense) & (F.sum(F.size("items")) <= HELD)
    sizes = materialize(rows.groupBy("root").agg(small.alias("small")), "sizes")
    part = lambda kind: rows.join(sizes.where(kind).select("root"), "root", "left_semi")
    short = materialize(_short(part("small"), num, den), "short-links")
    led = _led(part("not small"), num, den)
    forget(rows, sizes)
    sweep(sets.sparkSession)
    long = materialize(_long(led, num, den), "long-links")
    forget(led)
    return short.unionByName(long)
