"""Links inside long lists of fingerprints, without pairs: shared by both SimHash operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def distance(a: Column, b: Column, words: int) -> Column:
    """Differing bits of two arrays of `words` longs."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, words):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def dense_links(hot: DataFrame, radius: int, words: int, block: int = 4096) -> DataFrame:
    """x, y: links that join what lies within radius bits in each list (key, node, fp: array of longs).

    All within the radius of the list's least member are linked to it. Only the others are
    compared with the list, in blocks of rows and columns; a block gives back a spanning
    forest of its links.
    """
    lead = hot.groupBy("key").agg(F.min_by("fp", "node").alias("lead_fp"), F.min("node").alias("lead"))
    rows = hot.join(lead, "key").withColumn("far", distance(F.col("fp"), F.col("lead_fp"), words) > radius).select("key", "node", "fp", "far", "lead")
    rows = materialize(rows, "led")
    direct = rows.where("not far and node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("nc"), F.ceil(F.count_if("far") / block).cast("int").alias("nr")).where("nr > 0")
    sized = rows.join(size, "key")
    r, c = F.pmod(F.xxhash64("node", F.lit("r")), "nr").cast("int"), F.pmod(F.xxhash64("node", F.lit("c")), "nc").cast("int")
    every = sized.select("key", "node", "fp", F.lit(False).alias("row"), c.alias("c"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"))
    odd = sized.where("far").select("key", "node", "fp", F.lit(True).alias("row"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("c"), r.alias("r"))

    def run(pdf):
        import pandas as pd

        far, rest = pdf[pdf["row"]], pdf[~pdf["row"]]
        out = forest(far["node"].to_numpy(), _matrix(far["fp"]), rest["node"].to_numpy(), _matrix(rest["fp"]), radius) if len(far) and len(rest) else []
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64")

    return direct.unionByName(every.unionByName(odd.select(every.columns)).groupBy("key", "r", "c").applyInPandas(run, "x long, y long"))


def _matrix(fps) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in fps]).view(np.uint64)


def forest(a: np.ndarray, fa: np.ndarray, b: np.ndarray, fb: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between nodes a and b; fingerprints unsigned."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, out = np.arange(len(nodes)), []
    for i in range(len(a)):
        d = np.bitwise_count(fa[i] ^ fb).sum(1, dtype=np.int32)
        own, hits = at[i], at[len(a) :][d <= radius]
        labels, first = np.unique(label[hits], return_index=True)
        new = labels != label[own]
        if new.any():
            out += [(int(nodes[own]), int(nodes[hits[k]])) for k in first[new]]
            label[np.isin(label, labels)] = label[own]
    return out
