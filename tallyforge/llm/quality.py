"""Operator 5, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed by Spark for every whole text. Trees are fitted in numpy on the
driver, on labelled rows outside the held-out part: all of them up to `max_rows`, else as
many of 4096 classes by hash as fit that number (a documented bound). Statistics are binned into at most 64
bins, trees are grown best split first over gradient histograms, and flattened into arrays;
scoring walks all rows of a batch down all trees by array lookups.

Null text counts as empty. Without labelled rows the score is 0.5; with one class only it
is near that class. Repeated rows each get a row. Labels with null ids or values are
ignored; a document labelled twice counts with its lowest quality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, remainder, spare_names
from .docstats import quality_stats

STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct_words", "n_upper", "n_digits", "n_shouts", "n_bars", "n_stops", "n_chars_all"]
MAX_ROWS = 200_000


def features(raw: np.ndarray) -> np.ndarray:
    """Ratios and sizes from the counts (columns in the order of STATS)."""
    w, c, sym, lines, dup, distinct, upper, digits, shouts, bars, stops, chars = raw.astype(np.float64).T
    one = lambda x: np.maximum(x, 1)
    return np.stack([np.log1p(w), c / one(w), sym / one(c), bars / one(w), dup / one(lines), w / one(lines), distinct / one(w), distinct / one(np.sqrt(w)), upper / one(c), digits / one(c), shouts / one(w), stops / one(w), chars / one(c)], axis=1)


class Trees:
    """Binary logistic boosting; feature, threshold and children of all nodes in flat arrays."""

    def __init__(self, base: float, edges, feature, limit, left, value, roots, depth: int):
        self.base, self.edges, self.depth = base, edges, depth
        self.feature, self.limit, self.left, self.value, self.roots = feature, limit, left, value, roots

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                # a leaf points at itself
                go = b[rows, self.feature[at]] > self.limit[at]
                at = np.where(self.left[at] < 0, at, self.left[at] + go)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 5, ridge: float = 1.0, n_bins: int = 64) -> "Trees":
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        p = (y.sum() + 1) / (len(y) + 2)
        feature, limit, left, value, roots = [], [], [], [], []
        self = Trees(float(np.log(p / (1 - p))), edges, *[np.zeros(0)] * 5, depth)
        b = self.bins(x) if len(x) else np.zeros((0, x.shape[1]), np.int16)
        total, wide = np.full(len(y), self.base), n_bins + 1
        offset = np.arange(x.shape[1]) * wide

        def node() -> int:
            for col, v in ((feature, 0), (limit, 0), (left, -1), (value, 0.0)):
                col.append(v)
            return len(value) - 1

        for _ in range(trees if 0 < y.sum() < len(y) else 0):
            q = 1 / (1 + np.exp(-total))
            grad, hess = q - y, q * (1 - q)
            roots.append(node())
            level = [(roots[-1], np.arange(len(y)), depth)]
            while level:
                at, rows, deep = level.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                value[at] = -rate * g / (h + ridge)
                split = None
                if deep and len(rows) >= 2 * least:
                    flat = (b[rows] + offset).ravel()
                    size = wide * x.shape[1]
                    gs, hs, ns = (np.bincount(flat, w, size).reshape(-1, wide).cumsum(1) for w in (np.repeat(grad[rows], x.shape[1]), np.repeat(hess[rows], x.shape[1]), None))
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    k = int(gain.argmax())
                    if gain.ravel()[k] > 1e-6:
                        split = divmod(k, wide)
                if split:
                    feature[at], limit[at] = split
                    go = b[rows, split[0]] > split[1]
                    left[at] = node()
                    node()
                    level += [(left[at], rows[~go], deep - 1), (left[at] + 1, rows[go], deep - 1)]
                else:
                    total[rows] += value[at]
        self.feature, self.limit, self.left = np.array(feature, np.int64), np.array(limit, np.int64), np.array(left, np.int64)
        self.value, self.roots = np.array(value), roots
        return self


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """stats must hold only rows that may be learned from."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    rows = stats.join(marks, "doc_id").select(F.xxhash64("doc_id").alias("h"), F.col("y").cast("double"), *[F.col(c).cast("double") for c in STATS])
    kinds, taken = [], 0
    for kind, n in sorted(rows.groupBy(F.pmod("h", F.lit(4096)).alias("kind")).count().collect()):
        if taken + n <= max_rows:
            taken, kinds = taken + n, [*kinds, kind]
    some = rows if len(kinds) == 4096 else rows.where(F.array_contains(F.lit(kinds), F.pmod("h", F.lit(4096)))) if kinds else rows.limit(0)
    data = np.stack([c.to_numpy().astype(float) for c in some.toArrow().columns], axis=1)
    data = data[np.lexsort(data.T[::-1])]
    return Trees.fit(features(data[:, 2:]), data[:, 1])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, held: int = 2, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = materialize(quality_stats(docs).withColumn("held_out", remainder("doc_id", modulus) == held), "stats")
    model = stats.sparkSession.sparkContext.broadcast(fit(stats.where("not held_out"), labels, max_rows))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            raw = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], axis=1) if b.num_rows else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.value.score(features(raw)))], names=schema.fieldNames())

    scored = stats.select("doc_id", "held_out", *STATS).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are predicted good, with their columns, whatever their names.

    Rows are matched by doc_id; an id that repeats stays if any of its rows is good.
    """
    (keep,) = spare_names(docs.columns, "keep")
    good = quality_scores(docs, labels, **options).where("predicted = 1").select(F.col("doc_id").alias(keep))
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi")
