"""Operator 3, best-fit packing: Martello-Toth dominance reduction, then best-fit decreasing.

Piece lengths are whole numbers of at most `capacity`, so an instance of any size is a
histogram of at most `capacity` counts. The driver sees only that histogram; it fixes
dominating sets in bulk, best-fits the rest and returns runs ("items of length s with ranks
a..b go to sequences x.. at offset o"). Items get their ranks on the executors, salted, so
that one very common length doesn't land in one task.

Nulls and empty texts are documents of the end id alone. Documents with the same id are
packed each. An empty table gives an empty layout. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, materialize, spare_names
from .pieces import encoder

CAPACITY = 2048


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones last, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        enc, end = encoder(tokenizer, "byte"), int(end_id).to_bytes(4, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_bytes(texts):
                rows, cols = [], ([], [], [], [])
                for i, ids in enumerate(enc.ids(texts[a:b]), a):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append(i)
                        for col, v in zip(cols, (k, start, length, ids[4 * start : 4 * (start + length)])):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Plan:
    """Packs a histogram {length: count}; runs: (length, first rank, count, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.cap = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for s, n in histogram.items():
            if not 0 < s <= capacity:
                raise ValueError(f"length {s} is not in 1..{capacity}")
            self.count[s] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, s: int, m: int, seq: int, offset: int) -> None:
        self.runs.append((s, int(self.used[s]), m, seq, offset))
        self.used[s] += m
        self.count[s] -= m

    def _open(self, sizes: list[int], m: int) -> int:
        """m new sequences, each with an item of every length in sizes."""
        seq, offset = self.sequences, 0
        self.sequences += m
        for s in sizes:
            self._place(s, m, seq, offset)
            offset += s
        return seq

    def _smallest(self, n: int, without: int) -> list[int]:
        """The n smallest items left when one item of length `without` is taken."""
        out: list[int] = []
        for s in np.flatnonzero(self.count)[: n + 1]:
            out += [int(s)] * min(n, int(self.count[s]) - (s == without))
        return out[:n]

    def _best_pair(self, room: int, without: int) -> int:
        """Largest sum of at most room that two items left reach, or 0."""
        left = self.count.copy()
        left[without] -= 1
        have = np.flatnonzero(left)
        have = have[have <= room]
        if not len(have):
            return 0
        at = np.searchsorted(have, room - have, "right") - 1
        same = (at >= 0) & (have[np.maximum(at, 0)] == have) & (left[have] < 2)
        at = at - same
        good = at >= 0
        return int((have[good] + have[at[good]]).max()) if good.any() else 0

    def _reduce(self) -> None:
        """From the longest item down, fixes a set if it dominates every other feasible set with that item.

        It does so if nothing else fits; if one item fills the rest exactly; if no two others
        fit together; or if no three do and no two that fit together exceed the best single.
        """
        for s in range(self.cap, 0, -1):
            while self.count[s] > 0:
                room = self.cap - s
                fits = np.flatnonzero(self.count[: room + 1])
                if len(fits) and fits[-1] == s and self.count[s] < 2:
                    fits = fits[:-1]
                if not len(fits):
                    self.fixed += int(self.count[s])
                    self._open([s], int(self.count[s]))
                    break
                best = int(fits[-1])
                low = self._smallest(3, s)
                if not (best == room or len(low) < 2 or low[0] + low[1] > room or ((len(low) < 3 or sum(low) > room) and self._best_pair(room, s) <= best)):
                    break
                m = int(self.count[s] // 2 if best == s else min(self.count[s], self.count[best]))
                self.fixed += m
                self._open([s, best], m)

    def _best_fit(self) -> None:
        """Best-fit decreasing over classes of sequences with equal room, whole classes at a time."""
        room: list[int] = []  # sorted
        bins: dict[int, list[tuple[int, int]]] = {}

        def keep(r: int, seq: int, n: int) -> None:
            if r and n:
                if r not in bins:
                    bins[r] = []
                    insort(room, r)
                bins[r].append((seq, n))

        for s in range(self.cap, 0, -1):
            while (left := int(self.count[s])) > 0:
                i = bisect_left(room, s)
                if i < len(room):
                    r = room[i]
                    seq, n = bins[r].pop()
                    m = min(n, left)
                    self._place(s, m, seq, self.cap - r)
                    if n > m:
                        bins[r].append((seq + m, n - m))
                    elif not bins[r]:
                        del bins[r], room[i]
                    keep(r - s, seq, m)
                    continue
                each = self.cap // s
                if left >= each:
                    keep(self.cap - each * s, self._open([s] * each, left // each), left // each)
                if rest := left % each:
                    keep(self.cap - rest * s, self._open([s] * rest, 1), 1)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length << 40 | first rank), first ranks, first sequences, offsets."""
        r = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (r[:, 0] << 40) | r[:, 1], r[:, 1], r[:, 3], r[:, 4]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_a_salt: int = 1 << 20, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column length (1..capacity); equal lengths are numbered in parts of about rows_a_salt rows."""
    spark, names = pieces.sparkSession, pieces.columns
    rows = materialize(pieces, "pieces")
    salt, n, base, rn, rank = spare_names(names, "salt", "n", "base", "rn", "rank")
    salts = max(64, rows.count() // rows_a_salt)
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)))
    sums = rows.groupBy("length", salt).agg(F.count("*").alias(n))
    plan = Plan({int(r["length"]): int(r["n"]) for r in sums.groupBy("length").agg(F.sum(n).alias("n")).collect()}, capacity)
    ahead = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", salt, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(base))
    own = Window.partitionBy("length", salt).orderBy(*order)
    ranked = rows.withColumn(rn, F.row_number().over(own)).join(before, ["length", salt]).withColumn(rank, F.col(base) + F.col(rn) - 1).select(*names, rank)
    shared = spark.sparkContext.broadcast(plan.arrays())
    at = names.index("length")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        keys, first, seqs, offsets = shared.value
        for b in batches:
            rank = b.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            size = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            i = np.searchsorted(keys, (size << 40) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seqs[i] + rank - first[i]), pa.array(offsets[i])], names=schema.fieldNames())

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of every packed sequence (pieces must carry ids); a group has at most capacity ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", joined.alias("ids"))
