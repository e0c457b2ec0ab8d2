"""Operator 4, exact dedup by content-defined chunk recipes.

Texts are normalised ([\\x20\\x09-\\x0D]+ becomes one space; null is empty) and cut into chunks at
places that a rolling hash of the last 32 bytes chooses. A document's recipe is the ordered
list of its chunks (about 0.8 % of its size), so long texts never move. All chunks are
reduced to a table of distinct ones, each with a number as its identifier. Identifiers are
verified: chunks count as one only if a digest, an independent checksum and the length agree,
so a digest that stands for two contents gets two identifiers. Texts are equal if their lists
of identifiers (and lengths) are; the SHA-256 digest of the whole text is only returned.

Of equal texts the row with the smallest doc_id stays (null ids come last); of rows that
repeat this doc_id too, exactly one. Empty texts are equal to each other. An empty table
gives no rows. Other columns are ignored, and kept,
whatever their names, by drop_exact_copies.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, materialize, spare_names

WINDOW, SLICE = 32, 1 << 22
GEAR = np.array([random.Random(f"gear-{i}").getrandbits(32) for i in range(256)], np.uint32)


def boundaries(buf: np.ndarray, bits: int) -> np.ndarray:
    """Positions after which the hash of the last 32 bytes has `bits` zero low bits."""
    found = []
    for a in range(0, len(buf), SLICE):
        lead = min(a, WINDOW - 1)
        h = GEAR[buf[a - lead : a + SLICE]]
        step = 1
        while step < WINDOW:
            if len(h) > step:
                h[step:] += h[:-step] << np.uint32(step)  # the right side is a copy: no overlap
            step *= 2
        # the low bits of a sum with shifts hold the last bytes alone: take high bits
        found.append(np.flatnonzero((h[lead:] >> np.uint32(32 - bits)) == 0) + a)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(marks: np.ndarray, size: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text of `size` bytes, from the hash's positions in it."""
    ends, start = [], 0
    for end in [*(marks + 1).tolist(), size]:
        while end - start > most:
            start += most
            ends.append(start)
        if end - start >= least and end < size:
            ends.append(end)
            start = end
    if start < size:
        ends.append(size)
    return ends


RECIPE = T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("check", T.LongType()), T.StructField("size", T.IntegerType())]))


def recipes(docs: DataFrame, bits: int = 11, least: int = 256, most: int = 16384, digest_bytes: int = 16) -> DataFrame:
    """doc_id, text_sha256, n_bytes and recipe (digest, check, size of each chunk in order)."""
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]" + SPACE[:-1] + r"*|\x20" + SPACE, " ")
    rows = docs.select("doc_id", norm.alias("text")).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_sha256", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("recipe", RECIPE)])

    def run(batches):
        chunk = pa.struct([("digest", pa.binary()), ("check", pa.int64()), ("size", pa.int32())])
        for batch in batches:
            col = batch.column(2)
            wide = pa.types.is_large_binary(col.type)
            _, offsets, data = col.buffers()
            offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
            offs = offs - offs[0]
            marks, view = boundaries(buf, bits), memoryview(buf)
            # marks of the first 32 bytes of a text depend on the text before it; `least` skips them
            lo, hi = np.searchsorted(marks, offs[:-1]), np.searchsorted(marks, offs[1:])
            counts, digests, checks, sizes = [0], [], [], []
            for i in range(len(col)):
                at, start = int(offs[i]), 0
                for end in cuts(marks[lo[i] : hi[i]] - at, int(offs[i + 1]) - at, max(least, WINDOW), most):
                    part = view[at + start : at + end]
                    digests.append(hashlib.blake2b(part, digest_size=digest_bytes).digest())
                    checks.append(xxhash.xxh64_intdigest(part) - (1 << 63))
                    sizes.append(end - start)
                    start = end
                counts.append(len(digests))
            items = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int32())], fields=list(chunk))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def chunk_table(table: DataFrame) -> DataFrame:
    """digest, check, size, id: the distinct chunks of all recipes, each with its identifier."""
    chunks = table.select(F.explode("recipe").alias("c")).select("c.digest", "c.check", "c.size")
    return materialize(chunks.distinct().withColumn("id", F.monotonically_increasing_id()), "chunks")


def identified(table: DataFrame) -> DataFrame:
    """Replaces recipe by ids, the ordered list of verified identifiers."""
    found = chunk_table(table)
    placed = table.select("rid", F.posexplode("recipe").alias("i", "c")).select("rid", "i", "c.digest", "c.check", "c.size")
    lists = placed.join(found, ["digest", "check", "size"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("ids"))
    whole = table.drop("recipe").join(lists, "rid", "left")
    return whole.withColumn("ids", F.coalesce(F.transform("ids", lambda c: c["id"]), F.array().cast("array<bigint>")))


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row."""
    table = materialize(recipes(docs, **options).withColumn("rid", F.monotonically_increasing_id()), "recipes")
    rows = materialize(identified(table), "identified")
    groups = rows.groupBy("n_bytes", "ids").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    joined = rows.join(groups, ["n_bytes", "ids"]).select("rid", "gid", "doc_id", "keep_id", "group_size", "text_sha256", F.size("ids").alias("n_chunks"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        kept = same
    else:
        # Of rows that repeat the least id, the one with the least row number stays.
        first = joined.where(same).groupBy("gid").agg(F.min("rid").alias("stays"))
        joined = joined.join(first, "gid", "left")
        kept = F.coalesce(F.col("rid") == F.col("stays"), F.lit(False))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_chunks")


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    keep, kept_sha, many, n, sha = spare_names(docs.columns, "keep", "kept_sha", "many", "n", "sha")
    kept = exact_dedup(docs, **options).where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(kept_sha))
    same = F.col("doc_id").eqNullSafe(F.col(keep))
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col("doc_id").alias(many))
    if repeats.isEmpty():
        return docs.join(kept, same, "left_semi")
    # Rows that repeat an id are told apart by their text; of equal ones, one stays.
    hit = F.col("doc_id").eqNullSafe(F.col(many))
    once = docs.join(repeats, hit, "left_anti").join(kept, same, "left_semi")
    twice = docs.join(repeats, hit, "left_semi").withColumn(sha, F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), 256))
    twice = twice.join(kept, same & (F.col(sha) == F.col(kept_sha)), "left_semi").dropDuplicates(["doc_id", sha])
    return once.unionByName(twice.select(*docs.columns))
