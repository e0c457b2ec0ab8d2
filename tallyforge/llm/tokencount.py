"""Operator 7, token counts: a digest cache of counts.

The key is the SHA-256 digest of the content and of the tokenizer's file. Content is
normalised only as far as provably keeps every count: null becomes empty. Documents are
joined to the cache; only distinct misses are encoded, and appended to the cache (a folder
of Parquet files that all executors share). Copies, however many, are encoded once.
Null text counts as empty. Repeated rows each get a row. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, new_path
from .pieces import encoder

CACHE = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """digest, n_tokens of rows digest, text."""

    def run(batches):
        enc = encoder(tokenizer, "word")
        for batch in batches:
            words = [t or "" for t in batch.column(1).to_pylist()]
            n = [c for a, b in by_bytes(words) for c in enc.counts(words[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; cache: the cache's folder (a new one if None).

    The text is read twice; of each missing digest one row (the least id) is chosen to carry
    its text to the encoder. Texts move at most once, to where the chosen rows are joined.
    """
    spark = docs.sparkSession
    version, cache = version_of(tokenizer), cache or new_path(spark, "token-cache")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = materialize(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    try:
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    # One document of each missing digest encodes it; repeated ids with other texts have other digests.
    chosen = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti")
    picked = chosen.select(F.xxhash64("doc_id", "digest").alias("pick"), F.col("digest").alias("need"))
    # As many rows as there are distinct texts: never to be broadcast, at any size.
    misses = keyed.withColumn("pick", F.xxhash64("doc_id", "digest")).hint("merge").join(picked, "pick", "left_semi").select("digest", "text")
    encode_counts(misses, tokenizer).select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = materialize(counts, "counts")  # a plain scan on either side lets Spark split a hot digest
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
