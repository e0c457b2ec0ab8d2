"""Helpers shared by the corpus operators: the shared folder, materialised tables, splits."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one if all run in one process, else an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """While it lasts, tables that are written pass Python in batches of so many rows and bytes at most: for rows that hold long arrays."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def forget(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(root):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Has the driver collect garbage: Spark then deletes the shuffle files of queries that have ended."""
    spark.sparkContext._jvm.System.gc()


def spare_names(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes to clash with none of taken (case aside)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def likely_in(df: DataFrame, key: str, keys: DataFrame, words: int = 1 << 18) -> DataFrame:
    """The rows of df whose key is in the column `key` of keys, and a few others.

    A filter before a join, so that rows that can't match aren't shuffled. What is broadcast
    has `words` rows at most, 64 bits each, at any size of keys.
    """
    word, bit, mask = spare_names(df.columns, "word", "bit", "mask")
    h = lambda: F.xxhash64(key)
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h(), 58).cast("int"))
    masks = keys.select(h().bitwiseAND(F.lit(words - 1)).alias(word), own.alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(mask))
    rows = df.withColumn(word, h().bitwiseAND(F.lit(words - 1))).withColumn(bit, own).join(F.broadcast(masks), word)
    return rows.where(F.col(mask).bitwiseAND(F.col(bit)) != 0).drop(word, bit, mask)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once for a row.

    A projection would be merged into the expressions that use it, and an array used inside a
    lambda would then be made anew for every element; a one-row generator keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def by_bytes(texts: list, limit: int = 4 << 20):
    """(from, to) ranges of a list of strings, each of at most limit characters, or of one string."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
