"""Statistics of documents as DataFrame expressions; shared by the quality classifier and the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _long(x: Column) -> Column:
    return x.cast("long")


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of text are among chars (translate() takes some ten times as long)."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: how many of the words w stand in a 3-word window that occurs twice or more.

    Windows are compared by 64-bit hashes. Most texts have no repeat, which a hash set
    shows at once; otherwise (hash, place) pairs are sorted, windows next to an equal one
    are marked, and the words under marked windows counted: n log n for any text.
    """
    h, g, s, p = (F.col(f"_{x}") for x in "hgsp")
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    df = once(df, _h=F.transform("w", lambda x: F.xxhash64(x)))
    df = once(df, _g=F.when(F.size("w") > 3, window).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = once(df, _s=F.when(F.size(F.array_distinct(g)) < F.size(g), pairs))
    near = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
    df = once(df, _p=F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(near(x, k), F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    # Each window adds its words up to the next window's start, at most 3.
    gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
    total = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return df.withColumn("n_repeat_words", _long(total)).drop("_h", "_g", "_s", "_p")


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules and the contract of the rules' query use."""
    text = F.coalesce("text", F.lit(""))
    base = once(docs.select("doc_id", text.alias("t")), w=words_of(F.col("t")), l=F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    return with_repeats(base).select(
        "doc_id",
        _long(F.size("w")).alias("n_words"),
        _long(F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        _long(_count_of(F.col("t"), SYMBOLS)).alias("n_symbols"),
        _long(F.size("l")).alias("n_lines"),
        _long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        "n_repeat_words",
        _long(F.size(F.array_distinct("w"))).alias("n_distinct_words"),
        *_plain(F.col("t")),
    )


def _plain(t: Column) -> list[Column]:
    return [
        _long(_count_of(t, "A-ZÀ-ÖØ-Þ")).alias("n_upper"),
        _long(_count_of(t, "0-9")).alias("n_digits"),
        _long(_count_of(t, "!?")).alias("n_shouts"),
        _long(_count_of(t, "|")).alias("n_bars"),
        _long(_count_of(t, ".,;:")).alias("n_stops"),
        _long(F.length(t)).alias("n_chars_all"),
    ]


def quality_stats(docs: DataFrame) -> DataFrame:
    """doc_id and counts for the classifier; no window counts, so a text is scanned a few times only."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("t")).withColumn("w", words_of(F.col("t")))
    return base.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))).select(
        "doc_id",
        _long(F.size("w")).alias("n_words"),
        _long(F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        _long(_count_of(F.col("t"), SYMBOLS)).alias("n_symbols"),
        _long(F.size("l")).alias("n_lines"),
        _long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        _long(F.size(F.array_distinct("w"))).alias("n_distinct_words"),
        *_plain(F.col("t")),
    )
