"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, langid, linededup, lm, mixing, packing, quality, rules, simhash, tokencount
from .common import table

#: Weights of the mixture: domains, then languages inside any domain; sources count alike.
WEIGHTS = {"web": 5, "books": 3, "code": 2, "*/en": 4, "*/de": 2, "*/fr": 2, "*/es": 2}
BUDGET, EPOCHS, SEED = (7, 10), 2, 7


def domain() -> Column:
    """The domain of a source: src0 is web, sources with odd numbers are books, the rest code."""
    return F.when(F.col("source") == "src0", "web").when(F.col("source").rlike("[13579]$"), "books").otherwise("code")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), domain(), WEIGHTS, BUDGET, EPOCHS, SEED)
    return found.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("tokens"), F.col("_budget").alias("budget"))


def mixing_sql(share: tuple[int, int] = BUDGET, epochs: int = EPOCHS) -> str:
    """The same budgets and prefixes for DuckDB, written as the definition: plain running sums over rows."""
    dom = "CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '[13579]$') THEN 'books' ELSE 'code' END"
    case = lambda col, level: "CASE " + col + "".join(f" WHEN '{k.split('/')[-1]}' THEN {v}" for k, v in WEIGHTS.items() if k.count("/") == level) + " ELSE 1 END"

    def fill(name: str, src: str, keys: str, parent: str, cap: str, budget: str, weight: str, out: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_a AS (SELECT *, {weight}::HUGEINT AS w FROM {src}),
{name}_b AS (SELECT *, coalesce(sum({cap}) OVER ({part} ORDER BY {cap}::DOUBLE / w, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS bef, (sum(w) OVER ({part} ORDER BY {cap}::DOUBLE / w, {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS rest FROM {name}_a),
{name}_c AS (SELECT *, {cap} * rest <= greatest({budget} - bef, 0) * w AS filled FROM {name}_b),
{name}_d AS (SELECT *, coalesce(sum(CASE WHEN filled THEN {cap} END) OVER ({part}), 0)::HUGEINT AS spent, (sum(CASE WHEN NOT filled THEN w END) OVER ({part}))::HUGEINT AS opened FROM {name}_c),
{name} AS (SELECT * EXCLUDE (w, bef, rest, filled, spent, opened), CASE WHEN filled THEN {cap} ELSE (greatest({budget} - spent, 0) * w) // opened END AS {out} FROM {name}_d)"""

    words = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
    return f"""
WITH docs AS (SELECT doc_id, {dom} AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source, coalesce({words}, 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * {epochs})::HUGEINT AS cap FROM docs GROUP BY ALL),
one AS (SELECT domain, sum(cap)::HUGEINT AS cap1, (sum(sum(tokens)) OVER ())::HUGEINT * {share[0]} // {share[1]} AS budget0 FROM leaves GROUP BY domain),
{fill("top", "one", "domain", "", "cap1", "budget0", case("domain", 0), "budget1")},
two AS (SELECT l.domain, l.lang, sum(l.cap)::HUGEINT AS cap2, any_value(t.budget1)::HUGEINT AS budget1 FROM leaves l JOIN top t USING (domain) GROUP BY l.domain, l.lang),
{fill("mid", "two", "domain, lang", "domain", "cap2", "budget1", case("lang", 1), "budget2")},
three AS (SELECT l.*, m.budget2 FROM leaves l JOIN mid m USING (domain, lang)),
{fill("low", "three", "domain, lang, source", "domain, lang", "cap", "budget2", "1", "budget")},
epochs AS (SELECT d.*, l.budget, e.epoch, l.tokens AS leaf FROM docs d JOIN low l USING (domain, lang, source), (SELECT unnest(range({epochs}))::INT AS epoch) e),
ranked AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}:' || epoch || ':' || doc_id) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + epoch * leaf AS upto FROM epochs)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens::BIGINT AS tokens, budget::BIGINT AS budget FROM ranked WHERE upto <= budget AND budget > 0
"""


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_line_dedup, op3_best_fit_packing, op4_exact_dedup, op5_quality_classifier, op6_lm_scoring, op7_token_counts, op8_simhash_near_dedup, op9_quality_rules, op10_mixing]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": EXACT_SQL, "op10_mixing": mixing_sql()}
