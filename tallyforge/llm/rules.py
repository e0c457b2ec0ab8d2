"""Operator 9, quality rules: learned decision lists, in DataFrame operations only.

Sequential covering over labelled statistics: a rule is a conjunction of threshold tests
that points at low quality. It is grown test by test on two thirds of the labelled rows
(hash split), each step by one aggregation over binned statistics, and pruned on the other
third: trailing tests go while precision there doesn't fall. A rule is accepted if its
precision on the pruning rows is high; the rows it covers are removed and the next rule is
learned. The list becomes one ordered CASE expression. Only counts of (statistic, bin,
label), at most 32 bins for each statistic, reach the driver.

Without labels, or without a rule that is good enough, the list is empty and keeps all.
Null text has no words. Empty texts fail the base rules. Repeated rows each get a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .docstats import rule_stats

#: Ratios the rules may test: name -> SQL over the statistics.
RATIOS = {
    "symbols_per_100_chars": "100.0 * n_symbols / greatest(word_chars, 1)",
    "bars_per_100_words": "100.0 * n_bars / greatest(n_words, 1)",
    "repeat_words_percent": "100.0 * n_repeat_words / greatest(n_words, 1)",
    "dup_lines_percent": "100.0 * n_dup_lines / greatest(n_lines, 1)",
    "distinct_words_percent": "100.0 * n_distinct_words / greatest(n_words, 1)",
    "upper_percent": "100.0 * n_upper / greatest(word_chars, 1)",
    "digits_percent": "100.0 * n_digits / greatest(word_chars, 1)",
    "shouts_per_100_words": "100.0 * n_shouts / greatest(n_words, 1)",
    "stops_per_100_words": "100.0 * n_stops / greatest(n_words, 1)",
    "chars_per_word": "1.0 * word_chars / greatest(n_words, 1)",
    "words": "1.0 * n_words",
}
BINS = 32


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def sql(self) -> str:
        return f"({RATIOS[self.name]}) {'>=' if self.above else '<'} {self.limit!r}D"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.tests)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered expression: number of the first rule that rejects, else null."""
    out = F.lit(None).cast("int")
    if rules:
        out = F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules)) + " END").cast("int")
    return out


def learn(labelled: DataFrame, max_rules: int = 8, max_tests: int = 3, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Learns a list from rows of statistics with bad (1: low quality) and doc_id."""
    names = list(RATIOS)
    rows = labelled.select("doc_id", "bad", *[F.expr(v).cast("double").alias(k) for k, v in RATIOS.items()]).withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    rows = materialize(rows, "labelled")
    # Thresholds: quantiles over the bad rows and over all, so that rare junk has its own bins.
    points = [i / (BINS // 2) for i in range(1, BINS // 2)]
    q = rows.agg(*[F.percentile_approx(k, points, 2000).alias(k) for k in names], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(k)), points, 2000).alias(f"{k}_bad") for k in names]).first()
    limits = {k: sorted({float(x) for x in [*(q[k] or []), *(q[f"{k}_bad"] or [])]}) for k in names}
    if not any(limits.values()):
        return []
    binned = rows.select("doc_id", "bad", "prune", *[_bin(F.col(k), limits[k]).alias(k) for k in names])
    binned = materialize(binned, "binned")
    rules: list[Rule] = []
    left = binned
    for _ in range(max_rules):
        tests: list[Test] = []
        grown = []
        cover = left.where("not prune")
        best = 0.0
        for _ in range(max_tests):
            table = _table(cover, names)
            test, score, pure = _best(table, limits, least)
            if test is None or score <= best:
                break
            tests.append(test)
            best = score
            cover = cover.where(_on_bins(test, limits))
            grown.append(pure)
            if pure >= 0.9999:
                break
        if not tests:
            break
        tests, good, n = _prune(left.where("prune"), tests, limits)
        if good < precision or n < 1:
            break
        rules.append(Rule(tuple(tests), good, n))
        hit = F.lit(True)
        for t in tests:
            hit = hit & _on_bins(t, limits)
        left = materialize(left.where(~hit), "uncovered")
    return rules


def _bin(value: Column, limits: list[float]) -> Column:
    """How many limits are at most value."""
    return F.aggregate(F.array(*[F.lit(x) for x in limits]), F.lit(0), lambda a, x: a + (value >= x).cast("int")) if limits else F.lit(0)


def _on_bins(test: Test, limits: dict[str, list[float]]) -> Column:
    k = limits[test.name].index(test.limit) + 1
    return F.col(test.name) >= k if test.above else F.col(test.name) < k


def _table(rows: DataFrame, names: list[str]) -> dict:
    """{(name, bin): [good, bad]} in one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("bin")) for k in names])).alias("p")
    out: dict = {}
    for r in rows.select("bad", pairs).groupBy("p.name", "p.bin").agg(F.count_if(F.col("bad") == 0).alias("good"), F.count_if(F.col("bad") == 1).alias("bad")).collect():
        out[r["name"], r["bin"]] = (r["good"], r["bad"])
    return out


def _best(table: dict, limits: dict[str, list[float]], least: int) -> tuple[Test | None, float, float]:
    """The test with the best m-estimate of precision, weighed by what it still covers."""
    best: tuple[Test | None, float, float] = (None, 0.0, 0.0)
    for name, points in limits.items():
        n = len(points) + 1
        good = [table.get((name, b), (0, 0))[0] for b in range(n)]
        bad = [table.get((name, b), (0, 0))[1] for b in range(n)]
        total = sum(good) + sum(bad)
        if not total:
            continue
        prior = sum(bad) / total
        for k in range(1, n):
            for above in (True, False):
                g, b = (sum(good[k:]), sum(bad[k:])) if above else (sum(good[:k]), sum(bad[:k]))
                if b < least:
                    continue
                pure = (b + 2 * prior) / (g + b + 2)
                score = pure * pure * pure * (b / max(sum(bad), 1)) ** 0.25
                if score > best[1] + 1e-12:
                    best = (Test(name, above, points[k - 1]), score, b / (g + b))
    return best


def _prune(rows: DataFrame, tests: list[Test], limits: dict[str, list[float]]) -> tuple[list[Test], float, int]:
    """Drops trailing tests while precision on the pruning rows doesn't fall."""
    hits, hit = [], F.lit(True)
    for t in tests:
        hit = hit & _on_bins(t, limits)
        hits.append(hit)
    r = rows.agg(*[F.count_if(h & (F.col("bad") == 1)).alias(f"b{i}") for i, h in enumerate(hits)], *[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hits)]).first()
    scores = [(r[f"b{i}"] / r[f"n{i}"] if r[f"n{i}"] else 0.0) for i in range(len(tests))]
    k = len(tests) - 1
    while k > 0 and scores[k - 1] >= scores[k]:
        k -= 1
    return tests[: k + 1], scores[k], int(r[f"b{k}"])


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (number of the rule that rejects, or null), kept."""
    stats = materialize(rule_stats(docs), "stats")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    rules = learn(stats.join(marks, "doc_id"), **options)
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return stats.withColumn("base_failed", base).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
