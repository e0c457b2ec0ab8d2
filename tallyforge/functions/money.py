"""Amount, fee and debited total of a receipt, with confidence, source and candidates.

Labels of all families are found in one scan, so a longer label hides the shorter ones in it.
Labels that touch with no money between them are a block: as many values in a row, later in
the text, are theirs by place. Fees and debited totals are never the amount.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .spans import cleaned, let, once, spans, starting

MONEY = starting("0123456789", r"(?<![0-9.,\-/])(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,9})\.[0-9]{2}(?![0-9\-/])")
_FAMILIES = {"debit": vocab.TOTAL_DEBIT, "total_fee": vocab.TOTAL_FEE, "fee": vocab.FEE, "strong": vocab.AMOUNT, "weak": ["Amount"]}
_KINDS = {re.sub("[^a-z]", "", n.lower()): kind for kind, names in reversed(_FAMILIES.items()) for n in names}
LABELS = vocab.labels([n for names in _FAMILIES.values() for n in names])
CURRENCY = "(?i:" + starting("RM", r"\b(?:RM|MYR)\b") + ")"
CANDIDATES = "array<struct<value:decimal(11,2),score:int,source:string,s:int>>"


def money_value(v: Column) -> Column:
    return F.regexp_replace(v, ",", "").cast("decimal(11,2)")


def is_money(v: Column) -> Column:
    """Two decimals and nine digits before them at most, with correct groups if any."""
    return v.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3}){0,2}|[0-9]{1,9})\.[0-9]{2}$")


def is_fragment(t: Column, m: Column) -> Column:
    """Money that is a part of a longer number: digits joined by single blanks in more than two groups."""
    left = F.regexp_extract(F.substring(t, F.greatest(m["s"] - 39, F.lit(1)), F.least(m["s"], F.lit(40))), r"((?<![0-9.,])(?:[0-9]+ )+)$", 1)
    right = F.regexp_extract(F.substring(t, m["e"] + 1, F.lit(40)), r"^((?: [0-9]+(?![0-9.,]))+)", 1)
    return F.regexp_count(F.concat(left, right), F.lit("[0-9]+")) > 1


def _found(kind: str, m: Column, score: int, source: str) -> Column:
    return F.struct(money_value(m["v"]).alias("value"), F.lit(score).alias("score"), F.lit(source).alias("source"), m["s"].alias("s"), m["e"].alias("e"), F.lit(kind).alias("kind"))


def _runs(labels: Column, money: Column) -> Column:
    """The number of each label's run: labels that touch with no money between."""
    start = F.struct(F.lit(-1).alias("e"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.exists(money, lambda m: (m["s"] >= acc["e"]) & (m["e"] <= x["s"]))
        run = F.when((acc["e"] >= 0) & (x["s"] - acc["e"] <= vocab.RUN_GAP) & ~between, acc["run"]).otherwise(acc["run"] + 1)
        return F.struct(x["e"].alias("e"), run.alias("run"), F.concat(acc["out"], F.array(run)).alias("out"))

    return F.aggregate(labels, start, step, lambda acc: acc["out"])


def _blocks(labels: Column, money: Column, runs: Column) -> Column:
    """(s, m): labels of runs, and the money that is theirs by place."""
    def zipped(m: Column) -> Column:
        end = F.element_at(m, -1)["e"]
        row = F.slice(F.filter(money, lambda x: (x["s"] >= end) & (x["e"] <= end + vocab.CHAIN)), F.lit(1), F.size(m))

        def dealt(row: Column) -> Column:
            loose = F.exists(F.transform(row, lambda x, i: (i > 0) & (x["s"] - F.get(row, i - 1)["e"] > vocab.CHAIN_GAP)), lambda b: b)
            whole = (F.size(row) == F.size(m)) & ~loose & ~F.exists(row, lambda x: x["bad"])
            return F.transform(F.when(whole, m).otherwise(F.slice(m, 1, 0)), lambda x, i: F.struct(x["s"].alias("s"), F.get(row, i).alias("m")))

        return let(row, dealt)

    return F.when(F.size(labels) > 1, F.flatten(F.transform(F.filter(F.transform(F.array_distinct(runs), lambda r: F.filter(labels, lambda x, i: F.get(runs, i) == r)), lambda m: F.size(m) >= 2), zipped)))


def _confidence(score: Column, ocr: Column) -> Column:
    x = score.cast("decimal(7,4)") / 100
    return F.when(score.isNotNull(), F.least(F.when(ocr, x * F.lit("0.93").cast("decimal(3,2)")).otherwise(x), F.lit("0.99").cast("decimal(3,2)"))).cast("decimal(4,3)")


def with_money(df: DataFrame, ocr: Column | None = None) -> DataFrame:
    """Adds amount, fee and total_debit, each with _confidence, _source; and amount_candidates, the best ten first."""
    ocr = F.lit(False) if ocr is None else ocr
    t, s = F.col("t"), vocab.SCORE
    df = cleaned(df)
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    kind = lambda x: F.element_at(kinds, F.regexp_replace(F.lower(x["v"]), "[^a-z]", ""))
    money = F.transform(spans(t, MONEY), lambda m: F.struct(m["v"], m["s"], m["e"], is_fragment(t, m).alias("bad")))
    labels = F.transform(spans(t, LABELS), lambda x: F.struct(x["s"], x["e"], kind(x).alias("kind")))
    df = once(df, _money=money, _labels=labels, _cur=spans(t, CURRENCY))
    df = once(df, _good=F.filter("_money", lambda m: ~m["bad"]), _runs=_runs(F.col("_labels"), F.col("_money")))
    df = once(df, _block=_blocks(F.col("_labels"), F.col("_money"), F.col("_runs")))

    def by_label(x: Column, i: Column) -> Column:
        own = F.get(F.filter("_block", lambda b: b["s"] == x["s"]), F.lit(0))["m"]
        width = F.when(x["kind"].isin("fee", "total_fee"), vocab.AFTER_FEE).otherwise(vocab.AFTER)
        until = F.least(x["e"] + width, F.coalesce(F.get("_labels", i + 1)["s"], F.lit(1 << 30)))
        nearest = let(until, lambda u: F.get(F.filter("_good", lambda m: (m["s"] >= x["e"]) & (m["s"] < u)), F.lit(0)))
        # A weak label may stand below its value: on its own line or the one above, before a currency.
        before = F.substring(t, F.greatest(x["s"] - vocab.ABOVE + 1, F.lit(1)), F.least(x["s"], F.lit(vocab.ABOVE)))
        reach = x["s"] - F.length(F.substring_index(before, "\n", -2))
        floor = F.greatest(reach, F.coalesce(F.get("_labels", i - 1)["e"], F.lit(0)))
        near = lambda m: F.substring(F.substring_index(F.substring(t, m["e"] + 1, F.lit(vocab.CURRENCY_NEAR)), "\n", 1), 1, vocab.CURRENCY_NEAR).rlike(r"(?i)\b(?:RM|MYR)\b") | F.substring(t, F.greatest(m["s"] - 4, F.lit(1)), F.lit(5)).rlike("RM|MYR")
        last = let(floor, lambda f: let(F.filter("_good", lambda m: (m["s"] >= f) & (m["e"] <= x["s"])), lambda ms: F.get(ms, F.size(ms) - 1)))
        above = let(last, lambda m: F.when(m.isNotNull() & near(m), _found("amount", m, s["above"], "label:weak:above")))

        def told(p: Column) -> Column:
            block, after = p["block"], p["after"]
            of = lambda fam, b, d, name, way: F.when(block.isNotNull(), _found(fam, block, s[b], f"block_run:{name}")).when(after.isNotNull(), _found(fam, after, s[d], way))
            weak = of("amount", "block", "weak", "amount", "label:weak")
            return F.when(x["kind"] == "strong", of("amount", "block", "strong", "amount", "label:strong")).when(x["kind"] == "weak", F.coalesce(weak, above)).when(x["kind"] == "fee", of("fee", "fee_block", "fee", "fee", "label:fee")).when(x["kind"] == "total_fee", of("total_fee", "fee_block", "fee", "fee", "label:fee")).when(x["kind"] == "debit", of("debit", "debit_block", "debit", "total_debit", "label:total_debit"))

        return let(F.struct(own.alias("block"), F.when(own.isNull(), nearest).alias("after")), told)

    df = once(df, _by=F.filter(F.transform("_labels", by_label), lambda c: c.isNotNull()))
    claimed = F.filter("_by", lambda c: c["kind"].isin("fee", "total_fee") | (c["source"] == "block_run:total_debit"))

    def by_currency(x: Column) -> Column:
        after = F.get(F.filter("_money", lambda m: (m["s"] >= x["e"]) & (m["e"] <= x["e"] + vocab.CURRENCY_NEAR)), F.lit(0))
        behind = F.filter("_money", lambda m: (m["e"] <= x["s"]) & (m["s"] >= x["s"] - vocab.CURRENCY_NEAR))
        own = lambda m: F.struct(money_value(m["v"]).alias("value"), F.lit(s["currency"]).alias("score"), F.concat(F.lit("currency_prefix:"), F.upper(x["v"])).alias("source"), m["s"].alias("s"), m["e"].alias("e"), F.lit("amount").alias("kind"))
        free = lambda m: m.isNotNull() & ~m["bad"] & ~F.exists(F.col("_claimed"), lambda c: (c["s"] <= m["s"]) & (m["e"] <= c["e"]))
        last = let(behind, lambda ms: F.get(ms, F.size(ms) - 1))
        return let(F.coalesce(after, last), lambda m: F.when(free(m), own(m)))

    df = once(df, _claimed=claimed)
    df = once(df, _by_cur=F.filter(F.transform("_cur", by_currency), lambda c: c.isNotNull()))
    ranked = lambda col: F.array_sort(col, lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["s"] - b["s"]))
    of_kind = lambda *k: F.filter("_by", lambda c: c["kind"].isin(*k))
    df = once(df, _amounts=ranked(F.concat(of_kind("amount"), F.col("_by_cur"))), _fees=of_kind("fee", "total_fee"), _debits=ranked(of_kind("debit")), _total_fees=ranked(of_kind("total_fee")))
    # The same printed money may be reached from two labels: it is added once.
    distinct = F.filter("_fees", lambda c, i: ~F.exists(F.slice("_fees", F.lit(1), i), lambda d: d["s"] == c["s"]))
    total = F.aggregate(distinct, F.lit(0).cast("decimal(18,2)"), lambda a, c: (a + c["value"]).cast("decimal(18,2)"))
    df = once(df, _a=F.get("_amounts", F.lit(0)), _d=F.get("_debits", F.lit(0)), _f=F.get("_total_fees", F.lit(0)), _sum=F.when(F.size("_fees") > 0, total), _best_fee=F.array_max(F.transform("_fees", lambda c: c["score"])))
    zero = F.lit(0).cast("decimal(4,3)")
    missing = F.when(F.trim("t") == "", "none:empty_text").otherwise("none:no_candidates")
    df = df.withColumns(
        {
            "amount": F.col("_a.value"), "amount_confidence": F.coalesce(_confidence(F.col("_a.score"), ocr), zero), "amount_source": F.coalesce("_a.source", missing),
            "fee": F.coalesce("_f.value", F.col("_sum").cast("decimal(11,2)")), "fee_confidence": F.coalesce(_confidence(F.coalesce("_f.score", "_best_fee"), ocr), zero),
            "fee_source": F.when(F.col("_f").isNotNull(), F.col("_f.source")).when(F.size("_fees") > 0, "fee:sum_of_components").otherwise(missing),
            "total_debit": F.col("_d.value"), "total_debit_confidence": F.coalesce(_confidence(F.col("_d.score"), ocr), zero), "total_debit_source": F.coalesce("_d.source", missing),
            "amount_candidates": F.slice(F.transform("_amounts", lambda c: F.struct(c["value"], c["score"], c["source"], c["s"])), 1, 10).cast(CANDIDATES),
        }
    )
    return df.drop("_money", "_labels", "_cur", "_good", "_runs", "_block", "_by", "_claimed", "_by_cur", "_amounts", "_fees", "_debits", "_total_fees", "_a", "_d", "_f", "_sum", "_best_fee")
