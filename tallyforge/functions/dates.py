"""The transaction date of a receipt: tokens, order of day and month, labels in two ranks, stamps that never count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .spans import cleaned, let, once, spans, starting

_NAMES = "(?i:" + "|".join(sorted(set(vocab.MONTH_NAMES), key=lambda x: (-len(x), x))) + ")"
DATE = starting("0123456789" + "".join(x[0] for x in vocab.MONTH_NAMES), rf"(?<![0-9A-Za-z])(?:[0-9]{{4}}[/.\-][0-9]{{1,2}}[/.\-][0-9]{{1,2}}|[0-9]{{1,2}}[/\-.][0-9]{{1,2}}[/\-.](?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{1,2}}[ \t\-]+{_NAMES}[ \t\-,]+(?:[0-9]{{4}}|[0-9]{{2}})|{_NAMES}\.?[ \t\-]+[0-9]{{1,2}},?[ \t]*[0-9]{{4}})(?![0-9])")


def year_of(v: Column, ref_year: int) -> Column:
    """Two-digit years reach ten years ahead of ref_year."""
    y = v.try_cast("int")
    return F.when(F.length(v) != 2, y).when(y + 2000 > ref_year + 10, y + 1900).otherwise(y + 2000)


def _day(y: Column, m: Column, d: Column) -> Column:
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.try_to_date(F.concat_ws("-", pad(y, 4), pad(m, 2), pad(d, 2)), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in vocab.MONTHS]), F.lower(F.substring(name, 1, 3)))


def named_date(v: Column, ref_year: int) -> Column:
    """A date with a month's name, either way round; else null."""
    first, second = r"^([0-9]{1,2})[ \t\-]+([A-Za-z]+)[ \t\-,]+([0-9]+)$", r"^([A-Za-z]+)\.?[ \t\-]+([0-9]{1,2}),?[ \t]*([0-9]+)$"
    part = lambda p, i: F.regexp_extract(v, p, i)
    a = _day(year_of(part(first, 3), ref_year), _month(part(first, 2)), part(first, 1))
    b = _day(year_of(part(second, 3), ref_year), _month(part(second, 1)), part(second, 2))
    return F.when(v.rlike(first), a).when(v.rlike(second), b)


def to_date(v: Column, month_first: Column, ref_year: int) -> Column:
    """A date token as a date; impossible dates are null."""
    part = lambda i: F.regexp_extract(v, r"^([0-9]+)[/\-.]([0-9]+)[/\-.]([0-9]+)$", i)
    iso = _day(part(1), part(2), part(3))
    numeric = _day(year_of(part(3), ref_year), F.when(month_first, part(1)).otherwise(part(2)), F.when(month_first, part(2)).otherwise(part(1)))
    return F.when(v.rlike(r"^[0-9]{4}[/\-.]"), iso).when(v.rlike("[A-Za-z]"), named_date(v, ref_year)).otherwise(numeric)


def is_stamp(t: Column, d: Column) -> Column:
    """A print stamp: a comma and a time without seconds follow, or a stamp's label stands before."""
    never = "(?i:" + vocab.phrases(vocab.DATE_NEVER) + ")"
    return F.substring(t, d["e"] + 1, F.lit(14)).rlike(r"^\s*,\s*[0-9]{1,2}:[0-9]{2}(?!\s*:\s*[0-9]{2})") | F.substring(t, F.greatest(d["s"] - vocab.NEVER_BEFORE + 1, F.lit(1)), F.least(d["s"], F.lit(vocab.NEVER_BEFORE))).rlike(never)


def hinted_order(t: Column, label: Column) -> Column:
    """Whether a hint like (mm/dd/yyyy) after a label puts the month first; null without one."""
    hint = F.regexp_extract(F.substring(t, label["e"] + 1, F.lit(20)), r"^\s*\(([A-Za-z]{1,4}[/\-. ][A-Za-z]{1,4}[/\-. ][A-Za-z]{1,4})\)", 1)
    letters = F.lower(F.regexp_replace(hint, r"([A-Za-z])[A-Za-z]*[/\-. ]?", "$1"))
    return F.when(F.array_join(F.array_sort(F.split(letters, "")), "") == "dmy", F.locate("m", letters) < F.locate("d", letters))


def inferred_order(dates: Column, ref_year: int) -> Column:
    """Month first by the text's own dates: a part over 12, else a date with a month's name that agrees; null if unclear."""
    number = lambda d, i: F.regexp_extract(d["v"], r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.][0-9]+$", i).try_cast("int")
    over = lambda i: F.exists(dates, lambda d: F.coalesce(number(d, i) > 12, F.lit(False)))
    numeric = F.filter(dates, lambda d: d["v"].rlike(r"^[0-9]{1,2}[/\-.][0-9]"))
    named = F.filter(F.transform(dates, lambda d: named_date(d["v"], ref_year)), lambda x: x.isNotNull())
    agrees = lambda first: F.exists(numeric, lambda d: F.coalesce(F.array_contains(named, to_date(d["v"], F.lit(first), ref_year)), F.lit(False)))
    return F.when(over(1) & ~over(2), False).when(over(2) & ~over(1), True).when(agrees(False) & ~agrees(True), False).when(agrees(True) & ~agrees(False), True)


def with_date(df: DataFrame, bank_key: Column | None = None, ref_year: int = 2026, ocr: Column | None = None) -> DataFrame:
    """Adds date, date_tier (1: main label, 2: other label, 3: unlabelled), date_confidence, date_source.

    The order of day and month is that of the label's hint, else the bank's, else what the
    text itself shows, else day first. Digits of a token that a window's end cuts are read
    whole, because tokens are found in the whole text.
    """
    ocr = F.lit(False) if ocr is None else ocr
    t = F.col("t")
    df = once(cleaned(df), _found=spans(t, DATE), _l1=spans(t, vocab.labels(vocab.DATE_FIRST)))
    own = F.lit(None).cast("boolean") if bank_key is None else F.when(bank_key.isNotNull(), bank_key.isin(vocab.MONTH_FIRST))
    df = once(df, _dates=F.filter("_found", lambda d: ~is_stamp(t, d)), _order=F.coalesce(own, inferred_order(F.col("_found"), ref_year), F.lit(False)))
    read = lambda d, order: F.struct(d["v"].alias("v"), to_date(d["v"], order, ref_year).alias("date"))

    def after(x: Column) -> Column:
        near = F.filter("_dates", lambda d: (d["s"] >= x["e"]) & (d["s"] < x["e"] + vocab.DATE_AFTER))
        first = let(F.coalesce(hinted_order(t, x), F.col("_order")), lambda order: F.get(F.filter(F.transform(near, lambda d: read(d, order)), lambda d: d["date"].isNotNull()), F.lit(0)))
        slug = F.regexp_replace(F.regexp_replace(F.lower(x["v"]), "[^a-z0-9]+", "_"), "^_+|_+$", "")
        return let(first, lambda d: F.when(d.isNotNull(), F.struct(d["date"].alias("date"), slug.alias("label"))))

    best = lambda labels: F.get(F.filter(F.transform(labels, after), lambda d: d.isNotNull()), F.lit(0))
    bare = F.get(F.filter(F.transform("_dates", lambda d: to_date(d["v"], F.col("_order"), ref_year)), lambda d: d.isNotNull()), F.lit(0))
    # What a better kind of label gives leaves nothing to do for the others.
    df = once(df, _d1=best("_l1"))
    df = once(df, _d2=F.when(F.col("_d1").isNull(), best(spans(t, vocab.labels(vocab.DATE_SECOND)))))
    df = once(df, _d3=F.when(F.coalesce("_d1.date", "_d2.date").isNull(), bare))
    tier = F.when(F.col("_d1").isNotNull(), 1).when(F.col("_d2").isNotNull(), 2).when(F.col("_d3").isNotNull(), 3)
    points = F.when(tier == 1, 950).when(tier == 2, 750).when(tier == 3, 700)
    why = F.when(tier == 1, F.concat(F.lit("label:"), F.col("_d1.label"))).when(tier == 2, F.concat(F.lit("label_secondary:"), F.col("_d2.label"))).when(tier == 3, "fallback:unlabeled_date")
    why = F.coalesce(why, F.when(F.trim("t") == "", "missing:empty_text").when(F.size("_found") > F.size("_dates"), "missing:only_print_stamp").otherwise("missing:no_date_candidates"))
    confidence = ((points - F.when(ocr, 50).otherwise(0)).cast("decimal(7,3)") / 1000).cast("decimal(4,3)")
    df = df.withColumns({"date": F.coalesce("_d1.date", "_d2.date", "_d3"), "date_tier": tier.cast("int"), "date_confidence": F.coalesce(confidence, F.lit(0).cast("decimal(4,3)")), "date_source": why})
    return df.drop("_found", "_l1", "_dates", "_order", "_d1", "_d2", "_d3")
