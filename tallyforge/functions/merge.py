"""Merging two sources of the same fields, field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_id, valid_amount, valid_date, valid_id

VALID = {"id": valid_id, "amount": valid_amount, "date": valid_date}


def normal(kind: str, value: Column) -> Column:
    if kind == "id":
        return clean_id(value)
    if kind == "amount":
        return F.regexp_replace(F.regexp_replace(value, r"(?i)^\s*(?:RM|MYR)\s*", ""), ",", "").try_cast("decimal(11,2)").cast("string")
    return F.trim(value)


def merge(kind: str, local: Column, other: Column) -> Column:
    """(value, confidence, source): equal 1.00; both valid but different 0.70 (ids: the longer, ties to other); one 0.85 or 0.90; none 0.30."""
    ok = VALID[kind]
    a, b = F.when(F.coalesce(ok(local), F.lit(False)), normal(kind, local)), F.when(F.coalesce(ok(other), F.lit(False)), normal(kind, other))
    pick = F.when(F.length(a) > F.length(b), a).otherwise(b) if kind == "id" else b
    out = lambda v, c, s: F.struct(v.alias("value"), F.lit(c).cast("decimal(3,2)").alias("confidence"), F.lit(s).alias("source"))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both & (a == b), out(a, "1.00", "both")).when(both, out(pick, "0.70", "conflict")).when(a.isNotNull(), out(a, "0.85", "local")).when(b.isNotNull(), out(b, "0.90", "other")).otherwise(out(F.lit(None).cast("string"), "0.30", "none"))
