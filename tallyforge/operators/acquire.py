"""Which text of a file counts: a ladder of sources, each refused if it is garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_garbage

# The rungs from the top, with the confidence of those that have no own one; sources that are not OCR.
RUNGS = {"embedded": "0.7", "ocr": None, "vision": None, "pdfplumber": "0.4"}
NOT_OCR = ["embedded", "pdfplumber"]
LEAST_TEXT = 5
# End of fixed values.


def ladder(texts: dict[str, Column], confidences: dict[str, Column] | None = None) -> Column:
    """(text, source, confidence, ocr_used) of the first usable rung; an empty text from none where all are refused."""
    out = None
    rungs = [r for r in RUNGS if r in texts]
    for rung in reversed(rungs):
        own = (confidences or {}).get(rung)
        sure = (F.lit(RUNGS[rung]) if RUNGS[rung] else own if own is not None else F.lit("0")).cast("decimal(4,3)")
        here = F.struct(texts[rung].alias("text"), F.lit(rung).alias("source"), sure.alias("confidence"), F.lit(rung not in NOT_OCR).alias("ocr_used"))
        last = F.struct(F.lit("").alias("text"), F.lit("none").alias("source"), F.lit("0").cast("decimal(4,3)").alias("confidence"), F.lit(True).alias("ocr_used"))
        out = F.when(~is_garbage(texts[rung]), here).otherwise(last if out is None else out)
    return out


def long_enough(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a text of five characters or more, the others)."""
    ok = F.length(F.trim(F.coalesce("text", F.lit("")))) >= LEAST_TEXT
    return rows.where(ok), rows.where(~ok)
