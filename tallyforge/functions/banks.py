"""The bank that issued a receipt and the bank that receives, from names and codes that the text prints.

All names are found in one scan; what each is comes from maps. A name where only the receiver's
bank is printed excludes that bank's family from being the issuer. Rails (DuitNow, IBG, ...) are
never banks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .spans import capitals, cleaned, let, once, spans, starting

REGISTRY = vocab.registry_rows()
MONTH_FIRST = vocab.MONTH_FIRST
BANKS = [r for r in REGISTRY if r["tier"] != "rail"]
# How far the issuer's and receiver's marks reach, in characters; confidences in thousandths.
HEAD, FOOT, NAME_AFTER, CODE_AFTER, GENERIC_AFTER, MARK_BEFORE = 150, 120, 450, 60, 200, 150
# End of fixed values.
# Only the registry's codes count; all of a country's share two letters, which most words don't have at their place.
_COUNTRIES = sorted({r["bic"][4:6] for r in REGISTRY if r["bic"]})
_CODE = starting("".join(r["bic"][0] for r in REGISTRY if r["bic"]), rf"\b[A-Z]{{4}}(?:{'|'.join(_COUNTRIES)})[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?\b")
_SIDE = r"(?:BENEFICIARY|RECEIVING|RECIPIENT|PAYEE|CREDIT)(?:'S)?\s*BANK"


def _pattern() -> str:
    """All names in one pattern, for text in capitals."""
    names = [n for r in BANKS for n in r["names"]]
    return starting("".join(n[0] for n in names), r"(?<![A-Z0-9])" + vocab.any_of(names, r"\s+") + r"(?![A-Z0-9])")


NAMES = _pattern()


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table: key, name, bic, alias (one row each), tier, parent."""
    rows = [(r["key"], r["name"], r["bic"], a, r["tier"], r["parent"]) for r in REGISTRY for a in r["names"]]
    return spark.createDataFrame(rows, "key string, name string, bic string, alias string, tier string, parent string")


def repair(text: Column, ocr: Column) -> Column:
    """Whole words that OCR makes of bank names, put right; only where the text came from OCR."""
    out = text
    for wrong, right in vocab.OCR_BANKS.items():
        out = F.regexp_replace(out, rf"(?i)\b{wrong}\b", right)
    return F.when(ocr & text.rlike(r"(?i)\b(?:" + "|".join(vocab.OCR_BANKS) + r")\b"), out).otherwise(text)


def name_of(key: Column) -> Column:
    return F.element_at(_map((r["key"], r["name"]) for r in REGISTRY), key)


def root_of(key: Column) -> Column:
    """The parent of an Islamic subsidiary, else the bank itself."""
    return F.element_at(_map((r["key"], r["parent"] or r["key"]) for r in BANKS), key)


def key_of_code(code: Column) -> Column:
    """The bank of a code of eight or eleven characters."""
    return F.element_at(_map((r["bic"], r["key"]) for r in REGISTRY if r["bic"]), F.substring(code, 1, 8))


def mentions(text: Column) -> Column:
    """(s, e, key, root, portal, size, line) of every name of a bank, from left to right."""
    keys = _map((n, r["key"]) for r in reversed(BANKS) for n in r["names"])

    def named(x: Column) -> Column:
        line = F.regexp_count(F.substring(text, F.lit(1), x["s"]), F.lit("\n"))
        told = lambda p: F.struct(x["s"], x["e"], p["key"].alias("key"), root_of(p["key"]).alias("root"), (p["name"].isin(vocab.PORTALS) | p["name"].rlike("[0-9]")).alias("portal"), F.length(p["name"]).alias("size"), line.alias("line"))
        return let(F.regexp_replace(x["v"], r"\s+", " "), lambda name: let(F.struct(name.alias("name"), F.element_at(keys, name).alias("key")), told))

    return F.transform(spans(capitals(text), NAMES), named)


def _best(hits: Column) -> Column:
    """The family with the longest name, then the most mentions, then the first."""
    own = lambda r: F.filter(hits, lambda h: h["root"] == r)
    best = lambda roots: F.array_min(F.transform(roots, lambda r: F.struct((-F.array_max(F.transform(own(r), lambda h: h["size"]))).alias("size"), (-F.size(own(r))).alias("n"), F.array_min(F.transform(own(r), lambda h: h["s"])).alias("s"), r.alias("root"))))["root"]
    return let(F.array_distinct(F.transform(hits, lambda h: h["root"])), lambda roots: F.when(F.size(roots) > 1, best(roots)).otherwise(F.get(roots, F.lit(0))))


def _named_after(hits: Column, at: Column, width: int) -> Column:
    """The bank on the first line after a place that names one; lines with a portal's name don't count."""
    portal_lines = F.transform(F.filter(hits, lambda h: h["portal"]), lambda h: h["line"])
    near = let(portal_lines, lambda lines: F.filter(hits, lambda h: (h["s"] >= at) & (h["s"] < at + width) & ~F.array_contains(lines, h["line"])))
    return F.array_min(F.transform(near, lambda h: F.struct(h["line"], (-h["size"]).alias("size"), h["s"], h["key"])))["key"]


SCRATCH = "_t _hits _codes _names _code_labels _plain _theirs _lead _head _foot _ours _strong _sure _guess _by_code _named _generic _by_name _any_code _near".split()


def _code_after(at: Column, width: int) -> Column:
    return F.get(F.filter("_codes", lambda c: (c["s"] >= at) & (c["e"] <= at + width)), F.lit(0))["key"]


def _points(x: Column) -> Column:
    return (x.cast("decimal(7,3)") / 1000).cast("decimal(4,3)")


def _scan(df: DataFrame, ocr: Column | None) -> DataFrame:
    """What is found in the text once: names, codes, labels of the receiver's bank, and the families that they name."""
    df = cleaned(df)
    df = once(df, _t=repair(F.col("t"), F.lit(False) if ocr is None else ocr))
    t = F.col("_t")
    code = lambda x: F.struct(x["s"], x["e"], key_of_code(x["v"]).alias("key"))
    df = once(
        df,
        _hits=mentions(t),
        _codes=F.filter(F.transform(spans(F.upper(t), _CODE), code), lambda x: x["key"].isNotNull()),
        _names=spans(t, "(?i:" + starting("BRPC", rf"{_SIDE}(?!\s*CODE)\b") + ")"),
        _code_labels=spans(t, "(?i:" + starting("B", r"BENEFICIARY\s*BANK\s*(?:[A-Z]+\s*)?CODE\b") + ")"),
        _plain=F.filter(spans(t, "(?i:" + starting("B", r"\bBANK\s*(?:(?:NAME|CODE)\b|:)") + ")"), lambda x: F.substring(t, F.greatest(x["s"] - MARK_BEFORE + 1, F.lit(1)), F.least(x["s"], F.lit(MARK_BEFORE))).rlike(r"(?im)\b(?:PAYEE|RECIPIENT|BENEFICIARY|CREDIT)\b|^[ \t]*TO[ \t]*$")),
    )
    hits = F.col("_hits")
    theirs = F.concat(
        F.transform("_names", lambda x: F.coalesce(_named_after(hits, x["e"], NAME_AFTER), _code_after(x["e"], CODE_AFTER))),
        F.transform("_code_labels", lambda x: _code_after(x["e"], CODE_AFTER)),
        F.transform("_plain", lambda x: _named_after(hits, x["e"], GENERIC_AFTER)),
    )
    return once(df, _theirs=F.filter(F.transform(theirs, root_of), lambda k: k.isNotNull()))


def _issuer(df: DataFrame) -> DataFrame:
    t = F.col("_t")
    lead = F.length(F.regexp_extract(t, r"^\s*", 0))
    head = F.length(F.substring_index(F.substring(t, lead + 1, F.length(t)), "\n", 1))
    body = F.rtrim(F.regexp_replace(t, r"\s+$", ""))
    foot = lambda p: let(F.length(F.substring_index(p, "\n", -1)), lambda n: F.when(n <= FOOT, F.length(p) - n).otherwise(F.length(p) + 1))
    df = once(df, _lead=lead, _head=let(head, lambda n: F.when(n <= HEAD, n).otherwise(0)), _foot=let(body, foot))
    ours = F.filter("_hits", lambda h: ~F.array_contains("_theirs", h["root"]))
    strong = lambda h: (h["e"] <= F.col("_lead") + F.col("_head")) | (h["s"] >= F.col("_foot")) | h["portal"] | F.substring(t, h["e"] + 1, F.lit(14)).rlike(r"(?i)^\s+Reference\b")
    df = once(df, _ours=ours)
    df = once(df, _strong=F.filter("_ours", strong))
    first_code = F.slice(F.filter(F.transform("_codes", lambda c: F.struct(c["s"], c["e"], c["key"], root_of(c["key"]).alias("root"), F.lit(False).alias("portal"), F.lit(8).alias("size"), F.lit(0).alias("line"))), lambda c: c["root"].isNotNull()), 1, 1)
    weak = F.concat("_ours", F.filter(first_code, lambda c: ~F.array_contains("_theirs", c["root"])))
    df = once(df, _sure=_best(F.col("_strong")))
    df = once(df, _guess=F.when(F.col("_sure").isNull(), _best(weak)))
    bank = F.coalesce("_sure", "_guess")
    why = F.coalesce(F.concat(F.lit("strong_signal:"), "_sure"), F.concat(F.lit("bare_mention:"), "_guess"), F.when(F.trim("t") == "", "empty_text").otherwise("no_bank_signal"))
    return df.withColumns({"bank_key": bank, "bank": name_of(bank), "bank_confidence": _points(F.when(F.col("_sure").isNotNull(), 950).when(F.col("_guess").isNotNull(), 600).otherwise(0)), "bank_source": why})


def _receiver(df: DataFrame) -> DataFrame:
    hits, first = F.col("_hits"), F.get("_names", F.lit(0))["e"]
    df = once(df, _by_code=_code_after(F.get("_code_labels", F.lit(0))["e"], CODE_AFTER), _named=F.coalesce(_named_after(hits, first, NAME_AFTER), _code_after(first, NAME_AFTER)))
    df = once(df, _generic=F.get(F.filter(F.transform("_plain", lambda x: _named_after(hits, x["e"], GENERIC_AFTER)), lambda k: k.isNotNull()), F.lit(0)))
    generic = F.col("_generic")
    some_mark = (F.size("_names") > 0) | (F.size("_code_labels") > 0) | generic.isNotNull()
    longest = F.array_min(F.transform("_hits", lambda h: F.struct((-h["size"]).alias("size"), h["s"], h["key"])))["key"]
    df = once(df, _by_name=F.coalesce("_named", F.when(F.col("_by_code").isNull(), generic)), _any_code=F.get("_codes", F.lit(0))["key"])
    df = once(df, _near=F.when(F.coalesce("_by_code", "_by_name", "_any_code").isNull() & some_mark, longest))
    agree = F.col("_by_code").isNotNull() & F.coalesce(F.col("_by_code") == F.col("_by_name"), F.lit(False))
    key = F.coalesce("_by_code", "_by_name", "_any_code", "_near")
    points = F.when(agree, 970).when(F.col("_by_code").isNotNull(), 900).when(F.col("_by_name").isNotNull(), 850).when(F.col("_any_code").isNotNull(), 700).when(F.col("_near").isNotNull(), 550).otherwise(0)
    why = F.when(agree, "label_code+name:").when(F.col("_by_code").isNotNull(), "label_code:").when(F.col("_by_name").isNotNull(), "label_name:").when(F.col("_any_code").isNotNull(), "bic_scan:").when(F.col("_near").isNotNull(), "alias_near_label:")
    source = F.coalesce(F.concat(why, key), F.when(F.trim("t") == "", "empty_text").otherwise("no_beneficiary_signal"))
    return df.withColumns({"beneficiary_bank": name_of(key), "beneficiary_bank_confidence": _points(points), "beneficiary_bank_source": source})


def with_issuer(df: DataFrame, ocr: Column | None = None) -> DataFrame:
    """Adds bank_key, bank, bank_confidence, bank_source."""
    return _issuer(_scan(df, ocr)).drop(*SCRATCH)


def with_banks(df: DataFrame, ocr: Column | None = None) -> DataFrame:
    """Adds what with_issuer does; beneficiary_bank with _confidence, _source."""
    return _receiver(_issuer(_scan(df, ocr))).drop(*SCRATCH)
