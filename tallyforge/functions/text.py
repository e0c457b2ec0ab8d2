"""Scalar text functions and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_BLANK = r"[\s\u00A0]"
# Shapes of tax registrations, dates and times; words and shapes that are never ids; marks that show doubled print.
TAX_NUMBERS = r"^[WC][0-9]{2}-[0-9]{4}-[0-9]{8}$|^[WC]10-"
DATE_SHAPES = [r"[0-9]{1,2}[-/ ](?:[0-9]{1,2}|[A-Za-z]{3,9})[-/ ][0-9]{2,4}", r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}", r"[A-Za-z]{3,9}\.? [0-9]{1,2},? [0-9]{4}"]
TIME_TAIL = r"(?: [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp][Mm])?)?"
NOISE = "REFERENCE TRANSACTION PAYMENT TRANSFER BANK ACCOUNT CUSTOMER RECEIPT MAYBANK2U MAYBANK CIMBCLICKS CIMB PBEBANK PUBLIC RHBNOW RHB DUITNOW JOMPAY FPX MYKAD AMONLINE HLB HONGLEONG UOB SUCCESSFUL COMPLETED PENDING FAILED ACCEPTED REJECTED MAYBANK2USIZ MAYBANK2UBIZ MAYBANK2UCOM BIZCHANNEL BIZCHANNELCIMB MAYBONK2U ELUARAN BAYARAN SIMPANAN DEPOSIT WITHDRAWAL MAKER CHECKER AUTHORISER APPROVAL REJECT ACCEPT MERCHANT TERMINAL BATCH TRACE APP CODE AUTH STAN INVOICE".split()
NOISE_PARTS = "ELUARAN BAYARAN SIMPANAN DEPOSIT SUCCESS REJECT MERCHANT TERMINAL TRANSACTION TRANSFER REFERENCE".split()
NO_IDS = [r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$", r"^[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}$", r"^[0-9]{6}-[A-Z]$", r"^-|-$", r"^\p{L}+$", r"^[0-9]+[.,][0-9]{2}$", r"^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$", "@", r"([A-Z0-9])\1{9,}", r"^[IL1O0]{5,}$"]
DOUBLED_MARKS = ["RM", "MYR", "Duit"]
# End of fixed values.


def is_garbage(text: Column) -> Column:
    """Text that acquisition must not accept: short, (cid:n) codes, or under 60 % printable."""
    t = F.coalesce(text, F.lit(""))
    visible = F.length(F.regexp_replace(t, r"[^\P{C}\n\r\t]", ""))
    return (F.length(F.trim(t)) < 50) | (F.regexp_count(t, F.lit(r"\(cid:")) >= 3) | (visible * 10 < F.length(t) * 6)


def normalize(text: Column) -> Column:
    """Arrows and marks spaced, runs of marks and of three or more equal letters collapsed, one space."""
    t = F.regexp_replace(text, r"(?:->|=>|→|»)", " -> ")
    t = F.regexp_replace(F.regexp_replace(t, "#", " # "), ":", " : ")
    t = F.regexp_replace(t, r"([^A-Za-z0-9\s])\1{3,}", "$1")
    t = F.regexp_replace(t, r"([A-Za-z])\1{2,}", "$1")
    return F.trim(F.regexp_replace(t, _BLANK + "+", " "))


def undouble(text: Column) -> Column:
    """Repairs text whose characters were printed twice, line by line; only where a mark of money or of the rail is printed so."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(.)\1+", "$1"))
    return F.when(text.rlike("|".join("".join(c + "{2,}" for c in mark) for mark in DOUBLED_MARKS)), F.array_join(lines, "\n")).otherwise(text)


def repair_digits(text: Column, ocr_used: Column) -> Column:
    """Letters that OCR confuses with digits, inside tokens of mostly digits; never where no OCR was used."""
    fix = lambda w: F.when((F.regexp_count(w, F.lit("[0-9]")) * 2 > F.length(w)) & w.rlike("^[A-Za-z0-9]+$"), F.translate(w, "lIODQSZG", "11000526")).otherwise(w)
    return F.when(ocr_used, F.array_join(F.transform(F.split(text, " "), fix), " ")).otherwise(text)


def clean_id(value: Column) -> Column:
    return F.upper(F.regexp_replace(F.split(value, "\n")[0], _BLANK + "+", ""))


def valid_id(value: Column) -> Column:
    """Four to thirty characters with a digit, and no tax registration's number."""
    v = F.upper(F.regexp_replace(F.trim(value), " ", ""))
    return F.coalesce(v.rlike(r"^[A-Z0-9][A-Z0-9\-/]{3,29}$") & v.rlike("[0-9]") & ~v.rlike(TAX_NUMBERS), F.lit(False))


def valid_amount(value: Column) -> Column:
    v = F.trim(F.regexp_replace(F.trim(value), "RM|MYR", ""))
    return F.coalesce(v.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]{1,9})(?:\.[0-9]{2})?$"), F.lit(False))


def valid_date(value: Column) -> Column:
    """One of three shapes, a time may follow; the calendar isn't asked."""
    return F.coalesce(F.trim(value).rlike(rf"^(?:{'|'.join(DATE_SHAPES)}){TIME_TAIL}$"), F.lit(False))


def plausible_transaction_id(value: Column) -> Column:
    """Rejects dates, phone numbers, amounts, times, mail addresses, plain words and runs that can't be an id."""
    v = F.regexp_replace(F.upper(F.trim(value)), "[ ']", "")

    def judge(x: Column) -> Column:
        plain = F.replace(x, F.lit("-"), F.lit(""))
        phone = plain.rlike("^01[0-9]{8,9}$") | x.rlike(r"^\+60|^601")
        bad = phone | ~F.length(x).between(6, 40) | x.isin(NOISE) | x.rlike("|".join(NOISE_PARTS)) | x.rlike("|".join(NO_IDS)) | x.rlike("^199[0-9]{5}$")
        long_label = (F.length(x) > 15) & x.rlike("ERENCE|AMOUNT")
        return F.coalesce(~bad & ~long_label, F.lit(False))

    return F.get(F.transform(F.array(v), judge), F.lit(0))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def similarity(a: Column, b: Column) -> Column:
    """Share of a's letters and digits that occur in b over the longer length, and 0.3 by how alike the lengths are; four places."""
    clean = lambda x: F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")

    def judge(p: Column) -> Column:
        n, m = F.length(p["a"]), F.length(p["b"])
        hits = F.size(F.filter(F.split(p["a"], ""), lambda c: (c != "") & F.contains(p["b"], c)))
        longer = F.greatest(n, m).cast("decimal(12,0)")
        score = hits.cast("decimal(12,0)") / longer + (1 - F.abs(n - m).cast("decimal(12,0)") / longer) * F.lit("0.3").cast("decimal(2,1)")
        return F.when((n > 0) & (m > 0), score).otherwise(0).cast("decimal(7,4)")

    return F.get(F.transform(F.array(F.struct(clean(a).alias("a"), clean(b).alias("b"))), judge), F.lit(0))


def repair_line_digits(text: Column) -> Column:
    """Letters between capitals or digits that stand for digits, in lines with a digit or a word of receipts."""
    def fix(line: Column) -> Column:
        out = line
        for a, b in zip("OlISBG", "011586"):
            out = F.regexp_replace(out, f"(?<=[A-Z0-9]){a}(?=[A-Z0-9])", b)
        return F.when(line.rlike(r"(?i)[0-9]|Ref|Trx|Txn|Amount|RM|Date|Time"), out).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), fix), "\n")


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON with or without a code fence around it; null where it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(plain, schema, {"mode": "PERMISSIVE"})


def context_of(text: Column, value: Column, window: int = 50) -> Column:
    """What stands around the first occurrence of a value, capitals aside."""
    at = F.position(F.upper(value), F.upper(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)) + F.length(value) + window))


def format_pattern(kind: Column) -> Column:
    """A pattern for a class of format_class: two characters more or less."""
    n = F.regexp_extract(kind, "_([0-9]+)$", 1).try_cast("int")
    size = F.concat(F.lit("{"), (n - 2).cast("string"), F.lit(","), (n + 2).cast("string"), F.lit("}"))
    return F.when(kind.startswith("numeric_"), F.concat(F.lit(r"\b\d"), size, F.lit(r"\b"))).when(kind.startswith("alpha_"), F.concat(F.lit(r"\b[A-Z]"), size, F.lit(r"\b"))).when(kind.startswith("alnum_"), F.lit(r"\b[A-Z0-9]{8,20}\b")).otherwise(F.lit(r"\b[A-Z0-9\-/]{8,25}\b"))


def complexity(value: Column) -> Column:
    """How much a value looks like an id: length, both cases, digits, marks, turns between letters and digits."""
    mixed = F.when(value.rlike("[A-Z]") & value.rlike("[a-z]"), 20).otherwise(0)
    marks = F.least(F.regexp_count(value, F.lit("[^A-Za-z0-9]")), F.lit(3)) * 3
    tenths = F.length(value) + mixed + F.regexp_count(value, F.lit("[0-9]")) * 5 + marks + alternations(value) * 2
    return (tenths.cast("decimal(9,1)") / 10).cast("decimal(8,1)")


def weak_label_id(value: Column) -> Column:
    """Six to thirty characters, two digits, mostly letters and digits, but not nearly all of one kind."""
    n, digits, letters = F.length(value), F.regexp_count(value, F.lit("[0-9]")), F.regexp_count(value, F.lit("[A-Za-z]"))
    return F.coalesce(n.between(6, 30) & (digits >= 2) & ((digits + letters) * 10 >= n * 8) & (letters * 10 <= n * 9) & (digits * 10 <= n * 9), F.lit(False))


def entity_like_id(value: Column) -> Column:
    """Four to fifty letters, digits, dashes or slashes with a digit, seven tenths of them letters or digits."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9\-/]{4,50}$") & value.rlike("[0-9]") & (F.regexp_count(value, F.lit("[A-Za-z0-9]")) * 10 >= F.length(value) * 7), F.lit(False))


def format_class(value: Column) -> Column:
    """numeric_n, alpha_n, alnum_Lx_Dy or mixed_special."""
    n, digits, letters = F.length(value), F.regexp_count(value, F.lit("[0-9]")), F.regexp_count(value, F.lit("[A-Za-z]"))
    return F.when(digits == n, F.concat(F.lit("numeric_"), n)).when(letters == n, F.concat(F.lit("alpha_"), n)).when(digits + letters == n, F.concat(F.lit("alnum_L"), letters, F.lit("_D"), digits)).otherwise("mixed_special")


def alternations(value: Column) -> Column:
    """How often letters and digits take turns."""
    return F.regexp_count(value, F.lit("(?<=[A-Za-z])(?=[0-9])")) + F.regexp_count(value, F.lit("(?<=[0-9])(?=[A-Za-z])"))


def looks_interbank(text: Column) -> Column:
    return F.coalesce(F.upper(text).rlike("|".join(vocab.INTERBANK)), F.lit(False))


def name_words(name: Column) -> Column:
    """Words of a party name without company forms, each once."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(name), r"\b(?:" + "|".join(vocab.COMPANY_FORMS) + r")\b\.?", " "), "[^A-Z0-9 ]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 1))
