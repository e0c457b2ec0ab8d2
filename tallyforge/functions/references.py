"""References of a receipt: labels, the values beside or below them, blocks of labels and values, roles.

Spans of labels and values are array columns, and everything below is expressions over them,
narrow and without a UDF. A value is the rest of its label's line up to the next label, or
the next line with text. Where a portal prints a block of labels and then a block of values,
values are given to labels by their places in the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .spans import cleaned, let, once, spans

# Lengths in characters, and shapes of dates.
LONGEST, BLOCK, NEAR, SHORT_LINE, WRAPPED = 60, 400, 40, 24, 4
DATE_SHAPES = r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{1,2}[\s-][A-Za-z]{3,9}[\s-][0-9]{2,4}"
# End of fixed values.

LABEL = vocab.reference_pattern()
OTHER = "(?i:" + vocab.phrases([x.replace(";", ",") for x in vocab.OTHER_LABELS]) + ")"
MONEY = r"[0-9,]+\.[0-9]{2}"
REFERENCE = "array<struct<value:string,label:string,role:string,confidence:decimal(4,3),source:string>>"


def reflow(text: Column) -> Column:
    """Text in which short lines before a line that starts with a colon are joined to it: a label that a narrow column wrapped."""
    kind = "struct<done:array<string>,open:array<string>>"
    none = F.array().cast("array<string>")
    make = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def step(acc: Column, line: Column) -> Column:
        joined = F.concat(F.array_join(F.transform(acc["open"], F.trim), " "), F.lit(" "), F.trim(line))
        keeps = F.concat(acc["open"], F.array(line))
        short = (F.trim(line) != "") & ~F.contains(line, F.lit(":")) & (F.length(F.trim(line)) <= SHORT_LINE)
        many = F.size(keeps) > WRAPPED
        full = make(F.concat(acc["done"], F.slice(keeps, 1, 1)), F.slice(keeps, 2, WRAPPED))
        return (
            F.when(line.rlike(r"^\s*:\s*\S") & (F.size(acc["open"]) > 0), make(F.concat(acc["done"], F.array(joined)), none))
            .when(short & many, full)
            .when(short, make(acc["done"], keeps))
            .otherwise(make(F.concat(acc["done"], keeps), none))
        )

    lines = F.aggregate(F.split(text, "\n"), make(none, none).cast(kind), step, lambda acc: F.concat(acc["done"], acc["open"]))
    return F.when(text.rlike(r"\n[ \t]*:[ \t]*\S"), F.array_join(lines, "\n")).otherwise(text)


def key_of(label: Column) -> Column:
    """What is left of a label when spelling is: the same rule as vocab.reference_key."""
    x = F.lower(label)
    x = F.when(x.startswith("end"), F.regexp_replace(x, r"[ \t]*\([^)]*\)$", "")).otherwise(x)
    return F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(x, "['’`´]s", ""), F.lit("reference"), F.lit("ref")), "[^a-z0-9]", ""), "(number|no|id)$", "")


def phrase(value: Column) -> Column:
    """Capital letters and digits with one space between words."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9 ]+", " "), r"\s+", " ")))


def is_label(value: Column) -> Column:
    """A value that is a label itself, or a row of column heads."""
    heads = value.rlike(rf"{LABEL}") & value.rlike(r"(?i)[a-z][a-z .]{7,}")
    return value.rlike(rf"^(?:{LABEL}|{OTHER})[ \t]*[:.]*$") | (~value.rlike("[0-9]") & (heads | value.rlike(r"(?i)\b(?:Transaction\s+(?:Status|Date|Type)|Approval\s+Status|Value\s+Date|Payment\s+(?:Type|Date|Mode)|Transfer\s+(?:Type|Mode)|Product\s+Type|Account\s+(?:No\.?|Number|Name)|Beneficiary\s+\w+|Recipient\s+Bank|Service\s+Charge|Total\s+\w+)\b")))


def clean_value(raw: Column) -> Column:
    """A reference, or null for what stands in a value's place without being one."""
    v = F.regexp_replace(F.trim(raw), r"(?s)\s{2,}.*$", "")
    v = F.regexp_replace(v, r"^[\s:;|]+|[\s:;|]+$", "")
    v = F.regexp_replace(v, rf"(?s)^(\S.*?)\s+(?:{DATE_SHAPES})(?=\s|$).*$", "$1")
    v = F.regexp_replace(v, r"(?<=\S)[\s–—-]+$", "")

    def judged(x: Column) -> Column:
        bad = (x == "") | (F.length(x) > LONGEST) | ~x.rlike("[A-Za-z0-9]")
        bad = bad | x.rlike(rf"[*Xx]{{3,}}|(?i:https?://|www\.)|(?i:\.(?:com|my|net|org)\b)|[^@\s]+@[^@\s]+\.[A-Za-z]{{2,}}|^(?i:(?:RM|MYR)?\s*{MONEY})$|(?i:\b(?:RM|MYR)\s*{MONEY})|^(?i:\(?\s*(?:optional|if\s+any|s)\s*\)?)$|^(?:{DATE_SHAPES})$")
        bad = bad | (x.rlike(r"^[A-Za-z()]+$") & (x != F.upper(x))) | F.upper(x).isin(vocab.NO_VALUES) | phrase(x).isin(vocab.NO_VALUES) | is_label(x)
        return F.when(~bad, x)

    return let(v, judged)


def strong_tokens(text: Column) -> Column:
    """Tokens that can only be references: a digit, six characters or more, no date, money or masked number."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9\-/]{5,29})"), F.lit(1))
    return F.filter(found, lambda x: x.rlike("[0-9]") & ~x.rlike(rf"^(?:{DATE_SHAPES})$|^{MONEY}$|[*Xx]{{3,}}"))


def _labels(t: Column) -> Column:
    """(v, s, e, name, role, line_end) of the labels; words in running text aren't labels."""
    table = vocab.reference_labels()
    names = F.create_map(*[F.lit(x) for k, (name, _) in table.items() for x in (k, name)])
    roles = F.create_map(*[F.lit(x) for k, (_, role) in table.items() for x in (k, role)])

    def opens(x: Column) -> Column:
        before = F.substring_index(F.substring(t, F.lit(1), x["s"]), "\n", -1)
        prose = before.rlike(r"(?:^|[^A-Za-z'])[a-z']+\s*$") & ~before.rlike(r"[:\-|]\s*$|\s{2,}$")
        follows = F.substring(t, x["e"] + 1, F.lit(1))
        return ((follows == "") | follows.rlike(r"[-:\s.*]")) & (x["v"] != F.lower(x["v"])) & ~prose

    def named(x: Column) -> Column:
        rest = F.substring_index(F.substring(t, x["e"] + 1, F.length(t)), "\n", 1)
        return let(key_of(x["v"]), lambda k: F.struct(x["v"], x["s"], x["e"], F.element_at(names, k).alias("name"), F.element_at(roles, k).alias("role"), (x["e"] + F.length(rest)).alias("line_end")))

    return F.filter(F.transform(F.filter(spans(t, LABEL), opens), named), lambda x: x["name"].isNotNull())


def _read(t: Column, x: Column, end: Column) -> Column:
    """The label with value, state (value, empty or unread) and far (characters to the value), reading up to end."""
    def parts(seg: Column) -> Column:
        line = F.substring_index(seg, "\n", 1)
        gap = F.length(F.regexp_extract(seg, r"^[^\n]*\n(?:[ \t]*\n)*", 0))
        second = F.substring_index(F.substring(seg, F.length(line) + 2, F.length(seg)), "\n", 1)
        blank = line.rlike(r"^[-–—.\s]*[-–—.][-–—.\s]*$") | ((F.trim(line) == "") & second.rlike(r"^[-–—.\s]*[-–—.][-–—.\s]*$"))
        beside = F.coalesce(clean_value(line), F.get(strong_tokens(line), F.lit(0)))
        return F.struct(seg.alias("seg"), blank.alias("blank"), F.when(~blank, beside).alias("beside"), gap.alias("gap"))

    seg = F.regexp_replace(F.substring(t, x["e"] + 1, end - x["e"]), r"^[ \t]*[:\-*.]?[ \t]*", "")

    def told(p: Column) -> Column:
        below = lambda: F.when(p["gap"] > 0, clean_value(F.substring_index(F.substring(p["seg"], p["gap"] + 1, F.length(p["seg"])), "\n", 1)))
        state = lambda v: F.when(p["blank"], "empty").when(v.isNotNull(), "value").otherwise("unread")
        told = lambda v: F.struct(*[x[c].alias(c) for c in ("s", "e", "name", "role", "line_end")], v.alias("value"), state(v).alias("state"), F.when(p["beside"].isNotNull(), 0).otherwise(p["gap"]).alias("far"))
        return let(F.when(~p["blank"], F.coalesce(p["beside"], below())), told)

    return let(let(seg, parts), told)


def _runs(labels: Column) -> Column:
    """The run of each label: two or more unread ones in a row, and those after them on the last one's line; null outside."""
    start = F.struct(F.lit(0).alias("mode"), F.lit(0).alias("line_end"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        def to(mode, line_end, run, own):
            return F.struct(F.lit(mode).alias("mode"), line_end.alias("line_end"), run.alias("run"), F.concat(acc["out"], F.array(own)).alias("out"))

        unread, here = x["state"] == "unread", x["s"] < acc["line_end"]
        return (
            F.when((acc["mode"] == 1) & unread, to(1, x["line_end"], acc["run"], acc["run"]))
            .when((acc["mode"] >= 1) & here, to(2, acc["line_end"], acc["run"], acc["run"]))
            .when(unread, to(1, x["line_end"], acc["run"] + 1, acc["run"] + 1))
            .otherwise(to(0, acc["line_end"], acc["run"], F.lit(None).cast("int")))
        )

    return F.aggregate(labels, start, step, lambda acc: acc["out"])


def _paired(t: Column, labels: Column, runs: Column) -> Column:
    """(s, value) of the labels of each run of two or more, by their places among all labels of the block."""
    def members(r: Column) -> Column:
        return F.filter(labels, lambda x, i: F.get(runs, i) == r)

    def assign(m: Column) -> Column:
        first, last = F.get(m, F.lit(0)), F.element_at(m, -1)
        block = F.substring(t, last["e"] + 1, F.lit(BLOCK))
        lines = F.filter(F.transform(F.split(block, "\n"), clean_value), lambda v: v.isNotNull())
        tokens = F.slice(strong_tokens(block), F.lit(1), F.size(m))
        had = F.transform(F.filter(m, lambda x: x["state"] == "value"), lambda x: x["value"])
        found = F.when((F.size(lines) < F.size(m)) & (F.size(tokens) > F.size(lines)), tokens).otherwise(lines)
        places = F.array_distinct(F.transform(F.concat(spans(F.substring(t, first["s"] + 1, last["e"] - first["s"]), LABEL), spans(F.substring(t, first["s"] + 1, last["e"] - first["s"]), rf"(?m:^[ \t]*){OTHER}(?m:[ \t]*:?[ \t]*$)")), lambda p: p["s"] + first["s"]))
        each = lambda p: F.transform(m, lambda x: F.struct(x["s"].alias("s"), F.get(p["values"], F.size(F.filter(p["places"], lambda q: q < x["s"]))).alias("value"), (last["e"] - x["e"]).alias("far")))
        return let(F.struct(F.array_distinct(F.concat(had, found)).alias("values"), places.alias("places")), each)

    numbers = F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))
    many = F.filter(F.transform(numbers, members), lambda m: F.size(m) >= 2)
    return F.flatten(F.transform(many, assign))


def with_references(df: DataFrame, ocr: Column | None = None) -> DataFrame:
    """Adds references (value, label, role, confidence, source) in document order, and reference_id, its confidence, source.

    A main reference under a general name gives way to another main one; of equal values the
    first counts; where the bank's main reference is missing its strongest secondary one is
    promoted; what the payer typed never is.
    """
    ocr = F.lit(False) if ocr is None else ocr
    df = cleaned(df)
    df = once(df, _rt=reflow(F.col("t")))
    t = F.col("_rt")
    df = once(df, _hits=_labels(t))
    read = F.transform("_hits", lambda x, i: _read(t, x, F.coalesce(F.get(F.col("_hits"), i + 1)["s"], F.length(t))))
    df = once(df, _lab=F.when(F.size("_hits") > 0, read).otherwise(F.filter(read, lambda x: F.lit(False))))
    df = once(df, _runs=_runs(F.col("_lab")))
    df = once(df, _pairs=_paired(t, F.col("_lab"), F.col("_runs")))

    def resolved(x: Column) -> Column:
        pair = F.get(F.filter("_pairs", lambda p: p["s"] == x["s"]), F.lit(0))
        value = F.when(pair.isNotNull(), pair["value"]).when(x["state"] == "value", x["value"])
        return F.struct(value.alias("value"), x["name"].alias("name"), x["role"].alias("role"), F.coalesce(pair["far"], x["far"]).alias("far"))

    df = once(df, _all=F.filter(F.transform("_lab", resolved), lambda x: x["value"].isNotNull()))
    sure = F.exists("_all", lambda x: (x["role"] == "bank_primary") & ~x["name"].isin(vocab.GIVE_WAY))
    df = once(df, _sure=sure)
    by_label = F.create_map(*[F.lit(x) for kv in vocab.PRIMARY_CONFIDENCE.items() for x in kv])
    by_role = F.create_map(*[F.lit(x) for kv in vocab.ROLE_CONFIDENCE.items() for x in kv])

    def scored(x: Column) -> Column:
        role = F.when(x["name"].isin(vocab.GIVE_WAY) & F.col("_sure"), "bank_secondary").otherwise(x["role"])
        base = F.coalesce(F.when(role == "bank_primary", F.element_at(by_label, x["name"])), F.element_at(by_role, role))
        points = F.greatest(F.lit(550), F.least(F.lit(990), base - F.when(x["far"] >= NEAR, 100).otherwise(0) - F.when(ocr, 50).otherwise(0)))
        slug = F.regexp_replace(F.regexp_replace(F.lower(x["name"]), "[^a-z0-9]+", "_"), "^_+|_+$", "")
        return F.struct(x["value"].alias("value"), x["name"].alias("label"), role.alias("role"), (points.cast("decimal(7,3)") / 1000).cast("decimal(4,3)").alias("confidence"), F.concat(F.lit("label:"), slug).alias("source"))

    first = F.filter("_all", lambda x, i: ~F.exists(F.slice("_all", F.lit(1), i), lambda y: F.upper(y["value"]) == F.upper(x["value"])))
    df = once(df, _refs=F.transform(first, scored))
    seconds = F.filter("_refs", lambda r: r["role"] == "bank_secondary")
    best = F.array_max(F.transform(seconds, lambda r: r["confidence"]))
    none = ~F.exists("_refs", lambda r: r["role"] == "bank_primary")
    df = once(df, _up=F.when(none, F.get(F.filter(seconds, lambda r: r["confidence"] == best), F.lit(0))["value"]))
    promoted = lambda r: F.when(F.col("_up").isNotNull() & (r["value"] == F.col("_up")), F.struct(r["value"].alias("value"), r["label"].alias("label"), F.lit("bank_primary").alias("role"), r["confidence"].alias("confidence"), F.concat(r["source"], F.lit("+promoted_sole_bank_reference")).alias("source"))).otherwise(r)
    df = once(df, references=F.transform("_refs", promoted).cast(REFERENCE))
    return with_reference_id(df).drop("_rt", "_hits", "_lab", "_runs", "_pairs", "_all", "_sure", "_refs", "_up")


def with_reference_id(df: DataFrame) -> DataFrame:
    """Adds reference_id, reference_confidence and reference_source: the first main reference in the document."""
    main = F.get(F.filter("references", lambda r: r["role"] == "bank_primary"), F.lit(0))
    why = F.when(main.isNotNull(), main["source"]).when(F.trim("t") == "", "missing:empty_text").when(F.size("references") == 0, "missing:no_reference_label").otherwise("missing:no_bank_primary")
    df = once(df, _main=main)
    return df.withColumns({"reference_id": F.col("_main.value"), "reference_confidence": F.coalesce("_main.confidence", F.lit(0).cast("decimal(4,3)")), "reference_source": why}).drop("_main")


def most_certain_reference(references: Column) -> Column:
    """The main reference with the highest confidence, the first of equals: what the scalar operator gives."""
    main = F.filter(references, lambda r: r["role"] == "bank_primary")
    return F.get(F.filter(main, lambda r: r["confidence"] == F.array_max(F.transform(main, lambda x: x["confidence"]))), F.lit(0))
