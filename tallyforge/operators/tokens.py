"""Words with their places on a page: text assembly, choice of passes, layout scores, weak labels, entities.

Tokens are an array column of (text, left, top, width, height, conf, line_num) in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.spans import once, spans
from ..functions.text import entity_like_id, similarity

TOKENS = "array<struct<text:string,left:int,top:int,width:int,height:int,conf:double,line_num:int>>"
# Points of the layout scorer and its reach in pixels; words near ids and near other numbers.
BASE, LETTERS, DATED, OWN_BANK, UPPER, RIGHT, NEAR_ID, NEAR_OTHER, TAX = 100, 30, 40, 50, 20, 20, 150, -100, -150
LETTER_BANKS = ["Maybank", "HSBC", "Public Bank"]
ID_WORDS = ["REFERENCE", "REF", "TRX", "TXN", "ID", "INVOICE", "IBG", "JOMPAY", "DUITNOW"]
OTHER_WORDS = ["SAY", "DESCRIPTION", "MEMO", "REMARK", "TERMINAL", "MERCHANT", "MID", "TID", "TRACE", "BATCH", "APPR", "AUTH"]
TAX_WORDS, TAX_SHAPE = ["SST", "SERVICE TAX", "TAX ID"], r"^[WC][0-9]{2}-[0-9]{4}-[0-9]{8}$|^[WC]10"
ROW, ROW_REACH, ABOVE, ABOVE_REACH = 50, 500, 150, 300
WEAK_PATTERNS = [r"\b(?:reference|ref|refno|payment ref|trans ref|bank ref)\.?\s*[:#-]?\s*([A-Za-z0-9._\-/#]{5,})", r"\b(?:transaction|txn|trans|tx)\s*(?:id|no|number|ref)?\s*[:#-]?\s*([A-Za-z0-9._\-/#]{5,})", r"\b(?:invoice|inv|bill)\s*(?:ref|no|number)?\s*[:#-]?\s*([A-Za-z0-9._\-/#]{4,})", r"\bduitnow\s*(?:reference|ref|id)?\s*[:#-]?\s*([A-Za-z0-9._\-/#]{6,})", r"\b(?:payment|pymt|pay)\s*(?:reference|ref|id)?\s*[:#-]?\s*([A-Za-z0-9._\-/#]{5,})"]
# End of fixed values.


def assemble(tokens: DataFrame) -> DataFrame:
    """doc_id, text, n_words, confidence (0 to 1) and tokens, from one row for each word (doc_id, i, and the fields of a token).

    Words without confidence are left out; a page's words come to one task, as pages are bounded.
    """
    kept = tokens.where("conf > 0")
    each = F.struct("i", *[F.col(c) for c in ("text", "left", "top", "width", "height", "conf", "line_num")])
    pages = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("all"), (F.avg("conf") / 100).alias("confidence"), F.count("*").alias("n_words"))
    # A new line wherever the line's number changes.
    glue = lambda a, x: F.struct(F.concat(a["text"], F.when(a["line"].isNull(), "").when(a["line"] == x["line_num"], " ").otherwise("\n"), x["text"]).alias("text"), x["line_num"].alias("line"))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("line"))
    text = F.aggregate("all", start, glue, lambda a: a["text"])
    return pages.select("doc_id", text.alias("text"), "n_words", "confidence", F.transform("all", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "left", "top", "width", "height", "conf", "line_num")])).cast(TOKENS).alias("tokens"))


def reading_order(lines: Column) -> Column:
    """Text of lines (text, x, y) whose y grows upwards: from the top, then from the left."""
    ranked = F.array_sort(F.transform(lines, lambda x, i: F.struct((-F.round(x["y"], 3)).alias("y"), x["x"].alias("x"), i.alias("i"), x["text"].alias("text"))))
    return F.array_join(F.transform(ranked, lambda x: x["text"]), "\n")


def choose_pass(light: Column, photo: Column, heavy: Column) -> Column:
    """One of three passes (text, confidence): the light one if it is good, the photo one if it is better and fair, else the best; ties to the earlier."""
    sure = (light["confidence"] > 0.85) & (F.length(F.trim(light["text"])) > 15)
    fair = (photo["confidence"] > light["confidence"]) & (photo["confidence"] > 0.7)
    named = lambda name, x: F.struct(F.lit(name).alias("method"), x["text"].alias("text"), x["confidence"].alias("confidence"))
    best = F.when((light["confidence"] >= photo["confidence"]) & (light["confidence"] >= heavy["confidence"]), named("light", light)).when(photo["confidence"] >= heavy["confidence"], named("photo", photo)).otherwise(named("heavy", heavy))
    return F.when(sure, named("light", light)).when(fair, named("photo", photo)).otherwise(best)


def pages_until_sure(pages: DataFrame, enough: float = 0.8) -> DataFrame:
    """Pages (doc_id, page, n_ids, confidence) up to the first one with ids and a confidence over enough; all where there is none."""
    first = pages.where((F.col("n_ids") > 0) & (F.col("confidence") > enough)).groupBy("doc_id").agg(F.min("page").alias("last_page"))
    return pages.join(first, "doc_id", "left").where("last_page is null or page <= last_page").drop("last_page")


def first_angle(tries: Column) -> Column:
    """The first of the tries (angle, ids) that gives ids."""
    return F.get(F.filter(tries, lambda t: F.size(t["ids"]) > 0), F.lit(0))["angle"]


def layout_stats(tokens: Column, size: int = 100) -> Column:
    """Mean, deviation, least and most of left, top, width and height, the number of tokens, and zeros up to size."""
    def of(field: str) -> list[Column]:
        v = F.transform(tokens, lambda t: t[field].cast("double"))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
        spread = F.get(F.transform(F.array(mean), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v))), F.lit(0))
        return [mean, spread, F.array_min(v), F.array_max(v)]

    some = F.array(*[x.cast("float") for f in ("left", "top", "width", "height") for x in of(f)], F.size(tokens).cast("float"))
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    return F.when(F.size(tokens) > 0, F.concat(some, zeros(size - 17))).otherwise(zeros(size))


def _offsets(tokens: Column) -> Column:
    """(s, e) of each token in its text, with one character between tokens."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda a, t: F.struct((a["at"] + F.length(t["text"]) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), (a["at"] + F.length(t["text"])).alias("e")))).alias("out"))
    return F.aggregate(tokens, start, step, lambda a: a["out"])


def near_word(tokens: Column, x: Column, y: Column, words: list[str]) -> Column:
    """Whether a token with one of the words stands in the same row, or shortly above."""
    hit = lambda t: F.upper(t["text"]).rlike("|".join(words))
    row = lambda t: (F.abs(t["top"] - y) < ROW) & (F.abs(t["left"] - x) < ROW_REACH)
    above = lambda t: (y - t["top"] > 0) & (y - t["top"] < ABOVE) & (F.abs(t["left"] - x) < ABOVE_REACH)
    return F.exists(tokens, lambda t: hit(t) & (row(t) | above(t)))


def layout_scores(df: DataFrame) -> DataFrame:
    """Adds layout_ids: the five best (id, score) of doc_id, text, tokens, width, height; an id stands where its text first occurs."""
    df = once(patterns.with_ids(df), _at=_offsets(F.col("tokens")))

    def scored(c: Column, i: Column) -> Column:
        at = F.position(c["id"], F.upper("text")) - 1
        own = F.filter(F.col("tokens"), lambda t, k: (at >= 0) & (F.get("_at", k)["e"] > at) & (F.get("_at", k)["s"] < at + F.length(c["id"])))
        mean = lambda o, f: F.aggregate(o, F.lit(0.0), lambda a, t: a + t[f]) / F.size(o)
        letters = c["id"].rlike("[^0-9]")
        content = F.lit(BASE) + F.when(letters, LETTERS).otherwise(0) + F.when((F.length(c["id"]) >= 12) & c["id"].rlike("^20[0-9]{2}"), DATED).otherwise(0) + F.when(letters & F.col("v3_bank").isin(LETTER_BANKS), OWN_BANK).otherwise(0)

        def placed(p: Column) -> Column:
            first = F.get(p["own"], F.lit(0))
            near = lambda words: near_word(F.col("tokens"), p["x"], p["y"], words)
            return F.when(first["top"] / F.col("height") < 0.4, UPPER).otherwise(0) + F.when(first["left"] / F.col("width") > 0.5, RIGHT).otherwise(0) + F.when(near(ID_WORDS), NEAR_ID).otherwise(0) + F.when(near(OTHER_WORDS), NEAR_OTHER).otherwise(0) + F.when(c["id"].rlike(TAX_SHAPE) | near(TAX_WORDS), TAX).otherwise(0)

        place = F.get(F.transform(F.array(own), lambda o: F.when(F.size(o) > 0, placed(F.struct(o.alias("own"), mean(o, "left").alias("x"), mean(o, "top").alias("y")))).otherwise(0)), F.lit(0))
        return F.struct((-(content + place)).alias("rank"), i.alias("i"), c["id"].alias("id"))

    df = once(df, _scored=F.transform("ids", scored))
    best = F.slice(F.array_sort("_scored"), 1, 5)
    return df.withColumn("layout_ids", F.transform(best, lambda c: F.struct(c["id"].alias("id"), (-c["rank"]).alias("score")))).drop("_at", "_scored")


def text_tokens(text: Column) -> Column:
    """(text, s, e) of the words of a text."""
    return F.transform(spans(text, r"\S+"), lambda x: F.struct(x["v"].alias("text"), x["s"], x["e"]))


def weak_labels(text: Column, tokens: Column) -> Column:
    """0, 1 (begins an id) or 2 (goes on) for each token (text, s, e), from patterns; a token is labelled by the first that covers it."""
    def ids(p: str) -> Column:
        whole = spans(text, "(?i:" + p.replace("([A", "(?:[A") + ")")
        return F.transform(whole, lambda m: F.struct((m["e"] - F.length(F.regexp_extract(m["v"], f"(?i){p}", 1))).alias("s"), m["e"].alias("e")))

    found = F.array_sort(F.flatten(F.array(*[ids(p) for p in WEAK_PATTERNS])))

    def label(p: Column) -> Column:
        inside = lambda t: F.exists(p, lambda m: ((t["s"] >= m["s"]) & (t["s"] < m["e"])) | ((t["e"] > m["s"]) & (t["e"] <= m["e"])))
        hit = F.transform(tokens, lambda t: inside(t) & t["text"].rlike("[0-9]"))
        return F.transform(hit, lambda h, i: F.when(~h, 0).when((i > 0) & F.get(hit, i - 1), 2).otherwise(1))

    return F.get(F.transform(F.array(found), label), F.lit(0))


def label_known(text: Column, tokens: Column, value: Column) -> Column:
    """Labels of the tokens that cover a known id, capitals aside; zeros where it doesn't occur."""
    at = F.position(F.upper(value), F.upper(text)) - 1
    hit = lambda t: (at >= 0) & (t["s"] < at + F.length(value)) & (t["e"] > at)
    return F.transform(tokens, lambda t, i: F.when(~hit(t), 0).when((i > 0) & hit(F.get(tokens, i - 1)), 2).otherwise(1))


def best_alike(tokens: Column, value: Column, least: str = "0.7") -> Column:
    """The token most like a value, where the likeness is over least; the first of equals."""
    scored = F.transform(tokens, lambda t, i: F.struct((-similarity(t["text"], value)).alias("rank"), i.alias("i"), t["text"].alias("text")))
    best = F.array_min(scored)
    return F.when(-best["rank"] > F.lit(least).cast("decimal(7,4)"), best["text"])


def scaled_boxes(tokens: Column, width: Column, height: Column) -> Column:
    """Boxes of the tokens in thousandths of the page, kept inside it."""
    part = lambda v, whole: F.greatest(F.lit(0), F.least(F.lit(1000), (v * 1000 / whole).cast("int")))
    return F.transform(tokens, lambda t: F.array(part(t["left"], width), part(t["top"], height), part(t["left"] + t["width"], width), part(t["top"] + t["height"], height)))


def align(labels: Column, pieces: Column, size: int = 512) -> Column:
    """Labels for word pieces: each word's on its first piece, none (-100) on others, zeros up to size; pieces: how many each word has."""
    spread = F.flatten(F.transform(labels, lambda x, i: F.concat(F.array(x), F.array_repeat(F.lit(-100), F.get(pieces, i) - 1))))
    return F.slice(F.concat(spread, F.array_repeat(F.lit(0), size)), 1, size)


def entities(tokens: Column, labels: Column) -> Column:
    """Texts of runs of tokens that begin with 1 and go on with 2, joined by blanks; those that look like ids."""
    pairs = F.transform(tokens, lambda t, i: F.struct(t["text"].alias("text"), F.get(labels, i).alias("label")))
    start = F.array().cast("array<string>")
    grow = lambda a, p: F.when(p["label"] == 1, F.concat(a, F.array(p["text"]))).when((p["label"] == 2) & (F.size(a) > 0), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), p["text"])))).otherwise(F.when(F.size(a) > 0, a).otherwise(a))
    return F.filter(F.aggregate(pairs, start, grow), entity_like_id)


def best_entity(values: Column) -> Column:
    """The longest-looking of entity and pattern matches: a tenth for each character and capital, a fifth for each digit; the first of equals."""
    score = lambda v: F.length(v) + F.regexp_count(v, F.lit("[0-9]")) * 2 + F.regexp_count(v, F.lit("[A-Z]")) - F.when(F.lower(v).isin("date", "ref", "no", "id", "invoice"), 100).otherwise(0)
    best = F.array_min(F.transform(values, lambda v, i: F.struct((-score(v)).alias("rank"), i.alias("i"), v.alias("v"))))
    return F.when(best["rank"] < 0, best["v"])
