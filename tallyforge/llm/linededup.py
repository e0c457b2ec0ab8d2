"""Operator 2, line dedup by a deletion-neighbourhood join.

A line is the words between two newlines; lines without a word are left alone. Two lines are
near copies if they are equal, or if both have `least_words` words or more and one edit
(a word put in, taken out or replaced) turns one into the other: at five words and one edit,
four fifths of the words agree. Longer lines with two edits, and shorter ones with any, are
not near copies. A line goes if a near copy of it stands earlier in the order
of (doc_id, row, line number), whether or not that one stays: no order of processing matters.

Equal lines are first reduced to their earliest place. Each line then emits, as hashed keys,
itself and variants with one word deleted, with the place of the deletion. Lines meet if
a variant of one is the other, or if they share a variant at the same place; the earliest
line of each key is joined back, so no pairs are made within a key. Every match is verified
word by word on both texts.

Only lines that can match emit variants: one edit leaves the first or the last half of the
shorter line as it is, so lines that share no half with another line are left out, and those
that share only one half delete words of the other half only. Neither loses anything.

Rows are told apart by their place in the input: rows that repeat an id stand in that order,
so of repeated rows the later ones are copies. Rows with a null id come last. Null text has
no lines; very long lines are hashed in time that grows with their length; an empty table
gives no rows. Other columns, whatever their names, are kept by drop_lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_bytes, forget, likely_in, materialize, once, spare_names

HEAD, TAIL = 1, 2
LOW = (1 << 33) - 1  # the bits of a row number that count inside a partition


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashed keys of the first and last halves of n words, at both lengths that the shorter line can have."""
    out = []
    for back in (0, 1):
        m = F.floor((n - back) / 2).cast("int")
        out += [F.xxhash64(F.lit("head"), n - back, F.call_function("substring_index", line, F.lit(" "), m)), F.xxhash64(F.lit("tail"), n - back, F.call_function("substring_index", line, F.lit(" "), -m))]
    return out


def lines_of(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """rid (a number of the row: the column of docs named so, or a new one), doc_id, line_no, line (words with one space between), n (words), h1, h2 (two hashes).

    The first line of every row is there even if it has no word (n is 0).
    """
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")
    one = F.trim(F.regexp_replace("raw", r"[\x09-\x0D]" + SPACE[:-1] + r"*|\x20" + SPACE, " "))
    rows = docs.select("doc_id", "text", (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"))
    rows = once(rows.select("rid", "doc_id", split), line=one).where("line <> '' or line_no = 0")
    n = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return once(rows, n=n).select("rid", "doc_id", "line_no", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("second")).alias("h2"))


class Order:
    """The order of lines as one number: (doc_id, nulls last; rid; line_no), packed by the ranges that occur."""

    def __init__(self, lines: DataFrame):
        part, row = F.shiftrightunsigned("rid", 33), F.col("rid").bitwiseAND(F.lit(LOW))
        least, most, parts, rows, room = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max(part), F.max(row), F.max("line_no")).first()
        self.least, self.most = least or 0, most or 0
        self.parts, self.rows, self.room = (parts or 0) + 1, (rows or 0) + 1, (room or 0) + 1
        size = (self.most - self.least + 2) * self.parts * self.rows * self.room
        if size >= 10**38:
            raise ValueError("ids, rows and lines together need numbers of over 38 digits")
        self.kind = "long" if size < 1 << 63 else "decimal(38,0)"

    def _lit(self, n: int) -> Column:
        return F.expr(f"cast('{n}' as {self.kind})")

    def pos(self) -> Column:
        k = self.kind
        own = F.coalesce(F.col("doc_id").cast(k) - self._lit(self.least), self._lit(self.most - self.least + 1)).cast(k)
        row = F.shiftrightunsigned("rid", 33).cast(k) * self._lit(self.rows) + F.col("rid").bitwiseAND(F.lit(LOW)).cast(k)
        return ((own * self._lit(self.parts * self.rows) + row).cast(k) * self._lit(self.room) + F.col("line_no").cast(k)).cast(k)

    def of(self, pos: str) -> tuple[Column, Column]:
        """(doc_id, line_no) of a position."""
        own = F.expr(f"{pos} div cast('{self.parts * self.rows * self.room}' as {self.kind})")
        doc = F.when(own <= self.most - self.least, (own + self._lit(self.least)).cast("long"))
        return doc, F.expr(f"{pos} % cast('{self.room}' as {self.kind})").cast("int")


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one word put in, taken out or replaced, or none, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[k:] == long[k + 1 :]


def _variants(texts: DataFrame) -> DataFrame:
    """pos, v1, v2, place: the line itself (place -1) and variants with one word deleted, from the half that is not shared."""
    mul = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
    kind = texts.schema["pos"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lines, shared = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in by_bytes(lines, 1 << 18):
                at, keys, places = [], ([], []), []
                for i in range(lo, hi):
                    raw = lines[i].encode().split(b" ")
                    n = len(raw)
                    cut = np.arange((n - 1) // 2 if not shared[i] & TAIL else 0, n // 2 if not shared[i] & HEAD else n)
                    places.append(np.concatenate([[-1], cut]).astype(np.int32))
                    at.append(np.full(len(cut) + 1, i))
                    for seed, (m, out) in enumerate(zip(mul, keys)):
                        h = np.array([xxhash.xxh64_intdigest(w, seed) for w in raw], np.uint64)
                        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, m)]), dtype=np.uint64)
                        left = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:n], dtype=np.uint64)])
                        right = np.concatenate([[np.uint64(0)], np.cumsum(h[1:] * power[: n - 1], dtype=np.uint64)])
                        without = left[:n] + (right[n - 1] - right)
                        out.append(np.concatenate([[left[n]], without[cut]]).view(np.int64))
                pos = batch.column(0).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([pos, pa.array(np.concatenate(keys[0])), pa.array(np.concatenate(keys[1])), pa.array(np.concatenate(places))], names=["pos", "v1", "v2", "place"])

    return texts.select("pos", "line", "sides").mapInArrow(run, f"pos {kind}, v1 long, v2 long, place int")


def _verified(pairs: DataFrame) -> DataFrame:
    """pos, least of the pairs (with texts a and b) that one edit turns into each other."""
    kind = pairs.schema["pos"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ok = [one_edit(x.split(" "), y.split(" ")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("pos", "least", "a", "b").mapInArrow(run, f"pos {kind}, least {kind}")


def _able(firsts: DataFrame) -> DataFrame:
    """pos, sides: the texts that share a half with another one, and which halves."""
    key = lambda k, side: F.struct(F.col(k).alias("key"), F.lit(side).alias("side"))
    halves = firsts.where("k0 is not null").select(F.col("first").alias("pos"), F.explode(F.array(key("k0", HEAD), key("k1", TAIL), key("k2", HEAD), key("k3", TAIL))).alias("k")).select("pos", "k.key", "k.side")
    shared = materialize(halves.groupBy("key").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).where("a <> b").select("key"), "shared")
    able = materialize(likely_in(halves, "key", shared).hint("merge").join(shared, "key").groupBy("pos").agg(F.bit_or("side").alias("sides")), "able")
    forget(shared)
    return able


def copies_of(lines: DataFrame, order: Order, least_words: int = 5) -> DataFrame:
    """rid, line_no, of (the position of an earlier line), exact: the lines that go."""
    rows = lines.where("n > 0").withColumn("pos", order.pos())
    names = ["k0", "k1", "k2", "k3"]
    keys = [F.when(F.col("n") >= least_words, k).alias(c) for c, k in zip(names, _halves(F.col("line"), F.col("n")))]
    # One row for each text, at its first place: hot lines count once. Equal lines have equal keys.
    firsts = materialize(rows.select("h1", "h2", "pos", *keys).groupBy("h1", "h2").agg(F.min("pos").alias("first"), *[F.min(k).alias(k) for k in names]), "firsts")
    able = _able(firsts)
    texts = materialize(likely_in(rows.select("pos", "line"), "pos", able).join(able, "pos"), "texts")
    variants = materialize(_variants(texts), "variants")
    at_place = materialize(variants.groupBy("v1", "v2", "place").agg(F.min("pos").alias("least"), F.count("*").alias("n")), "places")
    any_place = at_place.where("place >= 0").groupBy("v1", "v2").agg(F.min("least").alias("least"))
    whole = at_place.where("place = -1").select("v1", "v2", "least")
    deleted = variants.where("place >= 0").hint("merge")
    same = deleted.join(at_place.where("place >= 0 and n > 1"), ["v1", "v2", "place"]).select("pos", "least")
    shorter = deleted.join(whole, ["v1", "v2"]).select("pos", "least")
    longer = variants.where("place = -1").hint("merge").join(any_place, ["v1", "v2"]).select("pos", "least")
    found = materialize(same.union(shorter).union(longer).where("least < pos").distinct(), "found")
    left, right = texts.select("pos", F.col("line").alias("a")), texts.select(F.col("pos").alias("least"), F.col("line").alias("b"))
    near = materialize(_verified(found.join(left, "pos").join(right, "least")).groupBy("pos").agg(F.min("least").alias("least")), "near")
    forget(able, texts, variants, at_place, found)
    # A text's first place is the only row that can be a near copy and no exact one.
    seen = firsts.select("h1", "h2", "first").join(near, F.col("first") == F.col("pos"), "left").select("h1", "h2", "first", "least")
    marked = rows.select("rid", "line_no", "pos", "h1", "h2").hint("merge").join(seen, ["h1", "h2"])
    later = F.col("pos") > F.col("first")
    gone = materialize(marked.where(later | F.col("least").isNotNull()).select("rid", "line_no", F.when(later, F.col("first")).otherwise(F.col("least")).alias("of"), later.alias("exact")), "gone")
    forget(firsts, near)
    return gone


def line_copies(docs: DataFrame, least_words: int = 5, rid: str | None = None) -> DataFrame:
    """rid, doc_id, line_no, of_doc_id, of_line_no, exact: the lines that go, and the earlier lines that they copy."""
    lines = materialize(lines_of(docs, rid), "lines", "zstd")
    order = Order(lines)
    ids = lines.where("line_no = 0").select("rid", "doc_id")
    doc, line = order.of("of")
    return copies_of(lines, order, least_words).join(ids, "rid").select("rid", "doc_id", "line_no", doc.alias("of_doc_id"), line.alias("of_line_no"), "exact")


def drop_lines(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """docs with the lines that go taken out of text; other columns as they are."""
    rid, gone = spare_names(docs.columns, "rid", "gone")
    rows = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    copies = line_copies(rows, least_words, rid)
    each = copies.groupBy(F.col("rid").alias(rid)).agg(F.collect_list("line_no").alias(gone))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = rows.join(each, rid, "left").withColumn("text", F.when(F.col(gone).isNotNull(), kept).otherwise(F.col("text")))
    return out.select(*docs.columns)


def line_dedup(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_kept, dropped (the numbers of the lines that go, from 0) of every row."""
    lines = materialize(lines_of(docs), "lines", "zstd")
    gone = copies_of(lines, Order(lines), least_words)
    sizes = lines.groupBy("rid").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("n") > 0).alias("n_lines"))
    each = gone.groupBy("rid").agg(F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.array_sort(F.collect_list("line_no")).alias("dropped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = sizes.join(each, "rid", "left").select("doc_id", zero("n_lines"), zero("n_exact"), zero("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", (F.col("n_lines") - F.col("n_exact") - F.col("n_near")).alias("n_kept"), "dropped")
