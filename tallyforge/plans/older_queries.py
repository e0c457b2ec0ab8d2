"""Queries of the older engine and of words with places: ids by shape, amounts, dates, layout scores, weak labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generations, money, patterns, text
from ..operators import service
from ..operators import tokens as tk
from ..sources import render
from .engine_queries import AMOUNT, DAY, TX, sql_pick
from .registry import query, table

#: How ids are printed (the digits are the order's), the id, and the bank that is detected.
_SHOWN = [
    ("Maybank Transfer Reference: MYCN99{} Status: Successful", "MYCN99{}", "Maybank"), ("M2U Maybank Ref No: MYCN99{} Amount: RM100.00", "MYCN99{}", "Maybank"), ("CIMB Transaction ID: B10-9910-{} Amount: RM250.00", "B10-9910-{}", "CIMB"),
    ("transaction id: b10-9910-{} amount: rm100", "B10-9910-{}", "Generic"), ("Bank Transfer-> RHB99{} | Amount: RM500", "RHB99{}", "RHB"), ("#HSBC99{}# Transaction Processed", "HSBC99{}", "HSBC"),
    ("UOB:UOB99{}:COMPLETED", "UOB99{}", "UOB"), ("SCB_Transfer_SCB99{}_Success", "SCB99{}", "Standard Chartered"), ("DN99{} DuitNow Payment", "DN99{}", "DuitNow"), ("Reference No.MYCN99{} for your transfer", "MYCN99{}", "Generic"),
    ("CIMB ref#B10-9910-{} completed successfully", "B10-9910-{}", "CIMB"), ("PBB 99{} Public Bank transaction", "PBB99{}", "Public Bank"), ("Ref: TX99{}\nFrom Account No: 1234567890123", "TX99{}", "Generic"), ("Reference 2099{}77", "2099{}77", "Generic"),
]


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = render.orders_of(spark, sf_dir)
    digits = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.replace(render.pick([s for s, _, _ in _SHOWN], F.col("o_orderkey")), F.lit("{}"), digits).alias("text"))


@query(f"SELECT o_orderkey AS doc_id, replace({sql_pick([i for _, i, _ in _SHOWN], 'o_orderkey')}, '{{}}', {TX}) AS id, {sql_pick([b for _, _, b in _SHOWN], 'o_orderkey')} AS bank, 0::BIGINT AS accounts FROM orders")
def v3_transaction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that receipts without clear labels print, in fourteen forms; account numbers never count."""
    shown = _shown(spark, sf_dir)
    want = F.replace(render.pick([i for _, i, _ in _SHOWN], F.col("doc_id")), F.lit("{}"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    found = patterns.with_ids(shown).withColumn("want", want)
    return found.select("doc_id", F.get(F.filter(F.transform("ids", lambda x: x["id"]), lambda x: x == F.col("want")), F.lit(0)).alias("id"), F.col("v3_bank").alias("bank"), F.size(F.filter("ids", lambda x: x["id"].contains("1234567890123"))).cast("long").alias("accounts"))


@query(f"SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 2 THEN '150' WHEN 4 THEN '2.00' ELSE CAST({AMOUNT} AS VARCHAR) END AS amount FROM orders")
def v3_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts beside fees and totals, below their label, whole, after doubled print; a reference number is none."""
    o = render.orders_of(spark, sf_dir)
    plain = F.col("o_totalprice").cast("decimal(11,2)").cast("string")
    k = F.col("o_orderkey") % 5
    body = F.when(k == 0, F.concat(F.lit("Service Charge RM 1.00 Amount RM "), plain, F.lit(" Total Charges RM 1.06"))).when(k == 1, F.concat(F.lit("Total Debit Amount 99999.00\nTransfer Amount\n"), plain)).when(k == 2, F.lit("paid RM 150 in cash")).when(k == 3, F.concat(F.lit("Amount (MYR) : "), plain, F.lit(" Fee 0.00"))).otherwise(F.lit("Amount 500123 Service Charge RM 2.00"))
    return o.select(F.col("o_orderkey").alias("doc_id"), patterns.v3_amount(body).alias("amount"))


@query(f"SELECT o_orderkey AS doc_id, strftime({DAY}, '%d/%m/%Y') AS date FROM orders")
def v3_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed date: beside a date label, before a heading's, before any other; print stamps last."""
    o = render.orders_of(spark, sf_dir)
    d = F.date_format("o_orderdate", "dd/MM/yyyy")
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, F.concat(F.lit("04/08/2026, 07:57\nDate: 01/01/2001\nValue Date "), d)).when(k == 1, F.concat(F.lit("03/03/2003 Date: "), d)).when(k == 2, F.concat(F.lit("04/08/2026, 07:57\nseen "), d)).otherwise(F.concat(d, F.lit(", 07:57")))
    return o.select(F.col("o_orderkey").alias("doc_id"), patterns.v3_date(body).alias("date"))


_NAMED = [("Malayan Banking", "Maybank"), ("CIMB Clicks", "CIMB"), ("PBeBank", "Public Bank"), ("Hong Leong", "Hong Leong Bank"), ("HSBC and HSBC, once CIMB", "HSBC"), ("United Overseas", "UOB"), ("BANK RAKYAT", "Bank Rakyat"), ("Kuwait Finance", "Kuwait Finance House"), ("nobody", "Generic"), ("AEON", "Generic")]


@query(f"SELECT p_partkey, {sql_pick([b for _, b in _NAMED], 'p_partkey')} AS bank FROM part")
def v3_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank mentioned most, rare ones by name, else Generic."""
    return table(spark, sf_dir, "part").select("p_partkey", patterns.detect_bank(render.pick([n for n, _ in _NAMED], F.col("p_partkey"))).alias("bank"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'RHB' || lpad(o_orderkey::VARCHAR, 8, '1') WHEN 1 THEN lpad(o_orderkey::VARCHAR, 10, '5') || '510' ELSE 'AB' || lpad(o_orderkey::VARCHAR, 8, '1') END AS fixed, CASE o_orderkey % 3 WHEN 0 THEN 'TX12345' WHEN 1 THEN 'AB123' ELSE 'X99 REF' END AS cleaned FROM orders")
def v3_id_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread codes and digits of ids, and words glued to their ends."""
    o = render.orders_of(spark, sf_dir)
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("RH8"), F.lpad(key, 8, "1"))).when(k == 1, F.concat(F.lpad(key, 10, "5"), F.lit("SlO"))).otherwise(F.concat(F.lit("AB"), F.lpad(key, 8, "1")))
    glued = F.when(k == 0, "REFTX12345SUCCESSFUL").when(k == 1, "AB123STATUS").otherwise("X99 REF NO")
    return o.select(F.col("o_orderkey").alias("doc_id"), patterns.repair_id(raw).alias("fixed"), patterns.clean_id_ends(glued).alias("cleaned"))


@query(f"SELECT o_orderkey AS doc_id, 'HSBC' AS bank_name, 'HSBC' || {TX} AS transaction_id, strftime({DAY}, '%d/%m/%Y') AS date, CAST({AMOUNT} AS VARCHAR) AS amount, 1.00::DECIMAL(3,2) AS confidence FROM orders")
def v3_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the older engine at once."""
    o = render.orders_of(spark, sf_dir)
    body = F.concat(F.lit("HSBC Transaction Reference: HSBC"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("\nValue Date "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nAmount RM "), F.col("o_totalprice").cast("decimal(11,2)").cast("string"))
    return patterns.extract_by_pattern(o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))).select("doc_id", "bank_name", "transaction_id", "date", "amount", "confidence")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i and the fields of a token: six words on three lines for each order; the fifth has no confidence."""
    o = render.orders_of(spark, sf_dir)
    key = F.col("o_orderkey")
    words = F.array(F.lit("Reference"), F.concat(F.lit("TX"), F.lpad(key.cast("string"), 8, "0")), F.lit("Terminal"), F.concat(F.lit("ZZ"), F.lpad(key.cast("string"), 8, "9")), F.lit("smudge"), F.lit("end"))
    each = o.select(key.alias("doc_id"), F.posexplode(words).alias("i", "text"))
    return each.select("doc_id", "i", "text", (F.lit(100) + (F.col("i") % 2) * 200).cast("int").alias("left"), (F.lit(50) + F.floor(F.col("i") / 2) * 300).cast("int").alias("top"), F.lit(80).alias("width"), F.lit(20).alias("height"), F.when(F.col("i") == 4, -1.0).otherwise(F.col("i") * 10 + 50.0).alias("conf"), (F.floor(F.col("i") / 2) + 1).cast("int").alias("line_num"))


@query(f"SELECT o_orderkey AS doc_id, 'Reference TX' || {TX} || chr(10) || 'Terminal ZZ' || lpad(o_orderkey::VARCHAR, 8, '9') || chr(10) || 'end' AS text, 5::BIGINT AS n_words, 0.72::DECIMAL(4,3) AS confidence FROM orders")
def tokens_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined to lines and pages, without those of no confidence; the mean confidence."""
    return tk.assemble(_words(spark, sf_dir)).select("doc_id", "text", "n_words", F.col("confidence").cast("decimal(4,3)").alias("confidence"))


@query(f"SELECT o_orderkey AS doc_id, 'TX' || {TX} AS best, 320::INT AS best_score, 'ZZ' || lpad(o_orderkey::VARCHAR, 8, '9') AS second, 70::INT AS second_score FROM orders")
def layout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by where they stand: beside the word Reference, beside the word Terminal."""
    pages = tk.assemble(_words(spark, sf_dir)).withColumns({"width": F.lit(550), "height": F.lit(1000)})
    found = tk.layout_scores(pages)
    at = lambda i: F.get("layout_ids", F.lit(i))
    return found.select("doc_id", at(0)["id"].alias("best"), at(0)["score"].alias("best_score"), at(1)["id"].alias("second"), at(1)["score"].alias("second_score"))


@query(f"SELECT o_orderkey AS doc_id, [0, 1, 0, 0, 0]::INT[] AS labels, ['TX' || {TX}] AS found, 17::BIGINT AS n_stats, 220.0::DOUBLE AS mean_left FROM orders")
def weak_label_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of words from patterns, the entities that they spell, and the statistics of the boxes."""
    pages = tk.assemble(_words(spark, sf_dir))
    words = pages.select("doc_id", "text", tk.text_tokens(F.col("text")).alias("w"), F.col("tokens"))
    labelled = words.withColumn("labels", tk.label_known(F.col("text"), F.col("w"), F.regexp_extract("text", "(TX[0-9]+)", 1)))
    stats = tk.layout_stats(F.col("tokens"))
    return labelled.select("doc_id", F.col("labels").cast("array<int>").alias("labels"), tk.entities(F.col("w"), F.col("labels")).alias("found"), F.size(F.filter(F.slice(stats, 1, 17), lambda x: x.isNotNull())).cast("long").alias("n_stats"), F.get(stats, F.lit(0)).cast("double").alias("mean_left"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'light' WHEN o_orderkey % 4 = 1 THEN 'photo' WHEN o_orderkey % 4 = 2 THEN 'heavy' ELSE 'light' END AS method FROM orders")
def ocr_pass_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three passes over an image counts."""
    k = F.col("o_orderkey") % 4
    one = lambda t, *c: F.struct(t.alias("text"), F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).otherwise(c[3]).alias("confidence"))
    chosen = tk.choose_pass(one(F.lit("a text of twenty chars"), 0.9, 0.5, 0.5, 0.6), one(F.lit("b"), 0.95, 0.8, 0.6, 0.6), one(F.lit("c"), 0.99, 0.99, 0.7, 0.6))
    return render.orders_of(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), chosen["method"].alias("method"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem l WHERE l_linenumber <= coalesce((SELECT min(m.l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_quantity > 40), 100)")
def pages_until_sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document up to the first that gives a sure id."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(1).alias("n_ids"), F.when(F.col("l_quantity") > 40, 0.9).otherwise(0.5).alias("confidence"))
    return tk.pages_until_sure(pages).select("doc_id", "page")


@query("SELECT n_nationkey, 'top left' || chr(10) || 'top right' || chr(10) || n_name AS text, 'Ref 105 OIL' AS fixed FROM nation")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with boxes put in reading order; letters that stand for digits in lines of numbers."""
    line = lambda t, x, y: F.struct(t.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    lines = F.array(line(F.col("n_name"), 0.1, 0.2), line(F.lit("top right"), 0.6, 0.9001), line(F.lit("top left"), 0.1, 0.9003))
    return table(spark, sf_dir, "nation").select("n_nationkey", tk.reading_order(lines).alias("text"), text.repair_line_digits(F.lit("Ref 1O5 OIL")).alias("fixed")).withColumn("fixed", F.replace("fixed", F.lit("O1L"), F.lit("OIL")))


@query("SELECT p_partkey, (['1.3000', '0.9667', '0.2286', '0.0000'])[p_partkey % 4 + 1]::DECIMAL(7,4) AS likeness, (['5.6', '1.6', '5.6', '0.0'])[p_partkey % 4 + 1]::DECIMAL(8,1) AS complexity FROM part")
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike two values are, and how much one looks like an id."""
    a, b = render.pick(["TX-12ab34", "abc", "ab", ""], F.col("p_partkey")), render.pick(["tx12AB34", "abd", "xyzxyza", "x"], F.col("p_partkey"))
    c = render.pick(["TX-12ab34", "ab12", "TX-12ab34", ""], F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", text.similarity(a, b).alias("likeness"), text.complexity(c).alias("complexity"))


@query(f"""SELECT o_orderkey AS doc_id, e.engine, 'HSBC' AS bank, 'HSBC' || {TX} AS reference, CASE e.engine WHEN 'label' THEN CAST({DAY} AS VARCHAR) ELSE strftime({DAY}, '%d/%m/%Y') END AS date, CASE e.engine WHEN 'second' THEN 'RM ' ELSE '' END || CAST({AMOUNT} AS VARCHAR) AS amount FROM orders, (VALUES ('label'), ('pattern'), ('second')) e(engine)""")
def engines_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engines behind one contract, on the same receipts."""
    o = render.orders_of(spark, sf_dir)
    body = F.concat(F.lit("HSBC\nTransaction Reference: HSBC"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("\nTransaction Reference No : HSBC"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("\nValue Date "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nAmount RM "), F.col("o_totalprice").cast("decimal(11,2)").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))
    parts = [service.extract_with(e, rows).withColumn("engine", F.lit(e)) for e in ("label", "pattern", "second")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "engine", "bank", "reference", "date", "amount")


@query("SELECT 'ok' AS status, 3 AS engines, 50 AS banks, 9 AS rails")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service says about itself."""
    return service.health(spark).select("status", F.size("engines").alias("engines"), "banks", "rails")


@query(f"SELECT o_orderkey AS doc_id, 0 AS place, {AMOUNT} AS value, 98 AS score FROM orders")
def amount_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each amount that was considered."""
    return service.candidates(money.with_money(render.portal_blocks(spark, sf_dir))).select("doc_id", "place", "value", "score")


_RULED = [("Maybank", "MYCN12345678", "1.00", "1.00"), ("Maybank", "12345", "0.60", "0.60"), ("CIMB", "B10-2510-625105", "1.00", "1.00"), ("Public Bank", "PBB12345", "1.00", "1.00"), ("RHB", "123456", "0.90", "0.60"), ("HSBC", "HSBC1234567", "1.00", "0.80"), ("DuitNow", "ABC123", "0.60", "0.70"), ("Affin Bank", "X1", "0.60", "0.00"), ("Bank of Nowhere", "AB12345678", None, "0.80")]


@query(f"SELECT p_partkey, {sql_pick([r[2] for r in _RULED], 'p_partkey')}::DECIMAL(3,2) AS by_bank, {sql_pick([r[3] for r in _RULED], 'p_partkey')}::DECIMAL(3,2) AS by_name FROM part")
def bank_id_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure ids are by the rules of twelve banks, and by words of a bank's name."""
    bank, v = render.pick([r[0] for r in _RULED], F.col("p_partkey")), render.pick([r[1] for r in _RULED], F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", generations.bank_id_confidence(bank, v).alias("by_bank"), generations.named_id_confidence(bank, v).alias("by_name"))


@query(f"""SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN strftime({DAY}, '%d/%m/%Y') WHEN 1 THEN strftime({DAY}, '%d/%m/%Y') WHEN 2 THEN strftime({DAY}, '%d/%m/%Y') WHEN 3 THEN '05/06/1999' ELSE '05/06/2025' END AS date FROM orders""")
def second_engine_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as day, month and year: names of months, ISO, short and impossible years."""
    o = render.orders_of(spark, sf_dir)
    k, d = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    body = F.when(k == 0, d("d MMM yyyy")).when(k == 1, d("yyyy-MM-dd")).when(k == 2, F.concat(F.lit("on "), d("MMM d, yyyy"))).when(k == 3, "5 Jun 99").otherwise("5 June 2044")
    return o.select(F.col("o_orderkey").alias("doc_id"), generations.second_date(body).alias("date"))


@query(f"""SELECT o_orderkey AS doc_id, 'CIMB' AS bank_name, 'B10-9910-' || {TX} AS transaction_id, 'RM ' || CAST({AMOUNT} AS VARCHAR) AS amount, strftime({DAY}, '%d/%m/%Y') AS date, 0.99::DECIMAL(3,2) AS confidence, 'CIMB' AS by_words, 24 AS score FROM orders""")
def second_engine_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the second engine, and the bank by words."""
    o = render.orders_of(spark, sf_dir)
    body = F.concat(F.lit("CIMB Bank receipt\nReference: B10-9910-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("\nAmount: RM "), F.col("o_totalprice").cast("decimal(11,2)").cast("string"), F.lit("\nDate "), F.date_format("o_orderdate", "dd MMM yyyy"))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))
    got = generations.extract_second(rows).withColumn("w", generations.keyword_bank(F.col("text")))
    return got.select("doc_id", "bank_name", F.get("transaction_ids", F.lit(0)).alias("transaction_id"), "amount", "date", "confidence", F.col("w.bank").alias("by_words"), F.col("w.score").alias("score"))


@query(f"SELECT o_orderkey AS doc_id, 'TX' || {TX} AS value, 300 AS left_edge FROM orders")
def label_token_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word after a label's word, and its box."""
    pages = tk.assemble(_words(spark, sf_dir)).withColumn("value", generations.value_after_label(F.col("tokens")))
    return pages.select("doc_id", "value", generations.box_of(F.col("tokens"), F.lower("value"))["left"].alias("left_edge"))
