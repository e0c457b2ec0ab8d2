"""Queries of the label engine on harder layouts: blocks, wrapped labels, degraded scans, all banks, modes, confidences, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import banks, dates, money, parties, references, text, vocab
from ..operators import extract as ex
from ..sources import render
from .registry import query, table

AMOUNT, DAY, TX = "CAST(o_totalprice AS DECIMAL(11,2))", "CAST(o_orderdate AS DATE)", "lpad(o_orderkey::VARCHAR, 8, '0')"


def sql_pick(values: list, index: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({index}) % {len(values)} + 1]"


@query(f"""SELECT o_orderkey AS doc_id, 'TX' || {TX} AS value, 'bank_primary' AS role, 0.990::DECIMAL(4,3) AS confidence, 'label:transaction_reference_no' AS source FROM orders
UNION ALL SELECT o_orderkey, 'INV ' || o_custkey, 'payer_supplied', 0.850::DECIMAL(4,3), 'label:recipient_reference' FROM orders""")
def reference_block_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose labels and values stand in two blocks."""
    found = references.with_references(render.portal_blocks(spark, sf_dir))
    return found.select("doc_id", F.explode("references").alias("r")).select("doc_id", "r.value", "r.role", "r.confidence", "r.source")


@query(f"""SELECT o_orderkey AS doc_id, {AMOUNT} AS amount, 0.980::DECIMAL(4,3) AS amount_confidence, 'block_run:amount' AS amount_source, 0.50::DECIMAL(11,2) AS fee, 'fee:sum_of_components' AS fee_source,
CAST({AMOUNT} + 0.50 AS DECIMAL(11,2)) AS total_debit, 'block_run:total_debit' AS total_debit_source, {DAY} AS date, 'Interbank GIRO (IBG)' AS payment_mode FROM orders""")
def amount_scrambled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount, fee and total whose labels and values stand in two blocks."""
    return ex.extract(render.portal_blocks(spark, sf_dir)).select("doc_id", "amount", "amount_confidence", "amount_source", "fee", "fee_source", "total_debit", "total_debit_source", "date", "payment_mode")


@query(f"SELECT o_orderkey AS doc_id, 'MY' || {TX} || 'X' AS reference_id, 'label:advice_reference_no' AS reference_source, {DAY} AS date, {AMOUNT} AS amount, 'label:weak' AS amount_source, 'Maybank' AS bank FROM orders")
def wrapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a narrow column wrapped, and a date whose label says that the month comes first."""
    return ex.extract(render.wrapped_advices(spark, sf_dir)).select("doc_id", "reference_id", "reference_source", "date", "amount", "amount_source", "bank")


@query("SELECT count(*) AS n, 0::BIGINT AS with_reference, 0::BIGINT AS with_amount, 0::BIGINT AS with_date, 0::BIGINT AS with_bank, count(*) AS only_stamps, count(*) AS for_review FROM orders")
def degraded_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is read where nothing can be: a label in a sentence, a print stamp, a part of an account number."""
    r = ex.extract(render.degraded_scans(spark, sf_dir))
    return r.agg(F.count("*").alias("n"), F.count("reference_id").alias("with_reference"), F.count("amount").alias("with_amount"), F.count("date").alias("with_date"), F.count("bank").alias("with_bank"), F.count_if(F.col("date_source") == "missing:only_print_stamp").alias("only_stamps"), F.count_if("needs_review").alias("for_review"))


_ISSUER, _THEIRS = sql_pick([p[1] for p in render.PRINTED], "o_custkey"), sql_pick([p[1] for p in render.PRINTED], "o_orderkey")
_RECEIVER = sql_pick([p[3] for p in render.PRINTED], "o_orderkey")


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN {_ISSUER} <> {_THEIRS} THEN {_ISSUER} END AS bank, CASE WHEN {_ISSUER} <> {_THEIRS} THEN 0.950 ELSE 0 END::DECIMAL(4,3) AS bank_confidence FROM orders")
def bank_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issuer by what banks print at the head; a bank that only receives, or its family, never counts as the issuer."""
    return banks.with_banks(render.bank_heads(spark, sf_dir)).select("doc_id", "bank", "bank_confidence")


@query(f"SELECT o_orderkey AS doc_id, {_RECEIVER} AS beneficiary_bank, 0.850::DECIMAL(4,3) AS beneficiary_bank_confidence FROM orders")
def bank_beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receiver's bank, Islamic subsidiaries told from their parents."""
    return banks.with_banks(render.bank_heads(spark, sf_dir)).select("doc_id", "beneficiary_bank", "beneficiary_bank_confidence")


@query("SELECT o_orderkey AS doc_id, NULL::VARCHAR AS bank, 'no_bank_signal' AS bank_source, TRUE AS is_rail FROM orders")
def rail_not_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rails are printed like banks, but are none."""
    o = render.orders_of(spark, sf_dir)
    rail = render.pick(render.RAILS, F.col("o_orderkey"))
    found = banks.with_banks(o.select(F.col("o_orderkey").alias("doc_id"), rail.alias("rail"), F.concat(rail, F.lit("\nAmount RM 5.00\nvia "), rail).alias("text")))
    return found.select("doc_id", "bank", "bank_source", F.col("rail").isin(render.RAILS).alias("is_rail"))


_BIC = [("MBBEMYKL", "Maybank"), ("RHBAMYKL", "RHB Islamic Bank"), ("HBMBMYKL", "HSBC"), ("BKCHMYKL", "Bank of China (Malaysia)"), ("MHCBMYKA", "Mizuho Bank (Malaysia)"), ("BSNAMYK1", "BSN")]


@query(f"""SELECT o_orderkey AS doc_id, {sql_pick([n for _, n in _BIC], 'o_custkey')} AS beneficiary_bank, CASE o_orderkey % 3 WHEN 0 THEN 0.970 WHEN 1 THEN 0.900 ELSE 0.700 END::DECIMAL(4,3) AS beneficiary_bank_confidence,
CASE o_orderkey % 3 WHEN 0 THEN 'label_code+name' WHEN 1 THEN 'label_code' ELSE 'bic_scan' END AS how FROM orders""")
def bank_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receiver's bank by code and name, by code alone, by a bare code; codes of eight and eleven letters."""
    o = render.orders_of(spark, sf_dir)
    code = F.concat(render.pick([c for c, _ in _BIC], F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, "XXX").otherwise(""))
    name = render.pick([n.removesuffix(" (Malaysia)") for _, n in _BIC], F.col("o_custkey"))
    k = F.col("o_orderkey") % 3
    body = F.when(k == 0, F.concat(F.lit("Beneficiary Bank Code : "), code, F.lit("\nBeneficiary Bank : "), name)).when(k == 1, F.concat(F.lit("Beneficiary Bank Code\n"), code)).otherwise(F.concat(F.lit("sent to "), code))
    found = banks.with_banks(o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Receipt\n"), body).alias("text")))
    return found.select("doc_id", "beneficiary_bank", "beneficiary_bank_confidence", F.substring_index("beneficiary_bank_source", ":", 1).alias("how"))


_MODES = [("Interbank GIRO (IBG)", "Interbank GIRO (IBG)"), ("DuitNow (Transfer)", "DuitNow Transfer"), ("DuitNow Payment", "DuitNow Payment"), ("DuitNow", "DuitNow"), ("Outward ACH", "Outward ACH"), ("ACH Credit / GIRO", "ACH Credit/GIRO"), ("Automated Clearing House (ACH)", "ACH"), ("Instant Transfer", "Instant Transfer"), ("RENTAS", "RENTAS"), ("Funds Transfer", "Fund Transfer"), ("GIRO payment", "Interbank GIRO (IBG)")]


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 1 AND {sql_pick([m for _, m in _MODES], 'o_custkey')} NOT LIKE 'Interbank%' THEN {sql_pick([m for _, m in _MODES], 'o_custkey')} WHEN o_orderkey % 2 = 1 THEN 'Interbank GIRO (IBG)' ELSE {sql_pick([m for _, m in _MODES], 'o_custkey')} END AS payment_mode,
CASE o_orderkey % 2 WHEN 0 THEN 0.950 ELSE 0.750 END::DECIMAL(4,3) AS payment_mode_confidence FROM orders""")
def payment_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode beside its label before any other that is named; without a label, what is named."""
    o = render.orders_of(spark, sf_dir)
    shown = render.pick([s for s, _ in _MODES], F.col("o_custkey"))
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("IBG cut-off at noon\n"), F.lit("x" * 130), F.lit("\nPayment Mode : "), shown)).otherwise(F.concat(F.lit("Paid by "), shown))
    return parties.with_parties(o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text"))).select("doc_id", "payment_mode", "payment_mode_confidence")


# "Payee Account Name" holds a label of the payer too, so it is left out here.
_PAYER, _BENEF = list(vocab.PAYER), [b for b in vocab.BENEFICIARY if "Account Name" not in b]


@query(f"""SELECT o_orderkey AS doc_id, 'HOUSE ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' SDN BHD' ELSE '' END AS payer, least(990, ({vocab.PAYER[_PAYER[0]]} + ({sql_pick([vocab.PAYER[p] - vocab.PAYER[_PAYER[0]] for p in _PAYER], 'o_custkey')})::INT) + CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END)::INT AS payer_points,
'Works of ' || o_orderkey AS beneficiary, ({sql_pick([vocab.BENEFICIARY[p] for p in _BENEF], 'o_custkey')})::INT AS beneficiary_points FROM orders""")
def party_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payers and beneficiaries behind every label, with its confidence; account numbers and currencies beside names fall away."""
    o = render.orders_of(spark, sf_dir)
    name = F.concat(F.lit("HOUSE "), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " SDN BHD").otherwise(""))
    body = F.concat(F.lit("Receipt\n"), render.pick(_PAYER, F.col("o_custkey")), F.lit(" : 8000000002 / "), name, F.lit(" (MYR)\n"), render.pick(_BENEF, F.col("o_custkey")), F.lit("\nWorks of "), F.col("o_orderkey").cast("string"), F.lit(" < XXXXXXXX0101"))
    found = parties.with_parties(o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text")))
    return found.select("doc_id", "payer", (F.col("payer_confidence") * 1000).cast("int").alias("payer_points"), "beneficiary", (F.col("beneficiary_confidence") * 1000).cast("int").alias("beneficiary_points"))


@query("""SELECT o_orderkey % 6 AS layout, o_orderkey % 2 = 0 AS ocr, CAST(CASE o_orderkey % 6 WHEN 2 THEN 0.837 WHEN 3 THEN 0.850 WHEN 4 THEN 0.605 WHEN 0 THEN 0.902 ELSE 0.970 END AS DECIMAL(4,3)) AS amount_confidence,
CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.900 ELSE 0.950 END AS DECIMAL(4,3)) AS date_confidence, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.940 ELSE 0.990 END AS DECIMAL(4,3)) AS reference_confidence, count(*) AS n FROM orders GROUP BY ALL""")
def field_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences by layout, and what OCR takes off."""
    r = banks.with_banks(render.receipts(spark, sf_dir)).withColumn("ocr", F.col("doc_id") % 2 == 0)
    found = references.with_references(dates.with_date(money.with_money(r, F.col("ocr")), F.col("bank_key"), ocr=F.col("ocr")), F.col("ocr"))
    return found.groupBy(F.pmod("doc_id", F.lit(6)).alias("layout"), "ocr", "amount_confidence", "date_confidence", "reference_confidence").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'beneficiary_bank low confidence (0.55)' WHEN 1 THEN 'transaction_date: found the field but could not read it' WHEN 2 THEN 'reference_id: found the field but could not read it' ELSE '' END AS reasons,
o_orderkey % 4 <> 3 AS needs_review FROM orders""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person looks at what was found but not read, or is hardly sure; a field that isn't there is no reason."""
    o = render.orders_of(spark, sf_dir)
    k = F.col("o_orderkey") % 4
    head = F.lit("HSBC\nTransaction Reference No : TX1234567\nAmount RM 5.00\nTransaction Date 01/02/2024\n")
    body = F.when(k == 0, F.concat(head, F.lit("Recipient Bank\nas agreed with you"))).when(k == 1, F.lit("HSBC\nTransaction Reference No : TX1234567\nAmount RM 5.00\nprinted 01/02/2024, 10:11")).when(k == 2, F.lit("HSBC\nRecipient Reference : A7\nAmount RM 5.00\nTransaction Date 01/02/2024")).otherwise(head)
    r = ex.extract(o.select(F.col("o_orderkey").alias("doc_id"), body.alias("text")))
    return r.select("doc_id", F.array_join("review_reasons", "; ").alias("reasons"), "needs_review")


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'TX' || {TX} END AS transaction_id, CASE WHEN o_orderkey % 2 = 0 THEN 'HSBC' ELSE 'Older Bank' END AS bank_name, CASE WHEN o_orderkey % 2 = 0 THEN CAST({DAY} AS VARCHAR) ELSE 'old date' END AS date, CASE WHEN o_orderkey % 2 = 0 THEN CAST({AMOUNT} AS VARCHAR) ELSE '9.99' END AS amount FROM orders""")
def live_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label engine's reference counts even if it is none; its gaps in other fields are filled by the older engine."""
    o = render.orders_of(spark, sf_dir)
    body = F.concat(F.lit("HSBC\nTransaction Reference No : TX"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("\nTransaction Date "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nTransfer Amount "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    r = ex.extract(o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, body).otherwise("nothing to see").alias("text")))
    older = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("Older Bank").alias("bank_name"), F.lit("old date").alias("date"), F.lit("9.99").alias("amount"), F.lit("OLD1234567").alias("transaction_id"))
    return ex.live_fields(r, older).select("doc_id", "transaction_id", "bank_name", "date", "amount")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'by hand' ELSE 'extracted' END AS value FROM orders")
def effective_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person entered, unless it is blank."""
    k = F.col("o_orderkey") % 3
    truth = F.when(k == 0, "by hand").when(k == 1, " ")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), ex.effective(truth, F.lit("extracted")).alias("value"))


#: value, valid id, valid amount, valid date, plausible transaction id, id for weak labels, id of an entity.
CASES = [
    ("AB12-34", 1, 0, 0, 1, 1, 1), ("hello", 0, 0, 0, 0, 0, 0), ("W10-2305-31000123", 0, 0, 0, 1, 1, 1), ("C10-1", 0, 0, 0, 0, 0, 1), ("12/03/2024", 1, 0, 1, 0, 1, 1), ("Jan 11, 2021", 0, 0, 1, 1, 0, 0), ("2021/01/11", 1, 0, 1, 0, 1, 1),
    ("2021-01-11 10:22", 0, 0, 1, 1, 0, 0), ("11.01.2021", 0, 0, 0, 1, 1, 0), ("RM 1,200.00", 0, 1, 0, 1, 0, 0), ("1200", 1, 1, 0, 0, 0, 1), ("12,34.00", 0, 0, 0, 1, 0, 0), ("1234567890", 1, 0, 0, 1, 0, 1), ("0123456789", 1, 0, 0, 0, 0, 1), ("601234567890", 1, 0, 0, 0, 0, 1), ("+60123456789", 0, 0, 0, 0, 0, 0),
    ("123456-A", 1, 0, 0, 0, 1, 1), ("-AB12345", 0, 0, 0, 0, 1, 1), ("a@b12345", 0, 0, 0, 0, 1, 0), ("12:30:45", 0, 0, 0, 0, 0, 0), ("TX" + "1" * 11, 1, 0, 0, 0, 1, 1), ("I1lI1l", 1, 0, 0, 0, 1, 1), ("123.45", 0, 1, 0, 0, 1, 0), ("3ELUARAN", 1, 0, 0, 0, 0, 1), ("19991231", 1, 1, 0, 0, 0, 1), ("MAYBANK2U", 1, 0, 0, 0, 0, 1), ("QPK 251174696", 1, 0, 0, 1, 1, 0),
]
_VALUES, _FLAGS = [c[0] for c in CASES], ["valid_id", "valid_amount", "valid_date", "plausible", "weak", "entity"]


@query("SELECT p_partkey, " + ", ".join(f"{sql_pick([c[i + 1] for c in CASES], 'p_partkey')} = '1' AS {flag}" for i, flag in enumerate(_FLAGS)) + " FROM part")
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of ids, amounts and dates, good ones and bad ones."""
    v = render.pick(_VALUES, F.col("p_partkey"))
    rules = [text.valid_id, text.valid_amount, text.valid_date, text.plausible_transaction_id, text.weak_label_id, text.entity_like_id]
    return table(spark, sf_dir, "part").select("p_partkey", *[rule(v).alias(flag) for rule, flag in zip(rules, _FLAGS)])


_NOISE = ["Successful", "below", "SUCCESS", "RM 12.00", "-", "****1234", "https://x.com.my/a", "a@b.com", "12/03/2024", "Payment Date", "Transaction Status", "INV 44 12/03/2024 more", "CPC", "ok  second column", "Debit Amount MYR 5.00"]
_CLEAN = [None, None, None, None, None, None, None, None, None, None, None, "INV 44", "CPC", None, None]


@query(f"SELECT p_partkey, {sql_pick(_CLEAN, 'p_partkey')} AS value FROM part")
def reference_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be a reference's value, and what stands in its place without being one."""
    return table(spark, sf_dir, "part").select("p_partkey", references.clean_value(render.pick(_NOISE, F.col("p_partkey"))).alias("value"))


@query("SELECT c_custkey, 'paid at ' || (['HSBC', 'CIMB', 'UOB', 'MAYBANK'])[c_custkey % 4 + 1] AS ocr, 'paid at ' || (['H5BC', 'C1MB', 'U0B', 'MAYB0NK'])[c_custkey % 4 + 1] AS embedded FROM customer")
def bank_token_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What OCR makes of bank names is put right; embedded text is left alone."""
    shown = F.concat(F.lit("paid at "), render.pick(["H5BC", "C1MB", "U0B", "MAYB0NK"], F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", banks.repair(shown, F.lit(True)).alias("ocr"), banks.repair(shown, F.lit(False)).alias("embedded"))


@query(f"""SELECT o_orderkey AS doc_id, {DAY} AS date, CASE o_orderkey % 5 WHEN 4 THEN 3 WHEN 3 THEN 2 ELSE 1 END::INT AS date_tier FROM orders""")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month before day with a comma, dotted ISO, hints after labels, second-rank labels, no label; stamps beside each."""
    o = render.orders_of(spark, sf_dir)
    k, d = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    body = F.when(k == 0, F.concat(F.lit("Value Date "), d("MMM d, yyyy"))).when(k == 1, F.concat(F.lit("Transaction Date : "), d("yyyy.MM.dd"), F.lit(" 10:11:12"))).when(k == 2, F.concat(F.lit("Payment Date (mm-dd-yyyy)\n"), d("MM-dd-yyyy"))).when(k == 3, F.concat(F.lit("Approved Date "), d("dd-MMM-yyyy"))).otherwise(d("d MMMM yyyy"))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("04/08/2026, 07:57 page 1\n"), body, F.lit("\nPrinted On 09/09/2029")).alias("text"))
    return dates.with_date(rows).select("doc_id", "date", "date_tier")
