"""Receipts rendered from orders, customers and the bank registry: text whose fields are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.banks import REGISTRY

_USED = "maybank cimb public_bank rhb hong_leong ambank alliance affin bank_islam bank_rakyat hsbc standard_chartered ocbc uob citibank".split()
BANKS = [next(r for r in REGISTRY if r["key"] == k) for k in _USED]
LAYOUTS = ("inline", "label_above", "weak", "value_above", "currency", "restated_fee")


def bank_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b["name"]) for b in BANKS]), (F.pmod(index, F.lit(len(BANKS))) + 1).cast("int"))


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of orders that receipts are made of; one small file, which would be one task, is dealt out."""
    path, cores = f"{sf_dir}/orders.parquet", spark.sparkContext.defaultParallelism
    orders = spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return orders if len(orders.inputFiles()) >= cores else orders.repartition(4 * cores)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: one receipt for each order, in six layouts, with fees, a print stamp and the payer's reference."""
    orders = orders_of(spark, sf_dir)
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    bank, there = bank_name(F.col("o_custkey")), bank_name(F.col("o_custkey") + 5)
    day = F.col("o_orderdate").cast("date")
    shown = F.element_at(F.array(F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd MMM yyyy"), F.date_format(day, "yyyy-MM-dd")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    shown = F.when(bank == "Citibank", F.date_format(day, "MM/dd/yyyy")).otherwise(shown)
    money = lambda x: F.concat(F.lit("RM "), F.format_number(x, 2))
    layout = F.pmod("o_orderkey", F.lit(len(LAYOUTS)))
    gap = F.when(layout == 1, "\n").otherwise(" : ")
    row = lambda label, value: F.concat(F.lit(label), gap, value)
    fee, tax = F.lit("0.50").cast("decimal(18,2)"), F.lit("0.03").cast("decimal(18,2)")
    main = (
        F.when(layout == 2, row("Amount", money(amount)))
        .when(layout == 3, F.concat(money(amount), F.lit("\nAmount")))
        .when(layout == 4, F.concat(F.lit("Paid "), money(amount)))
        .otherwise(row("Transfer Amount", money(amount)))
    )
    fees = F.concat_ws("\n", row("Service Charges", money(fee)), row("Service Tax Charges", money(tax)), F.when(layout == 5, row("Total Charges", money(fee + tax))))
    head = F.concat_ws("\n", bank, F.lit("Fund Transfer - Interbank GIRO (IBG)"), row("Transaction Date", shown), row("Transaction Reference No", F.concat(F.lit("TX"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))), row("Recipient Reference", F.concat(F.lit("INV"), F.col("o_custkey").cast("string"))))
    people = F.concat_ws("\n", row("From Account Name", F.concat(F.lit("Payer House "), F.col("o_custkey").cast("string"))), row("Beneficiary Name", F.concat(F.lit("Supply Works "), F.col("o_orderkey").cast("string"))), row("Beneficiary Bank", there))
    # The value above its label comes first, so that no other label stands before it.
    body = F.when(layout.isin(3, 4), F.concat_ws("\n", head, people, main, fees)).otherwise(F.concat_ws("\n", head, people, main, fees))
    tail = F.concat_ws("\n", F.when(layout.isin(0, 1, 5), row("Total Debit Amount", money(amount + fee + tax))), F.concat(F.lit("Printed Date/Time "), F.date_format(F.date_add(day, 2), "dd/MM/yyyy"), F.lit(", 10:22")))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", body, tail).alias("text"))


def portal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a block of labels, then a block of values in the same order; a label that isn't asked for takes a place too."""
    o = orders_of(spark, sf_dir)
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    labels = F.lit("Alliance Bank\nProduct Type\nTransaction Reference No.\nRecipient Reference\nPayment Date\nAmount\nService Charge\nTotal Debit Amount")
    values = F.concat_ws("\n", F.lit("Interbank GIRO (IBG)"), F.concat(F.lit("TX"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), F.concat(F.lit("INV "), F.col("o_custkey").cast("string")), F.date_format("o_orderdate", "dd/MM/yyyy"), F.format_number(amount, 2), F.lit("0.50"), F.format_number(amount + F.lit("0.50").cast("decimal(3,2)"), 2))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(labels, F.lit("\n"), values).alias("text"))


def wrapped_advices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: labels broken by a narrow column, and a hint that the month comes first."""
    o = orders_of(spark, sf_dir)
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Maybank2E\nAdvice\nReference\nno\n : MY"), F.lpad(key, 8, "0"), F.lit("X\nValue Date (mm/dd/yyyy) "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("\nAmount\n"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def degraded_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: nothing that can be read, and traps: words like labels in a sentence, a print stamp, an account number."""
    o = orders_of(spark, sf_dir)
    text = F.concat(F.lit("This advice is for your reference only and is not to be relied upon\nacct "), F.lpad(F.col("o_orderkey").cast("string"), 12, "4"), F.lit(" 22 10.55 71\nprinted "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", 07:57"))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


#: What banks print on their own receipts, the bank's name; what others print for them as receivers, the receiver's name.
PRINTED = [
    ("MAYBANK2U.COM", "Maybank", "Malayan Banking Berhad", "Maybank"), ("CIMB Clicks", "CIMB", "CIMB BANK BERHAD", "CIMB"), ("PB enterprise", "Public Bank", "Public Bank Berhad", "Public Bank"), ("RHB Reflex", "RHB", "RHB BANK", "RHB"),
    ("HLB ConnectFirst", "Hong Leong Bank", "HONG LEONG BANK BERHAD", "Hong Leong Bank"), ("AmAccess Biz", "AmBank", "AMBANK (M) BERHAD", "AmBank"), ("allianceBizSmart", "Alliance Bank", "ALLIANCE BANK", "Alliance Bank"), ("AffinAlways", "Affin Bank", "AFFIN BANK", "Affin Bank"),
    ("GO by Bank Islam", "Bank Islam", "BANK ISLAM MALAYSIA", "Bank Islam"), ("i-Muamalat iMuamalat", "Bank Muamalat", "BANK MUAMALAT", "Bank Muamalat"), ("iRakyat", "Bank Rakyat", "BANK KERJASAMA RAKYAT", "Bank Rakyat"), ("myBSN", "BSN", "BANK SIMPANAN NASIONAL", "BSN"),
    ("AGRONet", "Agrobank", "AGROBANK", "Agrobank"), ("Al Rajhi Bank Malaysia", "Al Rajhi Bank", "AL-RAJHI", "Al Rajhi Bank"), ("MBSB Bank Berhad", "MBSB Bank", "MBSB BANK", "MBSB Bank"), ("KFH Online", "Kuwait Finance House", "KUWAIT FINANCE HOUSE", "Kuwait Finance House"),
    ("HSBCnet HSBC", "HSBC", "HSBC BANK MALAYSIA", "HSBC"), ("Straight2Bank", "Standard Chartered", "STANDARD CHARTERED BANK", "Standard Chartered"), ("OCBC Velocity", "OCBC", "OCBC BANK", "OCBC"), ("UOB BIBPlus", "UOB", "UNITED OVERSEAS BANK", "UOB"),
    ("CitiDirect BE", "Citibank", "CITIBANK BERHAD", "Citibank"), ("BNP Paribas Connexis", "BNP Paribas", "BNP PARIBAS MALAYSIA", "BNP Paribas"), ("Maybank Islamic", "Maybank", "MAYBANK ISLAMIC BERHAD", "Maybank Islamic"), ("CIMB Islamic", "CIMB", "CIMB ISLAMIC BANK", "CIMB Islamic"),
    ("Public Islamic Bank", "Public Bank", "PUBLIC ISLAMIC BANK", "Public Islamic Bank"), ("RHB Islamic", "RHB", "RHB ISLAMIC BANK", "RHB Islamic Bank"), ("Hong Leong Islamic", "Hong Leong Bank", "HONG LEONG ISLAMIC BANK", "Hong Leong Islamic Bank"), ("HSBC Amanah", "HSBC", "HSBC AMANAH MALAYSIA", "HSBC Amanah"),
    ("OCBC Al-Amin", "OCBC", "OCBC AL-AMIN BANK", "OCBC Al-Amin"), ("GX Bank", "GXBank", "GXBANK", "GXBank"), ("AEON Bank", "AEON Bank", "AEON BANK", "AEON Bank"), ("Boost Bank", "Boost Bank", "BOOST BANK", "Boost Bank"),
    ("Bank of China", "Bank of China (Malaysia)", "BANK OF CHINA", "Bank of China (Malaysia)"), ("ICBC Malaysia", "ICBC (Malaysia)", "INDUSTRIAL AND COMMERCIAL BANK OF CHINA", "ICBC (Malaysia)"), ("GCMS Plus", "MUFG Bank (Malaysia)", "MUFG BANK", "MUFG Bank (Malaysia)"), ("SMBC e-Moneyger", "Sumitomo Mitsui (Malaysia)", "SUMITOMO MITSUI", "Sumitomo Mitsui (Malaysia)"),
    ("Mizuho Global", "Mizuho Bank (Malaysia)", "MIZUHO BANK", "Mizuho Bank (Malaysia)"), ("Deutsche Bank", "Deutsche Bank (Malaysia)", "DEUTSCHE BANK", "Deutsche Bank (Malaysia)"), ("J.P. Morgan Access", "J.P. Morgan (Malaysia)", "JP MORGAN CHASE", "J.P. Morgan (Malaysia)"), ("EXIM Bank", "EXIM Bank Malaysia", "EXIM BANK", "EXIM Bank Malaysia"),
]
#: Rails: printed like banks, but never banks.
RAILS = ["DuitNow", "JomPAY", "FPX", "RENTAS", "Interbank GIRO", "Touch 'n Go", "GrabPay", "Boost eWallet", "ShopeePay"]


def pick(values: list, index: Column) -> Column:
    """The value of a list at index modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def bank_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: what an issuer prints at the head and a receiver's bank below."""
    o = orders_of(spark, sf_dir)
    text = F.concat(pick([p[0] for p in PRINTED], F.col("o_custkey")), F.lit("\nFund Transfer\nRecipient Bank : "), pick([p[2] for p in PRINTED], F.col("o_orderkey")), F.lit("\nAmount RM 5.00\nThank you"))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
