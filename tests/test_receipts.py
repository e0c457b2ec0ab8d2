"""Receipt fields, on written-out layouts with traps, and the registered queries against SQL."""

import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import banks, dates, merge, text
from tallyforge.operators import training
from tallyforge.operators.extract import extract, references_by_role
from tallyforge.plans.queries import QUERIES, SQL
from tallyforge.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def one(spark, body, step=extract):
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    return step(df).first().asDict()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want, key=key)


def test_fee_and_total_are_never_the_amount(spark):
    r = one(spark, "RHB\nTotal Debit Amount : RM 101.00\nService Charge : RM 1.00\nDebit Amount : RM 100.00")
    assert (r["amount"], r["fee"], r["total_debit"]) == (Decimal("100.00"), Decimal("1.00"), Decimal("101.00"))
    r = one(spark, "Service Charge RM 1.00")
    assert r["amount"] is None and "amount" in r["fields_absent"] and r["amount_confidence"] == 0
    # A total beside its own label is left for the currency's sake only: hardly sure.
    r = one(spark, "Service Charge RM 1.00\nTotal Debit Amount RM 5.00")
    assert (r["amount"], r["amount_source"], r["amount_confidence"]) == (Decimal("5.00"), "currency_prefix:RM", Decimal("0.650"))


def test_account_fragments_are_not_money(spark):
    assert one(spark, "Account 1234-55.10-2\nAmount\nnone")["amount"] is None


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("Citibank\nTransaction Date : 03/04/2024", datetime.date(2024, 3, 4)),
        ("RHB\nTransaction Date : 03/04/2024", datetime.date(2024, 4, 3)),
        ("Value Date : 25 Dec 2023\nTransaction Date : 24 Dec 2023", datetime.date(2023, 12, 25)),
        ("Printed Date/Time 01/02/2024, 10:22", None),
        ("Generated on 01/02/2024\nby the branch in the capital, and later seen 05/02/2024", datetime.date(2024, 2, 5)),
        ("Payment Date 31/02/2024", None),
        ("Payment Date 01/02/99", datetime.date(1999, 2, 1)),
        ("Payment Date 01/02/24", datetime.date(2024, 2, 1)),
    ],
)
def test_dates(spark, body, want):
    assert one(spark, body)["date"] == want


def test_references(spark):
    r = one(spark, "Recipient Reference : Rent 5\nBank Reference : BR9\nTransaction Reference No : TX1\nPayNet Reference : PN2\nPayment Reference : tx1")
    assert r["reference_id"] == "TX1"
    assert [(x["value"], x["role"]) for x in r["references"]] == [("Rent 5", "payer_supplied"), ("BR9", "bank_secondary"), ("TX1", "bank_primary"), ("PN2", "bank_secondary")]
    assert one(spark, "Recipient Reference : ABC123")["reference_id"] is None
    got = references_by_role(extract(spark.createDataFrame([(1, "Recipient Reference : A1\nRemark : B2")], "doc_id long, text string"))).first()
    assert {k: [r["value"] for r in v] for k, v in got["references_by_role"].items()} == {"bank_primary": [], "bank_secondary": [], "payer_supplied": ["A1", "B2"]}


def test_names_are_not_references(spark):
    r = one(spark, "From Account Name : Blue Moon Trading Sdn Bhd\nRecipient Reference : Blue Moon\nRemark : June rent")
    assert [x["value"] for x in r["references"]] == ["June rent"] and r["payer"].startswith("Blue Moon")


def test_banks(spark):
    r = one(spark, "CIMB Islamic\nBeneficiary Bank : Maybank Islamic")
    assert (r["bank"], r["beneficiary_bank"]) == ("CIMB", "Maybank Islamic")
    assert one(spark, "Interbank GIRO via PayNet")["bank"] is None
    assert one(spark, "sent by HBMBMYKLXXX")["bank"] == "HSBC"


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 30_000), (4, "Amount RM"), (5, "\x01\x02 $1 \\ 12.34")], "doc_id long, text string")
    assert {r["amount"] for r in extract(df).collect()} == {None}


def test_merge_and_normalize(spark):
    m = spark.range(1).select(merge.merge("amount", F.lit("RM 1,200.00"), F.lit("1200.00")).alias("m"), text.similarity(F.lit("abc"), F.lit("abd")).alias("s"), text.normalize(F.lit("Ref#1:aaab ---- c")).alias("n")).first()
    assert m["m"]["source"] == "both" and m["s"] == Decimal("0.9667") and m["n"] == "Ref # 1 : ab - c"


def test_month_first_by_evidence(spark):
    df = spark.createDataFrame([(1, "Transaction Date : 03/04/2024\nseen 03/25/2024")], "doc_id long, text string")
    assert dates.with_date(df).first()["date"] == datetime.date(2024, 3, 4)
    assert banks.registry(spark).count() > 30


def test_split(spark):
    got = training.split_rows(spark.range(2000), "id", {"train": 70, "validate": 10, "test": 20}).groupBy("split").count().collect()
    share = {r["split"]: r["count"] / 2000 for r in got}
    assert abs(share["train"] - 0.7) < 0.05 and abs(share["validate"] - 0.1) < 0.05 and abs(share["test"] - 0.2) < 0.05
    with pytest.raises(ValueError, match="at least 10"):
        training.split_rows(spark.range(9), "id", {"a": 1, "b": 1})


def test_files_and_feed(spark, tmp_path):
    up = tmp_path / "up" / "deep"
    up.mkdir(parents=True)
    (up / "a.PDF").write_bytes(b"x")
    (up / "b.txt").write_bytes(b"y")
    got = {r["filename"]: r["accepted"] for r in files.uploads(spark, str(tmp_path / "up")).collect()}
    assert got == {"a.PDF": True, "b.txt": False}
    assert files.new_files(files.uploads(spark, str(tmp_path / "up")), spark.createDataFrame([("a.PDF",)], "filename string")).count() == 1
    (tmp_path / "n.json").write_text('{"id": "1", "bank": "RHB"}\n\nnot json\n{"id": "2"}\n')
    assert files.read_annotations(spark, str(tmp_path / "n.json")).where("id is not null").count() == 2
    results = extract(spark.createDataFrame([(1, "RHB\nTransaction Reference : TX1\nRemark : A9\nAmount RM 5.00")], "doc_id long, text string"))
    files.write_export(results, str(tmp_path / "csv"))
    row = spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()
    assert (row["bank_references"], row["payer_references"], row["amount"]) == ("TX1", "A9", "5.00")

    from tallyforge.streaming.feed import run_feed, text_feed

    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.json").write_text('{"doc_id": %d, "text": "RHB\\nAmount RM %d.00"}\n' % (k, k))
        run_feed(text_feed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r["amount"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [Decimal("1.00"), Decimal("2.00")]
