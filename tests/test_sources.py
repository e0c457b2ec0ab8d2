"""Files in and out, PDF text, engines from outside, and single layouts with traps."""

import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import banks, dates, patterns, references, text
from tallyforge.operators import acquire, evaluation, tokens, training
from tallyforge.operators.extract import extract
from tallyforge.sources import files, pdf


def a_pdf(pages, packed=True):
    """A small file with a page tree whose kids come in another order than their objects."""
    n = len(pages)
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(n))
    out = [b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {n} >> endobj\n".encode()]
    for i in reversed(range(n)):
        body = zlib.compress(pages[i]) if packed else pages[i]
        out.append(f"{10 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >> endobj\n".encode())
        out.append(f"{11 + 2 * i} 0 obj << /Length {len(body)} {'/Filter /FlateDecode ' if packed else ''}>> stream\n".encode() + body + b"\nendstream endobj\n")
    return b"".join(out) + b"trailer << /Root 1 0 R >>"


SHOWN = rb"BT /F1 12 Tf 10 700 Td (RHB Bank) Tj 0 -14 Td [(Amount) -300 (RM ) 20 (5.00)] TJ T* (a \(b\) \101) Tj ET"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(packed):
    assert pdf.page_texts(a_pdf([SHOWN, b"BT <414243> Tj ET"], packed)) == ["RHB Bank\nAmount RM 5.00\na (b) A", "ABC"]
    assert pdf.page_texts(b"no file") == [] and pdf.page_texts(b"%PDF-1.4 broken") == []


def test_pdf_files_and_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(a_pdf([SHOWN, b"BT (page two) Tj ET"]))
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    up = files.uploads(spark, str(tmp_path / "in"))
    got = {r["filename"]: r["error"] for r in files.with_errors(up, pdf.pdf_texts(up.where("accepted"))).collect()}
    assert got == {"a.pdf": None, "b.pdf": "could not be read", "c.txt": "unsupported file type"}
    assert pdf.pdf_texts(up).first()["text"].endswith("A page two")
    assert pdf.pdf_texts(up, headers=True).first()["text"].startswith("=== PAGE 1 ===\nRHB Bank")

    def engine(data):
        return [[{"text": w, "left": 10 * i, "top": 5, "width": 9, "height": 9, "conf": 90, "line_num": 1} for i, w in enumerate(p.split())] for p in pdf.page_texts(data)]

    words = pdf.read_words(up.where("accepted"), engine)
    page = tokens.assemble(words.where("page = 2").withColumnRenamed("path", "doc_id")).first()
    assert page["text"] == "page two" and page["confidence"] == 0.9


def test_history_and_updates(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"id": "1", "amount": "5.00"}, {"id": "2"}]')
    assert files.read_history(spark, str(tmp_path / "h.json")).count() == 2
    assert files.read_history(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "broken.json").write_text("[{")
    assert files.read_history(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "a.jsonl").write_text('{"id": "1", "bank": "RHB"}\n{"id": "2", "bank": "UOB"}\n')
    new = spark.createDataFrame([("2", "HSBC", "x")], "id string, bank string, other string")
    got = files.update_annotations(spark, str(tmp_path / "a.jsonl"), new, str(tmp_path / "out"))
    assert {r["id"]: r["bank"] for r in got.collect()} == {"1": "RHB", "2": "HSBC"}


def test_database_rows(spark):
    rows = spark.createDataFrame([("7", '{"bank": "RHB", "amount": "5.00"}', "UOB", "TX1", "9.00", None), ("8", None, "UOB", None, None, None)], "id string, data string, Bank_Name string, Reference_Id string, amount string, date string")
    assert [tuple(r) for r in files.rows_of(rows).collect()] == [("7", "RHB", "TX1", "5.00", None), ("8", "UOB", None, None, None)]
    results = spark.createDataFrame([(1, "RHB", "TX1", Decimal("5.00"), None)], "doc_id long, bank string, reference_id string, amount decimal(11,2), date date")
    row = files.table_rows(results).first()
    assert (row["id"], row["Bank_Name"], row["amount"]) == ("1", "RHB", "5.00") and '"reference_id":"TX1"' in row["data"]


def test_merged_data(spark):
    rows = spark.createDataFrame([("1", '{"a": "x", "b": "y"}'), ("2", None), ("3", "broken")], "id string, data string")
    new = spark.createDataFrame([("1", '{"b": "z", "c": "w"}'), ("2", '{"a": "q"}')], "id string, data string")
    got = {r["id"]: r["data"] for r in files.merged_data(rows, new).collect()}
    assert got == {"1": '{"a":"x","b":"z","c":"w"}', "2": '{"a":"q"}', "3": "broken"}


def one(spark, body, **options):
    return extract(spark.createDataFrame([(1, body)], "doc_id long, text string"), **options).first().asDict()


def test_issuer_and_receiver(spark):
    r = one(spark, "MAYBANK2U\nTo\nPayee Name X\nBank Name\nRHB BANK")
    assert (r["bank"], r["beneficiary_bank"]) == ("Maybank", "RHB")
    assert one(spark, "Receipt\nRecipient Bank\nHSBC BANK")["bank"] is None
    r = one(spark, "Receipt\nBank Name RHBAMYKLXXX\nReceiving Bank\nRHBAMYKLXXX")
    assert r["beneficiary_bank"] == "RHB Islamic Bank" and r["bank"] is None
    assert one(spark, "paid at H5BC", ocr=F.lit(True))["bank"] == "HSBC" and one(spark, "paid at H5BC")["bank"] is None
    assert one(spark, "OCBC Reference No : 123456 and more\nx\ny")["bank"] == "OCBC"


def test_blocks_and_blanks(spark):
    r = one(spark, "Transaction Reference No.: -\nRecipient Reference : A77")
    assert r["reference_id"] is None and [x["value"] for x in r["references"]] == ["A77"]
    r = one(spark, "Service Charge\nAmount\n1.00 2.00 9\n")
    assert (r["amount"], r["fee"]) == (Decimal("2.00"), Decimal("1.00"))
    # Values too far apart are no block.
    r = one(spark, "Service Charge\nAmount\n1.00" + "x" * 40 + "2.00")
    assert r["amount_source"] == "label:weak"
    r = one(spark, "see your reference below and the payment details here")
    assert r["references"] == []


def test_order_of_contradictory_dates(spark):
    df = spark.createDataFrame([(1, "Value Date 05/06/2024\n25/12/2023 and 12/25/2023"), (2, "Value Date 05/06/2024\n25/12/2023 12/25/2023 on 6 May 2024")], "doc_id long, text string")
    got = {r["doc_id"]: str(r["date"]) for r in dates.with_date(df).collect()}
    # Parts over 12 in both places show nothing; a date with a month's name may still tell.
    assert got == {1: "2024-06-05", 2: "2024-05-06"}
    df = spark.createDataFrame([(1, "Value Date 05/06/2024\nseen May 6, 2024")], "doc_id long, text string")
    assert str(dates.with_date(df).first()["date"]) == "2024-05-06"


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 30_000), (4, "Reference No"), (5, "\x01\x02 $1 \\ 12.34 \\Q \\E"), (6, "Ref No : " * 200)], "doc_id long, text string")
    assert df.count() == extract(df).count() == patterns.extract_by_pattern(df).count()
    assert {r["amount"] for r in extract(df).collect()} == {None}
    assert patterns.extract_by_pattern(df.limit(2)).where("size(all_ids) > 0").count() == 0


def test_labels_of_words(spark):
    df = spark.createDataFrame([(1, "pay ref: AB12345 CD678 to Ann")], "doc_id long, text string")
    row = df.select(tokens.weak_labels(F.col("text"), tokens.text_tokens(F.col("text"))).alias("l"), tokens.align(F.lit([1, 2, 0]), F.lit([2, 1, 3]), 8).alias("a"), tokens.best_alike(tokens.text_tokens(F.col("text")), F.lit("A812345")).alias("b"), tokens.best_entity(F.lit(["ref", "AB12", "AB123456"])).alias("e")).first()
    assert row["l"] == [0, 0, 1, 0, 0, 0] and row["a"] == [1, -100, 2, 0, -100, -100, 0, 0]
    assert (row["b"], row["e"]) == ("AB12345", "AB123456")
    box = df.select(tokens.scaled_boxes(F.array(F.struct(F.lit(50).alias("left"), F.lit(0).alias("top"), F.lit(500).alias("width"), F.lit(10).alias("height"))), F.lit(100), F.lit(100)).alias("x")).first()
    assert box["x"] == [[500, 0, 1000, 100]]


def test_models(spark):
    rows = [(i, f"{w} {i % 3} paid", w, i % 7) for i in range(60) for w in ("alpha bank", "beta bank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bank string, n int")
    model = training.text_model(df, "bank", features=50)
    got = training.bank_of_text(df.limit(10), model).collect()
    assert all(r["bank_guess"] == r["bank"] and r["guess_confidence"] > 0.8 for r in got)
    counted = df.withColumn("len", F.length("text"))
    forest = training.count_model(counted, "bank", ["len", "n"], trees=10, depth=4)
    assert forest.transform(counted).where("predicted = bank").count() > 100
    m = evaluation.weighted_metrics(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "t string, p string"), "t", "p").first()
    assert (m["n"], m["accuracy"], m["precision"], m["recall"]) == (3, 0.6667, 0.8333, 0.6667)


def test_small_functions(spark):
    r = spark.range(1).select(
        text.tolerant_json(F.lit('```json\n{"a": 1}\n```'), "a int")["a"].alias("json"),
        text.context_of(F.lit("x" * 60 + "ab12" + "y" * 60), F.lit("AB12"), 3).alias("context"),
        text.format_pattern(F.lit("numeric_8")).alias("pattern"),
        references.reflow(F.lit("Advice\nReference\nno\n : A1\nend")).alias("flow"),
        acquire.ladder({"embedded": F.lit("(cid:1)"), "pdfplumber": F.lit("z" * 60)})["source"].alias("rung"),
        tokens.first_angle(F.array(F.struct(F.lit(90).alias("angle"), F.array().cast("array<string>").alias("ids")), F.struct(F.lit(180).alias("angle"), F.array(F.lit("A")).alias("ids")))).alias("angle"),
        references.most_certain_reference(F.array(*[F.struct(F.lit(v).alias("value"), F.lit("l").alias("label"), F.lit("bank_primary").alias("role"), F.lit(c).cast("decimal(4,3)").alias("confidence"), F.lit("s").alias("source")) for v, c in (("A", "0.95"), ("B", "0.99"), ("C", "0.99"))]))["value"].alias("sure"),
    ).first()
    assert r["json"] == 1 and r["context"] == "xxxab12yyy" and r["pattern"] == r"\b\d{6,10}\b" and r["flow"] == "Advice Reference no : A1\nend"
    assert (r["rung"], r["angle"], r["sure"]) == ("pdfplumber", 180, "B")
    assert banks.registry(spark).count() > 150
