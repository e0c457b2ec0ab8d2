"""Files in and out: uploads, annotations, history and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

# Types that are taken, the shortest text that counts.
UPLOAD_TYPES = ("pdf", "jpg", "jpeg", "png")
LEAST_TEXT = 5
# End of fixed values.
ANNOTATION = "id string, filename string, bank string, reference_id string, transaction_date string, amount string, ocr_text string, ground_truth map<string,string>"
EXPORT = ["doc_id", "bank", "reference_id", "bank_references", "payer_references", "date", "amount", "fee", "total_debit", "payer", "beneficiary", "beneficiary_bank", "payment_mode"]


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Every file below path: path, filename, extension, size, content; accepted says whether its type is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    return files.select("path", name.alias("filename"), ext.alias("extension"), F.col("length").alias("size"), "content", ext.isin(*UPLOAD_TYPES).alias("accepted"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose name isn't known yet."""
    return files.join(known.select("filename").distinct(), "filename", "left_anti")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(ANNOTATION).option("mode", "DROPMALFORMED").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries; a missing or unreadable file is an empty history."""
    schema = "id string, timestamp string, filename string, bank_name string, reference_id string, amount string, date string, confidence double, status string, notes string"
    try:
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).where("id is not null")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def history_entries(results: DataFrame) -> DataFrame:
    """Entries of the history: success where there is a reference, else warning."""
    return results.withColumn("status", F.when(F.col("reference_id").isNotNull() & (F.col("reference_id") != ""), "success").otherwise("warning"))


def update_annotations(spark: SparkSession, path: str, updates: DataFrame, out: str) -> DataFrame:
    """Annotations with the updates (id and any of their columns) put in; written to another folder, since the old one is read."""
    from ..operators.relational import update_known

    update_known(read_annotations(spark, path), updates, "id").write.mode("overwrite").json(out)
    return read_annotations(spark, out)


def read_rows(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """Rows of a database table, their JSON column `data` before their own columns; id filled from the row."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return rows_of(rows)


def rows_of(rows: DataFrame) -> DataFrame:
    """id, bank, reference_id, amount, date of rows (id, data as JSON, Bank_Name, Reference_Id, amount, date)."""
    data = lambda key: F.get_json_object("data", f"$.{key}")
    own = {"bank": "Bank_Name", "reference_id": "Reference_Id", "amount": "amount", "date": "date"}
    return rows.select(F.coalesce(data("id"), F.col("id").cast("string")).alias("id"), *[F.coalesce(data(k), F.col(c).cast("string")).alias(k) for k, c in own.items()])


def write_rows(results: DataFrame, url: str, name: str, **options: str) -> None:
    """Appends id, the whole row as JSON, and the four columns of its own to a database table."""
    table_rows(results).write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()


def table_rows(results: DataFrame) -> DataFrame:
    whole = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    return results.select(F.col("doc_id").cast("string").alias("id"), whole.alias("data"), F.col("bank").alias("Bank_Name"), F.col("reference_id").alias("Reference_Id"), F.col("amount").cast("string").alias("amount"), F.col("date").cast("string").alias("date"))


def merged_data(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """rows (id, data as JSON) with the keys of updates (id, data) put over their own; other rows as they are."""
    own, new = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in ("data", "_new"))
    over = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    joined = rows.join(updates.select("id", F.col("data").alias("_new")), "id", "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.to_json(over)).otherwise(F.col("data")).alias("data") if c == "data" else c for c in rows.columns])


def with_errors(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Every file with its text or why there is none: refused type, unreadable, too short."""
    joined = files.drop("content").join(texts.select("path", "text"), "path", "left")
    why = F.when(~F.col("accepted"), "unsupported file type").when(F.col("text").isNull(), "could not be read").when(F.length(F.trim("text")) < LEAST_TEXT, "could not extract text")
    return joined.withColumn("error", why)


def append_annotations(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_rows(results: DataFrame) -> DataFrame:
    """The thirteen columns of the export; references by who gave them, joined by a bar."""
    of = lambda bank: F.array_join(F.transform(F.filter("references", lambda r: r["role"].startswith("bank_") == F.lit(bank)), lambda r: r["value"]), " | ")
    return results.withColumn("bank_references", of(True)).withColumn("payer_references", of(False)).select(*[F.col(c).cast("string").alias(c) for c in EXPORT])


def write_export(results: DataFrame, path: str) -> None:
    export_rows(results).write.mode("overwrite").option("header", "true").csv(path)
