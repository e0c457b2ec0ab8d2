"""Training data and classifiers: pseudo labels, weights, augmentation, splits, text and count models of pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns

# The gate of pseudo labels, the least quality, the weight of a pseudo label, what OCR takes characters for.
LEAST_CONFIDENCE, LEAST_QUALITY, PSEUDO_WEIGHT = "0.85", "0.7", "0.5"
NO_IDS = ["REFERENCE", "TRANSACTION", "PAYMENT", "TRANSFER", "MAYBANK", "CIMB", "PUBLIC", "RHB", "DUITNOW"]
CONFUSED = {"0": "ODQ", "O": "0QD", "1": "Il|", "I": "1l|", "l": "1I|", "5": "S8", "S": "58", "8": "B35", "B": "83", "2": "Z", "Z": "2", "6": "Gb", "G": "6C", "C": "GO"}
# End of fixed values.
DEC = "decimal(6,4)"


def passes_gate(bank: Column, transaction_id: Column, confidence: Column) -> Column:
    """An extraction that may serve as a label: a bank, a sure and well-formed id with a digit."""
    v = F.upper(F.regexp_replace(transaction_id, "[ ']", ""))
    form = v.rlike(r"^[A-Z0-9\-_/]{6,30}$") & ~v.isin(NO_IDS) & F.length(transaction_id).between(6, 25) & transaction_id.rlike("[0-9]")
    return F.coalesce((bank != "Unknown") & (confidence >= F.lit(LEAST_CONFIDENCE).cast(DEC)) & form, F.lit(False))


def quality(bank: Column, transaction_id: Column, confidence: Column, ocr_confidence: Column) -> Column:
    """Half the confidence, a fifth of OCR's (0 to 100), up to a tenth for an id's length, a tenth for letters in it, a tenth for a bank; one at most."""
    d = lambda x: F.lit(x).cast(DEC)
    v = F.coalesce(transaction_id, F.lit(""))
    parts = confidence.cast(DEC) * d("0.5") + ocr_confidence.cast(DEC) / 100 * d("0.2") + F.when(v != "", F.least(F.length(v).cast("decimal(4,0)") / 15, F.lit(1).cast("decimal(4,0)")) * d("0.1")).otherwise(d("0"))
    parts = parts + F.when((v != "") & F.regexp_replace(v, " ", "").rlike("[^0-9]"), d("0.1")).otherwise(d("0")) + F.when(F.coalesce(bank, F.lit("")) != "Unknown", d("0.1")).otherwise(d("0"))
    return F.least(parts.cast("decimal(12,8)"), F.lit(1).cast("decimal(12,8)")).cast(DEC)


def pseudo_labels(extracted: DataFrame, top_k: int | None = None) -> DataFrame:
    """Rows of extracted (doc_id, bank_name, transaction_id, confidence, ocr_confidence) that pass the gate, with quality, the best first."""
    ok = extracted.where(passes_gate(F.col("bank_name"), F.col("transaction_id"), F.col("confidence")))
    ok = ok.withColumn("quality", quality(F.col("bank_name"), F.col("transaction_id"), F.col("confidence"), F.col("ocr_confidence"))).where(F.col("quality") >= F.lit(LEAST_QUALITY).cast(DEC))
    ranked = ok.orderBy(F.desc("quality"), "doc_id")
    return ranked if top_k is None else ranked.limit(top_k)


def weighted_union(labelled: DataFrame, pseudo: DataFrame) -> DataFrame:
    """doc_id, weight: one for labelled rows, half the confidence for pseudo labels (a half where there is none)."""
    own = labelled.select("doc_id", F.lit(1).cast(DEC).alias("weight"))
    return own.unionByName(pseudo.select("doc_id", (F.coalesce(F.col("confidence").cast(DEC), F.lit("0.5").cast(DEC)) * F.lit(PSEUDO_WEIGHT).cast(DEC)).cast(DEC).alias("weight")))


def misread(text: Column, seed: Column, per_thousand: int = 50) -> Column:
    """Text in which about so many of a thousand confusable characters are taken for others; the same for the same seed."""
    table = F.create_map(*[F.lit(x) for kv in CONFUSED.items() for x in kv])
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def read(c: Column, i: Column) -> Column:
        others = F.try_element_at(table, c)
        draw = F.pmod(F.xxhash64(seed, i), F.lit(1000))
        which = (F.pmod(F.xxhash64(seed, i, F.lit("which")), F.length(others)) + 1).cast("int")
        return F.when(others.isNotNull() & (draw < per_thousand), F.substring(others, which, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, read), "")


def augmented(rows: DataFrame, copies: int = 3, per_thousand: int = 50, seed: int = 42) -> DataFrame:
    """Every row as it is (variant 0), and misread copies that differ from it."""
    many = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("variant"))
    own = F.when(F.col("variant") == 0, F.col("text")).otherwise(misread(F.col("text"), F.xxhash64(F.lit(seed), "doc_id", "variant"), per_thousand))
    return many.withColumn("read", own).where("variant = 0 or read <> text").drop("text").withColumnRenamed("read", "text")


def split_rows(rows: DataFrame, key: str, parts: dict[str, int], seed: int = 42, least: int = 10) -> DataFrame:
    """Adds split by an md5 of seed and key, which other engines have too; with fewer rows than least there is nothing to learn: an error."""
    if rows.limit(least).count() < least:
        raise ValueError(f"at least {least} rows are needed")
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % sum(parts.values())
    out, upto = F.lit(None).cast("string"), sum(parts.values())
    for name, n in reversed(parts.items()):
        out, upto = F.when(h < upto, name).otherwise(out), upto - n
    return rows.withColumn("split", out)


def text_model(rows: DataFrame, label: str, features: int = 5000, weight: str | None = None) -> PipelineModel:
    """TF-IDF of words and pairs of words, and a logistic regression; rows: text, label."""
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(rows)
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\W+"),
        NGram(n=2, inputCol="_w", outputCol="_w2"),
        CountVectorizer(inputCol="_w", outputCol="_c", vocabSize=features // 2),
        CountVectorizer(inputCol="_w2", outputCol="_c2", vocabSize=features // 2),
        IDF(inputCol="_c", outputCol="_f"),
        IDF(inputCol="_c2", outputCol="_f2"),
        VectorAssembler(inputCols=["_f", "_f2"], outputCol="_x"),
        index,
        LogisticRegression(featuresCol="_x", labelCol="_label", predictionCol="_p", maxIter=50, regParam=0.001, **({"weightCol": weight} if weight else {})),
        IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(rows)


def count_model(rows: DataFrame, label: str, columns: list[str], trees: int = 500, depth: int = 20, seed: int = 42) -> PipelineModel:
    """A random forest over count columns."""
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(rows)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), index, forest, IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)]).fit(rows)


def bank_of_text(rows: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Adds bank_guess and guess_confidence: the model's where there is one, else the older engine's name (0.9), unknown for empty text (0)."""
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    if model is None:
        return rows.withColumns({"bank_guess": F.when(empty, "unknown").otherwise(patterns.detect_bank(F.col("text"))), "guess_confidence": F.when(empty, 0.0).otherwise(0.9)})
    from pyspark.ml.functions import vector_to_array

    labels = next(s for s in model.stages if hasattr(s, "labels")).labels
    # Rows to be guessed need no label: the indexer is left out.
    out = rows
    for stage in model.stages:
        if not hasattr(stage, "labelsArray"):
            out = stage.transform(out)
    sure = F.array_max(vector_to_array("probability"))
    kept = out.withColumns({"bank_guess": F.when(empty, "unknown").otherwise(F.col("predicted")), "guess_confidence": F.when(empty, 0.0).otherwise(sure)})
    return kept.select(*rows.columns, "bank_guess", "guess_confidence") if labels else kept


def or_fallback(guess: Column, confidence: Column, other: Column, other_confidence: Column, least: float = 0.7) -> tuple[Column, Column]:
    """A model's (guess, confidence) unless it is unsure and the other one is surer."""
    take = (confidence < least) & (other_confidence > confidence)
    return F.when(take, other).otherwise(guess), F.when(take, other_confidence).otherwise(confidence)
