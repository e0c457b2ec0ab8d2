"""Operator 6, language-model scores: a gated recurrent model with a class-factored softmax.

Word counts of all training documents are shuffled once and kept as a table. Its `top` most
frequent words (a fixed bound, at most 64 bytes each) go to the executors as a dictionary;
other words of a document are joined to the table, so nothing that grows is broadcast.

The model (gru.py) predicts each token from the state, which goes on across windows to the
end of a document: the class, then the word in it. Words outside its vocabulary belong to
one of 32 bucket classes by their last bytes; within a bucket a word has the probability
(c + 0.5) / (N_b + 0.5 (V_b + 1)), from the counts of the whole training corpus.

Counts and network are learned from all training text. Trainers of about `per_trainer` tokens
each start from the same weights, pass once over their documents, and write their weights,
which are averaged by tokens, 32 at a time: first for an eighth of the documents, then, from
that average, for all others. What the weights become depends on how documents are dealt to
tasks; nothing else does.

Null text counts as empty (the end token alone). Repeated rows each get a row. Without
training documents all counts are 0. An empty table gives no rows.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, remainder
from .gru import Gru, Trainer

BUCKETS, LONGEST = 32, 64


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def word_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """word, c of all rows; each task adds up its words first."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Known:
    """What executors need: the dictionary of frequent words, their counts, and the model."""

    def __init__(self, top: list[tuple[bytes, int]], vocabulary: int, ends: int, masses: np.ndarray, kinds: np.ndarray):
        """top: frequent words by falling count; masses, kinds: training tokens and words of each bucket, vocabulary left out."""
        self.ids = {w: i + 1 for i, (w, _) in enumerate(top)}  # 0 is the end
        self.words = min(len(top) + 1, vocabulary)
        counts = np.array([ends, *[c for _, c in top]], float)
        self.log_count = np.log10(counts + 0.5)
        self.seen = counts > 0
        self.inputs = np.array([i if i < self.words else self.words + bucket(top[i - 1][0]) for i in range(len(top) + 1)], np.int32)
        self.bucket_base = np.log10(masses + 0.5 * (kinds + 1))
        self.model = Gru(counts[: self.words], masses)

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(model ids, dictionary ids or -1, words outside the dictionary) of a text with its end."""
        words = tokens(text)
        at = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int32, len(words))
        rare = np.flatnonzero(at < 0)
        ids = self.inputs[at]
        odd = [words[i] for i in rare]
        if len(rare):
            ids[rare] = [self.words + bucket(w) for w in odd]
        return np.append(ids, np.int32(0)), np.append(at, np.int32(0)), odd


ROW = T.StructType([T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_top", T.LongType()), ("base_top", T.DoubleType()), ("lm_top", T.DoubleType()), ("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.IntegerType())]))))])


def read_and_score(docs: DataFrame, known, hold: int = 3_000_000) -> DataFrame:
    """Keeps doc_id and held_out; adds what the dictionary and the model give, and the words still to be joined."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *ROW.fields])

    def run(batches):
        k = known.value
        item = pa.struct([("word", pa.binary()), ("n", pa.int32())])
        kept: list = []
        size = 0

        def out():
            lm = k.model.score([d[0] for d in kept]) / np.log(10)
            n, top, base, words, numbers, offsets = [], [], [], [], [], [0]
            for j, (ids, at, odd) in enumerate(kept):
                have = at[at >= 0]
                n.append(len(ids))
                top.append(int(k.seen[have].sum()))
                base.append(float(k.log_count[have].sum()))
                tail = ids[ids >= k.words] - k.words
                lm[j] += k.log_count[have[have >= k.words]].sum() - k.bucket_base[tail].sum()
                tf = Counter(odd)
                words += tf
                numbers += tf.values()
                offsets.append(len(words))
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(numbers, pa.int32())], fields=list(item)))
            return [pa.array(n, pa.int64()), pa.array(top, pa.int64()), pa.array(base, pa.float64()), pa.array(lm, pa.float64()), rare]

        owners: list = []
        for batch in batches:
            texts = batch.column(2)
            kept += [k.read(texts[i].as_py()) for i in range(batch.num_rows)]
            owners.append(batch.select([0, 1]))
            size += sum(len(d[0]) for d in kept[-batch.num_rows :]) if batch.num_rows else 0
            if size >= hold:
                yield _with(owners, out(), schema)
                kept.clear()
                owners, size = [], 0
        if kept:
            yield _with(owners, out(), schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _with(owners: list, columns: list, schema: T.StructType) -> pa.RecordBatch:
    own = pa.Table.from_batches(owners).combine_chunks()
    first = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in own.columns]
    return pa.RecordBatch.from_arrays([*first, *columns], names=schema.fieldNames())


def top_words(counts: DataFrame, top: int) -> list[tuple[bytes, int]]:
    """At most `top` of the most frequent words, of those as long as LONGEST at most, by falling count.

    How many words have about the same count (eight classes to each doubling) decides from which
    count on words are taken, so only words that are taken leave the executors.
    """
    known = counts.where(F.length("word") <= LONGEST).withColumn("kind", F.floor(F.log2("c") * 8))
    taken = 0
    least = None
    for r in sorted(known.groupBy("kind").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["kind"]):
        taken += r["n"]
        if taken > top:
            break
        least = r["kind"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in known.where(F.col("kind") >= least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def trained(train: DataFrame, known, trainers: int, expected: int, hold: int = 1_000_000) -> DataFrame:
    """n, weights: what each trainer makes of the broadcast model with its part of the texts, and from how many tokens."""

    def run(batches):
        k = known.value
        model = copy.deepcopy(k.model)
        model.load(model.flat.copy())
        trainer, kept, size, n = Trainer(model, expected), [], 0, 0
        for batch in batches:
            for t in batch.column(0):
                kept.append(k.read(t.as_py())[0])
                size += len(kept[-1])
                if size >= hold:
                    trainer.feed(kept)
                    kept, n, size = [], n + size, 0
        if kept:
            trainer.feed(kept)
        if n + size:
            yield pa.RecordBatch.from_arrays([pa.array([n + size], pa.int64()), pa.array([model.flat.tobytes()], pa.binary())], names=["n", "weights"])

    return train.select("text").coalesce(trainers).mapInArrow(run, "n long, weights binary")


def averaged(models: DataFrame, at_once: int = 32) -> np.ndarray | None:
    """The mean of the weights by their tokens; where there are many, executors add them up, `at_once` in a task."""

    def mean(rows) -> tuple[int, np.ndarray]:
        n, total = 0, np.zeros(0)
        for own, weights in rows:
            part = own * np.frombuffer(weights, np.float32).astype(np.float64)
            n, total = n + own, total + part if n else part
        return n, (total / max(n, 1)).astype(np.float32)

    def run(batches):
        n, weights = mean(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["n", "weights"])

    while (count := models.count()) > at_once:
        less = materialize(models.repartition(-(-count // at_once)).mapInArrow(run, models.schema), "models")
        forget(models)
        models = less
    rows = sorted((r["n"], bytes(r["weights"])) for r in models.collect())
    forget(models)
    return mean(rows)[1] if rows else None


def fit(train: DataFrame, counts: DataFrame, top: int, vocabulary: int, per_trainer: int, first: int = 8) -> tuple[Known, int, int]:
    """(what executors need, N, V)."""
    ends = train.count()
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = (total[0] or 0) + ends, total[1] + (ends > 0)
    best = top_words(counts, top)
    own = F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % BUCKETS
    masses, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy(own.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        masses[r["b"]], kinds[r["b"]] = r["c"], r["k"]
    for w, c in best[: vocabulary - 1]:
        masses[bucket(w)] -= c
        kinds[bucket(w)] -= 1
    known = Known(best, vocabulary, ends, masses, kinds)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(first)) == 0
    for rows, share in ((train.where(part), n // first), (train.where(~part), n - n // first)):
        shared = train.sparkSession.sparkContext.broadcast(known)
        trainers = max(1, -(-share // per_trainer))
        weights = averaged(materialize(trained(rows, shared, trainers, share // trainers), "models"))
        shared.destroy()
        if weights is not None:
            known.model.load(weights)
    return known, n, v


def lm_scores(docs: DataFrame, modulus: int = 5, held: int = 1, top: int = 150_000, vocabulary: int = 1024, per_trainer: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "text")
    train = rows.where("not held_out")
    counts = materialize(word_counts(train), "counts")
    known, n, v = fit(train, counts, top, vocabulary, per_trainer)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    scored = materialize(read_and_score(rows, shared).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n")
    joined = rare.join(counts, "word", "left").select("rid", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("x"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("k"))
    sums = joined.groupBy("rid").agg(F.sum("x").alias("x"), F.sum("k").alias("k"))
    whole = scored.drop("rare").join(sums, "rid", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    base = F.lit(float(np.log10(n + 0.5 * (v + 1)))) * F.col("n_tokens")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_top") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base_top") + F.col("x") - base).alias("base_score"), (F.col("lm_top") + F.col("x")).alias("score"))
