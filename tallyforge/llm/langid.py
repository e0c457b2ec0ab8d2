"""Operator 1, language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound
as rot(rot(a)) * rot(b) * c (rot: cyclic shift), a document is the bundle (sum) of its
trigrams, a language the bundle of its training documents, each scaled to length 1 by its
number of trigrams. Documents are compared with the languages by cosine.

Letters are lower-cased; each run of other characters counts as one separator, also at both
ends, so one letter is enough. Very long texts are bundled in segments: sums of vectors
don't depend on the cut. Null texts and those without a letter are `und` with score 0; if
nothing could be learned, all are. Ties go to the first language by name. Repeated rows
each get a row; an empty table gives none. Null languages are not learned from.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, remainder

DIM, SEGMENT, ROWS = 1024, 1 << 19, 128
_LETTERS: list = []


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter; made once in a process."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _LETTERS[0]


class Space:
    """Vectors of letters and trigrams."""

    def __init__(self, dim: int = DIM, seed: int = 11):
        self.dim, self.seed, self._letters = dim, seed, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            if len(self._letters) > 20_000:
                self._letters.clear()
            rng = np.random.Generator(np.random.PCG64([self.seed, int(code)]))
            self._letters[code] = (2 * rng.integers(0, 2, self.dim) - 1).astype(np.float32)
        return self._letters[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of trigrams (rows of three code points)."""
        codes, at = np.unique(grams, return_inverse=True)
        at = at.reshape(grams.shape)
        table = np.stack([self.letter(c) for c in codes])
        out = np.roll(table, 2, axis=1)[at[:, 0]]
        out *= np.roll(table, 1, axis=1)[at[:, 1]]
        out *= table[at[:, 2]]
        return out


def codes_of(text: str) -> np.ndarray:
    """Code points of the letters, lower-cased, with 0 for separators, also at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letter_table()[c], c, 0)
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, counts): distinct trigrams of the texts and a matrix texts x trigrams."""
    codes = [codes_of(t) for t in texts]
    sizes = np.array([max(len(c) - 2, 0) for c in codes])
    flat = np.concatenate(codes)
    letters, ids = np.unique(flat, return_inverse=True) if len(flat) < 1000 else _ids(flat)
    k = len(letters)
    starts = np.cumsum([0, *[len(c) for c in codes]])
    keep = np.ones(len(flat), bool)
    for e in starts[1:]:
        keep[max(e - 2, 0) : e] = False
    pos = np.flatnonzero(keep)
    ids = ids.astype(np.int64)
    gram = (ids[pos] * k + ids[pos + 1]) * k + ids[pos + 2]
    if k <= 160:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        rank = np.zeros(seen[-1] + 1 if len(seen) else 1, np.int64)
        rank[seen] = np.arange(len(seen))
        rank = rank[gram]
    else:
        seen, rank = np.unique(gram, return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(doc * max(len(seen), 1) + rank, minlength=len(texts) * max(len(seen), 1)).reshape(len(texts), -1)
    grams = np.stack([letters[seen // (k * k)], letters[seen // k % k], letters[seen % k]], axis=1)
    return grams, counts


def _ids(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = int(flat.max())
    have = np.zeros(top + 1, bool)
    have[flat] = True
    letters = np.flatnonzero(have).astype(np.uint32)
    ids = np.zeros(top + 1, np.int32)
    ids[letters] = np.arange(len(letters))
    return letters, ids[flat]


def segmented(texts: list[str]):
    """(row, segment) of all texts, long ones in segments that share two characters."""
    for i, t in enumerate(texts):
        for a in range(0, max(len(t), 1), SEGMENT):
            yield i, t[a : a + SEGMENT + 2]


def bundles(texts: list[str], space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, numbers of trigrams) of texts."""
    out, n = np.zeros((len(texts), space.dim), np.float32), np.zeros(len(texts), np.int64)
    parts = list(segmented(texts))
    for a, b in by_bytes([p for _, p in parts], SEGMENT):
        for c in range(a, b, ROWS):
            rows = [i for i, _ in parts[c : min(b, c + ROWS)]]
            grams, counts = gram_counts([p for _, p in parts[c : min(b, c + ROWS)]])
            if len(grams):
                np.add.at(out, rows, counts.astype(np.float32) @ space.bind(grams))
                np.add.at(n, rows, counts.sum(1))
    return out, n


def profiles(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype of each language from all rows of docs (text, lang); languages x partitions rows are shuffled."""

    def run(batches):
        space, sums = Space(dim), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts, SEGMENT):
                for c in range(a, b, ROWS):
                    some = list(segmented(texts[c : min(b, c + ROWS)]))
                    for x, y in by_bytes([p for _, p in some], SEGMENT):
                        grams, counts = gram_counts([p for _, p in some[x:y]])
                        if not len(grams):
                            continue
                        names = sorted({langs[c + i] for i, _ in some[x:y]})
                        scaled = counts / np.maximum(counts.sum(1, keepdims=True), 1)
                        own = np.array([names.index(langs[c + i]) for i, _ in some[x:y]])
                        per = np.stack([scaled[own == k].sum(0) for k in range(len(names))]).astype(np.float32) @ space.bind(grams)
                        for k, name in enumerate(names):
                            sums[name] = sums.get(name, 0) + per[k].astype(np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k].tolist() for k in names], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    total = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in total.collect():
        out.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["x"]
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 at least) of every row."""
    names = sorted(k for k, v in profiles.items() if np.linalg.norm(v) > 0)
    table = np.stack([profiles[k] / np.linalg.norm(profiles[k]) for k in names]).astype(np.float32) if names else None
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        (names, table), space, letter = shared.value, Space(dim), letter_table()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score = [], []
            for a, b in by_bytes(texts, 8 * SEGMENT):
                for c in range(a, b, 2048):
                    some = texts[c : min(b, c + 2048)]
                    v, n = bundles(some, space)
                    if table is None:
                        pred += ["und"] * len(some)
                        score += [0.0] * len(some)
                        continue
                    cos = (v @ table.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    best = cos.argmax(1)
                    none = n == 0
                    pred += ["und" if e else names[k] for k, e in zip(best, none)]
                    score += np.where(none, 0, np.clip(cos.max(1), 0, 1)).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def language_id(docs: DataFrame, modulus: int = 3, held: int = 1, dim: int = DIM) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that aren't held out."""
    out = remainder("doc_id", modulus) == held
    found = identify(docs, profiles(docs.where(~out), dim), dim)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
