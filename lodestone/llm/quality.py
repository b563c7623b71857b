"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are hashed n-grams of lower-cased words (n = 1, 2) and of word forms (n = 1, 2, 3), where a word's form is its
outline of letter cases, digits and signs, marked where the word equals the one before it.  Each of the five families is
scaled to length one, so a document is a sparse vector; its score is the logistic function of the sparse dot product
with the weights.

Training rows are a bounded sample: the MAX_TRAIN_ROWS labelled documents with the smallest hash of their id.  Their
sparse vectors are built on the executors; one task runs the sequential updates over them and returns the weights, a
table of at most 2^BITS rows.  Scoring broadcasts these weights (1 MB) and reads every document.

Cases: a null or empty text has the bias alone and still gets a score; labels that are null, and label rows without a
document, are not used; a document with several label rows is used once for each; without any label row, all scores are
0.5; an empty table gives an empty result; extra columns are ignored by `score` and kept by `keep_good`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, small_batches, splitmix, tidy, words_of

BITS, MAX_TRAIN_ROWS, EPOCHS, THRESHOLD = 18, 12_000, 3, 0.3
#: Follow-the-regularised-leader: learning rate and its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
HOLD_OUT = 5

_FORM = [(re.compile("[^\\W\\d_]+"), None), (re.compile(r"\d+"), "0")]


def _form(word: str) -> str:
    def letters(m: re.Match) -> str:
        run = m[0]
        return "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "C" if run[0].isupper() and (len(run) == 1 or run[1:].islower()) else "x"

    return _FORM[1][0].sub("0", _FORM[0][0].sub(letters, word))


class Vectoriser:
    """Sparse vectors of texts, with a bounded cache of word hashes."""

    def __init__(self, bits: int = BITS) -> None:
        import xxhash

        self.shift, self.hash, self.seen = np.uint64(64 - bits), xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(text) if text else []
        bias = (np.zeros(1, np.int32), np.ones(1, np.float32))
        if not words:
            return bias
        seen = self.seen
        if len(seen) > 200_000:
            seen.clear()
        for w in set(words):
            if w not in seen:
                form = _form(w.decode("utf-8", "surrogatepass"))
                seen[w] = (self.hash(w.lower()), self.hash(form.encode("utf-8", "surrogatepass"), 7))
        pairs = np.array([seen[w] for w in words], np.uint64)
        word, form = pairs[:, 0], pairs[:, 1]
        form = form ^ np.append(np.uint64(0), (word[1:] == word[:-1]) * np.uint64(0x5555))
        at, values = [bias[0]], [bias[1]]
        for salt, (base, n) in enumerate(((word, 1), (word, 2), (form, 1), (form, 2), (form, 3)), 1):
            if len(base) < n:
                continue
            h = np.full(len(base) - n + 1, salt, np.uint64)
            for k in range(n):
                h = splitmix(h ^ base[k : len(base) - n + 1 + k])
            found, counts = np.unique((h >> self.shift).astype(np.int32), return_counts=True)
            x = np.sqrt(counts.astype(np.float32))
            at.append(found)
            values.append(x / np.float32(np.sqrt((x * x).sum())))
        return np.concatenate(at), np.concatenate(values)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip((w * values).sum(), -35, 35))) - label
        g = error * values
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        np.add.at(self.z, at, g - sigma * w)
        np.add.at(self.n, at, g * g)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learned from labels (doc_id, quality) whose crc32 remainder is not 0."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & (crc_remainder(F.col("doc_id"), HOLD_OUT) != 0))
    sample = usable.select("doc_id", F.col("quality").cast("int").alias("y"), F.xxhash64(F.col("doc_id").cast("string")).alias("turn")).orderBy("turn", "doc_id", "y").limit(max_rows)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectorise = Vectoriser(bits)
        for batch in batches:
            rows = [vectorise(t) for t in batch["text"]]
            yield pd.DataFrame({"turn": batch["turn"], "y": batch["y"], "at": [a.tobytes() for a, _ in rows], "x": [x.tobytes() for _, x in rows]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, rows = Ftrl(bits), []
        for batch in batches:
            rows += [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for a, x, y in zip(batch["at"], batch["x"], batch["y"], strict=True)]
        for _ in range(EPOCHS):
            for at, x, y in rows:
                model.update(at, x, y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pd.DataFrame({"i": at, "w": w[at]})

    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows rows of three numbers
    built = known.mapInPandas(tidy(vectors), "turn long, y int, at binary, x binary")
    learned = built.repartition(1).sortWithinPartitions("turn", "at", "y").mapInPandas(tidy(learn), "i int, w double").toPandas()
    weights = np.zeros(1 << bits, np.float32)
    weights[learned["i"].to_numpy(np.int64)] = learned["w"].to_numpy(np.float32)
    return weights


def scorer(spark, weights: np.ndarray):
    """A column function of text: the score."""
    held = spark.sparkContext.broadcast(weights)
    bits = int(len(weights)).bit_length() - 1

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectorise, w = Vectoriser(bits), held.value
        for texts in parts:
            out = []
            for text in texts:
                at, x = vectorise(text)
                out.append(float(w[at].astype(float) @ x))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35))))

    @F.pandas_udf("double")
    def score_texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(scores)(parts)

    return score_texts


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    weights = train(docs, labels)
    out = docs.select("doc_id", F.coalesce(crc_remainder(F.col("doc_id"), HOLD_OUT) == 0, F.lit(False)).alias("held_out"), scorer(docs.sparkSession, weights)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with all its columns, without the documents the classifier rejects."""
    weights = train(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), scorer(docs.sparkSession, weights)("text").alias("score"))
    return rows.where(F.col("score") >= THRESHOLD).select("row.*")
