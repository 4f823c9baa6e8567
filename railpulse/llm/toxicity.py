"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import LETTERS, Shared, WordHash, lower_table, same_text, stage, texts_of

# Features hash to 2 ** BITS weights.
BITS = 20
# Most labelled rows that the model is fitted on, those of smallest hash.
FIT_ROWS = 12_000
EPOCHS = 6
# Learning rates and penalties of FTRL-proximal.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
# A document has this modulus of labels held out.
FOLDS, HELD = 5, 0


def fold(doc_id, folds: int):
    """crc32 of the id's decimal digits, modulo ``folds``; -1 without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


class Features:
    """Distinct hashed features of each text: words, pairs, and pairs that skip one word."""

    def __init__(self):
        self.hash = WordHash(bytes_as=lower_table())
        self.shift = np.uint64(64 - BITS)

    def of(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature), each once, ordered by text."""
        starts, ends, doc = texts.words(LETTERS)
        words = self.hash.words(texts.data, starts, ends)
        found = [(doc.astype(np.int64) << BITS) | (words >> self.shift).astype(np.int64)]
        for gap in (1, 2):
            if len(words) > gap:
                a, b = words[:-gap], words[gap:]
                h = a * np.uint64(2 * gap + 1) ^ (b + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                inside = same_text(doc, gap + 1)
                pair = (doc[:-gap].astype(np.int64) << BITS) | (h >> self.shift).astype(np.int64)
                found.append(pair[inside])
        every = np.unique(np.concatenate(found))
        return every >> BITS, every & ((1 << BITS) - 1)


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (features, label) in the given order; the last weight is the bias.

    Every coordinate has its own rate, falling with its squared gradients, and a
    weight stays exactly 0 until its gradients overcome the L1 penalty.
    """
    bias = 1 << BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    penalty = np.full(bias + 1, L1)
    penalty[bias] = 0.0

    def weights(at) -> np.ndarray:
        rate = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(z[at]) <= penalty[at], 0.0, (np.sign(z[at]) * penalty[at] - z[at]) / rate)

    for _ in range(epochs):
        for features, label in rows:
            at = np.append(features, bias)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(bias + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """Non-zero weights (feature, weight), learnt from at most ``rows`` labelled rows.

    Labels of 0 or 1 only; the largest counts if a doc_id has several. The sample is
    that of smallest hash of doc_id. Of a repeated doc_id one text counts, that of
    smallest hash, once. One task holds their features, which the bound on the rows bounds.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("long").alias("label"))
    known = known.where(fold("_id", FOLDS) != HELD).withColumn("_place", F.xxhash64(F.lit("fit"), "_id"))
    sample = stage(known.orderBy("_place", "_id").limit(rows), "toxic-sample")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("_id")
    )
    # Partial aggregates leave one text per task of an id that many rows have.
    one = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text")))
    texts = texts.groupBy("_id", "label", "_place").agg(one.alias("text"))
    texts = stage(texts.select("label", "_place", "text"), "toxic-texts").repartition(1).sortWithinPartitions("_place", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, examples = Features(), []
        for batch in batches:
            y = batch.column(0).to_numpy()
            for t in texts_of(batch.column(2)):
                doc, found = features.of(t)
                cuts = np.searchsorted(doc, np.arange(len(t) + 1))
                examples += [
                    (found[cuts[i] : cuts[i + 1]].astype(np.int32), int(y[t.first + i])) for i in range(len(t))
                ]
        if examples:
            w = train(examples)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["feature", "weight"])

    return texts.mapInArrow(learn, "feature long, weight double")


def score(docs: DataFrame, weights: DataFrame, out: str = "score") -> DataFrame:
    """The documents' columns and the probability that a text is toxic.

    Only weights that are not 0 are broadcast, a few hundred as a rule and never more
    than 2 ** BITS + 1. NULL and empty texts have no features and get the score of the bias.
    """
    columns = docs.columns
    at = columns.index("text")
    kept = [(row["feature"], row["weight"]) for row in weights.toLocalIterator()]
    shared = Shared(docs.sparkSession, np.array(kept, dtype=[("feature", np.int32), ("weight", np.float32)]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sparse = Features(), shared.get()
        w = np.zeros((1 << BITS) + 1, dtype=np.float32)
        w[sparse["feature"]] = sparse["weight"]
        for batch in batches:
            total = np.full(len(batch), float(w[-1]))
            for t in texts_of(batch.column(at)):
                doc, found = features.of(t)
                total[t.first : t.first + len(t)] += np.bincount(doc, weights=w[found], minlength=len(t))
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*columns, out])

    binary = docs.withColumn("text", F.col("text").cast("binary"))
    types = ", ".join(f"`{c}` {t}" for c, t in binary.dtypes)
    return binary.mapInArrow(scan, f"{types}, `{out}` double").withColumn("text", F.col("text").cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document: (doc_id, held_out, score, predicted).

    Learns from labels whose document is not held out; ids, language and source are
    no features. Rows are only mapped: repeated rows come out as often as they come
    in, NULL ids are not held out. Without labels every score is one half.
    """
    weights = stage(fit(docs, labels), "toxic-weights")
    scored = score(docs.select("doc_id", "text"), weights)
    held = fold("doc_id", FOLDS) == HELD
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below one half, with their own columns.

    Without labels to learn from nothing is dropped.
    """
    weights = stage(fit(docs, labels), "toxic-weights")
    if weights.isEmpty():
        return docs
    return score(docs, weights, "_tox_score").where("_tox_score < 0.5").select(*docs.columns)
