"""Quality: regularised quadratic discriminant over statistics of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import SPACED, Texts, WordHash, byte_class, same_text, stage, texts_of
from railpulse.llm.toxicity import fold

FOLDS, HELD = 3, 1
# Weight of the pooled covariance in each class's, and of the mean variance in both.
POOLED, SPHERICAL = 0.1, 0.02

UPPER, LOWER = byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A))
DIGIT, HIGH = byte_class((0x30, 0x39)), byte_class((0x80, 0xFF))
STOP = byte_class((0x2E, 0x2E), (0x3F, 0x3F))
COMMA = byte_class((0x2C, 0x2C))
MARK = byte_class((0x21, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3A, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
LINE = byte_class((0x0A, 0x0A))
STATISTICS = (
    "log words",
    "mean word length",
    "log word length spread",
    "distinct words",
    "immediate repeats",
    "repeated pairs",
    "repeated windows of five",
    "upper case",
    "capital words",
    "digits",
    "marks",
    "words ending in marks",
    "words of marks",
    "stops",
    "commas",
    "line length",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share, drawn to one half where there is little to count."""
    return np.log((part + 0.5) / (whole - part + 0.5 + (part > whole) * (part - whole)))


def statistics(t: Texts, h: WordHash) -> np.ndarray:
    """Transformed statistics, a row per text."""
    n = len(t)

    def per_text(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[t.data], dtype=np.int64)))
        return (sums[t.offsets[1:]] - sums[t.offsets[:-1]]).astype(float)

    starts, ends, doc = t.words(SPACED)

    def words_with(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[: len(flags)], weights=flags, minlength=n)

    def distinct(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, owner))
        hs, o = hashes[order], owner[order]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (hs[1:] != hs[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n).astype(float)

    size = np.diff(t.offsets).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    hashes = h.words(t.data, starts, ends)
    length = (ends - starts).astype(float)
    mean = words_with(length) / np.maximum(words, 1)
    spread = words_with(length**2) / np.maximum(words, 1) - mean**2
    last, first = (t.data[ends - 1], t.data[starts]) if len(starts) else (t.data[:0], t.data[:0])
    repeats = same_text(doc, 2) & (hashes[1:] == hashes[:-1]) if len(doc) > 1 else np.zeros(0, dtype=bool)

    def repeated(k: int) -> np.ndarray:
        inside = same_text(doc, k)
        if not len(inside):
            return _share(np.zeros(n), np.zeros(n))
        owner = doc[: len(inside)][inside]
        total = np.bincount(owner, minlength=n).astype(float)
        return _share(total - distinct(h.windows(hashes, k)[inside], owner), total)

    upper, lower, marks = per_text(UPPER), per_text(LOWER), per_text(MARK)
    columns = [
        np.log1p(words),
        np.log1p(mean),
        np.log1p(np.maximum(spread, 0)),
        _share(distinct(hashes, doc), words),
        _share(words_with(repeats), np.maximum(words - 1, 0)),
        repeated(2),
        repeated(5),
        _share(upper, upper + lower),
        _share(words_with(UPPER[first]), words),
        _share(per_text(DIGIT), size),
        _share(marks, size),
        _share(words_with(MARK[last]), words),
        _share(words_with(MARK[last] & (ends - starts == 1)), words),
        _share(per_text(STOP), words),
        _share(per_text(COMMA), words),
        np.log1p(words / (1 + per_text(LINE))),
    ]
    return np.column_stack(columns)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and ``x``, the statistics; a NULL text counts as empty."""
    ids = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHash()
        for batch in batches:
            for t in texts_of(batch.column(2)):
                x = statistics(t, h)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(t.first, len(t)) for i in (0, 1)), rows], ["doc_id", "content", "x"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {ids}, content long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def moments(rows: DataFrame) -> DataFrame:
    """Count, sums and sums of products of ``x`` for each label, a row per task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            y, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for label in np.unique(y):
                part = x[y == label]
                sums = [len(part), part.sum(axis=0), part.T @ part]
                total[int(label)] = [a + b for a, b in zip(total.get(int(label), [0, 0, 0]), sums)]
        if total:
            yield pa.RecordBatch.from_pydict(
                {
                    "label": list(total),
                    "n": [float(v[0]) for v in total.values()],
                    "s": [v[1].tolist() for v in total.values()],
                    "p": [v[2].ravel().tolist() for v in total.values()],
                }
            )

    parts = rows.select("label", "x").mapInArrow(scan, "label long, n double, s array<double>, p array<double>")
    flat = parts.select("label", "n", F.posexplode(F.concat("s", "p")).alias("i", "v"))
    sums = flat.groupBy("label", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return sums.groupBy("label").agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("v")
    )


class Discriminant:
    """Gaussian class densities with shrunken covariances, by their Cholesky factors."""

    def __init__(self, classes: dict[int, tuple[float, np.ndarray]], pooled: float, spherical: float):
        d = len(STATISTICS)
        n = {k: c for k, (c, _) in classes.items()}
        mean = {k: v[:d] / n[k] for k, (_, v) in classes.items()}
        own = {k: v[d:].reshape(d, d) / n[k] - np.outer(mean[k], mean[k]) for k, (_, v) in classes.items()}
        both = sum(n[k] * own[k] for k in own) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(both), 1e-9))
        self.prior = {k: np.log(n[k] / sum(n.values())) for k in n}
        self.mean = {k: mean[k] / self.scale for k in mean}
        self.factor = {}
        for k in own:
            c = ((1 - pooled) * own[k] + pooled * both) / np.outer(self.scale, self.scale)
            c = (1 - spherical) * c + spherical * max(np.trace(c) / d, 1e-3) * np.eye(d)
            self.factor[k] = np.linalg.cholesky(c)

    def log_density(self, x: np.ndarray, label: int) -> np.ndarray:
        factor = self.factor[label]
        z = np.linalg.solve(factor, (x / self.scale - self.mean[label]).T)
        return self.prior[label] - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        odds = self.log_density(x, 1) - self.log_density(x, 0)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -35, 35)))


def quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = POOLED, spherical: float = SPHERICAL
) -> DataFrame:
    """Score of every document: (doc_id, held_out, score, predicted).

    Learns from all labels of 0 or 1 whose document is not held out (the largest, if
    a doc_id has several), of a repeated doc_id from one text, that of smallest hash: tasks sum moments, the driver gets one row of moments per
    class. Ids, language and source are no features. NULL and empty texts have the
    statistics of no words and are scored like others. Repeated rows come out as
    often as they come in; NULL ids are not held out. If a class has fewer than two
    documents to learn from, every score is one half.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("long").alias("label"))
    known = known.where(fold("_id", FOLDS) != HELD)
    x = stage(document_statistics(docs), "quality-statistics")
    learnt = x.join(known, F.col("doc_id") == F.col("_id")).groupBy("_id", "label").agg(F.min_by("x", "content").alias("x"))
    sums = moments(learnt).collect()  # a row per class
    classes = {r["label"]: (r["n"], np.array(r["v"])) for r in sums}
    held = (fold("doc_id", FOLDS) == HELD).alias("held_out")
    if min([classes.get(k, (0, None))[0] for k in (0, 1)]) < 2:
        return x.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    model = Discriminant(classes, pooled, spherical)
    ids = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(_matrix(batch.column(1))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    scored = x.select("doc_id", "x").mapInArrow(scan, f"doc_id {ids}, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
