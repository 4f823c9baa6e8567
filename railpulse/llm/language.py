"""Language: the labelled text whose suffix automaton parses a text into the fewest normalised phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import LETTERS, Shared, Texts, byte_class, lower_table, stage, texts_of
from railpulse.llm.toxicity import fold

# A document of this modulus has its label held out.
FOLDS, HELD = 3, 1
# Labelled text learnt from: texts looked at per language, bytes per language, and bytes of all languages.
SAMPLE_ROWS, LANGUAGE_BYTES, MODEL_BYTES = 256, 48 << 10, 384 << 10
# Bytes that are parsed in one go: a phrase ends at the end of its window.
WINDOW = 512
UNKNOWN = "und"
LETTER = r"\p{L}"

SPACE = 0x20
WORD = LETTERS & ~byte_class((0x30, 0x39))


def plain(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of texts with one space for whatever lies between letters, and each text's offsets."""
    data = np.where(WORD, lower_table(), SPACE).astype(np.uint8)[t.data]
    after_c3 = np.zeros(len(data), dtype=bool)
    after_c3[1:] = data[:-1] == 0xC3
    upper = after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)  # Latin-1 capitals in UTF-8
    data[upper] += 0x20
    first = np.zeros(len(data) + 1, dtype=bool)
    first[t.offsets] = True
    keep = data != SPACE
    keep[1:] |= keep[:-1] & ~first[1 : len(data)]  # the blank after a letter
    offsets = np.concatenate(([0], np.cumsum(keep)))[t.offsets]
    return data[keep], offsets


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text, place): at most ``rows`` different labelled texts of each language, those of smallest hash.

    Partial aggregates leave one row of repeated texts, and each bucket its ``rows``
    best, before a language's texts meet.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (fold("doc_id", FOLDS) != HELD))
    # Ids and sizes first; the texts are fetched for the few that are chosen.
    known = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit("language"), "text").alias("place"))
    known = known.groupBy("lang", "place").agg(F.lit(1).alias("one"))
    dealt = Window.partitionBy("lang", F.pmod(F.col("place"), F.lit(64))).orderBy("place")
    known = known.withColumn("k", F.row_number().over(dealt)).where(F.col("k") <= rows)
    known = known.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("k") <= rows)
    chosen = stage(known.select(F.col("lang").alias("_lang"), F.col("place").alias("_place")), "language-sample")
    texts = docs.where(fold("doc_id", FOLDS) != HELD).select(F.col("lang").cast("string").alias("lang"), "text")
    texts = texts.withColumn("place", F.xxhash64(F.lit("language"), "text"))
    texts = texts.join(chosen, (F.col("place") == F.col("_place")) & (F.col("lang") == F.col("_lang")), "left_semi")
    return texts.groupBy("lang", "place").agg(F.min("text").alias("text"))


def suffix_automaton(data: bytes) -> dict[str, np.ndarray]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``data``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    sizes = [len(s) for s in step]
    return {
        "source": np.repeat(np.arange(len(step), dtype=np.int32), sizes),
        "byte": np.fromiter((c for s in step for c in s), dtype=np.uint8, count=sum(sizes)),
        "target": np.fromiter((q for s in step for q in s.values()), dtype=np.int32, count=sum(sizes)),
    }


def fit(docs: DataFrame, language_bytes: int = LANGUAGE_BYTES, model_bytes: int = MODEL_BYTES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A suffix automaton per language: (lang, bytes, source, byte, target).

    A language learns from whole texts of at most ``language_bytes``, taken in order of
    hash as long as they fit; if not even one does, the smallest is cut. All languages
    together learn from about ``model_bytes``, in equal shares.
    """
    sample = stage(sampled(docs, rows), "language-texts")
    languages = max(1, sample.select("lang").distinct().count())
    share = max(256, min(language_bytes, model_bytes // languages))
    parts = ("source", "byte", "target")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        texts, size = [], 0
        for chunk in table.column("text").chunks:
            for t in texts_of(chunk):
                data, offsets = plain(t)
                texts += [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
        chosen = []
        for text in texts:
            if text and size + len(text) <= share:
                chosen.append(text)
                size += len(text) + 1
        chosen = chosen or [min(texts, key=len, default=b"")[:share]]
        data = b" ".join(chosen)
        found = suffix_automaton(data)
        columns = {p: pa.array([found[p].tobytes()], pa.binary()) for p in parts}
        return pa.table({"lang": table.column("lang")[:1], "bytes": pa.array([len(data)], pa.int64()), **columns})

    binary = sample.withColumn("text", F.col("text").cast("binary"))
    return binary.groupBy("lang").applyInArrow(learn, "lang string, bytes long, source binary, byte binary, target binary")


class Parser:
    """Cross-parsing by the automata of all languages at once.

    One table holds them: a row per state, a column per byte that some language knows;
    0 means that the automaton does not read on.
    """

    def __init__(self, models: list[dict]):
        self.bits = np.array([np.log2(m["bytes"] + 2.0) for m in models])
        edges = [tuple(np.frombuffer(m[p], dtype=d) for p, d in (("source", np.int32), ("byte", np.uint8), ("target", np.int32))) for m in models]
        known = np.unique(np.concatenate([e[1] for e in edges]))
        self.column = np.zeros(256, dtype=np.int64)
        self.column[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        sizes = [max(int(s.max(initial=0)), int(t.max(initial=0))) + 1 for s, _, t in edges]
        self.roots = np.cumsum([1, *sizes])[:-1]  # row 0 stands for "none"
        self.table = np.zeros((1 + sum(sizes), self.width), dtype=np.int32)
        for root, (s, c, t) in zip(self.roots, edges):
            self.table[root + s, self.column[c]] = root + t

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases of each text in each language.

        A phrase is the longest match from where the last one ended, or one byte that
        the language does not know. Texts are cut into windows, which are all parsed
        side by side, a byte at a time.
        """
        size = np.diff(offsets)
        windows = -(-size // WINDOW)
        text = np.repeat(np.arange(len(size)), windows)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = offsets[text] + nth * WINDOW
        left = np.minimum(size[text] - nth * WINDOW, WINDOW)
        order = np.argsort(-left, kind="stable")
        text, start, left = text[order], start[order], left[order]
        alive = len(left) - np.searchsorted(left[::-1], np.arange(WINDOW), side="right")
        root = self.roots[:, None]
        state = np.repeat(root, len(text), axis=1)
        found = np.zeros(state.shape, dtype=np.int64)
        flat, columns = self.table.ravel(), self.column[data]
        for i in range(int(left.max(initial=0))):
            n = alive[i]
            c = columns[start[:n] + i]
            now = state[:, :n]
            following = flat[now * self.width + c]
            stuck = following == 0
            found[:, :n] += stuck | (now == root)
            again = flat[root * self.width + c]
            again = np.where(again == 0, root, again)
            state[:, :n] = np.where(stuck, again, following)
        out = np.zeros((len(size), len(self.roots)))
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(text, weights=found[k], minlength=len(size))
        return out


def predict(docs: DataFrame, models: DataFrame) -> DataFrame:
    """The documents' columns with ``_li_lang``, ``_li_score`` and ``_li_bits``, bits a byte by language.

    A phrase costs the bits of a place in the language's text. The cheapest language
    wins, the first by code point of equals; the score is its share if the others'
    odds fall by half with each bit. Texts without letters are of unknown language.
    """
    found = sorted((r.asDict() for r in models.collect()), key=lambda m: m["lang"])  # bounded by MODEL_BYTES
    columns = docs.columns
    names = [m["lang"] for m in found]
    has_letter = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)) & F.lit(bool(found))
    binary = docs.withColumn("text", F.col("text").cast("binary"))
    types = ", ".join(f"`{c}` {t}" for c, t in binary.dtypes)
    at = columns.index("text")
    shared = Shared(docs.sparkSession, found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.get()) if names else None
        for batch in batches:
            best, score = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
            rates = np.zeros((len(batch), len(names)))
            for t in texts_of(batch.column(at)) if parser else ():
                data, offsets = plain(t)
                cost = parser.phrases(data, offsets) * parser.bits
                rows = slice(t.first, t.first + len(t))
                best[rows] = np.argmin(cost, axis=1)
                score[rows] = 1.0 / np.exp2(cost.min(axis=1)[:, None] - cost).sum(axis=1)
                rates[rows] = cost / np.maximum(np.diff(offsets), 1)[:, None]
            lang = pa.array(names or [UNKNOWN], pa.string()).take(pa.array(best))
            each = pa.FixedSizeListArray.from_arrays(pa.array(rates.ravel()), max(1, len(names))).cast(pa.list_(pa.float64())) if names else pa.array([[]] * len(batch), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(score), each], [*columns, "_li_lang", "_li_score", "_li_bits"])

    parsed = binary.mapInArrow(scan, f"{types}, _li_lang string, _li_score double, _li_bits array<double>")
    parsed = parsed.withColumn("text", F.col("text").cast("string"))
    by_name = F.map_from_arrays(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("_li_bits"))
    return parsed.select(
        *[F.col(f"`{c}`") for c in columns],
        F.when(has_letter, F.col("_li_lang")).otherwise(UNKNOWN).alias("_li_lang"),
        F.when(has_letter, F.col("_li_score")).otherwise(0.0).alias("_li_score"),
        F.when(has_letter, by_name).alias("_li_bits"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Language of every document: (doc_id, held_out, lang_pred, score).

    Learns from text and language of documents that are not held out, a bounded sample
    of each language; ids, sources and languages are no features. Rows with a NULL
    language teach nothing, nor do texts without letters, which are of language "und"
    with score 0, as is everything if nothing was learnt. Rows are only mapped:
    repeated rows come out as often as they come in and count once in the sample; NULL
    ids are not held out. Equally cheap languages go to the first by code point.
    """
    models = stage(fit(docs), "language-models")
    found = predict(docs.select("doc_id", "text"), models)
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), F.col("_li_lang").alias("lang_pred"), F.col("_li_score").alias("score"))
