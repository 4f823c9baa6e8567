"""Benchmark decontamination: document windows against a broadcast set of test n-grams."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import LETTERS, Shared, WordHash, covered, lower_table, one_row, stage, texts_of

WINDOW = 13
# Bytes of benchmark text whose n-grams are broadcast at once; more are taken in blocks.
BLOCK_BYTES = 16 << 20
# Bytes of them that are hashed at once, at some 30 times their size.
PIECE_BYTES = 1 << 18
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Share of hit words from which a document counts as contaminated: one in twenty.
ONE_IN = 20


class Grams:
    """The windows of some test items as arrays: under 50 bytes a word of theirs.

    The items' words lie in lower case in one run of bytes, a space between them; a window is
    its hash and the number of its first word there. Windows are distinct: ``lengths`` has
    by length their sorted hashes and numbers; window w begins at word ``at[w]`` and is in
    the items ``item[bounds[w] : bounds[w + 1]]``.
    """

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int):
        lower, ids_of = bytes(lower_table()), defaultdict(set)
        for item_id, text in items:
            ids_of[b" ".join(WORD.findall(text.translate(lower)))].add(item_id)
        ids_of.pop(b"", None)
        self.ids = [sorted(x for x in ids if x is not None) for ids in ids_of.values()]
        counts = np.array([text.count(b" ") + 1 for text in ids_of], dtype=np.int64)
        self.data = b" ".join(ids_of)
        del ids_of
        data = np.frombuffer(self.data, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(LETTERS[data].astype(np.int8), prepend=0, append=0)).astype(np.uint32)
        self.starts, self.ends = edges[0::2].copy(), edges[1::2].copy()
        begins = np.cumsum(counts) - counts
        hashes = WordHash()
        words = self._word_hashes(hashes, data)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at, item, bounds = [], [], [np.zeros(1, dtype=np.uint32)]
        seen = held = 0
        for length in np.unique(np.minimum(counts, window)).tolist():
            mine = np.flatnonzero(np.minimum(counts, window) == length)
            runs = counts[mine] - length + 1
            of = np.repeat(mine, runs).astype(np.uint32)
            first = np.arange(runs.sum()) + np.repeat(begins[mine] - (np.cumsum(runs) - runs), runs)
            found = hashes.windows(words, length)[first]
            order = np.argsort(found, kind="stable")
            found, first, of = found[order], first[order].astype(np.uint32), of[order]
            new = self._distinct(found, first, of, length)
            (where,) = np.nonzero(new)
            self.lengths[length] = (found[where], (seen + np.arange(len(where))).astype(np.uint32))
            at.append(first[where])
            item.append(of)
            bounds.append((held + np.append(where[1:], len(of))).astype(np.uint32))
            seen, held = seen + len(where), held + len(of)
        self.at, self.item, self.bounds = (np.concatenate(x) if x else np.empty(0, np.uint32) for x in (at, item, bounds))

    def _word_hashes(self, hashes: WordHash, data: np.ndarray) -> np.ndarray:
        """Hashes of all words, a few hundred KB of text at a time."""
        cuts = np.searchsorted(self.starts, np.arange(0, len(data) + PIECE_BYTES, PIECE_BYTES))
        found = np.empty(len(self.starts), dtype=np.uint64)
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                origin = int(self.starts[a])
                starts, ends = (x[a:b].astype(np.int64) - origin for x in (self.starts, self.ends))
                found[a:b] = hashes.words(data[origin : origin + int(ends[-1])], starts, ends)
        return found

    def _distinct(self, found: np.ndarray, first: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
        """Flags for the first of each run of equal windows. Where windows share a hash, their
        words are compared, and those of equal words put side by side."""
        new = np.ones(len(found), dtype=bool)
        new[1:] = found[1:] != found[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], len(found))):
            if b - a > 1:
                texts = [self._words_from(int(i), length) for i in first[a:b]]
                order = sorted(range(b - a), key=texts.__getitem__)
                first[a:b], of[a:b] = first[a:b][order], of[a:b][order]
                for k in range(1, b - a):
                    new[a + k] = texts[order[k]] != texts[order[k - 1]]
        return new

    def _words_from(self, i: int, length: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i + length - 1]]

    def text(self, w: int, length: int) -> bytes:
        """The words of a window, a space between them."""
        return self._words_from(int(self.at[w]), length)

    def items(self, w: int) -> set[str]:
        """Ids of the items that hold a window."""
        return {x for i in self.item[self.bounds[w] : self.bounds[w + 1]] for x in self.ids[i]}


def _blocks(items: DataFrame, block_bytes: int) -> list:
    """Filters that cut the items into parts of about ``block_bytes``."""
    size = one_row(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")))["n"]
    parts = -(-size // block_bytes) if size else 1
    spread = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [F.lit(True)] if parts == 1 else [spread == i for i in range(parts)]


FOUND = {"_dc_words": "long", "_dc_hit": "long", "_dc_bits": "binary", "_dc_items": "array<string>"}


def _scan(docs: DataFrame, grams, text: str) -> DataFrame:
    """Add the hit words (a bit each) and items of one block to those found before."""
    columns = docs.columns
    at = columns.index(text)
    kept = [c for c in columns if c not in FOUND]
    again = len(kept) < len(columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Grams = grams.get()
        hashes = WordHash(bytes_as=lower_table())
        lower = bytes(lower_table())
        bitmap = np.zeros(1 << 16, dtype=bool)
        for found, _ in g.lengths.values():
            bitmap[(found >> np.uint64(48)).astype(np.int64)] = True

        def occurring(t, starts, ends, doc, words) -> Iterator[tuple[int, int, int]]:
            """(first word, length, window number) of each verified occurrence."""
            for length, (known, which) in g.lengths.items():
                windows = hashes.windows(words, length)
                maybe = np.flatnonzero(bitmap[(windows >> np.uint64(48)).astype(np.int64)])
                maybe = maybe[doc[maybe] == doc[maybe + length - 1]]
                first = np.searchsorted(known, windows[maybe])
                last = np.searchsorted(known, windows[maybe], side="right")
                for i, a, b in zip(maybe[first < last], first[first < last], last[first < last]):
                    text = b" ".join(t.data[starts[j] : ends[j]].tobytes().translate(lower) for j in range(i, i + length))
                    for w in which[a:b]:
                        if g.text(w, length) == text:
                            yield int(i), length, int(w)

        for batch in batches:
            n_words, n_hit = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            bits: list[bytes | None] = [None] * len(batch)
            items: list[list[str]] = [[] for _ in range(len(batch))]
            if again:
                n_hit = np.array(batch.column(columns.index("_dc_hit")), dtype=np.int64)
                bits = batch.column(columns.index("_dc_bits")).to_pylist()
                items = batch.column(columns.index("_dc_items")).to_pylist()
            for t in texts_of(batch.column(at)):
                starts, ends, doc = t.words(LETTERS)
                count = np.bincount(doc, minlength=len(t))
                n_words[t.first : t.first + len(t)] = count
                if not len(starts):
                    continue
                begins = np.concatenate(([0], np.cumsum(count)))
                by_doc: dict[int, list] = defaultdict(list)
                for i, length, w in occurring(t, starts, ends, doc, hashes.words(t.data, starts, ends)):
                    by_doc[int(doc[i])].append((i, length, w))
                for d, found in by_doc.items():
                    row = t.first + d
                    at_word = np.array([i for i, _, _ in found]) - begins[d]
                    flags = covered(at_word, np.array([n for _, n, _ in found]), int(count[d]))
                    if bits[row] is not None:
                        flags |= np.unpackbits(np.frombuffer(bits[row], dtype=np.uint8), count=int(count[d])).astype(bool)
                    bits[row], n_hit[row] = np.packbits(flags).tobytes(), flags.sum()
                    items[row] = sorted(set(items[row]).union(*(g.items(w) for w in {w for _, _, w in found})))
            found = [pa.array(n_words), pa.array(n_hit), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in kept), *found], [*kept, *FOUND])

    types = dict(docs.dtypes) | FOUND
    return docs.mapInArrow(scan, ", ".join(f"`{c}` {types[c]}" for c in [*kept, *FOUND]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents' columns with what of the benchmark occurs in them.

    Words are runs of letters, digits and non-ASCII, A-Z in lower case. The windows
    of an item are its runs of ``window`` words, or all its words if there are fewer.
    Adds ``_dc_words`` (their number), ``_dc_hit`` (number of hit words), ``_dc_bits``
    (a bit per word, set inside an occurrence of a window; NULL if none), ``_dc_items``
    (sorted ids of the items that occur) and ``_dc_bad`` (at least one word in twenty
    is hit); other columns of the documents pass unread, whatever their names.

    NULL and empty texts have no words and are clean; such items never occur. Items
    without an id hit words but are not listed; repeated items count once. Documents
    are only mapped, never shuffled, so copies and long texts need no special care.
    The broadcast set stems from ``block_bytes`` of benchmark text at most and is about
    four times as large (some twenty times, for a moment, on the driver): a larger
    benchmark is scanned for in blocks.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.where(F.col("text").isNotNull())
    df = docs.withColumn("text", F.col("text").cast("binary"))
    blocks = _blocks(items, block_bytes)
    for part in blocks:
        grams = Grams(((r["item_id"], bytes(r["text"])) for r in items.where(part).toLocalIterator()), window)
        df = _scan(df, Shared(docs.sparkSession, grams), "text")
        if len(blocks) > 1:
            df = stage(df, "decontam")
    bad = (F.col("_dc_hit") > 0) & (ONE_IN * F.col("_dc_hit") >= F.col("_dc_words"))
    return df.withColumn("text", F.col("text").cast("string")).withColumn("_dc_bad", bad)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return find_contamination(docs, benchmark).where(~F.col("_dc_bad")).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without their hit words: each hit run becomes one space."""
    found = find_contamination(docs, benchmark)
    lower = bytes(lower_table())

    @F.pandas_udf("string")
    def cut(texts, masks):
        out = []
        for text, mask in zip(texts, masks):
            if mask is None:
                out.append(text)
                continue
            data, parts, last = text.encode(), [], 0
            spans = [m.span() for m in WORD.finditer(data.translate(lower))]
            flags = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(spans)).astype(bool)
            for (a, b), hit in zip(spans, flags):
                if hit:
                    parts.append(data[last:a])
                    last = b
            parts.append(data[last:])
            out.append(re.sub(rb"[ \t]{2,}", b" ", b" ".join(parts)).decode())
        return type(texts)(out)

    no_hit = F.col("_dc_bits").isNull()
    clean = found.withColumn("text", F.when(no_hit, F.col("text")).otherwise(cut("text", "_dc_bits")))
    return clean.select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found and the verdict."""
    return find_contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("_dc_words").alias("n_words"),
        F.col("_dc_hit").alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_dc_items"), 256).alias("items_sha256"),
        F.col("_dc_bad").alias("contaminated"),
    )
