"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import SPACED, WordHash, covered, one_row, same_text, stage, texts_of

WINDOW = 20
# Bytes of text in a pack, the unit that tasks read, and of packed text for each part of the index.
PACK_BYTES = 4 << 20
PART_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max
PACKS = "pack long, bytes long, ids array<long>, digests array<long>, checks array<long>, sizes array<long>, texts binary"


def _pack(docs: DataFrame) -> DataFrame:
    """Rows of some megabytes of compressed text, with id and word digest (128 bits in two halves) of each."""
    schema = pa.schema(
        [
            ("pack", pa.int64()),
            ("bytes", pa.int64()),
            ("ids", pa.list_(pa.int64())),
            ("digests", pa.list_(pa.int64())),
            ("checks", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int64())),
            ("texts", pa.binary()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        ids, digests, checks, texts, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            raw = b"".join(texts)
            row = {
                "pack": pack,
                "bytes": len(raw),
                "ids": ids,
                "digests": digests,
                "checks": checks,
                "sizes": [len(t) for t in texts],
                "texts": squeeze.compress(raw),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = b" ".join((text.as_py() or b"").split())
                ids.append(doc_id.as_py())
                digest = hashlib.blake2b(words, digest_size=16).digest()
                digests.append(int.from_bytes(digest[:8], "big", signed=True))
                checks.append(int.from_bytes(digest[8:], "big", signed=True))
                texts.append(words)
                size += len(words)
                if size >= PACK_BYTES:
                    yield out()
                    ids, digests, checks, texts, size = [], [], [], [], 0
                    pack += 1
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, PACKS)


class Pack:
    """Words of a pack as hashes; texts are single-spaced words."""

    def __init__(self, row: dict, seeds: tuple[int, ...] = (1,)):
        self.ids, self.digests, sizes = row["ids"], row["digests"], np.array(row["sizes"], dtype=np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(row["bytes"])))
        self.ends = np.cumsum(sizes)
        self.raw, self.begins = raw, self.ends - sizes
        offsets = pa.py_buffer(np.concatenate(([0], self.ends)).astype(np.int32))
        texts = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(raw)])
        hashes = [WordHash(s) for s in seeds]
        parts, docs = [[] for _ in seeds], []
        for t in texts_of(texts):
            starts, ends, doc = t.words(SPACED)
            docs.append(doc + t.first)
            for part, h in zip(parts, hashes):
                part.append(h.words(t.data, starts, ends))
        self.doc = np.concatenate(docs) if docs else np.empty(0, dtype=np.int64)
        self.n_words = np.bincount(self.doc, minlength=len(sizes))
        self.first_word = np.cumsum(self.n_words) - self.n_words
        self._words = [np.concatenate(p) if p else np.empty(0, dtype=np.uint64) for p in parts]
        self._hashes = hashes

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        return self._hashes[seed].windows(self._words[seed], length)

    def order(self) -> np.ndarray:
        """(id, digest) of each text, ids NULL last, for comparing texts."""
        ids = np.array([LAST if i is None else i for i in self.ids], dtype=np.int64)
        return np.column_stack((ids, np.array(self.digests, dtype=np.int64))).reshape(-1, 2)


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches(max_chunksize=1):
        yield from batch.to_pylist()


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            yield int(part[group[0]]), group


def _anchor_keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of the index and 32 bits more; chance equals only add work later."""
    part = (h >> np.uint64(32)) % np.uint64(parts)
    return (part << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _copies(packs: DataFrame) -> DataFrame:
    """(pack, data): numbers of the texts that equal an earlier one, by 128 bits of a cryptographic hash of their words."""
    docs = packs.select("pack", F.posexplode(F.arrays_zip("ids", "digests", "checks")).alias("at", "d"))
    place = F.struct(F.col("d.ids").isNull().alias("no_id"), F.col("d.ids").alias("id"), "pack", "at")
    docs = stage(docs.select("pack", "at", F.col("d.digests").alias("digest"), F.col("d.checks").alias("check"), place.alias("place")), "substring-docs")
    first = docs.groupBy("digest", "check").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stage(first.select(F.col("digest").alias("of"), F.col("check").alias("of_check"), "first"), "substring-first")
    copies = docs.join(first, (F.col("digest") == F.col("of")) & (F.col("check") == F.col("of_check"))).where("place <> first")
    return stage(copies.groupBy("pack").agg(F.collect_list("at").alias("copies")), "substring-copies")


def _anchors(packs: DataFrame, block: int, parts: int) -> DataFrame:
    """(pack, data): anchor keys of a pack's windows that hit a reference block.

    Every text's blocks at multiples of ``block`` words are the references, and all
    its windows of ``block`` words the probes. A pack sends each distinct hash once,
    with a bit for "is a block" and one for "occurs again in the pack"; a part of the
    index sees for each hash whether there is a block and a second occurrence.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(pa.Table.from_batches([batch])):
                p = Pack(row)
                at = np.flatnonzero(same_text(p.doc, block))
                keys = _anchor_keys(p.windows(block)[at], parts)
                aligned = (at - p.first_word[p.doc[at]]) % block == 0
                distinct, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
                is_block = np.zeros(len(distinct), dtype=bool)
                is_block[inverse[aligned]] = True
                part = (distinct >> np.uint64(32)).astype(np.int64)
                out = []
                for which, group in _by_part(part):
                    low = distinct[group].astype(np.uint32).tobytes()
                    flags = np.packbits(is_block[group]).tobytes() + np.packbits(count[group] > 1).tobytes()
                    out.append({"part": which, "pack": row["pack"], "data": low + flags})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("data", pa.binary())]))

    def meet(table: pa.Table) -> pa.Table:
        lows, blocks, again = [], [], []
        for data in table.column("data"):
            data = data.as_buffer()
            n = 8 * len(data) // 34  # 32 bits and two flags each, the flags in whole bytes
            while 4 * n + 2 * -(-n // 8) > len(data):
                n -= 1
            low = np.frombuffer(data, dtype=np.uint32, count=n)
            flags = np.frombuffer(data, dtype=np.uint8, offset=4 * n).reshape(2, -1)
            lows.append(low)
            blocks.append(np.unpackbits(flags[0], count=n))
            again.append(np.unpackbits(flags[1], count=n))
        sizes = [len(x) for x in lows]
        low, inverse = np.unique(np.concatenate(lows), return_inverse=True)
        seen = np.bincount(inverse, weights=1 + np.concatenate(again)) > 1
        hot = seen & (np.bincount(inverse, weights=np.concatenate(blocks)) > 0)
        flags = np.split(hot[inverse], np.cumsum(sizes)[:-1])
        found = [x[f].tobytes() for x, f in zip(lows, flags)]
        part = table.column("part")[0].as_py()
        kept = [i for i, f in enumerate(found) if f]
        return pa.table(
            {
                "pack": table.column("pack").take(pa.array(kept, pa.int64())),
                "part": pa.array([part] * len(kept), pa.int64()),
                "data": pa.array([found[i] for i in kept], pa.binary()),
            }
        )

    probes = packs.mapInArrow(probe, "part long, pack long, data binary")
    return probes.groupBy("part").applyInArrow(meet, "pack long, part long, data binary")


WINDOWS = "part long, pack long, hashes binary, checks binary, places binary, ids binary, digests binary, runs binary"


def _repeats(packs: DataFrame, anchors: DataFrame, copies: DataFrame, window: int, block: int, parts: int) -> DataFrame:
    """(pack, data): hashes of a pack's windows that start earlier in another pack.

    Only windows around an anchor hit can repeat. A pack sends the first of its equal
    windows, with 96 bits of hash; of those that meet, all but the first are repeats.
    """
    names = [c.split()[0] for c in WINDOWS.split(", ")]

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in names}
        for row in _rows(left):
            hot = [(part << 32) + np.frombuffer(data, dtype=np.uint32).astype(np.int64) for part, data in _messages(right)]
            if not hot:
                continue
            p = Pack(row, (1, 2))
            hot = np.sort(np.concatenate(hot)).astype(np.uint64)
            keys = _anchor_keys(p.windows(block), parts)
            at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            hits = np.concatenate(([0], np.cumsum(hot[at] == keys)))
            inside = same_text(p.doc, window)
            n = len(inside)
            if not n:
                continue
            inside &= hits[window - block + 1 :][:n] > hits[:n]
            copy = np.zeros(len(p.ids), dtype=bool)
            copy[row["copies"] or []] = True
            at = np.flatnonzero(inside & ~copy[p.doc[:n]])
            h, check = p.windows(window)[at], p.windows(window, 1)[at].astype(np.uint32)
            order = p.order()
            rank = np.empty(len(order), dtype=np.int64)
            rank[np.lexsort((order[:, 1], order[:, 0]))] = np.arange(len(order))
            first = np.lexsort((at, rank[p.doc[at]], check, h))
            h, check, at = h[first], check[first], at[first]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
            h, check, at = h[new], check[new], at[new]
            by_place = np.argsort(at)
            h, check, at = h[by_place], check[by_place], at[by_place]
            part = ((h >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
            for which, group in _by_part(part):
                docs, runs = np.unique(p.doc[at[group]], return_counts=True)
                values = [which, row["pack"], h[group], check[group], (at[group] - p.first_word[p.doc[at[group]]]).astype(np.uint32)]
                values += [order[docs, 0], order[docs, 1], runs.astype(np.uint32)]
                for c, v in zip(names, values):
                    out[c].append(v.tobytes() if isinstance(v, np.ndarray) else v)
        return pa.table({c: pa.array(v, pa.int64() if c in ("part", "pack") else pa.binary()) for c, v in out.items()})

    def meet(table: pa.Table) -> pa.Table:
        def joined(name: str, dtype: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(d.as_buffer(), dtype=dtype) for d in table.column(name)])

        h, check, place = joined("hashes", np.uint64), joined("checks", np.uint32), joined("places", np.uint32)
        runs = joined("runs", np.uint32)
        ids, digests = np.repeat(joined("ids", np.int64), runs), np.repeat(joined("digests", np.int64), runs)
        sizes = [len(d.as_buffer()) // 8 for d in table.column("hashes")]
        order = np.lexsort((place, digests, ids, check, h))
        later = np.zeros(len(h), dtype=bool)
        same = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
        later[order[1:]] = same
        found = [x[f].tobytes() for x, f in zip(np.split(h, np.cumsum(sizes)[:-1]), np.split(later, np.cumsum(sizes)[:-1]))]
        kept = [i for i, f in enumerate(found) if f]
        return pa.table(
            {
                "pack": table.column("pack").take(pa.array(kept, pa.int64())),
                "part": table.column("part").take(pa.array(kept, pa.int64())),
                "data": pa.array([found[i] for i in kept], pa.binary()),
            }
        )

    with_copies = _with_copies(packs, copies)
    windows = with_copies.groupBy("pack").cogroup(anchors.groupBy("pack")).applyInArrow(extend, WINDOWS)
    return windows.groupBy("part").applyInArrow(meet, "pack long, part long, data binary")


def _messages(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    for part, data in zip(table.column("part"), table.column("data")):
        yield part.as_py(), data.as_py()


def _with_copies(packs: DataFrame, copies: DataFrame) -> DataFrame:
    c = copies.withColumnRenamed("pack", "of")
    return packs.join(c, F.col("pack") == F.col("of"), "left").drop("of")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the passages of ``window`` words that occur earlier.

    Returns doc_id, n_words, n_removed, spans (removed runs as first word and word
    after the last) and text (kept words joined by a space). A word goes if a window
    over it also starts in an earlier document (smaller doc_id, NULL last) or earlier
    in its own. Windows are judged on the input. Texts with the same words, ids too,
    are copies of the first; different texts with one id are ordered by a digest.
    NULL and blank texts have no words. Other columns are not read.

    Blocks of half a window lie whole in every window, so all repeats touch an
    indexed block. Documents travel in compressed packs; hashes in arrays, each once
    per pack, so a passage that many documents share is one entry per pack. Copies
    take part only as removed. Both shuffles of hashes go by parts of bounded size.
    """
    block = (window + 1) // 2
    packs = stage(_pack(docs), "substring-packs")
    total = one_row(packs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")))["n"]
    parts = max(1, -(-total // PART_BYTES))
    copies = _copies(packs)
    anchors = stage(_anchors(packs, block, parts), "substring-anchors")
    repeats = stage(_repeats(packs, anchors, copies, window, block, parts), "substring-repeats")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("spans", pa.list_(pa.list_(pa.int64()))),
            ("text", pa.string()),
        ]
    )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in _rows(left):
            p = Pack(row)
            h = p.windows(window)
            at = np.flatnonzero(same_text(p.doc, window))
            h = h[at]
            earlier = [np.frombuffer(data, dtype=np.uint64) for _, data in _messages(right)]
            repeated = np.isin(h, np.concatenate(earlier)) if earlier else np.zeros(len(h), dtype=bool)
            order = p.order()
            rank = np.empty(len(order), dtype=np.int64)
            rank[np.lexsort((order[:, 1], order[:, 0]))] = np.arange(len(order))
            copy = np.zeros(len(p.ids), dtype=bool)
            copy[row["copies"] or []] = True
            by = np.lexsort((at, rank[p.doc[at]], copy[p.doc[at]], h))
            later = np.zeros(len(h), dtype=bool)
            later[by[1:]] = h[by][1:] == h[by][:-1]
            gone = covered(at[repeated | later], window, len(p.doc))
            gone |= (copy & (p.n_words >= window))[p.doc]
            removed = np.bincount(p.doc, weights=gone, minlength=len(p.ids)).astype(np.int64)
            for i, doc_id in enumerate(p.ids):
                text = p.raw[p.begins[i] : p.ends[i]]
                spans = []
                if removed[i]:
                    mine = gone[p.first_word[i] : p.first_word[i] + p.n_words[i]]
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
                    spans = edges.reshape(-1, 2).tolist()
                    text = b" ".join(w for w, g in zip(text.split(), mine.tolist()) if not g)
                out.append((doc_id, int(p.n_words[i]), int(removed[i]), spans, text.decode("utf-8", "replace")))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else schema.empty_table().columns, schema=schema)

    with_copies = _with_copies(packs, copies)
    return (
        with_copies.groupBy("pack")
        .cogroup(repeats.groupBy("pack"))
        .applyInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<array<long>>, text string")
    )
