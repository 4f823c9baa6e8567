"""SimHash near-duplicates, found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import lower_table, stage
from railpulse.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
# Fixed value: a generator polynomial of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """SimHash of a lower-case text: bits set in over half of its shingles' hashes."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    h = xxhash.xxh64_intdigest
    last = ends[k - 1 :] if len(words) >= k else ends[-1:]
    hashes = [h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())]
    rows = np.array(hashes, dtype=">u8").view(np.uint8).reshape(n, 8)
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 200):  # sums of at most 200 bits fit a byte
        set_bits += np.add.reduce(np.unpackbits(rows[i : i + 200], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long; the other columns pass."""
    columns = docs.columns
    at = columns.index("text")
    lower = bytes(lower_table())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            prints = (fingerprint((t.as_py() or b"").translate(lower), k) for t in texts)
            out = np.fromiter(prints, dtype=np.uint64, count=len(batch)).view(np.int64)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], [*(c for c in columns if c != "text"), "fp"])

    types = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(scan, f"{types}, fp long")


class Golay:
    """Codeword indices near 23-bit words.

    The code is perfect: every word lies within three bits of exactly one codeword,
    found from its remainder by the generator. Words that differ in one or two bits
    are neighbours or have a common one, so the codewords nearest to a word and to
    its 23 neighbours are keys of which they share one. A word has 1 or 6 keys.
    """

    def __init__(self):
        bits = [1 << i for i in range(23)]
        remainders = []
        for r in bits:
            for s in range(22, 10, -1):
                if r >> s & 1:
                    r ^= GOLAY << (s - 11)
            remainders.append(r)
        # Remainders are linear: that of a word is the sum of those of its two parts.
        self.low, self.high = np.zeros(1 << 12, dtype=np.uint32), np.zeros(1 << 11, dtype=np.uint32)
        for table, part in ((self.low, remainders[:12]), (self.high, remainders[12:])):
            for i, r in enumerate(part):
                table[1 << i : 2 << i] = table[: 1 << i] ^ np.uint32(r)
        errors = [0, *bits]
        errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
        errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
        errors = np.array(errors, dtype=np.uint32)
        self.error = np.zeros(1 << 11, dtype=np.uint32)
        self.error[self.remainder(errors)] = errors

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & np.uint32(0xFFF)] ^ self.high[words >> np.uint32(12)]

    def index(self, words: np.ndarray) -> np.ndarray:
        """Message part, 12 bits, of the codeword nearest to each word."""
        return (words ^ self.error[self.remainder(words)]) >> np.uint32(11)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the distinct indices of each word and its 23 neighbours."""
        around = np.empty((len(words), 24), dtype=np.uint32)
        around[:, 0] = self.index(words)
        for bit in range(23):
            around[:, bit + 1] = self.index(words ^ np.uint32(1 << bit))
        around.sort(axis=1)
        new = np.ones(around.shape, dtype=bool)
        new[:, 1:] = around[:, 1:] != around[:, :-1]
        rows, _ = np.nonzero(new)
        return rows, around[new]


def _segments(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The eight ways to read a fingerprint: (way, a quarter, half of the rest).

    Of four 16-bit quarters one is free of error if at most three bits differ. The
    other 48 bits are two halves of 24, of which one has at most one error; its
    first 23 bits are a word for the code.
    """
    for quarter in range(4):
        exact = (fp >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
        low = fp & np.uint64((1 << (16 * quarter)) - 1)
        high = (fp >> np.uint64(16 * quarter)) >> np.uint64(16)
        rest = low | (high << np.uint64(16 * quarter))
        for half in range(2):
            word = (rest >> np.uint64(24 * half)) & np.uint64((1 << 23) - 1)
            yield 2 * quarter + half, exact, word.astype(np.uint32)


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """(key, fp): all keys of each distinct fingerprint; near ones share a key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for lo in range(0, len(batch), 20_000):
                fp = np.asarray(batch.column(0).slice(lo, 20_000)).view(np.uint64)
                for way, exact, word in _segments(fp):
                    rows, index = golay.keys(word)
                    key = (np.uint64(way) << np.uint64(28)) | (exact[rows] << np.uint64(12)) | index.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(fp[rows].view(np.int64))], ["key", "fp"]
                    )

    return prints.select("fp").mapInArrow(scan, "key long, fp long")


def linked(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that connect what chains of fingerprints within ``bits`` connect.

    Each found fingerprint takes its unvisited neighbours with it, so a dense group
    costs a few passes over it and yields one edge per member, never all its pairs.
    """
    edges = []
    free = np.arange(len(fp))
    while len(free):
        todo, free, root = [free[0]], free[1:], free[0]
        while todo and len(free):
            near = np.bitwise_count(fp[free] ^ fp[todo.pop()]) <= bits
            found, free = free[near], free[~near]
            edges += [(root, i) for i in found]
            todo += list(found)
    return edges


def links(keys: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Verified links (u, v) between the fingerprints that share a key.

    Rows arrive sorted by key, so a task holds one key's fingerprints at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def whole(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            two = first[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            u, v = [fp[two]], [fp[two + 1]]
            for a, n in zip(first[size > 2], size[size > 2]):
                group = fp[a : a + n]
                if pairs := linked(group, bits):
                    left, right = np.array(pairs).T
                    u.append(group[left])
                    v.append(group[right])
            u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            key = np.concatenate((rest_key, np.asarray(batch.column(0))))
            fp = np.concatenate((rest_fp, np.asarray(batch.column(1)).view(np.uint64)))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest_key, rest_fp = key[cut:], fp[cut:]
            if cut:
                yield whole(key[:cut], fp[:cut])
        if len(rest_key):
            yield whole(rest_key, rest_fp)

    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(scan, "u long, v long")


def fingerprint_groups(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, group): fingerprints that chains of links connect share a group.

    Only fingerprints that have a link are listed. The keys find every link of at
    most MAX_BITS bits, so more are refused.
    """
    if bits > MAX_BITS:
        raise ValueError(f"links of more than {MAX_BITS} bits are not all found: {bits}")
    found = stage(links(fuzzy_keys(prints.select("fp").distinct()), bits).distinct(), "simhash-links")
    roots = components(found)
    themselves = roots.select(F.col("root").alias("fp"), F.col("root").alias("group")).distinct()
    return roots.select(F.col("node").alias("fp"), F.col("root").alias("group")).union(themselves)


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """Component of every document: (doc_id, fingerprint, component_id).

    Texts that agree in all but ``bits`` of 64 SimHash bits are linked; component_id
    is the smallest doc_id that links reach. Texts of fewer than ``k`` words are one
    shingle; NULL and blank ones have fingerprint 0 and link like any other. Repeated
    rows come out as often as they come in. A NULL doc_id is in its group but never
    names it; a group of NULL ids only has a NULL name. Other columns are not read.

    Equal fingerprints meet once: keys, links and groups hold distinct ones only,
    so copies are neither paired nor moved. Groups return to the documents by a join
    whose hot partitions Spark splits, as both sides come from files.
    """
    return _classified(docs, k, bits).select("doc_id", "fingerprint", F.col("chosen.doc_id").alias("component_id"))


def _classified(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Fingerprint and chosen document, a struct of (no_id, doc_id, content), of every document."""
    if bits > MAX_BITS:
        raise ValueError(f"links of more than {MAX_BITS} bits are not all found: {bits}")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("content"))
    prints = stage(fingerprints(rows, k), "simhash-prints")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    least = stage(prints.groupBy("fp").agg(F.min(one).alias("first")), "simhash-classes")
    groups = stage(fingerprint_groups(least, bits), "simhash-groups").withColumnRenamed("fp", "of")
    named = least.join(groups, F.col("fp") == F.col("of"), "left").withColumn("group", F.coalesce("group", "fp"))
    names = stage(named.groupBy("group").agg(F.min("first").alias("chosen")), "simhash-names")
    classes = named.drop("of").join(names.withColumnRenamed("group", "name"), F.col("group") == F.col("name"))
    classes = stage(classes.select(F.col("fp").alias("of"), "chosen"), "simhash-components")
    return prints.join(classes, F.col("fp") == F.col("of")).select(
        "doc_id", "content", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "chosen"
    )


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Of repeated rows with its id and text one stays. A component without ids keeps
    one of its texts.
    """
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    chosen = _classified(docs, k, bits).where(mine == F.col("chosen"))
    keep = chosen.groupBy(F.col("doc_id").alias("_sh_id"), F.col("content").alias("_sh_content"))
    keep = stage(keep.agg(F.count(F.lit(1)).alias("_sh_rows")), "simhash-keep")
    same = F.col("doc_id").eqNullSafe(F.col("_sh_id")) & (F.xxhash64("text") == F.col("_sh_content"))
    once = docs.join(keep.where("_sh_rows = 1"), same, "left_semi")
    # Rows that are all alike but for their other columns: rare, so only these are ranked.
    often = docs.join(keep.where("_sh_rows > 1"), same)
    order = Window.partitionBy("_sh_id", "_sh_content").orderBy(F.xxhash64(*docs.columns))
    often = often.withColumn("_sh_rank", F.row_number().over(order)).where("_sh_rank = 1")
    return once.unionByName(often.select(*docs.columns))
