"""Phrase collocations: Misra-Gries summaries find every frequent n-gram, a second pass counts exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import WordHash, byte_class, lower_table, mixed, one_row, stage

# Longest phrase, least count of a candidate, and phrases reported per language.
MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2_000
# Bytes of text in a pack, the unit that tasks read, and n-grams that one hash partition counts.
PACK_BYTES, PART_MASS = 2 << 20, 8_000_000
# Packs of a task of the second pass.
TASK_PACKS = 4
# Tables into which a language's ranking is dealt before its best meet.
RANK_BUCKETS = 64

# Normalised text: lower case, one space between words, one line feed between pieces.
SPACE, BREAK = 0x20, 0x0A
WORD = ~byte_class((SPACE, SPACE), (BREAK, BREAK))


def _normal_table() -> bytes:
    table = lower_table()
    table[0x09] = SPACE
    for mark in b".,;:!?\x0a\x0b\x0c\x0d":
        table[mark] = BREAK
    return table.tobytes()


NORMAL = _normal_table()
BLANKS, BREAKS = re.compile(b"  +"), re.compile(b" ?\n[ \n]*")


def normalised(text: bytes) -> bytes:
    """Pieces between line feeds, their words between single spaces."""
    return BREAKS.sub(b"\n", BLANKS.sub(b" ", text.translate(NORMAL))).strip(b" \n")


def segments(text: bytes, longest: int, limit: int = PACK_BYTES) -> Iterator[tuple[bytes, int]]:
    """A normalised text in segments of about ``limit`` bytes: (bytes, owned bytes).

    N-grams belong to the segment that owns their first byte. A segment runs on for
    ``longest`` - 1 words beyond what it owns, so that it holds its n-grams whole.
    """
    start = 0
    while len(text) - start > 2 * limit:
        gaps = (m.start() for m in re.compile(b"[ \n]").finditer(text, start + limit))
        cut = next(gaps, len(text))
        end = cut
        for _ in range(longest - 1):
            end = next(gaps, len(text))
        yield text[start:end], cut - start
        start = cut + 1
    if start < len(text):
        yield text[start:], len(text) - start


PACKS = "pack long, langs array<string>, sizes array<long>, owned array<long>, words array<long>, texts binary"


def pack_texts(docs: DataFrame, longest: int) -> DataFrame:
    """Rows of some megabytes of normalised, compressed text, with the language and words of each segment."""
    lists = [("langs", pa.string()), ("sizes", pa.int64()), ("owned", pa.int64()), ("words", pa.int64())]
    schema = pa.schema([("pack", pa.int64()), *[(n, pa.list_(t)) for n, t in lists], ("texts", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            langs, texts, owned, words = zip(*rows)
            row = {"pack": pack, "langs": langs, "sizes": [len(t) for t in texts], "owned": owned, "words": words}
            return pa.RecordBatch.from_pylist([row | {"texts": squeeze.compress(b"".join(texts))}], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for part, own in segments(normalised(text.as_py() or b""), longest):
                    gaps = part.count(b" ", 0, own) + part.count(b"\n", 0, own)
                    rows.append((lang.as_py(), part, own, gaps + 1))
                    size += len(part)
                    if size >= PACK_BYTES:
                        yield out()
                        rows, size, pack = [], 0, pack + 1
        if rows:
            yield out()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.col("text").cast("binary").alias("text")).mapInArrow(scan, PACKS)


class Pack:
    """Words of a pack, and the n-grams that its segments own."""

    def __init__(self, row: dict, longest: int):
        raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, sum(row["sizes"])))
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = np.cumsum(np.array(row["sizes"], dtype=np.int64))
        first = ends - row["sizes"]
        inside = np.concatenate(([False], WORD[data], [False]))
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[first] = cut[ends] = True
        starts = inside[1:-1] & (~inside[:-2] | cut[:-1])
        stops = inside[1:-1] & (~inside[2:] | cut[1:])
        self.data, self.starts, self.ends = data, np.flatnonzero(starts), np.flatnonzero(stops) + 1
        segment = np.searchsorted(ends, self.starts, side="right")
        self.owned = self.starts < (first + row["owned"])[segment] if len(ends) else np.empty(0, dtype=bool)
        self.piece = segment + np.concatenate(([0], np.cumsum(data == BREAK)))[self.starts]
        names = sorted(set(row["langs"]))
        self.langs = names
        self.lang = np.array([names.index(x) for x in row["langs"]], dtype=np.int64)[segment] if len(ends) else segment
        self.longest = longest

    def grams(self, n: int) -> np.ndarray:
        """Where the owned n-grams of ``n`` words begin: the numbers of their first words."""
        size = max(0, len(self.starts) - n + 1)
        return np.flatnonzero(self.owned[:size] & (self.piece[:size] == self.piece[n - 1 : n - 1 + size]))

    def keys(self, parts: int) -> np.ndarray:
        """The keys of all n-grams, by number of words and place: hash partition and 32 bits more."""
        h = WordHash(13)
        seeds = np.frombuffer(b"".join(seed_of(x) for x in self.langs), dtype=np.uint64)
        words = h.words(self.data, self.starts, self.ends)
        out = []
        for n in range(1, self.longest + 1):
            at = self.grams(n)
            k = mixed(h.windows(words, n)[at] ^ seeds[self.lang[at]] ^ np.uint64(n))
            out.append(((k >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (k & np.uint64(0xFFFFFFFF)))
        return np.concatenate(out)

    def word_ids(self) -> np.ndarray:
        """A number per word: equal for equal words of one language."""
        ids = slices(self.data, self.starts, self.ends).dictionary_encode().indices.to_numpy().astype(np.int64)
        return ids * len(self.langs) + self.lang


def seed_of(name: str) -> bytes:
    """64 bits of a name, the same in every process."""
    return hashlib.blake2b(name.encode(), digest_size=8).digest()


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given ranges of bytes as an Arrow array."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal values: one place of each group, the group of each place, and the groups' sizes, by value."""
    order = np.argsort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    group = np.empty(len(values), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], group, np.diff(np.append(starts, len(values)))


def squeezed(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys with their high bits as gaps between set bits, whichever split is smallest."""
    n = len(keys)
    low = min((4, 3, 2), key=lambda b: b * n + (n + (1 << (32 - 8 * b))) / 8)
    marks = np.zeros(n + (1 << (32 - 8 * low)), dtype=bool)
    marks[(keys.astype(np.int64) >> (8 * low)) + np.arange(n)] = True
    small = keys.astype("<u4").view(np.uint8).reshape(n, 4)[:, :low]
    return bytes([low]) + n.to_bytes(4, "little") + small.tobytes() + np.packbits(marks).tobytes()


def unsqueezed(data: memoryview) -> np.ndarray:
    low, n = data[0], int.from_bytes(data[1:5], "little")
    keys = np.zeros((n, 4), dtype=np.uint8)
    keys[:, :low] = np.frombuffer(data[5 : 5 + low * n], dtype=np.uint8).reshape(n, low)
    marks = np.unpackbits(np.frombuffer(data[5 + low * n :], dtype=np.uint8))
    high = np.flatnonzero(marks)[:n] - np.arange(n)
    return keys.view("<u4").ravel() + (high << (8 * low)).astype(np.uint32)


class MisraGries:
    """Counters of at most ``capacity`` keys; none falls short by more than mass / (capacity + 1).

    Summaries of one capacity merge into one with the same bound over both masses:
    whenever a cut takes one off a key, it takes one off ``capacity`` others too.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        every, inverse = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate((self.counts, counts)), minlength=len(every)).astype(np.int64)
        if len(every) > self.capacity:
            at = len(total) - self.capacity - 1
            total = total - np.partition(total, at)[at]
            every, total = every[total > 0], total[total > 0]
        self.keys, self.counts = every, total

    def merge(self, other: MisraGries) -> None:
        self.add(other.keys, other.counts)


# Per pack and hash partition: 32 bits of each distinct n-gram, and the counts of those that occur again.
BLOCKS = "part long, pack long, keys binary, again binary, counts binary, mass long"


def pack_blocks(packs: DataFrame, parts: int, longest: int) -> DataFrame:
    """The n-grams of each pack, counted within it and dealt to hash partitions."""
    schema = pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary()), ("again", pa.binary()), ("counts", pa.binary()), ("mass", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.unique(Pack(row, longest).keys(parts), return_counts=True)
                cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
                out = []
                for part in np.flatnonzero(np.diff(cuts)):
                    k, c = keys[cuts[part] : cuts[part + 1]].astype(np.uint32), counts[cuts[part] : cuts[part + 1]]
                    again = np.packbits(c > 1).tobytes()
                    more = (c[c > 1] - 2).astype(np.uint32).tobytes()
                    out.append((int(part), row["pack"], squeezed(k), again, more, int(c.sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return packs.mapInArrow(scan, BLOCKS)


def frequent_masks(blocks: DataFrame, parts: int, min_count: int) -> DataFrame:
    """(pack, part, mask): which n-grams of a pack's block may be frequent, a bit each.

    Every n-gram that occurs ``min_count`` times has its bit set: a partition's
    summary has more counters than its mass divided by that count, so it survives, and
    a count of the survivors finds it often enough. Others have it set only if they
    share the 32 bits of a frequent one.
    """

    def read(keys: pa.Scalar, again: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        k = unsqueezed(memoryview(keys.as_buffer()))
        c = np.unpackbits(np.frombuffer(again.as_buffer(), dtype=np.uint8), count=len(k)).astype(np.int64)
        c[c > 0] = np.frombuffer(counts.as_buffer(), dtype=np.uint32).astype(np.int64) + 1
        return k, c + 1

    def meet(table: pa.Table) -> pa.Table:
        mass = sum(table.column("mass").to_pylist())
        summary = MisraGries(mass // min_count + 1)
        columns = [table.column(c) for c in ("keys", "again", "counts")]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for row in zip(*columns):
            held.append(read(*row))
            if sum(len(k) for k, _ in held) > 2 * summary.capacity:
                summary.add(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            summary.add(*map(np.concatenate, zip(*held)))
        # The blocks once more: what survived is counted, by its key.
        frequent, places = summary.keys, []
        total = np.zeros(len(frequent) + 1, dtype=np.int64)
        for row in zip(*columns):
            k, c = read(*row)
            at = np.searchsorted(frequent, k)
            at[at == len(frequent)] = 0
            place = np.where(frequent[at] == k, at, -1).astype(np.int32) if len(frequent) else np.full(len(k), -1, dtype=np.int32)
            np.add.at(total, place, c)  # the last place takes the others
            places.append(place)
        enough = total >= min_count
        enough[-1] = False
        masks = [np.packbits(enough[place]).tobytes() for place in places]
        return pa.table({"pack": table.column("pack"), "part": table.column("part"), "mask": pa.array(masks, pa.binary())})

    return blocks.repartition(parts, "part").groupBy("part").applyInArrow(meet, "pack long, part long, mask binary")


COUNTS = "part long, lang string, phrases binary, counts binary"


def exact_counts(packs: DataFrame, masks: DataFrame, parts: int, longest: int, min_count: int) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases that occur ``min_count`` times in a language.

    A pack counts those n-grams that its masks let through, by the words themselves, and
    sends them to their hash partition, a line each, as one row per partition and language.
    """

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        mask_of = dict(zip(right.column("part").to_pylist(), right.column("mask")))
        for row in (r for b in left.to_batches(max_chunksize=1) for r in b.to_pylist()):
            p = Pack(row, longest)
            keys = p.keys(parts)
            one, group, _ = groups_of(keys)
            cuts = np.searchsorted(keys[one], np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            hot = np.zeros(len(one), dtype=bool)
            for part, mask in mask_of.items():
                bits = np.frombuffer(mask.as_buffer(), dtype=np.uint8)
                size = int(cuts[part + 1] - cuts[part])
                hot[cuts[part] : cuts[part + 1]] = np.unpackbits(bits, count=size).astype(bool)
            hot = hot[group]
            part_of = (keys >> np.uint64(32)).astype(np.int64)
            words = p.word_ids()
            width = int(words.max(initial=0)) + 1
            # Number of the phrase that begins at a word; a phrase goes on only where the one before is counted.
            ids, done = np.zeros(len(words), dtype=np.int64), 0
            found = []
            for n in range(1, longest + 1):
                at = p.grams(n)
                parts_here, some_here = part_of[done : done + len(at)], hot[done : done + len(at)]
                done += len(at)
                some_here &= ids[at] >= 0
                some, to = at[some_here], parts_here[some_here]
                one, group, times = groups_of(ids[some] * width + words[some + n - 1])
                ids = np.full(len(words), -1, dtype=np.int64)
                ids[some] = group
                first = some[one]
                found.append((to[one], p.lang[first], p.starts[first], p.ends[first + n - 1], times))
            to, lang, start, end, times = map(np.concatenate, zip(*found))
            order = np.lexsort((lang, to))
            to, lang, start, end, times = (x[order] for x in (to, lang, start, end, times))
            edges = np.flatnonzero(np.diff(to, prepend=-1) | np.diff(lang, prepend=-1))
            offsets = pa.array(np.append(edges, len(to)), pa.int64())
            texts = slices(p.data, start, end).cast(pa.large_string()).cast(pa.string())
            lines = pc.binary_join(pa.LargeListArray.from_arrays(offsets, texts), "\n")
            counts = [c.astype(np.uint32).tobytes() for c in np.split(times, edges[1:])] if len(edges) else []
            names = [p.langs[i] for i in lang[edges]]
            out.append(pa.table({"part": to[edges], "lang": pa.array(names, pa.string()), "phrases": lines.cast(pa.binary()), "counts": pa.array(counts, pa.binary())}))
        return pa.concat_tables(out) if out else pa.table({"part": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "phrases": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        lines = pc.split_pattern(table.column("phrases").cast(pa.large_binary()), b"\n").combine_chunks()
        counts = b"".join(c.as_py() for c in table.column("counts"))
        sizes = np.diff(lines.offsets.to_numpy())
        lang = table.column("lang").combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        flat = pa.table({"lang": lang, "phrase": lines.flatten(), "f": np.frombuffer(counts, dtype=np.uint32).astype(np.int64)})
        sums = flat.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("f_sum"), min_count))
        phrase = sums.column("phrase").cast(pa.large_string()).cast(pa.string())
        return pa.table({"lang": sums.column("lang"), "phrase": phrase, "f": sums.column("f_sum")})

    tasks = max(1, -(-packs.count() // TASK_PACKS))
    left, right = (df.repartition(tasks, "pack").groupBy("pack") for df in (packs, masks))
    counted = left.cogroup(right).applyInArrow(count, COUNTS)
    return counted.repartition(parts, "part").groupBy("part").applyInArrow(total, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, longest: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, f) of all phrases of up to ``longest`` words that occur
    ``min_count`` times in a language, and the words (lang, n) of every language.

    Languages are those of the rows, NULL counting as "und"; phrases lie within pieces.
    """
    packs = stage(pack_texts(docs, longest), "phrase-packs")
    words = packs.select(F.explode(F.arrays_zip("langs", "words")).alias("s")).groupBy(F.col("s.langs").alias("lang"))
    words = stage(words.agg(F.sum("s.words").alias("n")), "phrase-words")
    mass = longest * (one_row(words.agg(F.sum("n").alias("n")))["n"] or 0)
    parts = max(1, -(-mass // PART_MASS))
    masks = stage(frequent_masks(pack_blocks(packs, parts, longest), parts, min_count), "phrase-masks")
    return stage(exact_counts(packs, masks, parts, longest, min_count), "phrase-counts"), words


def collocations(
    docs: DataFrame, longest: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int | None = TOP, kept_share: int = 100
) -> DataFrame:
    """The phrases of 2 to ``longest`` words whose parts meet far more often than by chance.

    Returns (lang, rank, phrase, a, l, r, n, score). ``a`` counts the phrase, ``n`` all
    words of the language; a cut after the first words gives the counts ``l`` and ``r``
    of its parts and floor(1000 * a * n / (l * r)); the cut of lowest score counts, the
    earliest of equals. A phrase goes if a longer one contains it and has at least
    ``kept_share`` percent of its count. The ``top`` of each language come back (None:
    all), by score and count descending, then by the phrase's bytes.

    NULL texts are empty, empty and blank ones hold no words, NULL languages count as
    "und"; repeated rows count as often as they occur; other columns are not read.
    Without candidates there are no rows. Counts of parts are exact, since a part occurs
    at least as often as its phrase. Only the phrase one word longer has to be looked
    at: what lies between a phrase and a longer one occurs at least as often as the latter.
    """
    counts, words = frequent_phrases(docs, longest, min_count)
    w = F.split("phrase", " ")
    phrases = counts.withColumn("w", w).where(F.size("w") > 1)

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    cuts = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1),
        lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.size("w") - k).alias("right")),
    )
    cut = phrases.select("lang", "phrase", F.size("w").alias("size"), F.col("f").alias("a"), F.inline(cuts))
    # The longest part but one at either end: the phrases that this one contains.
    inner = F.array_compact(F.array(F.when(F.col("k") == F.col("size") - 1, F.col("left")), F.when(F.col("k") == 1, F.col("right"))))
    inside = cut.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("longer").alias("longer"))

    def counted(side: str, name: str) -> DataFrame:
        return counts.select(F.col("lang").alias(f"_{name}_lang"), F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))

    cut = cut.join(counted("left", "l"), (F.col("lang") == F.col("_l_lang")) & (F.col("left") == F.col("_l")))
    cut = cut.join(counted("right", "r"), (F.col("lang") == F.col("_r_lang")) & (F.col("right") == F.col("_r")))
    cut = cut.join(words.select(F.col("lang").alias("_n_lang"), "n"), F.col("lang") == F.col("_n_lang"))
    # Exact beyond 64 bits.
    score = F.expr("(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    same = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
    kept = best.join(inside, same, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < kept_share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        dealt = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(RANK_BUCKETS))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
