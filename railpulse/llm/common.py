"""Words of Arrow text columns as numpy arrays, staged tables, joins on hot keys."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from railpulse.session import work_folder

# Bytes of text that a task turns into arrays at once.
CHUNK_BYTES = 1 << 20


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared work folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several
    readers share one computation.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame) -> dict:
    """The only row of an aggregate."""
    return df.first().asDict()


class Shared:
    """A broadcast value of this package's classes; tasks unpack it with ``get``."""

    def __init__(self, spark: SparkSession, value: object):
        self._data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self._data.value)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set in the given closed ranges of bytes."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Words between ASCII white space, and words of letters, digits and all other scripts.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


class Texts:
    """Some consecutive texts: their bytes and where each begins and ends."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word; no word spans two texts."""
        n = len(self.data)
        inside = table[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = cut[1:n] | ~inside[:-1]
            after[:-1] = cut[1:n] | ~inside[1:]
        starts = np.flatnonzero(inside & before)
        ends = np.flatnonzero(inside & after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def texts_of(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a binary column into runs of about ``limit`` bytes, at least one text each.

    NULL counts as an empty text. Bytes are not copied.
    """
    if len(column) == 0:
        return
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield Texts(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit sums over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Polynomial hashes of slices of a sequence, modulo 2**64, from prefix sums."""

    def __init__(self, seed: int):
        self.base = np.uint64(mixed(np.array([seed], dtype=np.uint64))[0] | np.uint64(1))
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers[0]) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base), np.full(size, self.inverse)
            up[0] = down[0] = 1
            self._powers = (np.cumprod(up), np.cumprod(down))
        return self._powers[0][:n], self._powers[1][:n]

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


class WordHash:
    """64-bit hashes of words and of windows of consecutive words.

    ``bytes_as`` maps bytes before hashing, such as to lower case. The same seed
    gives the same hashes in every process.
    """

    def __init__(self, seed: int = 1, bytes_as: np.ndarray | None = None):
        table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.table = table if bytes_as is None else table[bytes_as]
        self.bytes, self.sequence = Rolling(2 * seed + 1), Rolling(2 * seed + 2)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.bytes.slices(self.table[data], starts, ends)
        return mixed(h + (ends - starts).astype(np.uint64))

    def windows(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hash of each run of ``length`` words; run i begins at word i."""
        n = max(0, len(words) - length + 1)
        at = np.arange(n)
        return mixed(self.sequence.slices(words, at, at + length))


def same_text(text_of_word: np.ndarray, length: int) -> np.ndarray:
    """Flags for the windows of ``length`` words that lie in one text."""
    n = max(0, len(text_of_word) - length + 1)
    return text_of_word[:n] == text_of_word[length - 1 : length - 1 + n]


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Flags of n words; set where a window of ``length`` words from a start lies."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, starts + length, 1)
    return np.cumsum(steps[:-1]) > 0
