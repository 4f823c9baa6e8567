"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import Shared

# Pre-tokens whose counts a task remembers; then it starts anew.
MEMO = 200_000
MEMO_LENGTH = 64
# Symbols that are merged at once.
MERGE_SYMBOLS = 1 << 18
TEXTS_AT_ONCE = 200
# Fixed value: how the vocabulary's pre-tokenizer splits a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte.

    Printable Latin-1 bytes stand for themselves, the others for the code points
    from 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table of a tokenizer file: rank and result of every pair of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``none`` where the pair doesn't merge."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token.

        All pre-tokens lie in one ragged array. A round finds each one's lowest rank,
        applies that pair at all its places in it (from the left where they overlap),
        and closes up the array. Pre-tokens with no pair left are done.
        """
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        counts = lengths.copy()
        while len(symbols) > 1:
            rank = np.full(len(symbols), self.none)
            inner = owner[:-1] == owner[1:]
            rank[:-1][inner] = self.ranks_of(symbols[:-1][inner], symbols[1:][inner])
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            live = np.repeat(lowest < self.none, sizes)
            chosen = live & (rank == np.repeat(lowest, sizes))
            # In a run of overlapping places every second one counts, from the left.
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
            at = at[even]
            symbols = symbols.copy()
            symbols[at] = self.merged[rank[at]]
            live[at + 1] = False
            np.subtract.at(counts, owner[at], 1)
            symbols, owner = symbols[live], owner[live]
        return counts


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Number of tokens of every whole text, as the tokenizer file's library counts.

    The driver reads the file once and broadcasts its merge table, a few megabytes.
    Texts are cut at special strings (a token each), then into pre-tokens; each
    distinct pre-token of a batch is merged once, and a bounded memo carries the
    frequent ones from batch to batch. NULL and empty texts have 0 bytes and tokens.
    Rows are only mapped: repeated rows, copies and NULL ids come out as they come
    in. Returns doc_id, n_bytes, n_tokens, over_limit; other columns are not read.
    """
    shared = Shared(docs.sparkSession, Vocabulary(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.get()
        split = regex.compile(PRE_TOKENS).findall
        special = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        memo: dict[str, int] = {}

        def learn(new: list[str]) -> dict[str, int]:
            found: dict[str, int] = {}
            part: list[str] = []
            size = 0
            for i, token in enumerate(new):
                part.append(token)
                size += len(token)
                if size >= MERGE_SYMBOLS or i == len(new) - 1:
                    found.update(zip(part, vocabulary.count([t.encode() for t in part]).tolist()))
                    part, size = [], 0
            return found

        for batch in batches:
            texts = batch.column(1)
            n_bytes, n_tokens = [], []
            for lo in range(0, len(batch), TEXTS_AT_ONCE):
                pieces, extra = [], []
                for text in texts.slice(lo, TEXTS_AT_ONCE).to_pylist():
                    text = text or ""
                    n_bytes.append(len(text.encode()))
                    specials = special.findall(text)
                    extra.append(len(specials))
                    pieces.append([p for s in special.split(text) for p in split(s)] if specials else split(text))
                new = set().union(*pieces).difference(memo)
                if len(memo) > MEMO:
                    memo.clear()
                    new = set().union(*pieces)
                here = learn(list(new))
                memo.update((k, v) for k, v in here.items() if len(k) <= MEMO_LENGTH)
                long = {k: v for k, v in here.items() if len(k) > MEMO_LENGTH}
                for tokens, more in zip(pieces, extra):
                    get = memo.__getitem__ if not long else lambda t: memo[t] if t in memo else long[t]
                    n_tokens.append(sum(map(get, tokens)) + more)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    ids = dict(docs.dtypes)["doc_id"]
    counted = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {ids}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
