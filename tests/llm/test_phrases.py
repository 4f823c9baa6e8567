"""Phrase collocations against brute force, with many packs, partitions and cut texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from railpulse.llm import phrases

DOCS = "doc_id long, text string, lang string, n long, phrase string, rank int"


def brute(rows, longest, min_count, top, share=100):
    words, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            words[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    found = {k: v for k, v in f.items() if v >= min_count}
    out = {}
    for (lang, p), a in found.items():
        if len(p) == 1:
            continue
        longer = [v for (m, q), v in found.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * v >= share * a for v in longer):
            continue
        cuts = [(1000 * a * words[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[(lang, p[:k])], f[(lang, p[k:])], words[lang]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, v in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(v)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["the", "of", "New", "York", "é", "日本", "a\x00b", "x1", "|", "-"] + [f"w{i}" for i in range(25)]
    set_phrases = ["new york city hall", "of the", "w1 w2 w3 w4 w5 w6", "日本 é"]

    def text(n):
        return "".join(rng.choice([*words, *set_phrases]) + rng.choice([" ", "  ", "\t", ", ", ".\n", " \r\n ", " ! "]) for _ in range(n))

    made = [(i, text(rng.randint(0, 60)), rng.choice(["en", "en", "de", None]), 1, "x", 2) for i in range(120)]
    made += [(200, text(3_000), "en", 1, "x", 2), (201, "again and again " * 400, "de", 1, "x", 2), (202, None, "en", 0, None, None)]
    made += [(203, "", "fr", 0, "", 0), (204, " \n\t", "fr", 0, "", 0), (None, "of the", None, 0, "", 0), made[5], made[5], (205, "only", "xx", 0, "", 0)]
    return made


@pytest.mark.parametrize(("min_count", "share", "top"), [(12, 100, 2_000), (30, 60, 5)])
def test_collocations(spark, rows, monkeypatch, min_count, share, top):
    monkeypatch.setattr(phrases, "PACK_BYTES", 1_000)
    monkeypatch.setattr(phrases, "PART_MASS", 900)
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    got = phrases.collocations(d, longest=4, min_count=min_count, top=top, kept_share=share)
    expected = brute(rows, 4, min_count, top, share)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 5
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_empty_tables_and_nothing_frequent(spark, rows):
    d = spark.createDataFrame(rows, DOCS)
    assert phrases.collocations(d.where("false")).count() == 0
    assert phrases.collocations(d.where("text is null or text = ''")).count() == 0
    assert phrases.collocations(d, min_count=10**6).count() == 0


def test_scores_beyond_64_bits(spark):
    d = spark.createDataFrame([(1, "x y", "en")], "doc_id long, text string, lang string")
    big = 4 * 10**12
    counts = spark.createDataFrame([("en", "x", big), ("en", "y", big + 1), ("en", "x y", big)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "frequent_phrases", lambda *a: (counts, words))
        assert phrases.collocations(d).first().score == 1000 * big * 10**13 // (big * (big + 1))


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    keys = rng.zipf(1.3, 40_000).clip(max=5_000).astype(np.uint32)
    rng.shuffle(keys)
    bar = 100
    whole = phrases.MisraGries(len(keys) // bar + 1)
    for part in np.array_split(keys, 37):
        own = phrases.MisraGries(whole.capacity)
        own.add(*np.unique(part, return_counts=True))
        whole.merge(own)
        assert len(whole.keys) <= whole.capacity
    found, counts = np.unique(keys, return_counts=True)
    assert set(found[counts >= bar].tolist()) <= set(whole.keys.tolist())
    kept = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
    assert all(c - len(keys) / (whole.capacity + 1) <= kept.get(k, 0) <= c for k, c in zip(found.tolist(), counts.tolist()))


def test_segments_own_each_word_once():
    text = b"\n".join(b" ".join(f"w{i}".encode() for i in range(k, k + 7)) for k in range(400)) + b" " + b"z" * 500
    parts = list(phrases.segments(text, 4, 300))
    assert len(parts) > 20
    assert b" ".join(p[:own].replace(b"\n", b" ") for p, own in parts) == text.replace(b"\n", b" ")
    assert all(len(p[own:].split()) == 3 for p, own in parts[:-2])


def test_keys_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 3_000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        data = phrases.squeezed(keys)
        assert (phrases.unsqueezed(memoryview(data)) == keys).all() and len(data) <= 10 + 4.2 * n
