"""Languages: automata and phrases against brute force, held-out labels, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from railpulse.llm import language
from railpulse.llm.common import texts_of


def brute_phrases(text, known):
    n, i = 0, 0
    for start in range(0, len(text), language.WINDOW):
        window = text[start : start + language.WINDOW]
        i = 0
        while i < len(window):
            k = 1
            while i + k < len(window) and window[i : i + k + 1] in known:
                k += 1
            i += k if window[i : i + 1] in known else 1
            n += 1
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(5)
    known = ["".join(rng.choices("abc ", k=400)).encode(), "".join(rng.choices("abé ", k=300)).encode(), b"x"]
    parser = language.Parser([{"bytes": len(k)} | {p: a.tobytes() for p, a in language.suffix_automaton(k).items()} for k in known])
    texts = ["".join(rng.choices("abcdé ", k=rng.choice([0, 1, 5, 80, 700]))).encode() for _ in range(60)] + [known[0], b"", b"zzzz", b"x" * 1_300]
    offsets = np.cumsum([0, *map(len, texts)])
    got = parser.phrases(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    assert got.tolist() == [[brute_phrases(t, k) for k in known] for t in texts]


def test_automata_read_exactly_the_substrings():
    text = b"abracadabra abab"
    a = language.suffix_automaton(text)
    step = {}
    for s, c, t in zip(a["source"].tolist(), a["byte"].tolist(), a["target"].tolist()):
        step[(s, c)] = t
    seen, front = {b""}, [(b"", 0)]
    while front:
        word, state = front.pop()
        for (s, c), t in step.items():
            if s == state:
                seen.add(word + bytes([c]))
                front.append((word + bytes([c]), t))
    assert seen == {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}


def test_plain_text():
    column = pa.array(["L'ÉTÉ, 12 fois…", "", "  a\n\nB", "×Ö", None], pa.string()).cast(pa.binary())
    (t,) = texts_of(column)
    data, offsets = language.plain(t)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])] == ["l été fois…", "", "a b", "×ö", ""]


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = language.report(d).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.99


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = {"en": ["the", "thing", "with"], "de": ["der", "schön", "über"], "日": ["日本", "語"]}
    rows = [(i, " ".join(rng.choices(words[k], k=8)), k, "x", 0.5) for i in range(90) for k in [rng.choice(list(words))]]
    rows += [(100, None, "en", "", 0.0), (101, "", "en", "", 0.0), (102, "12 — !", "de", "", 0.0), (103, "über " * 50_000, None, "", 0.0), (None, "the thing", "en", "", 0.0)]
    rows += [rows[0], rows[0], (104, "ЖЖЖ", None, "", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_odd_rows(spark, docs):
    got = language.report(docs.repartition(3)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"]
    assert [by[i].score for i in (100, 101, 102)] == [0.0, 0.0, 0.0] and not by[None].held_out
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 90").collect()}
    assert all(by[i].lang_pred == t for i, t in truth.items())
    least = min((m.bytes, m.lang) for m in language.fit(docs).select("bytes", "lang").collect())
    assert by[104].lang_pred == least[1]  # as many phrases everywhere, cheapest in the shortest text


def test_nothing_to_learn_from(spark, docs):
    for d in (docs.withColumn("lang", docs.lang.substr(1, 0)).where("false"), docs.selectExpr("doc_id", "text", "cast(null as string) as lang")):
        assert {(r.lang_pred, r.score) for r in language.report(d).collect()} <= {("und", 0.0)}


def test_bounds_and_repeats(spark, docs):
    models = language.fit(docs, language_bytes=300, model_bytes=100_000).collect()
    assert sorted(m.lang for m in models) == ["de", "en", "日"] and all(m.bytes <= 300 for m in models)
    again = language.fit(docs.union(docs).repartition(5), language_bytes=300, model_bytes=100_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, models))
    assert all(m.bytes <= 256 for m in language.fit(docs, model_bytes=10).collect())
    long = spark.createDataFrame([(1, "wort " * 1_000, "de")], "doc_id long, text string, lang string")
    assert [m.bytes for m in language.fit(long.unionAll(long), 400).collect()] == [400]
