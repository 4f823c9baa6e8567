"""The training-data operators against brute force, on small texts with every odd case."""

import gzip
import hashlib
import random
import zlib
from base64 import b32encode
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from railpulse.llm import decontam, lines, mixing, quality, simhash, substrings, tokens, toxicity, vectors, warc
from railpulse.llm.components import components

# Extra columns with names that the operators use inside or return.
DOCS = "doc_id long, text string, source string, size long, fp long, score double, span string"


@pytest.fixture(scope="module")
def texts():
    """Words, copies, near copies, NULLs, blanks, a long text and repeated rows."""
    rng = random.Random(7)
    words = ["the", "of", "Ärger", "x1", "naïve", "and", "日本", "run", "a", "B"] + [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(words, k=60))
    made = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40)]
    made += [made[3], made[3] + " tail", passage, "start " + passage, passage + "\tend", None, "", "  \n ", "one"]
    made += [" ".join(rng.choices(words, k=6_000)) + " " + passage, "12 34\nMenu\nMenu 7", "Menu\nMenu 8", "x <|endoftext|> y's  \n\n z"]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 4}" if i % 5 else None, i, i, 0.5, "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], "s1", 0, 0, 0.0, "y"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_words(text):
    return (text or "").encode().split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_empty_tables(spark, docs):
    none = docs.where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        lines.report(none),
        mixing.mix_sources(none),
        simhash.near_duplicates(none),
        decontam.report(none, items),
        substrings.remove_repeats(none),
        toxicity.toxicity(none, labels),
        quality.quality(none, labels),
        vectors.nearest(pages, pages),
    ):
        assert df.count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {0.5}
    assert {r.score for r in quality.quality(docs, labels).collect()} == {0.5}


def test_lines(spark):
    head = "a b c d e f g h"
    rows = [(i, f"keep {i}x\nCookie notice {i}\n\n{head} same {'end' if i % 2 else 'fin'} {i} k l m n o\nown{'q' * (i + 1)}", 9) for i in range(6)]
    rows += [(6, None, 0), (7, "", 0), (8, "Cookie notice 77", 0), (None, "Cookie notice 5", 0), (0, rows[0][1], 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    got = {(r.doc_id, r.text): r for r in lines.drop_recurring_lines(d).collect()}
    assert (0, rows[0][1]) in got  # the first document keeps its lines
    assert got[(3, "\nowntttt".replace("tttt", "qqqq"))]._ld_dropped == 3
    assert got[(8, "")]._ld_dropped == got[(None, "")]._ld_dropped == 1
    assert got[(6, None)]._ld_lines == 0 and got[(7, "")]._ld_lines == 1
    kept = lines.without_recurring_lines(d)
    assert kept.columns == d.columns and kept.where("doc_id = 8 or text like '%Cookie%77%'").count() == 0
    # Long lines with one beginning and different ends are no template.
    loose = [(i, f"{head} " + " ".join(f"{c}{'z' * i}" for c in "ijklmnopqrstuvwx")) for i in range(9)]
    assert lines.report(spark.createDataFrame(loose, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 0


def dropped(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.n_dropped for r in lines.report(d).collect()}


def test_long_lines_recur_from_two_documents_on(spark):
    long = " ".join(f"{c}{d}" for c in "abcdef" for d in "uvwxyz")
    numbers = " ".join(map(str, range(12)))
    rows = [(i, f"{long}\nShort notice\n{numbers} kg\n" + "own" * (i + 1)) for i in range(2)]
    rows += [(i, "Short notice\n" + "own" * (i + 1)) for i in range(2, 4)]
    assert dropped(spark, rows) == {0: 0, 1: 1, 2: 0, 3: 0}
    assert dropped(spark, [*rows, (4, "Short notice")]) == {0: 0, 1: 2, 2: 1, 3: 1, 4: 1}


def test_odd_lines_keep_only_themselves_out(spark):
    head = "a b c d e f g h"
    line = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyzABCDEF"]
    other = [f"v{c}" for c in "abcdefghijklmnopqrstuvwxyzABCDEF"]

    def changed(words, at):
        return f"{head} " + " ".join("odd" + "x" * at if i % 16 == at else w for i, w in enumerate(words))

    rows = [(0, f"{head} " + " ".join("q" * (i + 1) for i in range(32)))]  # an outlier comes first
    rows += [(i, changed(line, i)) for i in range(1, 9)] + [(i, changed(other, i)) for i in range(9, 12)]
    rows += [(3, rows[3][1])]
    assert dropped(spark, rows) == {i: int(i not in (0, 1, 9)) for i in range(12)}


def brute_dropped(rows):
    placed, seen = [], {}
    for doc, text in rows:
        for line in text.split("\n"):
            t = ["<*>" if any(c.isdigit() for c in w) else w for w in line.split()]
            width = -(-(len(t) - 8) // 8)
            pieces = [t[a : a + width] for a in range(8, len(t), width)] if len(t) > 8 else [[]]
            bar = 2 if len(t) >= 9 and t[:8].count("<*>") <= 2 else 5
            keys = [(len(t), *t[:8], i, *p) for i, p in enumerate(pieces)] if any(w != "<*>" for w in t) else []
            placed.append((doc, bar, keys))
            for k in keys:
                seen.setdefault(k, set()).add(doc)
    out = dict.fromkeys((doc for doc, _ in rows), 0)
    for doc, bar, keys in placed:
        again = sum(len(seen[k]) >= bar and min(seen[k]) < doc for k in keys)
        out[doc] += bool(keys) and 2 * again >= len(keys)
    return out


def test_short_lines_that_share_only_their_beginning_stay(spark):
    ends = {n: [" ".join(f"{c}{'z' * (n * i + 1)}" for c in "abcdefg"[: n - 8]) for i in range(6)] for n in range(9, 16)}
    rows = [(i, "\n".join(f"{head} {e[i]}" for e in ends.values() for head in ("1 2 3 4 5 6 7 8", "s t u v w x y z"))) for i in range(6)]
    assert dropped(spark, rows) == dict.fromkeys(range(6), 0)
    rng = random.Random(4)
    heads = ["a b c d e f g h", "a b c d e 1 2 3", "a b c 9 8 7 6 5"]
    tails = [["p", "q", f"r{'r' * k}"] for k in range(40)]
    made = [(i, "\n".join(f"{rng.choice(heads)} " + " ".join(rng.choice(rng.choice(tails)) for _ in range(rng.randint(0, 12))) for _ in range(4))) for i in range(60)]
    expected = brute_dropped(made)
    assert dropped(spark, made) == expected and 20 < sum(expected.values()) < 220


def test_texts_without_id_are_documents_by_content(spark):
    rows = [(None, f"Cookie notice\n{'own' * (i + 1)}") for i in range(6)] + [((1 << 63) - 1, "Own line")]
    d = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").repartition(3)
    kept = [r.text for r in lines.drop_recurring_lines(d).collect()]
    once = {t for t in kept if "Cookie" in t}
    assert len(kept) == 8 and len(once) == 1 and len(set(kept)) == 7
    with_id = d.union(spark.createDataFrame([((1 << 63) - 1, rows[0][1])], d.schema))
    got = lines.drop_recurring_lines(with_id).where("_ld_dropped = 0").collect()
    assert {(r.doc_id, r.text) for r in got} == {rows[-1], ((1 << 63) - 1, rows[0][1])}


def test_lines_of_very_long_texts(spark):
    same = "All of these lines are the same notice of nothing at all"
    rows = [(0, "\n".join([same] * 200_000)), (1, "\n".join(f"{same}\n{i}" for i in range(100_000))), (2, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.drop_recurring_lines(d).collect()}
    assert (got[0]._ld_dropped, got[1]._ld_dropped, got[2]._ld_dropped) == (0, 100_000, 0)
    assert got[1].text == "\n".join(map(str, range(100_000))) and got[0].text == rows[0][1]


def test_templates_in_few_documents(spark):
    words = [f"w{c}{d}" for c in "abcdef" for d in "stuvwxyz"]
    assert dropped(spark, [(i, f"{' '.join(words)}\nown{'n' * i}") for i in range(4)]) == {0: 0, 1: 1, 2: 1, 3: 1}
    head = " ".join(words[:8])
    assert dropped(spark, [(i, f"{head} {'a' * (i + 1)} {'b' * (i + 1)} {'c' * (i + 1)}") for i in range(6)]) == dict.fromkeys(range(6), 0)
    variants = [(i, " ".join("odd" if k == 9 + i else w for k, w in enumerate(words[:40]))) for i in range(8)]
    outlier = [(8, f"{head} " + " ".join(f"z{w}" for w in words[8:40]))]
    assert dropped(spark, variants + outlier) == {0: 0} | dict.fromkeys(range(1, 8), 1) | {8: 0}


def test_warc(spark, tmp_path):
    payloads = [b"<a>", b"<b>\r\n\r\nWARC/1.1\r\n", b"", None, b"<a>", bytes(range(256)) * 400, b"<a>", b"<b>\r\n\r\nWARC/1.1\r\n"]
    rows = [(f"r{i}", i, f"http://x/{i}\n?" if i % 3 else None, p, "clash") for i, p in enumerate(payloads)]
    rows += [("r8", 6, "http://x/6", b"<a>", "clash"), ("r9", None, None, b"<a>", None)]
    records = spark.createDataFrame(rows, "record_id string, page_id long, url string, payload binary, ref_id string")
    warc.deduplicated_archives(records, str(tmp_path / "all"))
    got = warc.read_archives(spark, str(tmp_path / "all"), payloads=True).collect()
    assert len(got) == len(rows)
    by_digest = {}
    for r in got:
        by_digest.setdefault(r.payload_digest, []).append(r)
    for _, page, _, payload, _ in rows:
        group = by_digest[b32encode(hashlib.sha1(payload or b"").digest()).decode()]
        best = [r for r in group if r.record_type == "response"]
        assert len(best) == 1 and best[0].payload_ok and bytes(best[0].payload) == (payload or b"")
        assert best[0].page_id == max(p for _, p, _, x, _ in rows if (x or b"") == (payload or b"") and p is not None)
        assert all(r.refers_to == best[0].page_id for r in group if r.record_type == "revisit")
        assert {r.payload_bytes for r in group} == {len(payload or b"")}
    warc.deduplicated_archives(records, str(tmp_path / "some"), min_bytes=4)
    kinds = Counter((r.payload_bytes, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "some")).collect())
    assert kinds[(3, "response")] == 5 and kinds[(0, "response")] == 2


def test_tokens(docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for r in tokens.count_tokens(docs, path, 100).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100)
    v = tokens.Vocabulary(path)
    rng = random.Random(1)
    odd = ["aaaaaaa", "a" * 999, "ab" * 300, "éééé", "　" * 9] + ["".join(map(chr, rng.choices(range(97, 101), k=40))) for _ in range(50)]
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in odd]
    assert v.count([t.encode() for t in odd]).tolist() == expected


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, texts, block_bytes):
    items = [(1, " ".join(texts[0].split()[5:30])), (10, "One"), (2, None), (3, " "), (4, texts[44]), (4, texts[44]), (None, "MENU!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(docs, bench, block_bytes=block_bytes)
    split = lambda t: decontam.WORD.findall(lower(t).encode())
    for r in found.collect():
        w, hit, ids = split(r.text), set(), set()
        for item, t in items:
            g = split(t)
            k = min(13, len(g))
            for j in range(len(g) - k + 1 if k else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == g[j : j + k]:
                        hit |= set(range(i, i + k))
                        ids |= {str(item)} if item is not None else set()
        assert (r._dc_words, r._dc_hit, r._dc_items) == (len(w), len(hit), sorted(ids))
        assert r._dc_bad == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
    cut = decontam.remove_spans(docs, bench).where("doc_id = 0").first().text
    assert set(cut.split()) <= set(texts[0].split()) and len(cut.split()) == len(texts[0].split()) - 25


def test_decontamination_set_is_small_and_whole():
    """Windows against sets of words, with items that share passages, and few bytes for each."""
    import pickle
    import tracemalloc

    rng = random.Random(8)
    words = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(3_000)]
    shared = [rng.choice(words) for _ in range(200)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.choice([3, 12, 13, 14, 2_000])) + (shared if k % 10 == 0 else []))) for k in range(400)]
    items += [("i0 again", items[0][1].upper().replace("É", "é")), (None, items[1][1]), ("none", "..."), ("void", "")]
    size = sum(len(t.encode()) for _, t in items)
    tracemalloc.start()
    grams = decontam.Grams(((i, t.encode()) for i, t in items), 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * size and len(pickle.dumps(grams)) < 9 * size
    want = {}
    for item_id, text in items:
        found = decontam.WORD.findall(lower(text).encode())
        n = min(13, len(found))
        for i in range(len(found) - n + 1 if n else 0):
            want.setdefault(b" ".join(found[i : i + n]), set()).update([] if item_id is None else [item_id])
    got = {}
    for length, (hashes, which) in grams.lengths.items():
        assert (hashes[:-1] <= hashes[1:]).all()
        for w in which:
            got[grams.text(w, length)] = grams.items(w)
    assert got == want and len(grams.at) == len(want)


def test_decontamination_keeps_windows_of_equal_hash_apart(monkeypatch):
    monkeypatch.setattr(decontam.WordHash, "windows", lambda self, words, length: np.zeros(max(0, len(words) - length + 1), dtype=np.uint64))
    grams = decontam.Grams([("a", b"x y z x y"), ("b", b"x y q"), ("c", b"q")], 2)
    got = {grams.text(w, n): grams.items(w) for n, (_, which) in grams.lengths.items() for w in which}
    assert got == {b"x y": {"a", "b"}, b"y z": {"a"}, b"z x": {"a"}, b"y q": {"b"}, b"q": {"c"}}


def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(repeats * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        t = {s: repeats * sizes[s] if s in capped else left * w[s] / free for s in order}
        over = {s for s in order if s not in capped and t[s] > repeats * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 300), rng.choice(["a", "b", "é", "Z", None]), "clash") for i in range(400)]
    rows += [(400, "tiny text", "small", ""), (None, None, "a", ""), rows[0], (401, "v " * 9_000, "b", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix_sources(d, shard_docs=50).join(d.select("doc_id", "source").distinct(), "doc_id")
    got = got.collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(sizes)
    taken = Counter()
    for r in {(r.doc_id, r): r for r in got}.values():
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
    for r in got:
        taken[r.source] += r.taken
    for s in target:
        assert abs(taken[s] - target[s]) <= 16 * 12 + 0.01 * target[s]
    again = mixing.mix_sources(d.repartition(5), shard_docs=50)
    assert rows_of(again) == rows_of(mixing.mix_sources(d, shard_docs=50))


def test_mix_spans_are_the_words_taken(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.randint(0, 90))), rng.choice("abc")) for i in range(200)] + [(200, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_spans(d, shard_docs=50, keep=("text",))
    got = got.withColumn("mix", mixing.mixed_text(F.col("text"), F.col("spans"))).collect()
    assert len(got) == 201 and {len(r.spans) == 0 for r in got if r.taken == 0} == {True}
    for r in got:
        words = (r.text or "").split()
        assert all(0 <= s.start < s.end <= min(r.size, s.start + 16) and 1 <= s.repeats <= 3 for s in r.spans)
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:]))
        assert sum((s.end - s.start) * s.repeats for s in r.spans) == r.taken
        assert r.mix.split() == [w for s in r.spans for _ in range(s.repeats) for w in words[s.start : s.end]]
    assert any(0 < len(r.spans) and sum(s.end - s.start for s in r.spans) < r.size for r in got)


def test_mix_reruns_agree_without_ids(spark):
    rng = random.Random(8)
    rows = [(None, " ".join(rng.choices("abcdefgh", k=30)), "s") for _ in range(3_000)] + [(7, "x y z", "s")] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (mixing.mix_spans(x, shard_docs=50, keep=("text",)) for x in (d.repartition(3), d.orderBy(F.desc("text")).repartition(7)))
    assert rows_of(first.withColumn("spans", F.to_json("spans"))) == rows_of(second.withColumn("spans", F.to_json("spans")))


def test_repeated_rows_weigh_once_on_quality(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["Good", "words."] if i % 2 else ["bad", "!!", "###"], k=rng.randint(5, 60)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    learnt = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    more = d.union(spark.createDataFrame([rows[learnt]] * 200, d.schema)).repartition(4)
    scores = lambda x: {r.doc_id: round(r.score, 9) for r in quality.quality(x, labels).collect()}
    assert scores(more) == scores(d)


def brute_train(rows, epochs):
    """FTRL-proximal in a loop of dictionaries."""
    z, n, bias = {}, {}, "bias"

    def weight(k):
        total = z.get(k, 0.0)
        if abs(total) <= (0.0 if k == bias else toxicity.L1):
            return 0.0
        sign = 1 if total > 0 else -1
        rate = (toxicity.BETA + n.get(k, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2
        return (sign * (0.0 if k == bias else toxicity.L1) - total) / rate

    for _ in range(epochs):
        for features, label in rows:
            w = {k: weight(k) for k in [*features, bias]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for k, v in w.items():
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * v
                n[k] = old + g * g
    return {k: weight(k) for k in z if weight(k) != 0}


def test_training_equals_a_loop_of_dictionaries():
    rng = random.Random(10)
    rows = []
    for _ in range(300):
        label = rng.randint(0, 1)
        rows.append((np.array(sorted({rng.randrange(40 * label, 60 + 40 * label) for _ in range(12)}), dtype=np.int32), label))
    w = toxicity.train(rows, 3)
    expected = brute_train([(f.tolist(), y) for f, y in rows], 3)
    got = {("bias" if i == 1 << toxicity.BITS else int(i)): w[i] for i in np.flatnonzero(w)}
    assert got.keys() == expected.keys() and len(got) > 10 and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_discriminant_equals_densities_by_determinant_and_inverse():
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    data = {k: rng.normal(loc=k, size=(200 + 100 * k, d)) @ rng.normal(size=(d, d)) for k in (0, 1)}
    model = quality.Discriminant({k: (float(len(x)), np.concatenate((x.sum(axis=0), (x.T @ x).ravel()))) for k, x in data.items()}, 0.1, 0.02)
    n = {k: len(x) for k, x in data.items()}
    cov = {k: np.cov(x.T, bias=True) for k, x in data.items()}
    both = sum(n[k] * cov[k] for k in n) / sum(n.values())
    scale = np.diag(1 / np.sqrt(np.diag(both)))
    probe = rng.normal(size=(50, d))
    log = {}
    for k in n:
        c = scale @ (0.9 * cov[k] + 0.1 * both) @ scale
        c = 0.98 * c + 0.02 * np.trace(c) / d * np.eye(d)
        z = (probe - data[k].mean(axis=0)) @ scale
        log[k] = np.log(n[k] / sum(n.values())) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z)
    expected = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -35, 35)))
    assert np.allclose(model.score(probe), expected, atol=1e-8)


def test_apportionment_is_that_of_highest_quotients(spark):
    rng = random.Random(11)
    rows = [(g, p, float(rng.choice([0, 1, 5, rng.randint(1, 10_000)])), rng.choice([0, 1, 7]) if g == 0 else 40 * g) for g in range(6) for p in range(1 + 3 * g)]
    seats = {g: s for g, _, _, s in rows}
    votes = spark.createDataFrame([(g, p, v, seats[g]) for g, p, v, _ in rows], "g int, p int, v double, s long")
    got = {(r.g, r.p): r.won for r in mixing.apportion(votes, ["g"], "v", "s", "p", "won").collect()}
    for g in seats:
        mine, won = [(v, p) for h, p, v, _ in rows if h == g], Counter()
        if sum(v for v, _ in mine) == 0:
            assert all(got[(g, p)] == 0 for _, p in mine)
            continue
        for _ in range(seats[g]):
            won[max(mine, key=lambda x: (x[0] / (2 * won[x[1]] + 1), -x[1]))[1]] += 1
        assert {p: got[(g, p)] for _, p in mine} == {p: won[p] for _, p in mine}


def brute_fingerprint(text):
    w = lower(text).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    first = {}
    for r, g in zip(rows, group):
        if r.doc_id is not None:
            first[g] = min(first.get(g, r.doc_id), r.doc_id)
    expected = sorted(((r.doc_id, f"{p:016x}", first.get(g)) for r, p, g in zip(rows, prints, group)), key=str)
    assert rows_of(simhash.near_duplicates(docs)) == expected
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_links_of_more_bits_than_the_keys_find_are_refused(spark, docs):
    prints = spark.createDataFrame([(0,), (15,)], "fp long")
    for refused in (
        lambda: simhash.fingerprint_groups(prints, bits=4),
        lambda: simhash.near_duplicates(docs, bits=4),
        lambda: simhash.drop_near_duplicates(docs, bits=5),
    ):
        with pytest.raises(ValueError):
            refused()


def test_golay_keys_and_links(spark):
    rng = np.random.default_rng(5)
    golay = simhash.Golay()
    words = rng.integers(0, 1 << 23, 300, dtype=np.uint32)
    rows, keys = golay.keys(words)
    sets = [set(keys[rows == i].tolist()) for i in range(300)]
    assert {len(s) for s in sets} <= {1, 6}
    for flip in (1, 1 << 22, (1 << 4) | (1 << 19)):
        rows, keys = golay.keys(words ^ np.uint32(flip))
        assert all(sets[i] & set(keys[rows == i].tolist()) for i in range(300))
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [int(b) ^ sum({1 << int(k) for k in rng.integers(0, 64, 3)}) for b in base]
    every = sorted({*map(int, base), *near})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in every]
    groups = {r.fp: r.group for r in simhash.fingerprint_groups(spark.createDataFrame(signed, "fp long")).collect()}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    for a, b in zip(map(int, base), near):
        assert a == b or groups[sign(a)] == groups[sign(b)]


def test_components(spark):
    rng = random.Random(2)
    path = list(range(200))
    edges = [(a, a + 1) for a in path] + [(1_000, 1_000 + i) for i in range(1, 300)] + [(5_000, 5_000), (6_001, 6_000)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1_000 + i: 1_000 for i in range(1, 300)} | {6_001: 6_000}


def test_substrings(docs, texts):
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    seen, expected = set(), []
    for r in order:
        w = plain_words(r.text)
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        expected.append((r.doc_id, len(w), len(gone), kept))
    got = substrings.remove_repeats(docs.repartition(6))
    assert rows_of(got.drop("spans")) == sorted(expected, key=str)
    for r in got.where("n_removed > 0").collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed and all(b - a >= 20 for a, b in r.spans)


def held_out(spark, frame, column):
    rows = [r for r in frame.collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % (5 if column == "toxic" else 3)) == (0 if column == "toxic" else 1) for r in rows)
    labels = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in rows if r.doc_id in labels]
    return sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)


def test_classifiers_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    assert held_out(spark, toxicity.toxicity(d, known), "toxic") >= 0.95
    assert held_out(spark, quality.quality(d, known), "quality") >= 0.98


def test_classifiers_on_odd_rows(spark, docs):
    rows = [(i, i % 2, i % 2) for i in range(50)] + [(1, None, 2), (None, 1, 1), (3, 0, 0), (999, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for df in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
        got = df.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_repeated_rows_weigh_once_on_toxicity(spark):
    rows = [(i, f"{'vile foul' if i % 2 else 'kind fair'} w{i}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    learnt = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 5)
    more = d.union(spark.createDataFrame([rows[learnt]] * 200 + [(learnt, None)], d.schema)).repartition(4)
    assert rows_of(toxicity.fit(more, labels)) == rows_of(toxicity.fit(d, labels)) != []


def test_nearest_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3_000, 12)).round(2)
    x[1_000:1_900] = x[999]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5_000, None), (5_100, [0.0] * 12), (5_200, [float("nan")] * 12), (5_300, [None] + [1.0] * 11), (5_400, [float("inf")] * 12), (None, [1.0] * 12), (5_500, [1.0, 2.0]), (7, rows[7][1])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = vectors.nearest(d, d.where("vec_id % 100 = 0")).collect()
    found = hits = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(by) == set(range(0, 3_000, 100))  # the only vector of two numbers has no neighbours
    for q, mine in by.items():
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3_000), dist)) if i != q][:10]
        assert [r for r, _, _ in sorted(mine)] == list(range(1, 11))
        assert [(s, i) for _, s, i in sorted(mine)] == sorted((s, i) for _, s, i in mine)
        assert all(abs(s - dist[i]) < 1e-9 for _, s, i in mine)
        hits, found = hits + len({i for _, _, i in mine} & set(best)), found + 10
    assert hits / found >= 0.9


def test_nearest_vectors_over_many_shards(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 32))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    classes = vectors.classes_of(vectors.valid_vectors(d), 11)
    assert vectors.sharded(classes, 1_000)[1] == 12
    got = vectors.nearest(d, d.where("vec_id % 100 = 0"), shard_rows=1_000, query_rows=16, share=0.03, least=0).collect()
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(by) == set(range(0, 12_000, 100))
    for q, mine in by.items():
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.argsort(dist) if i != q][:10]
        assert all(abs(s - dist[i]) < 1e-9 for i, s in mine.values())
        hits += len({i for i, _ in mine.values()} & set(best))
    assert hits / (10 * len(by)) >= 0.9


def test_candidates_have_the_smallest_footrule(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 8))
    pivots, prefix = x[:40], 12
    rows = spark.createDataFrame([(8 << 32, i, v.tolist(), [i]) for i, v in enumerate(x)], "shard long, id long, v array<double>, ids array<long>")
    held = vectors.ShardSearch(8 << 32, pivots, prefix)
    for m in vectors.build_index(rows, {8: pivots}, prefix).orderBy("kind").collect():
        held.hold(m.ids, m.counts, m.data) if m.kind == vectors.VECTORS else held.post(m.part, m.ids, m.counts)
    near = vectors._nearest_pivots(x, pivots, prefix).tolist()

    def footrule(a, b):
        place = [{p: i for i, p in enumerate(v)} for v in (a, b)]
        return sum(abs(place[0].get(p, prefix) - place[1].get(p, prefix)) for p in range(len(pivots)))

    for q in range(0, 400, 50):
        plain = sorted(footrule(near[q], n) for n in near)[:30]
        chosen = held.candidates(np.array(near[q]), 30)
        assert sorted(footrule(near[q], near[c]) for c in chosen) == plain


def test_warc_archives_hold_a_bounded_number_of_bytes(spark, tmp_path):
    sizes = [0, 10, 10, 40] * 60 + [3_000] * 5 + [90_000] * 3 + [400_000, 150_000]
    rows = [(f"r{i}", i, f"u{i}", bytes([i % 7]) * n) for i, n in enumerate(sizes)]
    records = spark.createDataFrame(rows, "record_id string, page_id long, url string, payload binary").repartition(2)
    path = tmp_path / "mixed"
    warc.deduplicated_archives(records, str(path), archive_bytes=100_000)
    whole = [gzip.decompress(f.read_bytes()) for f in path.glob("part-*")]
    for archive in whole:
        n = archive.count(b"WARC/1.1\r\n")
        payload = len(archive) - 900 * n  # headers take less
        assert n <= 1 or payload <= 100_000
    assert sum(a.count(b"WARC/1.1\r\n") for a in whole) == len(rows)
    got = {r.page_id: r for r in warc.read_archives(spark, str(path), payloads=True).collect()}
    first = {}
    for i, (_, page, _, payload) in reversed(list(enumerate(rows))):
        first.setdefault(payload, page)  # the largest page_id responds
        assert got[page].payload_bytes == len(payload)
        assert got[page].refers_to == (first[payload] if first[payload] != page else None)
        assert got[page].payload == (payload if first[payload] == page else None)


def test_warc_of_no_records(spark, tmp_path):
    none = spark.createDataFrame([], "record_id string, page_id long, url string, payload binary")
    warc.deduplicated_archives(none, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
