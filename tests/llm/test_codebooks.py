"""Vector codes against plain k-means on whole numbers, and how much the trees save."""

import hashlib
import math

import numpy as np
import pytest

from railpulse.llm import codebooks

VECTORS = "vec_id long, embedding array<double>, label int, code string, error long"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted({i: v for i, v, _ in sorted(kept, key=lambda r: r[1], reverse=True) if i is not None and v and len(v) % parts == 0}.items())[:entries]
    if not first:
        return {}, ""
    width = len(first[0][1])
    fits = [(i, v, label) for i, v, label in kept if len(v) == width]
    d = width // parts
    books = [[v[p * d : (p + 1) * d] for _, v in first if len(v) == width] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            owned = {}
            for _, v, _ in fits:
                x = v[p * d : (p + 1) * d]
                owned.setdefault(nearest(book, x)[1], []).append(x)
            books[p] = [[sum(c) // len(owned[k]) for c in zip(*owned[k])] if k in owned else e for k, e in enumerate(book)]
    out, by_label = [], {}
    for i, v, label in fits:
        found = [nearest(books[p], v[p * d : (p + 1) * d]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[x], digest) for i, c, e, x in out), key=str), digest


def rows_like(rng, n, width):
    x = rng.normal(scale=0.2, size=(n, width)).round(2)
    x[n // 3 : n // 2] = x[5]  # a vector that many rows share
    x[n // 2 : n // 2 + 20, :4] = 0.0
    return [(int(i), v.tolist(), int(i) % 5 if i % 7 else None, "clash", 1) for i, v in enumerate(x)]


@pytest.mark.parametrize(("parts", "entries", "block_rows"), [(16, 64, 8_192), (4, 7, 100)])
def test_codes(spark, monkeypatch, parts, entries, block_rows):
    rng = np.random.default_rng(4)
    rows = rows_like(rng, 400, 32)
    rows += [(900, None, 1, "", 0), (901, [float("nan")] * 32, 1, "", 0), (902, [None] + [0.5] * 31, 1, "", 0), (903, [float("-inf")] * 32, 2, "", 0)]
    rows += [(904, [0.0] * 32, None, "", 0), rows[9], rows[9], (None, [0.25] * 32, 3, "", 0)]
    d = spark.createDataFrame(rows, VECTORS).repartition(3)
    monkeypatch.setattr(codebooks, "PARTS", parts)
    codes, books = codebooks.compress(d, parts, entries, 2, block_rows)
    expected, digest = brute(rows, parts, entries, 2)
    assert codebooks.codebook_digest(books) == digest
    assert sorted(((r.vec_id, r.code, r.error) for r in codes.collect()), key=str) == sorted((e[:3] for e in expected), key=str)
    if parts == 16:
        assert sorted(map(tuple, codebooks.report(d).collect()), key=str) == expected


def test_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codebooks.report(none).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 32, 1, "", 0), (2, [2.0] * 16, 1, "", 0), (3, [0.5] * 5, None, "", 0), (0, [], 1, "", 0), (4, [1e300] * 32, 2, "", 0)], VECTORS)
    got = {r.vec_id: r for r in codebooks.report(odd).collect()}
    assert [got[i].code is None for i in range(5)] == [True, False, True, True, False]
    assert got[1].error == 0 and got[2].error is None and got[3].label_error is None
    only = odd.where("vec_id = 3")
    assert [(r.code, r.error) for r in codebooks.report(only).collect()] == [(None, None)]
    with pytest.raises(ValueError):
        codebooks.compress(odd, entries=257)


def test_trees_own_the_nearest_and_measure_less():
    rng = np.random.default_rng(8)
    centres = rng.integers(-400, 400, (12, 4))
    points = np.unique(centres[rng.integers(0, 12, 6_000)] + rng.normal(scale=12, size=(6_000, 4)).astype(int), axis=0)
    weights = rng.integers(1, 5, len(points))
    balls = codebooks.Balls(points, weights)
    assert sorted(balls.order.tolist()) == list(range(len(points)))
    for low, high, centre, radius, total, count in zip(balls.low, balls.high, balls.centre, balls.radius, balls.sums, balls.counts):
        mine = balls.points[low:high]
        assert np.sqrt(((mine - centre) ** 2).sum(axis=1)).max() <= radius + 1e-6
        assert (total == (mine * balls.weights[low:high, None]).sum(axis=0)).all() and count == balls.weights[low:high].sum()
    entries = np.concatenate((centres, rng.integers(-400, 400, (50, 4)), centres[:2]))  # the last two tie with the first
    owner, sums, counts, measured = balls.owners(entries)
    full = ((balls.points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (owner == full.argmin(axis=1)).all()
    assert measured < 0.2 * full.size
    for k in range(len(entries)):
        mine = owner == k
        assert counts[k] == balls.weights[mine].sum()
        assert (sums[k] == (balls.points[mine] * balls.weights[mine, None]).sum(axis=0)).all()
