"""Vector codes: parts of vectors by their nearest codebook entries, found through metric trees of anchors."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import Shared, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Vectors under one set of trees, and points of a ball that has no balls below it.
BLOCK_ROWS, LEAF = 8_192, 12
# Components are whole numbers of at most this size, so that squared distances fit 64 bits.
LARGEST = 1 << 26


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the vectors without NULL or non-finite components, as floor(scale * component)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    number = lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    bounded = lambda x: F.least(F.greatest(x, F.lit(-2.0 * LARGEST / scale)), F.lit(2.0 * LARGEST / scale))
    return rows.select("vec_id", "label", F.transform("v", lambda x: number(bounded(x))).alias("x"))


def first_entries(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """The codebooks to begin with, (parts, entries, components): those of the smallest vec_ids.

    A repeated vec_id counts once, with its smallest vector. The driver gets ``entries`` rows.
    """
    fits = rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0))
    ids = fits.select(F.col("vec_id").alias("_id")).distinct().orderBy("_id").limit(entries)
    found = fits.join(F.broadcast(ids), F.col("vec_id") == F.col("_id")).groupBy("vec_id").agg(F.min("x").alias("x"))
    vectors = [r["x"] for r in found.orderBy("vec_id").collect()]
    vectors = [x for x in vectors if len(x) == len(vectors[0])]
    if not vectors:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    return np.array(vectors, dtype=np.int64).reshape(len(vectors), parts, -1).swapaxes(0, 1)


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


class Balls:
    """A metric tree over weighted points, built from the middle out by the anchors hierarchy.

    Anchors share out the points of a set: each new anchor is the point farthest from
    the anchor of largest radius, and takes from the others what is nearer to it. A
    ball of anchors is joined, the two of smallest common radius first, to the balls
    above; its points are shared out again for those below. A ball is a range of the
    points in ``order`` and caches their number and sum.
    """

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        self.points, self.weights = points.astype(np.float64), weights
        self._low, self._high, self._centre, self._radius, self._below = [], [], [], [], []
        self._order: list[np.ndarray] = []
        self._size = 0
        root = self._build(np.arange(len(points))) if len(points) else None
        self.order = np.concatenate(self._order) if self._order else np.empty(0, dtype=np.int64)
        self.low, self.high = np.array(self._low, dtype=np.int64), np.array(self._high, dtype=np.int64)
        self.centre, self.radius = np.array(self._centre), np.array(self._radius)
        self.root = np.array([] if root is None else [root], dtype=np.int64)
        self.child_count = np.array([len(b) for b in self._below], dtype=np.int64)
        self.children = np.array([c for b in self._below for c in b], dtype=np.int64)
        self.first_child = np.cumsum(self.child_count) - self.child_count
        p, w = points[self.order].astype(np.int64), weights[self.order].astype(np.int64)
        sums = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(p * w[:, None], axis=0)))
        total = np.concatenate(([0], np.cumsum(w)))
        self.sums = sums[self.high] - sums[self.low] if len(self.low) else sums[:0]
        self.counts = total[self.high] - total[self.low]
        self.points, self.weights = p, w
        for name in ("_low", "_high", "_centre", "_radius", "_below", "_order"):
            delattr(self, name)

    def _ball(self, low: int, high: int, centre: np.ndarray, radius: float, below: list[int]) -> int:
        self._low.append(low)
        self._high.append(high)
        self._centre.append(centre)
        self._radius.append(radius)
        self._below.append(below)
        return len(self._low) - 1

    def _leaf(self, members: np.ndarray) -> int:
        low, self._size = self._size, self._size + len(members)
        self._order.append(members)
        centre = self.points[members].mean(axis=0)
        return self._ball(low, self._size, centre, float(_distances(self.points[members], centre).max()), [])

    def _anchors(self, members: np.ndarray) -> list[np.ndarray]:
        """The members shared out among about the square root of their number of anchors."""
        p = self.points[members]
        wanted = max(2, int(np.sqrt(len(members))))
        owned = [np.arange(len(members))]
        away = [_distances(p, p[0])]
        anchors = [p[0]]
        while len(owned) < wanted:
            farthest = [d.max() for d in away]
            widest = int(np.argmax(farthest))
            if farthest[widest] == 0.0:
                break
            new = p[owned[widest][np.argmax(away[widest])]]
            apart = _distances(np.array(anchors), new)
            got, got_away = [], []
            for i, (mine, d) in enumerate(zip(owned, away)):
                # Points within half the way to the new anchor are nearer to their own.
                if 2.0 * farthest[i] <= apart[i]:
                    continue
                far = np.flatnonzero(2.0 * d > apart[i])
                to_new = _distances(p[mine[far]], new)
                lost = far[to_new < d[far]]
                if not len(lost):
                    continue
                got.append(mine[lost])
                got_away.append(to_new[to_new < d[far]])
                keep = np.ones(len(mine), dtype=bool)
                keep[lost] = False
                owned[i], away[i] = mine[keep], d[keep]
            owned.append(np.concatenate(got))
            away.append(np.concatenate(got_away))
            anchors.append(new)
        return [members[o] for o in owned if len(o)]

    def _build(self, members: np.ndarray) -> int:
        shares = self._anchors(members) if len(members) > LEAF else [members]
        if len(shares) == 1:
            return self._leaf(members)
        # Which anchors join which, before their points get places: a ball is a range of them.
        centres = [self.points[s].mean(axis=0) for s in shares]
        radii = [float(_distances(self.points[s], c).max()) for s, c in zip(shares, centres)]
        sizes = [len(s) for s in shares]
        trees: list = list(range(len(shares)))
        c, r, n = np.array(centres), np.array(radii), np.array(sizes, dtype=float)
        gap = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        joint = (gap + r[:, None] + r[None, :]) / 2
        np.fill_diagonal(joint, np.inf)
        for _ in range(len(shares) - 1):
            a, b = divmod(int(np.argmin(joint)), len(joint))
            trees[a], trees[b] = (trees[a], trees[b]), None
            centre = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
            r[a] = max(r[a] + np.sqrt(((c[a] - centre) ** 2).sum()), r[b] + np.sqrt(((c[b] - centre) ** 2).sum()))
            c[a], n[a] = centre, n[a] + n[b]
            joint[b, :] = joint[:, b] = np.inf
            free = np.isfinite(joint[a])
            joint[a, free] = joint[free, a] = (np.sqrt(((c[free] - centre) ** 2).sum(axis=1)) + r[free] + r[a]) / 2
        root = next(t for t in trees if t is not None)

        def place(tree) -> int:
            if isinstance(tree, int):
                return self._build(shares[tree])
            low = self._size
            below = [place(t) for t in tree]
            w = [self._high[i] - self._low[i] for i in below]
            centre = sum(k * self._centre[i] for k, i in zip(w, below)) / sum(w)
            radius = max(self._radius[i] + float(np.sqrt(((self._centre[i] - centre) ** 2).sum())) for i in below)
            return self._ball(low, self._size, centre, radius, below)

        return place(root)

    def owners(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry of each point, sums and counts of each entry's points, and distances measured.

        Balls go level by level with the entries that may own some of their points. An
        entry drops out of the list that a ball inherits if it is farther from all of
        the ball than another; a ball with one entry left is wholly owned, and gives its
        cached sum and number. Points of other leaves are measured, whole numbers all,
        against what is left. Of equally near entries the first owns.
        """
        k = len(entries)
        owner = np.full(len(self.points), -1, dtype=np.int64)
        sums, counts = np.zeros((k, entries.shape[1]), dtype=np.int64), np.zeros(k, dtype=np.int64)
        ball = np.repeat(self.root, k)
        entry = np.tile(np.arange(k), len(self.root))
        real, measured = entries.astype(np.float64), 0
        while len(ball):
            # Pairs of a ball and a candidate, ordered by ball.
            starts = np.flatnonzero(np.concatenate(([True], ball[1:] != ball[:-1])))
            at = self.centre[ball] - real[entry]
            d = np.sqrt((at * at).sum(axis=1))
            measured += len(d)
            nearest = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.concatenate((starts, [len(d)]))))
            slack = 1e-9 * (1.0 + d)
            keep = d <= nearest + 2.0 * self.radius[ball] + slack
            ball, entry = ball[keep], entry[keep]
            starts = np.flatnonzero(np.concatenate(([True], ball[1:] != ball[:-1])))
            listed = np.diff(np.concatenate((starts, [len(ball)])))
            balls = ball[starts]
            whole = listed == 1
            for b, e in zip(balls[whole], entry[starts[whole]]):
                owner[self.low[b] : self.high[b]] = e
            np.add.at(sums, entry[starts[whole]], self.sums[balls[whole]])
            np.add.at(counts, entry[starts[whole]], self.counts[balls[whole]])
            leaf = ~whole & (self.child_count[balls] == 0)
            for b, s, n in zip(balls[leaf], starts[leaf], listed[leaf]):
                some = entry[s : s + n]
                points = slice(self.low[b], self.high[b])
                gap = self.points[points, None, :] - entries[None, some, :]
                owner[points] = some[np.argmin((gap * gap).sum(axis=2), axis=1)]
                measured += gap.shape[0] * gap.shape[1]
                np.add.at(sums, owner[points], self.points[points] * self.weights[points, None])
                np.add.at(counts, owner[points], self.weights[points])
            # The others hand their lists down.
            down = ~whole & ~leaf
            listed, starts, balls = listed[down], starts[down], balls[down]
            if not len(balls):
                break
            heirs = self.child_count[balls]
            parent = np.repeat(np.arange(len(balls)), heirs)
            nth = np.arange(len(parent)) - np.repeat(np.cumsum(heirs) - heirs, heirs)
            child = self.children[self.first_child[balls[parent]] + nth]
            sizes = listed[parent]
            ball = np.repeat(child, sizes)
            entry = entry[np.repeat(starts[parent] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        return owner, sums, counts, measured


# ``trees`` holds a pickled (Balls, point of each row) per part; rows that do not fit the codebooks have none.
BLOCKS = "ids array<long>, labels array<{label}>, x binary, trees binary"


def tree_blocks(rows: DataFrame, width: int, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of vectors of ``width`` components with a metric tree per part; equal parts are one weighted point."""
    label = dict(rows.dtypes)["label"]
    label_type = rows.limit(0).select("label").toArrow().schema.field("label").type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x = np.asarray(table.column("x").combine_chunks().flatten(), dtype=np.int32).reshape(-1, width)
            trees = []
            for part in np.split(x, parts, axis=1):
                points, inverse, weights = np.unique(part, axis=0, return_inverse=True, return_counts=True)
                balls = Balls(points, weights)
                place = np.empty(len(points), dtype=np.int64)
                place[balls.order] = np.arange(len(points))
                trees.append((vars(balls), place[inverse.ravel()].astype(np.int32)))
            columns = [
                pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([table.column("label").to_pylist()], pa.list_(label_type)),
                pa.array([x.tobytes()], pa.binary()),
                pa.array([pickle.dumps(trees)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "x", "trees"])

        for batch in batches:
            for start in range(0, len(batch), block_rows):
                piece = batch.slice(start, block_rows)
                held.append(piece)
                size += len(piece)
                if size >= block_rows:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return rows.select("vec_id", "label", "x").mapInArrow(scan, BLOCKS.format(label=label))


def _trees(row: pa.Scalar) -> list[tuple[Balls, np.ndarray]]:
    found = []
    for fields, point in pickle.loads(row.as_py()):
        balls = Balls.__new__(Balls)
        vars(balls).update(fields)
        found.append((balls, point))
    return found


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts it owns, unused ones as they were.

    A task sends one sum and number per entry, and so does the aggregate to the driver.
    """
    shared = Shared(blocks.sparkSession, books)
    d = books.shape[2]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.get()
        total = np.zeros((*entries.shape[:2], d + 1), dtype=np.int64)
        for batch in batches:
            for row in batch.column(0):
                for part, (balls, _) in enumerate(_trees(row)):
                    _, sums, counts, _ = balls.owners(entries[part])
                    total[part, :, :d] += sums
                    total[part, :, d] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "value"])

    sums = blocks.select("trees").mapInArrow(scan, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38, 0)")).alias("value"))
    total = np.zeros(books.shape[0] * books.shape[1] * (d + 1), dtype=object)
    for r in sums.collect():  # at most a number per component and entry
        total[r["at"]] = int(r["value"])
    total = total.reshape(*books.shape[:2], d + 1)
    out = books.copy()
    for part, entry in zip(*np.nonzero(total[:, :, d])):
        out[part, entry] = [int(s) // int(total[part, entry, d]) for s in total[part, entry, :d]]
    return out


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): nearest entries of all parts, two hex digits each, and their squared distances' sum."""
    label = next(t for n, t in blocks.dtypes if n == "labels")[len("array<") : -1]
    shared = Shared(blocks.sparkSession, books)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.get()
        parts, _, d = entries.shape
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                x = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.int32).reshape(-1, parts, d).astype(np.int64)
                error, codes = np.zeros(len(x), dtype=np.int64), np.empty((len(x), parts), dtype=np.uint8)
                for part, (balls, point) in enumerate(_trees(batch.column(3)[i])):
                    owner = balls.owners(entries[part])[0][point]
                    error += ((x[:, part] - entries[part][owner]) ** 2).sum(axis=1)
                    codes[:, part] = owner
                text = codes.tobytes().hex()
                code = pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)])
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(scan, f"vec_id long, label {label}, code string, error long")


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, (vec_id, label, code, error), and the codebooks (parts, entries, components).

    Vectors that are NULL or hold NULL or non-finite components are left out. Components
    become whole numbers, those beyond 2**26 that bound. The codebooks start with the
    vectors of smallest vec_id, of which there may be fewer than ``entries`` (at most 256);
    NULL ids come last and start none. Vectors whose length differs from that of the
    first, or cannot be cut into ``parts``, have a NULL code and error. Repeated rows and
    equal vectors come out, and weigh, as often as they occur. An empty table has no rows.
    Only the codebooks, of a size that the parameters fix, are broadcast.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = stage(whole_vectors(vectors), "code-vectors")
    books = first_entries(rows, entries, parts)
    width = books.shape[0] * books.shape[2]
    fits = (F.size("x") == width) & F.lit(books.shape[1] > 0)
    others = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not books.shape[1]:
        return others, books
    blocks = stage(tree_blocks(rows.where(fits), width, parts, block_rows), "code-trees")
    for _ in range(rounds):
        books = improved(blocks, books)
    return coded(blocks, books).union(others), books


def report(vectors: DataFrame) -> DataFrame:
    """Per vector: code, error, the error of its label (NULL labels together) and the codebooks' digest."""
    codes, books = compress(vectors)
    codes = stage(codes, "code-rows")
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38, 0)")).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
