"""Approximate nearest neighbours by a permutation index over pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import one_row, stage

# Pivots, drawn from the vectors of smallest hash; how many a vector is known by.
PIVOTS, PREFIX = 256, 96
# Vectors that one shard of the index holds.
SHARD_ROWS = 16_384
# A query measures this share of the vectors, but this many of all shards together at least.
SHARE, LEAST = 0.02, 600
# Queries that are sent to a shard as one row.
QUERY_ROWS = 256

# Rows of the search: a shard's vectors, its inverted files, the queries it answers.
VECTORS, POSTING, QUERIES = 0, 1, 2
MESSAGE = "shard long, kind int, part long, ids binary, counts binary, data binary"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: finite, not NULL, not all zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).where(F.exists("v", lambda x: x != 0.0))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """Equal vectors as one: (id, v, ids), the ids being the ``keep`` smallest.

    Nobody needs more copies than that. Each task keeps that many of a vector's ids
    before they meet, so a vector that most rows share is no load.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    found = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return found.select(F.col("ids")[0].alias("id"), "v", "ids")


def _nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first, ties to the first pivot."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def choose_pivots(classes: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """At most ``pivots`` vectors of each dimension, those whose id has the smallest hash."""
    order = Window.partitionBy(F.size("v")).orderBy(F.xxhash64(F.lit("pivot"), "id"), "id")
    few = classes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots)
    found: dict[int, list] = {}
    for row in few.orderBy("rank").select("v").collect():  # at most ``pivots`` a dimension
        found.setdefault(len(row["v"]), []).append(row["v"])
    return {k: np.array(v) for k, v in found.items()}


def sharded(classes: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The classes with ``shard``, vectors of one dimension, and how many shards a dimension has.

    Vectors go to shards by the hash of their id, about ``shard_rows`` to each.
    """
    n = max(1, -(-one_row(classes.agg(F.count(F.lit(1)).alias("n")))["n"] // shard_rows))
    return classes.withColumn("shard", _shard(F.size("v"), F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(n)))), n


def _shard(dimension, number):
    return dimension.cast("long") * F.lit(1 << 32) + number


def _message(shard: int, kind: int, part: int, ids: np.ndarray, counts: np.ndarray, data: np.ndarray) -> dict:
    return {"shard": shard, "kind": kind, "part": part, "ids": ids.tobytes(), "counts": counts.tobytes(), "data": data.tobytes()}


def _messages(rows: list[dict]) -> pa.Table:
    fields = [("shard", pa.int64()), ("kind", pa.int32()), ("part", pa.int64())]
    return pa.Table.from_pylist(rows, pa.schema(fields + [(c, pa.binary()) for c in ("ids", "counts", "data")]))


def build_index(shards: DataFrame, pivots: dict[int, np.ndarray], prefix: int = PREFIX) -> DataFrame:
    """Each shard's vectors as one row, and one row per pivot: its inverted file.

    A posting is a vector, by its number in the shard's order of ids (``ids``), and the
    place that the pivot has among the vector's nearest (``counts``). The row of
    vectors has the ids of each, how many those are, and the components.
    """

    def post(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        shard, x, ids = table.column("shard")[0].as_py(), _matrix(table.column("v")), table.column("ids").combine_chunks()
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        rows = [_message(shard, VECTORS, 0, ids.flatten().to_numpy().astype(np.int64), counts, x)]
        near = _nearest_pivots(x, pivots[x.shape[1]], prefix)
        flat, width = near.ravel(), near.shape[1]
        order = np.argsort(flat, kind="stable")
        nothing = np.empty(0)
        for g in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1):
            members, places = (g // width).astype(np.uint32), (g % width).astype(np.uint16)
            rows.append(_message(shard, POSTING, int(flat[g[0]]), members, places, nothing))
        return _messages(rows)

    return shards.groupBy("shard").applyInArrow(post, MESSAGE)


def query_packs(queries: DataFrame, shards: int, rows: int = QUERY_ROWS) -> DataFrame:
    """The queries as rows of about ``rows`` of one dimension, a copy for each shard of that dimension."""
    blocks = max(1, -(-one_row(queries.agg(F.count(F.lit(1)).alias("n")))["n"] // rows))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        x = _matrix(table.column("v"))
        dimension, block = table.column("dimension")[0].as_py(), table.column("block")[0].as_py()
        return _messages([_message(dimension, QUERIES, block, ids, np.empty(0), x)])

    keys = queries.withColumn("dimension", F.size("v")).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)))
    packs = stage(keys.groupBy("dimension", "block").applyInArrow(pack, MESSAGE), "ann-queries")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    return packs.withColumn("number", number).withColumn("shard", _shard(F.col("shard"), F.col("number"))).drop("number")


class ShardSearch:
    """One shard in a task: its vectors and inverted files, as its rows come in."""

    def __init__(self, shard: int, pivots: np.ndarray, prefix: int):
        self.shard, self.pivots, self.prefix = shard, pivots, prefix
        self.x, self.lists = np.empty((0, pivots.shape[1])), {}

    def hold(self, ids: bytes, counts: bytes, data: bytes) -> None:
        counts = np.frombuffer(counts, dtype=np.int32)
        self.x = np.frombuffer(data, dtype=np.float64).reshape(len(counts), -1)
        self.ids = np.split(np.frombuffer(ids, dtype=np.int64), np.cumsum(counts)[:-1])

    def post(self, pivot: int, members: bytes, places: bytes) -> None:
        self.lists[pivot] = np.frombuffer(members, dtype=np.uint32), np.frombuffer(places, dtype=np.uint16)

    def candidates(self, row: np.ndarray, measured: int) -> np.ndarray:
        """The ``measured`` vectors of smallest footrule distance to a query with these nearest pivots.

        A pivot that both know brings the distance down by 2 (prefix - the worse place).
        """
        if len(self.x) <= measured:
            return np.arange(len(self.x))
        gain, width = np.zeros(len(self.x), dtype=np.int32), len(row)
        worth = 2 * (width - np.arange(width, dtype=np.int32))
        for place, pivot in enumerate(row.tolist()):
            if pivot in self.lists:
                members, places = self.lists[pivot]  # a member once per list
                gain[members] += np.minimum(worth[places], worth[place])
        least = np.partition(gain, len(gain) - measured)[len(gain) - measured]
        better, ties = np.flatnonzero(gain > least), np.flatnonzero(gain == least)
        return np.concatenate((better, ties[: measured - len(better)]))

    def answer(self, ids: bytes, data: bytes, k: int, measured: int) -> list[tuple[int, int, float]]:
        """(query_id, vec_id, score) of each query's ``k`` nearest among its candidates."""
        asked = np.frombuffer(ids, dtype=np.int64)
        q = np.frombuffer(data, dtype=np.float64).reshape(len(asked), -1)
        found = []
        for query, vector, row in zip(asked.tolist(), q, _nearest_pivots(q, self.pivots, self.prefix)):
            chosen = self.candidates(row, measured)
            d = np.sqrt(((self.x[chosen] - vector) ** 2).sum(axis=1))
            best = np.lexsort((chosen, d))[: k + 1]
            rows = sorted((float(d[b]), i) for b in best for i in self.ids[chosen[b]].tolist() if i != query)[:k]
            found += [(query, i, score) for score, i in rows]
        return found


def search_index(
    index: DataFrame,
    packs: DataFrame,
    shards: int,
    pivots: dict[int, np.ndarray],
    k: int,
    prefix: int = PREFIX,
    share: float = SHARE,
    least: int = LEAST,
) -> DataFrame:
    """(query_id, vec_id, score) of the ``k`` nearest that each shard finds for each query.

    A query walks the postings of its own nearest pivots and measures a shard's vectors
    of smallest footrule distance: ``share`` of them, or ``least`` divided by the number
    of shards if that is more. Index and queries meet by shard, sorted so that
    a task reads a shard's vectors, its inverted files, then row after row of queries;
    it holds one shard and one batch of query rows.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    floor = max(k + 1, -(-least // shards))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for m in batch.to_pylist():
                dimension = m["shard"] >> 32
                if m["kind"] == VECTORS:
                    held = ShardSearch(m["shard"], pivots[dimension], prefix)
                    held.hold(m["ids"], m["counts"], m["data"])
                elif held is None or held.shard != m["shard"]:
                    continue  # queries of a shard without vectors
                elif m["kind"] == POSTING:
                    held.post(m["part"], m["ids"], m["counts"])
                else:
                    found = held.answer(m["ids"], m["data"], k, max(floor, int(np.ceil(share * len(held.x)))))
                    columns = list(zip(*found)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    # As many partitions as shards: merged ones would leave the search to few tasks.
    together = index.unionByName(packs).repartition(max(2, shards), "shard")
    ordered = together.sortWithinPartitions("shard", "kind", "part")
    return ordered.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    share: float = SHARE,
    least: int = LEAST,
) -> DataFrame:
    """The ``k`` nearest of each query among the other vectors: (query_id, rank, vec_id, score).

    Both frames have (vec_id, embedding). Nearness is the Euclidean distance in double
    precision, ties go to the smaller vec_id. Vectors that are NULL, zero or hold a
    NULL or non-finite component take no part, and rows without an id neither; a
    vector is compared with those of its own dimension. A query is never its own
    neighbour; equal rows count once, and an id with several vectors is as near as
    its nearest. Fewer than ``k`` others give fewer rows, none give none.
    """
    classes = stage(classes_of(valid_vectors(vectors), k + 1), "ann-classes")
    pivots = choose_pivots(classes)
    rows, shards = sharded(classes, shard_rows)
    index = stage(build_index(rows, pivots), "ann-index")
    packs = query_packs(stage(valid_vectors(queries).distinct(), "ann-asked"), shards, query_rows)
    found = search_index(index, packs, shards, pivots, k, share=share, least=least)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
