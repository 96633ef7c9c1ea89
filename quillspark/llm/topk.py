"""Exact nearest neighbours of a query set by columnar branch and bound.

Vectors are rotated to the principal axes of a bounded sample and lie in blocks, one array for each axis, those of largest
variance first. Blocks hold vectors of one cluster of the sample, so that a query passes over blocks whose box is too far
away. Inside a block the distances of a group of queries are accumulated axis block by axis block. After each, the distance
so far plus the least that the remaining axes can add, (|q'| - |x'|)^2 of the remaining parts' lengths, bounds a pair's
distance from below; pairs beyond the query's k-th best leave, and what is left is compacted: whole vectors first, then,
once few pairs are left, pair by pair. Distances of the survivors are computed anew from the vectors as given in double
precision, so the result is that of comparing everything. The sample only affects how early pairs leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_stage, stage
from .textvec import hash_cut

K = 10
#: Bytes of one block, queries compared at once, axes accumulated between two looks at the bounds.
BLOCK, GROUP, AXES = 1 << 21, 256, (16, 16, 16, 16, 32, 64, 128)
#: The bound of the sample for rotation, clusters and first limits: vectors of least hash of their ids.
SAMPLE, CLUSTERS = 2048, 32
#: Relative slack of bounds in single precision, and the share of pairs below which they are followed one by one.
SLACK, FEW = 1e-4, 0.2


def steps(dims: int) -> list[tuple[int, int]]:
    out, at, k = [], 0, 0
    while at < dims:
        to = min(dims, at + AXES[min(k, len(AXES) - 1)])
        out.append((at, to))
        at, k = to, k + 1
    return out


class Space:
    """Rotation, cluster centres and sample of a vector table; with no sample at all the axes are as given."""

    def __init__(self, dims: int, sample: np.ndarray, ids: list):
        self.sample, self.ids = sample, ids
        self.axes = np.eye(dims)
        if len(sample) > 1:
            self.axes = np.linalg.eigh(np.cov(sample.T).reshape(dims, dims))[1][:, ::-1]
        turned = sample @ self.axes
        self.centres = turned[:CLUSTERS]
        for _ in range(5 if len(turned) > CLUSTERS else 0):
            own = self.cluster(turned)
            self.centres = np.stack([turned[own == c].mean(0) if (own == c).any() else self.centres[c] for c in range(CLUSTERS)])

    def cluster(self, turned: np.ndarray) -> np.ndarray:
        if not len(self.centres):
            return np.zeros(len(turned), np.int32)
        return ((self.centres**2).sum(1) - 2 * turned @ self.centres.T).argmin(1).astype(np.int32)

    def limits(self, x: np.ndarray, ids: list, k: int) -> np.ndarray:
        """Upper bounds of the squared distances of the ``k``-th neighbours: k + 1 of the sample, as one may be the vector itself."""
        if len(self.sample) <= k:
            return np.full(len(x), np.inf)
        d = (x**2).sum(1)[:, None] + (self.sample**2).sum(1) - 2 * x @ self.sample.T
        return np.maximum(np.partition(d, k, 1)[:, k], 0) * (1 + 1e-9) + 1e-9


class Block:
    """Vectors as given, one a row, and rotated in columns in single precision, with the lengths that remain after each step."""

    def __init__(self, x: np.ndarray, turned: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.turned = x, ids, turned
        self.steps = steps(len(turned))
        self.squares = [(turned[a:b] ** 2).sum(0) for a, b in self.steps]
        self.total = sum(self.squares)
        self.rest = [np.sqrt(np.maximum(self.total - sum(self.squares[: k + 1]), 0)) for k in range(len(self.steps))]
        self.low, self.high = turned.min(1), turned.max(1)


class Lists:
    """The best neighbours so far of the queries of a block, by distance, then id; ``limit`` bounds the k-th squared distance."""

    def __init__(self, q: Block, limit: np.ndarray, k: int):
        self.k, self.limit = k, limit.copy()
        self.d = [np.empty(0)] * len(q.ids)
        self.ids = [q.ids[:0]] * len(q.ids)

    def add(self, i: int, d: np.ndarray, ids: np.ndarray) -> None:
        d, ids = np.concatenate([self.d[i], d]), np.concatenate([self.ids[i], ids])
        by = np.lexsort((ids, d))[: self.k]
        self.d[i], self.ids[i] = d[by], ids[by]
        if len(by) == self.k:
            self.limit[i] = min(self.limit[i], d[by[-1]])


def search(q: Block, x: Block, best: Lists) -> int:
    """Bring ``best`` up to date with the block ``x``; returns how many products of coordinates that took.

    A vector whose id is the query's is not its neighbour.
    """
    gap = np.maximum(np.maximum(x.low[:, None] - q.turned, q.turned - x.high[:, None]), 0)
    slack_q = SLACK * (q.total + x.total.max()) + 1e-6
    near = np.flatnonzero((gap**2).sum(0) - slack_q <= best.limit)
    return sum(_group(q, x, best, near[at : at + GROUP]) for at in range(0, len(near), GROUP))


def _group(q: Block, x: Block, best: Lists, some: np.ndarray) -> int:
    limit = best.limit[some]
    alive = np.arange(len(x.ids))
    partial = np.zeros((len(some), len(alive)), np.float32)
    turned_q, turned_x = q.turned[:, some], x.turned
    pairs, work = None, 0
    for n, (a, b) in enumerate(x.steps):
        if pairs is None:
            product = turned_q[a:b].T @ turned_x[a:b]
            work += (b - a) * product.size
            product *= -2
            product += q.squares[n][some][:, None]
            product += x.squares[n][alive]
            partial += product
            rest = q.rest[n][some][:, None] - x.rest[n][alive]
            stay = partial + rest * rest - SLACK * (q.total[some][:, None] + x.total[alive]) - 1e-6 <= limit[:, None]
            if stay.mean() < FEW:
                i, j = np.nonzero(stay)
                pairs = i, alive[j], partial[i, j]
            elif (keep := stay.any(0)).mean() < 0.8:
                alive, partial, turned_x, stay = alive[keep], partial[:, keep], turned_x[:, keep], stay[:, keep]
        else:
            i, j, d = pairs
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                d[part] += ((turned_q[a:b, i[part]] - x.turned[a:b, j[part]]) ** 2).sum(0)
            work += (b - a) * len(i)
            rest = q.rest[n][some[i]] - x.rest[n][j]
            stay = d + rest * rest - SLACK * (q.total[some[i]] + x.total[j]) - 1e-6 <= limit[i]
            pairs = i[stay], j[stay], d[stay]
    if pairs is None:
        i, j = np.nonzero(stay)
        pairs = i, alive[j], None
    i, j = pairs[:2]
    cuts = np.searchsorted(i, np.arange(len(some) + 1))
    for m in np.flatnonzero(np.diff(cuts)):
        at = j[cuts[m] : cuts[m + 1]]
        at = at[x.ids[at] != q.ids[some[m]]]
        best.add(some[m], ((x.x[at] - q.x[some[m]]) ** 2).sum(1), x.ids[at])
        work += len(at) * x.x.shape[1]
    return work


def _ids(values: pa.Array) -> np.ndarray:
    return np.array(values.to_pylist(), None if pa.types.is_integer(values.type) else object)


def _prepare(batches: Iterator[pa.RecordBatch], space: Space, dims: int) -> Iterator[pa.RecordBatch]:
    """Each vector's cluster, by which it will be sorted."""
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.cluster(x @ space.axes), pa.int32())], [*batch.schema.names, "cluster"])


def _block_rows(batches: Iterator[pa.RecordBatch], space: Space, dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Runs of vectors of one cluster as blocks: ids, vectors, rotated columns and limits."""
    rows = max(64, BLOCK // (8 * dims))
    for batch in batches:
        own = batch.column("cluster").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(lo, hi, rows):
                part = batch.slice(at, min(rows, hi - at))
                x = np.asarray(part.column("vector").flatten(), np.float64).reshape(-1, dims)
                ids = part.column("id")
                turned = np.ascontiguousarray((x @ space.axes).T.astype(np.float32))
                limit = space.limits(x, ids, k)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([v.tobytes()], pa.binary()) for v in (x, turned, limit))], ["ids", "x", "turned", "limits"])


def _load(batch: pa.RecordBatch, n: int, dims: int, names: tuple[str, str, str]) -> Block:
    ids, x, turned = (batch.column(c)[n] for c in names)
    return Block(np.frombuffer(x.as_py(), np.float64).reshape(-1, dims), np.frombuffer(turned.as_py(), np.float32).reshape(dims, -1), _ids(ids.values))


def _search(batches: Iterator[pa.RecordBatch], dims: int, k: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    def results(q: Block, best: Lists) -> pa.RecordBatch:
        n = [len(d) for d in best.d]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, n).tolist(), id_type), pa.array([x for i in best.ids for x in i.tolist()], id_type), pa.array(np.sqrt(np.concatenate(best.d)))], ["id", "neighbour", "distance"])

    now = q = best = None
    for batch in batches:
        for n in range(batch.num_rows):
            key = batch.column("q_ids")[n]
            if now is None or key != now:
                if q:
                    yield results(q, best)
                now, q = key, _load(batch, n, dims, ("q_ids", "q_x", "q_turned"))
                best = Lists(q, np.frombuffer(batch.column("q_limits")[n].as_py(), np.float64), k)
            search(q, _load(batch, n, dims, ("ids", "x", "turned")), best)
    if q:
        yield results(q, best)


def _valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    named = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    return named.where("size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('inf'))")


def nearest(queries: DataFrame, base: DataFrame, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``(id, rank, neighbour, distance)``: of every row of ``queries`` the ``k`` nearest rows of ``base`` by Euclidean distance, then id.

    Both tables have ``id_column``, of one type of integers or strings, and ``vector_column``. A row of ``base`` with the query's id is not its
    neighbour. All vectors count whose length is the commonest of ``base`` (the greater length on ties) and whose values are all finite; rows
    with null ids or vectors, nulls in vectors, other lengths or NaN are ignored. Repeated ids are one vector, the least of them. Fewer than
    ``k`` others give fewer rows; empty tables give none. Extra columns are ignored. ``sample`` bounds the vectors that rotation, clusters and
    first limits are taken from.
    """
    spark = base.sparkSession
    named = _valid(base, id_column, vector_column)
    sizes = named.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kind = base.schema[id_column].dataType.simpleString()
    if sizes is None:
        return spark.createDataFrame([], f"id {kind}, rank int, neighbour {kind}, distance double")
    dims = sizes["n"]
    one = lambda df: df.where(F.size("vector") == dims).groupBy("id").agg(F.min("vector").alias("vector"))
    few = named.where(F.size("vector") == dims).withColumn("h", F.xxhash64("id")).where(F.col("h") <= hash_cut(sample, sizes["count"])).groupBy("id").agg(F.min("vector").alias("vector"), F.min("h").alias("h")).orderBy("h", "id").limit(sample).collect()
    shared = spark.sparkContext.broadcast(Space(dims, np.array([r["vector"] for r in few], np.float64).reshape(-1, dims), [r["id"] for r in few]))
    schema = f"ids array<{kind}>, x binary, turned binary, limits binary"

    def blocks(df: DataFrame, name: str) -> DataFrame:
        near = df.mapInArrow(lambda it: _prepare(it, shared.value, dims), f"id {kind}, vector array<double>, cluster int")
        near = near.repartitionByRange("cluster", F.xxhash64("id")).sortWithinPartitions("cluster", "id")
        return stage(near.mapInArrow(lambda it: _block_rows(it, shared.value, dims, k), schema), name)

    asked = _valid(queries, id_column, vector_column).select(F.col("id").cast(kind).alias("id"), "vector").where("id is not null")
    asked = blocks(one(asked), "queries").select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "x", "turned", "limits")))
    id_type = pa.string() if kind == "string" else {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    pairs = asked.crossJoin(blocks(one(named), "blocks").select("ids", "x", "turned"))
    found = pairs.mapInArrow(lambda it: _search(it, dims, k, id_type), f"id {kind}, neighbour {kind}, distance double")
    ranked = found.selectExpr("id", "cast(row_number() over (partition by id order by distance, neighbour) as int) as rank", "neighbour", "distance")
    return ranked.where(F.col("rank") <= k)


#: Queries are the rows whose id is divisible by this.
QUERY_IDS = 50
#: DuckDB SQL of :func:`nearest` over the table embeddings, its rows of ids divisible by QUERY_IDS as queries, distances to 6 digits.
SQL = f"""
SELECT a.vec_id AS id, CAST(r AS INT) AS rank, neighbour, round(distance, 6) AS distance FROM (
  SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % {QUERY_IDS} = 0) a
  JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.vec_id <> b.vec_id
) a WHERE r <= {K}
"""
