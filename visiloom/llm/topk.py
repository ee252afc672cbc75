"""Exact top-k by inner product over norm-sorted blocks.

Vectors are dealt out by descending length and packed into blocks. An orthogonal rotation from the SVD (eigenvectors of
the Gram matrix, summed over all rows) moves the large components to the front. A block is skipped for a query whose
length times the block's largest is below the query's k-th best score so far; in the others a partial product over the
leading rotated components plus the product of the residual lengths (Cauchy-Schwarz) bounds each score, and only vectors
whose bound reaches the k-th best are scored, exactly, in integers. Thresholds start from the longest block, so before
anything is copied a group of queries knows from lengths alone which chunks of candidates it can do without; a chunk is
copied once for each group of GROUP query blocks that needs it.

Rows: vectors that are null or hold a null or non-finite component take no part; shorter ones, the empty one too, count as
filled with zeros. Components are floor(256 x), at most the range of a long; sums that doubles can't hold are made in whole numbers, and
scores beyond a long's range come out as its ends. Other columns aren't read. A vec_id that occurs again is
a candidate each time; as a query it counts once, with its least vector, and no row of that id is its candidate. Ties go to the smaller vec_id.
An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

BLOCK, QUERIES, CHUNK, GROUP, LEADING = 2048, 1024, 32, 64, 16
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v (array of long), n2 (squared length) of the vectors that take part, and columns to keep."""
    x = F.col(embedding)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * 256).cast("long"))
    out = vectors.where(F.col(vec_id).isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), *keep)
    return out.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def _stored(m: np.ndarray) -> bytes:
    """Rows of whole numbers, four bytes each where that is enough; the first byte says how many."""
    width = 4 if not m.size or np.abs(m.astype(np.float64)).max() < 1 << 31 else 8
    return bytes([width]) + m.astype(f"<i{width}").tobytes()


def _vectors(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, width).astype(np.int64)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: right singular vectors of all vectors, largest first. Sums one width x width matrix a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width).astype(np.float64)
            gram += m.T @ m
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram.ravel())], names=["i", "j", "g"])

    rows = vectors.select("v").mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()  # width^2 rows
    gram = np.zeros((width, width))
    for r in rows:
        gram[r.i, r.j] = r.g
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(1))


def blocks(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """part, block, longest, ids, data: vectors by descending length, `size` to a block; part and block number them in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, ids, rows, n = TaskContext.get().partitionId(), 0, [], [], 0

        def row(i: np.ndarray, m: np.ndarray, block: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([float(_lengths(m).max())]), pa.array([i.astype("<i8").tobytes()], pa.binary()), pa.array([_stored(m)], pa.binary())], names=["part", "block", "longest", "ids", "data"])

        for b in batches:
            ids.append(np.asarray(b.column(0)))
            rows.append(_matrix(b.column(1), width))
            n += b.num_rows
            while n >= size:
                i, m = np.concatenate(ids), np.concatenate(rows)
                yield row(i[:size], m[:size], block)
                ids, rows, n, block = [i[size:]], [m[size:]], n - size, block + 1
        if n:
            yield row(np.concatenate(ids), np.concatenate(rows), block)

    order = (F.desc("n2"), F.asc("vec_id"))
    sorted_ = vectors.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return sorted_.select("vec_id", "v").mapInArrow(run, "part int, block int, longest double, ids binary, data binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


class Candidates:
    """A block of candidates as it is compared: whole numbers, lengths, leading rotated components and the length of the rest."""

    def __init__(self, ids: bytes, data: bytes, turn: np.ndarray):
        self.ids, self.whole = np.frombuffer(ids, "<i8"), _vectors(data, len(turn))
        self.real = self.whole.astype(np.float64)
        turned = self.real @ turn
        self.longest, self.most = float(_lengths(self.whole).max()), float(np.abs(self.real).max())
        self.leading, self.rest = turned[:, :LEADING], np.sqrt((turned[:, LEADING:] ** 2).sum(1))


class Queries:
    """A block of queries with the k best of each so far, and the k-th best score, from the longest candidates at first."""

    def __init__(self, ids: bytes, data: bytes, seed: Candidates, turn: np.ndarray, k: int):
        self.ids, self.whole, self.k = np.frombuffer(ids, "<i8"), _vectors(data, len(turn)), k
        self.real = self.whole.astype(np.float64)
        self.length, self.most = _lengths(self.whole), float(np.abs(self.real).max())
        turned = self.real @ turn
        self.leading, self.rest = turned[:, :LEADING], np.sqrt((turned[:, LEADING:] ** 2).sum(1))
        first = self.real @ seed.real.T
        first -= 1e-9 * self.length[:, None] * seed.longest if self.most * seed.most * len(turn) >= EXACT else 0
        first[self.ids[:, None] == seed.ids[None, :]] = -np.inf
        self.floor = np.sort(first, axis=1)[:, -k] if len(seed.ids) >= k else np.full(len(self.ids), -np.inf)
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in self.ids]

    def least(self) -> float:
        """Shorter candidates than this can't be among the best of any."""
        return float(np.min(np.where(self.length > 0, (self.floor - 1e-3) / np.maximum(self.length, 1e-300), -np.inf)))

    def meet(self, c: Candidates) -> None:
        slack = 1e-3 + 1e-9 * self.length * c.longest
        live = np.flatnonzero(self.length * c.longest + slack >= self.floor)
        if not len(live):
            return
        bound = self.leading[live] @ c.leading.T + self.rest[live][:, None] * c.rest[None, :]
        near = (bound >= (self.floor - slack)[live][:, None]) & (self.ids[live][:, None] != c.ids[None, :])
        if self.most * c.most * self.whole.shape[1] >= EXACT:  # more than doubles hold
            exact = np.full(near.shape, None, dtype=object)
            for i, j in zip(*np.nonzero(near)):
                exact[i, j] = sum(map(int.__mul__, self.whole[live[i]].tolist(), c.whole[j].tolist()))
        elif near.mean() > 0.1:
            exact = self.real[live] @ c.real.T
            near &= exact >= self.floor[live][:, None]
        else:
            i, j = np.nonzero(near)
            exact = np.full(near.shape, -np.inf)
            exact[i, j] = np.einsum("ij,ij->i", self.real[live][i], c.real[j])
            near &= exact >= self.floor[live][:, None]
        for n in np.flatnonzero(near.any(1)):
            at = np.flatnonzero(near[n])
            s, i = (np.concatenate([a, b]) for a, b in zip(self.found[live[n]], (exact[n, at], c.ids[at])))
            keep = best(s, i, self.k)
            self.found[live[n]] = s[keep], i[keep]
            if len(keep) == self.k:
                self.floor[live[n]] = max(self.floor[live[n]], np.nextafter(float(s[keep[-1]]), -np.inf) if s.dtype == object else s[keep[-1]])


def _copied(rows: DataFrame, keys: list[tuple[int, float]], column: str, shorter: bool) -> DataFrame:
    """rows (own, edge, ids, data) once for each key whose edge theirs doesn't rule out: candidates no shorter than the queries' least. `column` names the key."""
    numbers, edges = np.array([n for n, _ in keys], dtype=np.int32), np.array([e for _, e in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                edge = batch.column("edge")[i].as_py()
                some = numbers[edges <= edge if shorter else edges >= edge]
                for n in some.tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(batch.column(c).slice(i, 1) for c in ("own", "ids", "data"))], names=[column, "own", "ids", "data"])

    return rows.select("own", "edge", "ids", "data").mapInArrow(run, f"{column} int, own int, ids binary, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as quantised() gives them."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = stored(vectors, "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return empty
    width = max(width, 1)
    turn = rotation(vectors, width)
    candidates = stored(blocks(vectors, width, BLOCK), "candidates")
    head = candidates.orderBy("part", "block").limit(1).collect()  # BLOCK vectors
    seed_ids, seed_data = bytes(head[0].ids), bytes(head[0].data)

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = Candidates(seed_ids, seed_data, turn)
        for b in batches:
            least = [Queries(i.as_py(), d.as_py(), seed, turn, k).least() for i, d in zip(b.column("ids"), b.column("data"))]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("block"), pa.array(least, pa.float64()), b.column("ids"), b.column("data")], names=["part", "block", "edge", "ids", "data"])

    asked = blocks(queries.groupBy("vec_id").agg(F.min("v").alias("v"), F.min("n2").alias("n2")), width, QUERIES)
    asked = stored(asked.mapInArrow(edge, "part int, block int, edge double, ids binary, data binary"), "queries")

    def numbered(rows: DataFrame, size: int, edge: Column) -> tuple[DataFrame, list[tuple[int, float]]]:
        """rows with `own`, the number of their chunk or group, and each number's edge: one for BLOCK * CHUNK vectors, or QUERIES * GROUP queries."""
        n_parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
        out = rows.withColumn("own", (F.floor(F.col("block") / size) * n_parts + F.col("part")).cast("int"))
        return out, [(r.own, r.e) for r in out.groupBy("own").agg(edge.alias("e")).orderBy("own").collect()]

    candidates, chunks = numbered(candidates.withColumnRenamed("longest", "edge"), CHUNK, F.max("edge"))
    asked, groups = numbered(asked, GROUP, F.min("edge"))
    if not groups:
        return empty

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_c, out_s = [], [], []
        if left.num_rows and right.num_rows:
            seed = Candidates(seed_ids, seed_data, turn)
            met = sorted((Candidates(i.as_py(), d.as_py(), turn) for i, d in zip(left["ids"], left["data"])), key=lambda c: -c.longest)
            for i, d in zip(right["ids"], right["data"]):
                q = Queries(i.as_py(), d.as_py(), seed, turn, k)
                for c in met:
                    q.meet(c)
                for one, (s, ids) in zip(q.ids.tolist(), q.found):
                    out_q += [one] * len(ids)
                    out_c += ids.tolist()
                    out_s += [min(max(int(x), LEAST), MOST) for x in s]
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_s, pa.int64())], names=["query_id", "vec_id", "score"])

    left = _copied(candidates, groups, "g", True).withColumnRenamed("own", "c")
    right = _copied(asked, chunks, "c", False).withColumnRenamed("own", "g")
    some = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return some.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_resize(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)), (SELECT max(len(embedding)) FROM embeddings), 0.0) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
