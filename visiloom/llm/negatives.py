"""Hard-negative mining over inverted lists of a k-means clustering, exact by Cauchy-Schwarz bounds.

Vectors are put into the list of their nearest centroid; a list is stored as blocks of at most `LIST` rows with the
block's radius, the largest distance of its rows from the centroid. For an anchor a, a block with centroid c and radius r
holds scores between <a, c> - |a| r and <a, c> + |a| r. An anchor visits blocks by descending upper bound, skips those
whose range misses its score windows, and stops when the bound falls strictly below its k-th best score.

Two searches use the same walk. Positives: the k best rows of the anchor's label. Negatives: for each positive with score
p, the k best rows of other labels with scores s, least * p <= 100 s <= most * p. Each search first takes a floor from a
few rows of the anchor's own list, which tells which lists its group of anchors needs at all; a chunk of blocks meets a
group of anchors in one task, and what all tasks found is ranked by anchor. Lists of any length are many blocks, so a
cluster with most of the rows is dealt over as many tasks as it has chunks.

Centroids come from Lloyd's iterations over the `SAMPLE` rows of least hash of their id; every row is put in a list, and
bounds hold whatever the centroids are, so results are exact.

Rows: a null id, label or vector, or a null or non-finite component, takes no part; an empty vector scores 0, shorter ones
count as filled with zeros. Components are floor(256 x), scores beyond a long's range its ends. Rows of the anchor's id
are never its candidates; an id that occurs again is a candidate each time and, as an anchor, counts once, with its least
(label, vector). Ties go to the smaller id. Windows of a negative p are empty. Other columns aren't read, whatever their
names. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored
from .topk import EXACT, LEAST, MOST, _lengths, _matrix, _stored, _vectors, best, quantised

#: Rows of a list block and of a block of anchors; blocks that meet in a task; rows of a list that floors are taken from.
LIST, ANCHORS, CHUNK, GROUP, SEED = 1024, 512, 32, 32, 256
SAMPLE, MOST_CLUSTERS, STEPS = 8192, 512, 8


def centroids(vectors: DataFrame, width: int, rows: int) -> np.ndarray:
    """About the root of the number of rows, from a sample of a fixed size."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    x = _matrix(some.column(0).combine_chunks(), width).astype(np.float64)
    k = max(1, min(math.isqrt(rows) // 2, MOST_CLUSTERS, len(x)))
    c = x[:: len(x) // k][:k].copy()
    for _ in range(STEPS):
        near = nearest(x, c)[0]
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance."""
    at = np.argmin((c**2).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
    return at, np.sqrt(((x - c[at]) ** 2).sum(1))


def assigned(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, label, v, cluster, away (from the centroid)."""
    width = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, away = nearest(_matrix(b.column(2), width).astype(np.float64), c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(away)], names=["vec_id", "label", "v", "cluster", "away"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<long>, cluster int, away double")


def packed_lists(rows: DataFrame, width: int, size: int, *extra: str) -> DataFrame:
    """part, block, cluster, radius, ids, labels, data and, for arrays of long of one length named in `extra`, `extra`: rows of one cluster, at most `size` to a block, numbered within a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held = TaskContext.get().partitionId(), 0, None

        def row(t: pa.Table) -> pa.RecordBatch:
            ids, labels = (np.asarray(t[c]).astype("<i8").tobytes() for c in ("vec_id", "label"))
            more = [pa.array([np.asarray(t[c].combine_chunks().values).astype("<i8").tobytes()], pa.binary()) for c in extra]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), t["cluster"].combine_chunks()[:1], pa.array([max(t["away"].to_numpy())]), *(pa.array([x], pa.binary()) for x in (ids, labels, _stored(_matrix(t["v"].combine_chunks(), width)))), *more], names=["part", "block", "cluster", "radius", "ids", "labels", "data", *extra])

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            at = np.asarray(held["cluster"])
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            done = 0
            for a, e in zip(edges[:-1], edges[1:]):
                while e - a >= size or a < e < len(at):  # a full block, or the end of a cluster
                    yield row(held.slice(a, min(size, e - a)))
                    block += 1
                    done = a = min(a + size, e)
            held = held.slice(done) if done < len(at) else None
        if held is not None and held.num_rows:
            yield row(held)

    order = ("cluster", "vec_id")
    dealt = rows.select("vec_id", "label", "v", "cluster", "away", *extra).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "part int, block int, cluster int, radius double, ids binary, labels binary, data binary" + "".join(f", {c} binary" for c in extra))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, cut to a long's range."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.array([[min(max(sum(map(int.__mul__, x, y)), LEAST), MOST) for y in b.tolist()] for x in a.tolist()], dtype=np.int64).reshape(len(a), len(b))


class Members:
    """A block of a list."""

    def __init__(self, row: dict, width: int):
        self.cluster, self.radius = row["cluster"], row["radius"]
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.whole = _vectors(row["data"], width)


class Anchors(Members):
    """A block of anchors, the score windows of each, and the k best in each window so far."""

    def __init__(self, row: dict, width: int, k: int, same: bool, floors: bytes | None = None):
        super().__init__(row, width)
        self.k, self.same, n = k, same, len(self.ids)
        self.real, self.length = self.whole.astype(np.float64), _lengths(self.whole)
        if row.get("windows"):
            both = np.frombuffer(row["windows"], "<i8").reshape(n, -1, 2)
            self.low, self.high = both[:, :, 0], both[:, :, 1]
        else:
            self.low, self.high = np.full((n, 1), LEAST), np.full((n, 1), MOST)
        #: Scores below these can't be among the results.
        self.floor = self.low.copy() if floors is None else np.frombuffer(floors, "<i8").reshape(self.low.shape).copy()
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and highest score of each anchor with what is within a radius of each centroid, widened by what doubles may be off."""
        middle, reach = self.real @ c.T, self.length[:, None] * radius[None, :]
        slack = 1e-3 + 1e-9 * (np.abs(middle) + self.length[:, None] * (_lengths(c)[None, :] + radius[None, :]))
        return middle - reach - slack, middle + reach + slack

    def open(self) -> np.ndarray:
        """The windows that can still gain: empty ones can't."""
        return self.low <= self.high

    def needs(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether scores between `least` and `most` (a column a block) can enter a window of each anchor."""
        out = np.zeros(least.shape, dtype=bool)
        for w in range(self.low.shape[1]):
            out |= self.open()[:, w, None] & (most >= self.floor[:, w, None]) & (least <= self.high[:, w, None])
        return out

    def score(self, some: np.ndarray, m: Members) -> None:
        """Scores some anchors with all rows of a block."""
        s = products(self.whole[some], m.whole)
        fits = (self.labels[some][:, None] == m.labels[None, :]) == self.same
        fits &= self.ids[some][:, None] != m.ids[None, :]
        for w in range(self.low.shape[1]):
            hit = fits & (s >= self.floor[some, w, None]) & (s <= self.high[some, w, None])
            for i in np.flatnonzero(hit.any(1)).tolist():
                a, at = int(some[i]), np.flatnonzero(hit[i])
                old = self.found.get((a, w))
                scores, ids = (s[i, at], m.ids[at]) if old is None else (np.concatenate([old[0], s[i, at]]), np.concatenate([old[1], m.ids[at]]))
                keep = best(scores, ids, self.k)
                self.found[a, w] = scores[keep], ids[keep]
                if len(keep) == self.k:
                    self.floor[a, w] = max(self.floor[a, w], scores[keep[-1]])

    def visit(self, lists: list[Members], c: np.ndarray) -> None:
        """Each anchor goes through the blocks by descending bound; anchors that are at one block together are scored together."""
        least, most = self.bounds(c[[m.cluster for m in lists]], np.array([m.radius for m in lists]))
        order = np.argsort(-most, axis=1, kind="stable")
        every = np.arange(len(self.ids))
        for step in range(len(lists)):
            at = order[:, step]
            lowest = np.where(self.open(), self.floor, MOST).min(axis=1)
            alive = most[every, at] >= lowest  # later blocks have lower bounds, and floors only rise
            if not alive.any():
                break
            for b in np.unique(at[alive]).tolist():
                some = np.flatnonzero(alive & (at == b))
                some = some[self.needs(least[:, b : b + 1], most[:, b : b + 1])[some, 0]]
                if len(some):
                    self.score(some, lists[b])

    def floors(self, m: Members) -> bytes:
        """k-th best scores among a few rows, which are scored again later."""
        self.score(np.arange(len(self.ids)), m)
        return self.floor.astype("<i8").tobytes()


def _searched(anchors: DataFrame, lists: DataFrame, radii: DataFrame, c: np.ndarray, k: int, same: bool, label: str) -> DataFrame:
    """vec_id (the anchor's), w (number of its window), id, score: the k best in each window. anchors and lists are packed lists."""
    width = c.shape[1]
    known = radii.orderBy("cluster").collect()  # a row a cluster
    used, radius = np.array([r.cluster for r in known]), np.array([r.radius for r in known])

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = Anchors(r, width, k, same)
                seed = Members({"cluster": 0, "radius": 0.0, "ids": r["seed_ids"], "labels": r["seed_labels"], "data": r["seed_data"]}, width)
                floors = a.floors(seed)
                wanted = used[a.needs(*a.bounds(c[used], radius)).any(0)]
                r = {x: r[x] for x in ("part", "block", "cluster", "radius", "ids", "labels", "data", "windows")} | {"floors": floors, "wanted": wanted.tolist()}
                yield pa.RecordBatch.from_pylist([r], schema=FLOORED)

    seeds = lists.where("seed_ids is not null").select("cluster", "seed_ids", "seed_labels", "seed_data")
    if "windows" not in anchors.columns:
        anchors = anchors.withColumn("windows", F.lit(None).cast("binary"))
    asked = stored(anchors.join(seeds, "cluster").mapInArrow(floored, "part int, block int, cluster int, radius double, ids binary, labels binary, data binary, windows binary, floors binary, wanted array<int>"), f"{label}-anchors")
    asked = asked.withColumn("g", F.struct("part", F.floor(F.col("block") / GROUP).alias("n")))
    chunk = F.struct("part", F.floor(F.col("block") / CHUNK).alias("n")).alias("c")
    wanted = asked.select("g", F.explode("wanted").alias("cluster")).distinct()
    left = lists.select("cluster", "radius", "ids", "labels", "data", chunk).join(wanted, "cluster").withColumnsRenamed({"g": "left_g", "c": "left_c"})
    met = lists.select("cluster", chunk).distinct().join(wanted, "cluster").select("g", "c").distinct()
    right = asked.select("g", "cluster", "radius", "ids", "labels", "data", "windows", "floors").join(met, "g")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        members = [Members(r, width) for r in left.to_pylist()]
        out: list[tuple[np.ndarray, ...]] = []
        for r in right.to_pylist() if members else ():
            a = Anchors(r, width, k, same, r["floors"])
            a.visit(members, c)
            out += [(np.full(len(s), a.ids[i]), np.full(len(s), w), ids, s) for (i, w), (s, ids) in a.found.items()]
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int32)), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["vec_id", "w", "id", "score"])

    some = left.groupBy("left_g", "left_c").cogroup(right.groupBy("g", "c")).applyInArrow(run, "vec_id long, w int, id long, score long")
    order = Window.partitionBy("vec_id", "w").orderBy(F.desc("score"), F.asc("id"))
    return some.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


FLOORED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("cluster", pa.int32()), ("radius", pa.float64()), *((x, pa.binary()) for x in ("ids", "labels", "data", "windows", "floors")), ("wanted", pa.list_(pa.int32()))])


def inverted_lists(vectors: DataFrame, width: int, rows: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The stored lists (one block of each cluster also carries the rows that floors are taken from), the stored rows with their cluster, and the centroids."""
    c = centroids(vectors, width, rows)
    placed = stored(assigned(vectors, c), "assigned")

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x.as_py()) // 8 for x in b.column("ids")]
            head = [x.as_py()[: 8 * SEED] for x in b.column("ids")], [x.as_py()[: 8 * SEED] for x in b.column("labels")], [_stored(_vectors(x.as_py(), width)[:SEED]) if m else None for x, m in zip(b.column("data"), n)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(h, pa.binary()) for h in head)], names=[*b.schema.names, "seed_ids", "seed_labels", "seed_data"])

    lists = stored(packed_lists(placed, width, LIST), "lists")
    first = lists.groupBy("cluster").agg(F.min(F.struct("part", "block")).alias("f")).select("cluster", "f.*")  # a row a cluster
    schema = "part int, block int, cluster int, radius double, ids binary, labels binary, data binary, seed_ids binary, seed_labels binary, seed_data binary"
    seeds = lists.join(first, ["cluster", "part", "block"]).select(*lists.columns).mapInArrow(seeded, schema).select("cluster", "part", "block", "seed_ids", "seed_labels", "seed_data")
    return stored(lists.join(seeds, ["cluster", "part", "block"], "left"), "lists-seeded"), placed, c


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, v; anchors: which of them are."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    vectors = stored(vectors.select("vec_id", F.col("label").cast("long").alias("label"), "v"), "vectors")
    found = vectors.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    if not found.n:
        return empty
    width = max(found.w, 1)
    lists, placed, c = inverted_lists(vectors, width, found.n)
    radii = lists.groupBy("cluster").agg(F.max("radius").alias("radius"))
    asked = placed.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v", "cluster", "away")).alias("x")).select("vec_id", "x.*")
    good = stored(_searched(stored(packed_lists(asked, width, ANCHORS), "positives-asked"), lists, radii, c, positives, True, "positives"), "positives")
    # windows of a score p: from the least s with 100 s >= least * p to the highest with 100 s <= most * p
    def edge(share: int, up: bool) -> Column:
        part = F.lit(share).cast("decimal(10,0)") * F.col("score").cast("decimal(19,0)") / 100
        return (F.ceil(part) if up else F.floor(part)).cast("long")

    windows = good.where("score >= 0").withColumns({"low": edge(least, True), "high": edge(most, False)})
    listed = windows.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("l"))  # `positives` rows a group at most
    none = F.struct(F.lit(MOST).alias("low"), F.lit(LEAST).alias("high"))
    # a positive that isn't there, or whose score is below 0, has an empty window
    both = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at(F.filter("l", lambda x: x["rank"] == i), F.lit(1)).dropFields("rank"), none))
    again = asked.join(listed.select("vec_id", F.flatten(F.transform(both, lambda x: F.array(x["low"], x["high"]))).alias("windows")), "vec_id")
    bad = _searched(stored(packed_lists(again, width, ANCHORS, "windows"), "negatives-asked"), lists, radii, c, negatives, False, "negatives")
    pairs = good.select("vec_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = bad.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["vec_id", "w"])
    return named.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled(vectors: DataFrame, label: str | Column = "label") -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    rows = vectors.select("vec_id", "embedding", (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"))
    return quantised(rows.where("label is not null"), keep=("label",)).select("vec_id", "label", "v")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_resize(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)), (SELECT max(len(embedding)) FROM embeddings), 0.0) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
