"""Exact top-k search by inner product with an M-tree.

With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0): then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest points are those with the largest inner products
and the metric's triangle inequality holds. Vectors are dealt by nearest pivot to shards of bounded
size. In a shard, an M-tree pages them: a routing entry stores its object, covering radius and
distance to its parent; the pages are kept in a table. A query visits nodes best first by lower bound; stored distances rule out
entries before any distance to them is computed. Leaves compute exact integer products.
Pruning uses floats with a margin and keeps ties, so results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SCALE = 1024
K = 10
PIVOTS = 1024  # most pivots
PIVOT_SAMPLE = 8192  # vectors they are chosen among
SHARD_ROWS = 4096  # vectors of a shard
PAGE = 128  # entries of a tree page
QUERY_BLOCK = 2048  # queries that one task searches a shard for, or holds against regions
REGION_BLOCK = 2048  # shards' regions that one task holds queries against
MARGIN = 1e-6


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of floor(SCALE * x)); rows without id, null vectors and those with null or non-finite components are left out."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = raw.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return good.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).cast("array<long>").alias("v"))


class MTree:
    """An M-tree over points (float64, augmented) as flat arrays, so that a table can keep it.

    Page p holds the entries first[p] to first[p + 1]. An entry has the row of its object, the distance of that to the page's own
    routing object and, if the page is not a leaf, its covering radius and child page (leaf: 0 and -1). Page 0 is the root.
    """

    def __init__(self, points: np.ndarray, first, row, radius, to_parent, child):
        self.points, self.computed = points, 0
        self.first, self.row, self.child = (np.asarray(x, np.int64) for x in (first, row, child))
        self.radius, self.to_parent = np.asarray(radius, np.float64), np.asarray(to_parent, np.float64)

    @classmethod
    def load(cls, points: np.ndarray, page: int = PAGE) -> MTree:
        """Bulk load: rows go to the nearest of far-apart objects, level by level, until a page holds them."""

        def to(rows: np.ndarray, at: int) -> np.ndarray:
            return np.sqrt(((points[rows] - points[at]) ** 2).sum(1))

        def split(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
            """(object, rows) of up to `page` groups; equal points are cut by place."""
            fan = int(min(page, max(2, -(-len(rows) // page))))
            picks, near, owner = [int(rows[0])], to(rows, int(rows[0])), np.zeros(len(rows), np.int64)
            while len(picks) < fan and near.max() > 0:
                picks.append(int(rows[near.argmax()]))
                d = to(rows, picks[-1])
                closer = d < near
                owner[closer], near = len(picks) - 1, np.minimum(near, d)
            if len(picks) == 1:
                return [(int(part[0]), part) for part in np.array_split(rows, fan)]
            return [(p, rows[owner == i]) for i, p in enumerate(picks)]

        first, entries, waiting = [0], [], [(np.arange(len(points)), None)]
        for rows, parent in waiting:  # grows while pages are split
            groups = [(int(r), None) for r in rows] if len(rows) <= page else split(rows)
            objects = np.array([g[0] for g in groups], np.int64)
            far = to(objects, parent) if parent is not None else np.zeros(len(objects))
            for (item, below), distance in zip(groups, far.tolist()):
                entries.append((item, 0.0 if below is None else float(to(below, item).max()), distance, -1 if below is None else len(waiting)))
                if below is not None:
                    waiting.append((below, item))
            first.append(len(entries))
        row, radius, to_parent, child = zip(*entries) if entries else ((), (), (), ())
        return cls(points, first, row, radius, to_parent, child)

    def search(self, q: np.ndarray, whole: np.ndarray, ids: np.ndarray, values: np.ndarray, own: int, k: int, top: list, base: float) -> list:
        """Best k (score, -id) as a heap, starting from `top`. q: augmented query; whole: its integers; own: the place of its own row, or -1; base: |q|^2 + M^2.

        `computed` counts the distances and products that were computed.
        """

        def reach() -> float:
            return np.inf if len(top) < k else np.sqrt(max(base - 2 * top[0][0], 0.0)) + MARGIN

        queue = [(0.0, 0, np.nan)]
        while queue:
            low, page, from_parent = heapq.heappop(queue)
            limit = reach()
            if low > limit:
                break
            entries = np.arange(self.first[page], self.first[page + 1])
            if from_parent == from_parent and limit < np.inf:  # stored distances rule entries out before any new one is computed
                entries = entries[np.abs(from_parent - self.to_parent[entries]) - self.radius[entries] <= limit]
            if not len(entries):
                continue
            rows = self.row[entries]
            self.computed += len(rows)
            if self.child[entries[0]] < 0:
                scores = values[rows] @ whole
                if len(top) >= k:
                    good = scores >= top[0][0]
                    rows, scores = rows[good], scores[good]
                for at, i, s in zip(rows.tolist(), ids[rows].tolist(), scores.tolist()):
                    if at != own:
                        if len(top) < k:
                            heapq.heappush(top, (s, -i))
                        elif (s, -i) > top[0]:
                            heapq.heapreplace(top, (s, -i))
                continue
            d = np.sqrt(((self.points[rows] - q) ** 2).sum(1))
            lows = np.maximum(np.maximum(d - self.radius[entries], 0), low)
            for distance, bound, child in zip(d.tolist(), lows.tolist(), self.child[entries].tolist()):
                if bound <= limit:
                    heapq.heappush(queue, (bound, child, distance))
        return top


def augmented(values: np.ndarray, norm2: float) -> np.ndarray:
    flat = values.astype(np.float64)
    return np.concatenate([flat, np.sqrt(np.maximum(norm2 - (flat**2).sum(1), 0))[:, None]], axis=1)


def top_k(vectors: DataFrame, is_query, k: int = K, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows (all, if there are fewer).

    is_query: a condition on the id. Scores are integer inner products of the quantised vectors, ties go to
    the smaller id. Every row is a candidate, rows of an equal id too, but a query's own row is not; of several rows with one query id each is a query
    and has its own ranks. Shorter vectors count as padded with zeros. Rows without an id take no part. Products must fit 63 bits. A query without
    candidates, like an empty table, gives no row; other columns don't matter.

    Round one searches each query's own shard; its k-th score bounds round two, in which a query goes to those
    other shards only whose covering radius comes near enough. A task holds one shard and one block of queries.
    """
    spark = vectors.sparkSession
    rows = settle(quantised(vectors, id_col, vector_col).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    facts = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()
    n, dims, norm2 = facts[0], int(facts[1] or 0), float(facts[2] or 0)
    part = min(1.0, PIVOT_SAMPLE / max(1, n))
    sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 24)) < int(part * (1 << 24))).select("v").limit(2 * PIVOT_SAMPLE).toPandas()["v"]
    pivots = spark.sparkContext.broadcast(far_apart(augmented(matrix(sample, dims), norm2), min(PIVOTS, max(1, n // shard_rows))))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = augmented(matrix(pdf["v"], dims), norm2)
            d = ((points**2).sum(1)[:, None] + (pivots.value**2).sum(1)[None, :] - 2 * points @ pivots.value.T) if len(points) else np.zeros((0, 1))
            yield pdf.assign(pivot=d.argmin(1))

    dealt = settle(rows.mapInPandas(near, "row long, vec_id long, v array<long>, pivot int"))
    sizes = dealt.groupBy("pivot").agg(F.count("*").alias("rows"))  # one row a pivot
    parts = F.ceil(F.col("rows") / shard_rows).cast("int")
    sharded = dealt.join(F.broadcast(sizes), "pivot").select("row", "vec_id", "v", (F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("row"), parts)).alias("shard"))

    tree_schema = "shard long, centre array<double>, reach double, rows array<long>, ids array<long>, data binary, first array<int>, row array<int>, radius array<double>, to_parent array<double>, child array<int>"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        values = matrix(pdf["v"], dims)
        points = augmented(values, norm2)
        tree = MTree.load(points)
        centre = points[((points - points.mean(0)) ** 2).sum(1).argmin()]
        far = np.sqrt(((points - centre) ** 2).sum(1)).max()
        row = {"shard": pdf["shard"].iloc[0], "centre": centre, "reach": far, "rows": pdf["row"].to_numpy(), "ids": pdf["vec_id"].to_numpy(), "data": values.tobytes()}
        return pd.DataFrame([row | {name: getattr(tree, name) for name in PAGES}])

    shards = settle(sharded.groupBy("shard").applyInPandas(build, tree_schema))
    queries = settle(sharded.filter(is_query(F.col("vec_id"))).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", "shard"))
    first = settle(search(queries.withColumn("limit", F.lit(None).cast("double")), shards, dims, norm2, k))
    kth = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    limit = F.when(F.col("n") >= k, F.col("score").cast("double"))  # a lower bound of the k-th score
    asked = queries.join(kth.select("query", limit.alias("limit")), "query", "left")
    others = visits(asked, shards.select("shard", "centre", "reach"), dims, norm2)
    second = search(others.join(queries.drop("shard"), "query"), shards, dims, norm2, k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = first.unionAll(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


PAGES = ("first", "row", "radius", "to_parent", "child")


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n points by farthest-first choice; a point at the origin if there are none."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    picks, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(picks) < n and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[picks[-1]]) ** 2).sum(1))
    return points[picks]


def visits(asked: DataFrame, regions: DataFrame, dims: int, norm2: float) -> DataFrame:
    """query, shard and limit for each query and other shard that may hold one of its best.

    A task holds a block of queries against a block of regions; the number of blocks follows both counts. Vectors are joined to what is left.
    """
    n_queries, n_regions = asked.count(), regions.count()
    tall, wide = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_regions // REGION_BLOCK))

    def near(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            centres, radii, shards = np.stack(right["centre"].to_numpy()), right["reach"].to_numpy(), right["shard"].to_numpy()
            flat, last = centres[:, :-1], centres[:, -1] ** 2
            for query, v, own, limit in zip(left["query"], matrix(left["v"], dims), left["shard"], left["limit"].to_numpy(np.float64, na_value=np.nan)):
                d = np.sqrt(((flat - v) ** 2).sum(1) + last) - radii
                far = np.inf if np.isnan(limit) else np.sqrt(max(float(v @ v) + norm2 - 2 * limit, 0.0)) + MARGIN
                met = shards[(d <= far) & (shards != own)]
                out.append(pd.DataFrame({"query": query, "shard": met, "limit": limit}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "shard": [], "limit": []})

    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query", "v", "shard", "limit", part("query", tall).alias("tall")).select("*", every(wide).alias("wide"))
    right = regions.select("*", part("shard", wide).alias("wide")).select("*", every(tall).alias("tall"))
    return left.groupBy("tall", "wide").cogroup(right.groupBy("tall", "wide")).applyInPandas(near, "query long, shard long, limit double")


def search(queries: DataFrame, shards: DataFrame, dims: int, norm2: float, k: int) -> DataFrame:
    """Up to k rows (query, query_id, vec_id, score) for each query and shard that it names; a query's limit is a score that k rows are known to reach."""
    counts = queries.groupBy("shard").agg(F.count("*").alias("asked"))
    counts = counts.select("shard", F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("blocks"))
    left = queries.join(counts, "shard").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int")).drop("blocks")
    right = shards.select("shard", "rows", "ids", "data", *PAGES).join(counts, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            rows, ids = (np.asarray(right[name].iloc[0], np.int64) for name in ("rows", "ids"))
            values = np.frombuffer(right["data"].iloc[0], np.int64).reshape(len(ids), dims)
            tree = MTree(augmented(values, norm2), *(right[name].iloc[0] for name in PAGES))
            place = {row: at for at, row in enumerate(rows.tolist())}
            for query, name, whole, limit in zip(left["query"].tolist(), left["query_id"].tolist(), matrix(left["v"], dims), left["limit"].to_numpy(np.float64, na_value=np.nan)):
                known = [] if np.isnan(limit) else [(limit, -np.inf)] * k  # k rows elsewhere: only better ones or ties matter
                top = tree.search(np.append(whole.astype(np.float64), 0.0), whole, ids, values, place.get(query, -1), k, known, float(whole @ whole) + norm2)
                out += [(query, name, -int(i), int(s)) for s, i in top if i != -np.inf]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"])

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "query long, query_id long, vec_id long, score long")
