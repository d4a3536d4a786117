"""Nearest neighbours: a vantage-point tree per shard, pruned by the triangle inequality with a tunable factor."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import file_system, lines, materialise, read_file, scratch_path

NEAREST, EVERY = 20, 20
#: Points of a leaf; bytes of the vectors of a shard and of a block of queries; blocks that one task answers.
LEAF, SHARD_BYTES, BLOCK_BYTES, TASK_BLOCKS = 64, 10 << 20, 2 << 20, 16
#: A branch is skipped when its bound times the factor exceeds the distance of the worst neighbour held; 1 is exact. Unless a
#: factor is given, each shard takes the largest of FACTORS whose recall against brute force, over at most SAMPLE of its own
#: points as queries, reaches RECALL.
FACTORS, SAMPLE, RECALL = (1.0, 1.25, 1.6, 2.0, 2.5, 3.2, 4.0, 5.0, 6.4, 8.0, 10.0, 13.0, 16.0, 20.0, 26.0, 32.0), 64, 0.96
#: What a bound may exceed a distance by, for the rounding of both; points that a shard gives beyond those needed, for that of products.
MARGIN, SPARE = 1e-6, 8
#: Search tasks a core at most, where there is so much work.
TASKS_A_CORE = 50
#: Shards whose answers to a query meet in one step.
MERGE = 64


class VantagePointTree:
    """Points split at the median distance from a vantage point, down to leaves of at most LEAF points (or of equal distance). A leaf's points lie together.

    Distances are those of the points over their largest norm, with one more coordinate that brings all of them to norm one: the
    nearest to a query of norm one, whose own coordinate is 0, is then that of largest product. They only bound: what is
    nearest is told by the products of the points as they are, and where products are equal the point that comes first.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order, self.nodes, self.leaf = points, np.arange(len(points)), [], leaf
        self.leaves, self.top = 0, 1.0
        if len(points):
            self.top = float(np.sqrt((points**2).sum(axis=1)).max())
            unit = points / self.top
            self._grow(np.column_stack([unit, np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))]), 0, len(points))
            self.points = points[self.order]

    def _grow(self, lifted: np.ndarray, lo: int, hi: int) -> int:
        at = len(self.nodes)
        self.nodes.append((lo, hi))  # a leaf, or (vantage, low and high distance inside, the same outside, inner, outer)
        members = self.order[lo:hi]
        if hi - lo > self.leaf:
            own = lifted[members]
            vantage = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]  # a corner splits better than a centre
            d = np.sqrt(((own - vantage) ** 2).sum(axis=1))
            near = d <= np.median(d)
            if not near.all():
                cut = lo + int(near.sum())
                self.order[lo:hi] = np.concatenate([members[near], members[~near]])
                spans = (d[near].min(), d[near].max(), d[~near].min(), d[~near].max())
                self.nodes[at] = (vantage, *spans, self._grow(lifted, lo, cut), self._grow(lifted, cut, hi))
                return at
        self.leaves += 1
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query, which is not zero, the k points of largest product, best first, their products (place -1 and minus infinity fill up), and how many leaves it visited.

        All queries go through the tree together. First each descends to its own leaf, for a bound; then every node is
        entered once with the queries that its bound does not exclude.
        """
        n, none = len(queries), len(self.points)
        best, who, visited = np.full((n, k), -np.inf), np.full((n, k), none), np.zeros(n, np.int64)
        if not self.nodes:
            return np.where(who < none, who, -1), best, visited
        first = np.full(n, -1)
        norms = np.sqrt((queries**2).sum(axis=1))
        unit = queries / norms[:, None]

        def leaf(at: int, q: np.ndarray) -> None:
            lo, hi = self.nodes[at]
            visited[q] += 1
            products = queries[q] @ self.points[lo:hi].T
            better = (products >= best[q, -1:]).any(axis=1)
            if better.any():
                q = q[better]
                both = np.concatenate([best[q], products[better]], axis=1)
                ids = np.concatenate([who[q], np.broadcast_to(self.order[lo:hi], (len(q), hi - lo))], axis=1)
                pick = np.lexsort((ids, -both), axis=1)[:, :k]
                best[q], who[q] = np.take_along_axis(both, pick, 1), np.take_along_axis(ids, pick, 1)

        def away(v: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.sqrt(((unit[q] - v[:-1]) ** 2).sum(axis=1) + v[-1] ** 2)

        stack = [(0, np.arange(n))]
        while stack:  # to the own leaf
            at, q = stack.pop()
            if len(self.nodes[at]) == 2:
                leaf(at, q)
                first[q] = at
                continue
            v, _, high, low, _, inner, outer = self.nodes[at]
            near = away(v, q) <= (high + low) / 2
            stack += [(kid, part) for kid, part in ((inner, q[near]), (outer, q[~near])) if len(part)]
        stack = [(0, np.arange(n))]
        while stack:
            at, q = stack.pop()
            if len(self.nodes[at]) == 2:
                q = q[first[q] != at]
                if len(q):
                    leaf(at, q)
                continue
            v, *spans, inner, outer = self.nodes[at]
            d, worst = away(v, q), np.sqrt(np.maximum(2 - 2 * best[q, -1] / (norms[q] * self.top), 0))
            for kid, low, high in ((outer, spans[2], spans[3]), (inner, spans[0], spans[1])):
                bound = np.maximum(np.maximum(low - d, d - high), 0)
                part = q[bound * factor <= worst + MARGIN]
                if len(part):
                    stack.append((kid, part))
        return np.where(who < none, who, -1), best, visited

    def measured_factor(self, queries: np.ndarray, k: int) -> float:
        """The largest of FACTORS whose recall over the queries, against the products with all points, reaches RECALL; recall falls as the factor rises, so it is found by halving."""
        if not len(queries) or not self.nodes:
            return FACTORS[0]
        k = min(k, len(self.points))
        true = np.sort(queries @ self.points.T, axis=1)[:, -k]
        lo, hi = 0, len(FACTORS) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            _, found, _ = self.search(queries, k, FACTORS[mid])
            slack = 1e-12 * np.sqrt((queries**2).sum(axis=1)) * self.top
            hits = int((found >= (true - slack)[:, None]).sum())
            lo, hi = (mid, hi) if hits >= RECALL * found.size else (lo, mid - 1)
        return FACTORS[lo]


_TREE = "dim int, shard long, tree string, factor double"
_FOUND = "query_id long, shard long, ids array<long>, scores array<double>, visited long, leaves long, factor double"


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a file of its own and return where; the table that holds the path decides which attempt's file counts."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(path)
    with fs.open_output_stream(at) as f:
        f.write(data)
    return path


def _take(path: str):
    return pickle.loads(read_file(*file_system(path)))


def _planted(folder: str, factor: float | None):
    def build(table: pa.Table) -> pa.Table:
        """The rows (id, v, dim, shard) of one shard as one tree. Equal vectors are one point with its NEAREST + 1 smallest ids: no query needs more of them. Points are in the order of their smallest ids."""
        dim, shard = (table.column(c)[0].as_py() for c in ("dim", "shard"))
        rows = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(table.num_rows, dim)
        ids = table.column("id").to_numpy()
        _, one, of = np.unique(rows.view(np.dtype((np.void, 8 * dim))).ravel(), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        place = np.empty(len(one), np.int64)
        place[np.argsort(least, kind="stable")] = np.arange(len(one))
        points = np.empty((len(one), dim))
        points[place] = rows[one]
        of = place[of]
        order = np.lexsort((ids, of))
        heads = np.searchsorted(of[order], np.arange(len(one) + 1))
        tree = VantagePointTree(points)
        some = points[np.linspace(0, len(points) - 1, min(SAMPLE, len(points))).astype(np.int64)]
        own = tree.measured_factor(some, NEAREST + 1) if factor is None else factor
        path = _put(folder, f"tree-{dim}-{shard}", pickle.dumps((tree, points, ids[order], heads), protocol=5))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "tree": [path], "factor": pa.array([own], pa.float64())})

    return build


def _answered(tree_path: str, shard: int, factor: float, block_path: str, held={}) -> pa.RecordBatch:  # noqa: B006 - the last tree stays
    if tree_path not in held:
        held.clear()
        held[tree_path] = _take(tree_path)
    tree, points, ids, heads = held[tree_path]
    qid, q = _take(block_path)
    who, _, visited = tree.search(q, NEAREST + 1 + SPARE, factor)
    row, col = np.nonzero(who >= 0)
    point = who[row, col]
    n = np.minimum(heads[point + 1] - heads[point], NEAREST + 1)
    row, point = np.repeat(row, n), np.repeat(point, n)
    inside = np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n)
    vec = ids[heads[point] + inside]
    score = (q[row] * points[point]).sum(axis=1)
    keep = vec != qid[row]
    row, vec, score = row[keep], vec[keep], score[keep]
    o = np.lexsort((vec, -score, row))
    row, vec, score = row[o], vec[o], score[o]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < NEAREST
    row, vec, score = row[keep], vec[keep], score[keep]
    offsets = pa.array(np.searchsorted(row, np.arange(len(qid) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (vec, score)]
    return pa.RecordBatch.from_pydict({"query_id": qid, "shard": np.full(len(qid), shard), "ids": lists[0], "scores": lists[1], "visited": visited, "leaves": np.full(len(qid), tree.leaves), "factor": np.full(len(qid), factor)})


def _answers(batches):
    """Rows (tree, shard, factor, paths) to each query's NEAREST within the shard."""
    for b in batches:
        for tree, shard, factor, paths in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            for path in paths:
                yield _answered(tree, shard, factor, path)


def _blocks(folder: str):
    def run(batches):
        """Rows (id, v, dim) to files of queries of one dimension: (dim, path)."""
        held: dict[int, tuple[list, list]] = {}

        def done(dim):
            ids, vs = held.pop(dim)
            block = np.array(ids, np.int64), np.frombuffer(b"".join(vs), np.float64).reshape(len(ids), dim)
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([_put(folder, f"queries-{dim}", pickle.dumps(block, protocol=5))])], names=["dim", "path"])

        for b in lines(batches):
            for i, v, dim in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ids, vs = held.setdefault(dim, ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) * dim * 8 >= BLOCK_BYTES:
                    yield done(dim)
        for dim in list(held):
            yield done(dim)

    return run


def _norm(v: np.ndarray) -> float:
    most = np.abs(v).max()
    return float(most * np.sqrt(((v / most) ** 2).sum()))


def _as_blobs(batches):
    for b in lines(batches):
        vs = [None if v is None else np.array(v, np.float64) for v in b.column(1).to_pylist()]
        good = [v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in vs]
        keep = [i for i, g in enumerate(good) if g and b.column(0)[i].is_valid]
        yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array([vs[i].tobytes() for i in keep], pa.binary()), pa.array([len(vs[i]) for i in keep], pa.int32()), pa.array([int(np.floor((np.log2(_norm(vs[i])) + 0.5) / 2)) for i in keep], pa.int32())], names=["id", "v", "dim", "size"])


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, factor: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, visited, factor): for each row whose id is divisible by every, its NEAREST other rows by inner product.

    Rows are dealt by hash to shards of SHARD_BYTES, vectors within a factor of four in norm together, so that a few long vectors
    do not blur the distances of the others. Each shard builds one tree and writes it into the shared folder, as queries are
    written in blocks; a task is handed the paths of a tree and of TASK_BLOCKS blocks. The shards' answers meet per query, MERGE
    at a time. visited is the share of leaves that the query saw, factor the largest that a shard used; with factor=1 the search is exact.

    Vectors that are null, zero, or hold a null or a non-finite number take no part, nor do rows without id; a vector meets
    only those of its own dimension. Ties go to the smaller vec_id. Rows that repeat an id and its vector count once; an id with
    several vectors is one query (the nearest of all of them) and may be found once for each. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("e")).mapInArrow(_as_blobs, "id long, v binary, dim int, size int")
    rows = materialise(rows.distinct(), "vectors")
    sizes = rows.groupBy("dim", "size").agg(F.ceil(F.count(F.lit(1)) * F.first("dim") * 8 / SHARD_BYTES).alias("n"))
    own = W.partitionBy("dim")  # as many rows as the table has dimensions and binary orders of size
    sizes = sizes.withColumn("base", F.sum("n").over(own.orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).withColumn("shards", F.sum("n").over(own))
    sizes = materialise(sizes, "sizes")
    folder = scratch_path(spark, "trees")
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    dealt = rows.join(sizes, ["dim", "size"]).select("id", "v", "dim", (F.col("base") + F.pmod(F.xxhash64("id", "v"), "n")).alias("shard"))
    trees = materialise(dealt.groupBy("dim", "shard").applyInArrow(_planted(folder, factor), _TREE), "trees")
    blocks = rows.filter(F.col("id") % every == 0).select("id", "v", "dim").mapInArrow(_blocks(folder), "dim int, path string").withColumn("k", F.monotonically_increasing_id())
    blocks = materialise(blocks, "queries")
    groups = max(1, -(-blocks.count() // TASK_BLOCKS))
    blocks = blocks.groupBy("dim", F.pmod(F.xxhash64("k"), F.lit(groups)).alias("g")).agg(F.collect_list("path").alias("paths"))
    # handles only: a row for each tree and group of blocks of its dimension. They are few bytes and much work, so that the
    # number of tasks is set here; a task reads the tree of neighbouring rows once
    tasks = min(trees.count() * groups, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    work = trees.join(blocks, "dim").select("tree", "shard", "factor", "paths").repartition(max(1, tasks), "tree", F.col("paths")[0]).sortWithinPartitions("tree")
    found = materialise(work.mapInArrow(_answers, _FOUND), "answers", rows, trees)
    shards = sizes.agg(F.max("shards")).first()[0] or 1
    while True:  # MERGE answers at a time, so that no group grows with the table
        pairs = F.flatten(F.collect_list(F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("i"))))
        best = F.slice(F.sort_array(pairs), 1, NEAREST)
        merged = found.groupBy("query_id", F.floor(F.col("shard") / MERGE).alias("shard")).agg(best.alias("b"), F.sum("visited").alias("visited"), F.sum("leaves").alias("leaves"), F.max("factor").alias("factor"))
        if shards <= MERGE:
            break
        shards = -(-shards // MERGE)
        found = materialise(merged.select("query_id", "shard", F.transform("b", lambda x: x["i"]).alias("ids"), F.transform("b", lambda x: -x["s"]).alias("scores"), "visited", "leaves", "factor"), "merged", found)
    out = merged.select("query_id", F.posexplode("b").alias("p", "x"), (F.col("visited") / F.col("leaves")).alias("visited"), "factor")
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"), "visited", "factor")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    """The neighbours of every twentieth row of the embeddings table."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
