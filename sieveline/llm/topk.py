"""Exact top-k by inner product: dual-tree search over cover trees of the queries and of blocks of the vectors.

For a query node (centre q, radius r) and a data node (centre c, radius s), no pair below them scores more than
q.c + r|c| + s|q| + r*s. A pair of nodes is left out where that is below the worst k-th score of the node's queries; below a
query leaf the bound is taken for each query by itself, x.c + s|x|, and those that it rules out are left behind. The k-th scores
start from an exact search of a bounded sample of the data, which is a lower bound whatever the sample is.

Where vectors lie far apart in all directions (64 components drawn at random: neighbours at cosine 0.4, balls of any radius
below the nearest distance hold one vector each), no bound can rule out much, and the search is a blocked comparison of nearly
all pairs; `Search.compared` counts them.
"""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir

#: Queries whose tree is sent to the executors at once; more go in blocks of about that number, one after another.
QUERY_BLOCK = 8192
#: Vectors in a data tree.
DATA_BLOCK = 16_384
#: Rows of the sample that starts the k-th scores (expected number).
SAMPLE = 4096
#: Vectors up to which a node is a leaf.
LEAF = 256
#: A level's net covers its node at the node's radius over this, if it needs no more centres than that.
SHRINK = 2.0
MAX_CENTRES = 64
_FOUND = 1_000_000


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None  # of the children, and their radii
    radii: np.ndarray | None = None


def build(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree over x[rows]: a node's children are the balls round a net of its rows, each with its nearest rows.

    The net starts with the node's own centre and takes the farthest row until all are within radius / SHRINK of one, or there
    are as many as make leaves of about LEAF / 2 rows, MAX_CENTRES at most. So every row lies within its node's radius (covering), and the centres of a net are farther apart than any
    row of the node is from the nearest of them (separation). Small sets and equal vectors are leaves.
    """
    rows = np.arange(len(x)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    own = x[rows]
    nearest = np.sqrt(((own - x[centre]) ** 2).sum(axis=1))
    node = Node(x[centre], float(np.sqrt(x[centre] @ x[centre])), float(nearest.max()), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    centres, owner, cover, norms = [centre], np.zeros(len(rows), int), node.radius / SHRINK, (own**2).sum(axis=1)
    most = min(MAX_CENTRES, max(2, 2 * len(rows) // LEAF))
    while nearest.max() > cover and len(centres) < most:
        far = int(nearest.argmax())
        away = np.sqrt(np.maximum(norms + norms[far] - 2 * (own @ own[far]), 0))
        owner[away < nearest] = len(centres)
        owner[far] = len(centres)
        nearest = np.minimum(nearest, away)
        nearest[far] = 0
        centres.append(int(rows[far]))
    node.children = [build(x, rows[owner == i], c) for i, c in enumerate(centres)]
    node.centres, node.radii = np.stack([c.centre for c in node.children]), np.array([c.radius for c in node.children])
    return node


class Search:
    """The best k of all data seen, for a block of queries (ids, integer vectors)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.floor = np.full(len(x), -np.finfo(float).max) if floor is None else floor  # known lower bounds of the k-th scores
        self.tree = build(x) if len(x) else None
        self.norms = np.sqrt((x**2).sum(axis=1))
        self.best = np.full((len(x), k), -np.inf)  # scores, ascending
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.compared = 0

    def kth(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[q, 0], self.floor[q])

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Searches a block of data with all queries: node pairs of highest bound first."""
        if not len(ids) or self.tree is None:
            return
        count = itertools.count()

        def bound(q: Node, d: Node) -> float:
            return _above(float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius)

        data = build(x)
        heap = [(-bound(self.tree, data), next(count), self.tree, data)]
        while heap:
            b, _, q, d = heapq.heappop(heap)
            if -b < self.kth(q.rows).min():
                continue
            if not q.children:
                self.below(q.rows, d, ids, x)
                continue
            for a, c in [(q, y) for y in d.children] if d.children and d.radius >= q.radius else [(y, d) for y in q.children]:
                b = bound(a, c)
                if b >= self.kth(a.rows).min():
                    heapq.heappush(heap, (-b, next(count), a, c))

    def below(self, q: np.ndarray, d: Node, ids: np.ndarray, x: np.ndarray) -> None:
        """Searches a data node with the queries of a leaf that its ball does not rule out, the children of highest bound first."""
        if not d.children:
            near = _above(self.x[q] @ d.centre + d.radius * self.norms[q]) >= self.kth(q)
            if near.any():
                self.compare(q[near], d.rows, ids, x)
            return
        bounds = _above(self.x[q] @ d.centres.T + self.norms[q][:, None] * d.radii[None, :])
        for k in np.argsort(-bounds.max(axis=0), kind="stable"):
            near = bounds[:, k] >= self.kth(q)
            if near.any():
                self.below(q[near], d.children[k], ids, x)

    def compare(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(d), 2048):
            part = d[at : at + 2048]
            self.compared += len(q) * len(part)
            scores = self.x[q] @ x[part].T
            scores[self.ids[q][:, None] == ids[part][None, :]] = -np.inf
            hit = scores >= self.kth(q)[:, None]
            rows = np.flatnonzero(hit.any(axis=1))
            if len(rows):
                self.best[q[rows]] = np.partition(np.concatenate([self.best[q[rows]], scores[rows]], axis=1), -self.k, axis=1)[:, -self.k :]
                self.best[q[rows]] = np.sort(self.best[q[rows]], axis=1)
                i, j = np.nonzero(hit)
                self.found.append((q[i], ids[part[j]], scores[i, j]))
                self.held += len(i)
                if self.held > _FOUND:
                    self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of at most k rows a query, ties to smaller ids; keeps only those."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, ids, scores = (np.concatenate(c) for c in zip(*self.found, strict=True))
        good = scores >= self.kth(q)
        q, ids, scores = q[good], ids[good], scores[good]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < self.k
        self.found, self.held = [(q[top], ids[top], scores[top])], int(top.sum())
        return self.found[0]


def _above(bound):
    """A bound made safe against rounding."""
    return bound + 1e-9 * (1 + np.abs(bound))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 * x) of list<float> vectors, shorter ones with zeros behind, as whole float64 numbers."""
    flat = np.floor(64 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest inner product of each query, ties to the smaller id.

    Vectors are floor(64 * x) by component. Queries are the ids divisible by `every`; candidates all rows of another id. Ids or
    vectors that are null, and vectors with a null or non-finite component, take no part; shorter vectors count as filled up
    with zeros. An id with several rows asks once, with its first vector in array order; as candidates all rows count. With
    fewer than k candidates all are returned; an empty table gives no rows. Other columns are not read.

    The queries go in blocks of about query_block. With more than one, the blocks' hits are made one after another and appended
    to a written table, so that the driver and the executors hold one block at a time.
    """
    rows = usable(vectors)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = size["n"], int(size["width"] or 0)
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // query_block))
    share = F.lit(int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))
    start = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < share).select("vec_id", "vector").toArrow() if n else None
    spark, path = vectors.sparkSession, f"{scratch_dir(vectors.sparkSession)}/hits-{uuid.uuid4().hex}" if blocks > 1 else None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow().combine_chunks() if n else None
        ids = part["vec_id"].to_numpy() if n else np.empty(0, np.int64)
        search = Search(ids, _matrix(part["vector"].combine_chunks(), width) if n and len(ids) else np.empty((0, width)), k)
        if n and len(ids) and start.num_rows:
            sample = start.combine_chunks()
            search.add(sample["vec_id"].to_numpy(), _matrix(sample["vector"].combine_chunks(), width))
        shared = spark.sparkContext.broadcast((ids, search.x, search.kth(np.arange(len(ids)))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x, floor = shared.value
            search, held, rows = Search(ids, x, k, floor), [], 0

            def flush():
                if held:
                    search.add(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held.clear()

            for b in batches:
                if b.num_rows:
                    held.append((b["vec_id"].to_numpy(), _matrix(b["vector"], width)))
                    rows += b.num_rows
                    if rows >= DATA_BLOCK:
                        flush()
                        rows = 0
            flush()
            q, found, scores = search.result()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(found, pa.int64()), pa.array(scores.astype(np.int64), pa.int64())], names=["query_id", "vec_id", "score"])

        hits = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        if path:
            hits.write.mode("append").parquet(path)
            shared.destroy()
    if path:
        hits = spark.read.schema("query_id bigint, vec_id bigint, score bigint").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB SQL for top_k with k = 20 over the table embeddings.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
