"""Nearest neighbours by inner product with vantage-point trees.

Inner products become distances: with M the largest norm, x gets one more
component sqrt(M^2 - |x|^2) and a query gets 0; the nearest of those vectors is
the one with the largest product. Equal vectors are one point with its smallest
ids, so copies cannot fill a shard or a result. Points are dealt by a hash into
shards of about ``shard_rows``; each shard is one tree. A node splits its
points at the median distance to its vantage point, and the triangle inequality
tells which side may still hold one of the k best. ``factor`` divides the
search radius in that test: 1 is exact, more prunes more and may miss some.

Queries pass through every shard in batches, and searches of a batch go down
the tree together. A task holds one shard and one batch. Partial results, k + 1
points for each query and shard, are merged by a ranking that is limited before
the shuffle. Products of the original vectors are summed in double precision,
always in the same order, so equal vectors have equal scores.

Rows with a null id or vector, null or non-finite components or only zeros take
no part. Of rows that share an id, the smallest vector counts. Vectors meet
only vectors of their own length. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.llm.common import cut

_LEAF = 128


class Tree:
    """One shard. points: (n, d) as given; ids: the smallest id of each point."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, top: float) -> None:
        self.points, self.ids, self.top = points, ids, top
        lift = np.sqrt(np.maximum(top - np.einsum("nd,nd->n", points, points), 0))
        self.lifted = np.column_stack([points, lift])
        self.slack = 1e-7 * max(np.sqrt(top), 1e-300)  # rounding of distances never prunes
        self.root = self._node(np.arange(len(points)))

    def _node(self, members: np.ndarray):
        if len(members) <= _LEAF:
            return members
        vantage = members[0]
        gap = self.lifted[members] - self.lifted[vantage]
        d = np.sqrt(np.einsum("nd,nd->n", gap, gap))
        order = np.argsort(d, kind="stable")
        half = len(members) // 2
        return vantage, d[order[half]], self._node(members[order[:half]]), self._node(members[order[half:]])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores (best first, -inf where there are fewer) and point numbers for each query."""
        self.q = queries
        self.q_lifted = np.column_stack([queries, np.zeros(len(queries))])
        self.norms = np.einsum("nd,nd->n", queries, queries)
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1)
        self.factor = factor
        self.visited = 0
        self._visit(self.root, np.arange(len(queries)))
        return self.score, self.found

    def _radius(self, who: np.ndarray) -> np.ndarray:
        worst = self.score[who, -1]
        with np.errstate(invalid="ignore"):
            d = np.sqrt(np.maximum(self.norms[who] + self.top - 2 * worst, 0)) / self.factor + self.slack
        return np.where(np.isinf(worst), np.inf, d)

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(who), 2048):
                self._leaf(node, who[at : at + 2048])
            return
        vantage, middle, inner, outer = node
        gap = self.q_lifted[who] - self.lifted[vantage]
        d = np.sqrt(np.einsum("nd,nd->n", gap, gap))
        inside = d < middle
        self._visit(inner, who[inside])
        self._visit(outer, who[~inside])
        late = self._radius(who)
        self._visit(outer, who[inside & (middle - d <= late)])
        self._visit(inner, who[~inside & (d - middle <= late)])

    def _leaf(self, members: np.ndarray, who: np.ndarray) -> None:
        k = self.score.shape[1]
        self.visited += len(members) * len(who)
        score = np.einsum("qd,nd->qn", self.q[who], self.points[members])
        row, col = np.nonzero(score >= self.score[who, -1][:, None])
        new = np.unique(row)
        if not len(new):
            return
        old_row, old_col = np.nonzero(self.found[who[new]] >= 0)
        rows = np.concatenate([row, new[old_row]])
        point = np.concatenate([members[col], self.found[who[new]][old_row, old_col]])
        value = np.concatenate([score[row, col], self.score[who[new]][old_row, old_col]])
        order = np.lexsort((self.ids[point], -value, rows))
        rows, point, value = rows[order], point[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        keep = place < k
        self.score[who[rows[keep]], place[keep]] = value[keep]
        self.found[who[rows[keep]], place[keep]] = point[keep]


def valid(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids. rows: (id, v). Copies are thinned by salt before they meet."""
    salted = Window.partitionBy("v", "salt").orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = few.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _searcher(k: int, factor: float, top: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, its points before its queries."""
        now, parts, tree = None, [], None
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            query = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (query[1:] != query[:-1])) + 1 if len(shard) else []
            for a, b in zip([0, *edges], [*edges, len(shard)]):
                if a == b:
                    continue
                if shard[a] != now:
                    now, parts, tree = shard[a], [], None
                own = batch.slice(a, b - a)
                if not query[a]:
                    parts.append(own)
                    continue
                if tree is None:
                    if not parts:
                        continue
                    ids = [i for p in parts for i in p.column("ids").to_pylist()]
                    low = np.array([i[0] for i in ids], np.int64)
                    tree = Tree(np.concatenate([_matrix(p.column("v")) for p in parts]), low, top)
                    parts = []
                score, found = tree.search(_matrix(own.column("v")), k + 1, factor)
                row, col = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.column("id").to_numpy(zero_copy_only=False)[row]),
                        pa.array([ids[p] for p in found[row, col]], pa.list_(pa.int64())),
                        pa.array(score[row, col]),
                    ],
                    names=["query_id", "ids", "score"],
                )

    return search


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    factor: float = 1.0,
    shard_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row that ``is_query`` marks."""
    own = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    own = own.where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = cut(own.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    index = cut(points(rows.select("id", "v"), k))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = index.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"))
    shards = stats.select("d", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), "m")
    top = shards.agg(F.max("m")).first()[0] or 0.0
    placed = index.join(shards, F.size("v") == F.col("d")).select(
        F.concat_ws("/", "d", F.pmod(F.xxhash64("v"), F.col("shards"))).alias("shard"), F.lit(False).alias("is_query"), F.lit(None).cast("bigint").alias("id"), "v", "ids"
    )
    asked = rows.where("q").join(shards, F.size("v") == F.col("d"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"), "d", "id", "v").select(
        F.concat_ws("/", "d", "s").alias("shard"), F.lit(True).alias("is_query"), "id", "v", F.lit(None).cast("array<bigint>").alias("ids")
    )
    dealt = placed.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "is_query")
    found = dealt.mapInArrow(_searcher(k, factor, float(top)), "query_id bigint, ids array<bigint>, score double")
    every = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
