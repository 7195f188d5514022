"""Exact top-k search by inner product with M-trees.

A vector x gets one more coordinate that lifts all to the length M of the longest; a query q gets 0 there. Then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest neighbours in a metric space and an
M-tree can search them. Each tree holds some thousand vectors in pages: a node has a pivot, a covering radius and its
distance to the parent's pivot; a leaf has its vectors' distances to the pivot. Search takes the most promising
page first; |d(q, parent) - stored distance| bounds the distance to a child or vector, and where the bound is already
worse than the k-th best score the distance is not computed. Scores are exact integers; bounds carry a slack above
their rounding error, so pruning never drops a tie.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitalframe.llm.common import stored

SCALE = 1024
TREE_ROWS = 4096  # vectors per tree, about
PAGE = 512  # vectors per leaf page, scored as one product
FANOUT = 16  # children per inner page
QUERY_BLOCK = 512  # queries that meet a tree together, about


def whole_vector(embedding: Column) -> Column:
    """floor(SCALE * x) of every component; null if the vector or a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


def _prepared(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_vector(F.col("embedding")).alias("v"))
    rows = rows.filter("vec_id is not null and v is not null and size(v) > 0")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    return rows.select("vec_id", F.size("v").alias("dim"), "v", norm.alias("norm"))


def build_tree(ids: np.ndarray, points: np.ndarray, longest: float) -> dict[str, np.ndarray]:
    """Pages of an M-tree over integer vectors; children of a node are neighbours in the node list."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    real = points.astype(float)
    lifted = np.concatenate([real, np.sqrt(np.maximum(longest - (real**2).sum(axis=1), 0))[:, None]], axis=1)

    def distance(rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((lifted[rows] - lifted[pivot]) ** 2).sum(axis=1))

    rows = np.arange(len(ids))
    nodes = [{"pivot": 0, "rows": rows, "parent": 0.0}]
    done, slots = 0, []
    while done < len(nodes):
        node = nodes[done]
        rows = node.pop("rows")
        own = distance(rows, node["pivot"])
        node["radius"] = own.max()
        if len(rows) <= PAGE:
            node |= {"leaf": 1, "first": sum(map(len, slots)), "count": len(rows)}
            slots.append(rows)
        else:
            pivots, near = [rows[own.argmax()]], None  # farthest-first pivots
            for _ in range(FANOUT):
                to = distance(rows, pivots[-1])
                near = to[None] if near is None else np.concatenate([near, to[None]])
                far = near.min(axis=0)
                if len(pivots) == FANOUT or far.max() == 0:
                    break
                pivots.append(rows[far.argmax()])
            home = near.argmin(axis=0)
            groups = [(p, rows[home == k]) for k, p in enumerate(pivots[: len(near)]) if (home == k).any()]
            if len(groups) == 1:  # equal vectors: any split is as good
                groups = [(part[0], part) for part in np.array_split(rows, FANOUT)]
            node |= {"leaf": 0, "first": len(nodes), "count": len(groups)}
            nodes += [{"pivot": p, "rows": part, "parent": float(distance(np.array([p]), node["pivot"])[0])} for p, part in groups]
        done += 1
    rows = np.concatenate(slots)
    table = {k: np.array([n[k] for n in nodes]) for k in ("pivot", "parent", "radius", "leaf", "first", "count")}
    to_pivot = np.empty(len(rows))
    for n in nodes:
        if n["leaf"]:
            part = slice(n["first"], n["first"] + n["count"])
            to_pivot[part] = distance(rows[part], n["pivot"])
    table["pivot"] = points[table["pivot"]]
    return table | {"ids": ids[rows], "points": points[rows], "to_pivot": to_pivot, "longest": np.array(longest)}


def ready(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A tree with its vectors as floating numbers too, and whether every product of two is exact in them."""
    tree["exact"] = float(tree["longest"]) < 2.0**52
    tree["real"] = tree["points"].astype(float)
    tree["pivot"] = tree["pivot"].astype(float)
    return tree


def search(tree: dict[str, np.ndarray], query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best vectors but those of id ``own``; ties go to smaller ids."""
    reach = float((query.astype(float) ** 2).sum() + tree["longest"])
    slack = 1e-9 * reach + 1e-3
    ids, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf

    real = query.astype(float)

    def best(lower: np.ndarray) -> np.ndarray:
        """The highest score at that distance or more."""
        return (reach - np.maximum(lower, 0) ** 2) / 2 + slack

    def to_pivots(nodes) -> np.ndarray:
        return np.sqrt(np.maximum(reach - 2.0 * (tree["pivot"][nodes] @ real), 0))

    start = float(to_pivots([0])[0])
    queue = [(-float(best(start - tree["radius"][0])), 0, start)]
    while queue:
        bound, node, to = heapq.heappop(queue)
        if -bound < least:
            break
        part = slice(tree["first"][node], tree["first"][node] + tree["count"][node])
        if tree["leaf"][node]:
            open_ = np.flatnonzero(best(np.abs(to - tree["to_pivot"][part]) - 1e-6) >= least) + part.start
            open_ = open_[tree["ids"][open_] != own]
            if len(open_):
                ids = np.concatenate([ids, tree["ids"][open_]])
                # whole numbers below 2**53: the floating product is exact
                scores = np.concatenate([scores, (tree["real"][open_] @ real).astype(np.int64) if tree["exact"] else tree["points"][open_] @ query])
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
                least = scores[-1] if len(ids) == k else -np.inf
        else:
            open_ = np.flatnonzero(best(np.abs(to - tree["parent"][part]) - tree["radius"][part] - 1e-6) >= least) + part.start
            if len(open_):
                away = to_pivots(open_)
                for child, bound, far in zip(open_.tolist(), best(away - tree["radius"][open_] - 1e-6).tolist(), away.tolist()):
                    if bound >= least:
                        heapq.heappush(queue, (-bound, child, far))
    return ids, scores


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def top_k(vectors: DataFrame, k: int = 10, step: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query, a row whose id ``step`` divides.

    Null ids, and vectors that are null, empty or hold a null or non-finite component take no part. Only vectors of
    equal length are compared. Of rows that repeat an id each is a candidate, and a query if its id is one; rows of the
    query's own id are never its candidates. Fewer than k
    candidates are all returned, none give no row; so does an empty table. Other columns are not read. Components of
    up to 2**20 keep all scores exact.
    """
    rows = stored(_prepared(vectors), "vectors")
    sizes = rows.groupBy("dim").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / TREE_ROWS)).cast("int").alias("trees"),
        F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("vec_id") % step == 0, 1)) / QUERY_BLOCK)).cast("int").alias("blocks"),
        F.max("norm").cast("double").alias("longest"),
    )
    sized = rows.join(sizes, "dim")  # one row per vector length

    def build(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # about TREE_ROWS rows
        ids = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
        tree = build_tree(ids, np.concatenate([_matrix(p.column("v")) for p in parts]), parts[0].column("longest")[0].as_py())
        pages = io.BytesIO()
        np.savez(pages, **tree)
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[0].as_py()], pa.int32()), pa.array([keys[1].as_py()], pa.int64()), pa.array([pages.getvalue()])],
            ["dim", "tree", "pages"],
        )

    slot = F.pmod(F.xxhash64("vec_id"), "trees")
    trees = (
        sized.select("dim", slot.alias("tree"), "vec_id", "v", "longest")
        .groupBy("dim", "tree")
        .applyInArrow(build, "dim int, tree long, pages binary")
    )
    trees = stored(trees, "trees")
    queries = (
        sized.filter(F.col("vec_id") % step == 0)
        .groupBy("dim", "trees", F.pmod(F.xxhash64(F.lit(1), "vec_id"), "blocks").alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))  # about QUERY_BLOCK vectors
    )
    met = queries.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees").cast("long") - 1))).join(trees, ["dim", "tree"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, block in zip(batch.column(0), batch.column(1)):
                with np.load(io.BytesIO(pages.as_py())) as file:
                    tree = ready({name: file[name] for name in file.files})
                block = block.values
                queries = _matrix(block.field("v"))
                out: list = [[], [], []]
                for query, own in zip(queries, block.field("vec_id").to_pylist()):
                    ids, scores = search(tree, query, own, k)
                    out[0].append(np.full(len(ids), own))
                    out[1].append(ids)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["query_id", "vec_id", "score"])

    # a block and a tree of a fixed size a row: batches of few rows stay small
    found = met.select("pages", "q").mapInArrow(look, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
