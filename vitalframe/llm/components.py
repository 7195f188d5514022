"""Connected components of a link table: each task makes stars of its own links, alternating star contractions join these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import stored


#: Links that a task makes stars of at a time.
LINKS = 50_000


def star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): every node but the smallest of each component of the links, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        hung = root.copy()
        np.minimum.at(hung, root[a], low)
        np.minimum.at(hung, root[b], low)
        while not np.array_equal(hung, above := hung[hung]):
            hung = above
        if np.array_equal(hung, root):
            break
        root = hung
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _stars(edges: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that make the same components as ``edges``: stars of up to LINKS links of a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            u, v = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in star_edges(u, v)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= LINKS:
                yield joined()
        if held:
            yield joined()

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (u, v).

    First each task replaces its links by stars, which takes no shuffle; up to LINKS links are one star each after that.
    More are dealt to tasks of about LINKS links, and the stars of all tasks are joined in rounds. Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour. Both steps
    are one grouped minimum and one join on the node, so a node with very many links is reduced before the
    shuffle and split by the skew join; links never exceed their first number. Rounds grow as the logarithm
    of the longest path.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    edges = stored(_stars(edges), "links")
    tasks = -(-edges.count() // LINKS)
    edges = stored(_stars(edges.coalesce(max(1, tasks))), "stars")
    before = None
    while tasks > 1:
        # large star: larger neighbours move to the node's smallest neighbour (or the node itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stored(large, "large")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        near = large.join(low, "u")
        small = near.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        edges = stored(small.distinct(), "small")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
