"""Fitted forests as node tables: rows that joins can score, on any engine.

A forest is three small tables: its nodes (one row each, a split or a leaf's class shares), the centring and scaling of
its features, and its class list. Scoring follows the trees level by level, one join per level, so a table of
any size is scored without a model object; the same joins can be written in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.models.learned import TrainedModel, usable
from vitalframe.sources.tables import cut_lineage, shared_folder, union_all

NODES = "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"
#: Trees of together up to so many nodes (some 100 bytes each) are broadcast at a time; one larger tree is joined by shuffle.
BROADCAST_NODES = 200_000


@dataclass
class ForestTables:
    """Nodes, scaling (feature, centre, factor) and classes (position, class as text) of a forest."""

    nodes: DataFrame
    scaling: DataFrame
    classes: DataFrame
    depth: int

    def write(self, path: str) -> None:
        for name in ("nodes", "scaling", "classes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "ForestTables":
        parts = [spark.read.parquet(f"{path}/{name}") for name in ("nodes", "scaling", "classes")]
        return ForestTables(*parts, depth=deepest(parts[0]))


def deepest(nodes: DataFrame) -> int:
    """Splits on the longest way down: nodes are numbered in preorder, so a node's right child has at most as
    many nodes before it as there are; the way is found level by level."""
    level = nodes.select("tree", F.lit(0).alias("node")).distinct()
    splits = nodes.filter("feature >= 0").select("tree", "node", F.explode(F.array("left", "right")).alias("child")).cache()
    depth = 0
    try:
        while True:
            level = level.join(splits, ["tree", "node"]).select("tree", F.col("child").alias("node"))
            if level.isEmpty():
                return depth
            depth += 1
    finally:
        splits.unpersist()


def forest_tables(model: TrainedModel) -> ForestTables:
    """The node table of a fitted forest, read from where Spark saves it.

    A leaf has feature -1, points at itself and holds its share of each class.
    """
    spark = SparkSession.active()
    path = shared_folder(spark)
    scaler, forest = model.model.stages
    forest.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID").cast("int").alias("tree")
    n = "nodeData."
    split, stats = f"{n}split.", F.col(f"{n}impurityStats")
    leaf = F.col(f"{n}leftChild") < 0
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    nodes = saved.select(
        tree,
        F.col(f"{n}id").alias("node"),
        F.when(leaf, F.lit(-1)).otherwise(F.col(f"{split}featureIndex")).alias("feature"),
        F.when(~leaf, F.get(F.col(f"{split}leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        F.when(leaf, F.col(f"{n}id")).otherwise(F.col(f"{n}leftChild")).alias("left"),
        F.when(leaf, F.col(f"{n}id")).otherwise(F.col(f"{n}rightChild")).alias("right"),
        F.when(leaf, F.transform(stats, lambda x: x / total)).alias("shares"),
    )
    mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    scaling = spark.createDataFrame([(i, m, 1.0 / s if s else 0.0) for i, (m, s) in enumerate(zip(mean, std))], "feature int, centre double, factor double")
    classes = spark.createDataFrame([(i, str(c)) for i, c in enumerate(model.classes)], "position int, class string")
    return ForestTables(nodes, scaling, classes, max((t.depth for t in forest.trees), default=0))


def _tree_groups(sizes: list[tuple[int, int]]) -> list[tuple[list[int], bool]]:
    """Trees that are followed together, and whether their nodes may be broadcast."""
    groups: list[tuple[list[int], int]] = []
    for tree, n in sizes:
        if groups and groups[-1][1] + n <= BROADCAST_NODES:
            groups[-1] = ([*groups[-1][0], tree], groups[-1][1] + n)
        else:
            groups.append(([tree], n))
    return [(trees, n <= BROADCAST_NODES) for trees, n in groups]


def _group_votes(tables: ForestTables, rows: DataFrame, keys: list[str], trees: list[int], small: bool, classes: int) -> DataFrame:
    """keys and, per class, the sum of the shares of the leaves that a row reaches in ``trees``."""
    nodes = tables.nodes.filter(F.col("tree").isin(trees)).withColumnsRenamed({"tree": "_tree", "node": "_node"})
    if small:
        nodes = F.broadcast(nodes)
    at = rows.select(*keys, "_x", F.explode(F.lit(trees)).alias("_tree"), F.lit(0).alias("_node"))
    for _ in range(tables.depth):
        step = at.join(nodes.select("_tree", "_node", "feature", "threshold", "left", "right"), ["_tree", "_node"])
        value = F.get("_x", F.greatest("feature", F.lit(0)))
        ahead = F.when(F.col("feature") < 0, F.col("_node")).when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = step.select(*keys, "_x", "_tree", ahead.alias("_node"))
    leaves = at.join(nodes.select("_tree", "_node", "shares"), ["_tree", "_node"])
    return leaves.groupBy(*keys).agg(*[F.sum(F.get("shares", F.lit(i))).alias(f"_v{i}") for i in range(classes)])


def score_forest(tables: ForestTables, rows: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """keys, prediction (as text) and probability, an array in class order, of every row.

    Each row goes down many trees at once, one join with the node table per level; a row's leaves meet in one
    aggregate that is combined where the row is. Where the trees are too large to travel at once, groups of them are followed one after the
    other, and only the sums of their leaves are written: rows are never shuffled from level to level.
    ``keys`` must tell rows apart. Rows that are not ``usable`` get nulls.
    """
    scaling = {r["feature"]: (r["centre"], r["factor"]) for r in tables.scaling.collect()}  # one row per feature
    classes = [r["class"] for r in tables.classes.orderBy("position").collect()]
    centres, factors = (F.array(*[F.lit(scaling[i][k]) for i in range(len(scaling))]) for k in (0, 1))
    scaled = F.zip_with(F.zip_with(F.col(features), centres, lambda x, m: x - m), factors, lambda x, f: x * f)
    sizes = [(r["tree"], r["count"]) for r in tables.nodes.groupBy("tree").count().orderBy("tree").collect()]  # one row per tree
    groups = _tree_groups(sizes)
    known = (cut_lineage(rows.select(*keys, features)) if len(groups) > 1 else rows).withColumn("_usable", usable(features))
    start = known.filter("_usable").select(*keys, scaled.alias("_x"))
    parts = [_group_votes(tables, start, keys, trees, small, len(classes)) for trees, small in groups]
    if len(parts) > 1:
        sums = [F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(classes))]
        votes = union_all(*[cut_lineage(p) for p in parts]).groupBy(*keys).agg(*sums)
    else:
        votes = parts[0]
    total = sum((F.col(f"_v{i}") for i in range(len(classes))), F.lit(0.0))
    probability = F.array(*[F.col(f"_v{i}") / total for i in range(len(classes))])
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    scored = votes.select(*keys, probability.alias("probability")).withColumn("prediction", F.get(F.lit(classes), best - 1))
    blank = known.filter(~F.col("_usable")).select(
        *keys, F.lit(None).cast("array<double>").alias("probability"), F.lit(None).cast("string").alias("prediction")
    )
    return scored.unionByName(blank).select(*keys, "prediction", "probability")


def forest_sql(nodes: str, scaling: str, classes: str, rows: str, key: str, features: str, depth: int) -> str:
    """The same scoring in SQL over tables of those names: key, prediction and one probability per class."""
    levels = [
        f"""at0 AS (SELECT {key}, x, tree, 0 AS node FROM (SELECT {key}, list(({features}[feature + 1] - centre) * factor ORDER BY feature) AS x
  FROM {rows}, {scaling} GROUP BY {key}), (SELECT DISTINCT tree FROM {nodes}))"""
    ]
    for k in range(depth):
        levels.append(
            f"""at{k + 1} AS (SELECT a.{key}, a.x, a.tree, CASE WHEN n.feature < 0 THEN a.node WHEN a.x[n.feature + 1] <= n.threshold THEN n."left" ELSE n."right" END AS node
  FROM at{k} a JOIN {nodes} n USING (tree, node))"""
        )
    return f"""WITH {", ".join(levels)},
votes AS (SELECT a.{key}, c.class, c.position, sum(n.shares[c.position + 1]) AS v FROM at{depth} a JOIN {nodes} n USING (tree, node), {classes} c GROUP BY ALL),
shares AS (SELECT {key}, class, position, v / sum(v) OVER (PARTITION BY {key}) AS p FROM votes)
SELECT {key}, arg_max(class, struct_pack(p := p, low := -position)) AS prediction, list(p ORDER BY position) AS probability FROM shares GROUP BY {key}"""


def agreement(model: TrainedModel, rows: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """One row: rows, rows that cannot be scored, and rows where the node table and Spark's own forest differ in
    prediction or by more than 1e-9 in a probability."""
    mine = score_forest(forest_tables(model), rows, keys, features)
    theirs = model.score(rows.select(*keys, features), features).select(
        *keys, F.col("prediction").cast("string").alias("_p"), F.col("probability").alias("_q")
    )
    far = F.exists(F.zip_with("probability", "_q", lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)
    differs = ~F.col("prediction").eqNullSafe(F.col("_p")) | F.coalesce(far, F.lit(False))
    return mine.join(theirs, keys).agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count_if(F.col("_p").isNull()).alias("rows_aside"), F.count_if(differs).alias("rows_differing")
    )
