"""Regression trees that split between any two values, for series panels of any size.

MLlib's trees choose between a fixed number of quantiles and keep a dense table of them for every node of a level. Here
it only makes the top of the trees, as far down as is needed for a leaf to hold a bounded number of different points; what
lies below grows inside one task a leaf, between all values. A table with few points needs no top at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count as counted

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from bizmetrics.session import cut_lineage

#: Different points (features and label) of a leaf that one task takes, some 10 MB of them.
LEAF_POINTS = 50_000
#: Bins per feature in the top, its greatest depth, and the levels added while a leaf holds too many points.
TOP_BINS, TOP_DEPTH, DEEPER = 128, 30, 5

#: Rows (points times trees) that are worth a task of their own.
TASK_ROWS = 20_000
GROWN = ("tree int, leaf int, feature array<int>, cut array<double>, child array<int>, value array<double>, "
         "gains array<double>, spread double")


# These functions are built where they are used, so that Spark sends them to the executors whole.
def _grower(seed: int, sampled: bool, depth: int | None) -> Callable:
    def grow(points: pa.Table) -> pa.Table:
        """The tree of one leaf's points, a level at a time: nodes are numbered level by level, the right child
        follows the left, and -1 stands for the feature of a leaf."""
        tree, leaf = points["tree"][0].as_py(), points["leaf"][0].as_py()
        y, n = points["label"].to_numpy(), points["n"].to_numpy()
        x = points["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        order = np.lexsort((y, *x.T))  # the draw depends on the points alone
        x, y, n = x[order], y[order], n[order]
        w = np.random.default_rng([seed, tree, leaf]).poisson(n) if sampled else n
        w = (w if w.any() else n).astype(float)
        x, y, w = x[w > 0], y[w > 0], w[w > 0]
        centre = np.average(y, weights=w)
        y = y - centre
        spread = float((w * y * y).sum())
        node, made, columns, gains = np.zeros(len(y), int), 1, x.shape[1], np.zeros(x.shape[1])
        levels = []
        for level in counted():
            count = node.max() + 1
            weight, total = np.bincount(node, w, count), np.bincount(node, w * y, count)
            low, high = np.full(count, np.inf), np.full(count, -np.inf)
            np.minimum.at(low, node, y)
            np.maximum.at(high, node, y)
            best, feature, cut = np.full(count, -np.inf), np.full(count, -1), np.zeros(count)
            for f in range(columns):
                by = np.lexsort((x[:, f], node))
                xs, ns, ws = x[by, f], node[by], w[by]
                first = np.searchsorted(ns, np.arange(count))
                left_w, left_y = np.cumsum(ws), np.cumsum(ws * y[by])
                left_w, left_y = left_w - np.r_[0, left_w][first][ns], left_y - np.r_[0, left_y][first][ns]
                i = np.nonzero((ns[1:] == ns[:-1]) & (xs[1:] > xs[:-1]))[0]
                of = ns[i]
                gain = (left_y[i] ** 2 / left_w[i] + (total[of] - left_y[i]) ** 2 / (weight[of] - left_w[i])
                        - total[of] ** 2 / weight[of])
                ranked = np.lexsort((-gain, of))
                nodes, at = np.unique(of[ranked], return_index=True)
                better = gain[ranked[at]] > best[nodes]
                nodes, j = nodes[better], ranked[at][better]
                best[nodes], feature[nodes] = gain[j], f
                lower, upper = xs[i[j]], xs[i[j] + 1]
                middle = lower + (upper - lower) / 2
                cut[nodes] = np.where(middle < upper, middle, lower)
            splits = (high > low) & (feature >= 0) & (depth is None or level < depth)
            rank = np.cumsum(splits) - 1
            feature = np.where(splits, feature, -1)
            levels.append((feature, cut, np.where(splits, made + 2 * rank, -1), total / weight + centre))
            if not splits.any():
                break
            gains += np.bincount(feature[splits], np.maximum(best[splits], 0), columns)
            made += 2 * int(splits.sum())
            stays = splits[node]
            x, y, w, node = x[stays], y[stays], w[stays], node[stays]
            node = 2 * rank[node] + (x[np.arange(len(node)), feature[node]] > cut[node])
        feature, cut, child, value = (np.concatenate(parts) for parts in zip(*levels))
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "leaf": pa.array([leaf], pa.int32()),
            "feature": pa.array([feature], pa.list_(pa.int32())), "cut": pa.array([cut], pa.list_(pa.float64())),
            "child": pa.array([child], pa.list_(pa.int32())), "value": pa.array([value], pa.list_(pa.float64())),
            "gains": pa.array([gains], pa.list_(pa.float64())), "spread": pa.array([spread], pa.float64())})

    return grow


def _reach() -> Callable:
    def reached(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The value of the leaf that each point ends in."""
        at, every = np.zeros(len(x), int), np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            at = np.where(inner, child[at] + (x[every, np.maximum(feature[at], 0)] > cut[at]), at)
        return value[at]

    return reached


def _walker() -> Callable:
    reached, nodes = _reach(), ("feature", "cut", "child", "value")

    def walk(points: pa.Table, grown: pa.Table) -> pa.Table:
        """What one tree answers for its points."""
        if points.num_rows and grown.num_rows:
            x = points["x"].combine_chunks().flatten().to_numpy().reshape(points.num_rows, -1)
            found = reached(x, *(np.array(grown[c][0].as_py()) for c in nodes))
        else:
            points, found = points.slice(0, 0), np.zeros(0)
        return pa.table({"x": points["x"].cast(pa.list_(pa.float64())), "tree": points["tree"], "predicted": pa.array(found, pa.float64())})

    return walk


def _placed(points: DataFrame, top: Model | None, trees: int) -> DataFrame:
    """Every point once a tree, with the leaf of the tree's top that it belongs to."""
    columns = points.columns
    if top is None:
        return points.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("leaf"))
    leaves = top.transform(points.withColumn("features", array_to_vector("x")))
    return leaves.select(*columns, F.posexplode(vector_to_array("leaves")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))


@dataclass(frozen=True)
class Forest:
    """A fitted forest. ``transform`` adds ``predicted`` to rows with ``features``."""
    top: Model | None
    grown: DataFrame  # one row per tree and leaf of its top
    trees: int
    leaf_points: int

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean of the trees' answers. Equal features are answered once; of a leaf's points, each
        task gets at most about ``leaf_points``. An empty frame stays empty."""
        keyed = df.withColumn("_x", vector_to_array("features"))
        placed = _placed(keyed.select(F.col("_x").alias("x")).distinct(), self.top, self.trees)
        pieces = placed.groupBy("tree", "leaf").agg((F.floor(F.count(F.lit(1)) / self.leaf_points) + 1).cast("int").alias("pieces"))
        points = placed.join(pieces, ["tree", "leaf"]).select(
            "x", "tree", "leaf", F.pmod(F.xxhash64("x"), F.col("pieces")).cast("int").alias("piece"))
        grown = self.grown.join(pieces, ["tree", "leaf"]).select(
            "tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "feature", "cut", "child", "value")
        group = ["tree", "leaf", "piece"]
        answers = points.groupBy(*group).cogroup(grown.groupBy(*group)).applyInArrow(
            _walker(), "x array<double>, tree int, predicted double")
        # As many answers a point as there are trees, added up in their order: the same sum every time.
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("tree", "predicted"))), lambda a: a["predicted"])
        means = answers.groupBy(F.col("x").alias("_x")).agg(
            (F.aggregate(in_order, F.lit(0.0), lambda a, b: a + b) / self.trees).alias("predicted"))
        return keyed.join(means, "_x", "left").drop("_x")

    def predict(self, features: Vector) -> float:
        """The answer for one vector."""
        return self.transform(self.grown.sparkSession.createDataFrame([(features,)], ["features"])).first()["predicted"]

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of the squared error that the splits took away; without splits all are 0."""
        per_feature = self.grown.select("spread", F.posexplode("gains").alias("f", "gain")).groupBy("f").agg(
            F.sum("gain").alias("gain"), F.sum("spread").alias("spread")).orderBy("f").collect()  # one row per feature
        gains = [r["gain"] for r in per_feature]
        if self.top is not None:
            # What the tops left to their leaves against what there was before any split.
            before = self.top.spread * self.trees
            gains = [g + max(before - per_feature[0]["spread"], 0.0) * s
                     for g, s in zip(gains, self.top.featureImportances.toArray())]
        return DenseVector([g / (sum(gains) or 1.0) for g in gains])


def fit_forest(train: DataFrame, trees: int, depth: int | None, seed: int, sampled: bool, leaf_points: int = LEAF_POINTS) -> Forest:
    """Trees over ``features`` and ``label``, all features at every split, grown until a leaf holds one label or one point,
    or for ``depth`` levels (below their tops, where there are any). With ``sampled``, each tree weighs every row by its own Poisson draw of mean 1.

    Equal rows are one point with their number. ``leaf_points`` bounds what a task gets: beyond it MLlib grows the tops,
    deeper as long as a leaf holds more; one that still does at depth 30 answers its mean. An empty table is an error, as
    for MLlib's models.
    """
    points = cut_lineage(train.groupBy(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
                         .agg(F.count(F.lit(1)).alias("n")))
    n_points, spread = points.agg(F.count(F.lit(1)), F.sum("n") * F.var_pop("label")).first()
    if not n_points:
        raise ValueError("no rows to fit")
    top, levels = None, math.ceil(math.log2(max(n_points / leaf_points, 1)))
    placed, whole = _placed(points, None, trees), None
    while n_points > leaf_points and levels < TOP_DEPTH:
        levels = min(levels + DEEPER, TOP_DEPTH)
        top = RandomForestRegressor(
            numTrees=trees, maxDepth=levels, maxBins=TOP_BINS, seed=seed, featureSubsetStrategy="all", bootstrap=sampled,
            weightCol="n", leafCol="leaves", maxMemoryInMB=1024).fit(points.withColumn("features", array_to_vector("x")))
        top.spread = spread or 0.0
        placed = _placed(points, top, trees)
        whole = cut_lineage(placed.groupBy("tree", "leaf").agg(
            F.count(F.lit(1)).alias("points"), (F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("mean"),
            F.first(F.size("x")).alias("columns")))
        if whole.agg(F.max("points")).first()[0] <= leaf_points:
            whole = None
            break
    if whole is not None:  # leaves of points that no bin tells apart
        whole = whole.where(F.col("points") > leaf_points)
        placed = placed.join(whole.select("tree", "leaf"), ["tree", "leaf"], "left_anti")
    # Little data, much work: the number of tasks is said, since merging them by their bytes would leave one.
    slots, rows = train.sparkSession.sparkContext.defaultParallelism, n_points * trees
    tasks = max(min(trees, slots, 1 + rows // TASK_ROWS), rows // (20 * leaf_points))
    grown = placed.select("tree", "leaf", "x", "label", "n").repartition(tasks, "tree", "leaf").groupBy("tree", "leaf").applyInArrow(
        _grower(seed, sampled, depth), GROWN)
    if whole is not None:
        grown = grown.unionByName(whole.selectExpr(
            "tree", "leaf", "array(-1) AS feature", "array(0D) AS cut", "array(-1) AS child", "array(mean) AS value",
            "array_repeat(0D, columns) AS gains", "0D AS spread"))
    return Forest(top, cut_lineage(grown), trees, leaf_points)
