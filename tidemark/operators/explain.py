"""Shapley attributions for tree ensembles and for any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import scratch_path
from .filters import seeded_sample
from .models import BoostedRegressor

@dataclass
class LeafPath:
    """A leaf seen from the root: its weighted value and, per feature, interval and cover share."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray


def tree_nodes(model) -> pd.DataFrame:
    """Node table of a fitted tree ensemble, read from its saved form.

    Columns: tree, id, prediction, cover, left, right, feature, cut, weight. The size of a model is set by its
    parameters (trees and depth), not by the data.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.rawCount").cast("double").alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
    )
    pdf = nodes.toPandas()
    weights = np.asarray(model.treeWeights, dtype=float)
    if type(model).__name__.startswith("RandomForest"):
        weights = weights / weights.sum()
    return pdf.assign(weight=weights[pdf["tree"].to_numpy()])


@dataclass
class FlatTree:
    """A tree as arrays, node after node: what a task needs to walk it."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def leaves(self) -> Iterator[LeafPath]:
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            at, seen = stack.pop()
            if self.left[at] < 0:
                feats = sorted(seen)
                cells = np.array([seen[f] for f in feats], dtype=float).reshape(len(feats), 3)
                yield LeafPath(float(self.value[at]), np.array(feats, dtype=int), *cells.T)
                continue
            f = int(self.feature[at])
            low, high, cover = seen.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((self.left[at], (low, min(high, self.cut[at]))), (self.right[at], (max(low, self.cut[at]), high))):
                share = cover * self.cover[child] / self.cover[at]
                stack.append((int(child), {**seen, f: (*bounds, share)}))


def flat_trees(nodes: pd.DataFrame) -> list[FlatTree]:
    """The node table as arrays per tree, in the order of node ids."""
    out = []
    for _, tree in nodes.sort_values(["tree", "id"]).groupby("tree"):
        ids = tree["id"].to_numpy()

        def at(children: pd.Series, ids: np.ndarray = ids) -> np.ndarray:
            c = children.to_numpy()
            return np.where(c < 0, -1, np.searchsorted(ids, c)).astype(np.int32)

        value = (tree["prediction"] * tree["weight"]).to_numpy(float)
        columns = (tree["feature"].to_numpy(np.int32), tree["cut"].to_numpy(float), tree["cover"].to_numpy(float), value)
        out.append(FlatTree(at(tree["left"]), at(tree["right"]), *columns))
    return out


@dataclass
class LeafGroup:
    """All leaves of a tree with equally many features on their paths: one row a leaf, one column a feature."""

    value: np.ndarray
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray


def leaf_groups(tree: FlatTree) -> list[LeafGroup]:
    by_length: dict[int, list[LeafPath]] = {}
    for leaf in tree.leaves():
        if len(leaf.features):
            by_length.setdefault(len(leaf.features), []).append(leaf)
    return [
        LeafGroup(np.array([leaf.value for leaf in leaves]), *(np.stack([getattr(leaf, c) for leaf in leaves]) for c in ("features", "low", "high", "cover")))
        for leaves in by_length.values()
    ]


def group_attribution(group: LeafGroup, x: np.ndarray) -> np.ndarray:
    """Shapley values of a group's leaves for a batch of rows.

    A row's path weights say, for each coalition size, which share of the orderings reaches the leaf. Features extend the path
    one by one; unwinding one of them gives what the path would weigh without it. That is d * d steps for d features,
    each over all rows and leaves of the group.
    """
    d = group.features.shape[1]
    goes = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high in zip(group.features.T, group.low.T, group.high.T)]
    weight = np.zeros((d + 1, len(x), len(group.value)))
    weight[0] = 1.0
    for m in range(1, d + 1):
        one, share = goes[m - 1], group.cover[:, m - 1]
        for i in range(m - 1, -1, -1):
            weight[i + 1] += one * weight[i] * ((i + 1) / (m + 1))
            weight[i] *= share * ((m - i) / (m + 1))
    phi = np.zeros_like(x)
    for i in range(d):
        one, share = goes[i], group.cover[:, i]
        total = np.zeros_like(one)
        rest = weight[d].copy()
        for j in range(d - 1, -1, -1):
            taken = rest * ((d + 1) / (j + 1))
            total += np.where(one > 0, taken, weight[j] / (share * ((d - j) / (d + 1))))
            rest = weight[j] - taken * share * ((d - j) / (d + 1))
        earned = total * (one - share) * group.value
        features, of = np.unique(group.features[:, i], return_inverse=True)
        phi[:, features] += earned @ np.eye(len(features))[of]
    return phi


# Numbers that one step of an attribution holds.
CELLS = 2_000_000


def tree_attributions(trees: Sequence[list[LeafGroup]], x: np.ndarray) -> np.ndarray:
    phi = np.zeros_like(x)
    for groups in trees:
        for group in groups:
            step = max(1, CELLS // (group.features.shape[0] * (group.features.shape[1] + 1)))
            for a in range(0, len(x), step):
                phi[a : a + step] += group_attribution(group, x[a : a + step])
    return phi


def explain_trees(
    model: PipelineModel | BoostedRegressor, rows: DataFrame, features: Sequence[str], *, ids: Sequence[str] = ("ts",), tree_parts: int = 4
) -> DataFrame:
    """Path-dependent tree Shapley values (Lundberg et al. 2018): ``ids``, ``base``, ``phi`` array.

    ``base`` plus the values of a row is the model's prediction for it. Work is split by rows and by ``tree_parts`` parts of the
    trees, whose sums are added by ``ids``, which name a row. Null features go left at every split.
    """
    if isinstance(model, BoostedRegressor):
        trees = [FlatTree(t.left, t.right, t.feature, t.cut, t.cover, t.value[:, 0]) for t in model.model.trees]
        start = float(model.model.start[0])
    else:
        trees, start = flat_trees(tree_nodes(model.stages[-1])), 0.0
    # the mean prediction over the training rows: leaves weighted by cover
    base = start + float(sum((t.value * t.cover)[t.left < 0].sum() / t.cover[0] for t in trees))
    spark = rows.sparkSession
    context = spark.sparkContext
    shared = context.broadcast([leaf_groups(t) for t in trees])  # paths are built once; parameters bound their number
    parts = max(1, min(tree_parts, len(trees)))
    width = len(features)

    @F.pandas_udf("array<double>")
    def attribute(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for part, pdf in batches:
            x = pdf.to_numpy(float)
            x = np.where(np.isnan(x), -1.7e308, x)
            phi = np.zeros((len(x), width))
            for k in part.unique():
                at = (part == k).to_numpy()
                phi[at] = tree_attributions(shared.value[k::parts], x[at])
            yield pd.Series(list(phi))

    tasks = max(context.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vector = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    dealt = rows.select(*ids, vector.alias("__x"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part")).repartition(tasks)
    told = dealt.select(*ids, attribute("__part", "__x").alias("__phi"))
    sums = F.array(*[F.sum(F.col("__phi")[i]) for i in range(width)])
    return told.groupBy(*ids).agg(sums.alias("phi")).select(*ids, F.lit(base).alias("base"), "phi")


def long_attributions(attributions: DataFrame, features: Sequence[str], *, ids: Sequence[str] = ("ts",)) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    return attributions.select(*ids, F.posexplode("phi").alias("pos", "phi")).select(
        *ids, F.element_at(names, F.col("pos") + 1).alias("feature"), "phi"
    )


def explain_any(
    predict: Callable[[DataFrame], DataFrame],
    rows: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    *,
    ids: Sequence[str] = ("ts",),
    background_size: int = 50,
    coalitions: int = 98,
    seed: int = 42,
) -> DataFrame:
    """Kernel Shapley values of any model (Lundberg and Lee 2017): ``ids``, ``feature``, ``phi``.

    ``predict`` adds ``predicted`` to a table with the feature columns. A table of at most ``coalitions`` distinct feature subsets is drawn
    once: sizes 1 and p - 1 whole, then 2 and p - 2, and so on while they fit, the next sizes by a seeded sample, each subset
    with its complement. Each row is scored once for a subset and a background row (features outside the subset come from the
    background), which makes ``coalitions`` * ``background_size`` predictions a row at most. A row's values solve the weighted least-squares problem whose
    matrix is the same for all rows: it is solved once, and a row's values are a product with its subset means. Values add up
    to the prediction less the mean over the background. They are exact if all subsets fit, and for linear models. The
    background is a sample of fixed size and travels as an array constant. ``ids`` name a row.
    """
    p = len(features)
    sample = seeded_sample(background.select(*features).distinct(), background_size, ids=features, seed=seed).toPandas()
    subsets, weights = coalition_table(p, coalitions, seed)
    solve = coalition_solver(subsets, weights)  # (p, subsets): values from the subsets' means, less what adds up is forced to
    masks = F.array(*[F.array(*[F.lit(bool(k)) for k in s]) for s in [np.zeros(p, bool), np.ones(p, bool), *subsets]])
    back = F.array(*[F.struct(*[F.lit(float(v)).alias(f"b{i}") for i, v in enumerate(r)]) for r in sample.to_numpy(float)])
    steps = rows.select(*ids, *features).select("*", F.posexplode(masks).alias("__s", "__mask")).withColumn("__b", F.explode(back))
    mixed = [
        F.when(F.col("__mask")[i], F.col(f).cast("double")).otherwise(F.col("__b")[f"b{i}"]).alias(f) for i, f in enumerate(features)
    ]
    scored = predict(steps.select(*ids, "__s", *mixed))
    means = scored.groupBy(*ids, "__s").agg(F.avg("predicted").alias("m"))
    packed = means.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("__s", "m"))).alias("m"))  # one entry a subset
    shared = rows.sparkSession.sparkContext.broadcast((solve, subsets))

    @F.pandas_udf("array<double>")
    def values(m: pd.Series) -> pd.Series:
        if not len(m):
            return pd.Series([], dtype=object)
        matrix, sets = shared.value
        told = np.stack(m.to_numpy()).astype(float)
        empty, whole, rest = told[:, :1], told[:, 1:2], told[:, 2:]
        gap = whole - empty
        share = sets.mean(axis=1) if len(sets) else np.zeros(0)
        return pd.Series(list(gap / p + (rest - empty - gap * share) @ matrix.T))

    phi = packed.select(*ids, values(F.transform("m", lambda s: s["m"])).alias("phi"))
    return long_attributions(phi, features, ids=ids)


def coalition_table(p: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subsets of p features, neither empty nor whole, as rows of booleans, and their Shapley kernel weights."""
    chosen: list[tuple[int, ...]] = []
    weights: list[float] = []
    rng = np.random.default_rng(seed)
    for size in range(1, p // 2 + 1):
        sizes = {size, p - size}
        mass = sum((p - 1) / (s * (p - s)) for s in sizes)  # of all subsets of these sizes
        count = len(sizes) * comb(p, size)
        if len(chosen) + count <= most:
            found = [c for s in sizes for c in combinations(range(p), s)]
        else:
            halves: set[tuple[int, ...]] = set()
            room = (most - len(chosen)) // 2
            for _ in range(4 * room):
                if len(halves) == room:
                    break
                halves.add(tuple(sorted(rng.choice(p, size, replace=False).tolist())))
            found = sorted(halves | {tuple(sorted(set(range(p)) - set(h))) for h in halves})
        chosen += found
        weights += [mass / len(found)] * len(found)
        if len(chosen) + 2 > most:
            break
    table = np.zeros((len(chosen), p), bool)
    for row, subset in enumerate(chosen):
        table[row, list(subset)] = True
    return table, np.array(weights)


def coalition_solver(subsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix from subset means (less what equal shares explain) to values that add up to nothing."""
    p = subsets.shape[1]
    centred = subsets - subsets.mean(axis=1, keepdims=True)  # values that add up to 0 don't see the mean
    root = np.sqrt(weights)[:, None]
    return (np.linalg.pinv(root * centred) * root.T) if len(subsets) else np.zeros((p, 0))


def importance(long: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_shap")).orderBy(F.col("mean_shap").desc(), "feature")


def explain_model(
    model: PipelineModel, test: DataFrame, features: Sequence[str], *, ids: Sequence[str] = ("ts",), sample_size: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Importance table and long attributions of the test rows, or of a seeded sample of them if a size is given."""
    sample = test if sample_size is None else seeded_sample(test, sample_size, ids=ids)
    long = long_attributions(explain_trees(model, sample, features, ids=ids), features, ids=ids)
    return importance(long), long
