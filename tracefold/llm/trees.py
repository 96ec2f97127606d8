"""Trees fitted by Spark ML on bounded samples, and their form as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+)")


def parse(model) -> list:
    """Each tree as a leaf value or (feature, threshold, left, right)."""
    trees = []
    for part in re.split(r"\n\s*Tree \d+ .*\n", model.toDebugString)[1:]:
        tokens = iter([m.groups() for m in map(_NODE.search, part.split("\n")) if m])
        trees.append(_node(tokens))
    return trees


def _node(tokens):
    kind, feature, _, threshold, leaf = next(tokens)
    if leaf is not None:
        return float(leaf)
    left = _node(tokens)
    next(tokens)  # its Else
    return int(feature), float(threshold), left, _node(tokens)


def as_column(node, features: list[Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(features[feature] <= threshold, as_column(left, features)).otherwise(as_column(right, features))


def paths(node, held: tuple = ()) -> list[tuple]:
    """Every inner or leaf path from the root as a tuple of (feature, is it at most, threshold)."""
    if isinstance(node, float):
        return [held] if held else []
    feature, threshold, left, right = node
    return ([held] if held else []) + paths(left, (*held, (feature, True, threshold))) + paths(right, (*held, (feature, False, threshold)))


def assembled(sample: DataFrame, features: list[str], label: str, weight: str | None = None) -> DataFrame:
    v = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    return v.transform(sample.select(*features, F.col(label).cast("double").alias("__label"), *([weight] if weight else [])))


class Boosted:
    """Gradient boosted trees as one column: the chance of label 1.  ``weight`` names how many rows a row stands for."""

    def __init__(self, sample: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4, weight: str | None = None):
        found = {r["l"] for r in sample.select(F.col(label).cast("int").alias("l")).distinct().collect()}
        if len(found) < 2:  # nothing to tell apart
            self.trees, self.weights, self.only = [], [], float(found == {1})
            return
        trees = GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7,
                              maxBins=64, minInstancesPerNode=1 if weight else 5)
        model = (trees.setWeightCol(weight) if weight else trees).fit(assembled(sample, features, label, weight))
        self.trees, self.weights, self.only = parse(model), list(model.treeWeights), None

    def column(self, features: list[Column]) -> Column:
        if self.only is not None:
            return F.lit(self.only)
        total = reduce(lambda a, b: a + b, [as_column(t, features) * w for t, w in zip(self.trees, self.weights)])
        return 1 / (1 + F.exp(-2 * total))


def forest_paths(sample: DataFrame, features: list[str], label: str, trees: int = 24, depth: int = 3) -> list[tuple]:
    """Distinct conjunctive paths of a random forest's trees."""
    model = RandomForestClassifier(featuresCol="__features", labelCol="__label", numTrees=trees, maxDepth=depth, seed=7, maxBins=64,
                                   minInstancesPerNode=10, subsamplingRate=0.5).fit(assembled(sample, features, label))
    return sorted({p for t in parse(model) for p in paths(t)})
