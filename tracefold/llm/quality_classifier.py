"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Paths of a random forest over text statistics become conjunctive rules; lasso logistic regression keeps few of
them.  Statistics, rules and score are Spark columns, so scoring is one scan without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import SPACE, bounded, remainder, words
from tracefold.llm.trees import assembled, forest_paths
from tracefold.session import materialize

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
LASSO = 0.002
FEATURES = ["length", "mean_word", "distinct_words", "repeated_next", "symbol_share", "upper_share", "digit_share", "mark_share",
            "line_words", "repeated_lines"]


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The statistics of each text beside the columns ``keep`` as ``row``; null texts count as empty, with zero statistics."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), t.alias("t"))
    d = d.withColumn("w", words(F.col("t"), SPACE)).withColumn("lines", F.split("t", "\n"))
    count = lambda p: F.size(F.regexp_extract_all("t", F.lit(p), F.lit(0)))
    n, chars = F.size("w"), F.greatest(F.char_length("t"), F.lit(1))
    some, lines = F.greatest(n, F.lit(1)), F.size("lines")
    w = F.col("w")
    again = F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: w[i] == w[i - 1]))).otherwise(0)
    values = [F.log1p(n), F.char_length(F.array_join("w", "")) / some, F.size(F.array_distinct("w")) / some, again / some,
              count("[#*$%&|<>]") / chars, count("\\p{Lu}") / chars, count("[0-9]") / chars, count("[!?.,;:]") / chars,
              F.log1p(n / lines), (lines - F.size(F.array_distinct("lines"))) / lines]
    return d.select("row", *[v.cast("double").alias(c) for v, c in zip(values, FEATURES)])


def _holds(rule: tuple, f: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [f[i] <= t if less else f[i] > t for i, less, t in rule])


class RuleEnsemble:
    """``rules``: (path, weight) with weight not 0; ``intercept``."""

    def __init__(self, sample: DataFrame, label: str):
        found = {r["l"] for r in sample.select(F.col(label).cast("int").alias("l")).distinct().collect()}
        self.rules, self.intercept = [], {frozenset({1}): 9.0, frozenset({0}): -9.0}.get(frozenset(found), 0.0)
        if len(found) < 2:
            return
        found = forest_paths(sample, FEATURES, label)
        f = [F.col(c) for c in FEATURES]
        fired = sample.select(F.col(label).alias("__y"), *[_holds(r, f).cast("double").alias(f"r{i}") for i, r in enumerate(found)])
        data = materialize(assembled(fired, [f"r{i}" for i in range(len(found))], "__y"), "rules").coalesce(4)
        model = LogisticRegression(featuresCol="__features", labelCol="__label", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(data)
        self.rules = [(r, float(w)) for r, w in zip(found, model.coefficients.toArray()) if w]
        self.intercept = float(model.intercept)

    def column(self) -> Column:
        f = [F.col(c) for c in FEATURES]
        total = reduce(lambda a, b: a + b, [F.when(_holds(r, f), w).otherwise(0.0) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on labelled documents whose crc32(doc_id) modulo 4 is not 2, ``sample`` of them at most.

    Null labels and ids are not learned from; a label that a doc_id repeats counts as often.  With one kind of label
    (or none) the score is constant.
    """
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select(F.col("doc_id").alias("k"), F.col(label).alias("y"))
    known = bounded(known, F.col("k"), sample)
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("k")).select("text", "y")
    return RuleEnsemble(materialize(features(rows, ["y"]).select("row.y", *FEATURES), "quality").withColumnRenamed("y", "label"), "label")


def score(docs: DataFrame, model: RuleEnsemble, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the kept columns), the statistics, and score from 0 to 1.  Every row is scored, empty texts too."""
    return features(docs, keep, text).withColumn("score", model.column())
