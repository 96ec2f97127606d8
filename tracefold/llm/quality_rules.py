"""Quality rules: base limits, then robust multivariate outliers by language and source, with DataFrame functions only.

Statistics are transformed and quantised to small whole numbers, so sums, medians and thresholds are exact and
the same in any order.  Per group, an estimate with minimum covariance determinant: start from median and MAD,
then concentration steps on the three quarters of least distance, then one reweighted step.  A small group is judged
by the estimate of its language, a small language by that of the whole table, so every row gets a distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import SPACE, words
from tracefold.session import materialize

#: Transformed statistics: name, steps a unit, least spread in units (rare values of a constant statistic stay near).
VECTOR = [("length", 64, 0.6), ("symbols", 1024, 0.05), ("lines", 1024, 0.12), ("repeats", 1024, 0.12)]
STEPS = 2
COVERED = 0.75
#: Of chi-squared with four degrees: what makes the covered part's covariance consistent; the 97.5 % point; the
#: cut, beyond which normal data lie with a chance of 3e-7.
CONSISTENT, WEIGHTED, CUT = 1.49, 11.14, 36.0
#: Rows that a (lang, source) group or a language needs for an estimate of its own.
LEAST_GROUP = 60
D = len(VECTOR)
#: Of an estimate: level 0 is a language and source, 1 a language, 2 the whole table; what a level spans is null.
KEY = ["level", "lang", "source"]


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every document.

    Null and empty texts count as no words.  ``row`` holds the columns named by ``keep``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), t.alias("t"))
    d = d.withColumn("w", words(F.col("t"), SPACE))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = d.select("row", "w", "lines", F.size(F.regexp_extract_all("t", F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
                 F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(0), F.size("w") - 5),
                                                      lambda i: F.xxhash64(*[F.col("w")[i + k] for k in range(5)])))
                 .otherwise(F.array().cast("array<bigint>")).alias("g"))
    pairs = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # only a text with a window found twice is looked at further: windows that equal a neighbour in hash order
    d = d.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), pairs))
    s, last = F.col("s"), F.size("s") - 1
    same = lambda i, j: F.coalesce(s[i]["h"] == s[F.greatest(F.lit(0), F.least(last, j))]["h"], F.lit(False)) & (i != F.greatest(F.lit(0), F.least(last, j)))
    places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: s[i]["i"]))
    d = d.withColumn("p", F.when(F.col("s").isNotNull(), places))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct(
        (i + 5).alias("end"), (a["n"] + i + 5 - F.greatest(a["end"], i)).alias("n")))
    return d.select("row", F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
                    "n_symbols", F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    raw = [F.least(F.col("word_chars") / n, F.lit(60.0)), F.sqrt(F.least(F.col("n_symbols") / chars, F.lit(4.0))),
           F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * unit).cast("long").alias(f"x{i}") for i, (x, (_, unit, _)) in enumerate(zip(raw, VECTOR))]


def _floor(i: int) -> float:
    return VECTOR[i][1] * VECTOR[i][2]


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on columns of the same names, which stay once."""
    r = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return left.join(r, same, how).drop(*[f"__{c}" for c in on])


def _estimate(points: DataFrame, inside: Column, scale: float) -> DataFrame:
    """Mean and covariance's Cholesky factor of each group's points that are ``inside``."""
    x = [F.col(f"x{i}") for i in range(D)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(D)] + [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)]
    p = points.filter(inside).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *sums)
    p = p.select(*KEY, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(D)],
                 *[((F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))) * scale
                    + (_floor(i) ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)])
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            p = p.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return materialize(p.select(*KEY, *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)]), "mcd")


def _distance(points: DataFrame, params: DataFrame, on: list[str] = KEY) -> DataFrame:
    """Add d2, the squared Mahalanobis distance; null where ``params`` has no estimate."""
    d = _join(points, params, on, "left")
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)], F.lit(0.0))
        d = d.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(D)])
    return d.withColumn("d2", d2).drop(*[c for c in params.columns if c not in on], *[f"y{i}" for i in range(D)])


def _step(points: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: the estimate of the covered part that lies nearest by the last one."""
    d = _distance(points, params).withColumn("d", F.round(64 * F.log2(1 + F.col("d2"))).cast("long"))
    limit = d.groupBy(*KEY).agg(F.percentile("d", F.lit(COVERED)).alias("limit"))
    d = _join(d, limit, KEY)
    return _estimate(d, F.col("d") <= F.col("limit"), CONSISTENT)


def _levels(stats: DataFrame) -> DataFrame:
    """Of every language and source: ``level``, the one whose estimate judges it, and ``uses``, those that its points enter."""
    groups = stats.groupBy("lang", "source").agg(F.count_if(~base_failed()).alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    whole = langs.agg(F.max((F.col("least") < LEAST_GROUP) & (F.col("n_lang") < LEAST_GROUP)).alias("rest"))
    g = _join(groups, langs, ["lang"]).crossJoin(F.broadcast(whole))
    large, common = F.col("n") >= LEAST_GROUP, F.col("n_lang") >= LEAST_GROUP
    uses = [(large, 0), (common & (F.col("least") < LEAST_GROUP), 1), (F.col("rest"), 2)]
    return materialize(g.select("lang", "source", F.when(large, 0).when(common, 1).otherwise(2).alias("level"),
                                F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in uses])).alias("uses")), "levels")


def _spanned(level: Column) -> list[Column]:
    """The key of a row's estimate at ``level``."""
    return [level.alias("level"), F.when(level < 2, F.col("lang")).alias("lang"), F.when(level < 1, F.col("source")).alias("source")]


def fit(stats: DataFrame) -> DataFrame:
    """Robust location and scatter for every (lang, source) of ``stats``, of the rows that pass the base rules.

    ``stats`` has lang, source and the columns of :func:`statistics`.  Null languages and sources are groups of
    their own.  Groups below 60 such rows take the estimate of all rows of their language, languages below 60 that of
    the whole table, however small.
    """
    levels = _levels(stats)
    points = _join(stats.filter(~base_failed()).select("lang", "source", *_vector()), levels.select("lang", "source", "uses"), ["lang", "source"])
    points = points.withColumn("use", F.explode("uses")).select(*_spanned(F.col("use")), *[f"x{i}" for i in range(D)])
    medians = materialize(points.groupBy(*KEY).agg(*[F.median(f"x{i}").alias(f"m{i}") for i in range(D)]), "medians")
    spread = _join(points, medians, KEY).groupBy(*KEY).agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(D)], *[F.median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"a{i}") for i in range(D)])
    start = spread.select(*KEY, *[f"m{i}" for i in range(D)],
                          *[(F.greatest(1.4826 * F.col(f"a{i}"), F.lit(_floor(i))) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
                            for i in range(D) for j in range(i + 1)])
    params = materialize(start, "mcd")
    for _ in range(STEPS):
        params = _step(points, params)
    params = _estimate(_distance(points, params), F.col("d2") <= WEIGHTED, 1.0)
    asked = levels.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *_spanned(F.col("level")))
    found = _join(asked, params, KEY).drop(*KEY).withColumnsRenamed({"of_lang": "lang", "of_source": "source"})
    return materialize(found, "estimates")  # so that Spark knows how small it is when it meets the documents


def judge(stats: DataFrame, params: DataFrame) -> DataFrame:
    """Add base_failed, distance (squared Mahalanobis) and kept; ``params`` is of the same rows.

    A distance is null only where no row of the table passes the base rules.
    """
    names = stats.columns
    d = _distance(stats.select(*names, *_vector()), params, ["lang", "source"])
    failed = base_failed()
    return d.select(*names, failed.alias("base_failed"), F.col("d2").alias("distance"),
                    (~failed & F.coalesce(F.col("d2") <= CUT, F.lit(False))).alias("kept"))


def _measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    s = statistics(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, "lang", "source", "text"))]), (*dict.fromkeys((*keep, "lang", "source")),))
    return s.select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *s.columns[1:])


def verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: ``row`` (the kept columns), the statistics, base_failed, distance and kept."""
    stats = materialize(_measured(docs, keep), "stats")
    return judge(stats, fit(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    Documents and statistics are written once: a filter straight above them would be pushed into the scan and work out every
    statistic anew for each of its uses.
    """
    stats = materialize(_measured(docs, tuple(docs.columns)), "stats")
    return judge(stats, fit(stats)).filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
