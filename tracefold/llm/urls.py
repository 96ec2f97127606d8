"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import UPPER, LOWER, bounded
from tracefold.llm.trees import Boosted
from tracefold.session import materialize

#: Labelled URLs that the trees are fitted on, at most; and what an unseen suffix rests on, in labelled URLs.
SAMPLE = 20_000
PRIOR = 20
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens",
            "host_hyphens", "entropy", "parameters", "query_length", "has_fragment", "secure", "suffix_rate"]
#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`__url`")))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules or RULES, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def lexical(pages: DataFrame, rules=None) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict, suffix and every feature but suffix_rate."""
    d = pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col("url"), F.lit("")).alias("__url"))
    host, path = split_url(F.col("__url"))
    d = d.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    u, h, p = F.col("__url"), F.col("host"), F.col("path")
    count = lambda c, e: F.size(F.regexp_extract_all(c, F.lit(e), F.lit(0))).cast("double")
    length = F.char_length(u).cast("double")
    some = F.greatest(length, F.lit(1.0))
    chars = F.split(F.lower(u), "")
    d = d.withColumn("__runs", F.array_sort(F.filter(chars, lambda c: c != "")))
    kinds = F.array_distinct("__runs")
    share = lambda c: F.size(F.filter("__runs", lambda x: x == c)) / some
    entropy = F.aggregate(kinds, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    values = {"url_length": length, "host_length": F.char_length(h), "path_length": F.char_length(p), "host_labels": count(h, "[^.]+"),
              "depth": count(p, "[^/]+"), "digit_ratio": count(u, "[0-9]") / some, "host_digit_ratio": count(h, "[0-9]") / F.greatest(F.char_length(h), F.lit(1)),
              "hyphens": count(u, "[-_]"), "host_hyphens": count(h, "-"), "entropy": entropy, "parameters": count(query, "[^&]+"),
              "query_length": F.char_length(query), "has_fragment": F.instr(u, "#") > 0, "secure": u.startswith("https://")}
    return d.select("page_id", "url", "host", "path", "rule", "rule_verdict", F.substring_index(h, ".", -1).alias("suffix"),
                    *[v.cast("double").alias(c) for c, v in values.items()])


class UrlFilter:
    """Trees and the suffixes' rates, learned from labelled URLs (label 1: block)."""

    def __init__(self, labelled: DataFrame):
        """``labelled``: the columns of :func:`lexical` and ``label``; all of it is used, so bound it first."""
        labelled = materialize(labelled, "urls")
        total = labelled.agg(F.avg("label").alias("r")).first()["r"]
        self.rate = 0.5 if total is None else total
        self.suffixes = materialize(labelled.groupBy("suffix").agg(((F.sum("label") + PRIOR * self.rate) / (F.count(F.lit(1)) + PRIOR)).alias("suffix_rate"))
                                    .withColumnRenamed("suffix", "s"), "suffixes")
        self.trees = Boosted(self.rated(labelled), FEATURES, "label", rounds=15, depth=4)

    def rated(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.suffixes, F.col("suffix") == F.col("s"), "left").drop("s")
        return joined.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.rate)))

    def column(self) -> Column:
        return self.trees.column([F.col(c) for c in FEATURES])


def judge(pages: DataFrame, rules=None, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, host, path, rule, verdict and block_score of every page.

    The rules decide where one fits; else the trees, at 0.5.  The trees learn from ``labelled`` (url, label) if given,
    else from the pages that a rule decides, ``sample`` of them at most.  A null URL has empty host and path and is
    judged like an empty one.  Without any labelled URL the score is 0.5 or the only label's, and 0.5 blocks.
    """
    if labelled is None:
        known = bounded(pages.filter("url is not null").select("page_id", "url"), F.col("url"), 2 * sample)
        known = lexical(known, rules).filter("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
        known = bounded(known, F.col("url"), sample)
    else:
        known = bounded(labelled.filter("label is not null"), F.col("url"), sample)
        known = lexical(known.select(F.col("url"), F.lit(None).cast("long").alias("page_id")), rules).join(
            known.groupBy(F.col("url").alias("u")).agg(F.avg("label").alias("label")), F.col("url") == F.col("u")).drop("u")
        known = known.withColumn("label", (F.col("label") >= 0.5).cast("double"))
    model = UrlFilter(known)
    d = model.rated(lexical(pages, rules)).withColumn("block_score", model.column())
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return d.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "block_score")
