"""Personal data: high-recall generators propose spans, boosted trees select them, with DataFrame functions only.

Everything about a text stays in its row: matches and the gaps between them give the places of all spans, the trees are one column
expression over a span's format and context.  There is no shuffle, so repeated texts and hot sources cost nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.trees import Boosted
from tracefold.session import materialize

#: Least precision that the calibrated threshold reaches on held-out spans.
PRECISION = 0.95
KINDS = ["email", "ip", "card", "phone"]
# A match starts where the last one ended or at the start of a run, so a long run is read once; possessive
# quantifiers keep the matcher from recursing over long runs.  Neither changes what is matched: what follows a
# possessive run is never a character that the run could have taken.
BASE = {
    "email": ("@", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"),
    "ip": ("[0-9]\\.", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"),
    "card": ("[0-9][\\x20-]?[0-9]", "[0-9](?:[\\x20-]?[0-9])++"),
    "phone": ("\\+[0-9]", "\\+[0-9][\\x20().0-9-]+[0-9]"),
}
#: Generators of further kinds: what hints at one in a text, and the span.
MORE = {
    # a whole run of letters, digits, _ and - with a digit and something else in it, of any length
    "secret": ("[0-9]", "(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9-]*+[A-Za-z_])[A-Za-z0-9_-]++"),
    # runs of digits that touch no letter, any number of them of any length, with at most a bracket and a separator between
    "number": ("[0-9]", "\\+?\\(?(?<![0-9A-Za-z])[0-9]++(?![A-Za-z])\\)?(?:[\\x20./-]?\\(?[0-9]++(?![A-Za-z])\\)?)*+"),
    "address": ("@", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\\x20?@\\x20?[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)*+"),
}
HINTS = "(?i)(password|passwd|pwd|token|secret|api[_-]?key|key|auth|tel|phone|mail|card|account|ssn|ip)[\\x20\"'=:(]*$"
FEATURES = ["length", "digits", "letters", "separators", "upper", "kinds", "longest_run", "distinct", "hinted", "assigned", "quoted", "is_secret", "is_number", "is_address"]
SPAN = "struct<kind:string,start:bigint,text:string,before:string,after:string>"
CONTEXT = 24


def _proposals(t: Column, kind: str, hint: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches with place and context; an empty array where the hint is absent."""
    gaps, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("text"), F.slice(gaps, 2, 2**30).alias("next"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a, p):
        at = a["at"] + F.char_length(p["gap"])
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), p["text"].alias("text"),
                        F.substring(p["gap"], -CONTEXT, CONTEXT).alias("before"), F.substring(p["next"], 1, CONTEXT).alias("after"))
        return F.struct((at + F.char_length(p["text"])).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    zipped = F.filter(pieces, lambda p: p["text"].isNotNull())
    named = zipped.cast("array<struct<gap:string,text:string,next:string>>")
    seen = t.contains(hint) if hint == "@" else t.rlike(hint)
    return F.when(seen, F.aggregate(named, start, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        parts = F.split(text, "\\.")
        return F.forall(parts, lambda p: F.char_length(F.ltrim(p, F.lit("0"))) < F.lit(4)) & F.forall(
            F.transform(parts, lambda p: F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3)), lambda p: p <= "255")
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "card":
        back = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(F.nullif(c, F.lit("")), F.lit("9")).cast("int"))
        doubled = F.transform(F.filter(back, lambda c: c.isNotNull()), lambda c, i: F.when(i % 2 == 0, c).when(c > 4, 2 * c - 9).otherwise(2 * c))
        luhn = F.aggregate(doubled, F.lit(0), lambda a, c: a + c) % 10 == 0
        return F.char_length(digits).between(13, 19) & F.when(F.char_length(digits).between(13, 19), luhn).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _features(s: Column) -> list[Column]:
    x = s["text"]
    n = F.char_length(x)
    left = lambda p: n - F.char_length(F.regexp_replace(x, p, ""))
    runs = F.transform(F.split(x, "[^0-9A-Za-z]+"), lambda r: F.char_length(r))
    some = lambda p: x.rlike(p).cast("int")
    out = [n, left("[0-9]"), left("[A-Za-z]"), left("[\\x20().-]"), left("[A-Z]"), some("[a-z]") + some("[A-Z]") + some("[0-9]") + some("[^0-9A-Za-z]"),
           F.array_max(runs), F.size(F.array_distinct(F.split(x, ""))), s["before"].rlike(HINTS), s["before"].rlike("[=:]\\x20?[\"']?$"),
           s["after"].rlike("^[\"']"), s["kind"] == "secret", s["kind"] == "number", s["kind"] == "address"]
    return [c.cast("double") for c in out]


def _all(t: Column) -> tuple[Column, Column]:
    """Arrays of base spans (valid ones) and of further proposals (which keep clear of nothing yet)."""
    return F.concat(*[_base(t, k) for k in KINDS]), F.concat(*[_proposals(t, k, h, p) for k, (h, p) in MORE.items()])


def _base(t: Column, kind: str) -> Column:
    return F.filter(_proposals(t, kind, *BASE[kind]), lambda s: _valid(kind, s["text"]))


def _clear(more: Column, base: Column) -> Column:
    """The proposals that overlap no base span."""
    end = lambda s: s["start"] + F.char_length(s["text"])
    return F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < end(m)) & (m["start"] < end(b))))


class Selector:
    """Boosted trees over proposals and the threshold for them."""

    def __init__(self, spans: DataFrame):
        """``spans``: (span, label); of every four hashes of a span one calibrates, the rest fit.

        Spans are counted by their features, of which there are few combinations, so the trees are fitted on all of them.
        """
        f = spans.select(F.col("label").cast("double").alias("label"), (F.pmod(F.xxhash64("span"), F.lit(4)) == 0).alias("held"),
                         *[c.alias(n) for n, c in zip(FEATURES, _features(F.col("span")))])
        f = materialize(f.groupBy("label", "held", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("many")), "pii")
        self.trees = Boosted(f.filter("not held"), FEATURES, "label", rounds=12, depth=4, weight="many")
        scored = f.filter("held").select("label", "many", F.floor(100 * self.trees.column([F.col(c) for c in FEATURES])).alias("bin"))
        bins = {r["bin"]: (r["n"], r["good"]) for r in scored.groupBy("bin").agg(
            F.sum("many").alias("n"), F.sum(F.col("label") * F.col("many")).alias("good")).collect()}
        self.threshold, n, good = 0.5, 0, 0.0
        for b in sorted(bins, reverse=True):
            n, good = n + bins[b][0], good + bins[b][1]
            if n >= 20 and good >= PRECISION * n:
                self.threshold = max(0.05, b / 100)

    def selects(self, span: Column) -> Column:
        return self.trees.column(_features(span)) >= self.threshold


def training_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The spans of all documents, labelled by what is known of them: valid base spans and proposals that a key word assigns are personal data;
    other proposals, such as numbers that fail their checks, are not."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(t.alias("t")).filter(F.col("t").rlike("[0-9@]"))
    base, more = _all(F.col("t"))
    d = d.select(base.alias("base"), more.alias("more"))
    d = d.select("base", _clear(F.col("more"), F.col("base")).alias("more"))
    known = d.select(F.explode("base").alias("span"), F.lit(1).alias("label"))
    proposed = d.select(F.explode("more").alias("span"))
    assigned = F.col("span.before").rlike(HINTS) & ~F.col("span.before").rlike("(?i)(ip|tel|mail)[\\x20\"'=:(]*$")
    return known.unionByName(proposed.withColumn("label", assigned.cast("int")))


def find(docs: DataFrame, keep: list[str], selector: Selector | None = None, text: str = "text") -> DataFrame:
    """``row`` (the kept columns), ``base`` and ``spans`` (base and selected ones), each sorted by kind and start.

    A null text is empty and has no spans.  Every row is judged on its own; equal texts have equal spans.  Base spans
    of different kinds may overlap, added ones overlap no base span.  Without proposals nothing is added.
    """
    selector = selector or Selector(training_spans(docs, text=text))
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), t.alias("t"))
    base, more = _all(F.col("t"))
    d = d.select("row", "t", base.alias("base"), more.alias("more"))
    d = d.select("row", "t", "base", F.when(F.size("more") > 0, F.filter(_clear(F.col("more"), F.col("base")), selector.selects)).otherwise(F.col("more")).alias("more"))
    return d.select("row", "t", "base", F.concat("base", "more").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed and then start, joined by commas."""
    texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), (s["start"] + F.char_length(s["text"])).cast("string")))
    return F.array_join(texts, ",")


def redact(docs: DataFrame, text: str = "text", selector: Selector | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets (touching or nested spans by the first one's)."""
    found = find(docs, docs.columns, selector, text)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.char_length(s["text"])).alias("end"), F.upper(s["kind"]).alias("kind"))))
    t = F.col("t")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a, s):
        new = s["start"] >= a["at"]
        before = F.substring(t, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(a["out"], before, F.lit("["), s["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"))

    walked = F.aggregate(ordered, start, step)
    clean = F.when(F.size("spans") > 0, F.concat(walked["out"], F.substring(t, (walked["at"] + 1).cast("int"), F.lit(2**31 - 1)))).otherwise(F.col(f"row.`{text}`"))
    return found.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
