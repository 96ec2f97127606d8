"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised windows form a hash set: two bits a window in a constant bitmap, tested at every word
of a document inside one projection.  What passes is verified by a join on the window's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import ascii_lower, fixed, words
from tracefold.session import materialize

WINDOW = 13
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
#: Windows that are broadcast for the verifying join; more are joined by a shuffle.
BROADCAST = 200_000
#: log2 of the bits of the bitmap; more windows than bits make more work, not other results.
LEAST_BITS, MOST_BITS = 16, 26


def _grams(array: Column, size, at: Column) -> Column:
    return F.array_join(F.slice(array, at + 1, size), " ")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (size, gram, items): every window of the benchmark and the ids of the items that hold it.

    An item with fewer words than ``window`` is one window; without words it has none.  Null ids count as no item.
    """
    w = benchmark.select(F.col("item_id").alias("item"), words(ascii_lower(F.col("text")), NOT_WORD).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    w = w.select("item", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    w = w.select("item", "size", _grams(F.col("w"), F.col("size"), F.col("at")).alias("gram"))
    return w.groupBy("size", "gram").agg(F.collect_set("item").alias("items"))


def _hash(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[array[at + i] for i in range(size)])


def _hashes(array: Column, size: int) -> Column:
    """The hash of the window at each word."""
    many = F.size(array) - size
    found = F.transform(F.sequence(F.lit(0), F.greatest(many, F.lit(0))), lambda i: _hash(array, i, size))
    return F.when(many >= 0, found).otherwise(F.array().cast("array<bigint>"))


def _maybe(array: Column, hashes: Column, size: int, bitmap: Column, bits: int) -> Column:
    """The windows that the bitmap doesn't rule out."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0))),
                      lambda i: (i < F.size(hashes)) & _held(bitmap, hashes[i], bits))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), _grams(array, F.lit(size), i).alias("gram")))


def _bitmap(found: DataFrame, sizes: list[int], n: int) -> tuple[Column, int]:
    """Bits of all windows, gathered as at most 2**20 numbers of 64 bits each."""
    bits = min(MOST_BITS, max(LEAST_BITS, (256 * n).bit_length()))
    array = F.split("gram", " ")
    h = F.lit(None).cast("long")
    for size in sizes:
        h = F.when(F.col("size") == size, _hash(array, F.lit(0), size)).otherwise(h)
    places = F.explode(F.array(*[_place(F.col("h"), bits, k) for k in (0, 1)]))
    cells = (found.select(h.alias("h")).select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")))
    dense = [0] * (1 << (bits - 6))
    for r in cells.collect():
        dense[r["cell"]] = r["v"]
    return fixed(dense, "bigint"), bits


def _place(h: Column, bits: int, k: int) -> Column:
    return (F.shiftright(h, 30 * k) if k else h).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _held(bitmap: Column, h: Column, bits: int) -> Column:
    first, second = (_place(h, bits, k) for k in (0, 1))
    bit = lambda p: F.getbit(bitmap[F.shiftright(p, 6)], p.bitwiseAND(F.lit(63))) == 1
    return bit(first) & bit(second)


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), with_words: bool = False) -> DataFrame:
    """Every document with n_words, n_hit, items (sorted ids as strings) and hits (word ranges, merged).

    A document's word inside any occurrence of a benchmark window is hit.  Null and empty texts have no words and no
    hits.  Rows are told apart by position, so repeated rows and ids are separate rows.  Without benchmark windows
    nothing is hit.  ``keep`` names the columns to carry; they may have any names.
    """
    found = materialize(windows(benchmark, window), "bench")
    counts = {r["size"]: r["n"] for r in found.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, n = sorted(counts), sum(counts.values())
    held = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    w = docs.select(held, words(ascii_lower(F.col("text")), NOT_WORD).alias("w"))
    hits = F.array().cast("array<struct<at:int,size:int,gram:string>>")
    if n:
        bitmap, bits = _bitmap(found, sizes, n)
        for size in sizes:
            w = w.withColumn(f"h{size}", _hashes(F.col("w"), size))
        parts = [_maybe(F.col("w"), F.col(f"h{size}"), size, bitmap, bits) for size in sizes]
        hits = F.concat(*parts)
    first = w.select("row", F.size("w").cast("long").alias("n_words"), hits.alias("maybe"))
    first = materialize(first.withColumn("rid", F.monotonically_increasing_id()), "windows")
    maybe = first.filter(F.size("maybe") > 0).select("rid", F.inline("maybe"))
    known = found.withColumnRenamed("size", "s").withColumnRenamed("gram", "g")
    sure = maybe.join(F.broadcast(known) if n <= BROADCAST else known, (F.col("size") == F.col("s")) & (F.col("gram") == F.col("g")))
    per = sure.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("places"),
                                  F.collect_set(F.col("items")).alias("sets"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    walked = F.aggregate("places", zero, lambda a, p: F.struct(
        F.greatest(a["end"], p["at"] + p["size"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), p["at"] + p["size"] - F.greatest(a["end"], p["at"]))).alias("n")))
    per = per.select(F.col("rid").alias("r"), walked["n"].alias("n_hit"), "places",
                     F.sort_array(F.transform(F.array_distinct(F.flatten("sets")), lambda i: i.cast("string"))).alias("items"))
    per = materialize(per, "hits")  # of known size, so that few hits do not move all documents
    out = first.drop("maybe").join(per, F.col("rid") == F.col("r"), "left")
    none = F.array().cast("array<string>")
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", none).alias("items"), F.coalesce("places", F.array().cast(per.schema["places"].dataType)).alias("places"))


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    judged = spans(docs, benchmark, window, tuple(docs.columns))
    return judged.filter(~contaminated()).select("row.*")
