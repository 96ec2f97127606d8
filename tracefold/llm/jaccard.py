"""N-gram Jaccard join: tiles of documents that share a rare shingle, compared by hashed bitmaps, then exactly.

A document's shingles are 64-bit hashes in a sorted array; equal arrays are one class, and only classes are compared.  With a
common order of shingles, rare before frequent, two sets that link share a shingle among the first of each (prefix filter), so a
tile holds the classes that have one shingle there.  Rows are ordered by size and stay only where another of the
tile lies in their band of sizes; tiles of the same rows are one.  A shingle of very many classes has a tile for each
band instead, which a row enters for its own size and the next.  In a tile, the bits in which two parity bitmaps
differ bound the overlap from above.  What passes is verified by intersecting the sorted arrays.

The first round keeps, per tile, a spanning forest of the pairs that pass, so a group of near copies makes rows in
proportion to its size; a large tile is cut into blocks that each row enters once.  The second round tests every pair
that passes between different components of verified links, all pairs of blocks included; tiles within one component
are gone by then.  No link is lost and no tile, bucket or candidate list is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.components import components
from tracefold.session import discard, materialize, recorded, release_shuffles, remove

WORDS, PERCENT = 4, 85
#: Bits of a bitmap: the power of two from the number of shingles on, within these bounds.
LEAST_BITS, MOST_BITS = 1024, 1 << 17
#: Rows of a block; larger tiles are dealt into blocks.
TILE = 4096
#: The order of shingles: frequent are those seen this often in one text of SAMPLE; the most frequent of them are known.  It
#: only orders and deals work: any order gives the same links.
SAMPLE, FREQUENT, KNOWN = 16, 8, 1_000_000
#: Ids that are broadcast to pick the texts to verify; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Whole numbers that are broadcast to tell copies from the rows that stay in place; with more, all rows are moved.
MARKS = 2_000_000
MEMO = 200_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(text: str | None, words: int = WORDS, memo: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z are lower-cased and words end at ASCII white space.

    The hashes have 64 bits, and sets are compared by them: links are exact unless two shingles of a table collide.
    ``memo`` keeps words' hashes for the next text.
    """
    memo = {} if memo is None else memo
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    for x in set(w).difference(memo):
        memo[x] = xxhash.xxh3_64_intdigest(x)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    n = len(w) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):  # mixed after each word, so that the order counts
        out = (out ^ h[k:k + n]) * _MIX[k % 4]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bitmap(found: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit: two bitmaps differ in no more bits than the sets in shingles."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(found) - 1).bit_length())) if len(found) else LEAST_BITS
    place = ((found * _MIX[1]) >> np.uint64(40)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sig: np.ndarray) -> np.ndarray:
    """The bitmap of half as many bits."""
    half = len(sig) // 2
    return sig[:half] ^ sig[half:]


def _marks(df: DataFrame, name: str) -> DataFrame:
    """The numbers of a table of one column, written, so that a few of them do not move the rows they are compared with."""
    marks = materialize(df, name)
    return F.broadcast(marks) if marks.count() <= MARKS else marks


def _key():
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _frequent(docs: DataFrame, words: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their counts in one of ``sample`` distinct texts."""
    some = docs.select(F.col("text").cast("string").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).distinct()

    def run(batches):
        memo = {}
        for batch in batches:
            parts = [shingles(t, words, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["s"])

    rows = (some.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
            .orderBy(F.desc("n"), "s").limit(KNOWN).toArrow())
    keys = rows.column("s").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order]


def _measure(docs: DataFrame, words: int, percent: int, tile: int, sample: int) -> DataFrame:
    """(rid, doc_id, key, n, cls, prefix, deal, short, sig): a row for each document; key is the text's digest.

    ``deal`` has the blocks of the last shingles of ``prefix``, those expected in more than ``tile`` texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words, sample))

    def run(batches):
        keys, counts = shared.value
        memo = {}
        for batch in batches:
            n, cls, prefix, deal, short, sig = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                a = shingles(text, words, memo)
                size = len(a)
                order, blocks = a, np.zeros(0, np.int64)
                first = size - -(-percent * size // 100) + 1
                if len(keys) and size:
                    at = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
                    hot = keys[at] == a
                    seen = counts[at[hot]]
                    by = np.argsort(seen, kind="stable")
                    order = np.concatenate([a[~hot], a[hot][by]])
                    blocks = -(-seen[by] * sample // tile)[:max(0, first - int((~hot).sum()))]
                n.append(size)
                cls.append(xxhash.xxh3_128_digest(a.tobytes()))
                prefix.append(order[:first].view(np.int64) if size else np.zeros(0, np.int64))
                deal.append(blocks[blocks > 1])
                short.append(size - -(-2 * percent * size // (100 + percent)) + 1 if size else 0)
                sig.append(bitmap(a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(prefix, pa.list_(pa.int64())),
                                              pa.array(deal, pa.list_(pa.int64())), pa.array(short, pa.int32()), pa.array(sig, pa.binary())],
                                             ["doc_id", "key", "n", "cls", "prefix", "deal", "short", "sig"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text"), _key().alias("key"))
    kind = found.schema["doc_id"].dataType.simpleString()
    found = found.mapInArrow(run, f"doc_id {kind}, key string, n long, cls binary, prefix array<long>, deal array<long>, short int, sig binary")
    return materialize(found.withColumn("rid", F.monotonically_increasing_id()), "shingles")


class Join:
    """The measured documents of one table and what the rounds share."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, tile: int = TILE, sample: int = SAMPLE):
        self.docs, self.words, self.percent, self.tile = docs, words, percent, tile
        self.rows = _measure(docs, words, percent, tile, sample)
        classes = self.rows.filter("n > 0").groupBy("cls").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("rep"))
        self.classes = materialize(classes, "classes")
        copies = self.rows.filter("n > 0").select("rid").join(self.classes.select("cid"), F.col("rid") == F.col("cid"), "left_anti")
        self.copies = _marks(copies.withColumnRenamed("rid", "copy"), "copies")
        self.live = materialize(self._banded().unionByName(self._dealt()), "tiles")
        whole, self.rows = self.rows, materialize(self.rows.drop("prefix", "deal", "short"), "rows")
        discard(whole)  # the prefixes were most of it
        release_shuffles(docs.sparkSession)

    def _first(self) -> DataFrame:
        """A row for each class; ``cold`` is how many shingles of its prefix are not dealt into blocks."""
        rows = self.rows.filter("n > 0").select(F.col("rid").alias("cid"), "n", "prefix", "deal", "short", (F.size("prefix") - F.size("deal")).alias("cold"))
        return rows.join(self.copies, F.col("cid") == F.col("copy"), "left_anti")

    def _banded(self) -> DataFrame:
        """(token, block, cid, n, short, blocks) of the rows with another in their band, named by the tile's rows so that equal tiles meet."""
        posted = self._first().select(F.posexplode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("at", "token"), "cid", "n", (F.col("at") < F.col("short")).alias("short"))
        tile = Window.partitionBy("token")
        by_size = tile.orderBy("n", "cid")
        posted = posted.withColumn("next", F.lead("n").over(by_size))
        posted = posted.withColumn("last", F.max(F.when(F.col("short"), F.col("n"))).over(by_size.rowsBetween(Window.unboundedPreceding, -1)))
        smaller = F.col("short") & (100 * F.col("n") >= self.percent * F.col("next"))
        larger = 100 * F.col("last") >= self.percent * F.col("n")
        live = posted.filter(F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False))).select("token", "cid", "n", "short")
        name = [F.bit_xor(F.xxhash64("cid", "short", F.lit(k))).over(tile) for k in (1, 2)]
        return live.select(name[0].alias("name"), name[1].alias("block"), "cid", "n", "short").distinct().select(
            F.col("name").alias("token"), "block", "cid", "n", "short", F.lit(1).cast("long").alias("blocks"))

    def _dealt(self) -> DataFrame:
        """The same columns for shingles of very many classes: a tile for each band of sizes, ``block`` being the band."""
        size = F.size("deal")
        hot = F.arrays_zip(F.slice("prefix", F.col("cold") + 1, size).alias("token"), F.sequence(F.col("cold"), F.col("cold") + size - 1).alias("at"), F.col("deal").alias("blocks"))
        posted = self._first().filter(size > 0).select(F.explode(hot).alias("p"), "cid", "n", "short")
        width = (1 - 1e-9) / math.log(100 / self.percent)  # a little wide, so that rounding never puts a pair two bands apart
        band = F.floor(F.log(F.col("n")) * width).cast("long")
        return posted.select(F.col("p.token").alias("token"), F.explode(F.array(band, band + 1)).alias("block"), "cid", "n",
                             (F.col("p.at") < F.col("short")).alias("short"), F.col("p.blocks").alias("blocks"))

    def candidates(self, labels: DataFrame | None, every: bool) -> DataFrame:
        """Distinct pairs (a, b) of classes that pass the bitmaps: a forest per block, or all between different labels."""
        live = self.live
        if labels is not None:
            live = live.join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "cid")).drop("node", "root")
        else:
            live = live.withColumn("label", F.col("cid"))
        part = F.pmod(F.xxhash64("cid", "token"), F.col("blocks")).cast("long")
        if every:
            mixed = live.groupBy("token", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("many")).filter("lo <> hi")
            mixed = mixed.select(F.col("token").alias("t"), F.col("block").alias("b"), F.ceil(F.col("many") / self.tile).cast("long").alias("blocks"))
            live = live.drop("blocks").join(mixed, (F.col("token") == F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")
            deal = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
                F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(part, j) * F.col("blocks") + F.greatest(part, j)))
            live = live.select("token", "block", F.explode(deal).alias("part"), "cid", "n", "short", "label")
        else:
            live = live.select("token", "block", part.alias("part"), "cid", "n", "short", "label")
        sigs = self.rows.select("rid", "sig")
        tiles = live.join(sigs, F.col("cid") == F.col("rid")).drop("rid").repartition("token", "block", "part").sortWithinPartitions("token", "block", "part")
        percent = self.percent

        def run(batches):
            yield from _tiles(batches, percent, every)

        return tiles.mapInArrow(run, "a long, b long").distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by intersecting their arrays."""
        pairs = materialize(pairs, "pairs")
        release_shuffles(pairs.sparkSession)
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        need = materialize(self.classes.join(ids, F.col("cid") == F.col("id"), "left_semi").select("cid", "cls", "rep"), "need")
        some = need.select("rep").distinct()
        some = F.broadcast(some) if need.count() <= BROADCAST else some
        words, percent = self.words, self.percent

        def read(batches):
            memo = {}
            for batch in batches:
                arrays = [shingles(t, words, memo).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(a) for a in arrays], pa.binary()), pa.array(arrays, pa.binary())], ["c", "arr"])

        texts = self.docs.select("doc_id", F.col("text").cast("string").alias("text"))
        texts = texts.join(some, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
        arrays = texts.mapInArrow(read, "c binary, arr binary").join(need, F.col("c") == F.col("cls")).select("cid", "arr").dropDuplicates(["cid"])
        arrays = materialize(arrays, "arrays")
        release_shuffles(pairs.sparkSession)

        def test(batches):
            for batch in batches:
                good = np.array([_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                                 for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], bool)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

        discard(need)
        joined = (pairs.join(arrays.select(F.col("cid").alias("ca"), F.col("arr").alias("x")), F.col("a") == F.col("ca"))
                  .join(arrays.select(F.col("cid").alias("cb"), F.col("arr").alias("y")), F.col("b") == F.col("cb")))
        links = materialize(joined.select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "links")
        discard(pairs, arrays)
        release_shuffles(links.sparkSession)
        return links

    def links(self) -> DataFrame:
        """Every link (a, b) between classes; membership is in ``classes`` and ``rows``."""
        return self.verify(self.candidates(None, every=True))

    def labels(self) -> DataFrame:
        """(node, root) of every class that links with another."""
        links = self.verify(self.candidates(None, every=False))
        labels = self._components(links)
        more = self.verify(self.candidates(labels, every=True))
        discard(self.live)  # the last reader of the tiles is gone
        self.live = None
        if more.isEmpty():
            return labels
        discard(labels)
        return self._components(links.unionByName(more))

    def _components(self, links: DataFrame) -> DataFrame:
        with recorded() as rounds:
            labels = materialize(components(links), "labels")
        remove(links.sparkSession, rounds[:-1])
        return labels

    def members(self) -> DataFrame:
        """doc_id, key, n_shingles, component_id (null for a null doc_id alone; the document itself for an empty set), top (null for that)."""
        roots = self.classes.join(self.labels(), F.col("cid") == F.col("node"), "left").select("cls", F.coalesce("root", "cid").alias("top"), "rep")
        least = roots.groupBy("top").agg(F.min("rep").alias("component_id")).withColumnRenamed("top", "k")
        known = roots.join(least, F.col("top") == F.col("k")).select(F.col("cls").alias("c"), "component_id", "top")
        found = self.rows.filter("n > 0").join(known, F.col("cls") == F.col("c"))
        rest = self.rows.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "top": F.lit(None).cast("long")})
        pick = ["doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "component_id", "top"]
        return found.select(*pick).unionByName(rest.select(*pick))


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _tiles(batches, percent: int, every: bool):
    """Stream rows sorted by tile; each tile is looked at whole."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = np.stack([t.column(c).to_numpy() for c in ("token", "block", "part")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if not len(cuts):
            rest = t
            continue
        rest = t.slice(int(cuts[-1]))
        yield from _whole(t.slice(0, int(cuts[-1])), np.concatenate([[0], cuts]), percent, every)
    if rest is not None and rest.num_rows:
        yield from _whole(rest, np.array([0, rest.num_rows]), percent, every)


def _whole(t: pa.Table, bounds: np.ndarray, percent: int, every: bool):
    cid, n, short, label = (t.column(c).to_numpy() for c in ("cid", "n", "short", "label"))
    n = n.astype(np.int64)
    sig = [np.frombuffer(x, np.uint64) for x in t.column("sig").to_pylist()]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    if len(two):
        i, j = two, two + 1
        swap = (n[i] > n[j]) | ((n[i] == n[j]) & (cid[i] > cid[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        may = (label[i] != label[j]) & short[i] & (100 * n[i] >= percent * n[j])
        i, j = i[may], j[may]
        apart = np.array([_apart(sig[x], sig[y]) for x, y in zip(i, j)], np.int64)
        ok = _may_link(apart, n[i], n[j], percent)
        out.append((cid[i[ok]], cid[j[ok]]))
    for lo, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
        rows = np.arange(lo, lo + size)
        rows = rows[np.lexsort((cid[rows], n[rows]))]
        out += _tile(cid[rows], n[rows], short[rows], label[rows].copy(), [sig[r] for r in rows], percent, every)
    a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, folded to the shorter one's length."""
    while len(y) > len(x):
        y = fold(y)
    while len(x) > len(y):
        x = fold(x)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _may_link(apart, nx, ny, percent):
    """Whether sets of these sizes may link, by the bits in which their bitmaps differ."""
    most = (nx + ny - apart) // 2
    return (100 + percent) * most >= percent * (nx + ny)


def _tile(cid, n, short, label, sig, percent, every):
    out = []
    upto = np.searchsorted(n, 100 * n // percent, side="right")  # sizes in the band of each
    even = np.stack(sig) if len({len(x) for x in sig}) == 1 else None
    for i in range(len(cid)):
        j = slice(i + 1, int(upto[i]))
        if j.start >= j.stop or not short[i]:
            continue
        differ = label[j] != label[i]
        if not differ.any():
            continue
        at = i + 1 + np.flatnonzero(differ)
        if even is not None:
            apart = np.bitwise_count(even[i] ^ even[at]).sum(-1, dtype=np.int64)
        else:
            apart = np.array([_apart(sig[i], sig[x]) for x in at], np.int64)
        at = at[_may_link(apart, n[i], n[at], percent)]
        if not len(at):
            continue
        if not every:  # one of each part that is new to i's part
            _, first = np.unique(label[at], return_index=True)
            at = at[first]
            label[np.isin(label, label[at])] = label[i]
        out.append((np.full(len(at), cid[i]), cid[at]))
    return out


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Sets link when 100 * intersection >= percent * union.  Fewer words than a shingle are one shingle; null and empty texts have
    none and link with nothing.  Repeated rows and ids stay rows.
    """
    return Join(docs, words, percent).members().drop("key", "top")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all columns: that with the smallest id, the smallest digest of a text where all ids are null.

    Ids may be of any type that has an order.  Of rows that repeat that id and its text one stays.  Documents without a word, null
    and empty texts included, are no group: all of them stay.
    """
    found = materialize(Join(docs, words, percent).members().filter("top is not null").select("doc_id", "key", "top"), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = found.groupBy(F.col("top").alias("k")).agg(F.min(rank).alias("best"))
    gone = found.join(best, F.col("top") == F.col("k")).filter(rank != F.col("best")).select("doc_id", "key").distinct()
    again = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("doc_id", "key")
    gone, again = (materialize(x.select(F.col("doc_id").alias("__id"), F.col("key").alias("__text")), "dropped") for x in (gone, again))
    # only documents with the hash of such an id and text are moved and compared; the others stay in place
    odd = _marks(gone.unionByName(again).select(F.xxhash64("__id", "__text").alias("__mark")).distinct(), "marks")
    marked = F.xxhash64("doc_id", _key()) == F.col("__mark")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_key() == F.col("__text"))
    rest, kept = docs.join(odd, marked, "left_anti"), docs.join(odd, marked, "left_semi").join(gone, same, "left_anti")
    if again.isEmpty():
        return rest.unionByName(kept)
    repeats = kept.join(again, same, "left_semi").withColumn("__key", _key())
    repeats = repeats.dropDuplicates(["doc_id", "__key"]).drop("__key")
    return rest.unionByName(kept.join(again, same, "left_anti")).unionByName(repeats)
