"""Merkle dataset manifest in a van Emde Boas layout.

Rows are leaves, ordered inside their group; every FANOUT consecutive nodes become their parent.  A group's tree is cut into
aligned blocks of FANOUT ** HEIGHT leaves.  A block's nodes lie in one buffer, recursively split at half height, so where a node
or its siblings lie follows from level and position alone.  Block roots are the leaves of the next round, until
one node is left per group; the groups' roots, in the order of their keys, form one more tree in the same way.

A round groups by (group, block), so the group that holds a third of all rows is many small tasks.  Positions come from a range
shuffle and one row per (group, partition).  Every round is a written table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracefold.llm.common import extended
from tracefold.session import materialize

FANOUT, HEIGHT = 3, 6
BLOCK = FANOUT ** HEIGHT
BYTES = 32  # of a digest
GROUP = "__group"


# -- addresses ------------------------------------------------------------------

def nodes_in(levels: int) -> int:
    """Nodes of a complete tree."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: int) -> int:
    """Where node ``index`` at ``depth`` below the root lies in a complete tree of ``levels``.

    The upper half of the levels comes first, then the subtrees below it, each laid out in the same way.
    """
    base = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, below = depth - top, levels - top
        subtree, index = divmod(index, FANOUT ** depth)
        base += nodes_in(top) + subtree * nodes_in(below)
        levels = below
    return base


@lru_cache(None)
def addresses(height: int) -> list[list[int]]:
    """Addresses by level, leaves first, and position."""
    return [[address(height + 1, height - level, i) for i in range(FANOUT ** (height - level))] for level in range(height + 1)]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(leaves: int) -> int:
    height, span = 0, 1
    while span < leaves:
        height, span = height + 1, span * FANOUT
    return height


def build(leaves: list[str], height: int) -> tuple[str, bytes]:
    """(root, buffer of all nodes) of a block: every level's runs are hashed ``height`` times, runs of one node too."""
    places, buffer = addresses(height), bytearray(nodes_in(height + 1) * BYTES)
    level = leaves
    for depth in range(height + 1):
        for at, node in zip(places[depth], level):
            buffer[at * BYTES:(at + 1) * BYTES] = bytes.fromhex(node)
        if depth < height:
            level = [digest("".join(level[i:i + FANOUT])) for i in range(0, len(level), FANOUT)]
    return level[0], bytes(buffer)


def steps(buffer: bytes, leaves: int, height: int) -> list[str]:
    """Per leaf the steps up to the block's root: ``left:right`` siblings of each level, joined by commas."""
    text, places = buffer.hex(), addresses(height)
    counts = [leaves]
    for _ in range(height):
        counts.append(-(-counts[-1] // FANOUT))

    def node(level: int, i: int) -> str:
        at = places[level][i] * 2 * BYTES
        return text[at:at + 2 * BYTES]

    above = [""]
    for level in reversed(range(height)):
        here = []
        for i in range(counts[level]):
            run = i - i % FANOUT
            left = "".join(node(level, j) for j in range(run, i))
            right = "".join(node(level, j) for j in range(i + 1, min(run + FANOUT, counts[level])))
            rest = above[i // FANOUT]
            here.append(f"{left}:{right},{rest}" if rest else f"{left}:{right}")
        above = here
    return above


# -- rounds ---------------------------------------------------------------------

def _positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows, written, with ``n`` (rows of the group) and ``pos`` (0-based, in the given order)."""
    mark = F.monotonically_increasing_id()  # partition, then place in it
    ranged = rows.repartitionByRange(GROUP, *order).sortWithinPartitions(GROUP, *order)
    ranged = materialize(ranged.select("*", mark.alias("__mark")), "merkle-rows")
    part, at = F.shiftright("__mark", 33), F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(F.col(GROUP).alias("__g"), part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"), F.min(at).alias("__first"))
    of_group = Window.partitionBy("__g")
    offset = F.sum("__rows").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.select("__g", "__part", (F.coalesce(offset, F.lit(0)) - F.col("__first")).alias("__offset"),
                                       F.sum("__rows").over(of_group).alias("n")), "merkle-offsets")
    same = F.col(GROUP).eqNullSafe(F.col("__g")) & (part == F.col("__part"))
    return ranged.join(counts, same).select(*rows.columns, "n", (at + F.col("__offset")).alias("pos"))


def _blocks(rows: DataFrame) -> DataFrame:
    """One written row per block of (GROUP, n, pos, node, row): its root, its nodes and its rows in order."""
    schema = extended(rows, [GROUP], "n long, block long, leaves int, height int, root string, nodes binary")
    schema = schema.add("rows", ArrayType(rows.schema["row"].dataType))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n, block = table["n"][0].as_py(), table["pos"][0].as_py() // BLOCK
        leaves = table["node"].to_pylist()
        # a block beside others rises its full height; a group's only block stops at its root
        height = HEIGHT if n > BLOCK else height_of(n)
        root, nodes = build(leaves, height)
        held = pa.concat_arrays(table["row"].chunks)
        columns = [table[GROUP].slice(0, 1), pa.array([n]), pa.array([block]), pa.array([len(leaves)], pa.int32()),
                   pa.array([height], pa.int32()), pa.array([root]), pa.array([nodes], pa.binary()),
                   pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)]
        return pa.Table.from_arrays(columns, names)

    names = schema.names
    block = F.floor(F.col("pos") / BLOCK).alias("__block")
    return materialize(rows.groupBy(GROUP, block).applyInArrow(one, schema), "merkle-blocks")


def _forest(rows: DataFrame) -> list[DataFrame]:
    """Block tables of all rounds, the last holding the roots of the largest groups."""
    rounds = [_blocks(rows)]
    while True:
        over = rounds[-1].filter(F.col("n") > BLOCK)
        if over.isEmpty():
            return rounds
        rounds.append(_blocks(over.select(GROUP, F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("root").alias("node"),
                                          F.struct(F.lit(None).cast("int").alias("none")).alias("row"))))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(GROUP, root) of every group."""
    found = [r.filter(F.col("n") <= BLOCK).select(GROUP, "root") for r in rounds]
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole


def _walk(blocks: DataFrame, tails: DataFrame, held: list[str]) -> DataFrame:
    """Per leaf of each block its position, row, and steps: those inside the block, then the block's own (``tails``)."""
    tails = tails.select(F.col(GROUP).alias("__g"), F.col("pos").alias("__b"), F.col("steps").alias("__tail"), *held)
    met = F.col(GROUP).eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__b"))
    joined = blocks.drop("root").join(tails, met).select(GROUP, *held, "block", "leaves", "height", "nodes", "rows", "__tail")
    schema = extended(joined, [GROUP, *held], "pos long, node string, steps string").add("row", blocks.schema["rows"].dataType.elementType)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                block, leaves, height = (one.column(c)[0].as_py() for c in ("block", "leaves", "height"))
                nodes, tail = one.column("nodes")[0].as_py(), one.column("__tail")[0].as_py()
                found = [f"{s},{tail}" if s and tail else s or tail for s in steps(nodes, leaves, height)]
                places = addresses(height)[0]
                values = [nodes[a * BYTES:(a + 1) * BYTES].hex() for a in places[:leaves]]
                same = pa.array([0] * leaves, pa.int64())
                columns = [one.column(c).take(same) for c in (GROUP, *held)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(block * BLOCK, block * BLOCK + leaves), pa.int64()),
                                                  pa.array(values), pa.array(found), one.column("rows").flatten()], schema.names)

    return joined.mapInArrow(run, schema)


def _descend(rounds: list[DataFrame], tails: DataFrame, held: list[str]) -> DataFrame:
    """Steps of the lowest round's leaves.  ``tails``: (GROUP, steps, *held) of each group's root."""
    tails = tails.withColumn("pos", F.lit(0).cast("long"))
    passed = None
    for level in reversed(range(len(rounds))):
        # groups that end in this round start here; the others come from the round above
        top = rounds[level].filter(F.col("n") <= BLOCK).select(F.col(GROUP).alias("__t")).distinct()
        here = tails.join(top, F.col(GROUP).eqNullSafe(F.col("__t")), "left_semi").select(GROUP, "pos", "steps", *held)
        if passed is not None:
            here = here.unionByName(passed)
        walked = _walk(rounds[level], here, held)
        if level == 0:
            return walked
        passed = materialize(walked.select(GROUP, "pos", "steps", *held), "merkle-steps")


# -- the operator ---------------------------------------------------------------

def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def manifest(docs: DataFrame, leaf: Column, group: str = "source", key: str = "doc_id", **carry: Column) -> DataFrame:
    """Per row: the key, the columns ``carry``, leaf, subroot of its group, root, and proof.

    ``proof`` has a step per level from the leaf to the root, ``left:right`` siblings joined by commas; ``folded`` follows it.
    Leaves are ordered by key, null first, then by digest, so ties and repeated rows each have a place of their own and
    the same root in any row order.  Rows without a group form one.  An empty table has no rows and no root.  Texts of any
    length only meet the digest; further columns are not read.
    """
    rows = docs.select(F.col(group).alias(GROUP), F.col(key).alias("__key"), leaf.alias("node"),
                       F.struct(F.col(key).alias("key"), *[c.alias(n) for n, c in carry.items()]).alias("row"))
    rounds = _forest(_positioned(rows, ["__key", "node"]))
    subroots = _roots(rounds)
    # the groups' roots, in the order of the groups, as the leaves of one group
    top = _positioned(subroots.select(F.lit(0).alias(GROUP), F.col(GROUP).alias("__order"), F.col("root").alias("node"),
                                      F.struct(F.col(GROUP).alias("group")).alias("row")), ["__order"])
    upper = _forest(top)
    tails = _descend(upper, _roots(upper).select(GROUP, F.lit("").alias("steps"), "root"), ["root"])
    tails = materialize(tails.select(F.col("row.group").alias(GROUP), "steps", "root", F.col("node").alias("subroot")), "merkle-tails")
    found = _descend(rounds, tails, ["root", "subroot"])
    return found.select(F.col("row.key").alias(key), *[F.col(f"row.{n}").alias(n) for n in carry], F.col("node").alias("leaf"), "subroot", "root",
                        F.col("steps").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to along its proof."""
    climb = lambda node, s: F.sha2(F.concat(F.substring_index(s, ":", 1), node, F.substring_index(s, ":", -1)).cast("binary"), 256)
    return F.aggregate(F.filter(F.split(proof, ","), lambda s: s != ""), leaf, climb)


def siblings(proof: Column) -> Column:
    """All siblings of a proof, from the leaf's up, left to right, without separators."""
    return F.translate(proof, ":,", "")
