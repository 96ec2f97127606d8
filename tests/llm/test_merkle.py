"""The Merkle manifest against plain recursion, its layout, and edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracefold.llm import merkle
from tracefold.llm.queries import LEAF, QUERIES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        run = i - i % 3
        yield "".join(level[run:i]), "".join(level[i + 1:run + 3])
        i //= 3


def leaf(d):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"])))


def plain(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d["source"], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for found in groups.values():
        found.sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"], leaf(d)))
    trees = {s: tree([leaf(d) for d in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, d in enumerate(groups[s]):
            path, cur = [*steps(trees[s], i), *steps(top, k)], leaf(d)
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and d["text"] is not None:
                cur = leaf({**d, "text": d["text"].replace("\n", "")})
            for left, right in path:
                cur = h(left + cur + right)
            out.append((d["doc_id"], leaf(d), trees[s][-1][0], root, h("".join(a + b for a, b in path)), cur, cur == root))
    return sorted(out, key=str)


def query_over(spark, docs, folder):
    spark.createDataFrame([tuple(d[c] for c in (*LEAF[:3], "n_chars", "text")) for d in docs],
                          "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, QUERIES["op11_merkle"](spark, str(folder)).collect()), key=str)


DOCS = [dict(doc_id=i, source=["a", "é", None, "Z", "hot", "hot", "hot"][i % 7], lang=None if i % 5 == 0 else "en", n_chars=None if i % 11 == 0 else i,
             text=None if i % 13 == 0 else "" if i % 17 == 0 else f"line ü {i}\nline\n") for i in range(200)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_query_equals_recursion(spark, tmp_path, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** height)
    docs = [*DOCS, DOCS[1], DOCS[1], {**DOCS[1], "text": "other"}, {**DOCS[2], "doc_id": None}, {**DOCS[2], "doc_id": None, "text": "x" * 100_000}]
    assert query_over(spark, docs, tmp_path) == plain(docs)


def test_single_rows_and_empty_tables(spark, tmp_path):
    assert query_over(spark, DOCS[1:2], tmp_path / "one") == plain(DOCS[1:2])
    assert query_over(spark, [], tmp_path / "none") == []


def test_query_over_the_given_table(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_merkle"](spark, sf).collect()), key=str) == plain(docs)


def test_clashing_columns_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "s", "t", "r", 5), (2, "s", "u", "r", 6)], "doc_id long, source string, text string, root string, n long")
    rows = merkle.manifest(docs, merkle.leaf_of(F.col("text")), kept=F.col("n"), pos=F.col("root")).collect()
    assert {(r.doc_id, r.kept, r.pos) for r in rows} == {(1, 5, "r"), (2, 6, "r")}
    a, b = h("1:t"), h("1:u")
    assert {(r.leaf, r.proof, r.subroot, r.root) for r in rows} == {(a, f":{b}", h(a + b), h(a + b)), (b, f"{a}:", h(a + b), h(a + b))}


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 7])
def test_layout_is_a_permutation_that_keeps_subtrees_together(levels):
    places = [[merkle.address(levels, depth, i) for i in range(3 ** depth)] for depth in range(levels)]
    assert sorted(a for p in places for a in p) == list(range(merkle.nodes_in(levels)))
    top = levels // 2
    if top:
        assert sorted(a for p in places[:top] for a in p) == list(range(merkle.nodes_in(top)))
        below = levels - top
        for subtree in range(3 ** top):
            held = sorted(a for d in range(below) for a in places[top + d][subtree * 3 ** d:(subtree + 1) * 3 ** d])
            assert held == list(range(held[0], held[0] + merkle.nodes_in(below)))


def test_folding_a_changed_leaf_misses_the_root(spark):
    docs = spark.createDataFrame([(i, "s", str(i)) for i in range(10)], "doc_id long, source string, text string")
    rows = merkle.manifest(docs, merkle.leaf_of(F.col("text")))
    good = merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")
    bad = merkle.folded(F.sha2(F.lit("no").cast("binary"), 256), F.col("proof")) == F.col("root")
    assert rows.select(F.min(good), F.max(bad)).first() == (True, False)
