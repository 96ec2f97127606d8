"""The registered queries of this subpackage: each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bpe, decontaminate, jaccard, language, merkle, packing, pii, quality_classifier, quality_rules, toxicity, urls, warc, whitening
from tracefold.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


B32 = " || ".join(
    f"translate(to_base(('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for i in range(4))


@query("op3_warc_revisits", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {B32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f""")
def op3(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op6_bpe")
def op6(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), digest=True, keep=["doc_id"])


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op8_decontaminate", rf"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     d AS (SELECT doc_id, regexp_extract_all(t, '{ALNUM}') AS w FROM lowered),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w FROM benchmark),
     items AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
     grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
               FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
     sizes AS (SELECT DISTINCT k FROM grams),
     places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
                FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
     hits AS (SELECT doc_id, i, p.k, item_id FROM places p JOIN grams USING (k, g)),
     hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
     hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id""")
def op8(spark, sf_dir):
    found = decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


@query("op9_quality_rules")
def op9(spark, sf_dir):
    v = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return v.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op2_pii")
def op2(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


@query("op7_url_filter")
def op7(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, ["doc_id"])
    held = F.coalesce(remainder(F.col("row.doc_id"), 4) == 2, F.lit(False))
    return scored.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op4_language")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_ngram_jaccard")
def op5(spark, sf_dir):
    return jaccard.groups(table(spark, sf_dir, "documents"))


@query("op13_packing")
def op13(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def fields(*names: str, text: str = "text") -> str:
    one = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    return " || ".join(one.format(text if n == "text" else n) for n in names)


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


@query("op11_merkle", f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({fields(*LEAF)}) AS leaf, sha256({fields(*LEAF, text="replace(text, chr(10), '')")}) AS other FROM documents),
     placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
     nodes AS (SELECT source, 0 AS lvl, pos, n, leaf AS h FROM placed UNION ALL
               SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, lvl, n, pos // 3),
     subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
     tops AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM subs UNION ALL
              SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, n, pos // 3),
     low AS (SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
             FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
     high AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                     coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
              FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2),
     levels AS (SELECT source, max(lvl) AS last FROM nodes GROUP BY 1),
     bits AS (SELECT DISTINCT doc_id, list_reduce([4294967295] || flatten(list_transform(range(strlen(doc_id::VARCHAR)),
                         lambda i: [ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS c FROM documents),
     climb AS (SELECT p.doc_id, p.source, p.pos, 0 AS lvl, p.leaf, '' AS proof, CASE WHEN b.c % 2 = 1 THEN p.other ELSE p.leaf END AS h
               FROM placed p LEFT JOIN bits b ON b.doc_id = p.doc_id UNION ALL
               SELECT c.doc_id, c.source, c.pos // 3, c.lvl + 1, c.leaf, proof || l || r, sha256(l || c.h || r)
               FROM climb c JOIN low ON low.source IS NOT DISTINCT FROM c.source AND low.lvl = c.lvl AND low.pos = c.pos),
     rise AS (SELECT c.doc_id, c.leaf, s.subroot, 0 AS lvl, s.pos, proof, c.h FROM climb c JOIN levels e ON e.source IS NOT DISTINCT FROM c.source AND e.last = c.lvl
              JOIN subs s ON s.source IS NOT DISTINCT FROM c.source UNION ALL
              SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.pos // 3, proof || l || r, sha256(l || c.h || r)
              FROM rise c JOIN high ON high.lvl = c.lvl AND high.pos = c.pos)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM rise c JOIN tops t ON t.n = 1 AND t.lvl = c.lvl""")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    other = F.when(remainder(F.col("doc_id"), 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.manifest(docs, merkle.leaf_of(*map(F.col, LEAF)),
                           tampered=F.when(other != F.col("text"), merkle.leaf_of(*map(F.col, LEAF[:-1]), other)))
    back = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return rows.withColumn("folded_root", back).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
