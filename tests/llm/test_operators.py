"""Each operator against a plain form on small rows: nulls, empty and long texts, repeated rows, clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import bpe, decontaminate, jaccard, language, pii, quality_classifier, quality_rules, toxicity, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
ITEM = "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
TEXTS = [None, "", " \n\t", "word", BASE, BASE, BASE.upper() + " nineteen", BASE + " extra", "x " + ITEM + " y " + ITEM,
         "filler " * 400 + ITEM, "a b c d e a b c d e\nsame line\nsame line\n \n", "mail a.b@c.example.com, 10.0.0.300 and 10.0.0.3",
         "card 4111 1111 1111 1111 or 4111 1111 1111 1112, +1 (555) 010-9999 +12", "É ñ <|endoftext|> can't 12²!! ΑΣ\u001c x", "z" * 3000,
         "1" * 30000 + " " + "a@" * 5000, "w%d " * 3000, "q r s t"]
ROWS = [(i, t, None if i % 7 == 3 else "en", "src", 0, "clash") for i, t in enumerate(TEXTS)] + [(4, BASE, "en", None, 0, "clash"), (None, BASE, "en", "src", 0, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_statistics(docs, none):
    got = [tuple(r)[1:] for r in quality_rules.statistics(docs).collect()]
    want = []
    for _, t, *_ in ROWS:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines), len(lines) - len(set(lines)), len(again)))
    assert Counter(got) == Counter(want)
    assert quality_rules.keep_good(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect())[BASE] == 4  # groups below 60 rows have no estimate


def test_quality_outliers(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}x" for k in range(30)), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join(f"{k}##$$%%" for k in range(30)), "en", "s") for i in range(5)]
    found = {r["row"]["doc_id"]: r["kept"] for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i] for i in range(200)) and not any(found[1000 + i] for i in range(5))


def test_small_groups_are_judged(spark):
    text = lambda i: " ".join(f"w{(i * 7 + k) % 50}x" for k in range(30))
    junk = " ".join(f"{k}##$$%%" for k in range(30))
    rows = [(i, text(i), "en", f"s{i // 70}" if i < 140 else "few") for i in range(144)] + [(1000, junk, "en", "few")]  # a group of five
    rows += [(2000 + i, text(i), "es", f"t{i // 9}") for i in range(63)] + [(3000, junk, "es", "t0")]                  # a language of small groups
    rows += [(4000 + i, text(i), None, None) for i in range(4)] + [(5000, junk, None, None), (6000, junk, "fr", "s0"), (7000, "too short", "eo", "z")]
    found = {r["row"]["doc_id"]: r for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.distance is not None for r in found.values())
    assert {i for i, r in found.items() if not r.kept} == {1000, 3000, 5000, 6000, 7000}


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, ITEM), (2, "Q r S"), (3, None), (4, ""), (10, "q R s!"), (None, "nobody has this")], "item_id long, text string")
    got = {(r["row"]["doc_id"], r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.spans(docs, bench).collect()}
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = [(i, tuple(w[k:k + min(13, len(w))])) for i, t in [(1, ITEM), (2, "Q r S"), (10, "q R s!")] for w in [low(t)] for k in range(len(w) - min(13, len(w)) + 1)]
    want = set()
    for d, t, *_ in ROWS:
        w = low(t)
        hits = [(k, len(g), i) for i, g in grams for k in range(len(w) - len(g) + 1) if tuple(w[k:k + len(g)]) == g]
        want.add((d, len(w), len({j for k, n, _ in hits for j in range(k, k + n)}), tuple(sorted({str(i) for *_, i in hits}))))
    assert got == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {8, 17}
    assert decontaminate.spans(none, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_personal_data(docs, none):
    chosen = pii.Selector(pii.training_spans(docs))
    got = [(r["row"]["doc_id"], r.b) for r in pii.find(docs, ["doc_id"], chosen).select("row", pii.listed(F.col("base")).alias("b")).collect()]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15
    want = [(d, ",".join(f"{k}:{m.start()}:{m.end()}" for k in patterns for m in re.finditer(patterns[k], t or "") if valid(k, m.group()))) for d, t, *_ in ROWS]
    assert Counter(got) == Counter(want)
    clean = {r.doc_id: r for r in pii.redact(docs, selector=chosen).collect()}
    assert clean[11].text == "mail [EMAIL], 10.0.0.300 and [IP]" and clean[0].text is None and clean[12].n_words == "clash"
    assert pii.redact(none).count() == 0


def test_personal_data_is_learnt_from_all_documents(spark):
    rows = spark.range(0, 20_400, 1, 2).select(F.concat(F.lit("token=a"), F.col("id"), F.lit(" and b"), F.col("id")).alias("text"))
    spans = pii.training_spans(rows)
    assert {r["label"]: r["count"] for r in spans.groupBy("label").count().collect()} == {0: 20_400, 1: 20_400}
    trees = pii.Selector(spans)
    found = pii.find(rows.limit(5), ["text"], trees).select(F.explode("spans").alias("s"), F.col("row.text").alias("t")).collect()
    assert len(found) == 5 and all(r.t.startswith("token=" + r.s.text) for r in found)


def test_generators_take_whole_numbers_and_tokens(spark):
    whole = {"number": ["01234567890", "12345678901", "98765 43210", "07700 900123", "030 1234567", "0171 1234567", "1-800-555-1234", "(030) 1234567",
                        "+123 456", "1 2 3 4 5 6 7 8 9", "1234567890" * 30, "12"],
             "secret": ["a1" * 101, "sk-abc-1_x-9", "AKIA-99", "0x7_", "p4ss", "-k1-"],
             "address": ["a" * 70 + "@host", "joe @ mail.example.org", "x@y", "a@" + "b" * 70]}
    texts = [(k, x, t) for k, xs in whole.items() for x in xs for t in (x, f"see {x}, or", f"({x})" if "(" not in x else f"a{x}")]
    texts += [("number", "555 1234", "at 555 1234 2nd floor"), ("number", "555", "tel.555x 555;"), ("secret", None, "12-34 only-letters 5 --- 77")]
    rows = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "i int, t string")
    found = rows.select("i", F.explode(F.concat(*[pii._proposals(F.col("t"), k, h, p) for k, (h, p) in pii.MORE.items()])).alias("s"))
    got = {}
    for r in found.collect():
        got.setdefault((r.i, r.s.kind), []).append(r.s.text)
    for i, (k, x, t) in enumerate(texts):
        assert [y.strip("()") for y in got.get((i, k), [])] == ([] if x is None else [x.strip("()")]), (k, t, got.get((i, k)))

    def plain(t):  # numbers by hand: runs of digits that touch no letter, joined while at most ')', a separator and '(' stand between
        runs = [m.span() for m in re.finditer("[0-9]+", t) if not re.match("[A-Za-z]", t[m.end():]) and not re.search("[A-Za-z]$", t[:m.start()])]
        joined = []
        for a, b in runs:
            if joined and t[joined[-1][1]:a] in {c + s + o for c in ("", ")") for s in ("", " ", ".", "/", "-") for o in ("", "(")}:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        return [re.sub("[^0-9]", "", t[a:b]) for a, b in joined]
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("0123456789  ..--()/a+,"), 40)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(noise)), "i int, t string")
    for r in rows.select("t", pii._proposals(F.col("t"), "number", *pii.MORE["number"]).alias("s")).collect():
        assert [re.sub("[^0-9]", "", x.text) for x in r.s] == plain(r.t), r.t


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, digest=True).collect()]
    want = []
    for d, t, *_ in ROWS:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(got) == Counter(want)
    back = bpe.decode(bpe.encode(docs).withColumnRenamed("decoded_text", "before")).collect()
    assert all(r.before == r.decoded_text for r in back) and bpe.encode(none).count() == 0


def test_bpe_merges_the_new_words_of_many_texts_together(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = [*TEXTS, *(f"Word{i}, wörd{i}! x<|endoftext|>\u001cY{i}.\u1e9b\u0323 ΑΣ ΣΑΣ can't <|startoftext|> 'll{i}" for i in range(300)), None, "a " * 50]
    want = [(len(e.ids), " ".join(map(str, e.ids)), plain.decode(e.ids, skip_special_tokens=False))
            for e in (plain.encode(t or "", add_special_tokens=False) for t in texts)]
    codec, merged = bpe.Bpe(bpe.default_path()), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda pieces: merged.append(pieces) or merge(pieces))
    assert list(codec.encode_all(texts)) == want
    assert len(merged) == 1 and len(set(merged[0])) == len(merged[0])
    monkeypatch.setattr(bpe, "MEMO", 20)
    for size in (1, 40, 2000):
        monkeypatch.setattr(bpe, "GROUP", size)
        assert list(codec.encode_all(texts)) == want
    codec.forget()
    assert [codec.encode(t) for t in texts] == want


def test_jaccard(spark, docs, none):
    shared = [f"s{k}" for k in range(120)]
    rows = [(100 + i, " ".join([*shared[:120 - i], *(f"own{i}_{k}" for k in range(i))])) for i in range(40)]
    rows += [(200 + i, " ".join(f"v{k if k % 97 else -i}" for k in range(3000))) for i in range(4)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = []
    for r in every.collect():
        w = (r.text or "").encode().lower().split()
        sets.append((r.doc_id, frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])))
    links = [(i, j) for i, (_, a) in enumerate(sets) for j, (_, b) in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b)]
    top = list(range(len(sets)))
    for _ in sets:
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
    least = {t: min((sets[i][0] for i in range(len(sets)) if top[i] == t and sets[i][0] is not None), default=None) for t in top}
    want = Counter((d, len(s), least[top[i]]) for i, (d, s) in enumerate(sets))
    # small tiles are dealt into blocks, those of shingles known to be frequent by bands of sizes
    for tile, sample in ((jaccard.TILE, jaccard.SAMPLE), (5, jaccard.SAMPLE), (4, 1)):
        join = jaccard.Join(every, tile=tile, sample=sample)
        assert (join.live.agg(F.max("blocks")).first()[0] > 1) == (sample == 1)
        got = join.members().collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.groups(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.text for r in kept.collect())[BASE] == 1  # ids 4, 4, 5 and null


def test_keep_one_by_any_id(spark):
    rows = [("b", BASE, 1), ("a", BASE, 2), (None, BASE, 3), ("a", BASE + " extra", 4), ("c", None, 5), ("c", "", 6), (None, None, 7), (None, None, 7),
            (None, ITEM, 8), (None, ITEM, 9), (None, ITEM + " pi", 10)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id string, text string, __other int"))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got.pop(("a", BASE), 0) + got.pop(("a", BASE + " extra"), 0) == 1
    assert got.pop((None, ITEM), 0) + got.pop((None, ITEM + " pi"), 0) == 1
    assert got == Counter({("c", None): 1, ("c", ""): 1, (None, None): 2})


def test_documents_without_copies_stay_in_place(spark, monkeypatch):
    """However large the files of the ids to drop: only documents that share a hash with one of them are moved."""
    rows = [(i, f"{BASE} {i % 40} {' '.join(f'u{i % 40}_{k}' for k in range(30))}") for i in range(50)] + [(49, None), (50, ""), (1, "zz")]
    rows += [(7, rows[7][1])] * 2  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([*rows[:40], *rows[50:53]])
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    try:
        for marks in (jaccard.MARKS, 0):
            monkeypatch.setattr(jaccard, "MARKS", marks)
            kept = jaccard.keep_one(docs)
            assert Counter(tuple(r) for r in kept.collect()) == want
            assert ("BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()) == (marks > 0)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 50, 1500, 4000):
        a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[n // 10:], b[:n // 5]]))
        x, y = (np.frombuffer(jaccard.bitmap(v), np.uint64) for v in (a, b))
        assert jaccard._apart(x, y) <= len(np.setxor1d(a, b))


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (2, None, None), (5, "http://c/", ""), (4, "http://d/", "a\r\n\r\nWARC/1.1\r\né"), (4, "http://d/", "a\r\n\r\nWARC/1.1\r\né")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.archive(pages, path=str(tmp_path / "w")).collect())
    b32 = lambda t: warc._b32(hashlib.sha1((t or "").encode()).digest())
    first = {}
    for p, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", p)
    want = Counter((p, len((h or "").encode()), b32(h), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in rows)
    assert got == want
    back = {r.page_id: (r.url, r.payload.decode()) for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert back[4] == ("http://d/", "a\r\n\r\nWARC/1.1\r\né") and back[2][0] is None
    assert warc.archive(pages.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.net/x"), (2, "https://m.example.net/en/1?q#f"), (3, None), (4, "no scheme"), (5, "http://www.example.com/de/"), (6, "x://ORG/fr/"), (7, "http://borg/fr/"), (8, "http://net")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[5][2:] == ("example.com/de/", "block") and got[6] == ("org", "/fr/", "org/fr/", "allow")
    assert got[7][2] is None and got[8][:3] == ("net", "", None) and {v[3] for v in got.values()} <= {"allow", "block"}


def test_blocks_are_skipped_and_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    part = lambda i: [f"{'abcd'[i % 4]}{int(rng.zipf(1.3)) % 200}" for _ in range(12 + i % 9)]
    rows = [(i, " ".join(part(i) + (["vile"] if i % 10 == 0 else [])), int(i % 10 == 0)) for i in range(1200)]
    index = toxicity.build(rows, block=16)
    blocks, wide, _ = index.lists.shape
    held = [index.vector(toxicity._tokens(t)) for _, t, _ in rows]
    vectors = np.zeros((len(rows), len(index.terms)))
    for e, (at, v) in enumerate(held):
        vectors[e, at] = v
    found, visited = index.search(held[::7] + [held[0]])
    for e, (cosines, which) in zip([*range(0, len(rows), 7), 0], found):
        plain = vectors @ vectors[e]
        assert np.allclose(cosines, np.sort(plain)[::-1][:15], atol=1e-9)
        assert np.allclose(plain[index.number[which]], cosines, atol=1e-9) and list(which) == sorted(which, key=lambda x: (-plain[index.number[x]].round(10), index.number[x]))
    assert visited.max() <= blocks and visited.mean() < 0.6 * blocks
    alone = [index.search([q])[0][0] for q in held[:40:7]]  # the same whatever else is searched at the same time
    assert all(list(a[0]) == list(b[0]) and list(a[1]) == list(b[1]) for a, b in zip(alone, found))
    assert index.weigh[index.terms["vile"]] > 3 * index.weigh[index.terms["a1"]]  # tied to the label


def test_toxicity_score_is_the_calibrated_vote(spark):
    rng = np.random.default_rng(5)
    text = lambda i: " ".join([f"w{rng.integers(50)}" for _ in range(15)] + (["vile", "rotten"] if i % 6 == 0 else []))
    rows = [(i, text(i), int(i % 6 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t, _ in rows] + [(500, rows[6][1], None, None), (501, "nothing alike", None, None)],
                                 "doc_id long, text string, evidence string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    learned = sorted((i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5)
    assert sorted(zip(index.ids, index.labels.astype(int).tolist())) == learned
    place = {i: e for e, i in enumerate(index.ids)}
    bags = {i: index.vector(toxicity._tokens(t)) for i, t, _ in rows}
    dense = lambda q: np.bincount(q[0], q[1], len(index.terms))
    examples = {i: dense(bags[i]) for i in index.ids}
    got = {r.doc_id: r for r in toxicity.score(docs, index, ["doc_id", "evidence"]).collect()}
    for i, t, _ in rows + [(500, rows[6][1], None)]:
        q = dense(index.vector(toxicity._tokens(t)))
        near = sorted(((q @ v).round(10), e) for e, v in examples.items())[::-1][:15]
        w = np.array([1 / (1.05 - min(s, 1.0)) for s, _ in near])
        vote = (w @ index.labels[[place[e] for _, e in near]] + index.prior) / (w.sum() + 1)
        if near[-1][0] > sorted((q @ v).round(10) for v in examples.values())[-16]:  # no tie at the end
            assert np.isclose(got[i].score, 1 / (1 + np.exp(-(index.slope * vote + index.shift))), atol=1e-6)
            assert sorted(got[i].evidence) == sorted(str(e) for _, e in near)
    assert got[501].score == index.alone and got[501].evidence == []
    held = [(got[i].score >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == bool(y) for p, y in held) >= 0.9 * len(held)


def test_nearest_examples_are_over_all_terms():
    rng = np.random.default_rng(3)
    word = lambda y: f"bad{rng.integers(9)}" if y and rng.random() < 0.5 else f"w{int(rng.zipf(1.3)) % 4000}"
    rows = [(i, " ".join(word(i % 6 == 0) for _ in range(5 + i % 40)), int(i % 6 == 0)) for i in range(400)]
    rows += [(900, rows[7][1], 1), (901, None, 0), (902, "only here", 1)]  # one more of a text, with the other label
    queries = [t for _, t, _ in rows[::9]] + ["only here and nowhere else", rows[7][1] + " new words of no example", "unseen", "", None]
    index = toxicity.build(rows)
    bags = [Counter(re.findall(r"\w+", t or "")) for _, t, _ in rows]
    df = Counter(w for b in bags for w in b)
    toxic, n = Counter(w for b, (_, _, y) in zip(bags, rows) if y for w in b), len(rows)
    p = sum(y for _, _, y in rows) / n
    errors = {w: max(abs(toxic[w] - p * d) - 1, 0) / np.sqrt(p * (1 - p) * d * (n - d) / (n - 1)) for w, d in df.items() if d < n}
    factor = lambda w: 1 + 2 * max(errors.get(w, 0) - 5, 0)
    weigh = lambda b: {w: (1 + np.log(c)) * (np.log((1 + n) / (1 + df[w])) + 1) * factor(w) for w, c in b.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values())) or 1.0
    vectors = [weigh(b) for b in bags]
    for index in (index, toxicity.build(rows, block=64)):
        for t in queries:
            q = weigh(Counter(re.findall(r"\w+", t or "")))
            plain = [sum(x * v.get(w, 0.0) for w, x in q.items()) / norm(q) / norm(v) for v in vectors]
            found = index.nearest(toxicity._tokens(t))
            best = sorted((round(-s, 9), i) for i, s in enumerate(plain) if s > 0)[:15]
            assert np.allclose([s for s, _ in found], [-s for s, _ in best]) and {index.ids[i] for _, i in found[:1]} <= {rows[i][0] for s, i in best if s - best[0][0] < 1e-8}


def test_toxicity_and_language(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2), 1) for i in range(18)] + [(None, 1, None)], "doc_id long, toxic int, quality int")
    for index in (toxicity.fit(docs, labels), toxicity.fit(none, labels)):
        found = toxicity.score(docs, index, docs.columns).collect()
        assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    model = language.fit(docs)
    found = {r.doc_id: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert found[0].lang_pred == found[1].lang_pred == "und" and found[4].lang_pred == "en"
    assert all(r.lang_pred == "und" for r in language.predict(docs, language.fit(none), ["doc_id"]).collect())
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels), ["doc_id"]).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)


def test_forward_sums_all_segmentations():
    model = language.Model(["a", "b", "ab", "ba", "aba"], ["x"])
    model.table[:5, 0] = [0.3, 0.2, 0.1, 0.25, 0.15]
    a, b, ab, ba, aba = model.table[:5, 0]
    assert np.isclose(model.forward(["aba"])[-1][0, 0], a * b * a + ab * a + a * ba + aba)


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.count() <= docs.count() and after.count() > 0
        assert after.columns[:len(docs.columns)] == docs.columns
        docs = after
