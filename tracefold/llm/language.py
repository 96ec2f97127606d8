"""Language identification by unigrams of pieces, with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary.  A forward pass over a word adds up the chance of all
its segmentations into pieces; a text's score is the sum over its words.  The pieces' probabilities come from
expectation maximisation over a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import extended, remainder

#: Documents a language that the fit reads, at most; rounds; the longest stretch that pieces are summed over; memo size.
DOCUMENTS, ROUNDS, STRETCH, MEMO = 250, 3, 24, 400_000
SMOOTH, UNKNOWN = 0.05, 1e-7
WORD = re.compile(r"[^\W\d_]+")
LONG = 1 << 20


def pieces(path: str | None = None) -> list[str]:
    """The vocabulary's pieces without marks of word starts and special pieces, lower-cased, distinct and sorted."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = (sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_byte(i))
    return sorted({p for p in found if p and WORD.fullmatch(p) and len(p) <= STRETCH})


def stretches(text: str | None) -> list[str]:
    """Lower-cased words of letters, cut into stretches of 24 letters at most."""
    out = []
    for w in WORD.findall((text or "").lower()):
        out.extend((w,) if len(w) <= STRETCH else (w[i:i + STRETCH] for i in range(0, len(w), STRETCH)))
    return out


class Model:
    def __init__(self, vocabulary: list[str], languages: list[str]):
        self.number = {p: i for i, p in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)
        self.languages = languages
        # the last two rows: no such piece, and a letter that the vocabulary lacks
        self.table = np.full((len(vocabulary) + 2, len(languages)), 1 / max(1, len(vocabulary)))
        self.table[-2], self.table[-1] = 0, UNKNOWN
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def _lattice(self, words: list[str]):
        """For words of one length: the piece's row for each start and end."""
        n, none, get = len(words[0]), len(self.table) - 2, self.number.get
        out = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                ids = np.array([get(w[i:j], none) for w in words], np.int64)
                if j == i + 1:
                    ids[ids == none] = none + 1
                if j == i + 1 or (ids != none).any():
                    out[i, j] = ids
        return out

    def forward(self, words: list[str], lattice=None) -> np.ndarray:
        """alpha[position, word, language]; the last position is the chance of the word."""
        n = len(words[0])
        lattice = lattice or self._lattice(words)
        alpha = np.zeros((n + 1, len(words), len(self.languages)))
        alpha[0] = 1
        for (i, j), ids in sorted(lattice.items()):
            alpha[j] += alpha[i] * self.table[ids]
        return alpha

    def fit(self, counts: dict[str, np.ndarray], rounds: int = ROUNDS) -> None:
        """``counts``: occurrences of each stretch by language."""
        by: dict[int, list[str]] = {}
        for w in sorted(counts):
            by.setdefault(len(w), []).append(w)
        groups = [(ws[i:i + 4096]) for ws in by.values() for i in range(0, len(ws), 4096)]
        lattices = [self._lattice(g) for g in groups]
        for _ in range(rounds):
            got = np.zeros_like(self.table)
            for g, lattice in zip(groups, lattices):
                c = np.stack([counts[w] for w in g])
                alpha = self.forward(g, lattice)
                beta = np.zeros_like(alpha)
                beta[-1] = 1
                for (i, j), ids in sorted(lattice.items(), reverse=True):
                    beta[i] += self.table[ids] * beta[j]
                share = c / np.maximum(alpha[-1], 1e-300)
                for (i, j), ids in lattice.items():
                    np.add.at(got, ids, alpha[i] * self.table[ids] * beta[j] * share)
            got = got[:-2] + SMOOTH
            self.table[:-2] = got / got.sum(0)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Log chance of each word by language, through a bounded memo."""
        if len(self.memo) > MEMO:
            self.memo, self.rows = {}, np.zeros((0, len(self.languages)))
        new = list({w for w in words if w not in self.memo})
        by: dict[int, list[str]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        parts = [self.rows]
        for ws in by.values():
            for i in range(0, len(ws), 4096):
                g = ws[i:i + 4096]
                parts.append(np.log(self.forward(g)[-1]))
                for w in g:
                    self.memo[w] = len(self.memo)
        if len(parts) > 1:
            self.rows = np.concatenate(parts)
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def score(self, batches: list[list[str]]) -> list[tuple[str, float]]:
        out = []
        flat = [w for b in batches for w in b]
        at = self.look_up(flat) if flat else np.zeros(0, np.int64)
        lo = 0
        for b in batches:
            if not b or not self.languages:
                out.append(("und", 0.0))
                continue
            total = self.rows[at[lo:lo + len(b)]].sum(0)
            lo += len(b)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(docs: DataFrame, documents: int = DOCUMENTS, path: str | None = None) -> Model:
    """Learn from text and non-null lang of documents whose crc32(doc_id) modulo 4 is not 2, ``documents`` a language at most."""
    known = docs.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, int((1 << 20) * min(1.0, documents / n)) + 1).otherwise(limit)
    some = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) < limit).select("lang", "text")

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen.setdefault(lang, Counter()).update(stretches(text))
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    rows = some.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    languages = sorted(sizes)
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["word"], np.zeros(len(languages)))[languages.index(r["lang"])] += r["n"]
    model = Model(pieces(path), languages)
    if counts:
        model.fit(counts)
    return model


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns (except those named like the new ones), lang_pred and score, the chance among the learned languages.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.  Ties go to the first language in order.
    """
    new = ["lang_pred", "score"]
    held = [c for c in keep if c not in new]
    schema = extended(docs, held, "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            found, group, size = [], [], 0
            for t in batch.column("__text").to_pylist():
                group.append(stretches(t))
                size += len(group[-1])
                if size > LONG // 8:
                    found += m.score(group)
                    group, size = [], 0
            found += m.score(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], [*held, *new])

    return docs.select(*held, docs[text].alias("__text")).mapInArrow(run, schema)
