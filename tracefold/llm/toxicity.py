"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled examples with all their terms, in blocks of examples that share their
common words.  Lists of rare terms are short and added up whole.  Of the long lists of common terms a query first reads only each
block's largest weight, which bounds what they can add in that block.  It follows them into the blocks of the highest bounds, and
then only into those whose bound still reaches the k-th best cosine found, so the nearest are exact over whole texts on
both sides.  Queries are searched some at a time, and those that visit a block share the reading of it.  A term's weight is tf-idf times a factor that grows with its tie to the label among the examples; queries
and examples are weighted alike.  The neighbours' votes, weighted by distance and calibrated, are the score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, fields
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import bounded, extended, remainder

#: Labelled examples in the index, at most; neighbours; examples a block; blocks of the first visit; queries searched at a time.
EXAMPLES, NEAREST, BLOCK, VISIT, TOGETHER = 8_000, 15, 32, 24, 256
#: Terms whose lists are cut into blocks: in this part of the examples or more, the most common ones first, so many at most.
COMMON, TERMS = 0.04, 768
#: Of a term's factor: what each standard error beyond the least one adds.
GAIN, LEAST = 2.0, 5.0
#: Sums depend a little on their order: cosines are rounded to so many digits, and a bound may lie so far below one.
DIGITS, SLACK = 10, 1e-9
WORD = re.compile(r"\w+")
CHUNK = 1 << 20


def _tokens(text: str | None) -> dict[str, int]:
    """Counts of a text's terms, read in parts that end at white space."""
    found: Counter = Counter()
    text, at = (text or "").lower(), 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not text[end].isspace():
            end += 1
        found.update(WORD.findall(text, at, end))
        at = end
    return found


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


@dataclass
class Index:
    """Examples as bags of words, from which each process arranges the lists for itself: only the bags are sent to it."""

    terms: dict[str, int]
    weigh: np.ndarray   # a term's idf times its factor
    ids: list
    labels: np.ndarray
    number: np.ndarray  # an example's place among the examples as given; of equal cosines the smaller goes first
    row: np.ndarray     # of a common term, else -1
    starts: np.ndarray  # of each example: its first term in ``bag``; one more at the end
    bag: np.ndarray
    counts: np.ndarray
    prior: float
    block: int
    slope: float = 1.0
    shift: float = 0.0
    alone: float = 0.0
    shared = None       # the broadcast of this index, if there is one
    lists = None        # until the first search

    def _arrange(self):
        n, block, term, row = len(self.ids), self.block, self.bag, self.row
        example = np.repeat(np.arange(n), np.diff(self.starts))
        weight = (1 + np.log(self.counts)) * self.weigh[term]
        norms = np.array([np.sqrt((w * w).sum()) for w in np.split(weight, self.starts[1:-1])]) if n else np.zeros(0)
        self.held = weight = weight / norms[example]
        often = row[term] >= 0
        # [block, example of the block, row]: a common term's weights; [row, block]: the largest of these in the block
        self.lists = np.zeros((-(-n // block), block, int(row.max(initial=-1)) + 1))
        self.lists[example[often] // block, example[often] % block, row[term[often]]] = weight[often]
        self.tops = self.lists.max(1).T.copy()
        # of the other terms, one list after another
        by = np.argsort(term[~often], kind="stable")
        self.start = np.searchsorted(term[~often][by], np.arange(len(self.terms) + 1))
        self.entries, self.weights = example[~often][by], weight[~often][by]

    def __getstate__(self):
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms, ascending, and their weights; unknown terms count in the norm as seen in no example."""
        at = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        order = np.lexsort((n, at))
        at, n = at[order], n[order]
        new = int(np.searchsorted(at, 0))
        at = at[new:]
        v = (1 + np.log(n)) * np.concatenate([np.full(new, np.log(1 + len(self.ids)) + 1), self.weigh[at]])
        return at, v[new:] / np.sqrt((v * v).sum()) if len(v) else v

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST, skip: list[int] | None = None) -> tuple[list, np.ndarray]:
        """Of each query the cosines and examples of the k nearest with a cosine above 0, ties by the order given, and the blocks visited.

        ``skip`` names one example for each query that is left out.
        """
        if self.lists is None:
            self._arrange()
        blocks, wide, _ = self.lists.shape
        scores = np.zeros((len(queries), blocks, wide))
        common = np.zeros((len(queries), len(self.tops)))
        for q, (at, v) in enumerate(queries):
            row = self.row[at]
            long = row >= 0
            common[q, row[long]] = v[long]
            rare = at[~long]
            begin = self.start[rare]
            size = self.start[rare + 1] - begin
            lists = _ranges(begin, size)
            scores[q] = np.bincount(self.entries[lists], self.weights[lists] * np.repeat(v[~long], size), blocks * wide).reshape(blocks, wide)
        bounds = scores.max(2, initial=0) + common @ self.tops
        flat = scores.reshape(len(queries), -1)
        visited = np.zeros(bounds.shape, bool)
        least = np.full(len(queries), SLACK)
        for last in (False, True):
            mask = ~visited & (bounds >= least[:, None] - SLACK) & (bounds > 0)
            if not last and blocks > VISIT:
                highest = np.argpartition(bounds, -VISIT, axis=1)[:, -VISIT:]
                some = np.zeros_like(mask)
                np.put_along_axis(some, highest, True, axis=1)
                mask &= some
            for b in np.flatnonzero(mask.any(0)):
                who = np.flatnonzero(mask[:, b])
                scores[who, b] += common[who] @ self.lists[b].T
            visited |= mask
            if not last:
                if skip is not None:
                    flat[np.arange(len(queries)), skip] = -1
                if blocks > VISIT:
                    seen = np.take_along_axis(scores, highest[:, :, None], axis=1).reshape(len(queries), -1)
                else:
                    seen = flat
                if seen.shape[1] >= k:
                    least = np.maximum(np.partition(seen, -k, axis=1)[:, -k], 0)
        if skip is not None:
            flat[np.arange(len(queries)), skip] = -1
        out = []
        for q in range(len(queries)):
            which = np.flatnonzero((flat[q] > 0) & (flat[q] >= least[q] - SLACK) & np.repeat(visited[q], wide))
            cosines = flat[q, which].round(DIGITS)
            near = np.lexsort((self.number[which], -cosines))[:k]
            out.append((cosines[near], which[near]))
        return out, visited.sum(1)

    def nearest(self, counts: dict[str, int], k: int = NEAREST) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a cosine above 0; ties go to the example given first."""
        (best, which), = self.search([self.vector(counts)], k)[0]
        return list(zip(best.tolist(), which.tolist()))

    def vote(self, cosines: np.ndarray, examples: np.ndarray) -> float:
        weights = 1 / (1.05 - np.minimum(cosines, 1.0))
        return float((weights @ self.labels[examples] + self.prior) / (weights.sum() + 1))

    def own_votes(self, examples: list[int]) -> list[float | None]:
        """The votes on examples, each left out of its own; None without a neighbour."""
        if self.lists is None:
            self._arrange()
        starts, votes = self.starts, []
        for lo in range(0, len(examples), TOGETHER):
            part = examples[lo:lo + TOGETHER]
            found, _ = self.search([(self.bag[starts[e]:starts[e + 1]], self.held[starts[e]:starts[e + 1]]) for e in part], skip=part)
            votes += [self.vote(*f) if len(f[0]) else None for f in found]
        return votes

    def calibrate(self, votes: list[float | None]) -> None:
        """Fit slope and shift to the votes on the examples (by their order in the index)."""
        bare = [y for v, y in zip(votes, self.labels) if v is None]
        self.alone = (sum(bare) + self.prior) / (len(bare) + 1) if self.ids else 0.0
        x = np.array([(v, 1.0) for v in votes if v is not None]).reshape(-1, 2)
        truth = np.array([y for v, y in zip(votes, self.labels) if v is not None])
        start = np.array([8.0, -4.0])
        b = start.copy()
        loss = lambda b: np.logaddexp(0, x @ b).sum() - truth @ (x @ b) + 0.05 * ((b - start) ** 2).sum()
        for _ in range(50 if len(x) and 0 < truth.sum() < len(truth) else 0):  # Newton's steps with a small ridge, halved until they gain
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (truth - p) - 0.1 * (b - start))
            while np.abs(move).max() >= 1e-8 and loss(b + move) > loss(b):
                move = move / 2
            b = b + move
            if np.abs(move).max() < 1e-8:
                break
        self.slope, self.shift = float(b[0]), float(b[1])

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Of each text the score and the nearest examples, nearest first."""
        out = []
        for lo in range(0, len(texts), TOGETHER):
            for best, which in self.search([self.vector(_tokens(t)) for t in texts[lo:lo + TOGETHER]])[0]:
                odds = self.slope * self.vote(best, which) + self.shift
                out.append((float(1 / (1 + np.exp(-np.clip(odds, -30, 30)))) if len(best) else self.alone, which.tolist()))
        return out


def assemble(ids: list, labels: np.ndarray, sizes: np.ndarray, terms: pa.Array, counts: np.ndarray, block: int = BLOCK) -> Index:
    """An index whose votes are not calibrated, from the examples' ids and labels and their bags one after another."""
    n, toxic = len(ids), float(labels.sum())
    coded = pc.dictionary_encode(terms.cast(pa.string()))
    term = np.asarray(coded.indices, np.int64)
    vocabulary = coded.dictionary.to_pylist()
    example = np.repeat(np.arange(n), sizes)
    seen = np.bincount(term, minlength=len(vocabulary)).astype(float)
    bad = np.bincount(term, labels[example], len(vocabulary))
    prior = toxic / n if n else 0.0
    # standard errors by which a term's toxic examples differ from their share, less one example, so that a single one ties nothing
    error = np.sqrt(np.maximum(prior * (1 - prior) * seen * (n - seen) / max(1, n - 1), 1e-12))
    tied = np.maximum(np.abs(bad - prior * seen) - 1, 0) / error if 0 < prior < 1 else np.zeros(len(seen))
    weigh = (np.log((1 + n) / (1 + seen)) + 1) * (1 + GAIN * np.maximum(tied - LEAST, 0) * (seen < n))
    # examples with the same common words become neighbours in number, so that blocks have low bounds for other texts
    has = np.zeros((min(64, len(vocabulary)), n), bool)
    place = np.full(len(vocabulary), -1)
    place[np.argsort(-seen, kind="stable")[:len(has)]] = np.arange(len(has))
    often = place[term] >= 0
    has[place[term[often]], example[often]] = True
    order = np.lexsort((*has[::-1],)) if len(has) and n else np.arange(n)
    renumbered = np.empty(n, np.int64)
    renumbered[order] = np.arange(n)
    example = renumbered[example]
    sort = np.lexsort((term, example))  # by number, so that equal bags of words get equal norms
    term, example, counts = term[sort], example[sort], counts[sort]
    starts = np.concatenate([[0], np.cumsum(np.bincount(example, minlength=n))]).astype(np.int64)
    row = np.full(len(vocabulary), -1)
    long = np.argsort(-seen, kind="stable")[:TERMS]
    long = long[seen[long] >= COMMON * n]
    row[long] = np.arange(len(long))
    return Index(dict(zip(vocabulary, range(len(vocabulary)))), weigh, [ids[i] for i in order], labels[order], order, row,
                 starts, term.astype(np.int32), counts.astype(np.int32), prior, block, alone=prior)


def build(examples: list[tuple], block: int = BLOCK) -> Index:
    """A calibrated index of a few (id, text, label) rows, without Spark."""
    bags = [_tokens(text) for _, text, _ in examples]
    index = assemble([i for i, _, _ in examples], np.array([y for _, _, y in examples], float), np.array([len(b) for b in bags], np.int64),
                     pa.array([w for b in bags for w in b], pa.string()), np.array([c for b in bags for c in b.values()], float), block)
    index.calibrate(index.own_votes(list(range(len(examples)))))
    return index


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Index:
    """Examples are labelled documents whose crc32(doc_id) modulo 5 is not 0, ``examples`` of them at most.

    Null labels and ids are not learned from; rows that repeat are examples as often.  Without examples every
    score is 0.  Texts are counted and the left-out votes are found in tasks; to the driver come the bags of words and a vote an example.
    """
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y"))
    known = bounded(known, F.col("k"), examples)
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("k")).select("doc_id", "y", "text")

    def count(batches):
        for batch in batches:
            bags = [_tokens(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(b) for b in bags], pa.list_(pa.string())),
                                              pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))], ["doc_id", "y", "terms", "counts"])

    schema = extended(rows, ["doc_id", "y"], "terms array<string>, counts array<int>")
    found = rows.mapInArrow(count, schema).sort("doc_id", "terms", "counts", "y").toArrow().combine_chunks()
    terms = pa.concat_arrays([c.flatten() for c in found["terms"].chunks]) if len(found) else pa.array([], pa.string())
    counts = np.concatenate([c.flatten().to_numpy(False) for c in found["counts"].chunks]) if len(found) else np.zeros(0)
    index = assemble(found["doc_id"].to_pylist(), found["y"].to_numpy().astype(float), pc.list_value_length(found["terms"]).to_numpy().astype(np.int64), terms, counts.astype(float))
    del found, terms, counts
    spark, n = docs.sparkSession, len(index.ids)
    shared = index.shared = spark.sparkContext.broadcast(index)

    def own(batches):
        ix = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ix.own_votes(batch.column(0).to_pylist()), pa.float64())], ["id", "vote"])

    votes = dict(map(tuple, spark.range(0, n, 1, max(1, n // 250)).mapInArrow(own, "id long, vote double").collect())) if n else {}
    index.calibrate([votes[e] for e in range(n)])
    return index


def score(docs: DataFrame, index: Index, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns (except those named like the new ones), score from 0 to 1, and evidence: the ids of the nearest
    examples, nearest first.  Null and empty texts and those that share no term with an example get the rate of such examples."""
    new = ["score", "evidence"]
    held = [c for c in keep if c not in new]
    schema = extended(docs, held, "score double, evidence array<string>")
    shared = index.shared or docs.sparkSession.sparkContext.broadcast(index)
    fitted = index.slope, index.shift, index.alone  # later than what ``fit`` has sent out

    def run(batches):
        ix = shared.value
        ix.slope, ix.shift, ix.alone = fitted
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            different = list(dict.fromkeys(texts))
            once = dict(zip(different, ix.scores(different)))
            found = [once[t] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s for s, _ in found], pa.float64()),
                                              pa.array([[str(ix.ids[i]) for i in e] for _, e in found], pa.list_(pa.string()))], [*held, *new])

    return docs.select(*held, docs[text].alias("__text")).mapInArrow(run, schema)
