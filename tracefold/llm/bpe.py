"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks up the rank of every adjacent pair by binary search
over sorted pair keys, takes each word's lowest rank, and merges all its pairs of that rank at once.  Words are
what white space separates; bounded memos in each worker keep the ids of words and of their pieces.  Vocabulary, merges and added tokens
come from a tokenizer file; its text rules (NFC, white space, lower case, the split pattern) are applied here.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracefold.llm.common import extended

MEMO = 300_000
LONG = 1 << 20
#: Characters of the texts whose new words are merged together.
GROUP = 1 << 18
#: Rows whose ids and decoded texts a worker holds at once.
ROWS = 1000
WHITE = regex.compile(r"\p{White_Space}+")
ODD = regex.compile("[\x1c-\x1f]")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: Latin-1's visible characters for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        end = spec["model"]["end_of_word_suffix"]
        stand = byte_symbols()
        self.inner = np.array([vocab[s] for s in stand], np.int64)
        self.last = np.array([vocab[s + end] for s in stand], np.int64)
        self.size = max(self.names) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.memo: dict[str, str] = {}   # a word's ids as text
        self.shown: dict[str, str] = {}  # its tokens
        self.forget_parts()              # the same of pieces

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (none is empty)."""
        sizes = np.array([len(p) for p in pieces])
        symbols = self.inner[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[np.frombuffer(bytes(p[-1] for p in pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        live = np.ones(len(pieces), bool)
        none = len(self.keys)
        while live.any():
            busy = np.flatnonzero(live[owner])
            at = busy[:-1][(busy[1:] == busy[:-1] + 1) & (owner[busy[1:]] == owner[busy[:-1]])]
            if not len(at):
                break
            key = symbols[at] * self.size + symbols[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(self.keys[found] == key, self.ranks[found], none)
            best = np.full(len(pieces), none)
            np.minimum.at(best, owner[at], rank)
            live = best < none
            take = (rank == best[owner[at]]) & (rank < none)
            at, rank = at[take], rank[take]
            if not len(at):
                break
            # of pairs that overlap in a run, every second one, from the left
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at, rank = (x[(np.arange(len(at)) - start) % 2 == 0] for x in (at, rank)) if not fresh.all() else (at, rank)
            symbols[at] = self.made[rank]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        cuts = np.searchsorted(owner, np.arange(1, len(pieces)))
        return np.split(symbols, cuts)

    def pieces(self, chunks: list[str]) -> list[str]:
        """The pieces of all words, a line feed between words; an added token is a piece that begins with one."""
        found = []
        for i, part in enumerate(self.added_re.split("\n".join(chunks))):
            if i % 2:
                found.append("\n" + part)
            elif part:
                text = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                found += PIECES.findall(text.lower())
        return found

    def words(self, chunks: list[str]) -> None:
        """Put the ids of new white-space words into the memo."""
        pieces = self.pieces(chunks)
        if len(self.parts) > MEMO:
            self.forget_parts()
        new = list(set(pieces).difference(self.parts))
        if new:
            for piece, ids in zip(new, self.merge([p.encode() for p in new])):
                ids = ids.tolist()
                self.parts[piece] = " ".join(map(str, ids))
                self.shown_parts[piece] = " ".join(map(self.names.__getitem__, ids))
        # every word has a piece, so the line feeds stand alone between words
        self.memo.update(zip(chunks, " ".join(map(self.parts.__getitem__, pieces)).split(" \n ")))
        self.shown.update(zip(chunks, " ".join(map(self.shown_parts.__getitem__, pieces)).split(" \n ")))

    def forget_parts(self) -> None:
        self.parts = {"\n": "\n"} | {"\n" + t: str(i) for t, i in self.added.items()}
        self.shown_parts = {"\n": "\n"} | {"\n" + t: t for t in self.added}

    def forget(self) -> None:
        self.memo.clear()
        self.shown.clear()
        self.forget_parts()

    def split(self, text: str) -> list[str]:
        return [c for c in WHITE.split(text) if c] if ODD.search(text) else text.split()

    def learn(self, chunks: Iterable[str]) -> None:
        """See that the memo has all these words."""
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.shown.clear()
        new = set(chunks).difference(self.memo)
        if new:
            self.words(list(new))

    def written(self, chunks: list[str]) -> tuple[str, str]:
        return " ".join(map(self.memo.__getitem__, chunks)), " ".join(map(self.shown.__getitem__, chunks))

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and the decoded text."""
        chunks = self.split(text or "")
        done = []
        for lo in range(0, len(chunks), LONG):  # a very long text in parts
            part = chunks[lo:lo + LONG]
            self.learn(part)
            # every word has an id, so the parts are never empty
            done.append(self.written(part))
        return _counted(*(" ".join(x) for x in zip(*done))) if done else (0, "", "")

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """The same of many texts; the new words of a group of texts are merged together."""
        for group in _grouped(texts):
            if len(group) == 1:
                yield self.encode(group[0])
                continue
            split = [self.split(t or "") for t in group]
            self.learn(chain.from_iterable(split))
            for chunks in split:
                yield _counted(*self.written(chunks))


def _counted(ids: str, decoded: str) -> tuple[int, str, str]:
    return ids.count(" ") + 1 if ids else 0, ids, decoded


def _grouped(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in a row of GROUP characters together at most, longer ones alone."""
    group, size = [], 0
    for text in texts:
        more = len(text or "")
        if group and size + more > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += more
    if group:
        yield group


_loaded: dict[str, Bpe] = {}


def codec(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, digest: bool = False, keep: list[str] | None = None,
           forget: bool = False) -> DataFrame:
    """Add n_tokens with token_ids and decoded_text, or with ids_sha256 and decoded_sha256 if ``digest``.

    Null and empty texts have no ids and decode to nothing.  Rows are independent: repeated rows stay, an empty table
    gives an empty result.  ``keep`` names the columns to carry (all by default); new columns replace those of their name.
    With ``forget`` a task's words leave its worker's memory with the task, where other stages need the room.
    """
    path = path or default_path()
    extra = ["n_tokens long"] + (["ids_sha256 string", "decoded_sha256 string"] if digest else ["token_ids array<int>", "decoded_text string"])
    new = [x.split()[0] for x in extra]
    held = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = extended(docs, held, ", ".join(extra))
    source = docs.select(*held, docs[text].alias("__text"))

    def sha(whole: str) -> str:
        return hashlib.sha256(whole.encode()).hexdigest()

    def run(batches):
        bpe, none = codec(path), np.zeros(0, np.int32)
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            n, ids, decoded = [], [], []
            for many, whole, shown in bpe.encode_all(batch.column("__text").to_pylist()):
                n.append(many)
                ids.append(sha(whole) if digest else np.fromstring(whole, np.int32, sep=" ") if many else none)
                decoded.append(sha(shown) if digest else shown)
            out = [pa.array(n, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(held)], *out], [*held, *new])
        if forget:
            bpe.forget()

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """Add decoded_text: the tokens of the ids, joined by one space; null ids decode to nothing."""
    path = path or default_path()
    held = [c for c in df.columns if c != "decoded_text"]
    schema = extended(df, held, "decoded_text string")

    def run(batches):
        names = codec(path).names
        for batch in batches:
            texts = [" ".join(names[i] for i in x or ()) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*held, "decoded_text"])

    return df.select(*held, df[ids].alias("__ids")).mapInArrow(run, schema)
