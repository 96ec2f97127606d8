"""Packing documents into token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at every full sequence; what is left of it is shorter than one.  Each task balances these rests in groups
of a bounded number of tokens: partial partitions with the largest spread are merged so that the fullest windows of one meet
the emptiest of the other, until all windows of the group are nearly equal.  A group holds a little less than its windows can,
so equal windows fit; where one still does not, the window count rises.  Where that would pad more than SPARE of
the group (many rests of one awkward length), what hangs over a window is cut off and poured into windows with room.
What the last group of a task has beyond full windows goes into sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled: a task's rows come from a scan that a lost executor repeats alike.  A task holds one group and one document.
"""

from __future__ import annotations

import heapq
import os
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.bpe import ODD, WHITE, Bpe, byte_symbols, default_path
from tracefold.llm.common import extended

CAPACITY = 4096
#: Windows of a group, free tokens per window aimed at, and the share of further windows before overhangs are cut.
WINDOWS, FREE, SPARE = 256, 8, 1 / 128
#: Bytes that a worker's memos of words and of pieces may hold, characters split at once, bytes of the longest piece merged in a matrix.
WORD_BYTES, PIECE_BYTES, PART, LONGEST = 96 << 20, 160 << 20, 12 << 20, 128
#: Letters, one number, a contraction, or other signs, and the line breaks put between words.
SPLIT = regex.compile(r"\p{L}++|\n|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\p{White_Space}\p{L}\p{N}]++")
BREAK = b"\xff\xff\xff\xff"
WIDTH = 4  # bytes of an id


# -- ids ----------------------------------------------------------------------

def parts(text: str):
    """The text in parts of about PART characters, cut before white space."""
    at = 0
    while len(text) - at > PART:
        cut = WHITE.search(text, at + PART)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class Ranks:
    """Merge ranks of symbol pairs in an open hash table, looked up for whole arrays."""

    def __init__(self, codec: Bpe):
        self.size, self.made, self.none = codec.size, codec.made.astype(np.int32), len(codec.keys)
        self.bits = (4 * len(codec.keys)).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, self.none, np.int32)
        left, rank = codec.keys, codec.ranks
        at = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = left[put], rank[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, rank, at = left[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) * self.size + right).ravel()
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], self.none)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[rest]
            out[rest[hit]] = self.ranks[at[hit]]
            more = ~hit & (held >= 0)
            rest, at = rest[more], at[more]
        return out.reshape(left.shape)

    def merge(self, symbols: np.ndarray):
        """Merge every row of symbols to its end; yields (rows, their ids as a matrix)."""
        symbols, rows = symbols.astype(np.int32), np.arange(len(symbols))
        rank = self(symbols[:, :-1], symbols[:, 1:])
        while len(rows) and symbols.shape[1] > 1:
            each = np.arange(len(rows))
            pos = rank.argmin(1)
            best = rank[each, pos]
            done = best == self.none
            if done.any():
                yield rows[done], symbols[done]
                go = ~done
                rows, symbols, rank, pos, best = rows[go], symbols[go], rank[go], pos[go], best[go]
                each = each[:len(rows)]
            whole, width = self.made[best], symbols.shape[1]
            cols = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, cols + (cols > pos[:, None]), 1)
            symbols[each, pos] = whole
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= pos[:, None]), 1)
            at = np.flatnonzero(pos > 0)
            rank[at, pos[at] - 1] = self(symbols[at, pos[at] - 1], whole[at])
            at = np.flatnonzero(pos < width - 2)
            rank[at, pos[at]] = self(whole[at], symbols[at, pos[at] + 1])
        if len(rows):
            yield rows, symbols


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    Arrow splits many texts at white space and numbers their words.  Words not met before are split into pieces, and new pieces of
    one length are merged as the rows of one matrix; those of more than LONGEST bytes go to the library's own model.
    Words and pieces are remembered, up to WORD_BYTES and PIECE_BYTES.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.codec = Bpe(path)
        if self.codec.size > 1 << 24:
            raise ValueError("ids of more than three bytes")  # BREAK must differ from any of them
        self.ranks = Ranks(self.codec)
        self.stand = byte_symbols()
        self.words, self.pieces = {}, {}
        self.word_bytes = self.piece_bytes = 0

    def _merge(self, new: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        raws: dict[int, list[bytes]] = {}
        for piece in new:
            raw = piece.encode()
            by_size.setdefault(len(raw), []).append(piece)
            raws.setdefault(len(raw), []).append(raw)
        for size, found in by_size.items():
            if size > LONGEST:
                for piece, raw in zip(found, raws[size]):
                    tokens = self.library.model.tokenize("".join(self.stand[b] for b in raw))
                    self.pieces[piece] = np.array([t.id for t in tokens], "<u4").tobytes()
                continue
            raw = np.frombuffer(b"".join(raws[size]), np.uint8).reshape(-1, size)
            symbols = self.codec.inner[raw]
            symbols[:, -1] = self.codec.last[raw[:, -1]]
            for rows, ids in self.ranks.merge(symbols):
                flat, step = ids.astype("<u4").tobytes(), ids.shape[1] * WIDTH
                self.pieces.update(zip(map(found.__getitem__, rows.tolist()), [flat[i:i + step] for i in range(0, len(flat), step)]))
            self.piece_bytes += (size * 2 + 150) * len(found)

    def _learn(self, new: list[str]) -> None:
        if self.codec.added_re.search("\n".join(new)):
            for word in filter(self.codec.added_re.search, new):
                self.words[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            new = [word for word in new if word not in self.words]
        whole = "\n".join(new)
        if not whole.isascii():
            whole = unicodedata.normalize("NFC", whole).replace("Σ", "σ")
        flat = SPLIT.findall(whole.lower())
        distinct = set(flat)
        distinct.discard("\n")
        if self.piece_bytes > PIECE_BYTES:
            self.pieces.clear()
            self.piece_bytes = 0
        fresh = distinct.difference(self.pieces)
        if fresh:
            self._merge(list(fresh))
        self.pieces["\n"] = BREAK
        coded = b"".join(map(self.pieces.__getitem__, flat))
        self.words.update(zip(new, coded.split(BREAK)))
        self.word_bytes += len(coded) + 2 * len(whole) + 150 * len(new)

    def _ids(self, texts: pa.Array) -> list[bytes]:
        split = pc.utf8_split_whitespace(texts)
        lengths = pc.list_value_length(split).fill_null(0).to_numpy()
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.word_bytes > WORD_BYTES:
            self.words.clear()
            self.word_bytes = 0
        new = [w for w in words if w and w not in self.words]
        if new:
            self._learn(new)
        values = [self.words[w] if w else b"" for w in words]  # white space at an end leaves an empty word
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // WIDTH
        table, starts = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        many = sizes[codes]
        ends = np.cumsum(many)
        ids = table[np.repeat(starts[codes] - (ends - many), many) + np.arange(many.sum())]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; together they should not hold much more than PART characters."""
        odd = pc.fill_null(pc.match_substring_regex(texts, ODD.pattern), False)
        if not pc.any(odd).as_py():
            return self._ids(texts)
        # these control characters are white space to Arrow, but not to the tokenizer: a text with one is split here
        plain = iter(self._ids(texts.filter(pc.invert(odd))))
        return [self._odd(text.as_py()) if o else next(plain) for text, o in zip(texts, odd.to_pylist())]

    def _odd(self, text: str) -> bytes:
        words = [w for w in WHITE.split(text) if w]
        new = list(set(words).difference(self.words))
        if new:
            self._learn(new)
        return b"".join(map(self.words.__getitem__, words))

    def stream(self, texts: pa.Array):
        """The ids of each text in order: many short texts at once, a long one in parts."""
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(sizes, sizes[at] + PART, "right")) - 1
            if to > at:
                yield from self.ids(texts[at:to])
                at = to
            else:
                yield b"".join(self.ids(pa.array([part]))[0] for part in parts(texts[at].as_py()))
                at += 1


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


# -- windows ------------------------------------------------------------------

def differencing(sizes: list[int], k: int) -> tuple[list[list[int]], list[int]]:
    """The items dealt to ``k`` windows with nearly equal sums: (items of each window, sums).

    A partial partition is kept as its non-zero sums in rising order; it has k windows, the others are empty.
    """
    pairs: list[tuple[int, int]] = []  # a node beyond the items stands for two nodes that share a window
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # windows that hold parts of a and of b
        if both:
            met = np.arange(len(sizes) + len(pairs), len(sizes) + len(pairs) + both)
            pairs.extend(zip(an[:both].tolist(), bn[both - 1::-1].tolist()))
            sums = np.concatenate([a[:both] + b[both - 1::-1], a[both:], b[both:]])
            nodes = np.concatenate([met, an[both:], bn[both:]])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[-1]) - (int(sums[0]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, tie, sums, nodes))
        tie += 1
    if not heap:
        return [[] for _ in range(k)], [0] * k
    _, _, sums, nodes = heap[0]
    windows = []
    for node in nodes.tolist():
        items, open_nodes = [], [node]
        while open_nodes:
            n = open_nodes.pop()
            if n < len(sizes):
                items.append(n)
            else:
                open_nodes.extend(pairs[n - len(sizes)])
        windows.append(sorted(items))
    empty = k - len(windows)
    return windows + [[] for _ in range(empty)], sums.tolist() + [0] * empty


def _cut(piece, at: int):
    """(document, start, ids) before and from the id ``at`` on."""
    doc, start, ids = piece
    return (doc, start, ids[:at * WIDTH]), (doc, start + at, ids[at * WIDTH:])


def _size(piece) -> int:
    return len(piece[2]) // WIDTH


def windows_of(pieces: list, capacity: int = CAPACITY) -> list[list]:
    """The pieces in as few windows of at most ``capacity`` as balancing allows."""
    sizes = [_size(p) for p in pieces]
    least = -(-sum(sizes) // capacity)
    for k in range(least, least + 1 + int(least * SPARE)):
        dealt, sums = differencing(sizes, k)
        if max(sums, default=0) <= capacity:
            return [[pieces[i] for i in window] for window in dealt]
    dealt, sums = differencing(sizes, least)
    out, over = [], []
    for window in dealt:
        held, room = [], capacity
        for piece in (pieces[i] for i in window):
            if _size(piece) > room:
                piece, rest = _cut(piece, room)
                over.append(rest)
            room -= _size(piece)
            if piece[2]:
                held.append(piece)
        out.append([held, room])
    out.sort(key=lambda w: -w[1])
    for window in out:
        while window[1] and over:
            piece = over.pop()
            if _size(piece) > window[1]:
                piece, rest = _cut(piece, window[1])
                over.append(rest)
            window[0].append(piece)
            window[1] -= _size(piece)
    return [held for held, _ in out]


def powers_of_two(pieces: list, capacity: int = CAPACITY) -> list[list]:
    """All tokens of the pieces in sequences of ``capacity`` and, for the rest, of falling powers of two."""
    total = sum(map(_size, pieces))
    lengths = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    queue, out = pieces[::-1], []
    for room in lengths:
        held = []
        while room:
            piece = queue.pop()
            if _size(piece) > room:
                piece, rest = _cut(piece, room)
                queue.append(rest)
            held.append(piece)
            room -= _size(piece)
        out.append(held)
    return out


class Packer:
    """Takes the documents of a task one by one and gives sequences: lists of (document, start, ids)."""

    def __init__(self, capacity: int = CAPACITY, windows: int = WINDOWS):
        self.capacity, self.windows = capacity, windows
        self.pending, self.total = [], 0

    def add(self, doc, ids: bytes):
        n = len(ids) // WIDTH
        for start in range(0, n - n % self.capacity, self.capacity):
            yield [(doc, start, ids[start * WIDTH:(start + self.capacity) * WIDTH])]
        if n % self.capacity:
            self.pending.append((doc, n - n % self.capacity, ids[(n - n % self.capacity) * WIDTH:]))
            self.total += n % self.capacity
        if self.total >= self.windows * self.capacity:
            yield from self._balance(self.windows)

    def finish(self):
        yield from self._balance(self.total // self.capacity)
        yield from powers_of_two(self.pending, self.capacity)

    def _balance(self, windows: int):
        """Pack all but what ``windows`` nearly full windows cannot hold; that stays pending."""
        over, kept = self.total - windows * max(1, self.capacity - FREE), []
        while over > 0 and self.pending:
            piece = self.pending.pop()
            if _size(piece) > over:
                piece, rest = _cut(piece, _size(piece) - over)
                self.pending.append(piece)
                piece = rest
            kept.append(piece)
            over -= _size(piece)
        if self.pending:
            yield from windows_of(self.pending, self.capacity)
        self.pending, self.total = kept[::-1], sum(map(_size, kept))


# -- the operator ---------------------------------------------------------------

def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end: int = 2) -> DataFrame:
    """One row per piece: the key, start, length, doc_tokens, sequence_id, offset, and ids (binary, little-endian unsigned 32-bit).

    A document is the ids of its text and then ``end``.  Null and empty texts are the one id ``end``.  Every row is a document of
    its own: repeated rows and rows without a key are packed like others.  An empty table gives an empty result; further columns are not
    read.  A text of any length is encoded in parts; a task holds its ids and one group of rests.  Sequence ids are
    unique, not consecutive.
    """
    path = path or default_path()
    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    held = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = extended(held, [key], "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    last = struct.pack("<I", end)

    def run(batches):
        encode, packer = encoder(path).stream, Packer(capacity)
        number, kind, rows, size = TaskContext.get().partitionId() << 33, None, [], 0

        def batch_of():
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:6]],
                                               pa.array(columns[6], pa.binary())], names)

        def sequences():
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    ids += last
                    yield from packer.add((doc, len(ids) // WIDTH), ids)
            yield from packer.finish()

        for sequence in sequences():
            offset = 0
            for (doc, tokens), start, ids in sequence:
                n = len(ids) // WIDTH
                rows.append((doc, start, n, tokens, number, offset, ids))
                offset += n
                size += len(ids)
            number += 1
            if len(rows) >= 4096 or size > 8 << 20:
                yield batch_of()
                rows, size = [], 0
        if rows:
            yield batch_of()

    return held.mapInArrow(run, schema)



def unpacked(ids: Column) -> Column:
    """The ids of a piece as an array of numbers."""
    text = F.hex(ids)
    at = F.filter(F.sequence(F.lit(0), F.length(text), F.lit(2 * WIDTH)), lambda i: i < F.length(text))
    part = lambda i, b: F.substr(text, i + 2 * b + 1, F.lit(2))
    return F.transform(at, lambda i: F.conv(F.concat(*[part(i, b) for b in reversed(range(WIDTH))]), 16, 10).cast("long"))
