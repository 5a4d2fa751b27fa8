"""Encoding texts by a byte-level BPE vocabulary: speculate, verify, and merge exactly only what fails.

Texts are split into words by the vocabulary's pattern.  For every word not met
before, the longest vocabulary entries from left to right are proposed.  A
proposal is the exact encoding if no merge ever crosses the border of two
neighbouring tokens; that follows from how the tokens themselves are made up,
so all neighbours of a batch are tested at once, by array operations and
without merging anything.  Words with a failing pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quiver.llm.repetition import slices

#: fixed value: how the vocabulary splits text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Vocabulary of a file whose lines hold a token in base64 and its id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


NEVER = np.int64(1) << 40  # a rank that no merge has


class Merges:
    """How the entries of a vocabulary are made up, as arrays by id.

    pairs, joined: neighbours that can be merged (as one number, sorted) and
    what they become; left, right: the parts of the merge that makes an entry,
    -1 for single bytes; whole: entries that merging their own bytes leads to.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values(), default=0) + 1
        self.left, self.right = np.full(self.width, -1, np.int64), np.full(self.width, -1, np.int64)
        self.whole = np.zeros(self.width, bool)
        lengths: dict[int, list[bytes]] = {}
        for b in ranks:
            lengths.setdefault(len(b), []).append(b)
        cuts: dict[int, list[tuple[int, int, int]]] = {}
        for n, entries in lengths.items():
            cuts[n] = [(x, y, ranks[b]) for b in entries for i in range(1, n) if (x := ranks.get(b[:i])) is not None and (y := ranks.get(b[i:])) is not None]
        every = np.array(list(chain.from_iterable(cuts.values())), np.int64).reshape(-1, 3)
        key = every[:, 0] * self.width + every[:, 1]
        order = np.argsort(key)
        self.pairs, self.joined = key[order], every[order, 2]
        self.whole[[ranks[b] for b in lengths.get(1, [])]] = True
        for n in sorted(lengths):  # parts are shorter than what they make
            if n > 1 and cuts[n]:
                x, y, made = np.array(cuts[n], np.int64).T
                fine = self.whole[x] & self.whole[y]
                x, y, made = x[fine], y[fine], made[fine]
                fine = self.apart(x, y, made)
                self.left[made[fine]], self.right[made[fine]], self.whole[made[fine]] = x[fine], y[fine], True

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What each pair of neighbours becomes, NEVER if it can't be merged."""
        if not len(self.pairs):
            return np.full(len(x), NEVER)
        key = x * self.width + y
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], NEVER)

    def apart(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether x and y, merged from their bytes side by side, stay apart (until the rank ``until``).

        Time runs backwards: of the two entries at the border the one that was
        merged last is taken apart, which gives every pair that ever met there.
        A pair would have been merged if its rank came before the merge that
        used up the left one, and not after the one that used up the right one
        (of merges of one rank, the leftmost goes first).
        """
        x, y = x.copy(), y.copy()
        x_ends = np.full(len(x), NEVER) if until is None else until.copy()
        y_ends = x_ends.copy()
        fine, left = np.ones(len(x), bool), np.arange(len(x))
        while len(left):
            a, b = x[left], y[left]
            r = self.rank(a, b)
            bad = (r < x_ends[left]) & (r <= y_ends[left])
            if until is not None:
                bad &= r < until[left]
            fine[left[bad]] = False
            a_parts, b_parts = self.right[a] >= 0, self.left[b] >= 0
            open_ = ~bad & (a_parts | b_parts)
            left, a, b, a_parts, b_parts = left[open_], a[open_], b[open_], a_parts[open_], b_parts[open_]
            # of equal entries the right one was made last
            first = a_parts & (~b_parts | (a > b))
            i, j = left[first], left[~first]
            x_ends[i], x[i] = a[first], self.right[a[first]]
            y_ends[j], y[j] = b[~first], self.left[b[~first]]
        return fine


class Encoder:
    """Encoder that remembers words; ``memory`` bounds how many."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory: int = 400_000, merges: Merges | None = None):
        self.ranks, self.memory, self.merges = ranks, memory, merges or Merges(ranks)
        self.split = regex.compile(pattern).findall
        self.reach: dict[bytes, int] = {}  # the longest token by its first two bytes
        for b in ranks:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))
        self.merged = 0  # exact merges so far
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # -- one word ---------------------------------------------------------
    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: merge the neighbours of least rank, leftmost first, until none can be merged."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= stop or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """The longest tokens from left to right."""
        ranks, out, p, n = self.ranks, [], 0, len(word)
        while p < n:
            stop = min(n, p + self.reach.get(word[p : p + 2], 1))
            while (r := ranks.get(word[p:stop])) is None:
                stop -= 1
            out.append(r)
            p = stop
        return out

    # -- many words -------------------------------------------------------
    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = [self.propose(b) for b in raw]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(count.sum()))
        of = np.repeat(np.arange(len(found)), count)
        inner = np.flatnonzero(of[1:] == of[:-1])
        failed = np.zeros(len(found), bool)
        failed[of[~self.merges.whole[flat]]] = True
        pairs, which = np.unique(flat[inner] * self.merges.width + flat[inner + 1], return_inverse=True)
        fine = self.merges.apart(pairs // self.merges.width, pairs % self.merges.width)
        failed[of[inner[~fine[which]]]] = True
        for i in np.flatnonzero(failed).tolist():
            found[i] = self.merge(raw[i])
        self.merged += int(failed.sum())
        count = np.fromiter(map(len, found), np.int64, len(found))
        self.words.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.length = np.concatenate([self.length, count])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))])

    def encode(self, texts: list[str | None]) -> pa.Array:
        """ids of each text; a null or empty text has none."""
        split = [self.split(t) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.words) > self.memory:
            self._forget()
        new = list(set(words).difference(self.words))
        if new:
            self.learn(new)
        code = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        size = self.length[code]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.start[code], size)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(self.flat[at]))


_encoders: dict[int, Encoder] = {}


def encode_documents(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of each row: the ids of its whole text by the vocabulary file, without special tokens.

    Null and empty texts have an empty list.  The file is read once, by the
    driver, and broadcast with what follows from it: a vocabulary has a fixed
    size.  One pass over the text without a shuffle; other columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    ranks = parse_ranks(data)
    source = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast((ranks, Merges(ranks)))
    kind, name = dict(source.dtypes)["_key"], hash((data, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders.clear()
            ranks, merges = shared.value
            _encoders[name] = Encoder(ranks, pattern, merges=merges)
        for batch in batches:
            for part in slices(batch, batch.column("_text"), 4_000_000):
                ids = _encoders[name].encode(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_key"), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
