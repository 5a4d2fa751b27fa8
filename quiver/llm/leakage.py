"""Evaluation texts within training texts: one automaton over all items, one scan of each text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quiver.llm.repetition import slices

#: inside of words: combining marks, the soft hyphen and marks of no width; \w also has the underscore, which counts as a blank
_LETTER = r"[\w\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]"
#: a word: letters and digits, with hyphens and apostrophes inside, also where a line ends at the hyphen or soft hyphen, with any blanks behind it
WORD = re.compile(rf"{_LETTER}+(?:(?:[-'\u2010\u2011\u2019](?:[^\S\n\r]*[\n\r]\s*)?|(?<=\u00ad)[^\S\n\r]*[\n\r]\s*){_LETTER}+)*")
#: scripts that set no blanks between words, of which each character is a word: Thai to Myanmar, Khmer, kana, Han with extensions and compatibility forms
_CLOSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u19e0-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_ANY_CLOSE = re.compile(f"[{_CLOSE}]")
#: the same as WORD for texts in which such characters occur; others have the same words by either
CLOSE_WORD = re.compile(rf"[{_CLOSE}]|" + WORD.pattern.replace(_LETTER, f"(?:(?![{_CLOSE}]){_LETTER})"))
_DROP = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[a-z0-9]+\Z")


def word_pattern(text: str) -> re.Pattern:
    return CLOSE_WORD if not text.isascii() and _ANY_CLOSE.search(text) else WORD


def normal(word: str) -> str:
    """A word without case, hyphens, joiners and differences of form."""
    word = word.lower()
    if _PLAIN.match(word):
        return word
    return _DROP.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFKC", word)).lower())


@dataclass(frozen=True)
class Settings:
    """stretch: least words of an item that a document must reproduce; errors:
    one word in so many may be missing or other; seed: words of the automaton's
    patterns; header: most words of a page header between two lines of a
    passage; block: bytes of the items in one automaton, beyond which there
    are several, each with a scan of its own.
    """

    stretch: int = 20
    errors: int = 10
    seed: int = 4
    header: int = 24
    block: int = 16_000_000


class _Codes(dict):
    """Numbers of words as they stand in texts; words not met before are normalised, and remembered up to a bound."""

    def __init__(self, number: dict[str, int], memory: int = 500_000):
        super().__init__()
        self.number, self.memory = number, memory

    def __missing__(self, word: str) -> int:
        code = self.number.get(normal(word), 0)
        if len(self) < self.memory:
            self[word] = code
        return code


def unbeaten(chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of chains (first item place, matched, missing, first document place) that end in one run, those that no other beats.

    A chain is beaten by one that spans as many words of the item or more with
    no more of them missing: whatever follows, that one qualifies as well.  One
    chain at most is left for each number of missing words.
    """
    kept, span = [], -1
    for c in sorted(chains, key=lambda c: (c[2], -c[1])):
        if c[1] + c[2] > span:
            kept.append(c)
            span = c[1] + c[2]
    return kept


class Items:
    """The automaton over all runs of ``seed`` words of the items, and the items' words by number.

    Where a run stands in the items is kept in arrays beside the automaton, so
    that a run that many items share costs an occurrence no more than a slice.
    """

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.settings, self.number, self.names, self.words = settings, {}, [], []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for name, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in map(normal, word_pattern(text).findall(text))]
            i = len(self.names)
            self.names.append(name)
            self.words.append(np.array(words, np.int64))
            for p in range(len(words) - settings.seed + 1):
                places.setdefault(tuple(words[p : p + settings.seed]), []).append((i, p))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, key in enumerate(places):
            self.automaton.add_word(key, n)
        self.automaton.make_automaton()
        self.empty = not places
        flat = np.array([x for v in places.values() for x in v], np.int64).reshape(-1, 2)
        self.item, self.place = flat[:, 0], flat[:, 1]
        self.count = np.array([len(v) for v in places.values()], np.int64)
        self.first = np.cumsum(self.count) - self.count
        # with e words missing and one page header a least stretch falls into at most e + 2 runs, and a run of n words has n - seed + 1 hits
        missing = settings.stretch // settings.errors
        self.least = max(1, settings.stretch - missing - (settings.seed - 1) * (missing + 2))
        self.codes = _Codes(self.number)
        self.size = np.array(list(map(len, self.words)), np.int64)
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.concatenate([*self.words, np.zeros(1, np.int64)])

    def passages(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, words reproduced, first and last character) of the passages in a text."""
        if self.empty or not text:
            return []
        word = word_pattern(text)
        codes = tuple(map(self.codes.__getitem__, word.findall(text)))
        found = list(self.automaton.iter(codes))
        if not found:
            return []
        end, seed = np.array(found, np.int64).T
        count = self.count[seed]
        if count.sum() < self.least:
            return []
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[seed], count)
        item, place, where = self.item[at], self.place[at], np.repeat(end - self.settings.seed + 1, count)
        out, spans, by = [], None, None
        dense = self._dense(item, place, where)
        for i in self._likely(dense, item, place, where, codes).tolist() if len(dense) else ():
            if spans is None:
                spans, by = [m.span() for m in word.finditer(text)], np.argsort(item, kind="stable")
                item, place, where = item[by], place[by], where[by]
            own = slice(*np.searchsorted(item, [i, i + 1]))
            if best := self._align(i, list(zip(place[own].tolist(), where[own].tolist())), codes, spans, text):
                out.append((self.names[i], best[0], spans[best[1]][0], spans[best[2]][1]))
        return out

    def _dense(self, item: np.ndarray, place: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The items of which some band of shifts has as many hits as a least stretch leaves, whatever is missing in it."""
        many = np.bincount(item, minlength=len(self.names))[item] >= self.least
        item, place, where = item[many], place[many], where[many]
        if not len(item):
            return item
        band = (where - place) >> 5
        band -= band.min()
        bands, places = int(band.max()) + 2, int(place.max()) + 1
        one = np.unique(np.concatenate([(item * bands + band) * places + place, (item * bands + band + 1) * places + place]))
        group, hits = np.unique(one // places, return_counts=True)
        return np.unique(group[hits >= self.least] // bands)

    def _likely(self, dense: np.ndarray, item: np.ndarray, place: np.ndarray, where: np.ndarray, codes: tuple[int, ...], block: int = 4096) -> np.ndarray:
        """Of the ``dense`` items those of which the words around some run of hits can make up a passage.

        A passage has a stretch of the least length with one word more missing
        than that allows at most, and in it a run of hits.  So near some run,
        of so many words in a row all but so many must occur in the document,
        no further off than two page headers and the missing words can move
        them.  For a phrase that many items share this is told for all of them
        at once.
        """
        s, reach = self.settings, 2 * self.settings.header + 10
        need, around = s.stretch - s.stretch // s.errors - 1, s.stretch - s.seed
        shift = where - place
        by = np.lexsort((place, shift, item))
        by = by[np.isin(item[by], dense)]
        it, k, p = item[by], shift[by], place[by]
        new = np.ones(len(by) + 1, bool)
        new[1:-1] = (it[1:] != it[:-1]) | (k[1:] != k[:-1]) | (p[1:] > p[:-1] + 1)
        edge = np.flatnonzero(new)
        it, k, lo, hi = it[edge[:-1]], k[edge[:-1]], p[edge[:-1]], p[edge[1:] - 1] + s.seed
        likely = np.unique(it[hi - lo >= need])
        rest = np.flatnonzero(~np.isin(it, likely))
        text = np.concatenate([np.zeros(reach, np.int64), np.array(codes, np.int64), np.zeros(reach, np.int64)])
        for at in range(0, len(rest), block):
            r = rest[at : at + block]
            pos = lo[r, None] - around + np.arange(int((hi - lo)[r].max()) + 2 * around)
            inside = (pos >= 0) & (pos < self.size[it[r], None])
            word = np.where(inside, self.flat[np.minimum(self.begin[it[r], None] + np.maximum(pos, 0), len(self.flat) - 1)], -1)
            there, seen = pos + k[r, None] + reach, np.zeros(pos.shape, bool)
            for d in range(-reach, reach + 1):
                seen |= text[np.clip(there + d, 0, len(text) - 1)] == word
            upto = np.concatenate([np.zeros((len(r), 1), np.int32), np.cumsum(seen, axis=1, dtype=np.int32)], axis=1)
            good = (upto[:, s.stretch :] - upto[:, : -s.stretch]).max(axis=1) >= need
            likely = np.union1d(likely, it[r[good]])
        return likely

    def _runs(self, i: int, hits: list[tuple[int, int]], codes: tuple[int, ...], reach: int) -> list[tuple[int, int, int]]:
        """Maximal runs (item place, document place, length) of equal words in and near the hits."""
        words, runs = self.words[i], set()
        shifts = {}
        for p, d in hits:
            shifts.setdefault(d - p, []).append(p)
        near = sorted({k + e for k in shifts for e in range(-reach, reach + 1)})
        centre = {k: (min(v), max(v)) for k, v in shifts.items()}
        for k in near:
            lo = min(centre[j][0] for j in range(k - reach, k + reach + 1) if j in centre) - 2 * self.settings.stretch
            hi = max(centre[j][1] for j in range(k - reach, k + reach + 1) if j in centre) + 2 * self.settings.stretch
            lo, hi = max(0, lo, -k), min(len(words), hi, len(codes) - k)
            if hi <= lo:
                continue
            same = np.zeros(hi - lo + 2, np.int8)
            same[1:-1] = words[lo:hi] == np.array(codes[lo + k : hi + k])
            change = np.diff(same)
            for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
                runs.add((int(lo + a), int(lo + a + k), int(b - a)))
        return sorted(runs, key=lambda r: (r[1], r[0]))

    def _goes_on(self, runs: list[tuple[int, int, int]], r: int) -> bool:
        """Whether a run of three words or more follows run ``r`` with no more than the allowed errors between."""
        p, d, size = runs[r]
        errors = self.settings.stretch // self.settings.errors
        for pp, dd, length in runs[r + 1 :]:
            skip, jump = pp - (p + size), dd - (d + size)
            if jump > errors + 2:
                break
            if length >= 3 and 0 <= skip <= errors and 0 <= jump <= skip + 2:
                return True
        return False

    def _align(self, i: int, hits: list[tuple[int, int]], codes: tuple[int, ...], spans, text: str) -> tuple[int, int, int] | None:
        """The longest passage of item i: (words of the item, first and last word of the document), or None."""
        s = self.settings
        runs = self._runs(i, hits, codes, 3)
        n = len(self.words[i])
        best = None
        # runs come by document place, and only those close before one can be its forerunners
        window = s.header + s.stretch // s.errors + 4 + max((r[2] for r in runs), default=0)
        # chains of runs: (first item place, matched, missing) with the last run's end; all that no other beats are kept
        chains: list[list[tuple[int, int, int, int]]] = []
        for r, (p, d, size) in enumerate(runs):
            own = [(p, size, 0, d)]
            for q in range(r - 1, -1, -1):
                pp, dd, length = runs[q]
                if d - dd > window:
                    break
                if pp >= p:
                    continue
                skip, jump = p - (pp + length), d - (dd + length)
                cut = max(0, -skip, -jump)  # words that both runs claim count once
                if cut >= min(size, length) or skip > s.stretch // s.errors + 2:
                    continue
                if jump > skip + 2:
                    between = text[spans[dd + length - 1][1] : spans[d][0]]
                    if skip > 2 or jump > s.header + skip or not (size >= 3 or self._goes_on(runs, r)) or between.count("\n") + between.count("\r") < 2:
                        continue
                missing = max(0, skip + cut)
                own += [(a, m + size - cut, e + missing, at) for a, m, e, at in chains[q] if e + missing <= max(3, (m + size) // 5)]
            if len(own) > 16:
                own = unbeaten(own)
            chains.append(own)
            for a, m, e, at in own:
                span = m + e
                # words before or behind the matched ones may be among those missing
                spare = max(0, s.stretch - span)
                total = span + spare
                if total <= n and (e + spare) * s.errors <= total and (best is None or span > best[0]):
                    best = (span, at, d + size - 1)
        return best


_built: dict[int, Items] = {}


def find_passages(documents: DataFrame, items: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, words, from_char, to_char) of each item of which a document reproduces a stretch.

    A passage has at least ``stretch`` words of the item in order, of which one
    in ``errors`` may be replaced, dropped or blanked out.  Case, punctuation,
    hyphens, joiners, line breaks and page headers between lines don't matter.
    words: the item's words from the first to the last one matched; from_char,
    to_char: their place in the original text, in code points.

    Null and empty texts have no passages; items of fewer words than
    ``stretch``, without a text or without an id can't be found; an item given twice counts once.
    In scripts without blanks between words each character counts as a word.
    The items, held-out tests, are small beside the corpus: all go into one
    automaton and one scan up to ``block`` bytes; beyond that there is one for
    every so many bytes.
    """
    s = settings or Settings()
    rows = items.select(F.col(item).alias("_i"), F.col(item_text).alias("_t")).filter(F.col("_i").isNotNull() & F.col("_t").isNotNull()).distinct()
    source = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kinds = dict(source.dtypes)["_key"], dict(rows.dtypes)["_i"]
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, words int, from_char int, to_char int"
    size, many = rows.agg(F.sum(F.octet_length("_t")), F.count(F.lit(1))).first()
    blocks = max(1, min(many, -(-(size or 0) // s.block)))
    out = None
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == b) if blocks > 1 else rows
        out_b = _scan(source, sorted((r._i, r._t) for r in part.collect()), s, key, item, schema)
        out = out_b if out is None else out.unionByName(out_b)
    return out


def _scan(source: DataFrame, items: list[tuple[int, str]], s: Settings, key: str, item: str, schema: str) -> DataFrame:
    shared, name = source.sparkSession.sparkContext.broadcast(items), hash((tuple(items), s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Items(shared.value, s)
        find = _built[name].passages
        for batch in batches:
            for part in slices(batch, batch.column("_text"), 4_000_000):
                found = [(k, *p) for k, t in zip(part.column("_key").to_pylist(), part.column("_text").to_pylist()) if t for p in find(t)]
                types = [batch.schema.field("_key").type, None, pa.int32(), pa.int32(), pa.int32()]
                columns = list(zip(*found)) if found else [[], [], [], [], []]
                types[1] = pa.string() if found and isinstance(columns[1][0], str) else pa.int64()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, item, "words", "from_char", "to_char"])

    return source.mapInArrow(run, schema)
