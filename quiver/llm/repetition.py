"""Repetition inside a document: cheap statistics and trees that choose documents, and exact shares of those.

Exact shares need every word of a text.  The cheap statistics are taken from
its bytes, some five times faster; boosted trees, all of whose features are
monotone, score them, and only documents with a score that a case may have are
counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quiver.llm import boosted_trees

#: what is counted exactly
STATISTICS = ("share", "words", "longest", "twice", "line_share")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _codes(words: pa.Array) -> np.ndarray:
    return _mix(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _repeats(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word lies in a repeated window, window starting here is repeated) for hashed words of ascending doc numbers.

    A window is repeated if it also starts at an earlier place of its document.
    Windows are told apart by 64-bit hashes that take in the document.
    """
    n = len(words)
    starts = max(0, n - window + 1)
    h = _mix(doc[:starts].astype(np.uint64) + np.uint64(1))
    for j in range(window):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + starts])
    whole = doc[:starts] == doc[window - 1 :][:starts]
    again = np.zeros(n, dtype=bool)
    at = np.flatnonzero(whole)
    order = at[np.argsort(h[at], kind="stable")]
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    change = np.zeros(n + window + 1, dtype=np.int64)
    hit = np.flatnonzero(again)
    change[hit] += 1
    np.add.at(change, hit + window, -1)
    return np.cumsum(change)[:n] > 0, again


def statistics(texts: pa.Array, window: int = 6) -> dict[str, np.ndarray]:
    """The STATISTICS of each text (null counts as empty).

    share: part of the words that lie in ``window`` consecutive words which
    also start earlier; words: their number; longest: words of the longest
    repeated stretch; twice: part of the words seen before in the text;
    line_share: part of the characters in lines seen before in the text.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    m = len(texts)
    lists = pc.split_pattern_regex(texts, r"\P{L}+")
    counts, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
    doc = np.repeat(np.arange(m), counts)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    doc, words = doc[real], _codes(pc.utf8_lower(flat.filter(pa.array(real))))
    n = np.bincount(doc, minlength=m)
    inside, _ = _repeats(words, doc, window)
    _, before = _repeats(words, doc, 1)
    safe = np.maximum(n, 1)
    edge = np.ones(len(doc), dtype=bool)
    edge[1:] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(edge)
    run = np.diff(np.append(first, len(doc)))
    longest = np.zeros(m, dtype=np.int64)
    np.maximum.at(longest, doc[first], np.where(inside[first], run, 0))
    rows = pc.split_pattern_regex(texts, r"\r\n|[\r\n]")
    line = pc.utf8_trim_whitespace(rows.flatten())
    line_doc = np.repeat(np.arange(m), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
    chars = pc.utf8_length(line).to_numpy(zero_copy_only=False).astype(np.int64)
    _, seen = _repeats(_codes(line), line_doc, 1)
    all_chars = np.maximum(np.bincount(line_doc, weights=chars, minlength=m), 1)
    return {
        "share": np.bincount(doc, weights=inside, minlength=m) / safe,
        "words": n.astype(np.float64),
        "longest": longest.astype(np.float64),
        "twice": np.bincount(doc, weights=before, minlength=m) / safe,
        "line_share": np.bincount(line_doc, weights=chars * seen, minlength=m) / all_chars,
    }


#: cheap statistics in the order in which the trees see them; all grow with repetition or length
CHEAP = ("again", "run", "starts")


def _seen(h: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Which hashes occur earlier in the array, by scattering places into a table instead of sorting.

    Equal hashes share a slot, and the first place to come keeps it, so all
    hashes that win their slot are settled at once; the others try again with
    other bits.  Those still open after the last round count as seen.
    """
    again, left = np.zeros(len(h), bool), np.arange(len(h))
    bits = max(4, int(4 * len(h) + 1).bit_length())
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:rounds]:
        mine = h[left]
        slot = ((mine * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
        table, place = np.zeros(1 << bits, np.int32), np.arange(len(left), dtype=np.int32)
        table[slot[::-1]] = place[::-1]
        first = table[slot]
        settled = mine[first] == mine
        again[left[settled & (first != place)]] = True
        left = left[~settled]
        if not len(left):
            break
    again[left] = True
    return again


def cheap_statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(the CHEAP of each text, texts that these can't judge); null counts as empty.

    Letters are ASCII letters in either case and all bytes above; whatever lies
    between two words is one blank.  again: part of the words' starts from
    which on 24 bytes have occurred earlier in the text; run: most of them in
    a row; starts: their number.  A text of which more than a fifth is beyond
    ASCII can't be judged, as its blanks and capitals may be there.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    m = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + m + 1] if m else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    edges = ends - ends[0]
    low, beyond = data | 0x20, data >= 0x80
    letter = ((low - np.uint8(97)) < 26) | beyond
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # a word and one byte behind it
    upto = lambda flags: np.concatenate([np.zeros(1, np.int32), np.cumsum(flags, dtype=np.int32)])[edges]
    edges_kept = upto(kept)
    stream, letter = np.where(letter, low, np.uint8(0x20))[kept], letter[kept]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    inner = edges_kept[edges_kept < len(start)]
    start[inner] = letter[inner]  # a text begins a word of its own
    at = np.flatnonzero(start)
    doc = np.searchsorted(edges_kept, at, side="right") - 1
    padded = np.concatenate([stream, np.zeros(32, np.uint8)])
    eight = np.ndarray(len(stream) + 24, "<u8", padded, strides=(1,))
    h = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in (0, 8, 16):
        h = (h ^ eight[at + j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    again = _seen(h)
    n = np.bincount(doc, minlength=m)
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (again[1:] != again[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change)
    run, begin = np.zeros(m), first[:-1] if len(at) else first[:0]
    np.maximum.at(run, doc[begin], np.where(again[begin], np.diff(first), 0) if len(at) else 0)
    out = {"again": np.bincount(doc, weights=again, minlength=m) / np.maximum(n, 1), "run": run, "starts": n.astype(np.float64)}
    return out, np.diff(upto(beyond).astype(np.int64)) * 5 > np.diff(edges)


def repeated_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.3, words: int = 20, window: int = 6, rows: int = 4000
) -> DataFrame:
    """(key, score, STATISTICS…) of the documents that may have ``share`` of their ``words`` or more repeated.

    The trees are fitted on about ``rows`` documents, taken by a hash of key
    and text at any size of the input and counted exactly; they learn which
    have half the share.  A document is set aside if it scores less than one
    with half the words a case needs and whose other cheap statistics are six
    tenths of the least that a case of the sample has: the features are
    monotone, so one of its own is less than that.  If the sample has no case,
    nothing is set aside.  Null texts count as
    empty; other columns are ignored; repeated rows come out as often as they
    came in.
    """
    source = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    part = min(1 << 40, (rows << 40) // max(1, source.count()))
    picked = source.filter(F.pmod(F.xxhash64("_key", "_text"), F.lit(1 << 40)) < part)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, batch.column("_text"), 4_000_000):
                exact, cheap = statistics(some.column("_text"), window), cheap_statistics(some.column("_text"))[0]
                yield pa.RecordBatch.from_arrays([*(pa.array(cheap[c]) for c in CHEAP), pa.array(exact["share"]), pa.array(exact["words"])], names=[*CHEAP, "share", "words"])

    labelled = picked.mapInArrow(label, ", ".join(f"{c} double" for c in (*CHEAP, "share", "words")))
    sample = labelled.limit(4 * rows).toPandas()  # copies of one row may be many
    x = sample[list(CHEAP)].to_numpy(np.float64).reshape(-1, len(CHEAP))
    case = ((sample["share"] >= share) & (sample["words"] >= words)).to_numpy(bool)
    model, floor = None, -np.inf
    if case.any():
        half = ((sample["share"] >= share / 2) & (sample["words"] >= words / 2)).to_numpy(np.float64)
        model = boosted_trees.fit(x, half, np.ones(len(CHEAP), dtype=np.int64))
        corner = np.append(0.6 * x[case, :-1].min(axis=0), words / 2)
        floor = float(model.score(corner[None, :])[0]) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, batch.column("_text"), 4_000_000):
                score = np.full(some.num_rows, np.inf)
                if model is not None:
                    cheap, unknown = cheap_statistics(some.column("_text"))
                    score = np.where(unknown, np.inf, model.score(np.stack([cheap[c] for c in CHEAP], axis=1)))
                at = np.flatnonzero(score >= floor)
                if len(at):
                    some = some.take(pa.array(at))
                    s = statistics(some.column("_text"), window)
                    yield pa.RecordBatch.from_arrays([some.column("_key"), pa.array(score[at]), *(pa.array(s[c]) for c in STATISTICS)], names=[key, "score", *STATISTICS])

    kind = dict(source.dtypes)["_key"]
    return source.mapInArrow(run, f"`{key}` {kind}, score double, " + ", ".join(f"{c} double" for c in STATISTICS))


def document_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = 6) -> DataFrame:
    """(key, STATISTICS…) of each document; a null text counts as empty, and texts are read whole."""
    source = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column("_text")):
                s = statistics(part.column("_text"), window)
                yield pa.RecordBatch.from_arrays([part.column("_key"), *(pa.array(s[c]) for c in STATISTICS)], names=[key, *STATISTICS])

    kind = dict(source.dtypes)["_key"]
    return source.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` bytes of text, a longer text being a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
