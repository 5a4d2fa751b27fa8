"""Raw CSV records to cells, by a finite-state tokenizer that runs on bytes in parallel.

Every byte is a function on the tokenizer's five states.  The functions that
can arise by composing them are few (a finite monoid), so composing is a table
look-up on small numbers.  A buffer of records is cut into chunks; all chunks
are composed side by side, the chunks' totals are composed across (by the same
procedure), and each byte's state follows.  A record may span any number of
chunks, and no byte is handled by Python code of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

START, PLAIN, QUOTED, CLOSED, BAD = range(5)
OTHER, QUOTE, COMMA, END = range(4)
#: next state by byte class (rows) and state (columns: START, PLAIN, QUOTED, CLOSED, BAD)
_NEXT = {
    OTHER: (PLAIN, PLAIN, QUOTED, BAD, BAD),
    QUOTE: (QUOTED, BAD, CLOSED, QUOTED, BAD),
    COMMA: (START, START, QUOTED, START, BAD),
    END: (START, START, START, START, START),
}
SEPARATOR = 0xFF  # never a byte of UTF-8


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """(product table, states by element, element of each byte class, element that leads to a state whatever was before); element 0 is the identity."""
    elements = [tuple(range(5))]
    index = {elements[0]: 0}
    into = {s: (s,) * 5 for s in (START, QUOTED)}
    for f in elements:
        for g in (*_NEXT.values(), *into.values()):
            h = tuple(g[s] for s in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
    product = np.array([[index[tuple(g[s] for s in f)] for g in elements] for f in elements], dtype=np.uint8)
    return product, np.array(elements, dtype=np.uint8), np.array([index[_NEXT[c]] for c in range(4)], dtype=np.uint8), {s: index[f] for s, f in into.items()}


_PRODUCT, _STATES, _OF_CLASS, _RESET = _monoid()
_WIDTH = len(_STATES)
_FLAT = _PRODUCT.ravel()
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord('"')], _CLASS[ord(",")], _CLASS[SEPARATOR] = QUOTE, COMMA, END


def _prefixes(elements: np.ndarray, chunk: int) -> np.ndarray:
    """Product of all elements up to and including each one."""
    n = len(elements)
    chunk = max(2, chunk)
    count = -(-n // chunk) if n else 0
    if not count:
        return elements
    padded = np.zeros(count * chunk, dtype=np.uint8)
    padded[:n] = elements
    by_step = np.ascontiguousarray(padded.reshape(count, chunk).T)
    for j in range(1, chunk):
        by_step[j] = _FLAT[by_step[j - 1].astype(np.intp) * _WIDTH + by_step[j]]
    if count > 1:
        before = np.zeros(count, dtype=np.uint8)
        before[1:] = _prefixes(by_step[-1][:-1].copy(), chunk)
        by_step = _FLAT[before.astype(np.intp)[None, :] * _WIDTH + by_step]
    return np.ascontiguousarray(by_step.T).ravel()[:n]


def open_quotes(lines: pa.Array, chunk: int = 256) -> np.ndarray:
    """Two rows of booleans: whether the end of each line lies within quotes if its start does not, and if it does.

    A line that starts within quotes begins in the middle of a cell.
    """
    lines = lines.cast(pa.large_string()).fill_null("")
    if lines.offset:
        lines = pa.concat_arrays([lines])
    m = len(lines)
    ends = np.frombuffer(lines.buffers()[1], dtype=np.int64, count=m + 1) if m else np.zeros(1, np.int64)
    data = np.frombuffer(lines.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]] if lines.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = ends[1:] - ends[0] + np.arange(m)
    text = np.full(len(data) + m, SEPARATOR, dtype=np.uint8)
    inner = np.ones(len(text), dtype=bool)
    inner[at] = False
    text[inner] = data
    # each line's product: the prefix up to its end, taken from a start of its own
    elements = _OF_CLASS[_CLASS[text]]
    out = np.zeros((2, m), dtype=bool)
    starts = np.append(0, at[:-1] + 1) if m else at
    for h, opened in enumerate((False, True)):
        e = elements.copy()
        # a line's end puts the tokenizer where the next line is to start
        e[at] = _RESET[QUOTED if opened else START]
        states = _STATES[_prefixes(e, chunk), QUOTED if opened else START]
        last = at - 1
        before = np.where(last >= starts, states[np.maximum(last, 0)], QUOTED if opened else START)
        out[h] = before == QUOTED
    return out


class Cells:
    """What the tokenizer makes of an array of raw records (nulls count as empty).

    values: all cells, unquoted; first[i] and count[i]: the cells of record i;
    offset: byte offset of each cell within its record; bad[i]: offset of the
    first quoting error of record i, -1 if none.
    """

    def __init__(self, raw: pa.Array, chunk: int = 256):
        raw = raw.cast(pa.large_string()).fill_null("")
        if raw.offset:
            raw = pa.concat_arrays([raw])
        m = len(raw)
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=m + 1) if m else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
        separators = ends[1:] - ends[0] + np.arange(m)
        text = np.full(len(data) + m, SEPARATOR, dtype=np.uint8)
        inner = np.ones(len(text), dtype=bool)
        inner[separators] = False
        text[inner] = data
        kind = _CLASS[text]
        after = _STATES[_prefixes(_OF_CLASS[kind], chunk), START]
        before = np.zeros_like(after)
        before[1:] = after[:-1]
        boundary = (kind == END) | ((kind == COMMA) & ((before == START) | (before == PLAIN) | (before == CLOSED)))
        marks = np.flatnonzero(boundary)
        starts = np.zeros(len(marks), dtype=np.int64)
        starts[1:] = marks[:-1] + 1
        record_start = np.zeros(m, dtype=np.int64)
        record_start[1:] = separators[:-1] + 1
        last = np.searchsorted(marks, separators)
        self.first = np.zeros(m, dtype=np.int64)
        self.first[1:] = last[:-1] + 1
        self.count = last - self.first + 1
        self.offset = starts - np.repeat(record_start, self.count)
        self.length = separators - record_start
        self.bad = np.full(m, -1, dtype=np.int64)
        open_ = before[separators] == QUOTED
        self.bad[open_] = self.offset[last[open_]]
        entered = np.flatnonzero((after == BAD) & (before != BAD))
        of = np.searchsorted(separators, entered)
        self.bad[of] = entered - record_start[of]
        # the quotes that enclose a cell, and the first of each doubled pair, aren't content
        kept = ~boundary & ~((kind == QUOTE) & ((before == START) | (before == QUOTED)))
        so_far = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum(kept, out=so_far[1:])
        cuts = np.zeros(len(marks) + 1, dtype=np.int64)
        cuts[1:] = so_far[marks]
        self.values = pa.LargeStringArray.from_buffers(len(marks), pa.py_buffer(cuts.tobytes()), pa.py_buffer(text[kept].tobytes()))
