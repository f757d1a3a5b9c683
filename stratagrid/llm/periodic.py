"""Operator 11: runs, that is stretches of words that repeat with a period, by a harmonic grid.

For each period q the places 0, q, 2q, ... of a text form a grid. A run of period q is at least 2q long, so it holds two
neighbouring places of that grid, and reaches as far to both sides as the words at these two places go on to be equal. Over
all periods a text of n words has about n ln n such pairs. Prefix hashes in NumPy arrays tell for all pairs at once, by
binary search, how far the equality reaches (longest common extension, LCE); pairs of one run give the same stretch, which
is kept once, with its smallest period.

Equal words always have equal hashes, so a stretch can come out too long, never too short. Each distinct stretch is therefore
compared word by word; should one fail, the text is done again with another base. What is returned is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash, let_go, need, utf8

#: Words that a run has at least.
LEAST = 12
#: Modulus and first base of the prefix hashes.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
#: Texts of up to so many words take their pairs from one table; pairs of longer texts are made as they are needed, so many at once.
TABLE, BLOCK = 1 << 15, 1 << 18

_tables: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**k mod PRIME for k < n at least; those of the first base are remembered."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.int64) if have is None else have
        step = pow(base, len(have), PRIME)
        while len(have) < n:
            have = np.concatenate([have, have * step % PRIME])
            step = step * step % PRIME
        if base == BASE and n <= TABLE * 2:
            _tables[base] = have
    return have


def _grid() -> tuple[np.ndarray, np.ndarray]:
    """Periods q and places j = kq, k >= 1, of all pairs (j - q, j) below TABLE, ordered by j: those of n words come first."""
    if "grid" not in _tables:
        q = np.concatenate([np.arange(1, (TABLE - 1) // k + 1, dtype=np.int32) for k in range(1, TABLE)])
        j = np.concatenate([np.arange(k, TABLE, k, dtype=np.int32) for k in range(1, TABLE)])
        order = np.argsort(j, kind="stable")
        _tables["grid"] = q[order], j[order]
    return _tables["grid"]


def pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (periods, later places) of all pairs of neighbouring grid places of ``n`` words, for periods that can have a run."""
    if n <= TABLE:
        q, j = _grid()
        end = int(np.searchsorted(j, n))
        for a in range(0, end, BLOCK):
            yield q[a:min(end, a + BLOCK)], j[a:min(end, a + BLOCK)]
        return
    q = 1
    while q <= n // 2:
        places = (n - 1) // q
        if places > BLOCK:
            for a in range(1, places + 1, BLOCK):
                k = np.arange(a, min(places + 1, a + BLOCK), dtype=np.int64)
                yield np.full(len(k), q, np.int64), k * q
            q += 1
        else:
            qs = np.arange(q, min(q + BLOCK // places, n // 2 + 1), dtype=np.int64)
            counts = (n - 1) // qs
            k = np.arange(counts.sum(), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            each = np.repeat(qs, counts)
            yield each, k * each
            q += len(qs)


def _extension(equal, most: np.ndarray) -> np.ndarray:
    """For each pair the largest length, up to ``most``, for which ``equal(which, lengths)`` holds, by doubling and halving for all at once."""
    out = np.zeros(len(most), np.int64)
    step = np.ones(len(most), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):  # the first power of two that does not fit any more
        size = out[live] + step[live]
        good = size <= most[live]
        good[good] = equal(live[good], size[good])
        out[live[good]] = size[good]
        live = live[good]
        step[live] *= 2
    step //= 2
    live = np.flatnonzero(step > 0)
    while len(live):
        size = out[live] + step[live]
        good = size <= most[live]
        good[good] = equal(live[good], size[good])
        out[live[good]] = size[good]
        step[live] //= 2
        live = live[step[live] > 0]
    return out


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of each run of the numbered words ``ids``, ordered by start, then period. Runs of fewer than
    ``least`` words are left out."""
    n, attempt = len(ids), 0
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    while (found := _runs(ids, n, least, BASE + 2 * attempt)) is None:
        attempt += 1
    return found


def _runs(ids: np.ndarray, n: int, least: int, base: int) -> np.ndarray | None:
    """None if two different stretches had equal hashes."""
    # words that must be equal on one side at least: a run's stretch has max(q, least - q) equal words or more
    side = (max(1, (least + 1) // 2) + 1) // 2
    padded = np.concatenate([np.full(side, -1, np.int32), ids.astype(np.int32), np.full(side, -2, np.int32)])
    power = prefix = None
    found = []
    for q, j in pairs(n):
        at = j + np.int32(side)
        hit = np.flatnonzero(padded[at] == padded[at - q])
        if not len(hit):
            continue
        at, q = at[hit].astype(np.int64), q[hit].astype(np.int64)
        right, left = np.ones(len(at), bool), np.ones(len(at), bool)
        for d in range(1, side):
            right &= padded[at + d] == padded[at + d - q]
        for d in range(1, side + 1):
            left &= padded[at - d] == padded[at - d - q]
        near = np.flatnonzero(right | left)
        if not len(near):
            continue
        j, q = at[near] - side, q[near]
        i = j - q
        if prefix is None:
            power = _powers(base, n + 1)
            prefix = np.zeros(n + 1, np.int64)
            np.cumsum((ids.astype(np.int64) + 1) * power[:n] % PRIME, out=prefix[1:])
            prefix %= PRIME
        shift = power[q]

        def forward(k: np.ndarray, size: np.ndarray) -> np.ndarray:
            a, b = i[k], j[k]
            return (prefix[a + size] - prefix[a] + PRIME) * shift[k] % PRIME == (prefix[b + size] - prefix[b] + PRIME) % PRIME

        def backward(k: np.ndarray, size: np.ndarray) -> np.ndarray:
            a, b = i[k], j[k]
            return (prefix[a] - prefix[a - size] + PRIME) * shift[k] % PRIME == (prefix[b] - prefix[b - size] + PRIME) % PRIME

        ahead, back = _extension(forward, n - j), _extension(backward, i)
        length = q + ahead + back
        good = length >= np.maximum(2 * q, least)
        if good.any():
            found.append(np.unique(np.column_stack([i - back, length, q])[good], axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.unique(np.concatenate(found), axis=0)
    # the same stretch with a multiple of its period is no other run; the smallest comes first
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[first]
    for start, length, q in every.tolist():
        if not np.array_equal(ids[start:start + length - q], ids[start + q:start + length]):
            return None
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def collapse(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: not those that some run holds after its first period."""
    kept = np.ones(n, bool)
    for start, length, q in runs.tolist():
        kept[start + q:start + length] = False
    return kept


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period, by start, then period) and collapsed (the words that no run
    repeats, joined by one blank).

    Words are ``[^\\x20\\x09-\\x0D]+``, told apart byte by byte. A run is a stretch with smallest period q, of max(``least``, 2q) words
    or more, that no neighbouring word extends. Null, empty and blank texts: no words, no runs, an empty ``collapsed``. A text of any
    length is one task's row, in memory that grows with its words; its pairs are made in blocks. Repeated rows each give a row, and
    no rows none. No columns n_words, runs, collapsed may be there before.
    """
    need(docs, text)
    clash(docs, "n_words", "runs", "collapsed")
    if least < 2:
        raise ValueError("least must be 2 or more")
    none = F.lit(None)
    schema = docs.withColumns({"n_words": none.cast("bigint"), "runs": none.cast("array<struct<start:bigint,length:bigint,period:bigint>>"), "collapsed": none.cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                counts, found, left = [], [], []
                for value in utf8(batch.column(text)):
                    words = value.split() if value else []
                    number: dict = {}
                    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
                    # without repeated words there is nothing to find
                    own = runs_of(ids, least) if len(number) < len(words) else np.zeros((0, 3), np.int64)
                    if len(own):
                        words = [words[k] for k in np.flatnonzero(collapse(len(ids), own)).tolist()]
                    counts.append(len(ids))
                    found.append(own)
                    left.append(b" ".join(words))
                flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                ends = np.cumsum([0, *map(len, found)])
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(kind)))
                made = [pa.array(counts, pa.int64()), runs, pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, schema)
