"""Operator 3: benchmark decontamination by Wu-Manber search over words.

The benchmark's windows are the patterns, words the symbols. A table of one byte for each hash of a block of two words says
how far the search may move on without missing a window, so most positions are never looked at. Where it says 0, the hash of
the window's last two words, its suffix, together with that of its first two, its prefix, picks a bucket, and each window in
it is compared with the text word by word.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, clash, fresh, held, need, new_path, utf8, written

#: Words in a window.
WINDOW = 10
#: Benchmark text, in bytes, that one search holds: its index has about eight times as many. A larger benchmark is searched for
#: in several passes over the documents.
BLOCK_BYTES = 16 << 20
#: Entries of the shift table, a byte each.
SHIFTS = 1 << 22
LOW = (1 << 64) - 1


def words_of(text: bytes | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.translate(ALNUM_WORDS).split() if text else []


def _bucket(suffix: int, prefix: int) -> int:
    return (suffix ^ (prefix * 0x9E3779B97F4A7C15)) & LOW


class Search:
    """Wu-Manber over the windows of ``m`` words that start at the places ``at`` of ``words``; ``owners`` has the number of each one's item."""

    def __init__(self, words: list[bytes], at: Sequence[int], owners: Sequence[int], m: int):
        self.m, self.b, self.words = m, min(2, m), words
        b, far = self.b, m - self.b + 1
        self.shift, self.mask = bytearray([min(far, 255)]) * SHIFTS, SHIFTS - 1
        keys = np.empty(len(at), np.uint64)
        for k, start in enumerate(at):
            for end in range(start + b, start + m + 1):
                h, move = hash(tuple(words[end - b:end])) & self.mask, start + m - end
                if move < self.shift[h]:
                    self.shift[h] = move
            keys[k] = _bucket(hash(tuple(words[start + m - b:start + m])), hash(tuple(words[start:start + b])))
        # buckets: distinct windows in the order of their keys, each with its items, in flat arrays
        order = np.argsort(keys, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(keys[order]) != 0, True)) + 1 if len(at) else []
        self.keys, self.at, self.ends, self.items = array("Q"), array("q"), array("q"), array("q")
        begin = 0
        for end in ends:
            same: dict[tuple[bytes, ...], tuple[int, set[int]]] = {}
            for k in order[begin:end].tolist():
                same.setdefault(tuple(words[at[k]:at[k] + m]), (at[k], set()))[1].add(owners[k])
            for start, own in same.values():
                self.keys.append(int(keys[order[begin]]))
                self.at.append(start)
                self.items.extend(sorted(own))
                self.ends.append(len(self.items))
            begin = end

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start in ``text``, number of the window) of each occurrence of each distinct window."""
        m, b, n, shift, mask, keys, words = self.m, self.b, len(text), self.shift, self.mask, self.keys, self.words
        end, last = m, len(keys)
        while end <= n:
            suffix = hash((text[end - 2], text[end - 1]) if b == 2 else (text[end - 1],))
            move = shift[suffix & mask]
            if move:
                end += move
                continue
            start = end - m
            key = _bucket(suffix, hash(tuple(text[start:start + b])))
            k = bisect_left(keys, key)
            while k < last and keys[k] == key:
                at = self.at[k]
                if words[at:at + m] == text[start:end]:
                    yield start, k
                k += 1
            end += 1

    def owners(self, k: int) -> array:
        """The numbers of the items that have window ``k``."""
        return self.items[self.ends[k - 1] if k else 0:self.ends[k]]


class Benchmark:
    """The windows of ``items`` (id, text); one search for each length."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int):
        self.ids: list[object] = []
        words: list[bytes] = []
        known: dict[bytes, bytes] = {}
        by_length: dict[int, tuple[array, array]] = defaultdict(lambda: (array("q"), array("q")))
        for item, text in items:
            own = [known.setdefault(w, w) for w in words_of(text)]
            if own:
                m = min(window, len(own))
                at, owners = by_length[m]
                at.extend(range(len(words), len(words) + len(own) - m + 1))
                owners.extend([len(self.ids)] * (len(own) - m + 1))
                self.ids.append(item)
                words += own
        self.searches = [(m, Search(words, at, owners, m)) for m, (at, owners) in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, in order and disjoint, and the items that occur."""
        spans, items = [], set()
        for m, search in self.searches:
            seen = set()
            for at, k in search.occurrences(words):
                spans.append((at, at + m))
                seen.add(k)
            for k in seen:
                items.update(search.owners(k))
        found = {self.ids[k] for k in items}
        found.discard(None)
        return _joined(spans), found


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The benchmark in blocks of about ``limit`` bytes of text, one at a time in the driver."""
    held, size = [], 0
    for row in benchmark.select(item, F.col(text).cast("binary")).toLocalIterator():
        value = bytes(row[1]) if row[1] is not None else None
        held.append((row[0], value))
        size += len(value or b"") + 64
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """Per row of ``docs``: ``key``, n_words, n_hit, n_items, items_sha256, contaminated, and ``hits``, the hit word spans [start, end).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A word is hit if it lies in any
    occurrence of any window. ``keep``: all columns of ``docs`` stay, instead of ``key`` alone; none may be named like the new ones.

    Documents stay where they lie: the benchmark's windows go to them, in blocks of at most ``block_bytes`` of its text. If there
    is more than one block, documents are written once with a row number, each block's hits are written by row number, and
    these are put together at the end.
    Nulls: a null text has no words; items without an id mark words but are not counted; an item that occurs twice counts
    once. Repeated rows each give a row. An empty benchmark hits nothing, and no documents give no rows.
    """
    need(docs, key, text)
    need(benchmark, item, item_text)
    clash(docs if keep else docs.select(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
    spark = docs.sparkSession
    base = docs if keep else docs.select(key, text)
    row, spans, items = fresh(base, "sg_row", "sg_spans", "sg_items")
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    stay = [c for c in base.columns if keep or c == key]
    if after is None:
        search = _search(spark.sparkContext.broadcast(block), window)
        return _summed(base, text, lambda _, words: [search().hits(w) for w in words], stay)
    numbered, path = written(base.withColumn(row, F.monotonically_increasing_id()), "decontaminate"), new_path(spark, "hits")
    while block is not None:
        shipped = spark.sparkContext.broadcast(block)
        _hits(numbered.select(row, text), _search(shipped, window), row, text, spans, items).write.mode("append").parquet(path)
        shipped.destroy()
        block, after = after, next(blocks, None)
    hits = spark.read.schema(f"{row} long, {spans} array<bigint>, {items} array<string>").parquet(path)
    by_row = hits.groupBy(row).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_distinct(F.flatten(F.collect_list(items))).alias(items))

    def both(batch: pa.RecordBatch, _) -> list[tuple[list, list]]:
        flat = [x or [] for x in batch.column(spans).to_pylist()]
        return [(_joined(list(zip(x[::2], x[1::2], strict=True))), i or []) for x, i in zip(flat, batch.column(items).to_pylist(), strict=True)]

    return _summed(numbered.join(by_row, row, "left").drop(row), text, both, stay)


def _search(shipped, window: int) -> Callable[[], Benchmark]:
    """The searches of a block, built once in each worker."""
    identity = uuid.uuid4().hex
    return lambda: held(identity, lambda: Benchmark(shipped.value, window))


def _hits(df: DataFrame, search: Callable[[], Benchmark], row: str, text: str, spans: str, items: str) -> DataFrame:
    """Of the rows that are hit: row, the hit spans (starts and ends in turn) and the items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                found = [search().hits(words_of(value)) for value in utf8(batch.column(text))]
                at = [k for k, (s, _) in enumerate(found) if s]
                made = [pa.array([[x for pair in found[k][0] for x in pair] for k in at], pa.list_(pa.int64())), pa.array([sorted(map(str, found[k][1])) for k in at], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(row).take(pa.array(at, pa.int64())), *made], names=[row, spans, items])

    return df.mapInArrow(run, f"{row} long, {spans} array<bigint>, {items} array<string>")


def _summed(df: DataFrame, text: str, found: Callable[[pa.RecordBatch, list[list[bytes]]], list[tuple[list, Iterable]]], stay: list[str]) -> DataFrame:
    """The columns ``stay`` and the result's own; ``found`` gives spans and items of a batch's rows, of which it also gets the words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    mine = F.lit(None)
    schema = df.select(*stay).withColumns({"n_words": mine.cast("bigint"), "n_hit": mine.cast("bigint"), "n_items": mine.cast("bigint"), "items_sha256": mine.cast("string"), "contaminated": mine.cast("boolean"), "hits": mine.cast("array<struct<start:bigint,end:bigint>>")}).schema
    target = to_arrow_schema(schema)
    own = list(target)[len(stay):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                words = [words_of(value) for value in utf8(batch.column(text))]
                made: list[list] = [[] for _ in own]
                for w, (spans, items) in zip(words, found(batch, words), strict=True):
                    ids, hit = sorted(map(str, items)), sum(b - a for a, b in spans)
                    for c, x in zip(made, (len(w), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0, [{"start": a, "end": b} for a, b in spans]), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), *(pa.array(c, f.type) for c, f in zip(made, own, strict=True))], names=[f.name for f in target])

    return df.mapInArrow(run, schema)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, of any."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
