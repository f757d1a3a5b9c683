"""How operator 6 finds texts that share so much of their word shingles (Jaccard) where fingerprints can't tell.

MinHash bands propose: texts that agree on all rows of some band are linked, and connected parts of all proposed links hold
all that can be similar. Within each part the shingles themselves decide, so no link below the wanted similarity is made. At
exactly 0.8, 40 bands of 5 rows miss one pair in eight million (``(1 - 0.8**5)**40``), above it fewer.

Parts with many shingles are dealt into blocks, and each pair of blocks is a group of its own: all pairs of the part meet, and
no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, shingle_hashes, utf8, written

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction, so that comparing is exact.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 5
#: Shingles of a block.
BLOCK = 1_000_000
SALTS = 64


def shingles(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, ascending; shorter texts are one shingle, those without words have none."""
    parts = [h.astype(np.uint64) for h in shingle_hashes(text, shingle, seed)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the distinct hashes."""
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


@cache
def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 64, (n, 1), np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def bands(hashes: np.ndarray, count: int = BANDS, rows: int = ROWS) -> list[int]:
    """A signed 64-bit key per band; none without shingles."""
    import xxhash

    if not len(hashes):
        return []
    a, b = _mixers(count * rows)
    least = np.full(count * rows, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[k:k + 2048] * a + b).min(axis=1), out=least)
    raw = least.tobytes()
    return [int.from_bytes(xxhash.xxh64_digest(raw[t * rows * 8:(t + 1) * rows * 8], t), "big", signed=True) for t in range(count)]


def similar_links(ids: list[int], sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Links (larger, smaller id) whose components are those of all pairs of ``sets`` with at least this similarity.

    Grows each component from a seed; what it has reached is not looked at again, so a dense group takes few passes.
    """
    p, q = similar
    left, out = np.arange(len(ids)), []
    size = np.array([len(s) for s in sets], np.int64)
    front: list[int] = []
    while len(left) > (0 if front else 1):
        if not front:
            front, left = [int(left[0])], left[1:]
        # postings of what is left, made anew whenever half of it is reached
        flat = np.concatenate([sets[k] for k in left])
        order = np.argsort(flat, kind="stable")
        tokens, holders = flat[order], np.repeat(np.arange(len(left)), size[left])[order]
        open_, whole = np.ones(len(left), bool), len(left)
        while open_.any() and 2 * open_.sum() >= whole:
            if not front:
                seed = int(np.flatnonzero(open_)[0])
                open_[seed] = False
                front = [int(left[seed])]
                continue
            at = front.pop()
            lo, hi = np.searchsorted(tokens, sets[at], "left"), np.searchsorted(tokens, sets[at], "right")
            n = hi - lo
            within = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            both = np.bincount(holders[within], minlength=whole)
            # both / (x + y - both) >= p / q
            near = np.flatnonzero(open_ & (both * (p + q) >= p * (size[left] + size[at])))
            open_[near] = False
            for k in left[near].tolist():
                front.append(k)
                out.append((max(ids[k], ids[at]), min(ids[k], ids[at])))
        left = left[open_]
    return out


def marked(docs: DataFrame, text: str, shingle: int, names: list[str]) -> DataFrame:
    """``docs`` with the digest of each text's distinct shingles, their number, their bands and their fingerprint, under the four ``names``."""
    digest, size, keys, print_ = names
    schema = docs.withColumns({digest: F.lit(b"").cast("binary"), size: F.lit(0).cast("bigint"), keys: F.lit(None).cast("array<bigint>"), print_: F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        let_go()
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                made: list[list] = [[], [], [], []]
                for t in utf8(batch.column(text)):
                    s = shingles(t, shingle)
                    for c, x in zip(made, (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), bands(s), fingerprint(s)), strict=True):
                        c.append(x)
                types = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(made, types, strict=True))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def proposed(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of each band's members (``node``, ``keys``) with its smallest; salts deal large bands over many tasks."""
    own = nodes.select("node", F.explode("keys").alias("band")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    least = written(own.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "b"), "bands")
    spread = own.select("band", "salt").distinct().join(least, "band")
    return own.join(spread, ["band", "salt"]).where("node > b").select(F.col("node").alias("a"), "b")


def decided(parts: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Links (a, b) within the proposed ``parts`` (node, root), by the shingles of ``texts`` (node, text) themselves, as a written table."""
    parts = parts.select("node", F.col("root").alias("part"))
    members = written(parts.unionByName(parts.select(F.col("part").alias("node"), "part").distinct()), "parts")
    blocks = members.join(sizes, "node").groupBy("part").agg(F.ceil(F.sum("size") / block).cast("int").alias("n"))
    k = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = members.join(blocks, "part").withColumn("k", k).withColumn("l", F.explode(F.expr("sequence(0, n - 1)"))).where("n = 1 OR k != l")
    dealt = dealt.select("node", "part", F.least("k", "l").alias("i"), F.greatest("k", "l").alias("j"))
    return written(_decided(texts.join(dealt, "node").select("part", "i", "j", "node", "text"), shingle, similar).distinct(), "decided")


def _decided(texts: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b) by the shingles themselves, of rows (part, i, j, node, text) of one group (part, i, j) each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = similar_links(ids, sets, similar)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "i", "j", "node")]
            for *group, node, text in zip(*columns, utf8(batch.column("text")), strict=True):
                if group != now:
                    if len(ids) > 1:
                        yield links()
                    now, ids, sets = group, [], []
                ids.append(node)
                sets.append(shingles(text, shingle))
        if len(ids) > 1:
            yield links()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(parts, "part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(run, "a long, b long")
