"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

Each of a fingerprint's 64 bits gets a vector of ``radius + 1`` binary digits that is not zero. For each of the
``2**(radius + 1) - 1`` vectors v there is a table, whose mask keeps the bits whose vectors have an odd product with v.
The vectors of up to ``radius`` differing bits span too little to reach every v, so some table's mask keeps none of them
and the two fingerprints fall into one bucket there: every pair within the radius is found.

``near_duplicates`` links by the fingerprints alone. ``keep_one`` wants texts that share so much of their shingles: fingerprints
within the radius propose pairs, the shingles decide. Most pairs that share 0.8 differ in more bits than any such radius, so
bands of least hashes propose the others (see ``near``).

Buckets of up to ``bucket`` fingerprints are searched by one task. In a larger one, fingerprints meet at the points halfway
between them instead: two are within the radius if and only if balls of half the radius around them share a point. That is
linear in the bucket and needs no task that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components
from . import near
from .common import clash, fresh, need, shingle_hashes, utf8, written
from .graph import dealt_join

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a bucket that one task compares.
BUCKET = 16_384
TOP = 1 << 63


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the shingles' XXH64; 0 without words. Signed, as Spark holds 64 bits."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle, seed):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint_bits", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with the new column ``into`` (long), the whole text's fingerprint; null and blank texts have 0."""
    need(docs, text)
    clash(docs, into)
    schema = docs.withColumn(into, F.lit(None).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                made = pa.array([fingerprint(t, shingle, seed) for t in utf8(batch.column(text))], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' masks, as signed 64-bit numbers."""
    vectors = [1 + k % (2 ** (radius + 1) - 1) for k in range(64)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << k for k, x in enumerate(vectors) if (x & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >= TOP else mask)
    return out


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, smallest member of its component) of one bucket's distinct fingerprints.

    Grows each component from a seed; what it has reached is not looked at again, so a dense bucket takes few passes.
    """
    left, out = np.sort(values).view(np.uint64), []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                new = left[near]
                left = left[~near]
                front.extend(new)
                out.extend((int(x), int(root.astype(np.int64))) for x in new.view(np.int64))
    return out


def links(prints: DataFrame, value: str = "fp", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints; their components are those of all pairs within ``radius`` bits."""
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col(value).bitwiseAND(F.lit(m)).alias("m")) for k, m in enumerate(masks(radius))])
    dealt = prints.select(F.col(value).alias("fp"), F.explode(tables).alias("x")).select("fp", "x.t", "x.m")
    sizes = written(dealt.groupBy("t", "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    cold, hot = sizes.where(F.col("n") <= bucket).select("t", "m"), sizes.where(F.col("n") > bucket).select("t", "m")

    def search(pdf):
        import pandas as pd

        found = bucket_links(pdf["fp"].to_numpy(np.int64), radius)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # few bytes can be much work here, so partitions aren't to be put together by their bytes
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = dealt.join(cold, ["t", "m"]).repartition(parts, "t", "m").groupBy("t", "m").applyInPandas(search, "a long, b long")
    if hot.isEmpty():
        return near.distinct()
    return near.unionByName(_ball_links(dealt.join(hot, ["t", "m"]).select("fp").distinct(), radius)).distinct()


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """All fingerprints are linked through the points of the balls of half the radius around them."""
    if radius % 2:
        raise ValueError("an even radius is needed")
    points = prints
    for step in range(radius // 2):
        ones = F.array(F.lit(0), *[F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k) for k in range(64)])
        held = "point" if step else "fp"
        points = points.select("fp", F.col(held).alias("held"), F.explode(ones).alias("flip")).select("fp", F.col("held").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    own = written(points.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(64))), "ball-points")
    least = own.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "b")
    # the centre of a dense group is a point of all its members: salts deal these over many tasks
    spread = own.select("point", "salt").distinct().join(least, "point")
    return own.join(spread, ["point", "salt"]).where("fp > b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Per row: ``key``, fingerprint (16 lowercase hex digits), component_id (the smallest ``key`` reachable by links, itself included).

    Fingerprints link at ``radius`` or fewer differing bits; equal ones are one node, so groups of copies cost one row.
    Null, empty and blank texts have fingerprint 0 and are linked like others. A null ``key`` stays null, has a component, and
    gives its id only where all keys of the component are null, as null. Repeated rows each give a row.
    """
    return _components_of(docs, key, text, radius, bucket).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components_of(docs: DataFrame, key: str, text: str, radius: int, bucket: int) -> DataFrame:
    need(docs, key, text)
    rows = written(fingerprints(docs.select(key, text), text, "fp").select(key, "fp"), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "prints")
    # the search for links is costly, and components read them several times
    roots = components(written(links(prints, "fp", radius, bucket), "links"))
    rooted = written(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    by_print = written(dealt_join(rooted.select("fp", "root"), ids, "root", "fp").select("fp", "component_id"), "components")
    return dealt_join(rows, by_print, "fp", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = near.SHINGLE, similar: tuple[int, int] = near.SIMILAR, radius: int = RADIUS, block: int = near.BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that with the smallest ``key`` (nulls last; of several such rows, one).

    Similar: of the distinct ``shingle``-word shingles of both, the share ``similar`` (a fraction, 4/5) at least is common.
    Fingerprints of these shingles within ``radius`` bits, found by covering tables, propose pairs, and so do bands of least
    hashes; the shingles decide. Texts without words, null ones among them, are copies of each other, as are texts of equal
    shingles. Repeated rows are copies. No rows give none. Other columns stay as they are.
    """
    need(docs, key, text)
    row, digest, size, keys, print_ = fresh(docs, "sg_row", "sg_digest", "sg_size", "sg_keys", "sg_print")
    # rows get their numbers as they are written, so these stand
    held = written(near.marked(docs, text, shingle, [digest, size, keys, print_]).withColumn(row, F.monotonically_increasing_id()), "near-docs")
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))).alias("first")
    # texts of equal shingles are one node, the row of the first of them
    nodes = written(held.groupBy(F.col(digest).alias("digest")).agg(first, F.min(row).alias("node")).drop("digest"), "nodes")
    mine = written(held.select(F.col(row).alias("node"), F.col(keys).alias("keys"), F.col(print_).alias("fp"), F.col(size).alias("size")).join(nodes.select("node"), "node", "left_semi"), "marks")
    prints = written(mine.where("size > 0").groupBy("fp").agg(F.min("node").alias("least")), "prints")
    close = links(prints.select("fp"), "fp", radius, bucket)
    ends = close.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("left")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("right")), "b")
    same = dealt_join(mine.where("size > 0").select("node", "fp"), prints, "fp", "node").where("node > least")
    proposed = ends.select(F.greatest("left", "right").alias("a"), F.least("left", "right").alias("b")).unionByName(same.select(F.col("node").alias("a"), F.col("least").alias("b"))).unionByName(near.proposed(mine))
    texts = held.select(F.col(row).alias("node"), F.col(text).alias("text"))
    roots = components(near.decided(components(written(proposed.distinct(), "proposed")), mine.select("node", "size"), texts, shingle, similar, block))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return held.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
