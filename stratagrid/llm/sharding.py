"""Operator 7: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows go from each partition to each shard is drawn exactly, as a uniform permutation of all rows would have it.
Each partition puts its rows into a random order and deals them out by its row of the matrix; each shard puts what it
gets into a random order again. Rows are exchanged once. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, new_path, written

SHARDS, SEED = 40, 42
#: Numbers (partitions x shards) that the driver draws and every task gets, at most; more partitions are read several to a task.
MOST_NUMBERS = 4_000_000
#: Partitions whose rows of the matrix go into one plan.
PLAN_ROWS = 2_000
#: Rows, about, of a shard that one task puts into order.
BLOCK_ROWS, LEAST_BLOCKS = 200_000, 8
ROW_BITS = 33  # monotonically_increasing_id(): the partition above, the row below


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good`` + ``bad`` are good. Exact up to the precision of doubles, for any size.

    Small cases draw one by one; the others use the ratio of uniforms (Stadlober, 1990), whose cost does not depend on the sizes.
    """
    total = good + bad
    if draws > total - draws:
        return good - hypergeometric(rng, good, bad, total - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    if good == 0 or draws == 0:
        return 0
    if draws <= 12:
        left, found = good, 0
        for k in range(draws):
            if rng.random() * (total - k) < left:
                left, found = left - 1, found + 1
        return found
    share = good / total
    centre = draws * share + 0.5
    scale = math.sqrt((total - draws) * draws * share * (1 - share) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * scale + (3 - 2 * math.sqrt(3 / math.e))
    mode = (draws + 1) * (good + 1) // (total + 2)
    most = min(min(draws, good) + 1, math.floor(centre + 16 * scale))
    while True:
        x, y = rng.random(), rng.random()
        w = centre + width * (y - 0.5) / x if x else -1.0
        if not 0 <= w < most:
            continue
        k = math.floor(w) - mode
        if 2 * math.log(x) <= -(_log_step(mode, k) + _log_step(good - mode, -k) + _log_step(draws - mode, -k) + _log_step(bad - draws + mode, k)):
            return mode + k


def _log_step(n: int, k: int) -> float:
    """log((n + k)!) - log(n!). By Stirling's series for large numbers, where the difference of two lgammas would lose all its digits."""
    if min(n, n + k) < 1000:
        return math.lgamma(n + k + 1) - math.lgamma(n + 1)
    tail = lambda m: 1 / (12 * m) - 1 / (360 * m**3)
    return (n + 0.5) * math.log1p(k / n) + k * (math.log(n + k) - 1) + tail(n + k) - tail(n)


def matrix(counts: Sequence[int], sizes: Sequence[int], seed: int = SEED) -> list[list[int]]:
    """Rows from each partition to each shard: row sums ``counts``, column sums ``sizes``."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest = [], sum(left)
        for k, room in enumerate(left):
            got = hypergeometric(rng, room, rest - room, n) if n else 0
            row.append(got)
            n, rest = n - got, rest - room
            left[k] = room - got
        out.append(row)
    return out


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard): a uniform random permutation of the rows.

    Shards' row counts differ by one at most. Rows are told apart by where they lie, so null and repeated rows, of whatever
    number, are dealt out like all others. The driver gets one count per partition and draws partitions x shards numbers, at
    most ``MOST_NUMBERS``: beyond that a task reads several partitions. An empty table stays empty. Columns named like
    ``shard`` or ``slot`` must not be there.
    """
    if clash := {c.lower() for c in df.columns} & {shard.lower(), slot.lower()}:
        raise ValueError(f"there are columns {sorted(clash)} already")
    first, second, place, part, ends, block, rank, before = fresh(df, "sg_first", "sg_second", "sg_place", "sg_part", "sg_ends", "sg_block", "sg_rank", "sg_before")
    # the random keys are fixed by writing them, before anything is counted
    keyed = df.coalesce(max(1, MOST_NUMBERS // shards)).withColumns({first: F.rand(_stream(seed, "first")), second: F.rand(_stream(seed, "second"))})
    local = written(keyed.sortWithinPartitions(first).withColumn(place, F.monotonically_increasing_id()).drop(first), "shuffle")
    local = local.withColumn(part, F.shiftright(place, ROW_BITS))
    counts = sorted(tuple(r) for r in local.groupBy(part).count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    drawn = zip((p for p, _ in counts), matrix([n for _, n in counts], sizes, seed), strict=True)
    dealt = _as_table(df.sparkSession, [{part: p, ends: [sum(row[:k + 1]) for k in range(shards)]} for p, row in drawn], f"{part}: bigint, {ends}: array<bigint>")
    blocks = max(LEAST_BLOCKS, -(-total // (shards * BLOCK_ROWS)))
    row_in_part = F.col(place).bitwiseAND((1 << ROW_BITS) - 1)
    # at most MOST_NUMBERS numbers
    out = local.join(F.broadcast(dealt), part).withColumn(shard, F.size(F.filter(ends, lambda e: e <= row_in_part)))
    # ordering by (block, second) is ordering by second: a shard's blocks can be ordered by several tasks
    out = out.withColumn(block, F.floor(F.col(second) * blocks)).drop(ends, part)
    sums = out.groupBy(shard, block).count()
    offsets = sums.withColumn(before, F.sum("count").over(Window.partitionBy(shard).orderBy(block)) - F.col("count")).drop("count")
    numbered = out.withColumn(rank, F.row_number().over(Window.partitionBy(shard, block).orderBy(second, place)) - 1)
    return numbered.join(offsets, [shard, block]).withColumn(slot, F.col(before) + F.col(rank)).select(*df.columns, shard, slot)


def _stream(seed: int, name: str) -> int:
    """A seed of its own for each use. Spark adds the partition's number to the seed, so streams of neighbouring seeds are each other's, shifted by a partition."""
    return int.from_bytes(hashlib.blake2b(f"{seed}/{name}".encode(), digest_size=8).digest(), "big", signed=True)


def _as_table(spark, rows: list[dict], columns: str) -> DataFrame:
    """``rows`` as a written table; no plan holds more than ``PLAN_ROWS`` of them."""
    path, kind = new_path(spark, "matrix"), f"array<struct<{columns}>>"
    for k in range(0, max(1, len(rows)), PLAN_ROWS):
        some = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows[k:k + PLAN_ROWS])), kind)).alias("x")).select("x.*")
        some.write.mode("append").parquet(path)
    return spark.read.schema(columns.replace(": ", " ")).parquet(path)
