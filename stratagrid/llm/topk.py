"""Operator 5: exact top-k search with a vector-approximation file.

The approximations are a table of chunks: of each vector the number of the cell, of 2**BITS per component, in which each
component lies, the cells' edges, and where the exact vector is. The exact vectors are in files of their own, one behind the
other, so that any of them can be read alone.

A scan of the cells bounds each score from above and below; what can't be among the k best of its part any more is left out at
once, and what can't be among the k best of all, once the k-th lower bound over all parts is known. Exact vectors are then
read one by one, in the order of their bounds, best first, until no vector left can still be among the k best. No other part of
the exact files is ever read.

Queries are taken in blocks of bounded size, which go to all parts of the table; a query's candidates come to one task in order,
as a stream. Of vectors that are equal within a chunk, only those with the least ids that can ever be needed are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, new_path, written

K, SCALE, BITS = 5, 256, 8
#: Numbers in the queries of one block: 8 MB go to the workers at once.
BLOCK_NUMBERS = 1 << 20
#: Vectors of a chunk, queries that are searched for together, exact vectors read between two looks at the k-th score, and files that a task keeps open.
CHUNK, TOGETHER, ROUND, OPEN = 4_096, 512, 8, 64
TABLE = "n int, most double, ids binary, low binary, width binary, cells binary, kind string, file string, place long"
CANDIDATE = "query_id long, copy long, upper double, lower double, vec_id long, kind string, file string, at long"
FOUND = "query_id long, copy long, rank int, vec_id long, score long"


def whole_numbers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v``, floor(256 * x) of each component. Rows with a null key, vector or component, or a component that isn't finite, are left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * float(SCALE))).alias("v"))


class Cells:
    """The approximations of a chunk of vectors: cell numbers, and each component's least value and cell width."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cell: np.ndarray):
        self.low, self.width, self.cell = low, width, cell

    @staticmethod
    def of(v: np.ndarray) -> Cells:
        low, high = v.min(0), v.max(0)
        width = np.maximum(1, -(-(high - low + 1) // 2**BITS))
        return Cells(low, width, ((v - low) // width).astype(np.uint8))

    def middles(self) -> np.ndarray:
        return (self.low + (self.cell + 0.5) * self.width - 0.5).astype(np.float32)

    def slack(self, q: np.ndarray) -> np.ndarray:
        """By how much a score can differ from the single-precision product with the cells' middles.

        Half a cell per component, and the rounding of a sum of n products, which is below 2n units of 2**-24 of the sum of
        their sizes, with four more for the rounding of the factors.
        """
        size, farthest = np.abs(q), np.maximum(np.abs(self.low), np.abs(self.low + self.width * 2.0**BITS))
        return size @ ((self.width - 1) / 2) + (len(self.low) + 4) * 2.0**-23 * (size @ farthest) + 1


def candidates(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, cells: Cells, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, upper, lower bound) of what a chunk has that may be among the k best, by the lower bounds seen so far.

    ``lowest`` (queries x k): the k largest lower bounds of each query, which are brought up to date.
    """
    k, n, out = lowest.shape[1], len(ids), []
    middles = cells.middles()
    for first in range(0, len(q), TOGETHER):
        at = slice(first, first + TOGETHER)
        middle = (q[at].astype(np.float32) @ middles.T).astype(np.float64)
        slack = cells.slack(q[at].astype(np.float64))[:, None]
        own = q_ids[at, None] == ids[None, :]
        middle[own] = -np.inf
        best = np.partition(middle, n - k, axis=1)[:, n - k:] if n > k else middle
        lowest[at] = np.partition(np.concatenate([best - slack, lowest[at]], axis=1), -k, axis=1)[:, -k:]
        r, c = np.nonzero((middle + slack >= lowest[at].min(1)[:, None]) & ~own)
        out.append((r + first, c, (middle + slack)[r, c], (middle - slack)[r, c]))
    return tuple(np.concatenate([x[j] for x in out]) for j in range(4))  # type: ignore[return-value]


def resolve(rows: Iterator[tuple], queries: dict[int, np.ndarray], k: int, read: Callable[[str, int, int], bytes]) -> Iterator[tuple]:
    """Rows FOUND from rows CANDIDATE, which come query by query and by falling upper bounds. ``read`` (file, place, bytes) gives exact
    vectors; it is called in this order, and not any more once the k-th score is above all bounds that follow."""
    copy, best, waiting, done = None, [], [], True

    def look() -> None:
        q = queries[copy]
        for kind, file, at, vec_id in waiting:
            v = np.frombuffer(read(file, at, len(q) * np.dtype(kind).itemsize), kind)
            best.append((-int(v.astype(np.int64) @ q), vec_id))
        waiting.clear()
        best.sort()
        del best[k:]

    def end() -> Iterator[tuple]:
        if copy is not None:
            look()
            yield from ((query, copy, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(best, 1))

    query = None
    for query_id, own, upper, _, vec_id, kind, file, at in rows:
        if own != copy:
            yield from end()
            query, copy, done = query_id, own, False
            best.clear()
        if done:
            continue
        if len(waiting) >= ROUND or len(best) + len(waiting) == k:
            look()
        if len(best) == k and upper < -best[-1][0]:
            done = True
        else:
            waiting.append((kind, file, at, vec_id))
    yield from end()


def _least_of_equal(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Which rows stay when of equal vectors only those are kept, by their ids, that any query can need: ``k`` besides all of one id."""
    _, group = np.unique(v, axis=0, return_inverse=True)
    order = np.lexsort((ids, group))
    kept = np.zeros(len(ids), bool)
    sizes = np.bincount(group)
    start = 0
    for size in sizes.tolist():
        own = order[start:start + size]
        start += size
        if size > k + 1:
            _, first, many = np.unique(ids[own], return_index=True, return_counts=True)
            # the first rows of which k are left, whichever id is the query's
            fine = np.flatnonzero(np.cumsum(many) - np.maximum.accumulate(many) >= k)
            if len(fine):
                own = own[:first[fine[0]] + many[fine[0]]]
        kept[own] = True
    return np.flatnonzero(kept)


def approximation_file(vectors: DataFrame, k: int = K) -> tuple[DataFrame, str]:
    """The written table of ``vectors`` (id, v), a row per chunk of vectors of one length, and the folder with the exact vectors."""
    folder = new_path(vectors.sparkSession, "exact-vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        held: dict[int, list] = {}
        with files.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                sizes = lists.value_lengths().to_numpy()
                flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
                for n in map(int, np.unique(sizes)):
                    at = np.flatnonzero(sizes == n)
                    held.setdefault(n, []).append((ids[at], flat[starts[at][:, None] + np.arange(n)[None, :]] if n else np.zeros((len(at), 0), np.int64)))
                    if sum(len(x[0]) for x in held[n]) >= CHUNK:
                        yield from _chunks(held.pop(n), k, name, out)
            for own in held.values():
                yield from _chunks(own, k, name, out)

    return written(vectors.mapInArrow(run, TABLE), "vector-cells"), folder


def _chunks(held: list, k: int, name: str, out: pa.NativeFile) -> Iterator[pa.RecordBatch]:
    ids, v = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    for first in range(0, len(ids), CHUNK):
        i, own = ids[first:first + CHUNK], v[first:first + CHUNK]
        kept = _least_of_equal(i, own, k)
        i, own = i[kept], own[kept]
        most = max(abs(float(own.min(initial=0))), abs(float(own.max(initial=0))))
        if own.shape[1] * most * most >= 2.0**63:
            raise ValueError(f"the product of two vectors with {own.shape[1]} components of up to {most:g} does not fit a long")
        cells = Cells.of(own)
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        row = [own.shape[1], most, i.tobytes(), cells.low.tobytes(), cells.width.tobytes(), cells.cell.tobytes(), kind, name, out.tell()]
        out.write(own.astype(kind).tobytes())
        types = [pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in TABLE.split(", ")])


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = K, block: int = BLOCK_NUMBERS, read_bytes: Accumulator | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each query with all other rows.

    Queries are the rows whose ``key`` is divisible by ``every``. Scores are of whole numbers, floor(256 * x); ties go to the smaller id.
    Components so large that a score might not fit a long are an error. Rows with a null key, vector or component, or one that isn't
    finite, take no part. Vectors of other lengths than the query's do not count as candidates for it. Each row counts: a repeated
    query is answered as often as it occurs, a repeated candidate takes as many ranks; but no row with the query's own id counts.
    An empty table gives no rows. Other columns do not matter. ``read_bytes`` is increased by the bytes of exact vectors that are read.
    """
    need(df, key, vector)
    spark, vectors = df.sparkSession, whole_numbers(df, key, vector)
    cells, folder = approximation_file(vectors, k)
    # the largest numbers may be in different chunks
    reach = cells.groupBy("n").agg(F.max(F.col("n") * F.col("most") * F.col("most")).alias("reach")).agg(F.max("reach")).first()[0]
    if reach is not None and reach >= 2.0**63:
        raise ValueError("the product of two vectors does not fit a long")
    asked = written(vectors.where(F.col("id") % every == 0), "queries")
    path, held, size = new_path(spark, "nearest"), [], 0
    for copy, row in enumerate(asked.toLocalIterator()):
        held.append((row["id"], copy, row["v"]))
        size += len(row["v"]) + 2
        if size >= block:
            _block(cells, folder, held, k, path, read_bytes)
            held, size = [], 0
    _block(cells, folder, held, k, path, read_bytes)
    return spark.read.schema(FOUND).parquet(path).select("query_id", "rank", "vec_id", "score")


def _block(table: DataFrame, folder: str, rows: list, k: int, path: str, read_bytes: Accumulator | None) -> None:
    """Adds the ``k`` best for each query of a block to the table at ``path``."""
    by_length: dict[int, list] = {}
    for x in rows:
        by_length.setdefault(len(x[2]), []).append(x)
    queries = {n: (np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64), np.array([x[2] for x in own], np.int64).reshape(len(own), n)) for n, own in by_length.items()}
    shipped = table.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        lowest = {n: np.full((len(own[0]), k), -np.inf) for n, own in asked.items()}
        for batch in batches:
            for r in range(batch.num_rows):
                n, ids, low, width, cell, kind, file, place = (batch.column(c)[r] for c in ("n", "ids", "low", "width", "cells", "kind", "file", "place"))
                n, see = n.as_py(), lambda x, t: np.frombuffer(x.as_buffer(), t) if len(x.as_buffer()) else np.zeros(0, t)
                ids, kind = see(ids, np.int64), kind.as_py()
                cells = Cells(see(low, np.int64), see(width, np.int64), see(cell, np.uint8).reshape(len(ids), n))
                q, c, upper, lower = candidates(asked[n][0], asked[n][2], ids, cells, lowest[n])
                for a in range(0, len(q), 65_536):
                    at = slice(a, a + 65_536)
                    same = lambda x, at=at: pa.array([x]).take(pa.array(np.zeros(len(q[at]), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked[n][0][q[at]], asked[n][1][q[at]], upper[at], lower[at], ids[c[at]])] + [same(kind), same(file.as_py()), pa.array(place.as_py() + c[at] * n * np.dtype(kind).itemsize)], names=[x.split()[0] for x in CANDIDATE.split(", ")])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, where = fs.FileSystem.from_uri(folder)
        held: dict = {}
        asked = {int(copy): v for _, copies, vectors in shipped.value.values() for copy, v in zip(copies, vectors, strict=True)}

        def read(file: str, at: int, size: int) -> bytes:
            if file not in held:
                if len(held) >= OPEN:
                    held.pop(next(iter(held))).close()
                held[file] = files.open_input_file(f"{where}/{file}")
            if read_bytes is not None:
                read_bytes.add(size)
            return held[file].read_at(size, at)

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = list(zip(*resolve(rows, asked, k, read), strict=True)) or [()] * 5
        for x in held.values():
            x.close()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    own = table.where(F.col("n").isin(list(queries)) if queries else F.lit(False)).drop("most")
    near = written(own.mapInArrow(scan, CANDIDATE), "candidates")
    # a row per query of the block: the k-th lower bound over all parts
    by = Window.partitionBy("copy").orderBy(F.col("lower").desc())
    floors = near.select("copy", "lower").withColumn("sg_n", F.row_number().over(by)).where(F.col("sg_n") <= k).groupBy("copy").agg(F.min("lower").alias("floor"), F.count(F.lit(1)).alias("seen"))
    left = near.join(F.broadcast(floors), "copy").where((F.col("seen") < k) | (F.col("upper") >= F.col("floor"))).select(*near.columns)
    left.repartition("copy").sortWithinPartitions("copy", F.col("upper").desc(), "vec_id").mapInArrow(fetch, FOUND).write.mode("append").parquet(path)
    shipped.destroy()
