"""Operator 8: line deduplication by a sharded minimal perfect hash.

The lines' 128-bit hashes are counted in Spark. The distinct lines that recur at all are dealt to shards by their hash; each
shard's task builds a minimal perfect hash and compact arrays behind it: a fingerprint, which tells a line of the index from
any other, the count of documents, and the document that keeps the line. Documents then probe the arrays, and the counts
there decide: no line is joined. A line of one document alone can't be dropped, so it needs no place in the index.

An index of up to ``PASS_BYTES`` goes to all documents at once. For a larger one each shard's arrays are a file in the shared folder, and
the lines' hashes go to the shards: a task has the hashes of its shards in order, opens one shard's arrays after the other, and
writes which lines go (row and line numbers). A line that fills a third of all documents is one key of its shard's arrays, and
its hashes are dealt over ``SALTS`` tasks, each of which opens the arrays for itself.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clash, fresh, held, let_go, need, new_path, utf8, written

#: Code points that a line's key has at least, and documents that hold it at least.
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys in a shard, about.
SHARD_KEYS = 50_000
#: Bytes of arrays that go to every worker at once; those of a larger index stay in the shared folder. Tasks that a shard's lines are dealt over.
PASS_BYTES, SALTS = 24 << 20, 32
BLANK = b" \t\n\x0b\x0c\r"
GAMMA, LEVELS = 1.5, 48


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _long(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "replace")) >= chars)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the hash for each level (SplitMix64's finaliser)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: level by level, keys that are alone in their place of a bit array settle there; the others go on."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = np.unpackbits(bits, count=int(self.starts[-1])) if len(bits) else np.zeros(0, np.uint8)
        self.flat = flat
        self.rank = np.cumsum(flat, dtype=np.int64) - flat

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash | None:
        """None if two keys are equal."""
        sizes, levels, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(8, int(len(left) * GAMMA))
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(at, minlength=size)
            levels.append((counts == 1).astype(np.uint8))
            sizes.append(size)
            left = left[counts[at] != 1]
        if len(left):
            return None
        return PerfectHash(np.array(sizes, np.int64), np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, from 0; -1 where no level has a place, so that it is no key. Other strangers get any key's place."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (_mixed(keys[rest], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            there = self.flat[at] == 1
            out[rest[there]] = self.rank[at[there]]
            rest = rest[~there]
        return out


def _mixed_halves(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of both halves of hashes; another seed parts what one seed maps to the same bits."""
    return h1.view(np.uint64) ^ _mixed(h2.view(np.uint64), seed)


def _long_lines(text: bytes | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Number and 128-bit hash of the key of each line that is long enough."""
    import xxhash

    if text and len(text) >= min_chars:
        for j, line in enumerate(text.split(b"\n")):
            if len(line) >= min_chars and _long(x := key_of(line), min_chars):
                yield j, xxhash.xxh3_128_digest(x)


def line_counts(docs: DataFrame, key: str, text: str, min_chars: int, least: int) -> DataFrame:
    """h1, h2 (halves of the key's hash), n (documents, that is rows, ``least`` at least), keeper (the largest ``key``; null if all are null)."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keeper", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                found, rows = [], []
                for k, value in enumerate(utf8(batch.column(1))):
                    own = {h for _, h in _long_lines(value, min_chars)}
                    found += own
                    rows += [k] * len(own)
                if found:
                    h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["h1", "h2", "keeper"])

    return docs.select(key, text).mapInArrow(run, schema).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= least)


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard: shard, n, seed, sizes and bits of the perfect hash, and the arrays fingerprints, counts, keepers, has_keeper (binary)."""
    schema = "shard int, n int, seed int, sizes binary, bits binary, fingerprints binary, counts binary, keepers binary, has_keeper binary"

    def build(pdf):
        import pandas as pd

        h1, h2 = (pdf[c].to_numpy(np.int64) for c in ("h1", "h2"))
        seed, h = 0, None
        while h is None:
            keys = _mixed_halves(h1, h2, seed)
            h, seed = PerfectHash.build(keys), seed + 1
        at = h.index(keys)
        n = len(pdf)
        prints, counts, keepers, has = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.uint8)
        prints[at] = h2
        counts[at] = np.minimum(pdf["n"].to_numpy(np.int64), 2**31 - 1)
        known = pdf["known"].to_numpy(bool)
        has[at] = known
        keepers[at] = np.where(known, pdf["keep"].to_numpy(np.int64), 0)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [n], "seed": [seed - 1], "sizes": [h.sizes.tobytes()], "bits": [h.bits.tobytes()], "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()], "keepers": [keepers.tobytes()], "has_keeper": [has.tobytes()]})

    dealt = lines.select("h1", "h2", "n", F.coalesce(F.col("keeper").cast("bigint"), F.lit(0)).alias("keep"), F.col("keeper").isNotNull().alias("known"), F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(build, schema)


class Index:
    """The arrays of some shards, as a worker holds them."""

    def __init__(self, rows: list, shards: int, min_docs: int):
        self.shards, self.min_docs = shards, min_docs
        self.by = {}
        for r in rows:
            get = lambda c, t, r=r: np.frombuffer(bytes(r[c]), t)
            self.by[r["shard"]] = (r["seed"], PerfectHash(get("sizes", np.int64), get("bits", np.uint8)), get("fingerprints", np.int64), get("counts", np.int32), get("keepers", np.int64), get("has_keeper", np.uint8))

    def drops(self, h: np.ndarray, keys: list) -> np.ndarray:
        """Of each hash (n x 2) of a line of the document ``keys``: whether the line goes. Its fingerprint must be in the index,
        the count there large enough, and its keeper another document."""
        out = np.zeros(len(h), bool)
        shard = h[:, 0] % np.int64(self.shards)
        for s in np.unique(shard):
            if (own := self.by.get(int(s))) is None:
                continue
            seed, perfect, prints, counts, keepers, has = own
            at = np.flatnonzero(shard == s)
            k = perfect.index(_mixed_halves(h[at, 0].copy(), h[at, 1].copy(), seed))
            good = (k >= 0) & (prints[np.maximum(k, 0)] == h[at, 1]) & (counts[np.maximum(k, 0)] >= self.min_docs)
            for p, i in zip(at[good].tolist(), k[good].tolist(), strict=True):
                out[p] = keys[p] != keepers[i] if has[i] else keys[p] is not None
        return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with ``text`` without the lines that recur, and n_lines (before), n_dropped, kept_sha256.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of ``min_chars`` code points or more
    in at least ``min_docs`` rows lose their lines everywhere but in rows with the largest ``key`` (an integer) that holds
    them. Hashes of 128 bits stand for keys: 64 pick shard and place, 64 are compared.
    Null or empty text: one empty line, and the text stays as it is. A row all of whose lines go gets an empty text.
    A null ``key`` is less than any other; if all holders of a line have one, all keep it. Repeated rows count each, and
    those with the largest key all keep the line. No documents give no rows. No columns n_lines, n_dropped, kept_sha256 may be
    there before.
    """
    need(docs, key, text)
    clash(docs, "n_lines", "n_dropped", "kept_sha256")
    if not isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{key} must hold whole numbers, not {docs.schema[key].dataType.simpleString()}")
    spark = docs.sparkSession
    # without the lines of one document: they never go, unless one document is enough
    lines = written(line_counts(docs, key, text, min_chars, min(2, min_docs)), "lines")
    n = lines.count()
    shards = max(1, -(-n // shard_keys))
    index = written(build_index(lines, shards), "line-index")
    if shards * shard_keys * 28 <= max(pass_bytes, shard_keys * 28):
        # at most pass_bytes
        shipped, name = spark.sparkContext.broadcast([r.asDict() for r in index.collect()]), uuid.uuid4().hex

        def probe(batch: pa.RecordBatch) -> list:
            found = [list(_long_lines(t, min_chars)) for t in utf8(batch.column(text))]
            flat = b"".join([h for own in found for _, h in own])
            if not flat:
                return [()] * len(found)
            keys = [k for k, own in zip(batch.column(key).to_pylist(), found, strict=True) for _ in own]
            goes = iter(held(name, lambda: Index(shipped.value, shards, min_docs)).drops(np.frombuffer(flat, "<i8").reshape(-1, 2), keys).tolist())
            return [[j for j, _ in own if next(goes)] for own in found]

        return _kept(docs, text, probe, docs.columns)
    row, drop = fresh(docs, "sg_row", "sg_drop")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")
    folder = new_path(spark, "line-arrays")
    _store(index, folder)
    hashes = _hashes(numbered.select(F.col(row).alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")), min_chars).withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    dealt = hashes.repartition("shard", F.pmod(F.xxhash64("row", "line"), F.lit(SALTS))).sortWithinPartitions("shard")
    drops = written(_dropped(dealt, folder, shards, min_docs), "line-drops")
    by_row = drops.groupBy(F.col("row").alias(row)).agg(F.collect_list("line").alias(drop))
    return _kept(numbered.join(by_row, row, "left"), text, lambda batch: [x or () for x in batch.column(drop).to_pylist()], docs.columns)


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """row, key, line number and hash (h1, h2) of each long line of ``docs`` (row, key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                found = [list(_long_lines(t, min_chars)) for t in utf8(batch.column("text"))]
                at = pa.array([k for k, own in enumerate(found) for _ in own], pa.int64())
                h = np.frombuffer(b"".join([x for own in found for _, x in own]), "<i8").reshape(-1, 2) if len(at) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("key").take(at), pa.array([j for own in found for j, _ in own], pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["row", "key", "line", "h1", "h2"])

    return docs.mapInArrow(run, "row long, key long, line int, h1 long, h2 long")


def _store(index: DataFrame, folder: str) -> None:
    """Each row of ``index`` as a file of its own, named by its shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                name = f"{path}/{one.column('shard')[0].as_py()}"
                # whole when it has its name, whichever of several attempts gives it
                made = f"{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(made, compression=None) as out, pa.ipc.new_stream(out, one.schema) as writer:
                    writer.write_batch(one)
                files.move(made, name)
            yield pa.RecordBatch.from_arrays([batch.column("shard")], names=["shard"])

    index.mapInArrow(run, "shard int").write.format("noop").mode("overwrite").save()


def _dropped(dealt: DataFrame, folder: str, shards: int, min_docs: int) -> DataFrame:
    """row and number of the lines that go, of lines that come shard by shard. A shard that no line recurs in has no file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        let_go()
        files, path = fs.FileSystem.from_uri(folder)
        now, own = -1, Index([], shards, min_docs)

        def opened(shard: int) -> Index:
            name = f"{path}/{shard}"
            if files.get_file_info(name).type != fs.FileType.File:
                return Index([], shards, min_docs)
            with files.open_input_stream(name, compression=None) as f, pa.ipc.open_stream(f) as reader:
                return Index(reader.read_all().to_pylist(), shards, min_docs)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shard[a] != now:
                    now, own = int(shard[a]), opened(int(shard[a]))
                some = batch.slice(a, b - a)
                h = np.column_stack([some.column(c).to_numpy() for c in ("h1", "h2")])
                goes = pa.array(own.drops(h, some.column("key").to_pylist()))
                yield pa.RecordBatch.from_arrays([some.column(c).filter(goes) for c in ("row", "line")], names=["row", "line"])

    return dealt.mapInArrow(run, "row long, line int")


def _kept(docs: DataFrame, text: str, probe: Callable[[pa.RecordBatch], list], columns: list[str]) -> DataFrame:
    """The columns ``columns``, with ``text`` without the lines whose numbers ``probe`` gives for each row of a batch, and the result's own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    none = F.lit(None)
    schema = docs.select(*columns).withColumns({"n_lines": none.cast("bigint"), "n_dropped": none.cast("bigint"), "kept_sha256": none.cast("string")}).schema
    own = list(to_arrow_schema(schema))[-3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                kept, lines, dropped = [], [], []
                for value, go in zip(utf8(batch.column(text)), probe(batch), strict=True):
                    lines.append(value.count(b"\n") + 1 if value else 1)
                    dropped.append(len(go))
                    out = set(go)
                    kept.append(b"\n".join([x for j, x in enumerate(value.split(b"\n")) if j not in out]) if out else value)
                made = {c: batch.column(c) for c in columns}
                made[text] = pa.array(kept, pa.binary()).cast(batch.column(text).type)
                new = [lines, dropped, [hashlib.sha256(k or b"").hexdigest() for k in kept]]
                yield pa.RecordBatch.from_arrays([*made.values(), *(pa.array(x, f.type) for x, f in zip(new, own, strict=True))], names=[*made, *(f.name for f in own)])

    return docs.mapInArrow(run, schema)
