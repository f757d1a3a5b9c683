"""What the operators of this subpackage share: a folder that all machines see, written tables, and text in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One translation that lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(range(256)).lower()

#: The same, with every byte that ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` excludes turned into a blank,
#: so that ``bytes.split()`` yields the words. Bytes from 0x80 on belong to words.
ALNUM_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in ASCII_LOWER)

#: How the same words are split by Java's regular expressions, after lower-casing.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``, or the checkpoint folder that was set. Where neither is, a
    temporary one if driver and tasks are on one machine (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="stratagrid-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and is computed once, whatever executors are lost later."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_slot: list = [None, None]


def held(key: str, build: Callable[[], object]):
    """What ``build`` makes, made once for ``key`` in each worker. A worker holds one such thing: what another operator, or another
    run, has left there goes first."""
    if _slot[0] != key:
        _slot[:] = None, None
        _slot[:] = key, build()
    return _slot[1]


def let_go() -> None:
    """Frees what ``held`` holds in this worker, for operators that hold nothing themselves."""
    _slot[:] = None, None


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def clash(df: DataFrame, *columns: str) -> None:
    """New columns must not be there already, whatever the case of their letters."""
    new = {c.lower() for c in columns}
    if there := [c for c in df.columns if c.lower() in new]:
        raise ValueError(f"there are columns {there} already")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case of its letters."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        there.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of the shingles of a text's words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in order and in arrays of bounded size
    (big-endian). A text of fewer words is one shingle; one without words has none."""
    import xxhash

    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    for k in range(0, n, 65_536):
        yield np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k:k + 65_536], stops[k:k + 65_536])]), ">u8")
