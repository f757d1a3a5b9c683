"""Operator 10: URL filters by a blocked Bloom filter and an exact join.

The listed host and path prefixes are put into a Bloom filter whose keys each touch one block of 512 bits. Every URL's
candidates, its host's suffixes joined with its path's prefixes of the listed lengths, are looked up there; the few that
may be listed go on to an exact join, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash, fresh, need, written

#: Bits for each listed key, and blocks of 512 bits at most: 32 MB go to each worker at most. Longer lists make more false
#: positives, which the join removes.
BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 19
LANES = 8
#: Listed keys up to which the exact join sends them to every task (some 10 MB); beyond that, tasks among which a popular key is dealt.
MOST_SENT, SALTS = 100_000, 64
ASCII_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(ASCII_UPPER), tail[:stop]


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of all rules that could fit: each suffix of the host at a dot, each prefix of the path of a listed length."""
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1:])
        at = host.find(".", at + 1)
    return [f"{s}\0{path[:n]}" for s in suffixes for n in lengths if n <= len(path)]


def bloom(keys: DataFrame, key: str) -> np.ndarray:
    """The filter of a column of strings: blocks x 8 lanes of 64 bits, built block by block in Spark."""
    n = keys.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // 512))))
    h = F.xxhash64(key)
    lanes = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))).alias(f"l{k}") for k in range(LANES)]
    out = np.zeros((blocks, LANES), np.int64)
    for r in keys.groupBy(F.pmod(F.xxhash64(key, F.lit(1).cast("bigint")), F.lit(blocks)).alias("b")).agg(*lanes).toLocalIterator():
        out[r["b"]] = r[1:]
    return out.view(np.uint64)


def _possible(bits: np.ndarray, keys: list[str]) -> np.ndarray:
    import xxhash

    one = (1).to_bytes(8, "little")
    h = np.fromiter((xxhash.xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64, len(keys))
    b = np.fromiter((xxhash.xxh64_intdigest(one, int(x)) for x in h), np.uint64, len(keys)).view(np.int64) % np.int64(len(bits))
    good = np.ones(len(keys), bool)
    for k in range(LANES):
        good &= (bits[b, k] >> ((h >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1) == 1
    return good


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule, or null) and verdict (the rule's, else ``default``).

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains, where the URL's path starts with the
    rule's; the longest wins, of equal ones that with the longer host. Of rules given twice ``block`` wins over ``allow``.
    Rules with nulls do not count. Null URLs have an empty host and path and, like all that no rule fits, get ``default``.
    Repeated rows each give a row; columns of ``pages`` stay, but those named like the new ones are an error.
    """
    need(pages, url)
    need(rules, "host", "path", "verdict")
    clash(pages, "host", "path", "rule", "verdict")
    spark = pages.sparkSession
    listed = rules.select("host", "path", "verdict").dropna().withColumn("key", F.concat("host", F.lit("\0"), "path"))
    listed = listed.groupBy("key").agg(F.max("verdict").alias("ruled"), F.first("host").alias("rule_host"), F.first("path").alias("rule_path"))
    listed = written(listed, "rules")
    lengths = sorted(r[0] for r in listed.select(F.char_length("rule_path")).distinct().collect())
    shipped = spark.sparkContext.broadcast(bloom(listed, "key"))
    row, hits = fresh(pages, "sg_row", "sg_hits")
    mine = F.lit(None)
    schema = pages.withColumns({"host": mine.cast("string"), "path": mine.cast("string"), hits: mine.cast("array<string>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            hosts, paths, keys, owner = [], [], [], []
            for k, u in enumerate(batch.column(url).to_pylist()):
                h, p = split_url(u)
                hosts.append(h)
                paths.append(p)
                own = candidates(h, p, lengths)
                keys += own
                owner += [k] * len(own)
            found: list[list[str]] = [[] for _ in hosts]
            if keys:
                for j in np.flatnonzero(_possible(bits, keys)):
                    found[owner[j]].append(keys[j])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "host", "path", hits])

    # only possible hits go on to the join; row numbers are fixed by writing them
    numbered = written(pages.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "urls")
    possible = F.size(hits) > 0
    open_ = numbered.where(possible).select(F.col(row).alias("row"), F.explode(hits).alias("key"))
    best = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("size"), F.char_length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), "ruled")
    found = _listed(open_, listed).groupBy("row").agg(F.max(best).alias("best")).select(F.col("row").alias(row), F.col("best.rule").alias("rule"), F.col("best.ruled").alias("ruled"))
    columns = [*pages.columns, "host", "path"]
    held = numbered.where(possible).drop(hits).join(found, row, "left")
    judged = held.select(*columns, "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
    return judged.unionByName(numbered.where(~possible).select(*columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def _listed(open_: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows (row, key) of ``open_`` whose key is listed, with the rule."""
    if listed.count() <= MOST_SENT:
        return open_.join(F.broadcast(listed), "key")
    # a popular key's rows are dealt over salts, and its rule is copied to those salts that have rows
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    return salted.join(salted.select("key", "salt").distinct().join(listed, "key"), ["key", "salt"])
