"""Operator 13: the trie of the turns that conversations begin with, by a merge of sorted runs that know their common prefixes.

A turn is told by the 128-bit digest of its role and text, a conversation by the digests of its turns in a row: 16 bytes a turn
travel, no text. Equal conversations are brought together first, in blocks of ids, so that a conversation that most others repeat
is one row before anything is sorted.

Then the external mergesort, over the cluster. Tasks emit sorted runs, in which each conversation carries the number of turns that
it shares with the one before (LCP). The runs are cut at splitters into ranges of bounded size, and one task merges what all
runs have of a range with a loser tree: the carried LCPs decide most matches, and turns that two heads are known to share are
never compared again. The merged stream opens and closes nodes on a stack, the open path; a node that closes is finished, and
is emitted when its parent closes, which knows its own smallest member then.

A node whose subtree reaches over a splitter is open at the end of one range, or was open before its beginning. Which these are
tells the splitter alone: a prefix of some conversation, just long enough to differ from the one before. Such nodes come out
of several ranges in parts, all of whose figures are sums or extremes; there are about as many as splitters have turns. A
closed node counts as a child, and as a leaf, in the one range where it closes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_go, need, written
from .graph import dealt_join

#: Bytes of a turn's digest.
TURN = 16
#: Ids of one value range whose equal conversations are brought together in one group.
BLOCK_IDS = 4_096
#: Bytes of sequences that a run, and about as many that a merged range, has; rows of a range, if there are fewer ranges than partitions.
RUN_BYTES, RANGE_BYTES, RANGE_ROWS = 16 << 20, 32 << 20, 2_000
#: Sampled conversations for each splitter.
OVERSAMPLE = 16
NOTHING = hashlib.sha256(b"").hexdigest()

_RUN = "run long, number long, lcp int, seq binary, sizes array<long>, n long, least long, ends string"
_NODE = "node string, parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def collect_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and ``turns`` of each conversation: an array of digest (hex) and bytes (of the text, in UTF-8), ordered by ``turn``.

    A null turn comes first; equal turns are ordered by role, then by digest, and all stay. A null role or text is empty. Rows with a
    null ``conv`` are left out; ``conv`` must hold whole numbers. A conversation is one row: about 50 bytes a turn, in one task.
    """
    need(conversations, conv, turn, role, text)
    if not isinstance(conversations.schema[conv].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{conv} must hold whole numbers, not {conversations.schema[conv].dataType.simpleString()}")
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    one = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("bytes"))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv_id"), one.alias("one"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return ordered.select("conv_id", F.transform("all", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns at the beginning of both, of which ``known`` are known to be equal."""
    at, end = known * TURN, min(len(a), len(b))
    while at < end and a[at:at + TURN] == b[at:at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(rows: list[tuple]) -> Iterator[tuple[int, tuple]]:
    """The rows in the order of their sequences, which come first, each with its LCP."""
    before = b""
    for row in sorted(rows, key=lambda r: r[0]):
        yield common_turns(before, row[0]), row
        before = row[0]


def merged(runs: list[list[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """The rows of all sorted runs in order, each with its LCP with the row that came before; the first LCP of a run does not matter.

    The head of a run has the LCP with the last winner that it met. Of two heads that met the same winner, that with the
    larger LCP is less, and the other's LCP stays as it is; only heads with equal LCPs are compared, from there on.
    """
    k = len(runs)
    at, shared = [0] * k, [0] * k
    heads: list[bytes | None] = [run[0][1][0] if run else None for run in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        c = common_turns(heads[a], heads[b], shared[a])
        if heads[a][c * TURN:(c + 1) * TURN] > heads[b][c * TURN:(c + 1) * TURN]:
            a, b = b, a
        shared[b] = c
        return a, b

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not None:
        yield shared[best], runs[best][at[best]][1]
        at[best] += 1
        if at[best] < len(runs[best]):
            shared[best], heads[best] = runs[best][at[best]][0], runs[best][at[best]][1][0]
        else:
            heads[best] = None
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


class Node:
    """A node of the open path. ``begun``: it may be open in an earlier range, too."""

    __slots__ = ("begun", "bytes", "children", "ends", "leaves", "least", "n", "ready", "saved")

    def __init__(self, begun: bool, size: int):
        self.begun, self.bytes, self.ends = begun, size, None
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ready: list[tuple] = []


def nodes_of(stream: Iterable[tuple[int, tuple]], first: bytes | None, following: bytes | None) -> Iterator[tuple]:
    """The nodes (_NODE) of a merged range of rows (seq, sizes, n, least, ends). ``first``: the splitter at which the range begins;
    ``following``: that at which the next one begins. Nodes that may have parts in other ranges have their prefix's digest as ``node``."""
    path, seq = [Node(first is not None, 0)], b""
    digest = lambda depth: hashlib.md5(seq[:depth * TURN]).hexdigest()

    def close(depth: int, whole: bool) -> Iterator[tuple]:
        """Takes nodes deeper than ``depth`` from the path; ``whole``: no later range has them."""
        while len(path) - 1 > depth:
            d, node = len(path) - 1, path.pop()
            part = node.begun or not whole
            node.saved += node.n * node.bytes - (node.bytes if whole else 0)
            node.leaves += whole and node.children == 0
            own = digest(d) if part else None
            for child in node.ready:
                yield (None, own, *child[:2], None if part else node.least, *child[2:])
            row = (node.least, d, node.n, node.children, node.leaves, node.saved, node.ends)
            if path:
                up = path[-1]
                up.n, up.leaves, up.saved, up.children = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved, up.children + whole
                up.least = node.least if up.least is None else min(up.least, node.least)
                if part:  # its parent is such a node as well
                    yield (own, digest(d - 1), *row[:2], None, *row[2:])
                else:
                    up.ready.append(row)
                    if (up.begun or len(path) - 1 <= open_after) and len(up.ready) >= 4_096:
                        for child in up.ready:
                            yield (None, digest(d - 1), *child[:2], None, *child[2:])
                        up.ready.clear()
            else:
                yield (own, None, *row[:2], None, *row[2:])

    open_after = -1  # nodes up to this depth are sure to be parts, whatever follows
    for lcp, (new, sizes, n, least, ends) in stream:
        yield from close(lcp, True)
        seq = new
        open_after = common_turns(seq, following) if following is not None else -1
        for d in range(lcp + 1, len(seq) // TURN + 1):
            begun = path[-1].begun and d * TURN < len(first) and seq[(d - 1) * TURN:d * TURN] == first[(d - 1) * TURN:d * TURN]
            path.append(Node(begun, sizes[d - 1]))
        top = path[-1]
        top.n, top.ends = top.n + n, ends
        top.least = least if top.least is None else min(top.least, least)
    yield from close(open_after, True)
    yield from close(-1, following is None)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    size = 0
    for row in rows:
        some.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, list)))
        if len(some) >= 4_096 or size >= 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1_024):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, 1_024).columns), strict=True)


def _distinct(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (seq, sizes, n, least, ends) from blocks of ids (key, block, seq, sizes, n, least, ids) that come in order."""
    held = None
    for key, _, seq, sizes, n, least, ids in blocks:
        if held and held[0] == key:
            held[3] += n
            held[5].update(b"," + ids.encode())
        else:
            if held:
                yield (*held[1:5], held[5].hexdigest())
            held = [key, seq, sizes, n, least, hashlib.sha256(ids.encode())]
    if held:
        yield (*held[1:5], held[5].hexdigest())


def sorted_runs(sequences: DataFrame, run_bytes: int) -> DataFrame:
    """Sorted runs (_RUN) of the distinct sequences of ``sequences`` (conv_id, turns)."""
    packed = sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("seq"), F.transform("turns", lambda x: x["bytes"]).alias("sizes"))
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = packed.groupBy(F.md5("seq").alias("key"), F.floor(F.col("conv_id") / BLOCK_IDS).alias("block")).agg(
        F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(ids.cast("array<string>"), ",").alias("ids"),
    )
    schema = _arrow(_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        task, count = TaskContext.get().partitionId() << 32, 0

        def rows() -> Iterator[tuple]:
            nonlocal count
            some, size = [], 0
            for row in _distinct(_rows(batches)):
                some.append(row)
                size += len(row[0]) + 8 * len(row[1]) + 200
                if size >= run_bytes:
                    yield from emitted(some)
                    some, size = [], 0
            yield from emitted(some)

        def emitted(some: list[tuple]) -> Iterator[tuple]:
            nonlocal count
            for number, (lcp, row) in enumerate(sorted_run(some)):
                yield (task + count, number, lcp, *row)
            count += 1

        yield from _batches(rows(), schema)

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, _RUN)


def splitters(runs: DataFrame, range_bytes: int, range_rows: int) -> list[bytes]:
    """Where ranges of about equal bytes begin, but for the first: each is the beginning of some sequence, no longer than it takes to
    come after the sampled one before. The sample, ``OVERSAMPLE`` sequences for a range, goes through the driver."""
    rows, size = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("seq") + 8 * F.size("sizes") + 200), F.lit(0))).first()
    ranges = max(-(-size // range_bytes), min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // range_rows))
    if ranges < 2:
        return []
    share = min(1.0, OVERSAMPLE * ranges / rows)
    some = runs.where(F.pmod(F.xxhash64("seq"), F.lit(1 << 30)) < int(share * (1 << 30))).select("seq")
    sample = sorted(bytes(r[0]) for r in some.toLocalIterator())
    total, weight, out = sum(len(x) + 200 for x in sample), 0, []
    for before, x in zip([b""] + sample, sample):
        # the first sequence of all may be empty, and needs no splitter
        if weight >= total * (len(out) + 1) / ranges and x > before:
            out.append(x[:(common_turns(before, x) + 1) * TURN])
        weight += len(x) + 200
    return out


def trie(sequences: DataFrame, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row for each node of the trie of ``sequences`` (conv_id, turns: as ``collect_turns`` has them; one row for each conv_id).

    conv_id: the smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members, the sequences that
    begin with the node's; n_children; n_leaves: nodes without children in its subtree, which includes it; saved_tokens: over its
    subtree, (n_convs - 1) times the bytes of a node's last text; ends_sha256: of the ids of members that end here, in ascending
    order, joined by commas. Turns are told apart by 128 bits. A sequence without turns is a member of the root; no sequences
    have no nodes. A null ``turns`` counts as no turns.
    """
    need(sequences, "conv_id", "turns")
    turns = F.coalesce(F.col("turns"), F.array().cast(sequences.schema["turns"].dataType))
    runs = written(sorted_runs(sequences.select("conv_id", turns.alias("turns")), run_bytes), "trie-runs")
    cuts = splitters(runs, range_bytes, range_rows)
    told = runs.sparkSession.sparkContext.broadcast(cuts)
    schema, fields = _arrow(_NODE), [f.name for f in T._parse_datatype_string(_RUN).fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(told.value, x) for x in batch.column("seq").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()

        def rows() -> Iterator[tuple]:
            part, runs = -1, {}
            for at, run, _, lcp, *row in _rows(batches):
                if at != part:
                    yield from finished(part, runs)
                    part, runs = at, {}
                runs.setdefault(run, []).append((lcp, tuple(row)))
            yield from finished(part, runs)

        def finished(part: int, runs: dict) -> Iterator[tuple]:
            if runs:
                cuts = told.value
                yield from nodes_of(merged(list(runs.values())), cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None)

        yield from _batches(rows(), schema)

    placed = runs.select(*fields).mapInArrow(place, f"part int, {_RUN}")
    dealt = placed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "run", "number")
    nodes = written(dealt.mapInArrow(merge, _NODE), "trie-nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if cuts:
        parts = written(nodes.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
            *(F.sum(c).alias(c) for c in columns[3:7]), F.max("ends_sha256").alias("ends_sha256"),
        ), "trie-parts")
        apart = nodes.where(F.col("node").isNull()).unionByName(parts)
        names = parts.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
        below = dealt_join(apart.where(F.col("parent").isNotNull()), names, "parent", "conv_id").withColumn("parent_conv_id", F.col("up"))
        nodes = apart.where(F.col("parent").isNull()).select(*columns).unionByName(below.select(*columns))
    return nodes.select(*columns).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes (see ``trie``) of the turns of ``conversations`` (see ``collect_turns``); other columns do not matter."""
    return trie(collect_turns(conversations, conv, turn, role, text))
