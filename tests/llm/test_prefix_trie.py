"""Operator 13 against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from stratagrid.llm import prefix_trie, queries  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, node string, N double"


def table(seed=1, ids=60):
    rng = random.Random(seed)
    out = []
    for c in [k for k in range(ids) if rng.random() < 0.9]:
        said = [(k, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 20])) for k in range(rng.choice([1, 2, 3, 9, 14]))]
        if rng.random() < 0.3:
            said[0] = (None, "system", "be good")
        if c % 7 == 0:  # copies
            said = [(k, "user", "copy") for k in range(3)]
        out += [(c, *x, "n", 0.5) for x in said]
    return [*out, (None, 1, "user", "no id", "n", 0.5), (3_000_000, 0, "user", "a", "n", 0.5), (-7, 0, "user", "a", "n", 0.5)]


def sequences(rows, rebuild):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(said)] for c, said in by.items()}
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + own[c][h[c]:] for c in own}


def plain(rows, rebuild=False):
    seqs = sequences(rows, rebuild)
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = set()
    for node, who in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[:-1] == x for y in below if y) for x in below)
        ends = ",".join(map(str, sorted(c for c in who if len(seqs[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below)
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie(spark, tmp_path, rebuild):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if rebuild:
        df.write.parquet(f"{tmp_path}/conversations.parquet")
        got = queries.op13_prefix_trie(spark, str(tmp_path))
    else:
        got = prefix_trie.prefix_trie(df)
    assert nodes(got) == plain(rows, rebuild)


@pytest.mark.parametrize("seed", [2, 3])
@pytest.mark.parametrize("most", [1, 900])
def test_trie_of_many_runs_and_ranges(spark, monkeypatch, seed, most):
    """Runs of one row, ranges of a few rows, blocks of few ids: nodes that reach over splitters come out whole."""
    rows = table(seed, 90)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 10)
    seqs = prefix_trie.collect_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert nodes(prefix_trie.trie(seqs, run_bytes=most, range_bytes=700, range_rows=5)) == plain(rows)
    # few keys are broadcast; the same with salts
    monkeypatch.setattr("stratagrid.llm.graph.MOST_SENT", 0)
    assert nodes(prefix_trie.trie(seqs, run_bytes=most, range_bytes=3_000, range_rows=5)) == plain(rows)


def test_ends_in_blocks_and_hot_conversation(spark):
    seqs = prefix_trie.collect_turns(spark.range(9_000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text")))
    got = {r["depth"]: r for r in prefix_trie.trie(seqs).collect()}
    assert sorted(got) == [0, 1] and got[1]["n_convs"] == 9_000 and got[1]["saved_tokens"] == got[0]["saved_tokens"] == 8_999 * 5
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(9_000))).encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0
    kind = "conv_id long, turns array<struct<digest:string,bytes:bigint>>"
    got = prefix_trie.trie(spark.createDataFrame([(4, None), (5, [])], kind)).collect()
    assert [tuple(r) for r in got] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,5").hexdigest())]
    with pytest.raises(ValueError, match="whole numbers"):
        prefix_trie.prefix_trie(df.withColumn("conv_id", F.lit("a")))


def test_loser_tree_orders_and_knows_prefixes():
    rng = random.Random(0)
    for k in (1, 2, 3, 5, 8, 13):
        rows = {b"".join(bytes([rng.randint(0, 2)]) * prefix_trie.TURN for _ in range(rng.randint(0, 9))) for _ in range(200)}
        runs = [[] for _ in range(k)]
        for row in rows:
            runs[rng.randrange(k)].append((row,))
        got = list(prefix_trie.merged([list(prefix_trie.sorted_run(r)) for r in runs]))
        assert [x[0] for _, x in got] == sorted(rows)
        assert [c for c, _ in got][1:] == [prefix_trie.common_turns(a[0], b[0]) for (_, a), (_, b) in zip(got, got[1:])]
    assert list(prefix_trie.merged([])) == []


def test_merge_does_not_compare_shared_turns_again(monkeypatch):
    """Of runs that all share their first hundred turns, these are compared a few times per run, not per row."""
    compared = []
    real = prefix_trie.common_turns
    monkeypatch.setattr(prefix_trie, "common_turns", lambda a, b, known=0: compared.append(real(a, b, known) - known + 1) or real(a, b, known))
    runs = [[(100 if k else 0, (b"p" * 1600 + (k * 4 + r).to_bytes(16),)) for k in range(500)] for r in range(4)]
    assert len(list(prefix_trie.merged(runs))) == 2_000
    assert sum(compared) < 4 * 101 + 3 * 2_000
