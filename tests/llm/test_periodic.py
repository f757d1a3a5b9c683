"""Operator 11 against a plain search for runs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from stratagrid.llm import periodic, queries  # noqa: E402


def plain(words, least=12):
    """All runs, by comparing each word with the one a period before it."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x < n - q:
            if words[x] != words[x + q]:
                x += 1
                continue
            start = x
            while x < n - q and words[x] == words[x + q]:
                x += 1
            length = x - start + q
            if length >= max(least, 2 * q) and (start, length) not in found:
                found[start, length] = q
    return sorted((s, q, length) for (s, length), q in found.items())


def as_plain(found):
    return [(s, q, length) for s, length, q in found.tolist()]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(400):
        n, kinds = rng.randint(0, 120), rng.choice([1, 2, 3, 20])
        words = [rng.randint(0, kinds) for _ in range(n)]
        if rng.random() < 0.5 and n > 20:
            a, p = rng.randint(0, n // 2), rng.randint(1, n // 4)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        assert as_plain(periodic.runs_of(np.array(words, np.int32), least)) == plain(words, least)


def test_runs_of_structured_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    thue = [bin(k).count("1") % 2 for k in range(512)]
    for words in (b, thue, [0] * 500, [0, 1] * 300, list(range(300)) * 2, list(range(100)) + list(range(99)) + [7] * 30):
        assert as_plain(periodic.runs_of(np.array(words, np.int32))) == plain(words)


def test_pairs_of_long_texts_in_blocks(monkeypatch):
    """Beyond the table, and over several blocks, pairs and runs are the same."""
    monkeypatch.setattr(periodic, "BLOCK", 97)
    rng = random.Random(5)
    words = [rng.randint(0, 3) for _ in range(700)]
    words[300:600] = [words[300 + (k % 40)] for k in range(300)]
    want = as_plain(periodic.runs_of(np.array(words, np.int32)))
    inside = sorted((int(q), int(j)) for qs, js in periodic.pairs(700) for q, j in zip(qs, js, strict=True) if q <= 350)
    monkeypatch.setattr(periodic, "TABLE", 0)
    assert sorted((int(q), int(j)) for qs, js in periodic.pairs(700) for q, j in zip(qs, js, strict=True)) == inside == sorted((q, j) for q in range(1, 351) for j in range(q, 700, q))
    assert as_plain(periodic.runs_of(np.array(words, np.int32))) == want == plain(words)


def test_equal_hashes_of_different_words(monkeypatch):
    """With a modulus so small that hashes often agree by chance, words decide."""
    monkeypatch.setattr(periodic, "PRIME", 8191)
    monkeypatch.setattr(periodic, "_tables", {k: v for k, v in periodic._tables.items() if k == "grid"})
    rng = random.Random(9)
    for _ in range(60):
        words = [rng.randint(0, 1) for _ in range(300)]
        assert as_plain(periodic.runs_of(np.array(words, np.int32))) == plain(words)


def table():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "go " * 11, "go " * 12, "a b c " * 4 + "a b", "x\x1cy x\x1cy " * 9, "É é É é " * 8]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += ["\n".join(["the same line of seven words here", "end"] * 6), "w" * 100_000, " ".join(f"w{k % 5000}" for k in range(20_000))]
    return [(k, t) for k, t in enumerate(texts)] + [(12, texts[12]), (12, texts[12]), (None, "go " * 30), (None, None)]


def expected(key, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    runs = plain(words) if n < 6000 else [(0, 5000, 20_000)]
    gone = {k for s, q, length in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    return (
        key, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, q, length in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest(),
    )


def test_query_against_a_plain_one(spark, tmp_path):
    made = table()
    big = next(k for k, (_, t) in enumerate(made) if t and t.startswith("w0 w1"))
    made[big] = (next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 10), made[big][1])
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, t in made if k is not None and t)
    spark.createDataFrame(made, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*r) for r in made), key=str)


def test_operator_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 10, 0.5), (1, "a b " * 10, 0.5), (None, None, None)], "H long, text string, start double")
    found = periodic.periodic_runs(docs)
    assert found.columns == ["H", "text", "start", "n_words", "runs", "collapsed"]
    rows = sorted(found.collect(), key=str)
    assert [r["collapsed"] for r in rows if r["H"]] == ["a b", "a b"] and [tuple(x) for x in rows[0]["runs"]] == [(0, 20, 2)]
    assert [(r["n_words"], r["runs"], r["collapsed"]) for r in rows if not r["H"]] == [(0, [], "")]
    assert periodic.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="already"):
        periodic.periodic_runs(docs.withColumnRenamed("H", "RUNS"))
