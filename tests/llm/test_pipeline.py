"""The pipeline's stages against plain versions, each on its own input, and all in turn."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_operators import ASCII, LINE, PASSAGE, RANKS, brute_contamination, brute_lines, brute_similar  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCHMARK = [(1, PASSAGE), (2, None), (3, "")]


def documents():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    texts = [None, "", " \n ", "one word", "One  word", PASSAGE, f"so says {PASSAGE.title()} indeed", "vileword " + word(), f"{word()} VILEWORD"]
    texts += [" ".join(word() for _ in range(30)) for _ in range(20)]
    texts += [f"{word()} {word()}\n{LINE}\n{word()}" for _ in range(6)] + [f"{LINE}\n  {LINE.upper()} "]
    near = [word() for _ in range(100)]
    texts += [" ".join(near), " ".join([*near[:40], "other", *near[41:]]), " ".join([*near[:80], *(word() for _ in range(20))])]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[10], rows[10], (None, texts[11], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng, rows = random.Random(4), []
    for k in range(300):
        rows.append((1000 + k, " ".join([*("".join(rng.choice("nopqrstuv") for _ in range(6)) for _ in range(20)), *["vileword"] * (k % 3 == 0)])))
    # the labelled documents are among the others
    spark.createDataFrame([(k, t, "en", "l", len(t)) for k, t in rows] + documents(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + k, k % 2, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def counted(df):
    return Counter(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()))


def plain_lines(rows):
    """The rows after line dedup: the lines that brute force keeps, told by its digests, in the order of the rows."""
    out = []
    for row, (_, _, dropped, digest) in zip(rows, brute_lines(rows), strict=True):
        text = row[1]
        if dropped:
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
            text = "\n".join(x for x in text.split("\n") if key(x) != key(LINE))
        assert hashlib.sha256((text or "").encode()).hexdigest() == digest
        out.append((*row[:1], text, *row[2:4], len(text) if dropped else row[4]))
    return out


def plain_near(rows):
    part, best = brute_similar([r[1] for r in rows]), {}
    for p, r in zip(part, rows, strict=True):
        order = (r[0] is None, r[0] or 0)
        if p not in best or order < best[p][0]:
            best[p] = (order, r)
    return [r for _, r in best.values()]


def plain_clean(rows):
    return [r for r in rows if not brute_contamination(r[1], BENCHMARK)[-1]]


def plain_tokens(rows):
    import public_tokenizers
    import tiktoken

    from stratagrid.llm import bpe

    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    ids = [(r[0], peer.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    return Counter((k, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for k, x, t in ids)


def test_stages(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", row int").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert counted(stages["line_dedup"](spark, docs, "")) == Counter(plain_lines(rows))
    got, want = counted(stages["near_dedup"](spark, docs, "")), plain_near(rows)
    # of equal rows of one key any may stay
    assert Counter((r[0], r[1]) for r in got.elements()) == Counter((r[0], r[1]) for r in want)
    empty = docs.limit(0)
    assert all(stages[s](spark, empty, "").count() == 0 for s in ("line_dedup", "near_dedup", "bpe"))
    tokens = stages["bpe"](spark, docs, "").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, tokens.collect())) == plain_tokens(rows)


def test_stages_with_tables(spark, sf_dir):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert counted(stages["decontamination"](spark, docs, sf_dir)) == Counter(plain_clean(rows))
    # the labels are of other documents, so nothing is known here and all stay
    assert counted(stages["toxicity"](spark, docs, sf_dir)) == Counter(rows)
    assert stages["toxicity"](spark, docs.limit(0), sf_dir).count() == 0 and stages["decontamination"](spark, docs.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    toxic = lambda t: "vileword" in (t or "").lower().split()
    kept = [r for r in rows if not toxic(r[1])]
    scored = dict(corpus_pipeline.STAGES)["toxicity"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert counted(scored) == Counter(kept)
    want = plain_tokens(plain_clean(plain_near(plain_lines(kept))))
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
