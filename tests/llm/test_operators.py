"""Each operator against a plain version of its contract, over tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from stratagrid.plans.components import components  # noqa: E402
from stratagrid.llm import bpe, decontaminate, graph, licenses, line_dedup, sharding, simhash, topk, toxicity, url_filter, warc  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, H1 int, node string, grams double"
LINE = "This line of boilerplate is repeated in a good many of the documents here"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def table():
    rng = random.Random(7)
    words = ["sun", "moon", "Étoile", "river", "MIT License", "cc-by", "stone\x1c", "a", "日本語", "don't", "x  y", "\t", " ", "Apache license", "idiot"]
    texts = [None, "", " ", "\n", "\n\n", "one", "CC BY", "gnu general public license gnu General public License", PASSAGE, "x " + PASSAGE.upper() + "!", "mu alpha"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [f"{LINE}\nnumber {k}\n  {LINE.upper()}\t" for k in range(7)]
    texts += [("copy of " + PASSAGE + " ") * 30] * 4 + ["a" * 5000 + " " + "word " * 4000]
    near = [f"w{k}" for k in range(400)]
    for k in range(6):
        near[k * 7] = "changed"
        texts.append(" ".join(near))
    rows = [(k, t, "en", "s", len(t or ""), 1, "n", 0.5) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "one", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (90, f"{LINE}", "en", "s", 1, 1, "n", 0.5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return Counter(map(tuple, df.collect()))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def test_bpe(docs, empty):
    import tiktoken

    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = Counter()
    for r in table():
        ids = peer.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert rows(bpe.digests(docs, RANKS)) == want
    both = bpe.decode(bpe.encode(docs, RANKS), RANKS).select("text", "decoded").collect()
    assert all(bytes(r[1]).decode() == (r[0] or "") for r in both)
    assert bpe.digests(empty, RANKS).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("IDS", F.lit(1)), RANKS)


def test_bpe_random_texts():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec, peer = bpe.Codec(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabets = ["ab", "aeth nrs'\n", "".join(map(chr, range(32, 600))), "012 \t\n  x", "日本語é́ 🙂\x85\x1c\x1f\xa0"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 50)))
        ids = codec.encode(text)
        assert ids == peer.encode_ordinary(text) and codec.decode(ids).decode() == text


@pytest.fixture(scope="module")
def pages(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "<p>é</p>", "long " * 90_000, "tail", "\r\n\r\nWARC/1.1\r\n", None, "tail"]
    data = [(k, f"http://a/{k}\n", h, 1, 2) for k, h in enumerate(html)] + [(4, None, "<p>é</p>", 1, 2), (None, None, "tail", 1, 2), (None, "u", "alone", 1, 2), (None, "v", "alone", 1, 2)]
    return spark.createDataFrame(data, "page_id long, url string, html string, frame int, Offset int"), data


def test_warc(spark, pages):
    df, data = pages
    index = warc.write(df, warc.archive_folder(spark))
    got = warc.read(index)
    largest = defaultdict(lambda: -1)
    for r in data:
        largest[r[2] or ""] = max(largest[r[2] or ""], -1 if r[0] is None else r[0])
    want = Counter()
    for r in data:
        p, top = (r[2] or "").encode(), largest[r[2] or ""]
        first = (-1 if r[0] is None else r[0]) == top
        want[r[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top] += 1
    assert rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert all(payloads[k] == next(r[2] or "" for r in data if r[0] == k) for k in payloads)
    one = warc.read(index.where(F.col("record_id") == warc.URN + "5")).collect()
    assert len(one) == 1 and len(one[0]["payload"]) == 450_000
    assert warc.read(warc.write(df.limit(0), warc.archive_folder(spark))).count() == 0


def test_warc_seek_table(tmp_path):
    writer = warc.Writer(f"file://{tmp_path}", "x")
    records = [warc.record(k, "u", b"z" * (k * 9000), None, False) for k in range(60)]
    index = [y for k, r in enumerate(records) for y in writer.add(str(k), r)] + list(writer.close())
    reader = warc.Reader(index[0][1])
    assert len(reader.packed) > 10
    for ident, _, frame, offset, length in reversed(index):
        assert reader.frame(frame)[offset:offset + length] == records[int(ident)]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(index[0][1][7:], "rb"), read_across_frames=True).read()
    assert whole == b"".join(records)


BENCHMARK = [(1, PASSAGE), (2, "moon river"), (3, None), (4, "..."), (None, "one"), (10, "River Moon"), (10, "river moon"), (7, "kappa"), (8, PASSAGE + " nu")]


def brute_contamination(text, items, window=10):
    words, hit, found = alnum(text), set(), set()
    for item, t in items:
        w = alnum(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            for at in range(len(words) - m + 1):
                if words[at:at + m] == w[k:k + m]:
                    hit |= set(range(at, at + m))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_contamination(spark, docs, empty, block):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark, block_bytes=block, keep=block == 1)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(got.select(*names)) == Counter((r[0], *brute_contamination(r[1], BENCHMARK)) for r in table())
    assert got.columns[:-6] == (docs.columns if block == 1 else ["doc_id"])
    spans = {r["doc_id"]: [tuple(x) for x in r["hits"]] for r in got.where("n_hit > 0").collect()}
    assert all(sum(b - a for a, b in s) and all(x[1] < y[0] for x, y in zip(s, s[1:])) for s in spans.values())
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0), keep=True).where("contaminated").count() == 0


def test_wu_manber_random():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        m = rng.randint(1, 5)
        patterns = list({tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(m)) for _ in range(4)})
        want = {(k, j) for j, p in enumerate(patterns) for k in range(len(words) - m + 1) if tuple(words[k:k + m]) == p}
        flat = [w for p in patterns for w in p] * 2
        search = decontaminate.Search(flat, range(0, 2 * m * len(patterns), m), [*range(len(patterns))] * 2, m)
        assert {(k, j) for k, place in search.occurrences(words) for j in search.owners(place)} == want


def test_benchmark_of_one_phrase_over_and_over():
    bench = decontaminate.Benchmark([(k, b"same words " * 400) for k in range(5)] + [(9, b"w" + b" same" * 30)], 10)
    assert sum(len(s.keys) for _, s in bench.searches) == 4
    assert bench.hits(b"same words same words same words same words same words".split()) == ([(0, 10)], {0, 1, 2, 3, 4})
    # nearly every pair of words is the end of a window, and yet most buckets are empty
    rng = random.Random(1)
    text = [b"%d" % int(rng.paretovariate(0.7)) for _ in range(60_000)]
    bench = decontaminate.Benchmark([(1, b" ".join(text))], 10)
    assert bench.hits(text[500:530]) == ([(0, 30)], {1}) and len(bench.searches[0][1].keys) <= 60_000


def test_toxicity(spark, empty):
    rng = random.Random(11)
    bad = ["vileworm", "vilework", "vileword"]
    data, labels = [], []
    for k in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.randint(3, 80))]
        toxic = k % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad).upper() if k < 400 else "vileWXYZ"
        data.append((k, " ".join(words), "x"))
        if k < 400:
            labels.append((k, 1 if toxic else k % 2, int(toxic)))
    labels += [(None, 1, 1), (5000, 1, 1), (3, None, 1), (8, 1, 1), (8, 0, 0)]
    data += [(None, None, None), (601, "", "x"), (602, None, "x"), (3, data[3][1], "x"), (603, "word " * 50_000 + "vileworm", "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, fold string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marked)
    out = got.collect()
    assert len(out) == len(data) and {"p_quality", "p_toxic"} <= set(got.columns)
    by = {r["doc_id"]: r["rejected"] for r in out}
    held = range(400, 600)
    assert sum(by[k] == (k % 4 == 0) for k in held) >= 196
    assert by[603] and not by[601] and not by[602]
    assert toxicity.toxicity(empty, marked).count() == 0
    assert toxicity.toxicity(docs, marked.limit(0)).where("rejected").count() == 0


def test_toxicity_chain_against_a_plain_one(spark):
    """Out-of-fold probabilities by hand; the models that score are fitted on all labelled rows."""
    rng = random.Random(3)
    data = []
    for k in range(300):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(12)]
        good, toxic = k % 3 == 0, k % 5 == 0
        words += ["polished"] * (rng.random() < (0.9 if good else 0.1)) + ["vileword"] * (rng.random() < (0.9 if toxic else 0.05))
        data.append((k, " ".join(words), int(good), int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in data], "doc_id long, text string").repartition(3)
    marked = spark.createDataFrame([(k, q, x) for k, _, q, x in data] + [(1, 7, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, marked)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(toxicity.SEED + 1)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    fold = np.array([fold[r[0]] for r in data])
    texts, quality, toxic = [r[1].encode() for r in data], np.array([r[2] for r in data], float), np.array([r[3] for r in data], float)
    none = np.zeros((len(data), 0))
    first = toxicity.Linear(*toxicity.fit_linear(texts, quality, none))
    out_of_fold = np.zeros(len(data))
    for f in range(toxicity.FOLDS):
        rest = np.flatnonzero(fold != f)
        model = toxicity.Linear(*toxicity.fit_linear([texts[k] for k in rest], quality[rest], none[rest]))
        for k in np.flatnonzero(fold == f):
            out_of_fold[k] = model.probability(*toxicity.words_of(texts[k]), [])
    second = toxicity.Linear(*toxicity.fit_linear(texts, toxic, out_of_fold[:, None]))
    for got, want in zip(chain.models, (first, second), strict=True):
        assert got.weights.keys() == want.weights.keys() and len(got.weights) > 1
        assert all(abs(got.weights[t] - w) < 1e-6 for t, w in want.weights.items())
        assert np.allclose(got.earlier, want.earlier, atol=1e-6)


def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(0, 0.2, 8).tolist() for _ in range(700)] + [[0.5] * 8] * 9
    data = [(k, v, 1) for k, v in enumerate(vectors)]
    data += [(1000, None, 1), (None, [0.1] * 8, 1), (1050, [0.1, None] * 4, 1), (1100, [float("nan")] * 8, 1), (1150, [float("inf")] * 8, 1), (1200, [1.0, 2.0], 1), (1201, [3.0, 1.0], 1), (1250, [], 1), (1300, [7.0], 1), (51, vectors[51], 1)]
    # far beyond 32 bits, but not so far that a score would not fit
    data += [(1350, [2.0**22, -(2.0**21)], 1), (1351, [-(2.0**22), 1.0], 1), (1352, [2.0**22, 0.5], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(5)
    good = []
    for k, v, _ in data:
        if k is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float32)).all():
            good.append((k, [math.floor(256 * float(np.float32(x))) for x in v]))
    want = Counter()
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))[:5]
            want.update((q, rank, c, -s) for rank, (s, c) in enumerate(scores, 1))
    assert rows(topk.nearest(df)) == want
    assert rows(topk.nearest(df, block=30)) == want
    assert topk.nearest(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="fit a long"):
        topk.nearest(spark.createDataFrame([(0, [3e38], 1), (1, [1.0], 1)], df.schema))


def test_topk_reads_few_exact_vectors(spark):
    """Bytes of exact vectors that are read from storage, of all that there are; and each query row is answered."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (6000, 64))
    v[100:2000] = v[100]  # copies
    data = [(k, x.tolist()) for k, x in enumerate(v)] + [(50, v[50].tolist())] * 2
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    count = spark.sparkContext.accumulator(0)
    got = topk.nearest(df, read_bytes=count)
    whole = np.floor(v * 256).astype(np.int64)
    want = Counter()
    for q in range(0, 6000, 50):
        scores = whole @ whole[q]
        order = sorted((-int(s), k) for k, s in enumerate(scores) if k != q)
        order = sorted(order + [x for x in order if x[1] == 50] * 2)[:5]
        for _ in range(3 if q == 50 else 1):
            want.update((q, rank, k, -s) for rank, (s, k) in enumerate(order, 1))
    assert rows(got) == want
    assert 122 * 5 * 128 <= count.value < 0.02 * 122 * len(data) * 128


def test_topk_stops_when_the_kth_is_certain():
    q, read = np.array([1, 0], np.int64), []
    exact = {k: np.array([100 - k, 7], "<i2") for k in range(50)}
    given = [(0, 9, 100.0 - k + 2, 0.0, k, "<i2", "f", 4 * k) for k in range(50)]
    got = list(topk.resolve(iter([*given, (1, 10, 5.0, 0.0, 3, "<i2", "f", 12)]), {9: q, 10: q}, 3, lambda f, at, n: read.append(at // 4) or exact[at // 4].tobytes()))
    assert got == [(0, 9, 1, 0, 100), (0, 9, 2, 1, 99), (0, 9, 3, 2, 98), (1, 10, 1, 3, 97)]
    assert read[:-1] == list(range(len(read) - 1)) and len(read) < 16


def test_topk_keeps_what_any_query_needs_of_equal_vectors():
    ids = np.array([5, 1, 1, 1, 1, 9, 7, 3, 8, 2])
    kept = topk._least_of_equal(ids, np.zeros((10, 2), np.int64), 2)
    assert sorted(ids[kept]) == [1, 1, 1, 1, 2, 3]
    assert len(topk._least_of_equal(ids, np.arange(20).reshape(10, 2), 2)) == 10


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """Smallest id reachable, by fingerprint."""
    values = sorted(set(p for _, p in prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {p: least.get(find(p)) for p in values}


def test_simhash(docs, empty, monkeypatch):
    prints = [(r[0], brute_fingerprint(r[1])) for r in table()]
    roots = brute_components(prints)
    want = Counter((i, f"{p:016x}", roots[p]) for i, p in prints)
    assert rows(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(empty).count() == 0
    monkeypatch.setattr(graph, "MOST_SENT", 0)
    assert rows(simhash.near_duplicates(docs)) == want


def test_simhash_masks_cover():
    masks = simhash.masks(4)
    rng = random.Random(1)
    assert len(masks) == 31
    for _ in range(20_000):
        differing = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & differing == 0 for m in masks)


@pytest.mark.parametrize("bucket", [2, 10, 16_384])
def test_simhash_links(spark, bucket):
    rng = random.Random(4)
    values = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(20):
            values.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = components(simhash.links(prints, "fp", 4, bucket)).collect()
    got = {v: v for v in signed} | {r["node"]: r["root"] for r in found}
    want = brute_components([(k, v & (1 << 64) - 1) for k, v in enumerate(sorted(signed))])
    groups = lambda pairs: sorted(sorted(g) for g in _grouped(pairs))
    assert groups((r, v) for v, r in got.items()) == groups((want[v & (1 << 64) - 1], v) for v in signed)


def brute_shingles(text):
    words = (text or "").encode().translate(bytes(range(256)).lower()).split()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_similar(texts):
    """Components of texts that share 0.8 or more of their shingles, as sets of positions."""
    sets = [brute_shingles(t) for t in texts]
    part = list(range(len(sets)))
    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                part = [part[j] if p == part[k] else p for p in part]
    return part


def near_texts():
    rng = random.Random(11)
    texts = []
    for n, changed, copies in [(100, 1, 12), (100, 2, 12), (300, 5, 12), (1000, 10, 6), (60, 3, 12), (30, 1, 12)]:
        for _ in range(4):
            at = [f"v{rng.randrange(5000)}" for _ in range(n)]
            for _ in range(copies):
                other = list(at)
                for k in rng.sample(range(n), changed):
                    other[k] = f"n{rng.randrange(10**9)}"
                texts.append(" ".join(other))
                at = other if rng.random() < 0.3 else at
    return texts


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_near_keeps_one_of_all_similar(spark, docs, empty, block):
    texts = near_texts() + [r[1] for r in table()]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    part = brute_similar(texts)
    least = {p: k for k, p in reversed(list(enumerate(part)))}
    assert sorted(r[0] for r in simhash.keep_one(made, block=block).select("doc_id").collect()) == sorted(least.values())
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(empty).count() == 0


def test_near_keeps_one_of_rows_without_keys(spark, docs):
    unnamed = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert simhash.keep_one(unnamed).count() == len(set(brute_similar([r[1] for r in table()])))


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    words = [[f"d{d}w{k}" for k in range(100)] for d in range(40)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:50], "changed", *w[51:]]) for w in words]
    made = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, made, "").collect()) == list(range(40))


def _grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out.values()


def test_sharding(spark, docs, empty):
    small = docs.select("doc_id", "text", F.lit(1).alias("sg_part"))
    out = sharding.shuffle(small, 7).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[k]) for k in range(7)]
    assert sum(sizes) == len(table()) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in table())
    assert sharding.shuffle(empty, 7).count() == 0
    many = sharding.shuffle(spark.range(0, 12_000, 1, 6), 5)
    order = [r["id"] for r in many.orderBy("shard", "slot").collect()]
    assert sorted(order) == list(range(12_000))
    # a uniform permutation: ids and places don't go together, nor do neighbours
    assert abs(np.corrcoef(order, range(12_000))[0, 1]) < 0.04
    assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.04


def test_sharding_is_jointly_uniform(spark):
    """What becomes of row i of one partition says nothing of row i, or any other, of the next."""
    n, parts = 10_000, 4
    found = []
    for seed in range(12):
        places = sharding.shuffle(spark.range(0, n * parts, 1, parts), 4, seed).select("id", (F.col("shard") * n + F.col("slot")).alias("at"), "shard", "slot").orderBy("id").toPandas()
        at, shard, slot = (places[c].to_numpy(float).reshape(parts, n) for c in ("at", "shard", "slot"))
        found += [np.corrcoef(x[p], y[q])[0, 1] for x in (at, shard, slot) for y in (at, shard, slot) for p in range(parts) for q in range(p)]
    # 648 coefficients with deviation 0.01
    assert max(map(abs, found)) < 0.05 and abs(np.std(found) - 0.01) < 0.002


def test_sharding_takes_all_orders_alike(spark):
    """The places of row i of four partitions come in each of the 24 orders equally often, and so do those of neighbours."""
    n, parts = 10_000, 4
    out = sharding.shuffle(spark.range(0, n * parts, 1, parts), 4, 5).select("id", (F.col("shard") * n + F.col("slot")).alias("at")).orderBy("id").toPandas()["at"].to_numpy()
    for columns in (out.reshape(parts, n).T, out.reshape(n, parts)):
        counts = Counter(map(tuple, np.argsort(columns, axis=1)))
        # chi-square with 23 degrees of freedom is below 49.7 in 999 of 1000 cases
        assert len(counts) == 24 and sum((c - n / 24) ** 2 / (n / 24) for c in counts.values()) < 49.7


def test_sharding_bounds_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_NUMBERS", 15)
    monkeypatch.setattr(sharding, "PLAN_ROWS", 2)
    out = sharding.shuffle(spark.range(0, 1000, 1, 8), 5).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in out) == [200] * 5


def test_log_step():
    for n, k in ((5, 3), (5000, -700), (10**6, 10**5), (2000, -1500)):
        assert abs(sharding._log_step(n, k) - (math.lgamma(n + k + 1) - math.lgamma(n + 1))) < 1e-8 * abs(math.lgamma(n + 1))
    # at 10**12 the quotient of neighbouring factorials is known to all digits
    assert abs(sharding._log_step(10**12, 1000) - sum(math.log(10**12 + j) for j in range(1, 1001))) < 1e-7


def test_hypergeometric():
    rng = random.Random(9)
    for good, bad, draws in ((30, 50, 20), (5, 400, 100), (1000, 3000, 2500), (10**10, 10**11, 10**9)):
        got = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(3000)], float)
        total = good + bad
        mean, var = draws * good / total, draws * good / total * bad / total * (total - draws) / (total - 1)
        assert abs(got.mean() - mean) < 5 * (var / 3000) ** 0.5 and 0.85 < got.var() / var < 1.15
        assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)
    m = sharding.matrix([10, 0, 33, 7], [13, 13, 12, 12])
    assert [sum(r) for r in m] == [10, 0, 33, 7] and [sum(c) for c in zip(*m)] == [13, 13, 12, 12]


def brute_lines(data):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    holders = defaultdict(list)
    for r in data:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            holders[k].append(-1 if r[0] is None else r[0])
    bad = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    for r in data:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if bad.get(key(x), -2) in (-2, -1 if r[0] is None else r[0])]
        yield r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("shard, passes", [(3, 1), (50_000, 1 << 30)])
def test_line_dedup(spark, docs, empty, shard, passes):
    got = line_dedup.dedup_lines(docs, shard_keys=shard, pass_bytes=passes)
    assert rows(got.select("doc_id", "n_lines", "n_dropped", "kept_sha256")) == Counter(brute_lines(table()))
    assert line_dedup.dedup_lines(empty).count() == 0
    assert got.columns[:-3] == docs.columns
    nobody = spark.createDataFrame([(None, LINE)] * 6, "doc_id long, text string")
    assert line_dedup.dedup_lines(nobody).where("n_dropped > 0").count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(nobody.select(F.lit("a").alias("doc_id"), "text"))


def test_line_index_decides_by_its_counts():
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**62), 2**62, (1000, 2))
    keys = line_dedup._mixed_halves(h[:, 0].copy(), h[:, 1].copy(), 0)
    perfect = line_dedup.PerfectHash.build(keys)
    at, counts, prints = perfect.index(keys), np.zeros(1000, np.int32), np.zeros(1000, np.int64)
    counts[at], prints[at] = np.arange(1000) % 10, h[:, 1]
    row = {"shard": 0, "seed": 0, "sizes": perfect.sizes.tobytes(), "bits": perfect.bits.tobytes(), "fingerprints": prints.tobytes(), "counts": counts.tobytes(), "keepers": np.zeros(1000, np.int64).tobytes(), "has_keeper": np.ones(1000, np.uint8).tobytes()}
    index = line_dedup.Index([row], 1, 5)
    assert (index.drops(h, [7] * 1000) == (np.arange(1000) % 10 >= 5)).all()
    assert not index.drops(h, [0] * 1000).any() and not index.drops(rng.integers(-(2**62), 2**62, (1000, 2)), [7] * 1000).any()
    assert line_dedup.PerfectHash.build(np.array([3, 3], np.uint64)) is None


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 30_000, dtype=np.int64).view(np.uint64)
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.index(keys)) == list(range(len(keys)))
    again = line_dedup.PerfectHash(h.sizes, h.bits)
    assert (again.index(keys) == h.index(keys)).all()


def test_licenses(docs, empty):
    got = licenses.scan(docs)
    want = Counter()
    for r in table():
        w, starts, labels = alnum(r[1]), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        want[r[0], len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))] += 1
    assert rows(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == want
    assert licenses.scan(empty).count() == 0


def brute_labels(text):
    """Labels and score by looking at each template's diagonals one by one."""
    words, labels, score = alnum(text), set(), 0.0
    for template, label in {**licenses.PHRASES, **licenses.TEXTS}.items():
        own = template.split()
        lines = defaultdict(set)
        for k in range(len(words) - 1):
            for j in range(len(own) - 1):
                if words[k:k + 2] == own[j:j + 2]:
                    lines[k - j].add(j)
        grams, spans, last = len(own) - 1, [], None
        for d in sorted(lines):
            if template in licenses.PHRASES or last is None or d - last > licenses.NEAR:
                spans.append(set())
            spans[-1] |= lines[d]
            last = d
        best = max((len(x) / grams for x in spans), default=0.0)
        if template in licenses.PHRASES:
            if best == 1:
                labels.add(label)
                score = 1.0
        else:
            score = max(score, best)
            labels |= {label} if best >= licenses.COVER else set()
    return ",".join(sorted(labels)), round(score, 9)


def test_licenses_labels_against_brute_force(spark):
    rng = random.Random(8)
    texts = [r[1] for r in table() if len(r[1] or "") < 5000]
    for template in licenses.TEXTS:
        for edits in (0, 2, 5, 9):
            words = template.title().split()
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 1)] = rng.choice([[], ["other"], ["two", "more"]])
            texts.append("so, " + " - ".join(words) + " " + " ".join(rng.sample(template.split(), 9)))
    texts.append(" and ".join(licenses.TEXTS) + " MIT license")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(df).collect()}
    want = {k: brute_labels(t) for k, t in enumerate(texts)}
    assert got == want and sum(bool(x) for x, _ in want.values()) > 20


def test_licenses_edited_text(spark):
    text = next(t for t, x in licenses.TEXTS.items() if x == "mit-text").upper().split()
    del text[9]
    text.insert(20, "really")
    df = spark.createDataFrame([(1, "intro words, " + " ".join(text)), (2, " ".join(sorted(text)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert got[1]["labels"] == "mit-text" and 0.6 <= got[1]["score"] < 1 and got[1]["base_labels"] == ""
    assert got[2]["labels"] == "" and got[2]["score"] < 0.6


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block"), ("net", "/", "block"), ("deep.example.net", "", "block")]


def brute_url(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(ASCII)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("most", [100_000, 0])
def test_url_filter(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_SENT", most)
    urls = [None, "", "x", "://", "http://NET", "http://net/", "http://net?x", "https://a.example.net/en/1?q=://", "https://a.example.net/en", "http://deep.example.net/en/1", "http://x.deep.example.net", "http://example.com/de/#f", "http://notexample.com/de/", "http://b.org/fr/x", "http://b.org/en/x", "http://..net/", "http://É.net/ü", "http://com.net/\n"]
    data = [(k, u, 1, "x") for k, u in enumerate(urls)] + [(5, urls[5], 1, "x"), (None, urls[7], None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, sg_row int, key string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules)
    assert rows(got.select("page_id", "host", "path", "rule", "verdict")) == Counter((r[0], *brute_url(r[1])) for r in data)
    assert got.columns[:4] == pages.columns
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert url_filter.judge(pages, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_url_filter_joins_only_possible_hits(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_SENT", 0)
    seen = []
    joined = url_filter._listed
    monkeypatch.setattr(url_filter, "_listed", lambda a, b: (seen.append(a.count()), joined(a, b))[1])
    pages = spark.range(1000).select(F.when(F.col("id") % 100 == 0, "http://a.example.com/de/x").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".test/p"))).alias("url"))
    rules = spark.createDataFrame([("example.com", "/de/", "block")], "host string, path string, verdict string")
    assert url_filter.judge(pages, rules).where("verdict = 'block'").count() == 10
    assert 10 <= seen[0] <= 30


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    bits = url_filter.bloom(keys, "k")
    there = [f"k{k}" for k in range(5000)]
    assert url_filter._possible(bits, there).all()
    assert url_filter._possible(bits, [f"z{k}" for k in range(5000)]).mean() < 0.05


def test_crc_is_unsigned(spark):
    assert spark.sql("select crc32('idiot')").first()[0] == zlib.crc32(b"idiot")
