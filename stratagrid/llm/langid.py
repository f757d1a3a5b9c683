"""Operator 12: languages of a text, by inference of the mixture that its words come from.

Each language has a model of byte trigrams within words, counted over all labelled texts. A text is taken as a mixture: each word
comes from one language, with the likelihood of its trigrams. Expectation-maximisation estimates the proportions of the
languages. Which languages the text has at all is decided by penalised likelihood: the sets tried are the language that is
likeliest alone, then the two, three, ... with the largest proportions, for as long as a further language raises the log
likelihood by more than ``PENALTY`` times the logarithm of the number of words. The prediction is the language with the largest
proportion in that set.

Likelihood is concave in the proportions. Where no direction away from the best single language raises it, that language
alone is the maximum, and nothing is iterated.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash, held, let_go, need, written

#: Hashed trigrams of a model; share of the pooled model and of an even one in each language's; what a further language costs.
BUCKETS, POOLED, EVEN, PENALTY = 1 << 16, 0.02, 0.002, 2.0
#: Buckets whose counts make a row.
PART = 1 << 10
#: Rounds of expectation-maximisation, and the change of proportions that ends them.
ROUNDS, STILL = 200, 1e-4
#: Languages that a model has at most: half a megabyte of counts each goes through the driver.
MOST_LANGUAGES = 256
#: Different words whose likelihoods are held at once; those of longer texts are computed again in each round.
CHUNK = 1 << 16
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Stretches of letters, in lower case; none if the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of the words, each with a blank before and after; where each word's begin; and which span two words."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]) * np.uint32(2_654_435_761)
    return code >> np.uint32(16), np.flatnonzero(flat == 32)[:-1], flat[1:-1] == 32


def count(docs: DataFrame, label: str, text: str) -> DataFrame:
    """lang, part and cells (array of bucket, n): the trigrams of all texts whose ``label`` isn't null, PART buckets to a row; bucket -1
    counts the texts."""
    partial = "lang string, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[str]] = {}
        seen: Counter = Counter()

        def add(lang: str) -> None:
            words = [w.encode() for w in waiting.pop(lang)]
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for first in range(0, len(words), CHUNK):
                code, _, across = trigrams(words[first:first + CHUNK])
                own += np.bincount(code[~across], minlength=BUCKETS)

        for batch in batches:
            for lang, value in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                seen[lang] += 1
                waiting.setdefault(lang, []).extend(words_of(value.as_py()))
                if len(waiting[lang]) >= CHUNK:
                    add(lang)
        for lang in seen:
            if waiting.get(lang):
                add(lang)
            own = sums.get(lang, np.zeros(BUCKETS, np.int64))
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(own[at], seen[lang]))], names=["lang", "bucket", "n"])

    labelled = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), text)
    sums = labelled.mapInArrow(run, partial).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return sums.groupBy("lang", F.floor(F.col("bucket") / PART).alias("part")).agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))


def counted(rows: Iterator) -> list[tuple[str, int, np.ndarray]]:
    """(language, texts, counts of all buckets) from the rows of ``count``."""
    docs: Counter = Counter()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        own = counts.setdefault(r["lang"], np.zeros(BUCKETS, np.int64))
        for bucket, n in r["cells"]:
            if bucket < 0:
                docs[r["lang"]] += n
            else:
                own[bucket] = n
    return [(lang, docs[lang], own) for lang, own in counts.items()]


class Model:
    """Log likelihoods of trigrams (buckets x languages). Languages come in the order of their texts, the most first."""

    def __init__(self, rows: list[tuple[str, int, np.ndarray]]):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.langs = [r[0] for r in rows]
        counts = np.array([r[2] for r in rows], float).reshape(len(rows), BUCKETS)
        pooled = counts.sum(0) / max(1.0, counts.sum())
        own = counts / np.maximum(1.0, counts.sum(1, keepdims=True))
        # what no language has seen is as likely in all of them, however many texts they have
        self.log = np.log((1 - POOLED - EVEN) * own + POOLED * pooled + EVEN / BUCKETS).astype(np.float32).T.copy()

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Of each word in each language, as shares of the likeliest one."""
        code, starts, across = trigrams(words)
        log = self.log[code]
        log[across] = 0
        by_word = np.add.reduceat(log, starts, axis=0).astype(float)
        return np.exp(by_word - by_word.max(1, keepdims=True))

    def mixture(self, text: str | None) -> tuple[list[tuple[str, float]], int]:
        """The languages of the text and their proportions, the largest first, and its words; none without letters or languages."""
        words = Counter(words_of(text))
        if not words or not self.langs:
            return [], 0
        kinds, n = [w.encode() for w in words], np.fromiter(words.values(), float, len(words))
        cuts, once = [slice(k, k + CHUNK) for k in range(0, len(kinds), CHUNK)], None
        if len(cuts) == 1:
            once = [(self.likelihoods(kinds), n)]
        chosen = select(lambda: once or ((self.likelihoods(kinds[c]), n[c]) for c in cuts), int(n.sum()), len(self.langs))
        return [(self.langs[k], share) for k, share in chosen], int(n.sum())


Parts = Callable[[], "list | Iterator"]


def fit(parts: Parts, over: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the languages ``over`` that are likeliest, and their log likelihood, by expectation-maximisation."""
    share, log = np.full(len(over), 1 / len(over)), -np.inf
    for _ in range(ROUNDS):
        grown, log = np.zeros(len(over)), 0.0
        for like, n in parts():
            own = like if like.shape[1] == len(over) else like[:, over]
            mixed = np.maximum(own @ share, 1e-300)
            grown += (n / mixed) @ own * share
            log += float(n @ np.log(mixed))
        new = grown / grown.sum()
        moved, share = np.abs(new - share).max(), new
        if moved < STILL:
            break
    return share, log


def select(parts: Parts, total: int, langs: int) -> list[tuple[int, float]]:
    """(language, proportion) of the set with the largest penalised likelihood, the largest proportion first. ``parts`` gives arrays of
    likelihoods (words x languages) and of how often the words occur."""
    alone = sum(n @ np.log(np.maximum(like, 1e-300)) for like, n in parts())
    best = int(np.argmax(alone))
    chosen = [(best, 1.0)]
    if langs == 1:
        return chosen
    gain = sum(n @ (like / np.maximum(like[:, best:best + 1], 1e-300)) for like, n in parts())
    if gain.max() <= total:
        return chosen
    share, _ = fit(parts, list(range(langs)))
    order = sorted(range(langs), key=lambda k: (-share[k], k))
    score, cost = float(alone[best]), PENALTY * np.log(total + 1)
    for size in range(2, langs + 1):
        over = sorted(order[:size])
        own, log = fit(parts, over)
        if log - cost * (size - 1) <= score:
            break
        score = log - cost * (size - 1)
        chosen = sorted(zip(over, own.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return chosen


def identify(docs: DataFrame, learn: DataFrame, label: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` with languages (array of lang, share: the set chosen, the largest share first), lang_pred and score.

    The models are counted over all rows of ``learn`` whose ``label`` isn't null; nothing else of ``docs`` than ``text`` is used.
    score: the share of lang_pred, with one more word spread over all languages, so that short texts are less sure. Null texts,
    texts without a letter, and all texts where nothing was learned: no languages, lang_pred ``und``, score 0. Texts
    of words that tell nothing go to the language with most texts; equal ones to the first in alphabetical order. Repeated rows count and
    are judged each. More than ``MOST_LANGUAGES`` different labels are an error. No columns languages, lang_pred, score may be there before.
    """
    need(learn, label, text)
    need(docs, text)
    clash(docs, "languages", "lang_pred", "score")
    counts = written(count(learn, label, text), "langid")
    if (kinds := counts.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{kinds} different labels; a model has {MOST_LANGUAGES} languages at most")
    # BUCKETS numbers for each language at most
    rows = counted(counts.toLocalIterator())
    shipped, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    none = F.lit(None)
    schema = docs.withColumns({"languages": none.cast("array<struct<lang:string,share:double>>"), "lang_pred": none.cast("string"), "score": none.cast("double")}).schema
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(name, lambda: Model(shipped.value))
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                mixed, best, score = [], [], []
                for value in batch.column(text):
                    found, words = model.mixture(value.as_py())
                    mixed.append([{"lang": lang, "share": share} for lang, share in found])
                    best.append(found[0][0] if found else UNKNOWN)
                    score.append((found[0][1] * words + 1 / len(model.langs)) / (words + 1) if found else 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mixed, kind), pa.array(best), pa.array(score, pa.float64())], names=[*batch.schema.names, "languages", "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
