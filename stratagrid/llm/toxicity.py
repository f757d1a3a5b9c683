"""Operator 4: toxicity by a classifier chain.

One linear model per category, in order. Each sees the words of the text and the probabilities of the categories before
it. While training, those come from models fitted on the other folds, so a later model learns from probabilities as good,
and as bad, as it will meet. The models of all folds are fitted at once, each in a task of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, clash, let_go, need, utf8, written

#: Labelled rows that the models are fitted on: those with the smallest hashes of their ids. All others are scored only.
SAMPLE = 6_000
FOLDS, SEED = 3, 42
#: Sampled texts that hold a token at least, how many standard errors its share among the positive texts is away from that
#: among the others at least, and how many such tokens a model has at most.
MIN_TEXTS, MIN_Z, TOKENS = 8, 4.5, 3_000
#: Beside whole words, their first bytes.
PREFIXES = (4, 5, 6)
#: Strength of the L1 penalty, and steps of the fit.
PENALTY, STEPS = 0.0005, 300
#: Clean held-out texts score below a tenth of this, toxic ones mostly far above.
THRESHOLD = 0.25
BIAS = b""
#: The number of the model that is fitted on all rows: no fold's.
WHOLE = -1


def words_of(text: bytes | None) -> tuple[set[bytes], dict[int, set[bytes]]]:
    """The text's distinct words, and their first bytes by number."""
    words = set(text.translate(ALNUM_WORDS).split()) if text else set()
    return words, {n: {w[:n] for w in words} for n in PREFIXES}


def tokens(text: bytes | None) -> set[bytes]:
    """The words, and the first bytes marked with a star."""
    words, starts = words_of(text)
    return words.union(*[{s + b"*" for s in own if len(s) == n} for n, own in starts.items()])


class Linear:
    """A logistic model: weights of tokens, of earlier probabilities, and ``BIAS``."""

    def __init__(self, weights: dict[bytes, float], earlier: Sequence[float]):
        self.weights, self.earlier = weights, list(earlier)
        self.words = {k: v for k, v in weights.items() if k and not k.endswith(b"*")}
        self.starts = {n: {k[:-1]: v for k, v in weights.items() if k.endswith(b"*") and len(k) == n + 1} for n in PREFIXES}

    def probability(self, words: set[bytes], starts: dict[int, set[bytes]], before: Sequence[float]) -> float:
        z = self.weights.get(BIAS, 0.0) + sum(a * b for a, b in zip(self.earlier, before, strict=True))
        z += sum([self.words[w] for w in words & self.words.keys()])
        for n, known in self.starts.items():
            if known:
                z += sum([known[s] for s in starts[n] & known.keys()])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_linear(texts: Sequence[bytes | None], y: np.ndarray, earlier: np.ndarray) -> tuple[dict[bytes, float], list[float]]:
    """L1-penalised logistic regression by accelerated proximal gradients. ``earlier``: a column per category before."""
    n, positive = len(y), max(1, int(y.sum()))
    # texts are taken apart twice, so that only one text's tokens are held at a time
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for t, label in zip(texts, y, strict=True):
        counts[int(label)].update(tokens(t))
    scored = []
    least = min(MIN_TEXTS, max(2, n // 100))
    for t in {k for own in counts for k, c in own.items() if 2 * c >= least}:
        a, b = counts[0][t], counts[1][t]
        if a + b >= least:
            p, q, all_ = b / positive, a / max(1, n - positive), (a + b) / n
            z = abs(p - q) / np.sqrt(max(all_ * (1 - all_), 1e-9) * (1 / positive + 1 / max(1, n - positive)))
            if z >= MIN_Z:
                scored.append((-z, t))
    chosen = [t for _, t in sorted(scored)[:TOKENS]]
    place = {t: k for k, t in enumerate(chosen)}
    del counts
    rows, cols = [], []
    for k, text in enumerate(texts):
        c = [place[t] for t in tokens(text) & place.keys()]
        rows += [k] * len(c)
        cols += c
    d, extra = len(chosen), earlier.shape[1] + 1
    rows, cols, dense = np.array(rows, np.int64), np.array(cols, np.int64), np.column_stack([np.ones(n), earlier])
    w = np.zeros(d + extra)
    w[d] = np.log(positive / max(1, n - positive))
    v = w
    longest = max(1.0, np.bincount(rows, minlength=n).max(initial=1) * 1.0 + extra)
    # rare tokens have flat directions: each gets a step in proportion to how rarely it occurs
    step, t = 4 / longest * n / (np.concatenate([np.bincount(cols, minlength=d), np.full(extra, n)]) + 1), 1.0
    penalty = np.concatenate([np.full(d, PENALTY), np.zeros(extra)]) * step
    for _ in range(STEPS):
        z = np.bincount(rows, v[cols], minlength=n) + dense @ v[d:]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        u = v - step * np.concatenate([np.bincount(cols, g[rows], minlength=d), dense.T @ g])
        new = np.sign(u) * np.maximum(np.abs(u) - penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t_next * (new - w), t_next
    weights = {c: float(x) for c, x in zip(chosen, w[:d], strict=True) if x}
    weights[BIAS] = float(w[d])
    return weights, [float(x) for x in w[d + 1:]]


class Chain:
    """Fitted models in the order of ``categories``."""

    def __init__(self, categories: Sequence[str], models: Sequence[Linear]):
        self.categories, self.models = list(categories), list(models)

    def probabilities(self, text: bytes | None) -> list[float]:
        words, starts = words_of(text)
        out: list[float] = []
        for model in self.models:
            out.append(model.probability(words, starts, out))
        return out

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with the column p_<category> (double) for each category, which must not be there before; null and empty texts get
        what the models say without words."""
        need(df, text)
        names = [f"p_{c}" for c in self.categories]
        clash(df, *names)
        schema = df.withColumns({c: F.lit(None).cast("double") for c in names}).schema
        shipped = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            chain = shipped.value
            for whole in batches:
                for first in range(0, whole.num_rows, 1024):
                    batch = whole.slice(first, 1024)
                    made = [chain.probabilities(t) for t in utf8(batch.column(text))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in made], pa.float64()) for k in range(len(names)))], names=[*batch.schema.names, *names])

        return df.mapInArrow(run, schema)


def _fit_all(rows: DataFrame, category: str, before: Sequence[str], folds: int) -> dict[int, Linear]:
    """The models without fold 0, 1, ..., and at ``WHOLE`` that of all rows. Each task has one model's rows, at most the sample."""
    numbers = F.array(*[F.lit(k) for k in (WHOLE, *range(folds))])
    groups = rows.select("fold", "text", category, *[f"p_{c}" for c in before], F.explode(numbers).alias("model")).where("model != fold")

    def fit_one(pdf):
        import pandas as pd

        y = pdf[category].to_numpy(float)
        earlier = pdf[[f"p_{c}" for c in before]].to_numpy(float)
        texts = [bytes(t) if t is not None else None for t in pdf["text"]]
        weights, own = fit_linear(texts, y, earlier) if 0 < y.sum() < len(y) else ({BIAS: float(30 * np.sign(y.mean() - 0.5))}, [0.0] * len(before))
        out = [(int(pdf["model"].iloc[0]), t, w) for t, w in weights.items()] + [(int(pdf["model"].iloc[0]), b"\0%d" % k, w) for k, w in enumerate(own)]
        return pd.DataFrame(out, columns=["model", "token", "weight"])

    found: dict[int, tuple[dict, dict]] = {}
    for r in groups.groupBy("model").applyInPandas(fit_one, "model int, token binary, weight double").collect():
        token, (weights, own) = bytes(r["token"]), found.setdefault(r["model"], ({}, {}))
        if token[:1] == b"\0":
            own[int(token[1:])] = r["weight"]
        else:
            weights[token] = r["weight"]
    return {k: Linear(w, [e[i] for i in range(len(before))]) for k, (w, e) in found.items()}


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), key: str = "doc_id", text: str = "text", sample: int = SAMPLE, folds: int = FOLDS) -> Chain | None:
    """A chain over the label columns ``categories`` (0 or 1), fitted on at most ``sample`` labelled rows of ``docs``.

    Rows with a null key or a label other than 0 and 1 take no part, nor do labels without a document; of repeated labels of a
    key the largest values count, of repeated documents one. None if no category has both labels in the sample; categories that have
    one only are left out.
    """
    need(docs, key, text)
    need(labels, key, *categories)
    usable = labels.select(key, *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    for c in categories:
        usable = usable.where(F.col(c).isin(0, 1))
    usable = usable.groupBy(key).agg(*[F.max(c).alias(c) for c in categories])
    chosen = usable.join(docs.select(key).distinct(), key, "left_semi").withColumn("_sg_order", F.xxhash64(F.col(key), F.lit(SEED))).orderBy("_sg_order", key).limit(sample).drop("_sg_order")
    # at most `sample` ids and labels: small enough to broadcast whatever the corpus
    rows = docs.select(key, F.col(text).cast("binary").alias("text")).join(F.broadcast(chosen), key).dropDuplicates([key])
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 1)), F.lit(folds)).cast("int")), "labelled")
    seen = rows.agg(*[F.min(c).alias(f"min_{c}") for c in categories], *[F.max(c).alias(f"max_{c}") for c in categories]).first()
    used = [c for c in categories if seen[f"min_{c}"] is not None and seen[f"min_{c}"] < seen[f"max_{c}"]]
    if not used:
        return None
    models = []
    for k, category in enumerate(used):
        # the last model's probabilities go into no other, so it needs none without a fold
        found = _fit_all(rows, category, used[:k], folds if k + 1 < len(used) else 0)
        models.append(found[WHOLE])
        if k + 1 < len(used):
            rows = _out_of_fold(rows, category, used[:k], found)
    return Chain(used, models)


def _out_of_fold(rows: DataFrame, category: str, before: Sequence[str], found: dict[int, Linear]) -> DataFrame:
    """``rows`` with p_<category> by the model that was fitted without the row's fold."""
    schema = rows.withColumn(f"p_{category}", F.lit(None).cast("double")).schema
    shipped = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            earlier = [batch.column(f"p_{c}").to_pylist() for c in before]
            made = []
            for k, (t, fold) in enumerate(zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)):
                made.append(shipped.value.get(fold, shipped.value[WHOLE]).probability(*words_of(t), [e[k] for e in earlier]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, f"p_{category}"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", categories: Sequence[str] = ("quality", "toxic"), target: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with p_<category> for each category and ``rejected`` (p_<target> >= ``threshold``).

    Every row is scored on its whole text where it lies. Without usable labels all probabilities are 0 and nothing is rejected.
    Null texts are scored as empty. Repeated rows score alike.
    """
    clash(docs, *[f"p_{c}" for c in categories], "rejected")
    chain = fit(docs, labels, categories, key, text, sample)
    out = chain.score(docs, text) if chain else docs
    for c in categories:
        if f"p_{c}" not in out.columns:
            out = out.withColumn(f"p_{c}", F.lit(0.0))
    return out.withColumn("rejected", F.col(f"p_{target}") >= threshold)
