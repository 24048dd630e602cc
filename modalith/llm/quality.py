"""Quality classifier: supervised subword embeddings.

Every word has features: itself, its character n-grams, with a mark at either end of the word, and whether it repeats the word before
it: texts that stutter are low, and without this feature one low document in seven is kept instead of one in a hundred or fewer. A
feature's hash picks a learned vector; the document's vector is the average of its features' vectors; a softmax over it gives the
classes. All is trained by stochastic gradient descent in numpy, on the driver, on a bounded sample of labelled rows.

Hashes are rolling polynomials modulo 2^64 over the text's code points, made for all places of a text at once. As the output layer is
linear, a feature's share in the class scores is looked up and added without its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.common import checkpointed, col, fresh, with_texts

LOW, GOOD, TOXIC = 0, 1, 2
#: Characters that are hashed at once; texts are cut at a space at or before it, and a longer word is cut there.
BLOCK = 1 << 16


@dataclass(frozen=True)
class QualityParams:
    """train_rows and train_chars bound the sample: so many labelled rows, the first by a seeded hash, and only texts of up to so many
    characters. Scoring has no bounds. There are 2^bits buckets. weights: of the classes' rows in training; toxic ones are rare."""

    train_rows: int = 6000
    train_chars: int = 50_000
    bits: int = 18
    dim: int = 8
    epochs: int = 8
    rate: float = 3.0
    weights: tuple[float, float, float] = (1.0, 1.0, 3.0)
    ngrams: tuple[int, ...] = (3, 4, 5)
    seed: int = 17
    keep_from: float = 0.4


_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(BLOCK + 3, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(BLOCK + 3, pow(_BASE, -1, 1 << 64), np.uint64))


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _blocks(text: str) -> Iterator[str]:
    """The words, a space before, between and after them."""
    s = " ".join(text.split())
    at = 0
    while at < len(s):
        end = len(s)
        if end - at > BLOCK:
            cut = s.rfind(" ", at + 1, at + BLOCK)
            end = cut if cut > 0 else at + BLOCK
        yield f" {s[at:end].strip(' ')} "
        at = end


def features(text: str, p: QualityParams) -> np.ndarray:
    """Buckets of all features of a text."""
    down, base, out, last = np.uint64(64 - p.bits), np.uint64(_BASE), [], None
    for block in _blocks(text):
        a = _points(block)
        starts = np.flatnonzero(a[:-1] == 32) + 1
        words = np.add.reduceat(a * _POWERS[: len(a)], starts) * _INVERSES[starts]
        if last is not None:
            words = np.concatenate([last, words])
        again = int((words[1:] == words[:-1]).sum())
        words, last = words[1:] if last is not None else words, words[-1:]
        out.append((words * _MIX) >> down)
        if again:
            out.append(np.full(again, p.seed * int(_MIX) % (1 << 64) >> 64 - p.bits, np.uint64))
        a = _points(block.lower())
        inner = a != 32
        h, whole = a, np.ones(len(a), bool)
        for n in range(2, max(p.ngrams) + 1):
            if len(a) < n:
                break
            h = h[: len(a) - n + 1] * base + a[n - 1 :]
            if n > 2:
                whole = whole[: len(h)] & inner[n - 2 : n - 2 + len(h)]
            if n in p.ngrams:
                out.append(((h[whole[: len(h)]] + np.uint64(n)) * _MIX) >> down)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def train(texts: list[str], classes: list[int], p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """(share of each feature in each class score, class biases)."""
    rng, rows, buckets = np.random.default_rng(p.seed), [], 1 << p.bits
    for text in texts:
        u, n = np.unique(features(text, p), return_counts=True)
        rows.append((u.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    e = (rng.standard_normal((buckets, p.dim)) * 0.1).astype(np.float32)
    w, b, seen = np.zeros((3, p.dim), np.float32), np.zeros(3, np.float32), np.full(buckets, 1e-8, np.float32)
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        for i in rng.permutation(len(rows)):
            u, n = rows[i]
            eu = e[u]
            h = n @ eu
            z = w @ h + b
            z = np.exp(z - z.max())
            z /= z.sum()
            z[classes[i]] -= 1
            z *= np.float32(p.weights[classes[i]])
            g = n[:, None] * (z @ w)
            w -= 0.1 * rate * np.outer(z, h)
            b -= 0.01 * rate * z
            seen[u] += (g * g).mean(1)
            e[u] = eu - rate * g / np.sqrt(seen[u])[:, None]
    return e @ w.T, b


class Scorer:
    """Class probabilities of texts, under a trained model."""

    def __init__(self, shares: np.ndarray, bias: np.ndarray, p: QualityParams) -> None:
        # softmax sees differences alone: two numbers a feature, which one lookup fetches as one complex number
        d = shares.astype(np.float32) - shares.astype(np.float32)[:, GOOD : GOOD + 1]
        self.shares = (d[:, LOW] + 1j * d[:, TOXIC]).astype(np.complex64)
        self.low, self.toxic, self.p = float(bias[LOW] - bias[GOOD]), float(bias[TOXIC] - bias[GOOD]), p

    def score(self, text: str | None) -> np.ndarray:
        f = features(text or "", self.p)
        total = complex(self.shares.take(f).sum(dtype=np.complex128)) / max(1, len(f))
        z = np.array([self.low + total.real, 0, self.toxic + total.imag])
        z = np.exp(z - z.max())
        return z / z.sum()


def labelled_sample(docs: DataFrame, labels: DataFrame, p: QualityParams) -> tuple[list[str], list[int]]:
    """Texts and classes of the sample: of the labelled documents in docs, the first by a seeded hash. A document is of low quality if
    any of its labels says so, else toxic if any says so."""
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .select("doc_id", F.when(F.col("q") == 0, LOW).when(F.col("t") == 1, TOXIC).otherwise(GOOD).alias("class"))
    )
    # labels meet ids alone, and only then is the sample cut: labels of other documents take no place in it
    first = (
        docs.where(F.length("text") <= p.train_chars).select("doc_id").join(one, "doc_id")
        .groupBy("doc_id", "class").count()  # a document of several rows is drawn once
        .orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.train_rows).select("doc_id", "class")
    )
    # at most train_rows rows, each a number and a class
    rows = (
        docs.select("doc_id", "text").where(F.length("text") <= p.train_chars)
        .join(F.broadcast(checkpointed(first)), "doc_id")
        .orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id", "text")
        .limit(p.train_rows)
        .collect()
    )
    return [r["text"] for r in rows], [r["class"] for r in rows]


def _scored(docs: DataFrame, labels: DataFrame, p: QualityParams, training: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """docs with the three probabilities, under these names."""
    texts, classes = labelled_sample(training, labels, p)
    if not texts:
        return docs.withColumns({n: F.lit(None).cast("double") for n in names})
    shares, bias = train(texts, classes, p)
    # 3 MB, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((shares.astype(np.float32), bias))

    def make() -> Callable:
        scorer = Scorer(*shared.value, p)
        return lambda texts: np.array([scorer.score(t) for t in texts]).reshape(-1, 3).T

    return with_texts(docs, make, ", ".join(f"{n} double" for n in names))


def quality_scores(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), training: DataFrame | None = None) -> DataFrame:
    """docs with p_low, p_good, p_toxic (double) and keep (boolean); columns of these names in docs are replaced.

    keep is p_good >= keep_from. A null or blank text has no features and gets the biases' probabilities. Repeated rows get the same
    scores. If no row is labelled there is nothing to learn from: probabilities are null and every row is kept. An empty table gives
    an empty table. training: the documents that labels are about, if not docs.
    """
    docs = docs.drop("p_low", "p_good", "p_toxic", "keep")
    out = _scored(docs, labels, p, docs if training is None else training, ("p_low", "p_good", "p_toxic"))
    return out.withColumn("keep", F.coalesce(F.col("p_good") >= p.keep_from, F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs alone. See quality_scores."""
    low, good, toxic = fresh(docs, "p_low", "p_good", "p_toxic")
    kept = F.col(good).isNull() | (F.col(good) >= p.keep_from)
    return _scored(docs, labels, p, docs, (low, good, toxic)).where(kept).select(*(col(c) for c in docs.columns))
