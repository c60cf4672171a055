"""Toxicity as multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words and their stems, and the document's is the
noisy-or of its sentences: it is toxic unless every sentence is harmless,
``1 - (1 - leak) * prod(1 - p_s)``. Only documents have labels; the gradient of the document's likelihood shares the blame among its
sentences, which is what then locates the offending ones.

The classifier is fitted on a documented bound of labelled documents, at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes of whole texts: those with the smallest
hashes of doc_id. The bound holds for rows of documents, however often a doc_id repeats, and only these rows reach the driver.
Which of their words are features is part of the fit (a test of significance against chance, ``EXCESS``, which takes words of ``LEAST_DOCUMENTS`` toxic documents or more); the fitted weights, which the
bound of the sample bounds too, go to every task, and all documents are scored whole.

Defined cases: a null or wordless text has no sentences and gets the leak as its score; null or missing labels are not learned
from; of repeated labels of a doc_id the largest counts; rows that repeat id and text are learned from once and score alike; without both labels among
the training rows every score is the share of toxic ones (0 without rows); an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches

FOLDS = 5
SAMPLE, SAMPLE_BYTES = 12_000, 48_000_000
LEAST_DOCUMENTS = 3
STEM = 5
STEPS = 150
RATE = 0.05
#: Pull of the weights towards the log odds of their words' documents, from which they start.
L2 = 1e-4
#: Standard errors by which a word's documents must be toxic more often than all documents.
EXCESS = 4.0
THRESHOLD = 0.5
#: A sentence offends if its own score is at least this.
OFFENDING = 0.5

#: A-Z to a-z, sentence ends to newline, other ASCII that is no letter or digit to a space.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x0A if b in b".!?\n" else 0x20 for b in range(256))
_SENTENCE = re.compile(r"[^.!?\n]+")


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
    return [w for w in map(bytes.split, raw.split(b"\n")) if w]


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of the sentences that ``sentences`` returns, in the same order."""
    return [m.span() for m in _SENTENCE.finditer(text) if m[0].encode("utf-8", "surrogatepass").translate(_BYTES).split()]


def stem(word: bytes) -> bytes:
    """The first STEM code points of a word of UTF-8."""
    if len(word) <= STEM:
        return word
    if word.isascii():
        return word[:STEM]
    return word.decode("utf-8", "surrogatepass")[:STEM].encode("utf-8", "surrogatepass")


class Model:
    """Weights of words and of stems (the first STEM code points of a word, marked by a star), sentence bias and leak."""

    def __init__(self, weights: dict[bytes, float], bias: float, leak: float):
        self.words = {w: x for w, x in weights.items() if not w.endswith(b"*")}
        self.stems = {w[:-1]: x for w, x in weights.items() if w.endswith(b"*")}
        self.bias, self.leak = bias, leak

    def logits(self, text: str | None) -> np.ndarray:
        get, stem_of = self.words.get, self.stems.get
        if (text or "").isascii():
            return np.array([sum([get(w, 0.0) for w in s]) + sum([stem_of(w[:STEM], 0.0) for w in s]) for s in sentences(text)], float) + self.bias
        return np.array([sum([get(w, 0.0) for w in s]) + sum([stem_of(w[:STEM] if w.isascii() else stem(w), 0.0) for w in s]) for s in sentences(text)], float) + self.bias

    def score(self, text: str | None) -> tuple[float, int, float, int]:
        """Document score, the sentence with the highest score (-1: none), its score, and how many offend."""
        z = self.logits(text)
        if not len(z):
            return self.leak, -1, 0.0, 0
        safe = -np.logaddexp(0, z)
        top = int(z.argmax())
        return float(-np.expm1(np.log1p(-self.leak) + safe.sum())), top, float(1 / (1 + np.exp(-z[top]))), int((z >= np.log(OFFENDING / (1 - OFFENDING))).sum())


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Maximum likelihood of the labels under the noisy-or, by Adam over all given documents."""
    y = np.array(labels, float)
    rate = float(y.mean()) if len(y) else 0.0
    if not len(y) or rate in (0.0, 1.0):
        return Model({}, -1e9, min(rate, 1 - 1e-9))
    features = lambda sentence: dict.fromkeys([*sentence, *(stem(w) + b"*" for w in sentence)])
    held = lambda text: {f for s in sentences(text) for f in features(s)}
    bad = Counter(f for text, toxic in zip(texts, y, strict=True) if toxic for f in held(text))
    bad = Counter({f: k for f, k in bad.items() if k >= LEAST_DOCUMENTS})
    seen = Counter(f for text in texts for f in held(text) if f in bad)
    excess = {f: (k - rate * seen[f]) / (seen[f] * rate * (1 - rate)) ** 0.5 for f, k in bad.items()}
    ranked = sorted((-e, f) for f, e in excess.items() if e >= EXCESS)
    ids = {w: i for i, (_, w) in enumerate(ranked)}
    word, at_sentence, at_document = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in sentences(text):
            known = [ids[f] for f in features(s) if f in ids]
            word.extend(known)
            at_sentence.extend([len(at_document)] * len(known))
            at_document.append(d)
    word, at_sentence, at_document = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (word, at_sentence, at_document))
    n_s, n_d, n_w = len(at_document), len(texts), max(1, len(ids))
    theta = np.zeros(n_w + 2)
    odds = lambda w: np.log((bad[w] + 0.5) / (seen[w] - bad[w] + 0.5)) - np.log(rate / (1 - rate))
    theta[: len(ids)] = prior = np.array([odds(w) for w in ids])
    prior = np.resize(prior, n_w) if len(prior) else np.zeros(n_w)
    theta[n_w], theta[n_w + 1] = np.log(rate / max(1.0, n_s / n_d)) - 1, np.log(0.02)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(at_sentence, theta[word], n_s) + theta[n_w]
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-theta[n_w + 1]))
        log_safe = np.minimum(np.bincount(at_document, -np.logaddexp(0, z), n_d) + np.log1p(-leak), -1e-9)
        # d loss / d log_safe: 1 for harmless documents below zero, minus the odds of safe for toxic ones
        pull = np.where(y > 0, np.exp(log_safe) / -np.expm1(log_safe), -1.0)
        g_z = -pull[at_document] * p
        g = np.concatenate([np.bincount(word, g_z[at_sentence], n_w), [g_z.sum(), (-pull * leak).sum()]]) / n_d
        g[:n_w] += L2 * (theta[:n_w] - prior)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({w: float(theta[i]) for w, i in ids.items()}, float(theta[n_w]), float(1 / (1 + np.exp(-theta[n_w + 1]))))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text and toxic of labelled documents outside the held-out fold: at most ``sample`` rows of ``sample_bytes`` bytes together."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_of_id(F.col("doc_id")) % folds != 0)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    order = ["spot", "doc_id", "key"]
    # ids and sizes of the first rows, so that no text is sorted; the running sum goes over those few
    first = keyed.select("doc_id", "key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.xxhash64("doc_id").alias("spot")).join(marked, "doc_id")
    first = first.groupBy("doc_id", "key", "toxic", "spot").agg(F.max("bytes").alias("bytes")).orderBy(*order).limit(sample)
    first = first.select("doc_id", "key", "toxic", F.sum("bytes").over(Window.orderBy(*order)).alias("bytes")).where(F.col("bytes") <= sample_bytes).drop("bytes")
    return keyed.join(F.broadcast(first), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).drop("key")  # ``sample`` rows of three numbers


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and where it offends.

    n_offending counts offending sentences; sentence_start and sentence_end (code points) delimit the worst one, sentence_score is its own score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = training_rows(docs, labels, folds, sample, sample_bytes).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    model = spark.sparkContext.broadcast(fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows]))

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        for batch in texts:
            out = []
            for text in batch:
                p, top, own, n = m.score(text)
                start, end = spans(text)[top] if n else (None, None)
                out.append((p, n, start, end, own))
            yield pd.DataFrame(out, columns=["score", "n", "start", "stop", "own"]).astype({"start": "Int32", "stop": "Int32"})

    found = docs.select("doc_id", F.pandas_udf(scores, "score double, n long, start int, stop int, own double")("text").alias("f"))
    return found.select(
        "doc_id", (crc_of_id(F.col("doc_id")) % folds == 0).alias("held_out"), F.col("f.score").alias("score"), F.when(F.col("f.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.col("f.n").alias("n_offending"), F.col("f.start").alias("sentence_start"), F.col("f.stop").alias("sentence_end"), F.col("f.own").alias("sentence_score"),
    )
