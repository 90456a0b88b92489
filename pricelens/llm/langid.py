"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from every row that may be learnt from. The model is fitted on a bounded, stratified sample of those
rows (``SAMPLE`` in all): follow-the-regularised-leader with elastic-net penalties, then one temperature fitted on the part of
the sample that was left out. Scoring reads whole texts, where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns, text_of

#: Rows the classifier is fitted on, and buckets of n-grams.
SAMPLE = 3000
BITS = 15
FOLDS, HELD = 3, 1
#: Languages up to which their counts are sent to every task; beyond that they are joined by shuffle.
MANY = 10_000
UNKNOWN = "und"

_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the 1- to 3-grams of the lower-case letters of ``text``, other characters read as one space; None without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    kept = letter | np.roll(letter, 1)  # letters, and of other characters the first after a letter
    kept[0] = True
    c = np.where(letter, codes, np.uint32(32))[kept]
    one = c * _ODD[0]
    two = (one[:-1] ^ (c[1:] * _ODD[1])) * _ODD[2]
    three = (two[:-1] ^ (c[2:] * _ODD[0])) * _ODD[1]
    counts = np.bincount(np.concatenate((one * _ODD[1], two, three)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(np.sqrt(x @ x), 1e-9)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return tf_idf(counts, self.idf[at]) @ self.weights[at] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest label and its probability; ``und`` and 0 for a text without letters or a model without labels."""
        grams = ngram_counts(text) if self.labels else None
        if grams is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*grams) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, seed: int = 7) -> Model:
    """Follow the regularised leader over (label, buckets, counts); every fifth row calibrates the temperature instead."""
    labels = sorted({label for label, _, _ in rows})
    number = {label: k for k, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    taught, kept = ([rows[i] for k, i in enumerate(order) if (k % 5 == 4) == late] for late in (False, True))
    shape = (len(idf) + 1, len(labels))  # the last row is the bias
    z, n = np.zeros(shape), np.zeros(shape)

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(taught)):
            label, at, counts = taught[i]
            x, at = np.append(tf_idf(counts, idf[at]), 1.0), np.append(at, len(idf))
            w = weights(at)
            error = softmax(x @ w)
            error[number[label]] -= 1
            g = x[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = weights(slice(None))
    model = Model(labels, idf.astype(np.float32), w[:-1].astype(np.float32), w[-1].astype(np.float32))
    if kept and len(labels) > 1:
        logits = np.array([model.logits(at, counts) for _, at, counts in kept])
        truth = np.array([number[label] for label, _, _ in kept])
        # One more row of each kind than was seen, so that a sample without errors isn't taken for certainty.
        right = np.full((len(truth), len(labels)), 1 / (len(truth) + 2) / (len(labels) - 1))
        right[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
        loss = lambda t: -(right * np.log(np.maximum(softmax(logits / t), 1e-12))).sum(-1).mean()
        model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
    return model


def _document_frequencies(batches):
    seen, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            rows += 1
            if (grams := ngram_counts(text)) is not None:
                seen[grams[0]] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], rows), pa.int64())], names=["bucket", "n"])


def _features(batches):
    for batch in batches:
        found = [(label, grams) for label, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if (grams := ngram_counts(text)) is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1][0] for x in found], pa.list_(pa.int32())), pa.array([x[1][1] for x in found], pa.list_(pa.float32()))],
            names=["lang", "at", "counts"],
        )


def train(df: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``df`` (doc_id, text, lang) with a language, all of which count for the document frequencies."""
    rows = df.where(F.col("lang").isNotNull()).select("doc_id", text_of().alias("text"), "lang")
    df_rows = rows.select("text").mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row for each bucket
    total = next((r["n"] for r in df_rows if r["bucket"] == -1), 0)
    seen = np.zeros(1 << BITS)
    for r in df_rows:
        if r["bucket"] >= 0:
            seen[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + seen)) + 1
    # Each language gives an equal share of the sample, or all it has: a row is drawn when its hash is low enough. Copies share
    # a hash, so the bound is also set as a limit.
    numbers = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = numbers.count()
    share = sample / max(languages, 1)
    drawn = (
        rows.join(F.broadcast(numbers) if languages <= MANY else numbers, "lang")
        .withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
        .where(F.col("draw") < F.lit(share * (1 << 30)) / F.col("n"))
        .orderBy("draw", "doc_id")
        .limit(2 * sample)
    )
    found = drawn.select("lang", "text").mapInArrow(_features, "lang string, at array<int>, counts array<float>").toPandas()
    return fit([(r.lang, np.asarray(r.at, np.int32), np.asarray(r.counts, np.float32)) for r in found.itertuples()], idf)


def _scores(model):
    def run(batches):
        fitted = model.value
        for batch in batches:
            best = [fitted.predict(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def identify(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from rows with a language outside the held-out fold; predicts from the text alone. A null text, or one without
    letters, is ``und`` with score 0, and so is everything if nothing could be learnt from. A null id is not held out.
    Every row has a prediction of its own, also one that repeats an id; texts of any length are read whole, and of languages with the same
    score the first by name is taken. An empty table gives an empty result.
    """
    model = train(df.where(F.coalesce(learns("doc_id", FOLDS, HELD), F.lit(False))), sample)
    held = ~F.coalesce(learns("doc_id", FOLDS, HELD), F.lit(True))
    fitted = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the number of documents
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_of().alias("text")).mapInArrow(
        _scores(fitted), "doc_id long, held_out boolean, lang_pred string, score double"
    )
