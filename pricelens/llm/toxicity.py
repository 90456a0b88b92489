"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own vector, if training knew it, beside the sum of vectors of its hashed character 3- and 4-grams. Texts are
read as overlapping windows of ``WIDTH`` words, all of them; a text's score comes from its highest window, through a logistic
curve fitted on the training texts. Training sees a bounded sample of labelled texts, and all windows of each; since a label belongs
to a text, each epoch teaches the window that the network finds most toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns, text_of, unused

#: Labelled texts of each class the network is fitted on.
SAMPLE = 1200
WIDTH, STRIDE = 64, 32
FOLDS, HELD = 5, 0
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BITS = 8, 12, 16, 13
#: Words kept with their gate inputs by a Python worker, and windows run at a time.
CACHED_WORDS, BATCH = 150_000, 1024

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-grams of each word between marks of its ends: all buckets in a row, and where each word's begin."""
    codes = np.frombuffer("".join(f"\x02{w}\x03\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    begin = np.concatenate(([0], np.cumsum(sizes + 3)[:-1]))
    # Positions 0..len of "\\2word\\3\\3" each begin a 3-gram or 4-gram; a word of n letters has n of each kind.
    inner = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    c = [np.concatenate((codes, codes[:3]))[inner + k] for k in range(4)]
    three = (c[0] * np.uint32(0x9E3779B1) ^ c[1]) * np.uint32(0x85EBCA6B) ^ c[2]
    four = (three * np.uint32(0xC2B2AE35) ^ c[3]) * np.uint32(0x27D4EB2F)
    both = np.stack((three * np.uint32(0x165667B1), four), 1).ravel() >> np.uint32(32 - CHAR_BITS)
    return both.astype(np.int64), 2 * np.concatenate(([0], np.cumsum(sizes)[:-1]))


def windows_of(n: int) -> list[tuple[int, int]]:
    """Begin and end of every window over n words; the last one ends with the text."""
    if n <= WIDTH:
        return [(0, n)]
    return [*((at, at + WIDTH) for at in range(0, n - WIDTH, STRIDE)), (n - WIDTH, n)]


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """Weights. Axis 0 of the recurrent ones is the direction; gates are update, reset, candidate."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.0

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = 3) -> Net:
        rng, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            vocabulary,
            {
                "words": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1),
                "chars": draw(1 << CHAR_BITS, CHAR_DIM, scale=0.1),
                "input": draw(2, d, 3 * h, scale=d**-0.5),
                "gates": np.zeros((2, 3 * h), np.float32),
                "state": draw(2, h, 3 * h, scale=h**-0.5),
                "attend": draw(2, h, scale=0.3),
                "out": draw(2, h, scale=0.3),
                "bias": np.zeros(1, np.float32),
            },
        )

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """The input vector of each word, and what made it."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        grams, begin = char_grams(words)
        sizes = np.diff(np.append(begin, len(grams)))
        scale = (sizes**-0.5).astype(np.float32)[:, None]
        summed = np.add.reduceat(self.p["chars"][grams], begin, 0) * scale
        return np.concatenate((self.p["words"][ids], summed), 1), (ids, grams, sizes, scale)

    def gate_inputs(self, vectors: np.ndarray) -> np.ndarray:
        """direction x words x gates."""
        return vectors @ self.p["input"] + self.p["gates"][:, None]

    def run(self, gates: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Logits of windows. gates: direction x words x 3h, of which the last word is padding; ids: windows x positions."""
        h, (n, width) = HIDDEN, ids.shape
        state, states, kept = np.zeros((2, n, h), np.float32), np.empty((width, 2, n, h), np.float32), []
        at = np.stack((ids.T, ids.T[::-1]))  # direction x position x windows
        there = (np.arange(width)[:, None] < sizes).astype(np.float32)[:, :, None]
        mask, short = np.stack((there, there[::-1]), 1), (sizes < width).any()
        flat = gates.reshape(-1, 3 * h)
        at = at + np.array([0, gates.shape[1]])[:, None, None]
        weights = self.p["state"]
        for t in range(width):
            x, u = flat[at[:, t]], state @ weights
            zr = sigmoid(x[..., : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(x[..., 2 * h :] + r * u[..., 2 * h :])
            new = c + z * (state - c)
            if short:
                new *= mask[t]
            if keep:
                kept.append((state, u, z, r, c))
            state = states[t] = new
        seen = np.stack((states[:, 0], states[::-1, 1]), 1)  # position x direction x windows x h, both in reading order
        scores = np.einsum("tdnh,dh->tn", seen, self.p["attend"])
        scores[~(there[:, :, 0] > 0)] = -1e9
        e = np.exp(scores - scores.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tn,tdnh->dnh", alpha, seen)
        logits = np.einsum("dnh,dh->n", pooled, self.p["out"]) + self.p["bias"]
        return (logits, (seen, alpha, pooled, kept, mask, at)) if keep else logits

    def gradients(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, known: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of one batch. known: 0 for words that are to be read by their characters alone."""
        h, p = HIDDEN, self.p
        vectors, (wid, grams, gram_sizes, scale) = self.inputs(words)
        wid = wid * known
        vectors[:, :WORD_DIM] = p["words"][wid]
        vectors = np.concatenate((vectors, np.zeros((1, vectors.shape[1]), np.float32)))
        gates = self.gate_inputs(vectors)
        logits, (seen, alpha, pooled, kept, mask, at) = self.run(gates, ids, sizes, True)
        prob = sigmoid(logits)
        loss = -(weights * np.where(labels > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).mean()
        d_logit = (weights * (prob - labels) / len(labels)).astype(np.float32)
        g = {"out": np.einsum("n,dnh->dh", d_logit, pooled), "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[None, :, None] * p["out"][:, None]
        d_alpha = np.einsum("dnh,tdnh->tn", d_pooled, seen)
        d_scores = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["attend"] = np.einsum("tn,tdnh->dh", d_scores, seen)
        d_seen = alpha[:, None, :, None] * d_pooled + d_scores[:, None, :, None] * p["attend"][:, None]
        d_states = np.stack((d_seen[:, 0], d_seen[::-1, 1]), 1)
        g["state"], d_x = np.zeros_like(p["state"]), np.empty((len(kept), 2, len(labels), 3 * h), np.float32)
        back = np.zeros((2, len(labels), h), np.float32)
        turned = p["state"].transpose(0, 2, 1)
        for t in range(len(kept) - 1, -1, -1):
            state, u, z, r, c = kept[t]
            d = (back + d_states[t]) * mask[t]
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (state - c) * z * (1 - z)
            d_r = d_c * u[..., 2 * h :] * r * (1 - r)
            d_u = np.concatenate((d_z, d_r, d_c * r), -1)
            d_x[t] = np.concatenate((d_z, d_r, d_c), -1)
            g["state"] += state.transpose(0, 2, 1) @ d_u
            back = d * z + d_u @ turned
        by_word = np.zeros((2 * gates.shape[1], 3 * h), np.float32)
        np.add.at(by_word, at.transpose(1, 0, 2).reshape(-1), d_x.reshape(-1, 3 * h))
        by_word = by_word.reshape(2, -1, 3 * h)
        by_word[:, -1] = 0
        g["gates"] = by_word.sum(1)
        g["input"] = vectors.T @ by_word
        d_vectors = np.einsum("dwg,dvg->wv", by_word, p["input"])[:-1]
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], wid, d_vectors[:, :WORD_DIM])
        np.add.at(g["chars"], grams, np.repeat(d_vectors[:, WORD_DIM:] * scale, gram_sizes, 0))
        g["words"][0] = 0
        return float(loss), g


def _batch(windows: list[np.ndarray], names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of some windows, which hold numbers of ``names``: distinct words, windows x positions of their numbers among these (padding is one past the last), and sizes."""
    sizes = np.array([len(x) for x in windows])
    distinct, number = np.unique(np.concatenate(windows), return_inverse=True)
    ids = np.full((len(windows), sizes.max()), len(distinct), np.int64)
    ids[np.arange(ids.shape[1]) < sizes[:, None]] = number
    return [names[i] for i in distinct], ids, sizes


def window_logits(net: Net, windows: list[np.ndarray], names: list[str]) -> np.ndarray:
    out = []
    for i in range(0, len(windows), 256):
        words, ids, sizes = _batch(windows[i : i + 256], names)
        gates = net.gate_inputs(np.concatenate((net.inputs(words)[0], np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))))
        out.append(net.run(gates, ids, sizes))
    return np.concatenate(out) if out else np.zeros(0)


def fit(given: Iterable[tuple[int, str]], toxic_share: float | None = None, epochs: int = 9, rate: float = 0.01, seed: int = 5) -> Net:
    """Train on (label, text): Adam on the window of a text that scores highest, and others of clean texts.

    Every fourth text is left out and fits the final curve, by its highest window of all as in scoring, weighted so that
    ``toxic_share`` of them would be toxic.
    """
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    texts: list[tuple[int, list[np.ndarray]]] = []
    empty = []
    for label, text in given:
        words = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
        if len(words):
            texts.append((label, [words[a:b] for a, b in windows_of(len(words))]))
        else:
            empty.append(label)
    names = list(number)
    share = np.mean([label for label, _ in texts]) if texts else 0.0
    late = [x for i, x in enumerate(texts) if i % 4 == 3]
    if len({label for label, _ in late}) < 2:
        late = texts
    else:
        texts = [x for i, x in enumerate(texts) if i % 4 != 3]
    held = np.zeros(len(names), np.int64)
    for _, windows in texts:
        held[np.unique(np.concatenate(windows))] += 1
    net = Net.fresh({w: i + 1 for i, w in enumerate(sorted(w for w, n in zip(names, held) if n >= 3))})
    prior = (sum(empty) + share) / (len(empty) + 1)
    net.empty = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    if not 0 < share < 1:
        net.slope, net.shift = 0.0, 5.0 if share else -5.0
        return net
    flat = [(i, w) for i, (_, windows) in enumerate(texts) for w in windows]
    owner = np.array([i for i, _ in flat])
    labels = np.array([label for label, _ in texts], np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch < 1:
            chosen = rng.permutation(len(flat))[: 3 * len(texts)]
        else:
            logits = window_logits(net, [w for _, w in flat], names)
            order = np.lexsort((-logits, owner))
            first = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
            others = rng.permutation(len(flat))
            chosen = rng.permutation(np.concatenate((first, others[labels[owner[others]] == 0][: len(texts) // 2])))
        for at in range(0, len(chosen), 64):
            part = chosen[at : at + 64]
            words, ids, sizes = _batch([flat[i][1] for i in part], names)
            y = labels[owner[part]]
            weights = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            _, grads = net.gradients(words, ids, sizes, y, weights, (rng.random(len(words)) > 0.3).astype(np.int64))
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            norm = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
            for k, x in grads.items():
                x = x * min(1.0, 2.0 / (norm + 1e-9)) + 1e-5 * net.p[k]
                m, v = moments[k]
                m += 0.1 * (x - m)
                v += 0.001 * (x * x - v)
                net.p[k] -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    best = np.array([window_logits(net, windows, names).max() for _, windows in late]).clip(-20, 20)
    truth = np.array([label for label, _ in late], np.float64)
    share = toxic_share or truth.mean()
    weight = np.where(truth > 0, share / truth.mean(), (1 - share) / (1 - truth.mean()))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton's steps for a logistic curve over the highest windows, kept near slope 1
        q = sigmoid(a * best + b)
        w, e = weight * (q * (1 - q) + 1e-4), weight * (q - truth)
        grad = np.array([(e * best).mean() + 1e-3 * (a - 1), e.mean()])
        cross = (w * best).mean()
        a, b = np.array([a, b]) - 0.5 * np.linalg.solve([[(w * best * best).mean() + 1e-3, cross], [cross, w.mean() + 1e-6]], grad)
    net.slope, net.shift = float(max(a, 0.05)), float(b)
    return net


class Scorer:
    """Scores of texts, with the gate inputs of words kept between batches."""

    def __init__(self, net: Net):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.gates = np.zeros((2, 4096, 3 * HIDDEN), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word in the table of gate inputs; 0 is padding."""
        found = list(map(self.number.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(words, found) if i is None))
            begin = len(self.number) + 1
            self.number.update(zip(new, range(begin, begin + len(new))))
            if begin + len(new) > self.gates.shape[1]:
                more = np.zeros((2, max(begin + len(new), 2 * self.gates.shape[1]), 3 * HIDDEN), np.float32)
                more[:, :begin] = self.gates[:, :begin]
                self.gates = more
            self.gates[:, begin : begin + len(new)] = self.net.gate_inputs(self.net.inputs(new)[0])
            found = list(map(self.number.__getitem__, words))
        return np.array(found, np.int64)

    def _highest(self, ids: list[np.ndarray], best: np.ndarray, owner: list[int]) -> None:
        rows = np.zeros((len(ids), max(map(len, ids))), np.int64)
        for i, x in enumerate(ids):
            rows[i, : len(x)] = x
        logits = self.net.run(self.gates, rows, np.array([len(x) for x in ids]))
        np.maximum.at(best, owner, logits)

    def scores(self, texts: list[str]) -> np.ndarray:
        """From 0 to 1, for each text by its highest window; texts without words get what such texts had in training."""
        best = np.full(len(texts), -np.inf)
        ids, owner = [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            if len(self.number) + len(words) > CACHED_WORDS and self.number:
                if ids:
                    self._highest(ids, best, owner)
                    ids, owner = [], []
                self._forget()
            numbers = self._numbers(words)
            for a, b in windows_of(len(words)):
                ids.append(numbers[a:b])
                owner.append(i)
                if len(ids) >= BATCH:
                    self._highest(ids, best, owner)
                    ids, owner = [], []
        if ids:
            self._highest(ids, best, owner)
        some = np.isfinite(best)
        return np.where(some, sigmoid(self.net.slope * np.clip(np.where(some, best, 0), -20, 20) + self.net.shift), sigmoid(self.net.empty))


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """Fit on at most ``sample`` texts of each class, those of the lowest hash, among the labelled rows outside the held-out fold."""
    marked = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("__id").isNotNull())
    draw = F.xxhash64("doc_id", F.lit(17))

    def drawn(value: int) -> DataFrame:
        ids = marked.where((F.col("toxic") == value) & F.coalesce(learns("__id", FOLDS, HELD), F.lit(False))).select(F.col("__id").alias("doc_id"), "toxic").distinct()
        return ids.orderBy(draw, "doc_id").limit(sample)

    chosen = drawn(0).unionByName(drawn(1))
    # At most twice ``sample`` rows: their size is bounded, so they may be sent to every task.
    rows = df.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    counts = {r["toxic"]: r["n"] for r in marked.where(F.coalesce(learns("__id", FOLDS, HELD), F.lit(False))).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit(((r["toxic"], r["text"]) for r in rows.orderBy("doc_id", "toxic").select("toxic", "text").toLocalIterator()), share)


def _scored(model, columns: list[str], text: str, names: list[str]):
    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            score = scorer.scores([t or "" for t in batch.column(text).to_pylist()])
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[*columns, *names])

    return run


def score_texts(df: DataFrame, net: Net, columns: list[str], score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Those columns of ``df``, whose ``text`` is scored, with its score and prediction under names that are not among the columns."""
    fitted = df.sparkSession.sparkContext.broadcast(net)  # its vocabulary is that of the training sample
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), f"`{score}` double", f"`{predicted}` int"])
    return df.mapInArrow(_scored(fitted, columns, "text", [score, predicted]), schema)


def rate(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted.

    Labels are learnt outside the held-out fold only; the text alone is scored, all of it. A null text counts as empty. Without
    labels of both classes every score is near the class there is, or 0. A null id is not held out and teaches nothing.
    Every row is scored, also one that repeats an id, and equal texts score alike. An empty table gives an empty result.
    """
    net = train(df, labels, sample)
    held = ~F.coalesce(learns("doc_id", FOLDS, HELD), F.lit(True))
    return score_texts(df.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), net, ["doc_id", "held_out"])


def drop_toxic(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose score is under the threshold, with its own columns whatever their names; an empty table gives an empty result."""
    net = train(df, labels, sample)
    score, predicted = unused(df, "score", "predicted")
    return score_texts(df, net, df.columns, score, predicted).where(F.col(score) < threshold).select(*(f"`{c}`" for c in df.columns))
