"""Ranked lexical search of all documents for a set of items, by a tree over the items and trees over batches of documents.

A document's score for an item is a sum over the item's terms of a weight, which falls with the number of documents that hold the term,
times an impact, which grows with the term's occurrences and falls with the document's length. A node of a document tree holds, for each
term, the largest impact that any of its documents has, and a node of the item tree the largest product of weight and occurrences that
any of its items has. The sum of the products of both is a bound that no pair of the two nodes exceeds. It is compared with the
weakest k-th best score that an item of the node has so far: what is below is pruned, whole batches of documents and items at once,
and nothing is lost. Pairs of leaves that remain are scored exactly.

Documents are read twice: once to count, which leaves of each document its length and the occurrences of the items' terms, and once
in that form. They are never shuffled; each task streams through its part, a batch and its tree at a time, and keeps the best ``k`` of each
item, which meet at the end. Documents of a batch are ordered by their weightiest term, and items by their commonest ones, so that nodes
hold what is alike. Items are asked in blocks of ``BLOCK``, each a pass over the counted documents; a block's terms go to all tasks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Items of a block and bytes of their texts, at most; documents of a batch's tree; leaves of both trees.
BLOCK, BLOCK_BYTES, BATCH, DOC_LEAF, ITEM_LEAF = 4096, 64 << 20, 2048, 16, 8
#: Fixed values of the score: its scale, that of weights, and the share of the length in the normalisation.
SCALE, WEIGHT, LENGTH = 1_000_000_000, 1000, 75

#: ASCII letters in lower case and digits stay, other ASCII separates; all bytes of other characters belong to terms.
_TERMS = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of ASCII letters, digits and characters beyond ASCII, with only A to Z in lower case."""
    return text.translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The impact of terms by their occurrences and their document's number of terms; all in 64-bit integers."""
    m = 100 - LENGTH + (LENGTH * length * documents) // total
    return (SCALE * tf) // (1000 * tf + 8 * m)


def _counted(numbers):
    """Of each document with terms its id, its number of terms, and the numbers of the items' terms that it holds with their occurrences."""

    def run(batches):
        number = numbers.value.get
        for batch in batches:
            ids, lengths, terms, counts, bounds = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = terms_of(text or b"")
                if not words:
                    continue
                ids.append(doc_id)
                lengths.append(len(words))
                held = np.fromiter((x for x in map(number, words) if x is not None), np.int32)
                found, tf = np.unique(held, return_counts=True)
                terms.append(found)
                counts.append(tf)
                bounds.append(bounds[-1] + len(found))
            flat = lambda xs, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(xs) if xs else [], kind))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), flat(terms, pa.int32()), flat(counts, pa.int64())], names=["doc_id", "length", "terms", "counts"])

    return run


@dataclass
class Rows:
    """Sparse rows: row i has the columns ``at[start[i]:start[i + 1]]``, each once, with their values."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        empty = np.zeros(0, np.int64)
        return cls(np.cumsum([0, *(len(a) for a, _ in rows)]), np.concatenate([empty, *(a for a, _ in rows)]), np.concatenate([empty, *(v for _, v in rows)]))

    def __len__(self) -> int:
        return len(self.start) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.start[i], self.start[i + 1])
        return self.at[s], self.value[s]

    def maxima(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The columns of the rows from ``low`` to ``high`` and the largest value in each."""
        s = slice(self.start[low], self.start[high])
        order = np.argsort(self.at[s], kind="stable")
        at, value = self.at[s][order], self.value[s][order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        return at[first], np.maximum.reduceat(value, first) if len(at) else value

    def dot(self, which: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The product of each of the rows ``which`` with a dense vector."""
        sizes = self.start[which + 1] - self.start[which]
        ends = np.cumsum(sizes)
        flat = np.repeat(self.start[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate(([0], np.cumsum(self.value[flat] * dense[self.at[flat]])))
        return sums[ends] - sums[ends - sizes]


class Tree:
    """A hierarchy over neighbouring rows: each node covers [low, high) and holds the maxima of its rows' columns; halves are its children."""

    def __init__(self, rows: Rows, leaf: int):
        self.rows, self.low, self.high, self.left, self.right, maxima = rows, [], [], [], [], []

        def grow(low: int, high: int) -> int:
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.left.append(-1)
            self.right.append(-1)
            maxima.append(rows.maxima(low, high))
            if high - low > leaf:
                self.left[node] = grow(low, (low + high) // 2)
                self.right[node] = grow((low + high) // 2, high)
            return node

        if len(rows):
            grow(0, len(rows))
        self.low, self.high, self.left, self.right = (np.array(x, np.int64) for x in (self.low, self.high, self.left, self.right))
        self.maxima = Rows.of(maxima)


class Items:
    """The items of a block, in the order of their tree: ids, and of each term its weight times its occurrences."""

    def __init__(self, ids: list[int], rows: list[tuple[np.ndarray, np.ndarray]], terms: int, frequency: np.ndarray):
        # Items that share their commonest terms lie together.
        order = sorted(range(len(ids)), key=lambda i: (sorted(rows[i][0].tolist(), key=lambda t: (-frequency[t], t))[:6], ids[i]))
        self.ids, self.terms = [ids[i] for i in order], terms
        self.tree = Tree(Rows.of([rows[i] for i in order]), ITEM_LEAF)


class Search:
    """The best ``k`` documents of each item so far."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in items.ids]  # heaps of (score, -doc_id)
        self.least = np.ones(len(items.ids), np.int64)  # what a document must have at least
        self.weakest = np.ones(len(items.tree.low), np.int64)
        self.dense = np.zeros(items.terms, np.int64)
        self.pairs = self.scored = 0

    def add(self, ids: np.ndarray, rows: Rows) -> None:
        """Search a batch of documents, whose rows are impacts by term."""
        self.ids, self.docs = ids, Tree(rows, DOC_LEAF)
        if len(ids) and len(self.items.ids):
            self._visit(0, np.zeros(1, np.int64))

    def _alive(self, nodes: np.ndarray) -> np.ndarray:
        """Those of the item nodes ``nodes`` that the document node in ``dense`` may have something for."""
        self.pairs += len(nodes)
        return nodes[self.items.tree.maxima.dot(nodes, self.dense) >= self.weakest[nodes]]

    def _visit(self, node: int, nodes: np.ndarray) -> None:
        docs, tree = self.docs, self.items.tree
        at, value = docs.maxima.row(node)
        self.dense[at] = value
        nodes = self._alive(nodes)
        leaf = docs.left[node] < 0
        # Both sides are descended: a level of the item tree for each of the documents', all that is left at a leaf.
        done = nodes[tree.left[nodes] < 0]
        inner = nodes[tree.left[nodes] >= 0]
        while len(inner):
            lower = self._alive(np.concatenate((tree.left[inner], tree.right[inner])))
            done = np.concatenate((done, lower[tree.left[lower] < 0]))
            inner = lower[tree.left[lower] >= 0]
            if not leaf:
                break
        self.dense[at] = 0
        nodes = np.concatenate((done, inner))
        if not len(nodes):
            return
        if leaf:
            self._score(node, done)
        else:
            self._visit(docs.left[node], nodes)
            self._visit(docs.right[node], nodes)

    def _score(self, node: int, nodes: np.ndarray) -> None:
        tree = self.items.tree
        which = np.concatenate([np.arange(tree.low[n], tree.high[n]) for n in nodes])
        for doc in range(self.docs.low[node], self.docs.high[node]):
            at, value = self.docs.rows.row(doc)
            self.dense[at] = value
            scores = tree.rows.dot(which, self.dense)
            self.dense[at] = 0
            self.scored += len(which)
            for i in np.flatnonzero(scores >= self.least[which]):
                self._keep(int(which[i]), int(scores[i]), int(self.ids[doc]))
        # The weakest of a node is the weakest of its items.
        self.weakest = np.minimum.reduceat(self.least, tree.low) if len(tree.low) == 1 else np.array([self.least[a:b].min() for a, b in zip(tree.low, tree.high)])

    def _keep(self, item: int, score: int, doc_id: int) -> None:
        heap = self.best[item]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -doc_id))
        else:
            heapq.heappushpop(heap, (score, -doc_id))
        if len(heap) == self.k:
            self.least[item] = max(1, heap[0][0])

    def found(self) -> list[tuple[int, int, int]]:
        return [(item, -doc, score) for item, heap in zip(self.items.ids, self.best) for score, doc in heap]


def _searched(items, k: int, documents: int, total: int):
    def run(batches):
        search, weights = Search(items.value[0], k), items.value[1]
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                ids, lengths = np.asarray(part.column("doc_id")), np.asarray(part.column("length"))
                terms, counts = np.asarray(part.column("terms").flatten()), np.asarray(part.column("counts").flatten())
                sizes = np.asarray(part.column("terms").value_lengths())
                start = np.concatenate(([0], np.cumsum(sizes)))
                value = impact(counts, np.repeat(lengths, sizes), documents, total)
                # Documents in the order of their weightiest term; those without any go first.
                heaviest = np.array([terms[a:b][weights[terms[a:b]].argmax()] if b > a else -1 for a, b in zip(start, start[1:])], np.int64)
                order = np.argsort(heaviest, kind="stable")
                search.add(ids[order], Rows.of([(terms[start[i] : start[i + 1]].astype(np.int64), value[start[i] : start[i + 1]]) for i in order]))
        rows = search.found()
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return run


def blocks(items: DataFrame) -> list[DataFrame]:
    """The items dealt to as many blocks as their number and texts need, by hash."""
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(-(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // BLOCK_BYTES), 1)
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def search(documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of the highest score above 0 for each item, ties to the smaller id.

    Every row of ``documents`` counts, also one that repeats an id, which may be found as often; a null text has no terms, and a row
    with a null id counts in the statistics but is never found. Items that repeat an id are asked once, by the smallest text; an
    item with a null id, or without terms, finds nothing, and so do empty tables. Texts of any length are read whole.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = scratch.put(items.where(F.col(f"`{item_id}`").isNotNull()).groupBy(F.col(f"`{item_id}`").cast("long").alias("item_id")).agg(F.min(f"`{text}`").alias("text")))
    found = None
    for block in blocks(asked):
        texts = {r["item_id"]: terms_of((r["text"] or "").encode()) for r in block.collect()}  # ``BLOCK`` items at most
        vocabulary = sorted({t for terms in texts.values() for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        counted = scratch.put(docs.mapInArrow(_counted(spark.sparkContext.broadcast(number)), "doc_id long, length long, terms array<int>, counts array<long>"))
        size = counted.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
        held = {r["term"]: r["n"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # of the block's terms
        frequency = np.array([held.get(i, 0) for i in range(len(vocabulary))], np.int64)
        weights = np.array([weight(size["n"], int(f)) for f in frequency], np.int64)

        def row(terms: list[bytes], number=number, weights=weights) -> tuple[np.ndarray, np.ndarray]:
            at, n = np.unique(np.array([number[t] for t in terms], np.int64), return_counts=True)
            return at, weights[at] * n

        known = [i for i, terms in texts.items() if terms]
        tree = spark.sparkContext.broadcast((Items(known, [row(texts[i]) for i in known], len(vocabulary), frequency), weights))
        there = counted.where("doc_id is not null").mapInArrow(_searched(tree, k, size["n"], size["total"] or 1), "item_id long, doc_id long, score long")
        best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
        ranked = scratch.put(there.withColumn("rank", best).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        scratch.drop(counted)
        found = ranked if found is None else found.unionByName(ranked)
    return found
