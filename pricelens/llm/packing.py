"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokenising happens once, where the texts lie; only lengths and a checksum leave it. Lengths are whole numbers up to the capacity,
so best-fit decreasing over any number of documents is decided by the histogram of piece lengths: a segment tree over remaining
capacities finds the tightest open bin for each run of equal pieces. The resulting plan says, for each length, which ranks among
the pieces of that length go to which bins and at which offset. Its size depends on the capacity only. Ranks come from counts
per partition, so no task sees all pieces of a length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k"
END_ID = 2
#: Words kept with their ids by each Python worker.
CACHED_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nr long"

_PIECES = pa.schema(list(zip(PIECES.replace(" long", "").replace(" int", "").split(", "), (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))))
_SPECIAL, _SPECIAL_ID = "<|endoftext|>", 50256
#: A space before something that is no white space always begins a token of the byte-level vocabulary.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ODD_SPACE = re.compile(f" (?:[{_WHITE}]|$)")
_BEFORE_WORD = re.compile(f"(?= [^{_WHITE}])")


class _Words(dict):
    """Ids, as little-endian 32-bit bytes, of texts that begin with ``lead``."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.encode(self.lead + word)
        if len(word) < 64:
            self[word] = ids
        return ids


class ByteBPE:
    """Ids of a byte-level BPE vocabulary, a word at a time; equal to what the ``tokenizers`` library gives for the whole text."""

    _made: dict[str, ByteBPE] = {}

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = lambda text: bpe.encode_to_numpy(text).astype("<u4").tobytes() if text else b""
        self.first, self.spaced = _Words(encode, ""), _Words(encode, " ")

    @classmethod
    def of(cls, vocabulary: str) -> ByteBPE:
        if vocabulary not in cls._made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of ``text``; the special token's name counts as that token."""
        special = _SPECIAL_ID.to_bytes(4, "little")
        return special.join(self._plain(x) for x in text.split(_SPECIAL)) if _SPECIAL in text else self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return b"".join(map(self.first.__getitem__, _BEFORE_WORD.split(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))


def _cut_points(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: only the first may be shorter than the capacity."""
    first = tokens % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, tokens, capacity))]


def _pieces(capacity: int, vocabulary: str):
    def run(batches):
        from pyspark import TaskContext

        bpe, part, end = ByteBPE.of(vocabulary), TaskContext.get().partitionId(), END_ID.to_bytes(4, "little")
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = bpe.ids(text) + end
                for piece, (start, length) in enumerate(_cut_points(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_PIECES), _PIECES)], schema=_PIECES)

    return run


def tokenised_pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its rank among pieces of its length within its partition."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_pieces(capacity, vocabulary), PIECES)


class CapacityTree:
    """Segment tree over remaining capacities: which of them have open bins, and the smallest that holds a given length."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, left: int, runs: int) -> None:
        at = left + self.size
        while at:
            self.open[at] += runs
            at //= 2

    def tightest(self, length: int) -> int | None:
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                return self._down(at + 1)
            at //= 2
        return None

    def _down(self, at: int) -> int:
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing for ``counts`` pieces of each length: (length, first rank, bin, pieces per bin, offset) and the number of bins.

    A row says that pieces of that length from that rank on, up to the next row of that length, go to bins numbered from ``bin``
    on, so many to each, the first of them at ``offset``. A piece goes to the bin with the least room that holds it; having taken
    one, that bin is the tightest for the next equal piece, so a bin is filled before the next is looked for.
    """
    tree, runs, plan, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-rest // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(n, rest // each)
            used = full + (full < n and rest % each > 0 and rest < n * each)
            plan.append((length, rank, first, each, capacity - room))
            placed = min(rest, n * each)
            for left, begin, k in ((room - each * length, first, full), (room - (placed - full * each) * length, first + full, used - full), (room, first + used, n - used)):
                if k and left:
                    runs.setdefault(left, []).append((begin, k))
                    tree.add(left, 1)
            rank, rest = rank + placed, rest - placed
    return plan, bins


def _placed(plan: list[tuple[int, int, int, int, int]]):
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *rest in plan:
        by.setdefault(length, []).append(tuple(rest))
    starts = {length: [x[0] for x in rows] for length, rows in by.items()}

    def run(batches):
        for batch in batches:
            length, nr, before = (batch.column(c).to_pylist() for c in ("length", "nr", "before"))
            bins, offsets = [], []
            for size, rank in zip(length, map(int.__add__, nr, before)):
                first, begin, each, offset = by[size][bisect_right(starts[size], rank) - 1]
                bins.append(begin + (rank - first) // each)
                offsets.append(offset + (rank - first) % each * size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Every row of ``df`` is packed, rows that repeat an id too; an empty table gives an
    empty result. Sequences hold at most ``capacity`` tokens and are filled from 0 without gaps.
    """
    pieces = cut(tokenised_pieces(df, capacity, vocabulary))
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = each.select("length", "part", before.alias("before"))
    # At most ``capacity`` rows, whatever the number of documents.
    plan, _ = best_fit_plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    ranked = pieces.join(offsets, ["length", "part"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return (
        ranked.select(*columns[:5], "nr", "before")
        .mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
        .select(*columns)
    )
