"""SentencePiece encoding and decoding by streaming Viterbi.

The given model merges by byte-pair rank, so the best path is the one whose every pair of neighbouring pieces is what merging
those two alone would give; exactly one such path ends at each position, and it is the model's own encoding of that prefix. The
search keeps, for each of the last positions up to the longest piece, the piece that ends there. Whenever the paths back from all
of them meet at one boundary, the ids before it are final: they are handed out and forgotten. So a text of any length needs a
window of bounded size. Words that recur are kept with their ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words of one generation (two are kept) and pairs of pieces that a Python worker keeps; positions between two looks for a common boundary.
CACHED, PAIRS, LOOK = 500_000, 1_000_000, 64

_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_UNKNOWN = -2
_NEVER = float("-inf")


class Pieces:
    """The pieces of a model, and which pairs of them may stand next to each other."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file, num_threads=1)
        ids = range(model.vocab_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.byte_id, self.byte_of = {}, {}
        for i in ids:
            if model.is_byte(i):
                value = int(self.text[i][3:5], 16)
                self.byte_id[value], self.byte_of[i] = i, value
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        # A piece that merging does not reach from its own characters is in no encoding.
        self.id = {self.text[i]: i for i in plain}
        self.id = {t: i for t, i in self.id.items() if len(t) == 1 or self.merged(t) == [t]}
        self.longest = max(map(len, self.id))
        # A trie: for each character the piece that ends with it, if any, and the characters that go on from there.
        self.trie: dict[str, list] = {}
        for t, i in self.id.items():
            level, node = self.trie, None
            for c in t:
                node = level.setdefault(c, [None, {}])
                level = node[1]
            node[0] = i
        self.control = {i for i in ids if model.is_control(i)}
        #: For a piece on the left, whether it may be followed by those on the right met so far; and how many pairs are kept.
        self._fits: dict[int, dict[int, bool]] = {}
        self._pairs = 0

    @classmethod
    @lru_cache(maxsize=4)
    def of(cls, model_file: str) -> Pieces:
        return cls(model_file)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the neighbours whose join has the highest score, leftmost first, until none has one."""
        parts, score = list(text), self.score.get
        joins = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while joins and (best := max(joins)) > _NEVER:
            at = joins.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
            if at < len(joins):
                joins[at] = score(parts[at] + parts[at + 1], _NEVER)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the piece ``right`` may follow ``left``; characters without a piece fit everywhere."""
        if left < 0 or right < 0:
            return True
        known = self._fits.get(left, {}).get(right)
        if known is None:
            a, b = self.text[left], self.text[right]
            known = self.merged(a + b) == [a, b]
            if self._pairs >= PAIRS:
                self._fits.clear()
                self._pairs = 0
            self._fits.setdefault(left, {})[right] = known
            self._pairs += 1
        return known

    def segments(self, chars: Iterator[str] | str) -> Iterator[int]:
        """Ids of a stream of characters, each given out as soon as no later character can change it."""
        window, begin = "", 0  # characters from the last committed boundary on
        ends: list[tuple[int, int]] = [(_UNKNOWN, 0)]  # for each position of the window: the piece ending there, and its length
        get, fits, longest = self.id.get, self.fits, self.longest
        for c in chars:
            window += c
            i = len(window)
            for size in range(min(longest, i), 0, -1):
                piece = get(window[i - size :])
                if piece is None:
                    if size > 1:
                        continue
                    piece = _UNKNOWN
                left = ends[i - size]
                if left is not None and (i == size and not begin or fits(left[0], piece)):
                    ends.append((piece, size))
                    break
            else:
                ends.append(None)
            if i >= LOOK + longest and i % LOOK == 0:
                alive = {j for j in range(i - longest + 1, i + 1) if ends[j] is not None}
                while len(alive) > 1:
                    far = max(alive)
                    alive.remove(far)
                    alive.add(far - ends[far][1])
                if (cut := alive.pop()) > 0:
                    yield from self._back(window, ends, cut)
                    window, ends, begin = window[cut:], [ends[cut], *ends[cut + 1 :]], begin + cut
        yield from self._back(window, ends, len(window))

    def word(self, text: str) -> list[int]:
        """Ids of a short text: the same search, in one window. From each boundary the trie is walked until no piece goes on."""
        whole = self.id.get(text)
        if whole is not None:
            return [whole]
        n, trie, fits = len(text), self.trie, self.fits
        last: list[int | None] = [None] * (n + 1)
        sizes = [0] * (n + 1)
        last[0] = _UNKNOWN
        for begin in range(n):
            left = last[begin]
            if left is None:
                continue
            free = not begin or left < 0
            known = None if free else self._fits.get(left)
            level, i = trie, begin
            while i < n:
                step = level.get(text[i])
                i += 1
                if step is None:
                    if i == begin + 1 and last[i] is None:
                        last[i], sizes[i] = _UNKNOWN, 1
                    break
                piece, level = step
                if piece is None:
                    if i > begin + 1:
                        continue
                    piece = _UNKNOWN
                if last[i] is None:
                    ok = True if free or piece < 0 else known.get(piece) if known is not None else None
                    if ok or (ok is None and fits(left, piece)):
                        last[i], sizes[i] = piece, i - begin
        return self._back(text, list(zip(last, sizes)), n)

    def _back(self, window: str, ends: list, at: int) -> list[int]:
        found = []
        while at:
            piece, size = ends[at]
            found.append([piece] if piece >= 0 else [self.byte_id[b] for b in window[at - 1].encode("utf-8", "surrogatepass")])
            at -= size
        return [i for ids in reversed(found) for i in ids]


class _Words(dict):
    """Little-endian 32-bit ids of words that follow a space, or with ``lead=""`` of those that follow a line's end."""

    def __init__(self, pieces: Pieces, lead: str = SPACE):
        super().__init__()
        self.pieces, self.lead = pieces, lead
        self.before: dict[str, bytes] = {}
        self.lines = _Words(pieces, "") if lead else self
        # No piece holds a line's end, so what stands on either side of one is read alone.
        self.end = None if any("\n" in t for t in pieces.id) else struct.pack("<I", pieces.byte_id[10]) if 10 in pieces.byte_id else None

    def __missing__(self, word: str) -> bytes:
        if self.end and "\n" in word:
            head, *rest = word.split("\n")
            return self[head] + b"".join(self.end + self.lines[x] for x in rest)
        if not word and not self.lead:
            return b""
        if len(word) >= 48:
            return np.fromiter(self.pieces.segments(self.lead + word), "<u4").tobytes()
        if len(self) >= CACHED:  # words that come again are taken over from the generation before
            self.before = dict(self)
            self.clear()
        packed = self.before.get(word)
        if packed is None:
            ids = self.pieces.word(self.lead + word)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = packed
        return packed


class Codec:
    def __init__(self, model_file: str):
        self.pieces = Pieces.of(model_file)
        self.words = _Words(self.pieces)
        self.said = [t.replace(SPACE, " ") for t in self.pieces.text]
        self.special = frozenset(self.pieces.byte_of) | self.pieces.control

    @classmethod
    @lru_cache(maxsize=4)
    def of(cls, model_file: str) -> Codec:
        return cls(model_file)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, equal to the library's: a space is put before the text, and none is removed."""
        if not text:
            return b""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            # Runs of spaces, each with the word behind it; what follows one space is kept with the other words.
            runs, words, others = _RUNS.findall(SPACE + text.replace(" ", SPACE)), self.words, self.words.lines
            return b"".join(words[x[1:]] if x[0] == SPACE and x[1:2] != SPACE and len(x) > 1 else others[x] for x in runs)
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> str:
        """The text of some ids: bytes in a row are read as UTF-8, control ids as nothing, and the space put before the text goes."""
        listed = np.frombuffer(ids, "<u4").tolist()
        if self.special.isdisjoint(listed):
            out = "".join(map(self.said.__getitem__, listed))
        else:
            parts, run = [], bytearray()
            byte_of, said, control = self.pieces.byte_of, self.said, self.pieces.control
            for i in listed:
                if (b := byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                if i not in control:
                    parts.append(said[i])
            parts.append(run.decode("utf-8", "replace"))
            out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


def _path(model: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(model)


def _encoded(model: str, text: str):
    def run(batches):
        codec = Codec.of(_path(model))
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(text).to_pylist()]
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*_others(batch, text), lists], names=[*(n for n in batch.schema.names if n != text), "ids"])

    return run


def _decoded(model: str, ids: str):
    def run(batches):
        codec = Codec.of(_path(model))
        for batch in batches:
            texts = [None if x is None else codec.decode(np.asarray(x, "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*_others(batch, ids), pa.array(texts, pa.string())], names=[*(n for n in batch.schema.names if n != ids), "text"])

    return run


def _others(batch: pa.RecordBatch, out: str) -> list[pa.Array]:
    return [c for n, c in zip(batch.schema.names, batch.columns) if n != out]


def _swap(df: DataFrame, given: str, made: str, kind: str, function) -> DataFrame:
    """``df`` with ``made`` for ``given``; a column of that name already there is replaced. The function sees names that nothing else has."""
    df = df.drop(*({made} - {given}))
    (own,) = unused(df.drop(given), "made")
    rest = [f for f in df.schema.fields if f.name != given]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{own}` {kind}"])
    return df.mapInArrow(_named(function, own), schema).withColumnRenamed(own, made)


def _named(function, own: str):
    def run(batches):
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[*batch.schema.names[:-1], own])

    return run


def encode(df: DataFrame, model: str = MODEL) -> DataFrame:
    """``df`` with ``ids array<int>`` for its ``text``. A null text counts as empty, and an empty one has no ids.

    Other columns and all rows stay; a column ``ids`` that is there already is replaced. An empty table gives an empty result.
    """
    return _swap(df, "text", "ids", "array<int>", _encoded(model, "text"))


def decode(df: DataFrame, model: str = MODEL) -> DataFrame:
    """``df`` with ``text`` for its ``ids``; null ids give null. Other columns and all rows stay; a column ``text`` that is there already is replaced."""
    return _swap(df, "ids", "text", "string", _decoded(model, "ids"))


def _reported(model: str):
    def run(batches):
        codec = Codec.of(_path(model))
        for batch in batches:
            n, crc, back = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                back.append(codec.decode(ids) == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return run


def encoding_report(df: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (decoding gives the text back).

    Null texts count as empty. The character that stands for a space in pieces decodes to a space, in texts that have it too.
    Every row is kept, also one that repeats an id, and an empty table gives an empty result.
    """
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_reported(model), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
