"""Packing token sequences into fixed windows by best-fit decreasing.

Documents are tokenized once and cut: full windows first, the rest is one
shorter piece.  Best-fit decreasing looks at lengths only, so the plan is
made from the histogram of piece lengths (at most ``window`` counts, however
many documents): lengths go down, and a segment tree over remaining
capacities finds the tightest open window.  Runs of equal pieces that meet
equal windows are placed together, which gives the placement of the one-by-one
procedure.  Pieces then find their place by (length, rank among that length).

Null text counts as empty: it has the end id only.  Empty tables give empty
results; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartflow.llm.common import cut, groups_of, texts_of, worker_state
from cartflow.llm.tokens import byte_letters

WINDOW = 2048
END_ID = 1
#: Python's str.split() parts at these too, the vocabulary's white space does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Token ids of words, as little-endian unsigned 32-bit bytes; a word is encoded when it is first asked for.

    This vocabulary drops white space and no token spans it, so the ids of a
    text are those of its words; a worker keeps the ids of words it has seen.
    Signs around letters are tokens of their own, and letters below U+0130
    are changed by nothing but the lower case; so the letters go straight to
    the library's merges.  All other words take the library's whole way.
    """

    #: Not among the signs: the apostrophe before letters, and what begins or ends a special string.
    LEAD = "\"#$%&()*+,-./:;=?@[\\]^_`{}~!"
    TAIL = LEAD + "'"

    def __init__(self, path: str, max_words: int = 300_000):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.parts: dict[str, bytes] = {"": b""}
        self.max_words = max_words

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return pack_ids([t.id for t in self.merges.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str, make: Callable[[str], bytes]) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = make(part)
        return ids

    def __missing__(self, word: str) -> bytes:
        head = word.rstrip(self.TAIL)
        letters = head.lstrip(self.LEAD)
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0130"):
            ids = self._part(letters.lower(), self._letters)
            if len(letters) < len(word):
                ids = self._part(head[:len(head) - len(letters)], self._whole) + ids + self._part(word[len(head):], self._whole)
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.max_words:
            self.clear()
        if len(self.parts) > self.max_words:
            self.parts = {"": b""}
        return [self._whole(t) if any(c in t for c in NOT_SPACE) else b"".join(map(self.__getitem__, t.split())) for t in texts]


def word_ids(path: str) -> WordIds:
    return worker_state(f"words:{path}", lambda: WordIds(path))


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (with the end id), ``ids`` if kept,
    and ``_part`` / ``_nth``: the partition, and the number among the partition's pieces of that length."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _part long, _nth long"
              + (", ids array<int>" if keep_ids else ""))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(path), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            texts, keys = texts_of(batch), batch.column("doc_id")
            for group in groups_of(texts):
                rows: list[tuple] = []
                kept = []
                for i, ids in zip(group, words.encode([texts[i] for i in group])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        data = ids[4 * start:4 * (start + window)]
                        length = len(data) // 4
                        rows.append((i, start, length, zlib.crc32(data), n, part, seen[length]))
                        seen[length] += 1
                        if keep_ids:
                            kept.append(np.frombuffer(data, "<i4"))
                columns = list(zip(*rows))
                arrays = [keys.take(pa.array(columns[0], pa.int64())), *[pa.array(c, pa.int64()) for c in columns[1:]]]
                if keep_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Capacities:
    """Segment tree over remaining capacities: which hold open windows, and the least one of at least a given size."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:  # up to the first open part on the right, then down its left side
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """The placement of all pieces: rows (length, first rank, pieces, first sequence, pieces a window, offset).

    Pieces of one row fill consecutive sequences, each with ``pieces a
    window`` of them from ``offset`` on.
    """
    tree = Capacities(window)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs (first sequence, windows)
    plan, next_seq = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity:
            open_.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, next_seq, -(-left // (window // length))
                next_seq += n
            else:
                first, n = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            each = capacity // length  # a window just used is the tightest one as long as the length fits
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:
                plan.append((length, rank, left, first, left, window - capacity))
                put(capacity - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                put(capacity, first, n)
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`token_pieces`.

    The driver sees the histogram only (at most ``window`` numbers).  Ranks
    come from one row per (length, partition), so a length that most pieces
    share is no single group anywhere.
    """
    pieces = cut(pieces)
    counts = cut(pieces.groupBy("length", "_part").agg(F.count("*").alias("_n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = best_fit_decreasing(histogram, window)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    w = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    names = [c for c in pieces.columns if c not in ("_part", "_nth")]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            row = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            inside = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(row[:, 3] + inside // row[:, 4]),
                 pa.array(row[:, 5] + inside % row[:, 4] * length)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place."""
    return pack(token_pieces(docs, path, window, end_id, keep_ids), window)
