"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Texts are lower-cased in A-Z and cut into words; features are all runs of one to
three consecutive words, and a feature's bucket is the CRC-32 of its bytes modulo
the number of buckets.  A bucket's gain is the logarithm of its smoothed share in
the target over that in the documents; a document's weight is the sum of its
features' gains.  Gumbel noise from a hash of the id is added, and of the
documents with enough words the best are drawn, in order: sampling without
replacement in proportion to the exponential of the weight.

The CRCs of all features of a batch are taken at once.  A CRC is linear over XOR
but for a constant of the length, so a byte's contribution depends on the byte and
its distance from the end of the feature alone: contributions come from a table of
positions, ``bitwise_xor.reduceat`` adds them up over the feature's span, and the
length's constant is added.  Spans longer than the table are cut into blocks whose
results are folded one after the other.

Two passes read the texts: counts (of which ``buckets`` numbers come to the driver)
and weights.  Only ids and numbers are shuffled, in a sort over as many partitions
as needed.

Null and empty texts have no words: weight 0, never drawn.  A null id hashes as
``null`` and comes last among equal scores; repeated rows are documents of their
own.  Without documents or target texts, shares are those of the smoothing alone.
Texts of any length are taken in slices, whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import cut, groups_of, map_batches, own_names, ranged, running, texts_of

BUCKETS, LONGEST, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the table holds, also the block length of longer spans.
POSITIONS = 512
#: Bytes of spans whose contributions are looked up at a time, and bytes of a slice of a long text.
LOOKED_UP, SLICE = 1 << 18, 1 << 22


class PositionCrc:
    """CRC-32 of many spans of one buffer at a time."""

    def __init__(self, positions: int = POSITIONS):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
        rows, start = [step], [np.uint32(0xFFFFFFFF)]
        for _ in range(1, positions):
            rows.append((rows[-1] >> 8) ^ step[rows[-1] & 255])
        for _ in range(positions):
            start.append((start[-1] >> np.uint32(8)) ^ step[start[-1] & 255])
        self.positions, self.table = positions, np.concatenate(rows)  # entry 256 * distance + byte
        self.start = np.array(start, np.uint32)  # the register that begins with ones, after so many zero bytes

    def contributions(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XOR of the bytes' contributions for spans no longer than the table, in groups of bounded size."""
        out = np.empty(len(at), np.uint32)
        total = np.cumsum(size)
        first = 0
        while first < len(at):
            base = int(total[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + LOOKED_UP, "right")))
            n = size[first:last]
            ends = np.cumsum(n)
            here = np.arange(ends[-1], dtype=np.int32)
            origin = int(at[first:last].min())  # the group's places, counted from its first one, fit into 32 bits
            place = np.repeat((at[first:last] - origin - (ends - n)).astype(np.int32), n) + here
            entry = (np.repeat((ends - 1).astype(np.int32), n) - here) << 8
            entry |= data[origin:].take(place)
            out[first:last] = np.bitwise_xor.reduceat(self.table.take(entry), ends - n)
            first = last
        return out

    def after_block(self, register: np.ndarray) -> np.ndarray:
        """Registers after one block of zero bytes: each of their four bytes is like one of the block's first bytes."""
        return np.bitwise_xor.reduce([self.table[((self.positions - 1 - k) << 8) | ((register >> np.uint32(8 * k)) & 255)] for k in range(4)])

    def of_spans(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The CRC-32 of every span of at least one byte."""
        blocks = -(-size // self.positions)
        head = size - (blocks - 1) * self.positions
        register = self.start[head] ^ self.contributions(data, at, head)
        left = np.flatnonzero(blocks > 1)
        done = 1
        while len(left):
            block = self.contributions(data, at[left] + head[left] + (done - 1) * self.positions, np.full(len(left), self.positions))
            register[left] = self.after_block(register[left]) ^ block
            done += 1
            left = left[blocks[left] > done]
        return register ^ np.uint32(0xFFFFFFFF)


def byte_map() -> np.ndarray:
    """Each byte in lower case, 0 for those that are in no word."""
    out = np.zeros(256, np.uint8)
    for letters in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256))):
        out[list(letters)] = list(letters)
    out[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")
    return out


BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LAST_WORDS = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def slices(data: bytes, longest: int, size: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """A text in slices cut between words, each led by the last words before it, whose number is given."""
    at, lead = 0, []
    while True:
        border = BREAK.search(data, at + size) if len(data) - at > size else None
        end = border.start() if border else len(data)
        yield b" ".join([*lead, data[at:end]]), len(lead)
        if end == len(data):
            return
        words = re.findall(LAST_WORDS, data[at:end]) if longest > 1 else []
        lead = ([*lead, *words])[-(longest - 1):] if longest > 1 else []
        at = end


def features(texts: list[str], crc: PositionCrc, buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(n, document, bucket)`` for runs of n words: the document's place among the texts and the bucket of every feature."""
    lower = byte_map()
    parts: list[tuple[int, bytes, int]] = []
    held = 0
    for i, text in enumerate(texts):
        for part, lead in slices(text.encode("utf-8", "surrogatepass"), longest):
            parts.append((i, part, lead))
            held += len(part)
            if held >= SLICE:
                yield from of_parts(parts, lower, crc, buckets, longest)
                parts, held = [], 0
    if parts:
        yield from of_parts(parts, lower, crc, buckets, longest)


def of_parts(parts: list[tuple[int, bytes, int]], lower: np.ndarray, crc: PositionCrc, buckets: int,
             longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Features of texts or slices (document, bytes, words that lead)."""
    whole = lower[np.frombuffer(b"\x00".join([b"", *[p for _, p, _ in parts], b""]), np.uint8)]
    word = whole > 0
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    size = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - starts
    if not len(starts):
        return
    opens = np.cumsum([1, *[len(p) + 1 for _, p, _ in parts[:-1]]])
    part = np.searchsorted(opens, starts, "right") - 1
    # the words alone, each with one space behind it: features are spans of that
    after = np.zeros_like(word)
    after[1:] = word[:-1] & ~word[1:]
    joined = np.where(word, whole, 32)[word | after]
    at = np.cumsum(size + 1) - (size + 1)
    ordinal = np.arange(len(starts)) - np.searchsorted(part, part)
    lead = np.array([n for _, _, n in parts])[part]
    document = np.array([i for i, _, _ in parts])[part]
    for n in range(1, longest + 1):
        if len(starts) < n:
            return
        last = slice(n - 1, None)
        first = np.flatnonzero((part[:len(part) - n + 1] == part[last]) & (ordinal[last] >= lead[last]))
        if len(first):
            yield n, document[first], crc.of_spans(joined, at[first], at[first + n - 1] + size[first + n - 1] - at[first]) % buckets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: every task adds up its own, ``buckets`` numbers come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = PositionCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in features(texts_of(batch, "text"), crc, buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    buckets, all_docs, all_target = len(documents), float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_docs + buckets)) / ((s + 1) * (all_target + buckets))))
                     for s, t in zip(documents.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, keep: list[str], longest: int = LONGEST, text_col: str = "text") -> DataFrame:
    """The named columns with ``n_words``, ``n_features`` and ``weight`` (named columns called so give way)."""
    own = ["n_words", "n_features", "weight"]
    keep = [c for c in keep if c.lower() not in own]
    buckets = len(gain)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "_text")
        words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        crc = PositionCrc()
        for group in groups_of(texts, SLICE):
            size = len(group)
            for length, document, bucket in features(texts[group.start:group.stop], crc, buckets, longest):
                here = np.bincount(document, minlength=size)
                n[group.start:group.stop] += here
                words[group.start:group.stop] += here if length == 1 else 0
                total[group.start:group.stop] += np.bincount(document, gain[bucket], size).astype(np.int64)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(words), pa.array(n), pa.array(total)], [*keep, *own])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} long" for c in own]])
    return map_batches(docs, [F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in keep]], schema, make)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def scored(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
           least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
           target_col: str = "text") -> DataFrame:
    """Every row's id and kept columns with n_words, n_features, weight, score, and its place among those drawn (null if it isn't).

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down; ties go to the smaller id.
    """
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, target_col))
    rows = cut(weights(docs, gain, [id_col, *keep], longest, text_col).withColumn("score", F.col("weight") + noise(F.col(id_col), seed)))
    fit = F.col("n_words") >= least_words
    drawn = rows.where(fit).count() * percent // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("weight").desc()]
    placed = running(ranged(rows, [], order), [], order, {"_before": fit.cast("long")})
    return placed.withColumn("rank", F.when(fit & (F.col("_before") < drawn), F.col("_before") + 1)).drop("_part", "_before")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents drawn, with the columns of ``docs``."""
    held = own_names(docs, id_col, text_col)
    # rows carry their own number, for ids may repeat; the numbered rows stay in the shared folder
    numbered = cut(held.withColumn("_row", F.monotonically_increasing_id()))
    places = scored(numbered, target, ("_row",), id_col=id_col, text_col=text_col, **options)
    return numbered.join(places.where("rank is not null").select("_row"), "_row", "left_semi").select(*held.columns).toDF(*docs.columns)
