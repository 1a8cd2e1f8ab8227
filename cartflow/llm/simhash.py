"""SimHash near-duplicates: fingerprints, exact search within a bit distance, groups.

*Fingerprints.*  A bit is 1 if it is set in over half the 64-bit hashes of a
text's word shingles (repeats count).

*Search.*  Equal fingerprints form a class first, so copies cost nothing.
Cut into ``distance + 2`` bands of bits, two fingerprints within the distance
agree on at least two bands; so each class is listed once for every pair of
bands, and classes with the same two bands meet (ten lists for distance 3,
keys of about 25 bits).  This finds every pair; a list that is too long for
one task is dealt into chunks, and every two chunks meet.

*Comparison, bit-sliced.*  A task keeps its classes in order of their lists
as 64 bit planes, 64 classes to a word.  For a step ``d`` it compares every
class with the ``d``-th one after it, all at once: a plane XOR its shifted
self is one bit of the distance, added to carry-save counters (ones, twos,
and a flag for over the distance).  Words in which every pair is over the
distance, or of two lists, are dropped as the planes go by.

*Groups.*  Each list yields a spanning forest of its links, not all pairs;
connected components join them.

Null or empty texts have the fingerprint zero and link like any other.
Repeated rows keep their number; rows without an id link like any other, and
a group of such rows only has a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import cut, map_batches, own_names, texts_of
from cartflow.llm.components import components

SHINGLE = 3
DISTANCE = 3
#: Classes that one task compares within a list.
CHUNK = 2048


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case, in UTF-8 (where no other byte looks like a letter or blank of ASCII)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as the long with the same bits.  One pass, no shuffle."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in texts_of(batch, "_text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found)], [*keep, "fp"])
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "fp long"])
    return map_batches(docs, [F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in keep]], schema, make)


def band_masks(distance: int) -> list[int]:
    """The bits of every pair of ``distance + 2`` bands."""
    n = distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    bands = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [a | b for a, b in combinations(bands, 2)]


def within(planes: np.ndarray, same: np.ndarray, step: int, distance: int) -> np.ndarray:
    """Places i whose distance to place i + step is small enough; ``same``: the bits of the i that share a list with it.

    The counter of each pair is held across words: bit k of all counters is
    one word.  A pair over the distance stays flagged.
    """
    live = np.flatnonzero(same)
    words, bits = divmod(step, 64)
    alive = same[live]
    digits = [np.zeros(len(live), np.uint64) for _ in range((distance + 1).bit_length())]
    for b in range(64):
        plane = planes[b]
        moved = plane[live + words]
        if bits:
            moved = (moved >> np.uint64(bits)) | (plane[live + words + 1] << np.uint64(64 - bits))
        carry = plane[live] ^ moved
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        over = carry.copy()  # past the counter's range
        more, equal = np.zeros(len(live), np.uint64), np.full(len(live), ~np.uint64(0))
        for k in reversed(range(len(digits))):  # counter > distance, from the top digit
            if distance >> k & 1:
                equal &= digits[k]
            else:
                more |= equal & digits[k]
                equal &= ~digits[k]
        alive = alive & ~(over | more)
        if b % 4 == 3:
            keep = np.flatnonzero(alive)
            if len(keep) == 0:
                return np.empty(0, np.int64)
            if len(keep) < len(alive):
                live, alive = live[keep], alive[keep]
                digits = [d[keep] for d in digits]
    flags = np.unpackbits(alive.astype("<u8").view(np.uint8), bitorder="little").reshape(len(live), 64)
    word, bit = np.nonzero(flags)
    return live[word] * 64 + bit


def linked_pairs(lists: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in the same list whose fingerprints are within the distance, step by step.

    ``lists`` is sorted; equal values are next to each other.
    """
    n = len(lists)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    sizes = np.diff(np.r_[starts, n])
    use = np.repeat(sizes > 1, sizes)  # a class that is alone in its list meets nobody
    place = np.flatnonzero(use)
    if len(place) == 0:
        return
    sizes = sizes[sizes > 1]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(place)) - 1  # places after it in its list
    width = -(-len(place) // 64)
    bits = np.unpackbits(fps[place].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    planes = np.zeros((64, width + 1), np.uint64)
    padded = np.zeros((64, width * 64), np.uint8)
    padded[:, :len(place)] = bits.T
    planes[:, :width] = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    del bits, padded
    for step in range(1, int(sizes.max())):
        flags = np.zeros(width * 64, np.uint8)
        flags[:len(place)] = left >= step
        found = within(planes, np.packbits(flags, bitorder="little").view("<u8"), step, distance)
        if len(found):
            yield place[found], place[found + step]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from every linked place to the first place of its group, groups being joined by the given pairs."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links(classes: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """``classes(fp, rep)`` with different fingerprints -> links ``a, b`` (reps) that join all within the distance."""
    masks = band_masks(distance)
    listed = classes.select("fp", "rep", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("band", "key"))
    sizes = listed.groupBy("band", "key").count().where(F.col("count") > chunk)
    long = cut(sizes.select("band", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    if long.isEmpty():
        dealt = listed.withColumns({"one": F.lit(0), "two": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
        dealt = (listed.join(long, ["band", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
                 .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                 .withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}))
    slim = dealt.select("fp", "rep", F.xxhash64("band", "key", "one", "two").alias("list"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, fps, reps = (np.concatenate([r.column(i).to_numpy(zero_copy_only=False) for r in rows]) for i in range(3))
            found = list(linked_pairs(lists, fps.view(np.uint64), distance))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                node, root = forest(a, b, len(lists))
                yield pa.RecordBatch.from_arrays([pa.array(reps[node]), pa.array(reps[root])], ["a", "b"])

        # rows come sorted by list: a block ends where a list ends, once it holds enough rows
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).to_numpy(zero_copy_only=False)
            if size >= 1 << 17:
                last = held[-1].column(0)[-1].as_py()
                head = int(np.searchsorted(values, last, "right"))
                if head < len(values):
                    if head:
                        held.append(batch.slice(0, head))
                    yield from flush(held)
                    held, size, batch = [], 0, batch.slice(head)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from flush(held)

    by_list = slim.repartition("list").sortWithinPartitions("list").select("list", "fp", "rep")
    return by_list.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id",
                    text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the kept columns, ``fp`` (long) and ``component_id``, the smallest id reachable over links within the distance."""
    return grouped(docs, shingle, distance, id_col, text_col, keep).drop("_group")


def grouped(docs: DataFrame, shingle: int, distance: int, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """:func:`near_duplicates` with ``_group``, the smallest fingerprint of the group: classes are numbered by fingerprint, with an id or without."""
    fps = cut(fingerprints(docs, shingle, text_col, (id_col, *keep)))
    classes = cut(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("least")))
    groups = components(links(classes.select("fp", F.col("fp").alias("rep")), distance))
    classes = cut(classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("_group")))
    ids = cut(classes.groupBy("_group").agg(F.min("least").alias("component_id")))
    classes = cut(classes.join(ids, "_group").select("fp", "_group", "component_id"))
    return fps.join(classes, "fp", "left").select(id_col, *keep, "fp", "component_id", "_group")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, once, with the columns of ``docs``.

    Rows that share an id are one document if they are in one group.
    """
    held = own_names(docs, id_col, text_col)
    marked = held.withColumn("_row", F.xxhash64(*held.columns))
    groups = grouped(marked, shingle, distance, id_col, text_col, ("_row",))
    firsts = (groups.where(F.col("component_id").isNull() | (F.col(id_col) == F.col("component_id")))
              .groupBy("_group", "component_id")
              .agg(F.min("_row").alias("_row")).select("_row", F.col("component_id").alias("_id")))
    firsts = cut(firsts)
    on = (marked["_row"] == firsts["_row"]) & marked[id_col].eqNullSafe(firsts["_id"])
    return marked.join(firsts, on, "left_semi").dropDuplicates([id_col, "_row"]).select(*held.columns).toDF(*docs.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
