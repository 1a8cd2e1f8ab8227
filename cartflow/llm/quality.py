"""Quality of documents from a linear-chain conditional random field over their lines.

Every line gets the label good or bad.  A line is described by its make-up
(letters, case, digits, symbols, word length, repetition) together with that
of the line before and after it; a transition score ties neighbouring labels.
Forward-backward gives each line's probability of being good; the document's
score is their mean, weighted by line length.

The weights are fitted by gradient ascent on a bounded sample of labelled
documents (``max_docs`` documents, those of at most ``max_lines`` lines and
``max_chars`` code points), each line taking its document's label.  The sample is chosen by a hash of the
id, so it doesn't depend on the order or number of rows.  Scoring covers all
rows in one pass.

Null text counts as empty: one empty line.  Repeated rows get equal scores.
Without any labelled row of either class the score is 0.5 throughout.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import groups_of, map_batches, own_names, texts_of

MAX_DOCS = 3000
MAX_LINES = 400
MAX_CHARS = 50_000
#: Code points whose lines a task describes at a time (a longer document is described alone).
GROUP_CHARS = 4_000_000
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
           "blank": b" \t\n\r\x0b\x0c", "stop": b".,;:'\"()-", "call": b"!?", "bar": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{}~"}


def byte_classes() -> np.ndarray:
    """The class of each byte; bytes of other letters than ASCII have one class of their own."""
    kind = np.full(256, len(CLASSES), np.uint8)
    for i, members in enumerate(CLASSES.values()):
        kind[np.frombuffer(members, np.uint8)] = i
    return kind


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts (one row a line), lines per text, and line lengths in bytes."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    repeated, again, distinct = [], [], []
    for d in data:
        seen: set[bytes] = set()
        for line in d.split(b"\n"):
            repeated.append(len(line) > 0 and line in seen)
            seen.add(line)
            words = line.split()
            again.append(sum(map(eq, words, words[1:])) / max(len(words) - 1, 1))
            distinct.append(len(set(words)) / max(len(words), 1))
    count = np.array([d.count(b"\n") + 1 for d in data], np.int64)
    whole = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    ends = np.flatnonzero(whole == 10)
    starts = np.r_[0, ends[:-1] + 1]
    kind = byte_classes()[whole]
    n = [np.add.reduceat(kind == i, starts, dtype=np.int64) for i in range(len(CLASSES) + 1)]
    length = ends - starts
    n[3] = n[3] - 1  # without the line's end
    size = np.maximum(length, 1).astype(float)
    upper, lower, digit, blank, stop, call, bar, sign, other = (x / size for x in n)
    words = n[3] + 1.0
    columns = [np.log1p(length) / 5, (length == 0) * 1.0, upper / np.maximum(upper + lower, 1e-9) * (n[0] + n[1] > 0), digit, blank,
               stop * 4, np.minimum(call * 20, 1), np.minimum(bar * 20, 1), np.minimum(sign * 20, 1), other, np.minimum(size / words, 30) / 10, np.array(repeated, float), np.array(again) * 4, np.array(distinct)]
    return np.stack(columns, 1).astype(np.float32), count, length


def with_neighbours(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each line's features, a constant, and those of the lines before and after it (zero at a document's ends)."""
    first = np.zeros(len(x), bool)
    last = np.zeros(len(x), bool)
    ends = np.cumsum(count)
    first[ends - count] = True
    last[ends - 1] = True
    before = np.roll(x, 1, 0)
    before[first] = 0
    after = np.roll(x, -1, 0)
    after[last] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype), first[:, None], last[:, None]], 1)


def forward_backward(unary: np.ndarray, move: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the two labels of every line, and the expected label pairs over all neighbouring lines.

    ``unary``: a score for label 1 of each line (label 0 has 0); ``move[i, j]``:
    of label j after i.  All documents advance by one line at a time.
    """
    order = np.argsort(-count, kind="stable")
    starts, sizes = (np.cumsum(count) - count)[order], count[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents that have line t
    u = np.stack([np.zeros_like(unary), unary], 1)
    alpha = np.empty_like(u)
    for t in range(longest):
        rows = starts[:active[t]] + t
        if t == 0:
            alpha[rows] = u[rows]
        else:
            p = alpha[rows - 1]
            alpha[rows] = np.logaddexp(p[:, :1] + move[0], p[:, 1:] + move[1]) + u[rows]
    beta = np.zeros_like(u)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        rows = starts[:active[t + 1]] + t
        ahead = u[rows + 1] + beta[rows + 1]
        joint = move[None] + ahead[:, None, :]
        beta[rows] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        joint = joint + alpha[rows][:, :, None]
        total = np.logaddexp.reduce(joint.reshape(-1, 4), 1)
        pairs += np.exp(joint - total[:, None, None]).sum(0)
    both = alpha + beta
    return 1 / (1 + np.exp(both[:, ::-1] - both)), pairs


@dataclass
class LineModel:
    """Weights of the field: one for each feature of a line, and for each pair of neighbouring labels."""

    weights: np.ndarray
    move: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        x, count, length = line_features(texts)
        good = forward_backward(with_neighbours(x, count) @ self.weights, self.move, count)[0][:, 1]
        weight = np.maximum(length, 1).astype(float)
        starts = np.cumsum(count) - count
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, shrink: float = 2e-4) -> LineModel | None:
    """Gradient ascent (Adam) on the conditional likelihood."""
    if len(set(labels.tolist())) < 2:
        return None
    x, count, _ = line_features(texts)
    x = with_neighbours(x, count).astype(float)
    y = np.repeat(labels, count).astype(float)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(count) - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner].astype(int)), 1.0)
    theta, n = np.zeros(x.shape[1] + 4), len(y)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p, pairs = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), count)
        slope = np.r_[x.T @ (y - p[:, 1]), (seen - pairs).ravel()] / n - shrink * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        theta = theta + rate * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
    return LineModel(theta[:-4], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES,
          max_chars: int = MAX_CHARS) -> LineModel | None:
    """Fits the field on at most ``max_docs`` labelled documents of ``max_chars`` (the bound of what the driver sees)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))  # max_docs rows
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
            .where((F.length("text") <= max_chars) & (F.length("text") - F.length(F.translate("text", "\n", "")) < max_lines))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).orderBy("doc_id").collect())
    return fit([r.text for r in rows], np.array([r.quality for r in rows], int))


def score(docs: DataFrame, model: LineModel | None, keep: list[str]) -> DataFrame:
    """The named columns of ``docs`` with ``score`` (a named column called so gives way to it)."""
    keep = [c for c in keep if c.lower() != "score"]
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "_text")
        found = np.full(len(texts), 0.5)
        for group in groups_of(texts, GROUP_CHARS) if model else ():
            found[group.start:group.stop] = model.scores(texts[group.start:group.stop])
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.clip(found, 0, 1), pa.float64())], [*keep, "score"])
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "score double"])
    return map_batches(docs, [F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in keep]], schema, make)


def good_documents(docs: DataFrame, model: LineModel | None, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``least``, with the columns of ``docs``."""
    held = own_names(docs, "text")
    return score(held, model, held.columns).where(F.col("score") >= least).select(*held.columns).toDF(*docs.columns)


def in_training(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1
