"""Toxicity of documents from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled text
that holds toxic documents too, in the share ``prior``.  Linear classifiers over
hashed pieces of words (the word, its beginnings, its runs of four letters) that
confirmed documents have more or less often than chance allows are trained in
numpy by stochastic steps on the corrected risk

    prior * risk(positives as toxic) + max(0, risk(unlabelled as clean) - prior * risk(positives as clean)):

what positives among the unlabelled add to the second risk is taken off; once
that falls below zero the step goes up on it instead, so that a flexible
classifier can't drive it to minus infinity.  Labels of clean documents are used
for the prior alone.  A document's margin is the sum of the weights of the pieces
it has; scores are the mean of the classifiers' logistics.

The fit sees at most ``max_docs`` positives and ``3 * max_docs`` unlabelled documents
of ``max_chars`` code points at most, chosen by a hash of the id, so it
doesn't depend on the order or number of rows.  The prior comes from all labels,
and all rows are scored in one pass.

Null and empty texts have no words: their score is that of the intercept.
Repeated rows get equal scores; several labels of one id count as its highest.
Without any positive or unlabelled document the score is 0 throughout.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import map_batches, texts_of, worker_state

MAX_DOCS, MAX_CHARS = 1500, 12_000
PIECES = 1 << 20
#: Standard errors by which a piece's share among positives must differ from that among the unlabelled.
ERRORS = 5.0
#: Words whose pieces a worker keeps.
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+|\d+")


def pieces_of(word: str) -> set[str]:
    """Pieces of a word: itself, its beginnings of three to six letters, its runs of four."""
    marked = f"<{word[:64]}>"
    return {marked, *[marked[:n] for n in range(4, min(8, len(marked)))], *[marked[i:i + 4] for i in range(1, len(marked) - 4)]}


def hashed(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) % PIECES


def words_of(text: str) -> set[str]:
    """Different words of a text, which is taken in parts so that a very long one isn't split at once."""
    seen: set[str] = set()
    at = 0
    while at < len(text):
        end = at + 1_000_000
        while end < len(text) and text[end].isalnum():
            end += 1
        seen.update(WORD.findall(text[at:end].lower()))
        at = end
    return seen


@dataclass
class Classifiers:
    """The place of each piece that counts, and for each of several classifiers the weights by place and an intercept."""

    place: dict[str, int]
    weights: np.ndarray
    intercepts: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def places(self, word: str) -> tuple[int, ...]:
        return tuple({self.place[p] for p in pieces_of(word) if p in self.place})

    def scores(self, rows: list[set[int]]) -> np.ndarray:
        """Probability of documents given by the places of their pieces."""
        margins = np.array([self.weights[:, sorted(r)].sum(1) for r in rows]).reshape(len(rows), -1) + self.intercepts
        return 1 / (1 + np.exp(-np.clip(margins.mean(1), -500, 500)))


def telling(rows: list[np.ndarray], positive: np.ndarray, errors: float) -> np.ndarray:
    """Pieces whose share of the positives differs from that of the unlabelled by so many standard errors."""
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, positive) if y == side] or [np.zeros(0, np.int64)]), minlength=PIECES) for side in (True, False)]
    n = [max(int((positive == side).sum()), 1) for side in (True, False)]
    both = (counts[0] + counts[1] + 1) / (n[0] + n[1] + 2)
    z = (counts[0] / n[0] - counts[1] / n[1]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    return np.flatnonzero(np.abs(z) >= errors)


def nonnegative_slope(margins: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """The slope of the corrected risk by each document's margin (logistic loss)."""
    margins = np.clip(margins, -500, 500)
    p, as_clean = 1 / (1 + np.exp(-margins)), np.logaddexp(0, margins)
    n_pos, n_free = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    rest = as_clean[~positive].sum() / n_free - prior * as_clean[positive].sum() / n_pos
    clean = np.where(positive, -prior * p / n_pos, p / n_free)
    return np.where(positive, prior * (p - 1) / n_pos, 0.0) + clean if rest >= 0 else -clean


def even_margin(margins: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The margin that stands for even odds: the least corrected error, in the middle of the widest gap that has it."""
    cuts = np.unique(margins)
    if len(cuts) < 2:
        return 0.0
    above = lambda side: 1 - np.searchsorted(np.sort(margins[side]), cuts[1:], "left") / max(int(side.sum()), 1)
    hit, free = above(positive), above(~positive)
    error = prior * (1 - hit) + np.maximum(0, free - prior * hit)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    widest = best[np.argmax(cuts[best + 1] - cuts[best])]
    return float(cuts[widest] + cuts[widest + 1]) / 2


def fit(texts: list[str], positive: np.ndarray, prior: float, seeds: tuple[int, ...] = (1, 2, 3), steps: int = 600, batch: int = 1024,
        rate: float = 0.05, shrink: float = 1e-4, errors: float = ERRORS) -> Classifiers | None:
    """One classifier for each seed, each by stochastic steps (Adam) on three quarters of the documents; the last quarter sets even odds."""
    if not positive.any() or positive.all():
        return None
    known: dict[str, np.ndarray] = {}
    rows = []
    for text in texts:
        words = words_of(text)
        for word in words:
            if word not in known:
                known[word] = np.array([hashed(p) for p in pieces_of(word)], np.int32)
        rows.append(np.unique(np.concatenate([known[w] for w in words])) if words else np.zeros(0, np.int32))
    learns = np.ones(len(texts), bool)
    for side in (True, False):
        learns[np.flatnonzero(positive == side)[3::4]] = False
    pieces = telling([r for r, x in zip(rows, learns) if x], positive[learns], errors)
    x = np.zeros((len(texts), len(pieces)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(pieces, r[np.isin(r, pieces)])] = 1
    confirmed, free = np.flatnonzero(positive & learns), np.flatnonzero(~positive & learns)
    if not len(free):
        return None
    share = len(confirmed) / int(learns.sum())
    weights, intercepts = [], []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        theta = np.zeros(len(pieces) + 1)
        theta[-1] = np.log(prior / (1 - prior))
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            some = min(len(confirmed), max(1, round(batch * share)))
            docs = np.concatenate([rng.choice(confirmed, some, replace=False), rng.choice(free, min(len(free), batch - some), replace=False)])
            slope = nonnegative_slope(x[docs] @ theta[:-1] + theta[-1], np.arange(len(docs)) < some, prior)
            g = np.append(x[docs].T @ slope, slope.sum()) + shrink * np.append(theta[:-1], 0)
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g ** 2
            theta = theta - rate * (1 - k / (steps + 1)) * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        weights.append(theta[:-1])
        intercepts.append(theta[-1])
    held = ~learns if positive[~learns].any() and not positive[~learns].all() else learns
    margins = (x[held] @ np.stack(weights).T + intercepts).mean(1)
    intercepts = np.array(intercepts) - even_margin(margins, positive[held], prior)
    at = {int(p): i for i, p in enumerate(pieces)}
    place = {p: at[h] for w, found in known.items() if not at.keys().isdisjoint(found.tolist()) for p in pieces_of(w) if (h := hashed(p)) in at}
    return Classifiers(place, np.stack(weights), intercepts)


class KnownWords:
    """Places of the words a worker has met, for one set of classifiers at a time; emptied when full."""

    def __init__(self):
        self.name, self.places = "", {}

    def of(self, model: Classifiers, text: str) -> set[int]:
        if self.name != model.name or len(self.places) > KEPT_WORDS:
            self.name, self.places = model.name, {}
        found: set[int] = set()
        for word in words_of(text):
            at = self.places.get(word)
            if at is None:
                at = self.places[word] = model.places(word)
            if at:
                found.update(at)
        return found


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS,
          id_col: str = "doc_id", text_col: str = "text") -> Classifiers | None:
    """Learns from confirmed toxic documents and unlabelled ones, both among ``docs``.

    ``prior``: the share of toxic documents among the unlabelled (default: that of all labels, from 0.001 to 0.5).
    """
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.max("toxic").alias("_toxic")))
    if prior is None:
        n = known.agg(F.sum("_toxic").alias("toxic"), F.count("*").alias("n")).first()
        prior = min(0.5, max(0.001, (n.toxic or 0) / max(n.n, 1)))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where("_id is not null")

    def some(ids: DataFrame, most: int, salt: int) -> list[str]:
        order = [F.xxhash64("_id", F.lit(salt)), F.col("_id")]
        chosen = F.broadcast(ids.distinct().orderBy(*order).limit(2 * most))  # 2 * most ids
        found = (rows.join(chosen, "_id").where(F.length("_text") <= max_chars).groupBy("_id").agg(F.min("_text").alias("_text"))
                 .orderBy(*order).limit(most).collect())
        return [r["_text"] for r in found]

    confirmed = some(known.where("_toxic = 1").select("_id"), max_docs, 1)
    free = some(rows.select("_id"), 3 * max_docs, 2)
    return fit(confirmed + free, np.arange(len(confirmed) + len(free)) < len(confirmed), prior)


def score(docs: DataFrame, model: Classifiers | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of ``docs`` with ``score`` (a named column called so gives way to it)."""
    keep = [c for c in keep if c.lower() != "score"]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "_text")
        words = worker_state("toxicity_words", KnownWords)
        found = model.scores([words.of(model, t) for t in texts]) if model else np.zeros(len(texts))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.float64())], [*keep, "score"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "score double"])
    return map_batches(docs, [F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in keep]], schema, make)


def in_training(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0
