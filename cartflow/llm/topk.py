"""Exact top-k by inner product: columnar branch and bound over integer vectors.

A chunk of candidates lies in columns, dimension by dimension.  For a query,
inner products are added up block by block of dimensions.  What the dimensions
to come can add or take is at most the product of the norms of the rest of
query and candidate; a candidate whose sum with that stays under the k-th best
sum without it can't be among the k best, and the columns go on with the
survivors only.

Components become ``floor(scale * x)``.  Vectors of another length than the
query's are no candidates.  Null ids, null vectors, empty ones and those with
null or non-finite components take no part; rows of the same id and integers
count once, those of the same id with other integers are candidates of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import cut
from cartflow.llm.vectors import BLOCK, CHUNK, against, best, dealt, matrix, parts_of, usable

DIMENSIONS = 8


def top_of_chunk(columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best candidates and their scores; ``columns`` is (dimensions, candidates), ``rest[b]`` the norms from block b on."""
    alive = np.flatnonzero(ids != own)
    total = np.zeros(len(alive), columns.dtype)
    for b, at in enumerate(range(0, len(query), DIMENSIONS)):
        part = slice(at, at + DIMENSIONS)
        total = total + query[part] @ (columns[part] if len(alive) == columns.shape[1] else columns[part, alive])
        if at + DIMENSIONS < len(query) and len(alive) > k:
            slack = rest[b + 1][alive] * (np.sqrt((query[at + DIMENSIONS:].astype(float) ** 2).sum()) * (1 + 1e-9)) + 1
            sums = total.astype(float)
            least = np.partition(sums - slack, len(alive) - k)[len(alive) - k]
            keep = np.flatnonzero(sums + slack >= least)
            if len(keep) < 0.9 * len(alive):
                alive, total = alive[keep], total[keep]
    order = np.lexsort((ids[alive], -total))[:k]
    return alive[order], total[order]


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as floats while sums of products stay exact, as Python's integers beyond."""
    made = np.floor(values * scale)
    top = float(np.abs(made).max(initial=0))
    return made if top * top * made.shape[1] < 2 ** 52 else np.array([[int(x) for x in row] for row in made], object)


def once(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the first row of every id and vector."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    return np.array(list({(i, *row): place for place, (i, row) in reversed(list(enumerate(zip(ids.tolist(), rows.tolist()))))}.values())[::-1])


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id",
                vector_col: str = "embedding", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` (long): for each query row the k highest inner products among all other ids."""
    all_ = cut(usable(rows, id_col, vector_col).distinct())
    n_chunks, n_blocks = parts_of(all_.count(), chunk), parts_of(all_.where(is_query).count(), block)

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        both = integers(np.concatenate([matrix(a.v), matrix(b.v)]), scale)
        ids, owns, rows, queries = a.vec_id.to_numpy(), b.vec_id.to_numpy(), both[:len(a)], both[len(a):]
        mine, asked = once(ids, rows), once(owns, queries)  # all rows of an id are in one chunk and one block
        ids, owns, columns, queries = ids[mine], owns[asked], np.ascontiguousarray(rows[mine].T), queries[asked]
        squares = np.cumsum((columns.astype(float) ** 2)[::-1], 0)[::-1]
        rest = np.sqrt(squares[::DIMENSIONS])
        out = []
        for own, q in zip(owns, queries):
            place, score = top_of_chunk(columns, rest, ids, q, own, k)
            out += [(own, ids[p], max(-2 ** 63, min(2 ** 63 - 1, int(s)))) for p, s in zip(place, score)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = against(dealt(all_, "chunk", n_chunks, 3, F.col("vec_id")), n_chunks,
                    dealt(all_.where(is_query), "block", n_blocks, 5, F.col("vec_id")), n_blocks, search,
                    "query_id long, vec_id long, score long")
    return best(found, k)
