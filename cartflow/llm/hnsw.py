"""Approximate nearest neighbours by cosine: a navigable small-world graph per shard.

Equal vectors become one node that keeps its least ids (one more than the
neighbours asked for: more can't be among them), pre-aggregated batch by batch.
Nodes are dealt to shards by a hash; each shard builds its hierarchical graph
and stores it as flat arrays, one row a shard: vectors, and for each level a
table of neighbour numbers.  Blocks of queries search every shard, and each
query's best are merged.  Scores are cosines of the original vectors in double
precision.

Null ids, null, empty or zero vectors and those with null or non-finite
components take no part; vectors of another length than the query's are no
candidates; of rows that share an id the nearest counts, and rows of the query's own id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import cut
from cartflow.llm.vectors import BLOCK, CHUNK, against, best, dealt, matrix, parts_of, usable

LINKS, EF_BUILD, EF_SEARCH = 16, 64, 128


class Graph:
    """Hierarchical navigable small world over unit vectors; ``links[level]`` is a table of neighbour numbers, -1 for none."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.links, self.entry = x, links, entry
        self.seen = np.zeros(len(x), np.int64)
        self.mark = 0

    def near(self, q: np.ndarray, start: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found from ``start``, as (similarity, node), best first."""
        x, links, seen = self.x, self.links[level], self.seen
        self.mark += 1
        mark = self.mark
        seen[start] = mark
        todo, found = [], []
        for s, i in zip((x[start] @ q).tolist(), start):
            heappush(todo, (-s, i))
            heappush(found, (s, i))
        while len(found) > width:
            heappop(found)
        while todo:
            s, i = heappop(todo)
            if len(found) >= width and -s < found[0][0]:
                break
            near = links[i]
            near = near[(seen[near] != mark) & (near >= 0)]
            if len(near):
                seen[near] = mark
                for s, j in zip((x[near] @ q).tolist(), near.tolist()):
                    if len(found) < width:
                        heappush(found, (s, j))
                        heappush(todo, (-s, j))
                    elif s > found[0][0]:
                        heapreplace(found, (s, j))
                        heappush(todo, (-s, j))
        return sorted(found, reverse=True)

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        start = [self.entry]
        for level in range(len(self.links) - 1, 0, -1):
            start = [self.near(q, start, 1, level)[0][1]]
        return self.near(q, start, width, 0)


def spread(x: np.ndarray, found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
    """Up to ``most`` of the nodes found, such that each is nearer to the new node than to those before it; then the nearest left."""
    ids = [i for _, i in found]
    between = x[ids] @ x[ids].T
    kept: list[int] = []
    for a, (s, _) in enumerate(found):
        if len(kept) == most:
            break
        if not kept or between[a, kept].max() < s:
            kept.append(a)
    for a in range(len(found)):
        if len(kept) == most:
            break
        if a not in kept:
            kept.append(a)
    return [found[a] for a in kept]


def build(x: np.ndarray, links: int = LINKS, width: int = EF_BUILD, seed: int = 0) -> Graph:
    """Inserts the vectors one after the other; levels are drawn with a fixed seed.

    A node may have ``links`` neighbours more than it should keep: when there is
    no room for another back link, its list is cut to a spread of them.
    """
    n = len(x)
    levels = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links), 8).astype(int)
    top = int(levels.max(initial=0))
    most = [2 * links if level == 0 else links for level in range(top + 1)]
    tables = [np.full((n, m + links), -1, np.int32) for m in most]
    held = [np.zeros(n, np.int64) for _ in most]
    graph = Graph(x, tables[:1], 0)
    high = -1

    def link(level: int, j: int, i: int) -> None:
        table, count = tables[level], held[level]
        if count[j] == table.shape[1]:
            near = np.append(table[j], i)
            sims = x[near] @ x[j]
            kept = spread(x, [(float(sims[a]), int(near[a])) for a in np.argsort(-sims, kind="stable")], most[level])
            table[j] = -1
            table[j, :len(kept)] = [k for _, k in kept]
            count[j] = len(kept)
        else:
            table[j, count[j]] = i
            count[j] += 1

    for i in range(n):
        level = int(levels[i])
        if high < 0:
            high, graph.entry = level, i
            graph.links = tables[:level + 1]
            continue
        q, start = x[i], [graph.entry]
        for up in range(high, level, -1):
            start = [graph.near(q, start, 1, up)[0][1]]
        for at in range(min(level, high), -1, -1):
            found = graph.near(q, start, width, at)
            start = [j for _, j in found]
            for _, j in spread(x, found, links):
                link(at, i, j)
                link(at, j, i)
        if level > high:
            high, graph.entry = level, i
            graph.links = tables[:level + 1]
    return graph


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: every different vector with its ``k + 1`` least ids."""
    kind = rows.schema["v"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids: dict[tuple, list[int]] = {}
                first: dict[tuple, int] = {}
                for row, (i, v) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist())):
                    key = tuple(v)
                    ids.setdefault(key, []).append(i)
                    first.setdefault(key, row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("v").take(pa.array(list(first.values()))),
                     pa.array([sorted(set(x))[:k + 1] for x in ids.values()], pa.list_(pa.int64()))], ["v", "ids"])

    return (rows.mapInArrow(local, f"v {kind}, ids array<bigint>").groupBy("v")
            .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))


def index(nodes: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard: dim, chunk, entry, ids, vectors (doubles), and the neighbour table of each level, as flat binary arrays."""
    def one(a: pd.DataFrame) -> pd.DataFrame:
        x = matrix(a.v)
        graph = build(unit(x))
        width = max(map(len, a.ids))
        ids = np.full((len(a), width), -1, np.int64)
        held = np.array([len(i) for i in a.ids], np.int32)
        for row, i in enumerate(a.ids):
            ids[row, :len(i)] = i
        return pd.DataFrame({"dim": [x.shape[1]], "chunk": [int(a.chunk.iloc[0])], "entry": [graph.entry], "width": [width],
                             "held": [held.tobytes()], "ids": [ids.tobytes()], "vectors": [x.tobytes()], "links": [[t.tobytes() for t in graph.links]]})

    return (dealt(nodes, "chunk", n_shards, 3, F.col("v")).groupBy("dim", "chunk")
            .applyInPandas(one, "dim int, chunk int, entry long, width int, held binary, ids binary, vectors binary, links array<binary>"))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            shard: int = CHUNK, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k nearest found among all other ids.

    ``width`` of the search: by default 128, or 5/4 of the dimensions where that is more.
    """
    all_ = usable(rows, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    nodes = cut(nodes_of(all_, k))
    queries = cut(all_.where(is_query).distinct())
    n_shards, n_blocks = parts_of(nodes.count(), shard), parts_of(queries.count(), block)
    shards = cut(index(nodes, n_shards))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s = a.iloc[0]
        x = np.frombuffer(s.vectors, np.float64).reshape(-1, s.dim)
        n, norms = len(x), np.sqrt((x * x).sum(1))
        graph = Graph(unit(x), [np.frombuffer(t, np.int32).reshape(n, -1) for t in s.links], int(s.entry))
        ids, held = np.frombuffer(s.ids, np.int64).reshape(n, -1), np.frombuffer(s.held, np.int32)
        q64, out = matrix(b.v), []
        q32 = unit(q64)
        for own, q, qn in zip(b.vec_id.to_numpy(), q64, q32):
            place = np.array([i for _, i in graph.search(qn, width or max(EF_SEARCH, 5 * int(s.dim) // 4))])
            score = (x[place] * q).sum(1) / (norms[place] * np.sqrt((q * q).sum()))
            mine = [(-c, int(i)) for p, c in zip(place, score.tolist()) for i in ids[p, :held[p]] if i != own]
            nearest_of: dict[int, float] = {}
            for c, i in sorted(mine):
                nearest_of.setdefault(i, -c)
                if len(nearest_of) == k:
                    break
            out += [(own, i, c) for i, c in nearest_of.items()]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = against(shards, n_shards, dealt(queries, "block", n_blocks, 5, F.col("vec_id")), n_blocks, search,
                    "query_id long, vec_id long, score double")
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
