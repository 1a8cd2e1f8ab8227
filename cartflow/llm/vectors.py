"""Vectors in chunks against queries in blocks: what both vector searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Rows in a chunk of candidates and in a block of queries, on average.
CHUNK, BLOCK = 8192, 2048
#: Blocks of queries that stream past one copy of a chunk.
TOGETHER = 64


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of rows with an id and a vector of finite numbers; equal rows once."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
            .where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad)))


def parts_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def matrix(values: pd.Series, dtype: str = "float64") -> np.ndarray:
    return np.stack([np.asarray(v, dtype) for v in values])


def against(chunks: DataFrame, n_chunks: int, queries: DataFrame, n_blocks: int, search: Callable, out: str) -> DataFrame:
    """Every chunk meets every block of queries once: ``search(chunk rows, query rows)``, both as pandas.

    ``chunks`` has ``dim`` and ``chunk``, ``queries`` has ``dim`` and ``block``.  Queries
    are repeated for each chunk, a chunk for every ``TOGETHER`` blocks only: its rows
    come first in their task, and the queries stream past them in batches.  A task holds
    one chunk and one batch of queries, and its work is bounded.
    """
    spans = parts_of(n_blocks, TOGETHER)
    names = [f.split()[0] for f in out.split(", ")]
    left = chunks.withColumns({"span": F.explode(F.sequence(F.lit(0), F.lit(spans - 1))), "turn": F.lit(0)})
    right = (queries.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))), "turn": F.lit(1)})
             .withColumn("span", F.floor(F.col("block") / TOGETHER).cast("int")).drop("block"))
    types = {f.name: f.dataType for f in [*left.schema, *right.schema]}

    def filled(rows: DataFrame) -> DataFrame:
        """All columns of both sides; numbers that a side lacks are 0, so that longs stay longs in pandas."""
        return rows.select(*[F.col(n) if n in rows.columns else F.lit(0 if isinstance(t, NumericType) else None).cast(t).alias(n) for n, t in types.items()])

    keys = ["dim", "chunk", "span"]
    rows = filled(left).unionByName(filled(right)).repartition(*keys).sortWithinPartitions(*keys, "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, chunk = None, [], None
        for batch in batches:
            at = batch[[*keys, "turn"]].to_numpy()
            starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1)] if len(batch) else []
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                if place != tuple(at[start, :3]):
                    place, held, chunk = tuple(at[start, :3]), [], None
                if not at[start, 3]:
                    held.append(batch.iloc[start:end])
                elif held or chunk is not None:
                    if chunk is None:
                        chunk, held = pd.concat(held, ignore_index=True), []
                    yield search(chunk, batch.iloc[start:end])[names]

    return rows.mapInPandas(run, out)


def dealt(rows: DataFrame, name: str, parts: int, salt: int, by: Column) -> DataFrame:
    return rows.withColumns({"dim": F.size("v"), name: F.pmod(F.xxhash64(by, F.lit(salt)), F.lit(parts)).cast("int")})


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
