"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartflow.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` with all columns but the kept ones called c0, c1, ..., so that none of them can clash with an operator's own.

    The caller gives the old names back with ``toDF(*docs.columns)``.
    """
    return docs.toDF(*[c if c in kept else f"c{i}" for i, c in enumerate(docs.columns)])


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the shared checkpoint folder: lineage ends there,
    the partitions stay as they are, and lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker, kept between tasks.

    Functions travel to workers by value, so a module global would be new in
    every task; ``sys`` is the one module that surely outlives them.
    """
    state = sys.__dict__.setdefault("_cartflow_llm", {})
    if name not in state:
        state[name] = make()
    return state[name]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of an Arrow batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def groups_of(texts: list[str], chars: int = 1_000_000) -> Iterator[range]:
    """Consecutive texts of about ``chars`` code points together."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield range(at, i + 1)
            at, total = i + 1, 0
    if at < len(texts):
        yield range(at, len(texts))


def map_batches(df: DataFrame, columns: list[Column | str], out: str,
                make: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over the named columns only; ``make`` turns one batch into one or several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
    return df.select(*columns).mapInArrow(run, out)


def ranged(df: DataFrame, keys: list[str], order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by keys and order, its partition number in ``_part``, rows kept in the shared folder.

    A hot key spans as many partitions as its rows need.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], *order)
               .withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, per key, the sum of each column over the rows before this one in ``order``.

    ``df`` comes from :func:`ranged` with the same keys and order.  A window
    never sees more of a key than one partition holds; the sums of earlier
    partitions (one row per key and partition) are joined on.  DataFrame
    functions only.
    """
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    parts = df.groupBy("_part", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums])
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(parts, on).withColumns(
        {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0)) for n in sums})
    return out.drop("_p", *[f"_k{i}" for i in range(len(keys))],
                    *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])
