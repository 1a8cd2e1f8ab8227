"""Running numbers and running sums over a sort order, without hot groups.

``row_number() over (partition by g order by k)`` hashes every row of a
group into one task: a user (or any key) holding a third of the rows would
run a third of the job on one core.  A window without ``partitionBy`` is
worse, it moves all rows into one task.

Here the rows are range-partitioned on ``(g, k)`` instead, so a large
group spans several balanced partitions.  Each partition is numbered
locally (vectorised, per Arrow batch), and a group that started in earlier
partitions gets the total of those partitions added.  Those totals are a
summary of at most two rows per partition (its first and last group), so
the only data that reaches the driver is bounded by the partition count,
not by the data.

The range-partitioned frame is checkpointed (reliable checkpoint in the
shared ``spark.checkpoint.dir``) so that the partition ids the summary is
computed from are exactly the ones the numbering pass reads, even if an
executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_PID = "_cf_pid"
_GRP = "_cf_grp"


def _partitions_for(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column | str],
                 values: dict[str, Column], num_partitions: int | None = None,
                 with_totals: bool = False):
    """Add, for each name in ``values``, the running sum of that expression.

    Sums are inclusive of the current row, over rows of the same group in
    ``order``; ``order`` must be a total order inside a group (ties would
    make the result depend on the partitioning).  ``values`` expressions are
    evaluated on the input rows and must be integral.

    With ``with_totals=True`` returns ``(frame, totals)`` where ``totals``
    maps each value name to its sum over all rows (taken from the same
    per-partition summary, no extra pass).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = _partitions_for(df, num_partitions)
    group_cols = list(group_cols)
    if not group_cols:
        df = df.withColumn(_GRP, F.lit(0))
        gcols = [_GRP]
    else:
        gcols = group_cols
    val_names = list(values)
    tmp = {name: f"_cf_v_{i}" for i, name in enumerate(val_names)}
    staged = df.select("*", *[values[n].cast("long").alias(tmp[n]) for n in val_names])
    sort_keys = [F.col(c) for c in gcols] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = (staged.repartitionByRange(n_parts, *sort_keys)
              .sortWithinPartitions(*sort_keys)
              .withColumn(_PID, F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)

    # Summary: first and last group of every partition with its totals.
    per_group = ranged.groupBy(_PID, *gcols).agg(*[F.sum(tmp[n]).alias(tmp[n]) for n in val_names])
    packed = F.struct(*[F.col(c) for c in gcols], *[F.col(tmp[n]) for n in val_names])
    bounds = per_group.groupBy(_PID).agg(F.min(packed).alias("first"), F.max(packed).alias("last"),
                                         *[F.sum(tmp[n]).alias(tmp[n]) for n in val_names])
    rows = sorted(bounds.collect(), key=lambda r: r[_PID])  # <= one row per partition
    totals = {n: int(sum(r[tmp[n]] or 0 for r in rows)) for n in val_names}
    ng = len(gcols)
    carry: dict[int, tuple] = {}
    prev_key = None
    prev_run = None
    for r in rows:
        first = tuple(r["first"])
        last = tuple(r["last"])
        fkey, fsum = first[:ng], first[ng:]
        lkey, lsum = last[:ng], last[ng:]
        base = prev_run if (prev_key is not None and fkey == prev_key) else tuple(0 for _ in val_names)
        if any(base):
            carry[r[_PID]] = (fkey, base)
        if fkey == lkey:  # the whole partition is one group: its run continues
            prev_run = tuple(b + s for b, s in zip(base, lsum))
        else:
            prev_run = tuple(lsum)
        prev_key = lkey

    out_fields = [f for f in ranged.schema.fields if f.name not in tmp.values()]
    out_schema = T.StructType(out_fields + [T.StructField(n, T.LongType(), False) for n in val_names])
    keep = [f.name for f in out_fields]

    def _null_safe(row):
        return tuple(None if pd.isna(v) else v for v in row.tolist())

    def number(batches):
        state_key = None
        state_run = None
        for pdf in batches:
            if pdf.empty:
                continue
            pid = int(pdf[_PID].iat[0])
            keys = pdf[gcols]
            before = keys.shift()
            change = ((keys != before) & ~(keys.isna() & before.isna())).any(axis=1)  # NULL keys are equal
            gid = change.cumsum()
            out = pdf[keep].copy()
            first_key = _null_safe(keys.iloc[0])
            if state_key is not None and first_key == state_key:
                base = state_run
            elif state_key is None and pid in carry and carry[pid][0] == first_key:
                base = carry[pid][1]
            else:
                base = None
            for i, n in enumerate(val_names):
                cs = pdf[tmp[n]].groupby(gid).cumsum()
                if base is not None:
                    cs = cs + (gid == gid.iat[0]) * base[i]
                out[n] = cs.astype("int64")
            state_key = _null_safe(keys.iloc[-1])
            last_mask = gid == gid.iat[-1]
            state_run = tuple(int(out[n][last_mask].iat[-1]) for n in val_names)
            yield out

    result = ranged.mapInPandas(number, out_schema)
    result = result.drop(_PID)
    if not group_cols:
        result = result.drop(_GRP)
    return (result, totals) if with_totals else result


def grouped_row_number(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column | str],
                       out: str = "row_number", num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group_cols order by order)`` as INT, skew-safe."""
    numbered = running_sums(df, group_cols, order, {out: F.lit(1)}, num_partitions)
    return numbered.withColumn(out, F.col(out).cast("int"))



def with_next(df: DataFrame, order: Sequence[Column], values: dict[str, Column], num_partitions: int | None = None) -> DataFrame:
    """Add, for each name, the expression's value in the next row of ``order`` (a total order), null in the last row.

    Rows are range-partitioned; within a partition a window looks ahead, and
    a partition's last row gets the first row of the next one that has any,
    from a table with one row per partition.
    """
    n = _partitions_for(df, num_partitions)
    ensure_checkpoint_dir(df.sparkSession)
    staged = df.withColumn(_GRP, F.struct(*[c.alias(k) for k, c in values.items()]))
    ranged = staged.repartitionByRange(n, *order).withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True)
    here = Window.partitionBy(_PID).orderBy(*order)
    firsts = ranged.withColumn("_cf_n", F.row_number().over(here)).where("_cf_n = 1").select(_PID, F.col(_GRP).alias("_cf_first"))
    after = firsts.select(_PID, F.lead("_cf_first").over(Window.orderBy(_PID)).alias("_cf_after"))
    out = ranged.withColumn("_cf_next", F.lead(_GRP).over(here)).join(after, _PID)
    found = F.coalesce("_cf_next", "_cf_after")
    return out.select(*df.columns, *[found[k].alias(k) for k in values])
