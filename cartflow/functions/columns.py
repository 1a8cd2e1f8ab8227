"""Small column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier and modulus of the seeded split hash; fixed so that the same
# key lands on the same side in Spark and in SQL, at any partitioning.
_SPLIT_MULT = 2654435761
_SPLIT_MOD = 1_000_003


def hash_fraction(*keys: Column, seed: int = 42) -> Column:
    """A deterministic value in [0, 1) from integer keys and a seed.

    Plain integer arithmetic (no engine-specific hash), so a DuckDB query can
    compute the same number (:func:`hash_fraction_sql`): each key is reduced
    modulo ``P`` and folded as ``h = (h * M + k) % P``, starting from the
    seed, then mixed once more by ``h = (h * h + seed) % P`` and
    ``h = h * M % P``; the result is ``h / P``.  All products stay below 2**63.
    """
    h = F.lit(seed % _SPLIT_MOD).cast("long")
    for key in keys:
        k = F.abs(key.cast("long")) % F.lit(_SPLIT_MOD)
        h = (h * F.lit(_SPLIT_MULT) + k) % F.lit(_SPLIT_MOD)
    # A squaring round, so that two seeds are not a constant shift apart.
    h = (h * h + F.lit(seed % _SPLIT_MOD)) % F.lit(_SPLIT_MOD)
    h = (h * F.lit(_SPLIT_MULT)) % F.lit(_SPLIT_MOD)
    return h / F.lit(float(_SPLIT_MOD))


def hash_fraction_sql(*keys_sql: str, seed: int = 42) -> str:
    """The SQL text of :func:`hash_fraction` (DuckDB / Spark SQL)."""
    h = f"CAST({seed % _SPLIT_MOD} AS BIGINT)"
    for k in keys_sql:
        h = f"(({h}) * {_SPLIT_MULT} + abs(CAST({k} AS BIGINT)) % {_SPLIT_MOD}) % {_SPLIT_MOD}"
    h = f"(({h}) * ({h}) + {seed % _SPLIT_MOD}) % {_SPLIT_MOD}"
    h = f"(({h}) * {_SPLIT_MULT}) % {_SPLIT_MOD}"
    return f"({h}) / {float(_SPLIT_MOD)}"


def threshold_flag(score: Column, threshold: float) -> Column:
    """1 when ``score >= threshold`` (inclusive bound), else 0, as INT."""
    return (score >= F.lit(float(threshold))).cast("int")
