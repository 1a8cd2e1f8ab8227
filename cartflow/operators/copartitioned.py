"""The feature table from tables that are kept by user.

Pairs, user features and future orders are bucketed by user once; the joins of
any number of later runs read bucket against bucket, without an exchange of any
of the three.  Pairs of hot users lie in a plain table of their own and take an
ordinary join, whose partitions can be split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.bucketed import write_bucketed, write_by_key
from .features import FEATURES, future_orders


@dataclass
class UserStore:
    pairs: DataFrame
    hot_pairs: DataFrame
    users: DataFrame


def store(uxp: DataFrame, user: DataFrame, orders: DataFrame, buckets: int, hot_rows: int = 1_000_000) -> UserStore:
    """Writes the pairs and, for every user, features and future order, by user."""
    pairs, hot = write_by_key(uxp, "user_id", buckets, "pairs", hot_rows)
    features = write_bucketed(user, "user_id", buckets, "users")
    future = write_bucketed(future_orders(orders), "user_id", buckets, "future")
    # both are bucketed by user: joined without an exchange, and written so again
    users = write_bucketed(features.join(future, "user_id", "full"), "user_id", buckets, "users_future")
    return UserStore(pairs, hot, users)


def feature_table(kept: UserStore, prd: DataFrame) -> DataFrame:
    """T5 from the store; products (one row each) are joined as their measured size allows."""
    columns = ["user_id", "product_id", *FEATURES, "eval_set", "order_id"]
    by_bucket = kept.pairs.join(kept.users, "user_id", "left")
    hot = kept.hot_pairs.join(kept.users, "user_id", "left")
    return by_bucket.unionByName(hot).join(prd, "product_id", "left").select(*columns)
