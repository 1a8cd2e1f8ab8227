"""Baskets, frequent itemsets and association rules.

Frequent pairs and triples are counted level-wise (Apriori): only frequent
items can be in a frequent pair, only triples whose three sub-pairs are
frequent can be frequent.  Frequent items and pairs stay DataFrames, joined
by key; nothing is gathered on the driver and no size stops a job.  Tasks
count the pairs or triples of their baskets chunk by chunk, equal ones added
up before the shuffle, and Spark sums the partial counts.  A basket of many
frequent items is cut into blocks, and every pair of blocks is a row of its own,
so that a huge basket's pairs are shared by as many tasks as they need.  Baskets
of one block with the same frequent items are one row with their number from
then on, whichever orders they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 500_000  # pairs or triples that a task holds before it adds up equal ones
_BLOCK = 1000  # items of a basket that a task pairs with each other or with another block's


def baskets(lines: DataFrame) -> DataFrame:
    """B1: one row per order: its distinct products, ascending, as an array and a string.

    A basket is bounded by the product catalogue.
    """
    b = lines.groupBy("order_id").agg(F.array_sort(F.collect_set("product_id")).alias("items"))
    return b.select("order_id", "items", F.size("items").cast("long").alias("n_items"),
                    F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("products"))


def _frequent_items(lines: DataFrame, min_support: float):
    """(distinct order items, number of baskets, least count, frequent items with n_orders)."""
    pairs = lines.select("order_id", "product_id").distinct().checkpoint(eager=True)
    n_baskets = pairs.select("order_id").distinct().count()
    min_count = min_support * n_baskets
    items = (pairs.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_orders"))
             .where(F.col("n_orders") >= F.lit(min_count))).checkpoint(eager=True)
    return pairs, n_baskets, min_count, items


def _summed(columns: list[list[np.ndarray]], names: list[str]) -> pd.DataFrame:
    """Equal rows of a chunk once, with the sum of their numbers (the last column)."""
    frame = pd.DataFrame({n: np.concatenate(c) for n, c in zip([*names, "n"], columns)})
    return frame.groupby(names, sort=False)["n"].sum().reset_index()


def _pair_rows(batches):
    """Tiles (items of a basket's block, those of another one, number of such baskets) -> partial counts of their pairs, chunk by chunk."""
    out, held = [[], [], []], 0
    for pdf in batches:
        for items, others, n in zip(pdf["items"], pdf["others"] if "others" in pdf else [None] * len(pdf), pdf["n"] if "n" in pdf else [1] * len(pdf)):
            items = np.asarray(items, dtype=np.int64)
            for i in range(len(items)):
                near = items[i + 1:] if others is None else np.asarray(others, dtype=np.int64)
                one = np.full(len(near), items[i])
                for column, values in zip(out, (np.minimum(one, near), np.maximum(one, near), np.full(len(near), n, np.int64))):
                    column.append(values)
                held += len(near)
                if held >= _CHUNK:
                    yield _summed(out, ["item_a", "item_b"])
                    out, held = [[], [], []], 0
    if held:
        yield _summed(out, ["item_a", "item_b"])


def basket_tiles(lines: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Rows ``order_id, i, j, items, others``: every pair of a basket's blocks (a block with itself: no others) of distinct lines.

    Items are dealt into ``ceil(size / block)`` blocks of their basket by a hash,
    so no row holds a whole basket, and every pair of items is in one tile.
    """
    return _tiles(lines, block).select("order_id", "i", "j", "items", "others")


def _tiles(lines: DataFrame, block: int) -> DataFrame:
    """The tiles, with the number of their basket's blocks."""
    sizes = (lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select("order_id", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocks")).checkpoint(eager=True))
    dealt = lines.join(sizes, "order_id").withColumn("_b", F.pmod(F.xxhash64("product_id"), F.col("_blocks")).cast("int"))
    lists = dealt.groupBy("order_id", "_blocks", "_b").agg(F.array_sort(F.collect_list("product_id")).alias("items"))
    met = lists.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return (met.groupBy("order_id", "_blocks", F.least("_b", "_c").alias("i"), F.greatest("_b", "_c").alias("j"))
            .agg(F.collect_list("items").alias("_lists")).where((F.col("i") == F.col("j")) | (F.size("_lists") == 2))
            .select("order_id", "_blocks", "i", "j", F.get("_lists", F.lit(0)).alias("items"), F.get("_lists", F.lit(1)).alias("others")))


def _equal_merged(tiles: DataFrame) -> DataFrame:
    """Tiles ``order_id, items, others, n``: baskets of one block with the same items once, with their number and one of their orders.

    Tiles of larger baskets stay their order's, as sets of more than two items meet across them.
    """
    own = F.when(F.col("_blocks") > 1, F.col("order_id")).alias("_own")
    return (tiles.groupBy(own, "i", "j", "items", "others").agg(F.min("order_id").alias("order_id"), F.count(F.lit(1)).alias("n"))
            .select("order_id", "items", "others", "n"))


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """Rows ``order_id, n, item_a, item_b``: the pairs of each tile."""
    each = tiles.select("order_id", "n", "items", "others", F.posexplode("items").alias("_at", "_x"))
    near = F.when(F.col("others").isNull(), F.slice("items", F.col("_at") + 2, F.size("items"))).otherwise(F.col("others"))
    return (each.select("order_id", "n", "_x", F.explode(near).alias("_y"))
            .select("order_id", "n", F.least("_x", "_y").cast("long").alias("item_a"), F.greatest("_x", "_y").cast("long").alias("item_b")))


def _triple_rows(batches):
    """Baskets as their frequent pairs, with their number -> partial counts of triples whose three pairs are frequent."""
    out, held = [[], [], [], []], 0
    for pdf in batches:
        for pairs, n in zip(pdf["pairs"], pdf["n"]):
            after: dict[int, set[int]] = {}
            for p in pairs:
                after.setdefault(p["item_a"], set()).add(p["item_b"])
            for x, near in after.items():
                for y in near:
                    third = near & after.get(y, set())
                    if third:
                        c = np.fromiter(third, np.int64, len(third))
                        for column, values in zip(out, (np.full(len(c), x), np.full(len(c), y), c, np.full(len(c), n, np.int64))):
                            column.append(values)
                        held += len(c)
                        if held >= _CHUNK:
                            yield _summed(out, ["item_a", "item_b", "item_c"])
                            out, held = [[], [], [], []], 0
    if held:
        yield _summed(out, ["item_a", "item_b", "item_c"])


def _pair_counts(lines: DataFrame, min_support: float):
    """(frequent pairs with n_orders, n_baskets, least count, frequent items, merged tiles of the baskets' frequent items)."""
    pairs, n_baskets, min_count, items = _frequent_items(lines, min_support)
    frequent = pairs.join(items.select("product_id"), "product_id", "left_semi")
    tiles = _equal_merged(_tiles(frequent, _BLOCK)).checkpoint(eager=True)
    counts = (tiles.select("items", "others", "n").mapInPandas(_pair_rows, "item_a long, item_b long, n long")
              .groupBy("item_a", "item_b").agg(F.sum("n").alias("n_orders"))
              .where(F.col("n_orders") >= F.lit(min_count)))
    return counts, n_baskets, min_count, items, tiles


def frequent_pairs(lines: DataFrame, min_support: float = 0.02) -> DataFrame:
    """B3 (k = 2): item_a < item_b, n_orders, support; pairs with support >= min_support."""
    counts, n_baskets, *_ = _pair_counts(lines, min_support)
    return counts.select("item_a", "item_b", "n_orders", (F.col("n_orders") / F.lit(float(n_baskets))).alias("support"))


def frequent_triples(lines: DataFrame, min_support: float = 0.002) -> DataFrame:
    """B3 (k = 3): item_a < item_b < item_c with support >= min_support.

    Candidates: every sub-pair frequent (Apriori).  Each basket keeps its
    frequent pairs (a join by pair), and tasks count the triangles in them.
    """
    counts, n_baskets, min_count, _, tiles = _pair_counts(lines, min_support)
    frequent = counts.select("item_a", "item_b").checkpoint(eager=True)
    held = (_tile_pairs(tiles).join(frequent, ["item_a", "item_b"], "left_semi")
            .groupBy("order_id", "n").agg(F.collect_list(F.struct("item_a", "item_b")).alias("pairs")).where(F.size("pairs") > 2))
    return (held.select("pairs", "n").mapInPandas(_triple_rows, "item_a long, item_b long, item_c long, n long")
            .groupBy("item_a", "item_b", "item_c").agg(F.sum("n").alias("n_orders"))
            .where(F.col("n_orders") >= F.lit(min_count))
            .select("item_a", "item_b", "item_c", "n_orders", (F.col("n_orders") / F.lit(float(n_baskets))).alias("support")))


def frequent_itemsets(lines: DataFrame, min_support: float, size: int, block: int = _BLOCK) -> DataFrame:
    """B3 at any level: ``items`` (ascending array), ``n_orders``, ``support`` of sets of ``size`` items.

    Level by level: candidates of k items come from frequent sets of k - 1 that
    share all but the last item, and all their subsets must be frequent.  What
    a basket holds is kept as rows (order, number of equal baskets, set without its
    last item, last item); a candidate's occurrences are pairs of such rows with the same
    first part, so even one basket's are spread over many keys.
    """
    pairs, n_baskets, min_count, items = _frequent_items(lines, min_support)
    of = lambda df: df.select("items", "n_orders", (F.col("n_orders") / F.lit(float(n_baskets))).alias("support"))
    if size == 1:
        return of(items.select(F.array("product_id").alias("items"), "n_orders"))
    kept = pairs.join(items.select("product_id"), "product_id", "left_semi")
    # occurrences of pairs, tile by tile
    held = (_tile_pairs(_equal_merged(_tiles(kept, block)))
            .select("order_id", "n", F.array("item_a").alias("head"), F.col("item_b").alias("last")))
    level = 2
    while True:
        held = held.checkpoint(eager=True)
        counted = held.groupBy("head", "last").agg(F.sum("n").alias("n_orders")).where(F.col("n_orders") >= F.lit(min_count)).checkpoint(eager=True)
        if level == size:
            return of(counted.select(F.concat("head", F.array("last")).alias("items"), "n_orders"))
        known = counted.select("head", "last")
        occurs = held.join(known, ["head", "last"], "left_semi").checkpoint(eager=True)
        longer = (known.join(known.select("head", F.col("last").alias("next")), "head").where("last < next")
                  .select(F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last")))
        # every subset without one of the first items is frequent too (those without the last two are by the join)
        for i in range(level - 1):
            rest = [F.concat(F.slice("head", 1, i), F.slice("head", i + 2, level - 1 - i)).alias("_head"), F.col("last").alias("_last")]
            checked = longer.select("head", "last", *rest)
            sets = known.select(F.col("head").alias("_head"), F.col("last").alias("_last"))
            longer = checked.join(sets, ["_head", "_last"], "left_semi").select("head", "last")
        longer = longer.checkpoint(eager=True)
        both = (occurs.join(occurs.select("order_id", "head", F.col("last").alias("next")), ["order_id", "head"]).where("last < next")
                .select("order_id", "n", F.concat("head", F.array("last")).alias("head"), F.col("next").alias("last")))
        held = both.join(longer, ["head", "last"], "left_semi")
        level += 1


def association_rules(lines: DataFrame, min_support: float = 0.02, min_confidence: float = 0.0) -> DataFrame:
    """Rules antecedent -> consequent over frequent pairs, both directions.

    support = n(a, b) / N, confidence = n(a, b) / n(a), lift = confidence / support(b).
    Both items of a frequent pair are frequent, so their counts come from the
    frequent-item table.
    """
    counts, n_baskets, _, items, _ = _pair_counts(lines, min_support)
    nb = float(n_baskets)
    fp = (counts.join(items.select(F.col("product_id").alias("item_a"), F.col("n_orders").alias("n_a")), "item_a")
          .join(items.select(F.col("product_id").alias("item_b"), F.col("n_orders").alias("n_b")), "item_b"))
    both = (fp.select(F.col("item_a").alias("antecedent"), F.col("item_b").alias("consequent"), "n_orders",
                      F.col("n_a").alias("_na"), F.col("n_b").alias("_nc"))
            .unionByName(fp.select(F.col("item_b").alias("antecedent"), F.col("item_a").alias("consequent"),
                                   "n_orders", F.col("n_b").alias("_na"), F.col("n_a").alias("_nc"))))
    conf = F.col("n_orders") / F.col("_na")
    return (both.select("antecedent", "consequent", "n_orders", (F.col("n_orders") / F.lit(nb)).alias("support"),
                        conf.alias("confidence"), (conf / (F.col("_nc") / F.lit(nb))).alias("lift"))
            .where(F.col("confidence") >= F.lit(min_confidence)))


def fp_growth(lines: DataFrame, min_support: float = 0.02, min_confidence: float = 0.0):
    """B2: ``pyspark.ml.fpm.FPGrowth`` fitted on the baskets; returns the model."""
    from pyspark.ml.fpm import FPGrowth
    b = baskets(lines).select("items")
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(b)
