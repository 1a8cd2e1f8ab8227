"""Equal baskets are counted once, with their number."""

import itertools
import random

from cartflow.operators import baskets
from cartflow.sources import schemas


def test_equal_baskets_are_one_row_and_all_counted(spark):
    rng = random.Random(5)
    kinds = [sorted(rng.sample(range(9), rng.randint(1, 5))) for _ in range(20)]
    held = {o: kinds[o % len(kinds)] for o in range(400)} | {o: list(range(12)) for o in (1000, 1001)}  # two equal ones of several blocks
    df = spark.createDataFrame([(o, p, 0) for o, items in held.items() for p in items], schemas.ORDER_LINES)
    merged = baskets._equal_merged(baskets._tiles(df, 6)).collect()
    small = [t for t in merged if t.order_id < 1000]
    assert len(small) == len({tuple(k) for k in kinds if len(k) > 1}) and sum(t.n for t in small) == sum(len(i) > 1 for o, i in held.items() if o < 1000)
    assert all(t.n == 1 for t in merged if t.order_id >= 1000)

    def plain(size, least):
        n = {}
        for items in held.values():
            for c in itertools.combinations(items, size):
                n[c] = n.get(c, 0) + 1
        return {c: k for c, k in n.items() if k >= least * len(held)}

    assert {(r.item_a, r.item_b): r.n_orders for r in baskets.frequent_pairs(df, 0.02).collect()} == plain(2, 0.02)
    assert {(r.item_a, r.item_b, r.item_c): r.n_orders for r in baskets.frequent_triples(df, 0.02).collect()} == plain(3, 0.02)
    for block in (6, 1000):
        assert {tuple(r["items"]): r.n_orders for r in baskets.frequent_itemsets(df, 0.02, 4, block).collect()} == plain(4, 0.02)
