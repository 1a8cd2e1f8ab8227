"""Frequent itemsets by partition matrices against a brute-force count."""

from itertools import combinations

from cartflow.operators import baskets as B


def _lines(spark):
    baskets = {1: [1, 2, 3], 2: [1, 2], 3: [2, 3, 4], 4: [1, 2, 3, 4], 5: [5], 6: [1, 3], 7: [2, 3]}
    data = [(o, p, 0) for o, items in baskets.items() for p in items]
    return spark.createDataFrame(data, "order_id long, product_id long, reordered int"), baskets


def _brute(baskets, k, support):
    n = len(baskets)
    counts = {}
    for items in baskets.values():
        for c in combinations(sorted(items), k):
            counts[c] = counts.get(c, 0) + 1
    return {c: v for c, v in counts.items() if v >= support * n}


def test_pairs_and_triples(spark):
    lines, baskets = _lines(spark)
    pairs = {(r["item_a"], r["item_b"]): r["n_orders"] for r in B.frequent_pairs(lines, 0.25).collect()}
    assert pairs == _brute(baskets, 2, 0.25)
    triples = {(r["item_a"], r["item_b"], r["item_c"]): r["n_orders"]
               for r in B.frequent_triples(lines, 0.2).collect()}
    assert triples == _brute(baskets, 3, 0.2)


def test_rules_match_fp_growth(spark):
    lines, _ = _lines(spark)
    ours = {(r["antecedent"], r["consequent"]): round(r["confidence"], 9)
            for r in B.association_rules(lines, 0.25).collect()}
    model = B.fp_growth(lines, 0.25)
    theirs = {(r["antecedent"][0], r["consequent"][0]): round(r["confidence"], 9)
              for r in model.associationRules.collect() if len(r["antecedent"]) == 1}
    assert ours == theirs
