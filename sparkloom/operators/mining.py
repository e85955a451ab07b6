"""Frequent itemsets and association rules.

Pairs are counted by a grouped count. Longer sets are candidates whose subsets are all frequent; a level of them is counted
in one pass over the baskets, by bitmaps of a batch of baskets per item, so that what is held never grows with a set's
occurrences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import cut


def basket_items(baskets: DataFrame, tid: str, items: str) -> DataFrame:
    """tid and item (text), each pair once; null items and baskets without items go."""
    return baskets.select(F.col(tid).alias("tid"), F.explode(F.col(items)).alias("item")).where("item is not null").select("tid", F.col("item").cast("string").alias("item")).distinct()


def candidates(level: Sequence[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets of one item more than those of a sorted level, all of whose subsets are in it."""
    held, out, at = set(level), [], 0
    while at < len(level):
        head, end = level[at][:-1], at
        while end < len(level) and level[end][:-1] == head:
            end += 1
        tails = [s[-1] for s in level[at:end]]
        for i, a in enumerate(tails):
            for b in tails[i + 1 :]:
                new = (*head, a, b)
                if all(new[:k] + new[k + 1 :] in held for k in range(len(head))):
                    out.append(new)
        at = end
    return out


def _counted(sets: np.ndarray, step: int = 4096):
    """Baskets of each batch that hold each set: number of the set, and count."""
    items = np.unique(sets)
    place = np.searchsorted(items, sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["ks"].map(len).to_numpy()
            ks = np.concatenate([np.zeros(0, "i8"), *batch["ks"]]).astype("i8")
            row = np.repeat(np.arange(len(batch)), size)
            at = np.minimum(np.searchsorted(items, ks), len(items) - 1)
            known = items[at] == ks
            bits = np.zeros((len(items), len(batch)), bool)
            bits[at[known], row[known]] = True
            bits = np.packbits(bits, axis=1)
            n = np.zeros(len(sets), "i8")
            for low in range(0, len(sets), step):
                some = bits[place[low : low + step, 0]]
                for k in range(1, sets.shape[1]):
                    some = some & bits[place[low : low + step, k]]
                n[low : low + step] = np.bitwise_count(some).sum(1, dtype="i8")
            on = np.flatnonzero(n)
            yield pd.DataFrame({"s": on, "n": n[on]})

    return run


def frequent_itemsets(rows: DataFrame, min_support: float, max_size: int = 0, most: int = 2_000_000) -> tuple[DataFrame, int]:
    """items (sorted array), size and n (baskets that hold them all) for every frequent itemset, and the basket count.

    `rows` has tid and item, each pair once. Frequent sets and the candidates of a level are on the driver and go to the
    tasks: more than `most` of them are refused. max_size 0 means no limit.
    """
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be above 0 and at most 1")
    spark = rows.sparkSession
    n = rows.select("tid").distinct().count()
    least = max(1, math.ceil(min_support * n - 1e-9))

    def checked(found: list) -> list:
        if len(found) > most:
            raise ValueError(f"over {most} itemsets of one size: raise min_support or limit max_size")
        return found

    single = checked(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).limit(most + 1).collect())
    names = sorted(r["item"] for r in single)
    found = [([r["item"]], 1, r["n"]) for r in single]
    if len(names) > 1 and max_size != 1:
        index = spark.createDataFrame(list(enumerate(names)), "k int, item string")
        baskets = cut(rows.join(index, "item").groupBy("tid").agg(F.sort_array(F.collect_list("k")).alias("ks")).where(F.size("ks") > 1).select("ks"))  # at most the frequent items
        pairs = F.expr("flatten(transform(ks, (a, i) -> transform(slice(ks, i + 2, size(ks)), b -> named_struct('a', a, 'b', b))))")
        twos = baskets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        level = {(r["a"], r["b"]): r["n"] for r in checked(twos.limit(most + 1).collect())}
        size = 2
        while level:
            found += [([names[k] for k in s], size, c) for s, c in level.items()]
            if size == max_size:
                break
            new = checked(candidates(sorted(level)))
            if not new:
                break
            counts = baskets.where(F.size("ks") > size).mapInPandas(_counted(np.array(new, "i8")), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            level, size = {new[r["s"]]: r["n"] for r in counts.collect()}, size + 1
    return spark.createDataFrame(found, "items array<string>, size int, n long"), n


def rules(itemsets: DataFrame, n: int, min_confidence: float, most: int = 30) -> DataFrame:
    """antecedent, consequent (arrays), support, confidence, lift, n_both of all rules from every frequent itemset.

    Every non-empty proper subset of an itemset can be the antecedent; subsets of a frequent set are frequent, so their
    counts come from two joins. A set of n items has 2^n - 2 rules: sets of over `most` items are refused.
    """
    if not 0 < min_confidence <= 1:
        raise ValueError("min_confidence must be above 0 and at most 1")
    if (largest := itemsets.agg(F.max("size")).first()[0] or 0) > most:
        raise ValueError(f"an itemset of {largest} items has 2^{largest} - 2 rules; limit itemsets by max_size, to {most} or fewer")
    many = itemsets.where(F.col("size") > 1).select("items", F.col("n").alias("n_both"), F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size) - 2"))).alias("mask"))
    bit = lambda want: F.expr(f"filter(items, (x, i) -> (mask div cast(pow(2, i) as bigint)) % 2 = {want})")
    parts = many.select("n_both", bit(1).alias("antecedent"), bit(0).alias("consequent"))
    count = itemsets.select("items", "n")
    out = parts.join(count.select(F.col("items").alias("antecedent"), F.col("n").alias("n_a")), "antecedent")
    out = out.where(F.col("n_both") / F.col("n_a") >= min_confidence - 1e-12)
    out = out.join(count.select(F.col("items").alias("consequent"), F.col("n").alias("n_c")), "consequent")
    confidence = F.col("n_both") / F.col("n_a")
    return out.select("antecedent", "consequent", (F.col("n_both") / F.lit(n)).alias("support"), confidence.alias("confidence"), (confidence * F.lit(n) / F.col("n_c")).alias("lift"), "n_both")


def association_rules(baskets: DataFrame, tid: str, items: str, min_support: float, min_confidence: float, max_size: int = 0) -> DataFrame:
    """Rules of baskets with an array of items: highest confidence first, then support, then the shorter antecedent."""
    found, n = frequent_itemsets(basket_items(baskets, tid, items), min_support, max_size)
    return rules(found, n, min_confidence).orderBy(F.desc("confidence"), F.desc("support"), F.size("antecedent"), "antecedent", "consequent")
