"""How filters of a corpus overlap, whatever order they run in: a Walsh-Hadamard audit.

1. A document's mask has a bit for every filter it fails. Which of several rows of one text comes first is known from a
   grouped minimum of ids per text digest, and asked by text and id, so that a text held by very many rows meets nowhere.
2. For each part and label class one aggregation gives 32 signed sums: for every set of filters, documents count +1 or
   -1 by the parity of their failures in it. Nothing else leaves the documents, and parts or shards of a corpus add up.
3. The transform is its own inverse but for the factor 32: it gives back exactly how many documents have each mask.
4. The 32 cells answer all 120 orders. A document falls to the first of its filters, and each of its k failures comes
   first in 120 / k of the orders: the Shapley value needs no order at all.

Everything runs as DataFrame expressions.

Defined cases: a null text is empty (it fails A alone, and E where an earlier text is empty), a null part is the empty
string; rows that repeat id and text are each counted, and none is later than the other; a null id is later than every
other and not than another null; a document is good or toxic if any of its label rows says so, and neither without one;
labels of null or unknown ids count nowhere; texts of any length count whole; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SUM = "aggregate(transform({of}, (v, m) -> IF({when}, {take}, 0L)), 0L, (a, x) -> a + x)"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09 to \\x0D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def failures(text: Column, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, marks: str = "#$%&*|") -> Column:
    """The bits of the filters that look at the text alone: few words, few different words, capitals, marks."""
    n = F.size(words(text))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    tests = [n < min_words, 100 * F.size(F.array_distinct(words(text))) < distinct_percent * n, 100 * upper > upper_percent * F.length(text), text.rlike("[" + marks + "]")]
    out = F.lit(0)
    for bit, test in enumerate(tests):
        out = out.bitwiseOR(F.when(test, 1 << bit).otherwise(0))
    return out


def masks(docs: DataFrame, part: str) -> DataFrame:
    """id, part, mask and n, the rows that share all of these and their text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), failures(text).alias("mask"))
    rows = rows.groupBy("id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("*", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("key"))
    # the first holder of a text doesn't repeat it, and a null id repeats it if anyone holds it
    first = rows.where("id is not null").groupBy("h").agg(F.min("id").alias("first"))
    told = "inline(array(named_struct('none', false, 'key', first, 'late', false), named_struct('none', true, 'key', 0L, 'late', true)))"
    first = first.selectExpr("h", told)
    late = F.coalesce(F.col("late"), ~F.col("none"))
    return rows.join(first, ["h", "none", "key"], "left").select("id", "part", "h", F.col("mask").bitwiseOR(F.when(late, 16).otherwise(0)).alias("mask"), "n")


def parity_sums(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, label (1 good, 2 toxic, 3 both, else 0) and p, the 32 signed sums; those of several tables may be added."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    rows = masks(docs, part).select("part", "mask", "n", F.col("id").isNull().alias("none"), F.coalesce("id", F.xxhash64("h")).alias("key"))  # null ids are spread
    rows = rows.join(said.withColumn("none", F.lit(False)), ["none", "key"], "left")
    label = F.coalesce(F.col("good") + 2 * F.col("toxic"), F.lit(0)).alias("label")
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    return rows.groupBy("part", label).agg(F.array(*[F.sum(F.col("n") * sign(s)) for s in range(32)]).alias("p"))


def cells(sums: DataFrame) -> DataFrame:
    """part, and arrays of 32 counts by mask: `every`, `good` and `toxic`."""
    back = "transform(sequence(0, 31), m -> aggregate(transform(p, (v, s) -> v * (1 - 2 * (bit_count(m & s) % 2))), 0L, (a, x) -> a + x) div 32)"
    one = sums.select("part", "label", F.posexplode(F.expr(back)).alias("mask", "n"))
    of = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(0))
    one = one.groupBy("part", "mask").agg(F.sum("n").alias("every"), of(1).alias("good"), of(2).alias("toxic"))
    in_order = lambda c: F.expr(f"transform(array_sort(collect_list(struct(mask, {c}))), x -> x.{c})").alias(c)
    return one.groupBy("part").agg(*[in_order(c) for c in ("every", "good", "toxic")])  # 32 of each


def orders(counts: DataFrame) -> DataFrame:
    """A row per part, order and step, of the cells' answers."""
    every_order = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counts.withColumn("filter_order", F.explode(every_order)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
    rows = rows.withColumn("before", F.expr("aggregate(split(substring(filter_order, 1, step - 1), ''), 0, (a, c) -> a | IF(c = '', 0, shiftleft(1, ascii(c) - 65)))"))
    here = "(m & bit) <> 0 AND (m & before) = 0"
    of = lambda when, cells="every", take="v": F.expr(_SUM.format(of=cells, when=when, take=take))
    return rows.select(
        "part", "filter_order", "step",
        of("(m & (bit | before)) = 0").alias("kept"),
        of(here).alias("removed"),
        of("(m & bit) <> 0 AND (m & before) <> 0").alias("redundant"),
        of("m = bit").alias("unique_fails"),
        of(here, "good").alias("good_lost"),
        of(here, "toxic").alias("toxic_lost"),
        of("(m & bit) <> 0", take="v * (120 div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(cells(parity_sums(docs, labels, part)))
