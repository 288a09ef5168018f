"""What each filter of a chain removes, in every order, from counts of failure masks.

Each document fails some of k filters: a mask of k bits. Counts of masks for each part (at most 2**k of them) say everything
about every order: the subset-zeta transform turns them into the survivors of every subset of filters, and what a step
removes is the difference between two neighbouring subsets. The same holds for counts of labelled documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

GAP = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: More filters have more than 5,040 orders.
MOST_FILTERS = 7
COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null: short, repetitive, loud, symbols."""
    words = F.array_remove(F.split(text, GAP), "")
    loud = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), "C": 100 * loud > 10 * F.length(text), "D": F.regexp_like(text, F.lit(r"[#$%&*|]"))}


def mask_of(conditions: list[Column]) -> Column:
    """Bit i is set where the i-th condition holds (null: does not)."""
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(conditions)]
    return sum(bits[1:], bits[0]).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, text: str = "text", part: str = "lang", key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, the last of which is "equal to an earlier text".

    filters: failure conditions that depend on the text alone, as Columns of `text` where null texts are empty; A to D unless given.
    A document is a copy if a row with a smaller key has the same text anywhere in docs. Rows without a key are no copies and make
    none; rows equal in key and text are not copies of each other. Null parts are the empty string. A document is good (toxic) if
    any of its labels says so; labels without a key or a document count nowhere.

    Only digests and masks are shuffled. A text of any number of copies is one row for each part and label before its group meets.
    """
    t = F.coalesce(col(text), F.lit(""))
    failing = text_filters(F.col("t")) if filters is None else filters
    slim = docs.select(col(key).alias("key"), F.coalesce(col(part), F.lit("")).alias("part"), t.alias("t"))
    slim = slim.select("key", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask_of(list(failing.values())).alias("mask"))
    # rows without a key meet no label: their digest spreads them
    slim = slim.withColumn("meet", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("~"), F.base64("digest"))))
    flags = labels.where(col(key).isNotNull()).groupBy(col(key).cast("string").alias("meet"))
    flags = flags.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = slim.join(flags, "meet", "left").fillna(0, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    rows = known.groupBy("meet", "key", *kinds).agg(F.count(F.lit(1)).alias("n"))  # needs no further shuffle
    # of each kind: all rows, the smallest key and the rows that have it
    kept = F.col("key").isNotNull()
    groups = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("key").alias("least"), F.min_by("n", F.when(kept, F.col("key"))).alias("at_least"), F.sum(F.when(kept, 0).otherwise(F.col("n"))).alias("keyless"))
    groups = groups.withColumn("first", F.min("least").over(Window.partitionBy("digest")))  # as many rows as parts and labels
    ahead = F.coalesce(F.when(F.col("least") == F.col("first"), F.col("at_least")), F.lit(0)) + F.col("keyless")
    copy = 1 << len(failing)
    sides = F.explode(F.array(F.struct(F.col("mask").alias("mask"), ahead.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - ahead).alias("n"))))
    x = groups.select("part", "good", "toxic", sides.alias("x")).select("part", "x.mask", "x.n", "good", "toxic").where("n > 0")
    return x.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def subset_sums(counts: Column, k: int) -> Column:
    """The subset-zeta transform of an array of 2**k counts: element s is the sum over all masks within s."""
    step = lambda a, bit: F.transform(a, lambda x, i: x + F.when(i.bitwiseAND(bit) > 0, F.get(a, i - bit)).otherwise(F.lit(0)))
    return F.aggregate(F.array(*(F.lit(1 << b) for b in range(k))), counts, step)


def survivors(counts: DataFrame, k: int, by: str = "part") -> DataFrame:
    """(by, n, good, toxic): arrays in which element s counts the documents that pass all filters of the set s."""
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    full = (1 << k) - 1
    masks = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))  # at most 2**k entries
    x = counts.groupBy(by).agg(masks.alias("masks"))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.element_at("masks", m)[c], F.lit(0)).cast("long"))
    x = x.select(by, *(subset_sums(dense(c), k).alias(c) for c in COUNTS))
    # what passes the set s fails only within the rest: the sum at its complement
    return x.select(by, *(F.reverse(c).alias(c) for c in COUNTS))


def audit(counts: DataFrame, filters: str, by: str = "part") -> DataFrame:
    """One row for each part, order of the filters (one letter each, in the order of their bits) and step; zeros included."""
    k = len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    x = survivors(counts, k, by)
    n = lambda s: F.get("n", F.lit(s))
    full = (1 << k) - 1
    shapley = []
    for f in filters:
        without = [s for s in range(full + 1) if not s & bit[f]]
        orders = lambda s: factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
        shapley.append(sum((orders(s) * (n(s) - n(s | bit[f])) for s in without), F.lit(0)))
    per = F.array(*(F.struct((n(0) - n(bit[f])).alias("fails"), (n(full ^ bit[f]) - n(full)).alias("unique_fails"), s.alias("shapley")) for f, s in zip(filters, shapley)))
    x = x.withColumn("per", per).withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))))
    x = x.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    letter = lambda i: F.instr(F.lit(filters), F.substring(F.col("filter_order"), i, F.lit(1))) - 1
    bit_at = lambda i: F.get(F.array(*map(F.lit, bit.values())), letter(i))
    # the set of filters up to a step, by the letters of the order
    upto = lambda j: F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda a, i: a + F.when(i <= j, bit_at(i)).otherwise(0))
    x = x.withColumns({"after": upto(F.col("step")), "before": upto(F.col("step") - 1), "own": F.get("per", letter(F.col("step")))})
    fell = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return x.select(by, "filter_order", "step", F.get("n", F.col("after")).alias("kept"), fell("n").alias("removed"), (F.col("own.fails") - fell("n")).alias("redundant"), "own.unique_fails", fell("good").alias("good_lost"), fell("toxic").alias("toxic_lost"), "own.shapley")
