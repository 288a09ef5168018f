"""Translation metrics over pairs of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .coverage import ratio

#: White space as Python's str.split() has it.
GAP = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def numeric_consistency(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of the sources' distinct numbers that the translations have; 1 where there is none."""
    s, t = tx.numbers("source_text"), tx.numbers("translated_text")
    x = pairs.select(*by, F.size(s).alias("n"), F.size(F.array_intersect(s, t)).alias("m")).groupBy(*by).agg(F.sum("n").alias("numbers"), F.sum("m").alias("kept"))
    return x.withColumn("consistency", ratio(F.col("kept"), F.col("numbers")))


def layout_fidelity(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Share of blocks with a box that have a translation."""
    boxed = F.col("x0").isNotNull()
    n, m = F.count_if(boxed), F.count_if(boxed & ~tx.blank("translated_text"))
    return blocks.groupBy(*by).agg(n.alias("boxed"), m.alias("filled"), ratio(m, n).alias("fidelity"))


def _codes(texts: pd.Series, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts' words (or characters that aren't white space), one after the other, and offsets of each text."""
    parts = [t.split() for t in texts] if words else ["".join(t.split()) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    if not words:
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64), off
    return pd.factorize(np.array([w for p in parts for w in p], object))[0].astype(np.int64), off


def _common(h: pd.Series, r: pd.Series, most: int, words: bool) -> np.ndarray:
    """For each pair of texts (rows) and order (columns): n-grams in common, each as often as in both, for all pairs of a batch at once."""
    code, off = _codes(pd.concat([h, r]), words)
    n, out = len(h), np.zeros((len(h), most), np.int64)
    size = np.diff(off)
    text = np.repeat(np.arange(2 * n), size)
    room = np.repeat(off[1:], size) - np.arange(len(code))  # units up to the text's end
    gram = np.unique(code, return_inverse=True)[1].astype(np.int64)  # numbers of n-grams of one order
    unit, kinds = gram, int(gram.max()) + 1 if len(gram) else 1
    for k in range(most):
        if k:
            at = np.flatnonzero(room > k)
            longer = np.full(len(code), -1, np.int64)
            longer[at] = np.unique(gram[at] * kinds + unit[at + k], return_inverse=True)[1]
            gram = longer
        at = np.flatnonzero(room > k)
        if not len(at):
            break
        # how often each pair's side has each n-gram; the smaller side counts
        most_grams = int(gram[at].max()) + 1
        pair, left = text[at] % n, text[at] < n
        key = pair * most_grams + gram[at]
        a, ca = np.unique(key[left], return_counts=True)
        b, cb = np.unique(key[~left], return_counts=True)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        np.add.at(out[:, k], both // most_grams, np.minimum(ca[i], cb[j]))
    return out


def _clipped(pairs: DataFrame, by: list[str], hyp: Column, ref: Column, most: int, words: bool) -> DataFrame:
    """For each group and order: n-grams of hypotheses, of references, and those in common (each at most as often as in both).

    Lengths give the first two, and the third of equal texts. Only pairs that differ are counted, by numbers of n-grams of a whole
    batch in an Arrow UDF: exploding n-grams into rows took ten times as long.
    """
    h, r = (F.coalesce(c, F.lit("")) for c in (hyp, ref))
    e = pairs.select(*by, h.alias("_h"), r.alias("_r"))
    size = (lambda c: F.size(F.array_remove(F.split(c, GAP), ""))) if words else (lambda c: F.length(F.regexp_replace(c, GAP, "")))
    e = e.withColumn("_hs", size(F.col("_h"))).withColumn("_rs", F.when(F.col("_h") == F.col("_r"), F.col("_hs")).otherwise(size(F.col("_r"))))

    @F.pandas_udf("array<long>")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype=object)
        there = np.flatnonzero(a.notna())
        if len(there):
            out.iloc[there] = list(_common(a.iloc[there], b.iloc[there], most, words))
        return out

    differ = (F.col("_h") != F.col("_r")) & (F.col("_hs") > 0) & (F.col("_rs") > 0)
    e = e.withColumn("_m", common(F.when(differ, F.col("_h")), F.when(differ, F.col("_r"))))
    grams = lambda c, n: F.greatest(F.lit(0), F.col(c) - n + 1).cast("long")
    same = lambda n: F.when(F.col("_h") == F.col("_r"), grams("_hs", n)).otherwise(F.lit(0))
    orders = F.array(*(F.struct(F.lit(n).alias("n"), grams("_hs", n).alias("h"), grams("_rs", n).alias("r"), F.coalesce(F.get("_m", F.lit(n - 1)), same(n)).alias("m")) for n in range(1, most + 1)))
    x = e.select(*by, F.explode(orders).alias("x"))
    return x.groupBy(*by, "x.n").agg(*(F.sum(f"x.{c}").alias(c) for c in ("h", "r", "m")))


def bleu(pairs: DataFrame, by: list[str], hyp: str = "hypothesis", ref: str = "reference") -> DataFrame:
    """Corpus BLEU (0 to 1) over white-space tokens, orders 1 to 4, exponential smoothing of orders without a match."""
    counts = _clipped(pairs, by, F.col(hyp), F.col(ref), 4, True)
    rows = F.array_sort(F.collect_list(F.struct("n", "h", "r", "m")))
    per = counts.groupBy(*by).agg(rows.alias("o"))
    step = lambda a, x: F.struct(
        F.when(x["m"] == 0, a["k"] * 2).otherwise(a["k"]).alias("k"),
        (a["s"] + F.when(x["h"] > 0, F.log(F.when(x["m"] == 0, 1 / (a["k"] * 2 * x["h"])).otherwise(x["m"] / x["h"]))).otherwise(F.lit(0.0))).alias("s"),
        (a["c"] + F.when(x["h"] > 0, 1).otherwise(0)).alias("c"),
    )
    logs = F.aggregate("o", F.struct(F.lit(1.0).alias("k"), F.lit(0.0).alias("s"), F.lit(0).alias("c")), step)
    words = F.get(F.col("o"), 0)
    brevity = F.when(words["h"] < words["r"], F.exp(1 - words["r"] / words["h"])).otherwise(1.0)
    none = (words["h"] == 0) | (words["m"] == 0)
    return per.select(*by, F.round(F.when(none, 0.0).otherwise(brevity * F.exp(logs["s"] / logs["c"])), 6).alias("bleu"))


def chrf(pairs: DataFrame, by: list[str], hyp: str = "hypothesis", ref: str = "reference", order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF (0 to 1): character n-grams without white space, mean precision and recall over the orders both sides have."""
    counts = _clipped(pairs, by, F.col(hyp), F.col(ref), order, False)
    used = (F.col("h") > 0) & (F.col("r") > 0)
    x = counts.groupBy(*by).agg(F.avg(F.when(used, F.col("m") / F.col("h"))).alias("p"), F.avg(F.when(used, F.col("m") / F.col("r"))).alias("q"))
    f = (1 + beta**2) * F.col("p") * F.col("q") / (beta**2 * F.col("p") + F.col("q"))
    return x.select(*by, F.round(F.coalesce(F.when(F.col("p") + F.col("q") > 0, f), F.lit(0.0)), 6).alias("chrf"))


def comet(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The neural metric needs a model that isn't there: null for each group."""
    return pairs.select(*by).distinct().withColumn("comet", F.lit(None).cast("double"))


def check_aligned(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """Raise ValueError where one side lacks a row of the other."""
    x = a.select(*on, F.lit(1).alias("l")).join(b.select(*on, F.lit(1).alias("r")), on, "full").where("l is null or r is null")
    if x.take(1):
        raise ValueError("the two sides differ in length")
