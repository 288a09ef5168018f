"""Ordered context within documents, as window functions over (doc_id, pos)."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

def _doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def window(blocks: DataFrame, n: int = 3, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each block with the texts of up to n blocks before and behind it, itself included. by: what a context doesn't go beyond
    (a segment: its columns behind the document's)."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(-n, n)
    return blocks.withColumn("context", F.collect_list("source_text").over(w))


def translated_before(blocks: DataFrame, n: int = 5) -> DataFrame:
    """Each block with the pairs (source, translation) of translated ones among the n blocks before it."""
    pair = F.when(~tx.blank("translated_text"), F.struct("source_text", "translated_text"))
    return blocks.withColumn("context", F.collect_list(pair).over(_doc().rowsBetween(-n, -1)))


def last_translations(blocks: DataFrame, n: int = 5) -> DataFrame:
    """Each block with the last n translations of translatable blocks before it, however far back."""
    good = tx.is_translatable("block_type") & ~tx.blank("translated_text")
    k = F.count_if(good).over(_doc().rowsBetween(Window.unboundedPreceding, -1))
    numbered = blocks.withColumn("_k", k)
    # the translated blocks' own frame; a block takes that of the last translated one before it
    chain = numbered.where(good).withColumn("_last", F.collect_list("translated_text").over(_doc().rowsBetween(-(n - 1), 0)))
    chain = chain.select("doc_id", (F.col("_k") + 1).alias("_k"), "_last")
    joined = numbered.join(chain, ["doc_id", "_k"], "left")
    return joined.withColumn("previous", F.coalesce("_last", F.array().cast("array<string>"))).drop("_k", "_last")


def links(blocks: DataFrame) -> DataFrame:
    """Numbers within the document and the neighbours' positions."""
    return blocks.withColumns({"block_no": F.row_number().over(_doc()), "previous_pos": F.lag("pos").over(_doc()), "next_pos": F.lead("pos").over(_doc())})


def continued(blocks: DataFrame, lengths: Column | None = None) -> DataFrame:
    """Blocks that a page break split (the last of a page without final punctuation) joined with what follows: doc_id, first pos, text."""
    open_end = ~F.regexp_replace("source_text", r"\s+$", "").rlike(r"[.!?:;。！？]$") & (F.col("page") < F.lead("page").over(_doc()))
    starts = blocks.withColumn("_open", F.coalesce(open_end, F.lit(False)))
    group = F.sum(F.when(F.coalesce(F.lag("_open").over(_doc()), F.lit(False)), 0).otherwise(1)).over(_doc())
    parts = F.array_sort(F.collect_list(F.struct("pos", "source_text")))
    return starts.withColumn("_g", group).groupBy("doc_id", "_g").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(parts, lambda p: p["source_text"]), " ").alias("source_text"), *([] if lengths is None else [lengths.alias("lengths")])).drop("_g")


def part_lengths(blocks: DataFrame) -> DataFrame:
    """continued() with the lengths of the joined parts, which split_back() needs."""
    return continued(blocks.withColumn("_length", F.length("source_text")), F.transform(F.array_sort(F.collect_list(F.struct("pos", "_length"))), lambda p: p["_length"]))


def cut_in_parts(text: str, lengths: list[int]) -> list[str]:
    """The text in len(lengths) parts whose shares of characters are as near as can be (least squares) to the given lengths' shares.

    Cuts are between sentences if there are as many as parts, else between words, else the last parts are empty. Placeholders hold no
    white space, so none is cut. Among equal costs the earliest cuts win.
    """
    k = len(lengths)
    if k < 2:
        return [text.strip()] * k
    pieces = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if len(pieces) < k:
        pieces = text.split()
    n, total = len(pieces), sum(lengths) or 1
    if n <= k:
        return pieces + [""] * (k - n)
    upto = [0, *accumulate(map(len, pieces))]
    whole = upto[-1] or 1
    # best[j]: least cost of the first j pieces in so many parts, and where the last part begins
    best, cuts = [0.0] + [float("inf")] * n, []
    for share in (x / total for x in lengths):
        now, begins = [float("inf")] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j):
                cost = best[i] + ((upto[j] - upto[i]) / whole - share) ** 2
                if cost < now[j] - 1e-12:
                    now[j], begins[j] = cost, i
        best = now
        cuts.append(begins)
    out, j = [], n
    for begins in reversed(cuts):
        out.append(" ".join(pieces[begins[j] : j]))
        j = begins[j]
    return out[::-1]


def split_back(merged: DataFrame, translation: str = "translated_text", lengths: str = "lengths", out: str = "translated_parts") -> DataFrame:
    """Merged blocks with their translation cut into as many parts as were joined, for each one's page. A null translation has null parts."""

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else cut_in_parts(a, [int(x) for x in b]) for a, b in zip(t, n)], dtype=object)

    return merged.withColumn(out, cut(F.col(translation), F.col(lengths)))
