"""Translation of distinct texts behind a cache, and cache upkeep.

A translator is any function from a list of texts to a list of translations; it runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: The rule translator's replacements (English to French), applied in small letters and capitalised.
RULES = [("the", "le"), ("and", "et"), ("is", "est"), ("are", "sont"), ("in", "dans"), ("of", "de"), ("with", "avec"), ("for", "pour"), ("model", "modèle"), ("data", "données"), ("learning", "apprentissage")]


def rule_translate(t: Column) -> Column:
    """The deterministic translator, as a Column expression."""
    for a, b in RULES:
        t = F.replace(F.replace(t, F.lit(f"{a} "), F.lit(f"{b} ")), F.lit(f"{a.capitalize()} "), F.lit(f"{b.capitalize()} "))
    return t


def key(text: Column, source: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, target, text), 256), 1, 32)


def lookup(texts: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """texts (key) with the cached value, null where there is none or it is too old."""
    live = cache.where(F.col("ts") > now - F.expr(f"interval {days} days")).select("key", F.col("value").alias("cached"))
    return texts.join(live, "key", "left")


def misses(texts: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    live = cache.where(F.col("ts") > now - F.expr(f"interval {days} days")).select("key")
    return texts.join(live, "key", "left_anti")


#: A Column of the text, a function of a list of texts (it runs in Arrow batches), or of DataFrames (blocks in, blocks with another translated_text out).
Translator = Column | Callable[[list[str]], list[str]] | Callable[[DataFrame], DataFrame]


def on_frames(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Marks a translator that takes blocks, as a DataFrame."""
    f.on_frames = True
    return f


def _in_batches(translator: Callable[[list[str]], list[str]], text: str, out: str):
    """mapInPandas function: the translator over each batch; where it raises, each text alone (an error: null)."""

    def alone(t: str) -> str | None:
        try:
            return translator([t])[0]
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = list(f[text])
            try:
                done = list(translator(texts))
            except Exception:  # a translator may raise anything
                done = [alone(t) for t in texts] if len(texts) > 1 else [None] * len(texts)
            yield f.assign(**{out: done})

    return run


def answered(blocks: DataFrame, translator: Translator, text: str = "source_text", out: str = "_answer") -> DataFrame:
    """blocks with the translator's answer to each of them, in a column of its own."""
    if isinstance(translator, Column):
        return blocks.withColumn(out, translator)
    if getattr(translator, "on_frames", False):
        had = blocks.withColumn("_had", F.col("translated_text"))
        return translator(had).withColumnRenamed("translated_text", out).withColumnRenamed("_had", "translated_text")
    schema = T.StructType([*blocks.schema.fields, T.StructField(out, T.StringType())])
    return blocks.mapInPandas(_in_batches(translator, text, out), schema)


def translate_distinct(blocks: DataFrame, translator: Column | Callable[[list[str]], list[str]], text: str = "source_text", out: str = "translated_text", sources: int = 0) -> DataFrame:
    """Translate each distinct text once and hand it to all its rows; blank texts pass; a text that the
    translator fails at (an error, or null) stays as it is, and the others of its batch are tried alone.

    translator: a Column of `text`, or a function of a list of texts. sources: partitions (concurrent clients) for a function; 0: as planned.
    """
    todo = blocks.where(~tx.blank(text)).select(text).distinct()
    if sources and not isinstance(translator, Column):
        todo = todo.repartition(sources)
    keyed = answered(todo, translator, text, "_t").select(F.col(text).alias("_s"), "_t")
    return blocks.join(keyed, F.col(text) == F.col("_s"), "left").withColumn(out, F.coalesce("_t", text)).drop("_s", "_t")


def cache_stats(blocks: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    found = lookup(blocks, cache, now)
    n, hit, kinds = F.count(F.lit(1)), F.count("cached"), F.count_distinct("key")
    return found.agg(n.alias("total"), hit.alias("hits"), kinds.alias("distinct_texts"), (n - kinds).alias("deduplicated"), F.round(hit / n, 6).alias("hit_rate"))


def evict(cache: DataFrame, most: int, by: list[str]) -> DataFrame:
    """The newest `most` entries of each part."""
    w = Window.partitionBy(*by).orderBy(F.desc("insert_seq"))
    return cache.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def cascade(blocks: DataFrame, attempts: list[Column]) -> DataFrame:
    """The first service's answer that isn't blank, and its number."""
    usable = [F.when(~tx.blank(a), a) for a in attempts]
    no = F.when(F.lit(False), 0)
    for k, u in enumerate(usable):
        no = no.when(u.isNotNull(), k)
    return blocks.withColumns({"answer": F.coalesce(*usable), "service": no})


def chunk(text: Column, limit: int) -> Column:
    """Texts over `limit` in parts: whole sentences as long as they fit together, longer sentences cut at the limit."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    pieces = F.flatten(
        F.transform(sentences, lambda s: F.when(F.length(s) <= limit, F.array(F.struct(s.alias("t"), F.lit(False).alias("cut")))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda k: F.struct(tx.trim_ws(F.substring(s, k * limit + 1, F.lit(limit))).alias("t"), F.lit(True).alias("cut")))))
    )
    kind = "array<struct<t:string,cut:boolean>>"
    last = lambda a: F.get(a, F.size(a) - 1)
    packed = F.aggregate(
        pieces,
        F.array().cast(kind),
        lambda a, p: F.when((F.size(a) > 0) & ~p["cut"] & ~last(a)["cut"] & (F.length(last(a)["t"]) + F.length(p["t"]) + 1 <= limit), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.concat(last(a)["t"], F.lit(" "), p["t"]).alias("t"), F.lit(False).alias("cut"))))).otherwise(F.concat(a, F.array(p))),
        lambda a: F.filter(F.transform(a, lambda p: tx.trim_ws(p["t"])), lambda t: t != ""),
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunk_masked(text: Column, limit: int) -> Column:
    """chunk() of paragraphs; placeholders hold no sentence end, so none is cut unless it is longer than the limit."""
    return F.flatten(F.transform(F.filter(F.split(text, "\n\n+"), lambda p: ~tx.blank(p)), lambda p: chunk(p, limit)))
