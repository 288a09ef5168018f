"""Quality rules with adaptive limits, in DataFrame functions only.

Base measures come from array functions within a row (no shuffle). Their shares among documents that pass the base rules
are counted into fixed bins: a quantile sketch of bounded size that merges by addition and is exact to the bin's width. Each language
and source has its own sketch, each language the merged ones of its sources. No limit is a fixed value: shares that are mostly zero are
limited by an upper quantile of their group, no higher than a further quantile of the language; word lengths by the group's quartile fence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, discard, fresh, materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
SPAN = 8
#: Shares limited by this quantile of their language and source, in ten-thousandths; and by FAR of the language.
LEVELS = {"symbols": 9500, "dup_lines": 9980, "repeats": 9980}
FAR = {k: 10_000 - (10_000 - v) // 10 for k, v in LEVELS.items()}
#: Word lengths: third quartile + REACH * (third - first quartile; at least the language's), and FAR_LENGTH of the language at most.
REACH, FAR_LENGTH = 3, 9990
SHARES = [*LEVELS, "word_length"]
#: Bins: thousandths, and fiftieths of a character; words of 100 characters on average or more share the last one.
LAST_BIN = {"symbols": 1000, "dup_lines": 1000, "repeats": 1000, "word_length": 5000}
#: Limits are broadcast up to so many bytes (200 a group); larger tables are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the base measures; {measure: its column} (other names where docs has a column of that name)."""
    names = dict(zip([*MEASURES, "n_lines"], fresh(docs, *MEASURES, "n_lines")))
    t, words, windows, lines, order = fresh(docs, "t", "words", "windows", "lines", "order")
    d = docs.withColumn(t, F.coalesce(col(text), F.lit("")))
    d = d.withColumn(words, F.array_remove(F.split(t, WORD_GAP), ""))
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(words)
    window = F.transform(F.sequence(F.lit(1), n - (SPAN - 1)), lambda i: F.xxhash64(F.slice(F.col(words), i, F.lit(SPAN))))
    d = d.withColumn(windows, F.when(n > SPAN, window))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    d = d.withColumn(order, F.when(repeats, F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    z = F.col(order)
    same = lambda k, x: F.coalesce(F.when(k >= 0, F.get(z, k))["h"] == x["h"], F.lit(False))
    again = F.filter(z, lambda x, k: same(k - 1, x) | same(k + 1, x))
    # words covered by windows at ascending places: each adds what the one before has not covered
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("total")),
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(SPAN), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    as_long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d = d.withColumns(
        {
            names["n_words"]: as_long(n),
            names["word_chars"]: as_long(F.length(t) - F.regexp_count(F.col(t), F.lit(r"[\x20\x09-\x0D]"))),
            names["n_symbols"]: as_long(F.regexp_count(F.col(t), F.lit(r"[#*$%&|<>]"))),
            names["n_dup_lines"]: as_long(F.size(lines) - F.size(F.array_distinct(lines))),
            names["n_repeat_words"]: as_long(F.when(z.isNotNull(), covered)),
            names["n_lines"]: as_long(F.size(lines)),
        }
    )
    return d.drop(t, words, lines, windows, order), names


def shares(names: dict[str, str]) -> dict[str, Column]:
    """Bins of the shares that limits are set for (null where there is nothing to divide by)."""
    c = {k: F.col(v) for k, v in names.items()}
    of = {"symbols": (1000, "n_symbols", "word_chars"), "dup_lines": (1000, "n_dup_lines", "n_lines"), "repeats": (1000, "n_repeat_words", "n_words"), "word_length": (50, "word_chars", "n_words")}
    return {k: F.when(c[b] > 0, F.least(F.floor(unit * c[a] / c[b]), F.lit(LAST_BIN[k]))) for k, (unit, a, b) in of.items()}


def base_failed(names: dict[str, str]) -> Column:
    n = F.col(names["n_words"])
    return (n < 20) | (100 * F.col(names["n_repeat_words"]) > 30 * n)


def sketch(d: DataFrame, names: dict[str, str], lang: str, source: str) -> DataFrame:
    """Counts (lang, source, share, bin, n) of the documents that pass the base rules: combined in each task before the shuffle."""
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("share"), b.cast("long").alias("bin")) for k, b in shares(names).items())))
    x = d.where(~base_failed(names)).select(col(lang).alias("lang"), col(source).alias("source"), bins.alias("x")).select("lang", "source", "x.share", "x.bin").where("bin is not null")
    return x.groupBy("lang", "source", "share", "bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(counts: DataFrame, by: list[str], points: list[int]) -> DataFrame:
    """(by, share, docs, q<point>: the first bin that holds so many ten-thousandths) of each share's merged sketch."""
    merged = counts.groupBy(*by, "share", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "share")  # a sketch: as many rows as it has bins, at most
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    return ranked.groupBy(*by, "share").agg(F.first("total").alias("docs"), *(F.min(F.when(10_000 * F.col("upto") >= p * F.col("total"), F.col("bin"))).alias(f"q{p}") for p in points))


def limits(counts: DataFrame) -> DataFrame:
    """(lang, source, one limit for each share)."""
    q = quantiles(counts, ["lang", "source"], sorted({2500, 7500, *LEVELS.values()}))
    wide = sorted({2500, 7500, FAR_LENGTH, *FAR.values()})
    by_lang = quantiles(counts, ["lang"], wide).select(F.col("lang").alias("l"), F.col("share").alias("s"), *(F.col(f"q{p}").alias(f"l{p}") for p in wide))
    x = q.join(by_lang, q["lang"].eqNullSafe(by_lang["l"]) & (q["share"] == by_lang["s"]))
    fence = F.col("q7500") + REACH * F.greatest(F.col("q7500") - F.col("q2500"), F.col("l7500") - F.col("l2500"))
    most = F.least(fence, F.col(f"l{FAR_LENGTH}"))
    for k, p in LEVELS.items():
        most = F.when(F.col("share") == k, F.least(F.col(f"q{p}"), F.col(f"l{FAR[k]}"))).otherwise(most)
    return x.withColumn("most", most).groupBy("lang", "source").agg(*(F.max(F.when(F.col("share") == k, F.col("most"))).alias(f"most_{k}") for k in SHARES))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """docs with measures, base_failed and kept; {name: column}.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed and no
    share beyond its limit (equal to it is kept). Null and empty texts have no words (base_failed). Null languages and sources are
    groups of their own. Repeated rows count as often as they stand. Windows are compared by 64-bit hashes within one text.
    """
    d, names = measured(docs, text)
    d = materialize(d)
    groups = materialize(limits(sketch(d, names, lang, source)))
    base, kept, gl, gs, *most = fresh(d, "base_failed", "kept", "gl", "gs", *(f"most_{k}" for k in SHARES))
    named = groups.select(F.col("lang").alias(gl), F.col("source").alias(gs), *(F.col(f"most_{k}").alias(m) for k, m in zip(SHARES, most)))
    if 200 * groups.count() <= BROADCAST_BYTES:
        named = F.broadcast(named)
    x = d.join(named, col(lang).eqNullSafe(F.col(gl)) & col(source).eqNullSafe(F.col(gs)), "left")
    failed = base_failed(names)
    beyond = [F.coalesce(shares(names)[k] > F.col(m), F.lit(False)) for k, m in zip(SHARES, most)]
    bad = beyond[0]
    for b in beyond[1:]:
        bad = bad | b
    x = x.withColumn(base, failed).withColumn(kept, ~failed & ~bad).drop(gl, gs, *most)
    return x, names | {"base_failed": base, "kept": kept}


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    x, names = judge(docs, text, lang, source)
    return x.where(F.col(names["kept"])).select(*(col(c) for c in docs.columns))


__all__ = ["discard", "judge", "keep", "limits", "measured", "quantiles", "sketch"]
