"""Candidate scoring on five dimensions, and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import text as tx

#: Weights of the dimensions.
WEIGHTS = {"fluency": 0.20, "adequacy": 0.30, "terminology": 0.25, "format": 0.20, "consistency": 0.05}


def _mean(parts: list[Column], empty: float) -> Column:
    """Mean of the parts that aren't null."""

    def mean(a: Column) -> Column:
        each = [F.get(a, F.lit(k)) for k in range(len(parts))]
        n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in each), F.lit(0))
        return F.when(n == 0, F.lit(empty)).otherwise(sum((F.coalesce(p, F.lit(0.0)) for p in each), F.lit(0.0)) / n)

    return tx.once(F.array(*(p.cast("double") for p in parts)), mean)


#: A word and the lines behind it that repeat it, in sorted lines; possessive, so that no number of them is deep.
REPEATED = r"(?md)^(\S++)\n(?:\1\n)++"


def _lines(words: Column) -> Column:
    """Words (without white space) in sorted order, one on each line: equal ones are neighbours. Sorting and joining cost less than a step for each word."""
    return F.concat(F.array_join(F.sort_array(words), "\n"), F.lit("\n"))


def top_count(words: Column) -> Column:
    """How often the most frequent word stands in an array of words; 0 in an empty one."""
    often = lambda w: F.array_max(F.transform(F.regexp_extract_all(_lines(w), F.lit(REPEATED), F.lit(0)), lambda run: (F.length(run) / F.instr(run, "\n")).cast("int")))
    return tx.once(words, lambda w: F.coalesce(often(w), F.least(F.size(w), F.lit(1))))


def stddev(values: Column) -> Column:
    """Population standard deviation of an array of numbers, which is made once, as is its mean."""

    def around(v: Column, mean: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v))

    return tx.once(values, lambda v: tx.once(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), lambda mean: around(v, mean)))


#: Words that begin with a capital (looked for first: most places have none).
CAPITALS = r"(?=\p{Lu})(?<!\S)\p{Lu}\S*"


def capitals(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(CAPITALS), F.lit(0))


def counts(t: Column) -> Column:
    """What fluency() takes from a text, as batches.text_counts counts it for whole batches."""
    long = F.transform(F.regexp_extract_all(t, F.lit(r"\S{4,}"), F.lit(0)), F.lower)
    lengths = F.transform(F.split(t, r"\. "), lambda s: tx.n_words(s).cast("double"))
    spread = tx.once(lengths, lambda v: F.when(F.size(v) > 1, stddev(v)))
    return F.struct(tx.n_words(t).alias("words"), F.size(capitals(t)).alias("capitals"), top_count(long).alias("most"), tx.count(t, "[.,;:!?]").alias("marks"), spread.alias("spread"))


def fluency(t: Column, counted: Column | None = None) -> Column:
    """Repetition, sentence lengths, punctuation and capitals; 0 without words. counted: batches.text_counts of the text, where it is at hand."""
    near = lambda share, best: F.greatest(F.lit(0.0), 1 - F.abs(share - best) / best)

    def of(c: Column) -> Column:
        n = c["words"]
        parts = [
            1 - F.least(F.greatest(c["most"], F.lit(1)) / n, F.lit(0.3)) / 0.3,
            F.when(c["spread"].isNotNull(), F.least(c["spread"] / 10, F.lit(1.0))),
            near(c["marks"] / n, 0.15),
            near(c["capitals"] / n, 0.1),
        ]
        return F.when(n == 0, 0.0).otherwise(_mean(parts, 0.0))

    return tx.once(counts(t), of) if counted is None else of(counted)


#: Stretches of letters, digits, underscores and points that hold a digit: nothing that numbers depend on reaches beyond one. (Linear: tried at a stretch's start only.)
STRETCH = r"(?<![\p{L}\d_.])[\p{L}_.]*+\d[\p{L}\d_.]*+"
#: Digits with an optional fraction that touch a letter or underscore, as the SQL cuts them out first; what is left of digits are numbers.
TOUCHED, NUMBER = r"[\p{L}_]\d+(?:\.\d+)?|\d+(?:\.\d+)?[\p{L}_]", r"\d+(?:\.\d+)?"


def _numbers(x: Column) -> Column:
    stretches = F.array_join(F.regexp_extract_all(x, F.lit(STRETCH), F.lit(0)), " ")
    return F.regexp_extract_all(F.regexp_replace(stretches, TOUCHED, ""), F.lit(NUMBER), F.lit(0))


def of_source(source: Column, counted: Column) -> Column:
    """What adequacy() takes from a source: its number of words, numbers, distinct capitalised words and opened brackets. counted: batches.source_words of it."""
    return F.struct(counted["words"].alias("words"), F.when(counted["digits"], _numbers(source)).alias("numbers"), counted["capitals"].alias("capitals"), counted["opened"].alias("opened"))


def adequacy(source: Column, t: Column, counted: Column) -> Column:
    """Length, numbers, capitalised words and brackets that carry over. source: of_source() of it; counted: batches.text_counts of the text and the source's capitalised words."""
    kept = lambda s: tx.once(_numbers(t), lambda have: F.size(F.filter(s, lambda x: F.array_contains(have, x))))
    words, numbers, caps, opened = (source[k] for k in ("words", "numbers", "capitals", "opened"))
    parts = [
        F.when(words > 0, 1 - F.least(F.abs(counted["words"] / words - 1), F.lit(0.5)) / 0.5),
        F.when(F.size(numbers) > 0, kept(numbers) / F.size(numbers)),
        F.when(F.size(caps) > 0, counted["kept"] / F.size(caps)),
        F.when(opened > 0, F.least(counted["opened"] / opened, F.lit(1.0))),
    ]
    return _mean(parts, 0.5)


def terminology(t: Column, terms: list[tuple[str, str]], low: Column | None = None) -> Column:
    """Targets that stand in the text less untranslated sources, over all terms. low: the text in lower case, where it is at hand."""
    if not terms:
        return F.lit(1.0)

    def of(low: Column) -> Column:
        score = sum((F.when(F.contains(low, F.lit(b.lower())), 1).when(F.contains(low, F.lit(a.lower())), -1).otherwise(0) for a, b in terms), F.lit(0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / len(terms)))

    return tx.once(F.lower(t), of) if low is None else of(low)


def format_kept(t: Column, masks: Column) -> Column:
    """Placeholders kept, averaged with 1 for list markers and for blank lines in the text."""
    n = F.size(masks)
    kept = F.size(F.filter(masks, lambda m: F.contains(t, m["placeholder"]))) / n
    parts = [kept, F.when(t.rlike(r"(?m)^\s*[\d•\-*]\s"), 1.0), F.when(F.contains(t, F.lit("\n\n")), 1.0)]
    return F.when(n == 0, 1.0).otherwise(_mean(parts, 1.0))


def often(previous: Column) -> Column:
    """Words of five characters or more that stand twice or more in previous translations."""
    return batches.repeated_words(previous)


def consistency(t: Column, previous: Column, words: Column | None = None, low: Column | None = None) -> Column:
    """Share of long words, used twice or more in previous translations, that stand in the text. words, low: often() of the previous ones and the text in lower case, where they are at hand."""
    words = often(previous) if words is None else words
    of = lambda w, low: F.size(F.filter(w, lambda x: F.contains(low, x))) / F.size(w)
    share = lambda w: tx.once(F.lower(t), lambda low: of(w, low)) if low is None else of(w, low)
    return tx.once(words, lambda w: F.coalesce(F.when(F.size(w) > 0, share(w)), F.lit(1.0)))


def prepared(blocks: DataFrame) -> DataFrame:
    """blocks (source_text, previous) with what score() takes from both: candidates that are made of such blocks share it."""
    x = blocks.withColumn("_words", batches.source_words("source_text"))
    return x.withColumns({"_source": of_source(F.col("source_text"), F.col("_words")), "_often": often(F.col("previous"))}).drop("_words")


def score(candidates: DataFrame, terms: list[tuple[str, str]], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """candidates (source_text, text, masks, previous) with a column for each dimension and total. Those of prepared() blocks have their sources' parts at hand."""
    t, c, low = F.col("text"), F.col("_counts"), F.col("_low")
    x = candidates if {"_source", "_often"} <= set(candidates.columns) else prepared(candidates)
    x = x.withColumns({"_counts": batches.text_counts("text", "_source.capitals"), "_low": F.lower(t)})  # two dimensions take each
    x = x.withColumns({"fluency": fluency(t, c), "adequacy": adequacy(F.col("_source"), t, c), "terminology": terminology(t, terms, low), "format": format_kept(t, F.col("masks")), "consistency": consistency(t, F.col("previous"), F.col("_often"), low)})
    return x.withColumn("total", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))).drop("_source", "_often", "_counts", "_low")


def rerank(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rank candidates in each block by total (six digits), then id; those without all masks only rank where no other one has them."""
    w = Window.partitionBy(*by)
    whole = F.forall("masks", lambda m: F.contains(F.col("text"), m["placeholder"]))
    x = scored.withColumn("_ok", F.count_if(whole).over(w)).where((F.col("_ok") == 0) | whole).drop("_ok")
    return x.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("total", 6)), "candidate_id")))


def rerank_stats(scored: DataFrame, by: list[str]) -> DataFrame:
    """Blocks, mean and deviation of the best totals, candidates, and what the best gains over the first candidate."""
    best = scored.groupBy(*by).agg(F.max("total").alias("best"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("candidate_id") == 0, F.col("total"))).alias("first"))
    r = lambda c: F.round(c, 6)
    return best.agg(F.count(F.lit(1)).alias("blocks"), r(F.avg("best")).alias("mean_best"), r(F.stddev_pop("best")).alias("std_best"), r(F.avg("n")).alias("mean_candidates"), r(F.avg(F.col("best") - F.col("first"))).alias("mean_gain"))


def tiers(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means of all dimensions, and numbers of low (under 0.5), medium and high (0.8 and more) totals."""
    total = F.round("total", 6)
    return scored.groupBy(*by).agg(*(F.round(F.avg(c), 6).alias(c) for c in (*WEIGHTS, "total")), F.count_if(total < 0.5).alias("low"), F.count_if((total >= 0.5) & (total < 0.8)).alias("medium"), F.count_if(total >= 0.8).alias("high"))


def adapt(weights: dict[str, float], feedback: dict[str, float], rate: float = 0.1) -> dict[str, float]:
    """Weights moved towards normalised feedback, summing up to 1 again."""
    total = sum(feedback.values())
    moved = {k: (1 - rate) * w + rate * (feedback.get(k, 0.0) / total if total else w) for k, w in weights.items()}
    return {k: w / sum(moved.values()) for k, w in moved.items()}
