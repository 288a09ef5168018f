"""Recovery of failed translations: rounds of retries, a fallback service, refinement, answers that were cut, and what a run reports of it.

Rounds and fallbacks run over what is left: each writes its answers, and the next translator is asked only for the rest.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import written
from .coverage import defect, failure_report, ratio, refinement_ok
from .translate import Translator, answered, chunk, chunk_masked

Answer = Callable[[Column], Column]


def usable(answer: Column, source: Column | str = "source_text") -> Column:
    """The answer, or null where it is blank or only repeats the source."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(~tx.blank(answer) & (tx.normalize(answer) != tx.normalize(source)), answer)


@dataclass(frozen=True)
class Backoff:
    """Seconds between rounds: none before the first, then `delay`, each further one `factor` times as long."""

    delay: float = 1.0
    factor: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    def before(self, k: int) -> float:
        """Seconds of waiting before round k (from 0)."""
        return self.delay * self.factor ** (k - 1) if k else 0.0


class CoverageError(Exception):
    """Translatable blocks are left without a translation. report: the failure report of all of them, as a DataFrame."""

    def __init__(self, missing: int, total: int, report: DataFrame):
        self.missing, self.total, self.report = missing, total, report
        self.coverage = (total - missing) / total if total else 1.0
        super().__init__(f"translation coverage is {self.coverage:.6f}: {missing} of {total} blocks are missing")


def rounds(blocks: DataFrame, translators: list[Translator], backoff: Backoff = Backoff(), at_once: int = 0) -> DataFrame:
    """Ask one translator after the other, each only for the blocks that are left.

    A block is left while it is translatable and its translation is missing or repeats the source. Each round's answers are
    written as a table in the shared folder before the next translator is asked, so a translator sees a block once, lost executors
    or not, and a round without remainder isn't run. Other blocks are read once more and never shuffled.

    round: number of the translator that helped, from 1 (null: none was needed, or none helped); waited: seconds of back-off up to there;
    failed: still without a translation. Translators are Columns, functions of a list of texts, or of DataFrames (blocks in, blocks with
    another translated_text out). at_once: so many of the last ones are asked without a wait. A text that a translator raises at, or answers with null, stays for the next one.
    """
    bad = F.coalesce(defect(), F.lit(False))
    kept = [c for c in blocks.columns if c not in ("round", "waited", "failed")]
    none = {"round": F.lit(None).cast("int"), "waited": F.lit(0.0), "failed": F.lit(False)}
    out = [blocks.select(*kept).where(~bad).withColumns(none)]
    left, waited = written(blocks.select(*kept).where(bad)), 0.0
    for k, translator in enumerate(translators):
        if left.isEmpty():
            break
        pause = backoff.before(k) if k < len(translators) - at_once else 0.0
        if pause:
            backoff.sleep(pause)
        waited += pause
        good = usable(F.col("_answer"))
        tried = written(answered(left, translator))
        solved = tried.where(good.isNotNull()).withColumn("translated_text", good).drop("_answer")
        out.append(solved.withColumns({"round": F.lit(k + 1), "waited": F.lit(waited), "failed": F.lit(False)}))
        left = tried.where(good.isNull()).drop("_answer")
    out.append(left.withColumns({"round": F.lit(None).cast("int"), "waited": F.lit(waited), "failed": F.lit(True)}))
    return reduce(DataFrame.unionByName, out)


def guarantee(blocks: DataFrame, attempts: list[Translator], fallback: Translator | None = None, backoff: Backoff = Backoff()) -> DataFrame:
    """Rounds of retries, then the fallback service without a wait for what they left. status: ok, retried, fallback or failed."""
    n = len(attempts)
    tried = rounds(blocks, attempts, backoff) if fallback is None else rounds(blocks, [*attempts, fallback], backoff, at_once=1)
    status = F.when(F.col("failed"), "failed").when(F.col("round") > n, "fallback").when(F.col("round").isNotNull(), "retried").otherwise("ok")
    return tried.withColumn("status", status).drop("round", "waited", "failed")


def guaranteed_coverage(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """guarantee()'s rows by document: translatable, recovered, missing and coverage. strict: CoverageError where blocks are missing."""
    can, gone = tx.is_translatable("block_type"), F.col("status") == "failed"
    if strict:
        blocks = written(blocks)
        seen = blocks.agg(F.count_if(can).alias("total"), F.count_if(gone).alias("missing")).first()
        if seen.missing:
            raise CoverageError(seen.missing, seen.total, failure_report(blocks.where(gone)))
    n, lost = F.count_if(can), F.count_if(gone)
    return blocks.groupBy("doc_id").agg(n.alias("translatable"), F.count_if(F.col("status").isin("retried", "fallback")).alias("recovered"), lost.alias("missing"), ratio(n - lost, n).alias("coverage"))


def single_fallback(source: Column, answer: Column) -> Column:
    """A block's answer after clean-up, or the source where that is blank; answers that repeat the source count."""
    clean = tx.trim_ws(tx.postprocess(answer))
    return F.when(tx.blank(source), F.coalesce(source, F.lit(""))).when(~tx.blank(clean), clean).otherwise(source)


def retry_listed(blocks: DataFrame, listed: DataFrame, answer: Column, by: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Blocks of the list take the answer (or their source); retried says which. Repeated entries count once, unknown ones not at all."""
    marked = listed.select(*by).distinct().withColumn("retried", F.lit(True))
    out = blocks.join(marked, list(by), "left").withColumn("retried", F.coalesce("retried", F.lit(False)))
    return out.withColumn("translated_text", F.when(F.col("retried"), single_fallback(F.col("source_text"), answer)).otherwise(F.col("translated_text")))


def refine(blocks: DataFrame, answer: Answer, masks: Column, targets: Column, segment: tuple[str, ...] = ("doc_id",), most: int = 5, width: int = 100) -> DataFrame:
    """A second pass over translated blocks with the beginnings of their segment's first translations as context.

    answer: gives the refined text from that context. It is taken where it keeps placeholders and glossary targets.
    status: skipped (nothing to refine), unchanged, refined, or violation (the text before stays).
    """
    can = tx.is_translatable("block_type") & (F.coalesce("translated_text", F.lit("")) != "")
    first = Window.partitionBy(*segment).orderBy("pos")
    begun = blocks.where(can).select(*segment, "pos", F.row_number().over(first).alias("nth"), F.substring("translated_text", 1, width).alias("text")).where(F.col("nth") <= most)
    told = begun.groupBy(*segment).agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("- "), "text").alias("text")))).alias("told"))
    out = blocks.join(told.select(*segment, F.array_join(F.transform("told", lambda t: t["text"]), "\n").alias("segment_context")), list(segment), "left")
    before, after = F.col("translated_text"), answer(F.col("segment_context"))
    same = after.isNull() | (after == "") | (after == before)
    status = F.when(~can, "skipped").when(same, "unchanged").when(refinement_ok(before, after, masks, targets), "refined").otherwise("violation")
    out = out.withColumn("status", status)
    return out.withColumn("translated_text", F.when(F.col("status") == "refined", after).otherwise(before))


def recover_cut(source: Column, answer: Column, translator: Answer, finish_reason: Column | None = None, limit: int = 450) -> Column:
    """An answer that seems cut is put together from the translations of the source's chunks; clean-up follows in any case.

    A chunk without a translation stays as it is. Sources of one chunk keep their answer.
    """
    paragraphs = F.contains(source, F.lit("\n\n"))
    whole = lambda parts, between: F.array_join(F.transform(parts, lambda c: F.coalesce(translator(c), c)), between)
    by_paragraph, by_sentence = chunk_masked(source, limit), chunk(source, limit)
    parts = F.when(paragraphs, F.when(F.size(by_paragraph) > 1, whole(by_paragraph, "\n\n"))).otherwise(F.when(F.size(by_sentence) > 1, whole(by_sentence, " ")))
    return tx.postprocess(F.when(tx.truncated(source, answer, finish_reason), F.coalesce(parts, answer)).otherwise(answer))


def run_summary(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each run (doc_id, duration in seconds): counts, coverage, percentage, blocks a second (0 without a duration) and counts by type."""
    can = tx.is_translatable("block_type")
    kinds = blocks.groupBy("doc_id", "block_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(can).alias("can"), F.count_if(can & ~tx.blank("translated_text")).alias("done"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_type", "n"))), lambda k: F.concat_ws(":", k["block_type"], k["n"].cast("string"))), ",")
    x = kinds.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sum("can").alias("translatable"), F.sum("done").alias("translated_ok"), named.alias("by_type"))
    x = runs.select("doc_id", "duration").join(x, "doc_id", "left").fillna({"total": 0, "translatable": 0, "translated_ok": 0, "by_type": ""})
    n, done = F.col("translatable"), F.col("translated_ok")
    speed = F.when(F.col("duration") > 0, F.round(done / F.col("duration"), 2)).otherwise(0.0)
    return x.select("doc_id", "total", n, done, (n - done).alias("failed"), "by_type", ratio(done, n).alias("coverage"), F.round(100 * ratio(done, n), 1).alias("percentage"), speed.alias("blocks_per_second"))


def translation_report(blocks: DataFrame) -> DataFrame:
    """Each block's part of the translation report: kind, whether it has a translation, lengths and status."""
    has = ~tx.blank("translated_text")
    can = tx.is_translatable("block_type")
    status = F.when(~can, "skipped").when(defect() & has, "identity").when(has, "translated").otherwise("missing")
    return blocks.select("doc_id", "pos", "block_type", can.alias("is_translatable"), has.alias("has_translation"), F.length("source_text").alias("source_length"), F.coalesce(F.length("translated_text"), F.lit(0)).alias("translation_length"), status.alias("status"))
