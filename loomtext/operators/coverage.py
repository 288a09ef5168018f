"""Coverage: what is missing, whether a document's translation is complete, and the last resorts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import BLOCK_TYPES
from ..sources.scratch import written


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to six digits; 1 where there is nothing."""
    return F.round(F.when(whole > 0, part / whole).otherwise(1.0), 6)


def defect() -> Column:
    """A translatable block whose translation is missing or repeats the source."""
    return tx.is_translatable("block_type") & (tx.blank("translated_text") | tx.simple_identity("source_text", "translated_text"))


def defects(blocks: DataFrame) -> DataFrame:
    """Translatable blocks whose translation is missing or a copy of the source; reason says which."""
    reason = F.when(tx.blank("translated_text"), "missing_translation").when(tx.simple_identity("source_text", "translated_text"), "identity_translation")
    # no element where there is no reason: it is computed once, not in a filter and again
    return blocks.where(tx.is_translatable("block_type")).withColumn("reason", F.explode(F.array_compact(F.array(reason))))


def by_document(blocks: DataFrame) -> DataFrame:
    can = tx.is_translatable("block_type")
    n, done = F.count_if(can), F.count_if(can & ~tx.blank("translated_text"))
    return blocks.groupBy("doc_id").agg(n.alias("translatable"), done.alias("translated"), ratio(done, n).alias("coverage"))


def by_page(blocks: DataFrame) -> DataFrame:
    """Totals for each page, each document (page null) and all (both null)."""
    can = tx.is_translatable("block_type")
    return blocks.rollup("doc_id", "page").agg(F.count(F.lit(1)).alias("total"), F.count_if(can & ~tx.blank("translated_text")).alias("translated"), F.count_if(can & tx.blank("translated_text")).alias("errors"))


def failure_report(blocks: DataFrame) -> DataFrame:
    ordinal = F.array_position(F.array(*map(F.lit, BLOCK_TYPES)), F.col("block_type"))
    return defects(blocks).select("doc_id", "pos", "page", ordinal.cast("long").alias("type_ordinal"), tx.preview("source_text", 100).alias("preview"), "reason")


def validate(blocks: DataFrame, full_coverage: bool = True, restored: Column | None = None, expected: Column | None = None) -> DataFrame:
    """One row for each document: coverage, identity blocks, masks, is_valid, and has_errors (also where is_valid lets errors pass)."""
    restored, expected = (F.lit(0) if c is None else c for c in (restored, expected))
    can = tx.is_translatable("block_type")
    n, done = F.count_if(can), F.count_if(can & ~tx.blank("translated_text"))
    same = F.count_if(can & tx.identity_failure("source_text", "translated_text"))
    lost = F.sum(F.greatest(expected - restored, F.lit(0))).cast("long")
    x = blocks.groupBy("doc_id").agg(n.alias("translatable"), done.alias("translated"), ratio(done, n).alias("coverage"), same.alias("identity_blocks"), lost.alias("missing_masks"))
    bad = (F.col("identity_blocks") > 0) | (F.col("missing_masks") > 0)
    short = F.col("translated") < F.col("translatable")
    return x.withColumns({"is_valid": ~bad & ~(F.lit(full_coverage) & short), "has_errors": bad | short})


def final_guard(blocks: DataFrame, *attempts: Column) -> DataFrame:
    """The first attempt that isn't blank, else the source."""
    usable = [F.when(~tx.blank(a), a) for a in attempts]
    first = F.when(F.lit(False), 0)
    for k, a in enumerate(usable):
        first = first.when(a.isNotNull(), k)
    return blocks.withColumns({"final_text": F.coalesce(*usable, F.col("source_text")), "attempt": F.coalesce(first, F.lit(len(attempts)))})


def repair(blocks: DataFrame, translators: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run translators in turn, each only on blocks that are still missing or copies; status: number of the one that helped, or failed.

    A translator takes blocks and returns them with another translated_text.
    """
    bad = F.coalesce(defect(), F.lit(False))
    out, left = [blocks.where(~bad).withColumn("status", F.lit("ok"))], written(blocks.where(bad))
    for k, translate in enumerate(translators):
        if left.isEmpty():
            break
        tried = written(translate(left))
        out.append(tried.where(~bad).withColumn("status", F.lit(f"repaired_{k}")))
        left = tried.where(bad)
    return reduce(DataFrame.unionByName, [*out, left.withColumn("status", F.lit("failed"))])


def quality_gate(source: Column, target: Column, masks: Column, confidence: Column, least: float, check_masks: bool = True) -> Column:
    kept = F.forall(masks, lambda m: F.contains(target, m["placeholder"])) if check_masks else F.lit(True)
    return ~tx.blank(target) & (target != source) & kept & (F.coalesce(confidence, F.lit(1.0)) >= least)


def refinement_ok(before: Column, after: Column, masks: Column, targets: Column) -> Column:
    """A refined text keeps all placeholders and all glossary targets that the text before had."""
    low = F.lower(after)
    return F.forall(masks, lambda m: F.contains(after, m["placeholder"])) & F.forall(targets, lambda t: ~F.contains(F.lower(before), F.lower(t)) | F.contains(low, F.lower(t)))
