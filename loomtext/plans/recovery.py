"""Queries for the recovery of failed translations over the whole driver tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery
from ..operators.translate import Translator
from ..sources.blocks import read_table
from . import oracles
from .queries import _blocks, _translated


def _attempts() -> tuple[list[Translator], Translator]:
    """Two rounds and a fallback; the first round's answer repeats the source, helps or is blank."""
    s, k = F.col("source_text"), F.col("pos")
    one = F.when(k % 3 == 0, F.concat(F.lit("  "), s)).when(k % 3 == 1, F.concat(F.lit("[1] "), s)).otherwise(F.lit("  "))
    return [one, F.when(k % 2 == 0, F.concat(F.lit("[2] "), s))], F.when(k % 5 == 0, F.concat(F.lit("[f] "), s))


#: The answers are at hand, so rounds don't wait.
AT_ONCE = recovery.Backoff(sleep=lambda seconds: None)


def retry_rounds(spark: SparkSession, sf: str) -> DataFrame:
    x = recovery.rounds(_translated(spark, sf), _attempts()[0], AT_ONCE).where("failed or round is not null")
    return x.select("doc_id", "pos", "round", "waited", F.md5("translated_text").alias("text_hash"))


def coverage_guarantee(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.guaranteed_coverage(recovery.guarantee(_translated(spark, sf), *_attempts(), AT_ONCE))


def single_block_fallback(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("source_text")
    answer = F.when(F.col("pos") % 3 == 1, "   ").when(F.col("pos") % 3 == 2, F.concat(F.lit("  <think>x</think> "), s))
    return _blocks(spark, sf).select("doc_id", "pos", recovery.single_fallback(s, answer).alias("text"))


def retry_listed(spark: SparkSession, sf: str) -> DataFrame:
    listed = read_table(spark, sf, "labels").select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(2))).alias("pos"))
    x = recovery.retry_listed(_translated(spark, sf), listed, F.when(F.col("doc_id") % 2 == 0, F.lit("again")))
    return x.where("retried").select("doc_id", "pos", F.md5("translated_text").alias("text_hash"))


def refinement_pass(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("translated_text"), F.col("pos")
    answer = lambda context: F.when(k % 3 == 0, F.concat(t, F.lit(" !"))).when(k % 3 == 1, F.replace(t, F.lit("e"), F.lit(""))).when(context.isNotNull(), t)
    x = recovery.refine(_translated(spark, sf), answer, F.array(F.struct(F.lit("e").alias("placeholder"))), F.array(F.lit("de")))
    return x.select("doc_id", "pos", "status", F.md5("translated_text").alias("text_hash"), F.md5("segment_context").alias("context_hash"))


def truncation_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: chunks are packed one after the other (tested against a plain loop)."""
    s = F.col("text")
    cut = F.when(F.col("doc_id") % 3 == 0, F.substring(s, F.lit(1), F.floor(F.length(s) / 10).cast("int"))).otherwise(s)
    x = read_table(spark, sf, "documents").select("doc_id", recovery.recover_cut(s, cut, F.upper).alias("t"))
    return x.select("doc_id", F.length("t").alias("length"), F.md5("t").alias("text_hash"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = read_table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).cast("double").alias("duration"))
    return recovery.run_summary(_translated(spark, sf), runs)


def translation_report(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.translation_report(_translated(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (retry_rounds, coverage_guarantee, single_block_fallback, retry_listed, refinement_pass, truncation_recovery, run_summary, translation_report)}


def oracle_sql() -> dict[str, str]:
    tr, blank, simple, b = oracles.TR, oracles._blank("translated_text"), oracles.SIMPLE, oracles.B
    bad = f"can and ({blank} or {simple})"
    squeezed = r"regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' +([.,;:!?])', '\1', 'g')"
    return {
        "retry_rounds": f"{tr} select doc_id, pos, case when pos % 3 = 1 then 1 when pos % 2 = 0 then 2 end as round, case when pos % 3 = 1 then 0.0 else 1.0 end as waited, md5(case when pos % 3 = 1 then '[1] ' || source_text when pos % 2 = 0 then '[2] ' || source_text else translated_text end) as text_hash from tr where {bad}",
        "coverage_guarantee": f"{tr}, x as (select doc_id, can, {bad} as bad, pos % 3 <> 1 and pos % 2 = 1 and pos % 5 <> 0 as lost from tr), y as (select doc_id, count(*) filter (can) as translatable, count(*) filter (bad and not lost) as recovered, count(*) filter (bad and lost) as missing from x group by doc_id) select *, case when translatable > 0 then round((translatable - missing) / translatable, 6) else 1.0 end as coverage from y",
        "single_block_fallback": f"{b} select doc_id, pos, case when pos % 3 = 2 then {squeezed} else source_text end as text from blocks",
        "retry_listed": f"{tr} select doc_id, pos, md5(case when doc_id % 2 = 0 then 'again' else source_text end) as text_hash from tr where pos in (0, 2) and doc_id in (select doc_id from labels)",
        "refinement_pass": f"{tr}, c as (select doc_id, string_agg('- ' || left(translated_text, 100), chr(10) order by pos) as context from (select * from tr where can and translated_text <> '' qualify row_number() over (partition by doc_id order by pos) <= 5) group by doc_id), x as (select doc_id, pos, can, translated_text as t, context, case pos % 3 when 0 then translated_text || ' !' when 1 then replace(translated_text, 'e', '') else translated_text end as a from tr left join c using (doc_id)), y as (select *, case when not can or coalesce(t, '') = '' then 'skipped' when a = '' or a = t then 'unchanged' when contains(a, 'e') and (not contains(lower(t), 'de') or contains(lower(a), 'de')) then 'refined' else 'violation' end as status from x) select doc_id, pos, status, md5(case when status = 'refined' then a else t end) as text_hash, md5(context) as context_hash from y",
        "run_summary": f"{tr}, k as (select doc_id, block_type, count(*) as n, count(*) filter (can) as can, count(*) filter (can and not ({blank})) as done from tr group by all), x as (select doc_id, sum(n)::bigint as total, sum(can)::bigint as translatable, sum(done)::bigint as translated_ok, string_agg(block_type || ':' || n, ',' order by block_type) as by_type from k group by doc_id), y as (select d.doc_id, (d.doc_id % 7)::double as duration, coalesce(total, 0) as total, coalesce(translatable, 0) as translatable, coalesce(translated_ok, 0) as translated_ok, coalesce(by_type, '') as by_type from documents d left join x using (doc_id)) select doc_id, total, translatable, translated_ok, translatable - translated_ok as failed, by_type, case when translatable > 0 then round(translated_ok / translatable, 6) else 1.0 end as coverage, round(100 * case when translatable > 0 then round(translated_ok / translatable, 6) else 1.0 end, 1) as percentage, case when duration > 0 then round(translated_ok / duration, 2) else 0.0 end as blocks_per_second from y",
        "translation_report": f"{tr} select doc_id, pos, block_type, can as is_translatable, not ({blank}) as has_translation, length(source_text) as source_length, coalesce(length(translated_text), 0) as translation_length, case when not can then 'skipped' when {blank} then 'missing' when {simple} then 'identity' else 'translated' end as status from tr",
    }
