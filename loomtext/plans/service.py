"""Queries for breakers, progress, texts that overflow their boxes, and languages, over the whole driver tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages
from ..operators import breaker, overflow, progress
from ..sources.blocks import read_table
from . import oracles
from .queries import _blocks

STRATEGY = "smart"


def breaker_states(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("user_id") % 3 == 0, "ok").when(F.col("user_id") % 7 == 1, "busy").otherwise("failed")
    calls = read_table(spark, sf, "events").select(F.col("event_type").alias("service"), F.col("event_id").alias("seq"), "ts", outcome.alias("outcome"))
    return breaker.replay(calls, breaker.Rule(cool_down=1200)).drop("outcome")


def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """All events as the steps of one run."""
    status = F.when(F.col("user_id") % 5 == 0, "failed").when(F.col("user_id") % 5 == 1, "skipped").otherwise("completed")
    steps = read_table(spark, sf, "events").select(F.lit("all").alias("run"), F.col("event_id").alias("seq"), "ts", status.alias("status"))
    return progress.follow(steps).select("seq", "completed", "failed", "skipped", *(F.round(c, 6).alias(c) for c in ("percentage", "elapsed", "rate", "eta")))


def progress_messages(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    of = b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.max("page") + 1).alias("pages"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    x = b.select("doc_id", "pos", "page", k.alias("k")).join(of, "doc_id")
    return x.select("doc_id", "pos", progress.message(F.lit("Translating"), F.floor(F.col("k") * 100 / F.col("n")) / 100, F.col("k"), F.col("n"), F.col("page"), F.col("pages")).alias("message"))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks in boxes whose heights differ and of which some are left out, so that there is space."""
    b = _blocks(spark, sf).where((F.col("doc_id") * 7 + F.col("pos")) % 5 < 3)
    return b.withColumn("y1", F.col("y0") + 14 + (F.col("pos") * 5 % 13).cast("double"))


def overflow_boxes(spark: SparkSession, sf: str) -> DataFrame:
    x = overflow.resolve(_placed(spark, sf), STRATEGY)
    return x.select("doc_id", "pos", "how", *(F.round(c, 6).alias(c) for c in ("new_y0", "new_y1", "size")))


def overflow_pages(spark: SparkSession, sf: str) -> DataFrame:
    x = overflow.appended(overflow.resolve(_placed(spark, sf), STRATEGY))
    return x.select("doc_id", "pos", "extra_page", F.round("extra_y", 6).alias("extra_y"))


def overflow_report(spark: SparkSession, sf: str) -> DataFrame:
    return overflow.report(overflow.resolve(_placed(spark, sf), STRATEGY), STRATEGY, texts=False)


def best_match(spark: SparkSession, sf: str) -> DataFrame:
    """Three matches for each block; by its number their qualities are texts, equal, low or no numbers."""
    k = F.col("doc_id") + F.col("pos")
    quality = lambda m: F.when(k % 11 == 3, "n/a").otherwise((k * m % 10 / 10).cast("string"))
    match = lambda m: F.struct(F.concat(F.lit(f"{m} "), "source_text").alias("translation"), quality(m).alias("quality"))
    chosen = languages.best_match(F.array(match(3), match(7), match(9)), F.when(k % 4 > 0, F.col("source_text")))
    return _blocks(spark, sf).select("doc_id", "pos", F.md5(chosen).alias("text_hash"))


def language_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the code, script and font of a language that their number spells in several ways."""
    k = F.col("doc_id") % 6
    said = F.when(k == 0, F.upper("lang")).when(k == 1, " Russian ").when(k == 2, "Chinese").when(k == 3, "EL").when(k == 4, "klingon").otherwise(F.col("lang"))
    x = read_table(spark, sf, "documents").select(languages.code(said).alias("code"))
    return x.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", languages.script(F.col("code")).alias("script"), languages.font_file(F.col("code")).alias("font"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (breaker_states, run_progress, progress_messages, overflow_boxes, overflow_pages, overflow_report, best_match, language_fonts)}


def oracle_sql() -> dict[str, str]:
    lines = "greatest(len(string_split(source_text, chr(10))), ceil(length(source_text) * 0.5 * ({s}) / 240.0))"
    need = lambda s: f"({lines.format(s=s)} * ({s}) * 1.2)"
    ladder = " ".join(f"when {need(f'(11.0::double * {s})')} <= h then 11.0::double * {s}" for s in overflow.LADDER)
    reduced = " ".join(f"when {need(s)} * 0.95 <= h then 'reduced'" for s in ("(11.0::double * 0.9)", "(11.0::double * 0.85)"))
    # columns of 12 points: boxes from 50 take 4 to 24, those from 310 take 25 to 45, so a box meets those of its own side
    boxes = f"""with {oracles.BLOCKS}, p as (select doc_id, pos, page, source_text, x0, y0, y0 + 14 + pos * 5 % 13 as y1, (14 + pos * 5 % 13)::double as h from blocks where (doc_id * 7 + pos) % 5 < 3),
f as (select *, case {ladder} end as fit, case {ladder} end is null as needy, {need('11.0::double')} - h as g from p),
s as (select a.doc_id, a.pos, greatest(0, least(782 - a.y1, min(case when b.pos > a.pos then case when b.needy then (b.y0 - a.y1) / 2 else b.y0 - a.y1 end end))) as below,
  greatest(0, least(a.y0 - 10, min(case when b.pos < a.pos then case when b.needy then (a.y0 - b.y1) / 2 else a.y0 - b.y1 end end))) as above
  from f a left join f b on b.doc_id = a.doc_id and b.page = a.page and b.x0 = a.x0 and b.pos <> a.pos where a.needy group by a.doc_id, a.pos, a.y0, a.y1),
r as (select f.*, above, below, case when not needy then 'fits' when below > 20 and below >= g then 'down' when above > 20 and above >= g then 'up'
  when above + below > 40 and least(above * 0.8, g * 0.5) + least(below * 0.8, g * 0.5) >= g then 'both' {reduced} else 'append' end as how from f left join s using (doc_id, pos))"""
    return {
        "breaker_states": """with recursive c as (select event_type as service, event_id as seq, ts, case when user_id % 3 = 0 then 'ok' when user_id % 7 = 1 then 'busy' else 'failed' end as outcome, row_number() over (partition by event_type order by ts, event_id) as k from events),
r as (select service, 0::bigint as k, null::bigint as seq, null::timestamp as ts, null::boolean as attempted, 0::int as failures, null::timestamp as open_until, null::boolean as opened from (select distinct service from c)
  union all select service, k, seq, ts, made, count, case when made then case when trips then ts + interval 1200 second end else open_until end, trips from (
    select *, made and (outcome = 'busy' or (outcome = 'failed' and count >= 3)) as trips from (
      select *, case when not made then failures when outcome = 'ok' then 0 else base + (outcome = 'failed')::int end as count from (
        select r.service, c.k, c.seq, c.ts, c.outcome, r.failures, r.open_until, r.open_until is null or c.ts >= r.open_until as made, case when r.open_until is not null then 0 else r.failures end as base
        from r join c on c.service = r.service and c.k = r.k + 1))))
select service, seq, ts, attempted, failures, open_until, opened from r where k > 0""",
        "run_progress": """with x as (select event_id as seq, count(*) filter (user_id % 5 > 1) over w as completed, count(*) filter (user_id % 5 = 0) over w as failed, count(*) filter (user_id % 5 = 1) over w as skipped,
  count(*) over () as total, date_diff('microsecond', min(ts) over (), ts) / 1e6 as elapsed from events window w as (order by ts, event_id rows unbounded preceding)),
y as (select *, case when elapsed = 0 then 0 else completed / elapsed end as rate from x)
select seq, completed, failed, skipped, round(completed * 100.0 / total, 6)::double as percentage, round(elapsed, 6) as elapsed, round(rate, 6) as rate, round(case when rate > 0 then (total - completed) / rate end, 6) as eta from y""",
        "progress_messages": f"""with {oracles.BLOCKS}, x as (select doc_id, pos, page, row_number() over (partition by doc_id order by pos) - 1 as k, count(*) over (partition by doc_id) as n, max(page) over (partition by doc_id) + 1 as pages from blocks)
select doc_id, pos, '[' || (k * 100 // n) || '%] Translating (Block ' || (k + 1) || '/' || n || ') (Page ' || (page + 1) || '/' || pages || ')' as message from x""",
        "overflow_boxes": f"""{boxes} select doc_id, pos, how, round(case how when 'up' then y0 - least(g * 1.2, above) when 'both' then y0 - least(above * 0.8, g * 0.5) else y0 end, 6)::double as new_y0,
  round(case how when 'down' then y1 + least(g * 1.2, below) when 'both' then y1 + least(below * 0.8, g * 0.5) else y1 end, 6)::double as new_y1,
  round(case how when 'fits' then fit when 'reduced' then case when {need('(11.0::double * 0.9)')} * 0.95 <= h then 11.0::double * 0.9 else 11.0::double * 0.85 end else 11.0::double end, 6) as size from r""",
        "overflow_pages": f"""{boxes}, m as (select *, greatest(len(string_split(source_text, chr(10))), ceil(length(source_text) * 0.5 * 11.0::double / 592.0)) * 11.0::double * 1.2 as high from r where how = 'append'),
q as (select doc_id, pos, coalesce(sum(high) over (partition by doc_id order by page, pos rows between unbounded preceding and 1 preceding), 0.0) as start from m)
select doc_id, pos, floor(start / 772)::bigint + 1 as extra_page, round(10 + start % 772, 6) as extra_y from q""",
        "overflow_report": f"""{boxes} select doc_id, '{{"total_overflows":' || count(*) || ',"strategy":"smart","events":[' || string_agg('{{"block_id":' || pos || ',"page":' || page || ',"text_length":' || length(source_text) || ',"strategy":"' || case how when 'append' then 'append_pages' else 'smart' end || '"}}', ',' order by page, pos) || ']}}' as report
  from r where needy group by doc_id""",
        "best_match": f"""with {oracles.BLOCKS}, x as (select doc_id, pos, source_text, doc_id + pos as k from blocks), y as (select *, k * 3 % 10 as a, k * 7 % 10 as b, k * 9 % 10 as c from x)
select doc_id, pos, md5(case when k % 11 = 3 or greatest(a, b, c) <= 7 then case when k % 4 > 0 then source_text end when a >= b and a >= c then '3 ' || source_text when b >= c then '7 ' || source_text else '9 ' || source_text end) as text_hash from y""",
        "language_fonts": """with x as (select case doc_id % 6 when 0 then lower(lang) when 1 then 'ru' when 2 then 'zh-CN' when 3 then 'el' when 4 then 'klingon' else lower(lang) end as code from documents)
select code, script, 'noto-' || script || '.ttf' as font, n from (select code, case code when 'ru' then 'cyrillic' when 'zh-CN' then 'chinese' when 'el' then 'greek' end as script, count(*) as n from x group by code)""",
    }
