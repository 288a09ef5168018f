"""Queries for translation in order and by concurrent clients over the whole driver tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import client, sequential
from . import oracles
from .queries import _blocks


def _in_context(request: sequential.Request) -> list[str]:
    """An answer that depends on the translations before it; by its text's length it raises, is empty or repeats the text."""
    n = len(request.text)
    if n % 11 == 5:
        raise RuntimeError("no answer")
    if n % 7 == 3:
        return [""]
    if n % 13 == 6:
        return [request.text]
    last = request.context[-1][1] if request.context else ""
    return [f"{len(request.context)}.{len(last)} {request.text}"]


def _fallback(request: sequential.Request) -> list[str]:
    return ["[f] " + request.text] if len(request.text) % 2 else []


def sequential_translation(spark: SparkSession, sf: str) -> DataFrame:
    x = sequential.translate_in_order(_blocks(spark, sf), _in_context, _fallback, how=sequential.Settings(window=3))
    return x.select("doc_id", "pos", "status", "context_used", F.md5("translated_text").alias("text_hash"))


class _Moody:
    """A service that, by its text's length, is busy twice or always, fails, gives nothing, or answers. It holds only the texts that it is busy with."""

    def __init__(self) -> None:
        self.calls: dict[str, int] = {}

    def __call__(self, text: str) -> str:
        k = len(text) % 5
        if k == 3:
            raise client.Busy("429")
        if k == 0:
            n = self.calls.pop(text, 0)
            if n < 2:
                self.calls[text] = n + 1
                raise client.Busy("429")
        if k == 1:
            raise ValueError("broken")
        return "" if k == 2 else "[a] " + text


def _second(text: str) -> str:
    if len(text) % 3 == 0:
        raise ValueError("broken")
    return "[b] " + text


def concurrent_translation(spark: SparkSession, sf: str) -> DataFrame:
    x = client.translate_concurrently(_blocks(spark, sf), [("a", _Moody()), ("b", _second)], client.Policy(in_flight=4), sleep=_no_wait)
    return x.select("doc_id", "pos", "service", "calls", "busy", "waited", "error", F.md5("translated_text").alias("text_hash"))


def _no_wait(seconds: float) -> None:
    """The doubles are ready at once."""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (sequential_translation, concurrent_translation)}


def oracle_sql() -> dict[str, str]:
    b = oracles.B
    return {
        "sequential_translation": f"""with recursive {oracles.BLOCKS},
kinds as (select doc_id, pos, source_text, length(source_text) as n, {oracles.CAN} as can, row_number() over (partition by doc_id order by pos) as k, min(row_k) over (partition by doc_id, source_text) as first_k from (select *, row_number() over (partition by doc_id order by pos) as row_k from blocks)),
told as (select *, case when not can then 'skipped' when n % 11 = 5 then 'failed' when n % 7 = 3 or n % 13 = 6 then case when n % 2 = 1 then 'fallback' else 'source' end when k > first_k then 'cached' else 'translated' end as status from kinds),
r as (select doc_id, 0::bigint as k, []::bigint[] as lens, 0::bigint as pairs, 0::bigint as last from (select distinct doc_id from told)
  union all select r.doc_id, t.k, list_append(r.lens, case t.status when 'skipped' then 0 when 'failed' then 0 when 'source' then t.n when 'fallback' then t.n + 4 when 'cached' then r.lens[t.first_k] else length(c.pairs::varchar) + length(c.last::varchar) + 2 + t.n end), c.pairs, c.last
  from r join told t on t.doc_id = r.doc_id and t.k = r.k + 1, lateral (select len(f) as pairs, coalesce(f[-1], 0) as last from (select list_filter(r.lens[greatest(1, len(r.lens) - 2):], lambda x: x > 0) as f)) c)
select doc_id, pos, status, case when status in ('skipped', 'cached') then 0 else pairs end::int as context_used,
  md5(case status when 'source' then source_text when 'fallback' then '[f] ' || source_text when 'translated' then pairs || '.' || last || ' ' || source_text when 'cached' then first_pairs || '.' || first_last || ' ' || source_text end) as text_hash
from (select t.*, r.pairs, r.last, q.pairs as first_pairs, q.last as first_last from told t join r using (doc_id, k) join r q on q.doc_id = t.doc_id and q.k = t.first_k)""",
        "concurrent_translation": f"""{b}, x as (select doc_id, pos, source_text, length(source_text) % 5 as k, length(source_text) % 3 = 0 as off from blocks),
y as (select *, case when k in (0, 4) then 'a' when not off then 'b' end as service from x)
select doc_id, pos, service, case k when 0 then 3 when 4 then 1 when 1 then 2 else case when k = 2 or k = 3 then 4 end end::int as calls, case k when 0 then 2 when 3 then 3 else 0 end::int as busy, case k when 0 then 6.0 when 3 then 12.0 else 0.0 end::double as waited,
  case when service is null then 'b: broken' end as error, md5(case when service is null then source_text else '[' || service || '] ' || source_text end) as text_hash from y""",
    }
