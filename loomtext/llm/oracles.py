"""DuckDB SQL for queries that SQL can express."""

from __future__ import annotations

from .licenses import scan_sql
from .quality import FAR, FAR_LENGTH, LAST_BIN, LEVELS, REACH, SHARES


def _quantiles(by: str, points: list[int]) -> str:
    merged = "select " + by + ", share, bin, sum(n) as n from counts group by all"
    ranked = f"select *, sum(n) over (partition by {by}, share order by bin) as upto, sum(n) over (partition by {by}, share) as total from ({merged})"
    return f"select {by}, share, " + ", ".join(f"min(bin) filter (10000 * upto >= {p} * total) as q{p}" for p in points) + f" from ({ranked}) group by {by}, share"


def quality_sql() -> str:
    shares = {"symbols": "1000 * n_symbols // nullif(word_chars, 0)", "dup_lines": "1000 * n_dup_lines // nullif(n_lines, 0)", "repeats": "1000 * n_repeat_words::bigint // nullif(n_words, 0)", "word_length": "50 * word_chars // nullif(n_words, 0)"}
    shares = {k: f"case when {v} > {LAST_BIN[k]} then {LAST_BIN[k]} else {v} end" for k, v in shares.items()}
    union = " union all ".join(f"select lang, source, '{k}' as share, {v} as bin from base where not base_failed" for k, v in shares.items())
    beyond = " or ".join(f"coalesce({v} > most_{k}, false)" for k, v in shares.items())
    most = "case g.share " + " ".join(f"when '{k}' then least(g.q{p}, l.q{FAR[k]})" for k, p in LEVELS.items()) + f" else least(g.q7500 + {REACH} * greatest(g.q7500 - g.q2500, l.q7500 - l.q2500), l.q{FAR_LENGTH}) end"
    own, wide = sorted({2500, 7500, *LEVELS.values()}), sorted({2500, 7500, FAR_LENGTH, *FAR.values()})
    return rf"""
with m as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lined as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from m),
windows as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as v from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from m)),
again as (select doc_id, i from windows qualify count(*) over (partition by doc_id, v) > 1),
covered as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from (select *, lead(i) over (partition by doc_id order by i) as nxt from again) group by doc_id),
base as (select doc_id, lang, source, len(w) as n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines, len(w) < 20 or 100 * coalesce(n, 0) > 30 * len(w) as base_failed from lined left join covered using (doc_id)),
counts as (select lang, source, share, bin, count(*) as n from ({union}) where bin is not null group by all),
limits as (select g.lang, g.source, g.share, {most} as most from ({_quantiles('lang, source', own)}) g join ({_quantiles('lang', wide)}) l on g.lang is not distinct from l.lang and g.share = l.share),
wide as (select lang, source, {', '.join(f"max(most) filter (share = '{k}') as most_{k}" for k in SHARES)} from limits group by lang, source),
judged as (select b.*, {beyond} as far from base b left join wide x on b.lang is not distinct from x.lang and b.source is not distinct from x.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not far as kept from judged"""


def decontamination_sql() -> str:
    word = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with d as (select doc_id, {word} as w from documents),
b as (select item_id, {word} as w from benchmark),
items as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as v from (select *, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
sizes as (select distinct k from items),
found as (select doc_id, i, t.k, v from (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as v from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes)) t where v in (select v from items)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
named as (select doc_id, count(id) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from found join items using (k, v)) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join named using (doc_id)"""


def audit_sql() -> str:
    """Walks every order over every document, without masks' counts."""
    fails = {"A": "n < 100", "B": "100 * len(list_distinct(w)) < 80 * n", "C": "100 * caps > 10 * length(t)", "D": "regexp_matches(t, '[#$%&*|]')", "E": "doc_id > first"}
    flags = ", ".join(f"coalesce({c}, false)::int as {f}" for f, c in fails.items())
    fail = "case substr(o, s::int, 1) " + " ".join(f"when '{f}' then {f}" for f in fails) + " end"
    earlier = " or ".join(f"({f} = 1 and strpos(o, '{f}') < s)" for f in fails)
    return rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
m as (select *, min(doc_id) over (partition by t) as first, regexp_extract_all(t, '[^ 	-
]+') as w, len(regexp_extract_all(t, '[A-Z]')) as caps from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
f as (select part, {flags}, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from (select *, len(w) as n from m) left join l using (doc_id)),
g as (select part, A, B, C, D, E, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select g.*, o, s, substr(o, s::int, 1) as own, {fail} as fail, ({earlier})::int as earlier, A + B + C + D + E as many from g, orders, range(1, 6) r(s)),
y as (select part, o as filter_order, s::int as step, own, sum(n * ((1 - earlier) * (1 - fail)))::bigint as kept, sum(n * (1 - earlier) * fail)::bigint as removed, sum(n * earlier * fail)::bigint as redundant,
  sum(case when fail = 1 and many = 1 then n else 0 end)::bigint as unique_fails, sum(good * (1 - earlier) * fail)::bigint as good_lost, sum(toxic * (1 - earlier) * fail)::bigint as toxic_lost from steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from y"""


def url_sql() -> str:
    return r"""
with r(action, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from a),
p as (select row_number() over () as row_no, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
m as (select row_no, arg_max({'rule': r.host || r.path, 'action': action}, length(r.host) + length(r.path)) as won from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by row_no)
select page_id, host, path, won.rule as rule, coalesce(won.action, 'allow') as verdict from p left join m using (row_no)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_sql(), "op5_license_scan": scan_sql(), "op10_decontamination": decontamination_sql(), "op11_filter_audit": audit_sql(), "op12_url_filters": url_sql()}
