"""DuckDB SQL for the queries' rows."""

from __future__ import annotations

from ..operators.glossary import DEMO
from ..operators.scoring import WEIGHTS
from ..operators.translate import RULES

_WORDS = r"regexp_extract_all({}, '\S+')"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _norm(x: str) -> str:
    return rf"regexp_replace({_trim(f'lower({x})')}, '\s+', ' ', 'g')"


def _count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, '{p}'))"


def _words(x: str) -> str:
    return _WORDS.format(x)


def _blank(x: str) -> str:
    return rf"coalesce({_trim(x)}, '') = ''"


def _gloss(x: str) -> str:
    for a, b in sorted(DEMO, key=lambda p: -len(p[0])):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _ruled(x: str) -> str:
    for a, b in RULES:
        x = f"replace(replace({x}, '{a} ', '{b} '), '{a.capitalize()} ', '{b.capitalize()} ')"
    return x


_T = _trim("source_text")
BLOCKS = rf"""
raw as (select doc_id, lang, unnest(string_split(text, chr(10))) as source_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
lines as (select *, {_T} as t from raw where regexp_matches(source_text, '\S')),
blocks as (select doc_id, lang, pos, source_text, t, pos // 20 as page, 50.0 + 260 * (pos % 2) as x0, 50.0 + 30 * (pos % 20) as y0, 290.0 + 260 * (pos % 2) as x1, 70.0 + 30 * (pos % 20) as y1,
  case when length(t) < 100 and regexp_matches(t, '\p{{Lu}}') and not regexp_matches(t, '\p{{Ll}}') then 'TITLE' when starts_with(lower(t), 'abstract') then 'ABSTRACT'
    when {_count("t", r"\S+")} < 10 and not ends_with(t, '.') then 'HEADING' when contains(t, '$') or contains(t, '\') then 'EQUATION' when regexp_matches(t, '^([•*–-]|\d+\.)') then 'LIST_ITEM' else 'PARAGRAPH' end as block_type from lines)"""
CAN = "block_type not in ('EQUATION', 'CODE', 'HEADER', 'FOOTER', 'METADATA')"
TRANSLATED = (
    BLOCKS
    + rf""",
glossed as (select *, {_gloss("source_text")} as g from blocks),
tr as (select *, {CAN} as can, case (doc_id * 31 + pos) % 17 when 0 then null when 1 then '  ' when 2 then source_text when 3 then left(g, length(g) // 10) else g end as translated_text from glossed)"""
)
B, TR = "with " + BLOCKS, "with " + TRANSLATED
HAS_LETTERS = rf"coalesce(length({{0}}) > 0 and {_count('{0}', r'\p{{L}}')} / nullif(length({{0}}), 0) >= 0.3, false)"
_S, _U = _norm("source_text"), _norm("translated_text")
SIMPLE = rf"coalesce({_S} = {_U} and {_count(_S, r'\p{L}')} >= 0.3 * length({_S}) and length({_S}) >= 5 and {_count(_S, r'\p{L}')} >= 0.4 * length({_S}), false)"
IDENTITY = rf"coalesce({_S} = {_U} and length({_T}) >= 30 and {_count('source_text', r'\S+')} >= 6 and 10 * {_count('source_text', r'\p{Lu}')} <= 7 * {_count('source_text', r'\p{L}')} and 10 * {_count('source_text', r'\p{Nd}')} <= 3 * length(source_text) and 2 * (length(source_text) - length(regexp_replace(source_text, '<<[A-Z_]+_\d+>>|MASK_[A-Z_]+_\d+_MASK', '', 'g'))) <= length(source_text), false)"
#: Java's upper case of sharp s is SS, DuckDB's is one letter.
_UPPER = "upper(replace(source_text, 'ß', 'ss'))"
_DONE = f"{CAN} and not ({_blank('translated_text')})"
_LOST = f"{CAN} and ({_blank('translated_text')})"
_COVER = "case when translatable > 0 then round(translated / translatable, 6) else 1.0 end"
_GLOSS_VALUES = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(DEMO))
GLOSSARY = f"glossary(term_id, term, term_target) as (values {_GLOSS_VALUES})"
PROGRESS = "with r as (select event_type as template, event_id as seq, (user_id % 100)::double as bleu, (event_id % 90)::double as chrf, event_id % 4 <> 0 as success from events)"
LOADED = """loaded as (select lower(p_name) as source, p_brand as target, p_type as domain, p_partkey as load_seq from part
  union all select upper(p_name), p_type, p_type, p_partkey * 3 + 1 from part where (p_partkey * 3 + 1) % 2 = 0),
merged as (select lower(source) as source, target, domain, load_seq from loaded qualify row_number() over (partition by lower(source) order by load_seq desc) = 1)"""
NOTED = BLOCKS + ", noted as (select doc_id, pos, source_text || ' see https://doi.org/10.1000/ab1 and [3,4], (Smith et al., 2020), mail a.b@example.org, $x''+1$ `code` Fig. 2 on page 12' as s from blocks)"
#: RE2 forms of the patterns that both engines read alike.
_RE2 = {
    "latex_apostrophe": r"(?s)(\$[^$]*?[''][^$]*?\$|\\\(.*?\\\))",
    "latex_display": r"\$\$[^$]+\$\$|\\\[[^\]]+\\\]",
    "latex_text_ops": r"(?s)\\(?:text|mathrm|mathbf|mathbb|mathcal|mathfrak|mathsf|operatorname)\{.*?\}",
    "latex_inline": r"\$[^$\n]+\$",
    "latex_inline_paren": r"(?s)\\\(.*?\\\)",
    "latex_escaped_brace": r"\\[{}%]",
    "code_block": r"(?s)```.*?```",
    "code_inline": r"`[^`\n]+`",
    "doi": r"(?:doi:|DOI:|https?://doi\.org/)10\.\d{4,}/\S+",
    "arxiv": r"arXiv:\d{4}\.\d{4,5}(?:v\d+)?",
    "url_full": r"(?:https?|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]*[-A-Za-z0-9+&@#/%=~_|]",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "citation_bracket": r"\[\d+(?:[,-]\d+)*\]",
    "citation_author": r"\([A-Z][a-z]+(?:\s+et\s+al\.?)?,\s*\d{4}\)",
}
CANDIDATES = BLOCKS + rf""",
glossed as (select *, {_gloss("source_text")} as g from blocks),
withprev as (select *, list(g) over (partition by doc_id order by pos rows between 2 preceding and 1 preceding) as previous from glossed),
cand as (select doc_id, lang, pos, source_text, coalesce(previous, []) as previous, unnest([g, source_text, regexp_replace(g, '^\S+\s*', ''), lower(g)]) as text, generate_subscripts([1,2,3,4], 1) - 1 as candidate_id from withprev)"""
_W = _words("text")


def _near(share: str, best: float) -> str:
    return f"greatest(0.0, 1 - abs({share} - {best}) / {best})"


_NUM = r"regexp_extract_all(regexp_replace({0}, '([\p{{L}}_]\d+(\.\d+)?|\d+(\.\d+)?[\p{{L}}_])', '', 'g'), '\d+(\.\d+)?')"
_CAPS = r"list_distinct(list_filter(regexp_extract_all({0}, '\S+'), lambda w: regexp_matches(w, '^\p{{Lu}}')))"
_TERM_SCORE = " + ".join(f"case when contains(lower(text), '{b}') then 1 when contains(lower(text), '{a}') then -1 else 0 end" for a, b in DEMO)
SCORED = (
    CANDIDATES
    + rf""",
w0 as (select *, {_W} as w, {_words("source_text")} as sw, list_transform(string_split(text, '. '), lambda s: len({_words("s")})) as lens from cand),
w1 as (select *, len(w) as n, coalesce(list_max(map_values(list_histogram(list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: lower(x))))), 1) as most,
  list_sum(lens) / len(lens) as lmean, {_CAPS.format("source_text")} as scaps, {_CAPS.format("text")} as tcaps,
  len(regexp_extract_all(source_text, '[(\[]')) as so, len(regexp_extract_all(text, '[(\[]')) as t_o from w0),
w2 as (select *, 1 - least(most / n, 0.3) / 0.3 as f1, case when len(lens) > 1 then least(sqrt(list_sum(list_transform(lens, lambda x: (x - lmean) * (x - lmean))) / len(lens)) / 10, 1.0) end as f2,
  {_near("len(regexp_extract_all(text, '[.,;:!?]')) / n", 0.15)} as f3, {_near("len(list_filter(w, lambda x: regexp_matches(x, '^" + chr(92) + "p{Lu}'))) / n", 0.1)} as f4,
  case when len(sw) > 0 then 1 - least(abs(n / len(sw) - 1), 0.5) / 0.5 end as a1,
  case when len(scaps) > 0 then len(list_intersect(scaps, tcaps)) / len(scaps) end as a3, case when so > 0 then least(t_o / so, 1.0) end as a4,
  case when len({_NUM.format("source_text")}) > 0 then len(list_filter({_NUM.format("source_text")}, lambda x: list_contains({_NUM.format("text")}, x))) / len({_NUM.format("source_text")}) end as a2 from w1),
often as (select doc_id, pos, list(word) as words from (select doc_id, pos, word, count(*) as c from (select distinct doc_id, pos, previous from cand) p, unnest(p.previous) as u(p1), unnest(regexp_extract_all(lower(u.p1), '\S+')) as v(word) where length(word) > 4 group by all) where c >= 2 group by doc_id, pos),
scored as (select w2.doc_id, lang, w2.pos, candidate_id, text,
  case when n = 0 then 0.0 else (f1 + coalesce(f2, 0) + f3 + f4) / (3 + (f2 is not null)::int) end as fluency,
  case when a1 is null and a2 is null and a3 is null and a4 is null then 0.5 else (coalesce(a1, 0) + coalesce(a2, 0) + coalesce(a3, 0) + coalesce(a4, 0)) / ((a1 is not null)::int + (a2 is not null)::int + (a3 is not null)::int + (a4 is not null)::int) end as adequacy,
  greatest(0.0, least(1.0, ({_TERM_SCORE}) / {len(DEMO)}.0)) as terminology,
  ((contains(text, 'de')::int + contains(text, 'a')::int) / 2.0 + regexp_matches(text, '(?m)^\s*[\d•\-*]\s')::int) / (1 + regexp_matches(text, '(?m)^\s*[\d•\-*]\s')::int) as format,
  case when words is null then 1.0 else len(list_filter(words, lambda x: contains(lower(text), x))) / len(words) end as consistency from w2 left join often using (doc_id, pos)),
totals as (select *, """
    + " + ".join(f"{w} * {k}" for k, w in WEIGHTS.items())
    + " as total from scored)"
)
CACHE = (
    BLOCKS
    + """,
keyed as (select doc_id, pos, left(sha256(lang || '|fr|' || source_text), 32) as key, source_text from blocks),
cache as (select key, min(source_text) as value, min(doc_id) as insert_seq, timestamp '2024-06-10' - to_days((min(doc_id) % 11)::int) as ts from keyed where doc_id % 3 = 0 group by key)"""
)
LIVE = "ts > timestamp '2024-06-10' - interval 7 days"
BOXES = BLOCKS + ", det as (select doc_id, page, pos as det_idx, case when pos % 2 = 0 then 'text' else 'figure' end as cls, x0 + (pos % 5) * 40.0 as x0, y0, x1 + (pos % 5) * 40.0 as x1, y1 from blocks)"
_IW, _IH = "(least(b.x1, d.x1) - greatest(b.x0, d.x0))", "(least(b.y1, d.y1) - greatest(b.y0, d.y0))"
IOU = f"case when {_IW} > 0 and {_IH} > 0 then {_IW} * {_IH} / ((b.x1 - b.x0) * (b.y1 - b.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) - {_IW} * {_IH}) else 0.0 end"
RECORDS = "records as (select event_type as template, event_id as seq, (user_id % 100)::double as bleu, event_id % 4 <> 0 as success from events)"


def _ngram(kind: str, most: int) -> str:
    if kind == "word":
        split, sep = lambda x: f"regexp_extract_all(coalesce({x}, ''), '{chr(92)}S+')", " "
    else:
        split, sep = lambda x: f"list_filter(string_split(regexp_replace(coalesce({x}, ''), '{chr(92)}s', '', 'g'), ''), lambda c: c <> '')", " "
    grams = lambda side: f"select lang, doc_id, pos, n, array_to_string({side}[i:i + n - 1], '{sep}') as v, count(*) as c from (select *, unnest(range(1, len({side}) - n + 2)) as i from tok, orders where h <> r) group by all"
    return f"""tok as (select lang, doc_id, pos, {split("translated_text")} as h, {split("g")} as r from tr),
orders as (select unnest(range(1, {most + 1})) as n),
hg as ({grams("h")}),
rg as ({grams("r")}),
parts as (select lang, n, coalesce(hg.c, 0) as h, coalesce(rg.c, 0) as r, least(coalesce(hg.c, 0), coalesce(rg.c, 0)) as m from hg full join rg using (lang, doc_id, pos, n, v)
  union all select lang, n, g, g, g from (select lang, n, greatest(len(h) - n + 1, 0) as g from tok, orders where h = r)),
per as (select lang, n, sum(h) as h, sum(r) as r, sum(m) as m from parts group by lang, n)"""


def oracle_sql() -> dict[str, str]:
    shown = f"case when {_blank('translated_text')} then source_text else translated_text end"
    found = {
        "block_stats_by_lang": f"{B} select lang, count(*) as blocks, count(*) filter ({CAN}) as translatable, round(avg(length(source_text)), 6) as mean_length from blocks group by lang",
        "block_type_counts": f"{B} select lang, block_type, count(*) as n from blocks group by all",
        "split_blocks_scan": f"{B} select doc_id, pos, source_text from blocks",
        "page_range_scan": f"{B} select doc_id, pos, page from blocks where page >= 1 and page < 3",
        "translatable_filter": f"{B} select doc_id, pos, block_type from blocks where {CAN}",
        "skip_reasons": f"{B} select doc_id, pos, block_type, 'non_translatable_content' as reason from blocks where not ({CAN})",
        "doc_stats": f"{TR}, x as (select doc_id, count(*) as blocks, count(*) filter (can) as translatable, count(*) filter ({_DONE}) as translated, count(distinct block_type) as types from tr group by doc_id) select doc_id, blocks, translatable, translated, round(100 * {_COVER}, 4) as progress, types from x",
        "char_class_ratios": rf"{B} select doc_id, pos, round({_count('source_text', r'\p{L}')} / length(source_text), 6) as letters, round({_count('source_text', r'\p{Lu}')} / length(source_text), 6) as upper, round({_count('source_text', r'\p{Nd}')} / length(source_text), 6) as digits, round((length(source_text) - length(regexp_replace(source_text, '<<[A-Z_]+_\d+>>|MASK_[A-Z_]+_\d+_MASK', '', 'g'))) / length(source_text), 6) as placeholders, {HAS_LETTERS.format('t')} as has_letters from blocks",
        "normalized_text_hash": f"{B} select doc_id, pos, md5(source_text) as content_hash, md5({_norm('source_text')}) as normal_hash, left(md5(source_text), 8) as short_hash from blocks",
        # the lead-in stays where the removed reasoning leaves a space before it
        "clean_output": f"{B} select doc_id, pos, case pos % 4 when 3 then '<thinking></thinking>' when 0 then 'Translation: ' || t else t end as cleaned, pos % 4 <> 2 as wrapped from blocks",
        "postprocess_text": rf"{B} select doc_id, pos, regexp_replace(regexp_replace({_gloss('source_text')}, '[ \t]+', ' ', 'g'), ' +([.,;:!?])', '\1', 'g') || '.' || chr(10) || chr(10) || '''end'';' as text from (select doc_id, pos, {_trim('source_text')} as source_text from blocks)",
        "reflow_text": "select doc_id, array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p: replace(p, chr(10), ' ')), chr(10) || chr(10)) as text from documents",
        "text_previews": f"{B} select doc_id, pos, " + ", ".join(f"case when length(source_text) > {n} then left(source_text, {n}) || '...' else source_text end as p{n}" for n in (50, 100, 200)) + " from blocks",
        "mask_counts_by_type": f"with {NOTED} " + " union all ".join(f"select '{k}' as mask_type, sum(len(regexp_extract_all(s, '{p}')))::bigint as n from noted" for k, p in _RE2.items()),
        "mask_roundtrip": f"{B} select doc_id, pos, true as same, 0 as missing, true as all_restored, true as all_present from blocks",
        "residue_cleanup": rf"{B} select doc_id, pos, trim(regexp_replace(regexp_replace(' ' || regexp_replace(source_text, '<<[^<>]*>>', '', 'g') || ' ', '\.{{3,}}', '', 'g'), ' {{2,}}', ' ', 'g'), ' ') as text from blocks",
        "template_progress": f"{PROGRESS}, w as (select *, row_number() over (partition by template order by seq desc) - 1 as k from r) select template, round(sum(0.1 * pow(0.9, k) * bleu), 6) as bleu, round(sum(0.1 * pow(0.9, k) * chrf), 6) as chrf, round(avg(success::int), 6) as success_rate, count(*) as usage from w group by template",
        "template_progress_resumed": f"{PROGRESS}, w as (select *, row_number() over (partition by template order by seq % 2 desc, seq desc) - 1 as k from r) select template, round(sum(0.1 * pow(0.9, k) * bleu), 6) as bleu, round(sum(0.1 * pow(0.9, k) * chrf), 6) as chrf, round(avg(success::int), 6) as success_rate, count(*) as usage from w group by template",
        "score_write_back": "with l as (select doc_id::varchar as document_id, unnest(string_split(coalesce(text, ''), chr(10))) as t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as k from documents) select document_id, count(*) as blocks, round(sum(case when k % 3 = 1 then round(length(t) / 1000, 3) else 0.5 end), 3) as total, count(*) filter (k % 3 = 1) as missing, md5(coalesce(string_agg('<<M_' || k || '>>', ',' order by '<<M_' || k || '>>') filter (k % 3 = 1), '')) as missing_hash from l group by document_id",
        "cache_upsert": f"{B}, b as (select doc_id, pos, source_text as t from blocks where pos < 3), e as (select t, 'one ' || doc_id as value, timestamp '2024-06-10' - to_days((doc_id % 9)::int) as ts from b where doc_id % 2 = 0 union all select t, 'two ' || doc_id, timestamp '2024-06-10' - to_days(((doc_id + 4) % 9)::int) from b where doc_id % 3 = 0), c as (select t, value from e where ts > timestamp '2024-06-10' - interval 7 days qualify row_number() over (partition by t order by ts desc, value desc) = 1) select doc_id, pos, value as cached from b left join c using (t)",
        "context_window_segments": f"{B}, x as (select doc_id, pos, list(source_text) over (partition by doc_id, page order by pos rows between 3 preceding and 3 following) as c from blocks) select doc_id, pos, md5(array_to_string(c, chr(10))) as context_hash, len(c) as n from x",
        "validation_masks": f"{B}, x as (select doc_id, count(*) filter ({CAN}) as translatable, count(*) filter ({CAN} and pos % 4 <> 1) as translated, 0 as identity_blocks, count(*) filter (pos % 4 = 0) as missing_masks from blocks group by doc_id) select *, {_COVER} as coverage, missing_masks = 0 and translated = translatable as is_valid, missing_masks > 0 or translated < translatable as has_errors from x",
        "validation_texts": rf"""{B}, m as (select *, {CAN} as can, len(regexp_extract_all(source_text, '\[\d+(?:[,-]\d+)*\]')) + 1 as masks from blocks),
k as (select *, coalesce(sum(masks) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + 1 as first_no from m),
c as (select doc_id, count(*) filter (can) as n, count(*) filter (can and pos % 4 <> 1) as done, count(*) filter (can and pos % 4 = 1) as gone, count(*) filter (pos % 4 = 0) as lost, (list(pos::varchar order by pos) filter (can and pos % 4 = 1))[:5] as gone_at, (list(pos || ' <<CITATION_BRACKET_' || lpad(first_no::bigint::varchar, greatest(4, length(first_no::bigint::varchar))::int, '0') || '>> (citation_bracket)' order by pos) filter (pos % 4 = 0))[:5] as lost_at from k group by doc_id)
select doc_id, case when lost = 0 and done = n then 'valid' else 'not valid' end || ': ' || done || ' of ' || n || ' blocks translated' || case when gone > 0 then chr(10) || gone || ' without a translation: ' || array_to_string(gone_at, ', ') || case when gone > 5 then ' and ' || (gone - 5) || ' more' else '' end else '' end || case when lost > 0 then chr(10) || lost || ' lost placeholders: ' || array_to_string(lost_at, ', ') || case when lost > 5 then ' and ' || (lost - 5) || ' more' else '' end else '' end as report from c""",
        "glossary_many_terms": f"{B}, words as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) as term from benchmark) select term, count(*) as blocks, count(distinct doc_id) as documents from blocks join words on case when starts_with(term, 't') then contains(source_text, term) else contains(lower(source_text), lower(term)) end group by term",
        "glossary_term_hits": f"{B}, {GLOSSARY} select doc_id, pos, term from blocks join glossary on contains(lower(source_text), lower(term))",
        "glossary_adherence": f"{TR}, {GLOSSARY}, x as (select lang, count(*) as found, count(*) filter (contains(lower(coalesce(translated_text, '')), term_target)) as enforced from tr join glossary on contains(lower(source_text), term) group by lang) select l.lang, coalesce(found, 0) as found, coalesce(enforced, 0) as enforced, round(coalesce(enforced / nullif(found, 0), 1.0), 6) as rate from (select distinct lang from tr) l left join x using (lang)",
        "glossary_apply": f"{B} select doc_id, pos, {_gloss('source_text')} as text from blocks",
        "glossary_prompt_section": f"{B}, {GLOSSARY}, h as (select doc_id, pos, term_id, '- ' || term || ' -> ' || term_target as line from blocks join glossary on contains(lower(source_text), term) qualify row_number() over (partition by doc_id, pos order by term_id) <= 3) select doc_id, pos, 'Glossary:' || chr(10) || string_agg(line, chr(10) order by term_id) as section from h group by doc_id, pos",
        "glossary_merge_override": f"with {LOADED} select source, load_seq from merged",
        "glossary_swap": f"with {LOADED} select target as source, source as target from loaded",
        "glossary_by_domain": f"with {LOADED} select domain, count(*) as total_terms from merged group by domain",
        "glossary_lookup": f"with {LOADED} select p_partkey, load_seq from part left join merged on lower(p_name) = source",
        "learned_glossary": rf"{TR}, x as (select lang, doc_id, pos, regexp_extract(lower(translated_text), '\S+') as target, unnest({_words('lower(source_text)')}) as word, generate_subscripts({_words('lower(source_text)')}, 1) as k from tr where not ({_blank('translated_text')})) select lang, word, arg_min(target, (doc_id, pos, k)) as target from x where length(word) > 3 and word not in ('the', 'and', 'for', 'with', 'that') group by lang, word",
        "missing_translations": f"{TR} select doc_id, pos, case when {_blank('translated_text')} then 'missing_translation' else 'identity_translation' end as reason from tr where can and ({_blank('translated_text')} or {SIMPLE})",
        "identity_failures": f"{TR} select doc_id, pos from tr where {IDENTITY}",
        "truncation_suspects": rf"{TR} select doc_id, pos from tr where length(translated_text) > 0 and (pos % 13 = 5 or (length(source_text) > 300 and length(translated_text) < 0.15 * length(source_text)) or (length(source_text) > 200 and length(translated_text) < 0.4 * length(source_text) and regexp_replace(translated_text, '\s+$', '') <> '' and not regexp_matches(regexp_replace(translated_text, '\s+$', ''), '[.!?。！？]$')))",
        "coverage_by_doc": f"{TR}, x as (select doc_id, count(*) filter (can) as translatable, count(*) filter ({_DONE}) as translated from tr group by doc_id) select *, {_COVER} as coverage from x",
        "coverage_rollup_page": f"{TR} select doc_id, page, count(*) as total, count(*) filter ({_DONE}) as translated, count(*) filter ({_LOST}) as errors from tr group by rollup (doc_id, page)",
        "failure_report": f"{TR} select doc_id, pos, page, list_position(['PARAGRAPH', 'HEADING', 'SUBHEADING', 'EQUATION', 'CODE', 'TABLE', 'FIGURE', 'CAPTION', 'LIST_ITEM', 'REFERENCE', 'FOOTNOTE', 'HEADER', 'FOOTER', 'ABSTRACT', 'TITLE'], block_type) as type_ordinal, case when length(source_text) > 100 then left(source_text, 100) || '...' else source_text end as preview, case when {_blank('translated_text')} then 'missing_translation' else 'identity_translation' end as reason from tr where can and ({_blank('translated_text')} or {SIMPLE})",
        "final_guard": f"{TR} select doc_id, pos, case when not ({_blank('translated_text')}) then translated_text when pos % 3 = 0 then '[2] ' || source_text else source_text end as final_text, case when not ({_blank('translated_text')}) then 0 when pos % 3 = 0 then 1 else 2 end as attempt from tr",
        "failed_semi_join": f"{TR} select lang, count(*) as n from tr where can and ({_blank('translated_text')} or {SIMPLE}) group by lang",
        "validation_summary": f"{TR}, x as (select doc_id, count(*) filter (can) as translatable, count(*) filter ({_DONE}) as translated, count(*) filter (can and {IDENTITY}) as identity_blocks, 0 as missing_masks from tr group by doc_id) select *, {_COVER} as coverage, identity_blocks = 0 and translated = translatable as is_valid, identity_blocks > 0 or translated < translatable as has_errors from x",
        "quality_gate": f"{TR} select doc_id, pos, coalesce(not ({_blank('translated_text')}) and translated_text <> source_text and contains(translated_text, 'e') and pos % 5 <> 0, false) as passed from tr",
        "numeric_consistency": rf"{TR}, p as (select lang, '1,5 and 12 ' || source_text as s, case when pos % 2 = 0 then '1.5 et 13 ' || translated_text else translated_text end as t from tr), q as (select lang, list_distinct(list_transform(regexp_extract_all(s, '[+-]?\d+(?:[.,]\d+)?'), lambda v: replace(v, ',', '.'))) as a, list_distinct(list_transform(regexp_extract_all(coalesce(t, ''), '[+-]?\d+(?:[.,]\d+)?'), lambda v: replace(v, ',', '.'))) as b from p), x as (select lang, sum(len(a)) as numbers, sum(len(list_intersect(a, b))) as kept from q group by lang) select lang, numbers, kept, case when numbers > 0 then round(kept / numbers, 6) else 1.0 end as consistency from x",
        "layout_fidelity": f"{TR}, x as (select doc_id, count(*) filter (pos % 7 <> 3) as translatable, count(*) filter (pos % 7 <> 3 and not ({_blank('translated_text')})) as translated from tr group by doc_id) select doc_id, translatable as boxed, translated as filled, {_COVER} as fidelity from x",
        "context_window": f"{B}, x as (select doc_id, pos, list(source_text) over (partition by doc_id order by pos rows between 3 preceding and 3 following) as c from blocks) select doc_id, pos, md5(array_to_string(c, chr(10))) as context_hash, len(c) as n from x",
        "block_context": f"{TR}, x as (select doc_id, pos, coalesce(list_filter(list(case when not ({_blank('translated_text')}) then translated_text end) over (partition by doc_id order by pos rows between 5 preceding and 1 preceding), lambda v: v is not null), []) as c from tr) select doc_id, pos, len(c) as n, md5(array_to_string(c, chr(10))) as context_hash from x",
        "previous_translations": f"{TR}, x as (select doc_id, pos, coalesce(list_filter(list(case when can and not ({_blank('translated_text')}) then translated_text end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), lambda v: v is not null), []) as c from tr) select doc_id, pos, len(c[-3:]) as n, md5(array_to_string(c[-3:], chr(10))) as previous_hash from x",
        "block_links": f"{B} select doc_id, pos, row_number() over w as block_no, lag(pos) over w as previous_pos, lead(pos) over w as next_pos from blocks window w as (partition by doc_id order by pos)",
        "score_dimensions": f"with {SCORED} select doc_id, pos, candidate_id, round(fluency, 6) as fluency, round(adequacy, 6) as adequacy, round(terminology, 6) as terminology, round(format, 6) as format from scored",
        "score_consistency": f"with {SCORED} select doc_id, pos, candidate_id, round(consistency, 6) as consistency from scored",
        "rerank_best": f"with {SCORED}, x as (select *, contains(text, 'de') and contains(text, 'a') as ok from totals), y as (select *, count(*) filter (ok) over (partition by doc_id, pos) as k from x) select doc_id, pos, candidate_id from y where k = 0 or ok qualify row_number() over (partition by doc_id, pos order by round(total, 6) desc, candidate_id) = 1",
        "rerank_stats": f"with {SCORED}, x as (select doc_id, pos, max(total) as best, count(*) as n, max(total) filter (candidate_id = 0) as f from totals group by all) select count(*) as blocks, round(avg(best), 6) as mean_best, round(stddev_pop(best), 6) as std_best, round(avg(n), 6) as mean_candidates, round(avg(best - f), 6) as mean_gain from x",
        "score_report_tiers": f"with {SCORED} select lang, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in (*WEIGHTS, "total")) + ", count(*) filter (round(total, 6) < 0.5) as low, count(*) filter (round(total, 6) >= 0.5 and round(total, 6) < 0.8) as medium, count(*) filter (round(total, 6) >= 0.8) as high from totals group by lang",
        "worst_blocks": f"with {SCORED} select doc_id, pos, round(total, 6) as total from totals where candidate_id = 0 order by 3, 1, 2 limit 20",
        "cache_lookup": f"with {CACHE} select k.doc_id, k.pos, c.key is not null as hit from keyed k left join (select key from cache where {LIVE}) c using (key)",
        "cache_miss": f"with {CACHE} select doc_id, pos from keyed where key not in (select key from cache where {LIVE})",
        "cache_stats": f"with {CACHE}, x as (select k.key, c.key as hit from keyed k left join (select key from cache where {LIVE}) c using (key)) select count(*) as total, count(hit) as hits, count(distinct key) as distinct_texts, count(*) - count(distinct key) as deduplicated, round(count(hit) / count(*), 6) as hit_rate from x",
        "cache_fifo_evict": f"with {CACHE} select left(key, 1) as shard, key from cache qualify row_number() over (partition by left(key, 1) order by insert_seq desc, key desc) <= 10",
        "cascade_failover": f"{B} select lang, case pos % 4 when 0 then 0 when 2 then 1 when 1 then 2 end as service, count(*) as n from blocks group by all",
        "bleu_corpus": f"{TR}, {_ngram('word', 4)}, k as (select *, pow(2, sum(case when m = 0 then 1 else 0 end) over (partition by lang order by n)) as z from per), x as (select lang, avg(ln(case when m = 0 then 1 / (z * h) else m / h end)) filter (h > 0) as s, max(h) filter (n = 1) as hw, max(r) filter (n = 1) as rw, max(m) filter (n = 1) as mw from k group by lang) select lang, round(case when mw = 0 then 0.0 else (case when hw < rw then exp(1 - rw / hw) else 1.0 end) * exp(s) end, 6) as bleu from x",
        "chrf_corpus": f"{TR}, {_ngram('char', 6)}, x as (select lang, avg(m / h) filter (h > 0 and r > 0) as p, avg(m / r) filter (h > 0 and r > 0) as q from per group by lang) select lang, round(5 * p * q / (4 * p + q), 6) as chrf from x",
        "metric_bundle": rf"{TR}, {GLOSSARY}, p as (select lang, list_distinct(list_transform(regexp_extract_all(source_text, '[+-]?\d+(?:[.,]\d+)?'), lambda v: replace(v, ',', '.'))) as a, list_distinct(list_transform(regexp_extract_all(coalesce(translated_text, ''), '[+-]?\d+(?:[.,]\d+)?'), lambda v: replace(v, ',', '.'))) as b from tr), c as (select lang, case when sum(len(a)) > 0 then round(sum(len(list_intersect(a, b))) / sum(len(a)), 6) else 1.0 end as consistency from p group by lang), l as (select lang, round(count(*) filter (not ({_blank('translated_text')})) / count(*), 6) as fidelity from tr group by lang), g as (select lang, round(count(*) filter (contains(lower(coalesce(translated_text, '')), term_target)) / count(*), 6) as adherence from tr join glossary on contains(lower(source_text), term) group by lang) select lang, consistency, fidelity, coalesce(adherence, 1.0) as adherence, null::double as comet from c join l using (lang) left join g using (lang)",
        "dedup_translate": f"{B} select doc_id, pos, md5({_ruled('source_text')}) as translated_hash from blocks",
        "repair_failed": f"{TR} select status, count(*) as n from (select case when not can or not ({_blank('translated_text')} or {SIMPLE}) then 'ok' when pos % 2 = 0 and not ({SIMPLE.replace(_U, _norm(_UPPER))}) then 'repaired_0' else 'repaired_1' end as status from tr) group by status",
        "iou_match": f"with {BOXES}, x as (select b.doc_id, b.pos, d.det_idx, d.cls, {IOU} as iou from blocks b join det d using (doc_id, page)), y as (select * from x where iou > 0.3 qualify row_number() over (partition by doc_id, pos order by round(iou, 9) desc, det_idx) = 1) select b.doc_id, b.pos, det_idx, cls, round(iou, 6) as iou from blocks b left join y using (doc_id, pos)",
        "layout_iou_mean": f"with {BOXES}, x as (select b.doc_id, b.pos, coalesce(max(case when d.doc_id is null then null else {IOU} end), 0.0) as best from (select * from blocks where page = 0) b left join (select * from det where page = 0) d using (doc_id) group by all) select doc_id, round(avg(best), 6) as mean_iou, round(avg((best > 0.3)::int), 6) as share from x group by doc_id",
        "column_detection": f"{B}, x as (select distinct doc_id, page, x0 from blocks), y as (select *, coalesce((x0 - lag(x0) over (partition by doc_id, page order by x0) >= 50)::int, 0) as new from x) select doc_id, page, sum(new) + 1 as columns from y group by all",
        "reading_order": f"{B} select doc_id, pos, row_number() over (partition by doc_id order by page, y0, x0, pos) as reading_no from blocks",
        "placement_plan": f"{B}, x as (select doc_id, pos, 50.0 + coalesce(sum(15.0 * ceil(greatest(length(source_text), 1) / 80.0) + 10) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0.0) as y from blocks) select doc_id, pos, y, y <= 750 as fits from x",
        "render_text": f"{TR} select doc_id, string_agg({shown}, chr(10) || chr(10) order by pos) as text from tr group by doc_id",
        "render_markdown": f"{TR} select doc_id, string_agg(case when block_type = 'TITLE' then '# ' || s when block_type = 'HEADING' then '## ' || s when block_type = 'EQUATION' then '$$' || s || '$$' else s end, chr(10) || chr(10) order by pos) as text from (select *, {shown} as s from tr) group by doc_id",
        "extraction_report": f"{B} select doc_id, pos, block_type, {CAN} as is_translatable, case when length(source_text) > 200 then left(source_text, 200) || '...' else source_text end as text, length(source_text) as length from blocks",
        "template_best": f"with {RECORDS} select template from (select template, avg(bleu) as b, avg(success::int) as s, count(*) as u, min(seq) as k from records group by template) where u >= 10 order by round(0.8 * b / 100 + 0.2 * s, 9) desc, k limit 1",
        "template_weak": f"with {RECORDS} select template, round(avg(bleu), 6) as bleu, avg(bleu) < 30 as strong from (select * from records order by seq desc limit 100) group by template having avg(bleu) < 90",
        "cost_by_model": "select model, sum(tokens) as tokens, round(sum(tokens / 1000 * coalesce(rate, 0)), 6) as cost from (select event_type as model, user_id * 7 % 1000 as tokens from events) left join (values ('click', 0.005), ('view', 0.003), ('signup', 0.00014), ('purchase', 0.01)) r(model, rate) using (model) group by model",
        "rate_window": "select time_bucket(interval 1 hour, ts) as window_start, count(*) as calls, count(*) > 30 as over_limit from events group by 1",
        "circuit_breaker_islands": "with o as (select event_type as service, event_id as seq, ts, user_id % 3 = 0 as ok from events), x as (select *, sum(ok::int) over (partition by service order by ts, seq) as run from o) select service, min(ts) as first_ts, max(ts) as last_ts, count(*) as length from x where not ok group by service, run having count(*) >= 3",
        "conversation_context": "with x as (select conv_id, turn, list(text) over (partition by conv_id order by turn rows between 2 preceding and 2 following) as c from conversations) select conv_id, turn, len(c) as n, md5(array_to_string(c, chr(10))) as context_hash from x",
    }
    bundle, bleu, chrf = (found[k] for k in ("metric_bundle", "bleu_corpus", "chrf_corpus"))
    return found | {"metric_bundle_full": f"select * from ({bundle}) join ({bleu}) using (lang) join ({chrf}) using (lang)"}
