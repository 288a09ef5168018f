"""Queries over the whole driver tables, one or more for each operator.

Pages, boxes, translations with faults, candidates and the like are derived from documents by the same rule here and in oracles.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import cache, context, coverage, glossary, layout, masking, metrics, report, scoring, translate
from ..sources.blocks import blocks as split_blocks
from ..sources.blocks import read_table
from ..streaming import events

TERMS = glossary.DEMO
_rewrite = glossary.rewrite(TERMS)
_all: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _all[f.__name__] = f
    return f


def _blocks(spark, sf) -> DataFrame:
    return split_blocks(read_table(spark, sf, "documents"))


def _translated(spark, sf) -> DataFrame:
    """Blocks with a glossary translation and injected faults: missing, blank, copied, cut."""
    g = _rewrite(F.col("source_text"))
    fault = (F.col("doc_id") * 31 + F.col("pos")) % 17
    t = F.when(fault == 0, None).when(fault == 1, "  ").when(fault == 2, F.col("source_text")).when(fault == 3, F.substring(g, F.lit(1), F.floor(F.length(g) / 10).cast("int"))).otherwise(g)
    # made once for each row: predicates on it stay behind the generator
    return _blocks(spark, sf).withColumn("translated_text", F.explode(F.array(t)))


def _candidates(spark, sf) -> DataFrame:
    """Four candidates for each block, with two placeholders to keep and the two previous glossary translations."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-2, -1)
    g = F.col("_g")
    b = _blocks(spark, sf).withColumn("_g", _rewrite(F.col("source_text"))).withColumn("previous", F.collect_list(g).over(w))
    texts = F.array(g, F.col("source_text"), F.regexp_replace(g, r"^\S+\s*", ""), F.lower(g))
    mask = lambda p: F.struct(F.lit(p).alias("placeholder"))
    return scoring.prepared(b).select("doc_id", "lang", "pos", "source_text", "previous", "_source", "_often", F.array(mask("de"), mask("a")).alias("masks"), F.posexplode(texts).alias("candidate_id", "text"))


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@query
def block_stats_by_lang(spark, sf):
    b = _blocks(spark, sf)
    return b.groupBy("lang").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(tx.is_translatable("block_type")).alias("translatable"), _r(F.avg(F.length("source_text"))).alias("mean_length"))


@query
def block_type_counts(spark, sf):
    return _blocks(spark, sf).groupBy("lang", "block_type").agg(F.count(F.lit(1)).alias("n"))


@query
def split_blocks_scan(spark, sf):
    return _blocks(spark, sf).select("doc_id", "pos", "source_text")


@query
def page_range_scan(spark, sf):
    return layout.pages(_blocks(spark, sf), 1, most=2).select("doc_id", "pos", "page")


@query
def translatable_filter(spark, sf):
    return _blocks(spark, sf).where(tx.is_translatable("block_type")).select("doc_id", "pos", "block_type")


@query
def skip_reasons(spark, sf):
    r = tx.skip_reason("block_type", "source_text")
    return _blocks(spark, sf).withColumn("reason", r).where("reason is not null").select("doc_id", "pos", "block_type", "reason")


@query
def doc_stats(spark, sf):
    return report.document_stats(_translated(spark, sf))


@query
def char_class_ratios(spark, sf):
    n = F.length("source_text")
    c = lambda p: _r(tx.count("source_text", p) / n)
    return _blocks(spark, sf).select("doc_id", "pos", c(r"\p{L}").alias("letters"), c(r"\p{Lu}").alias("upper"), c(r"\p{Nd}").alias("digits"), _r(tx.placeholder_chars("source_text") / n).alias("placeholders"), tx.has_letters("source_text").alias("has_letters"))


@query
def normalized_text_hash(spark, sf):
    return _blocks(spark, sf).select("doc_id", "pos", tx.content_hash("source_text").alias("content_hash"), tx.content_hash(tx.normalize("source_text")).alias("normal_hash"), tx.short_hash("source_text").alias("short_hash"))


@query
def clean_output(spark, sf):
    s = F.col("source_text")
    raw = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("<think>why\nso</think> Translation: "), s)).when(F.col("pos") % 4 == 1, F.concat(F.lit("```text\n"), s, F.lit("\n```"))).when(F.col("pos") % 4 == 2, F.concat(F.lit('Output: "'), s, F.lit('"'))).otherwise(F.lit("<thinking></thinking>"))
    return _blocks(spark, sf).withColumn("raw", raw).select("doc_id", "pos", tx.clean_output("raw").alias("cleaned"), tx.has_wrapper("raw").alias("wrapped"))


@query
def postprocess_text(spark, sf):
    raw = F.concat(F.lit("<think>x</think>  "), F.replace(F.col("source_text"), F.lit(" "), F.lit("  ")), F.lit(" .\r\n\n\n\n`end´ ;"))
    return _blocks(spark, sf).select("doc_id", "pos", tx.postprocess(raw, _rewrite).alias("text"))


@query
def reflow_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", tx.reflow("text").alias("text"))


@query
def text_previews(spark, sf):
    return _blocks(spark, sf).select("doc_id", "pos", tx.preview("source_text", 50).alias("p50"), tx.preview("source_text", 100).alias("p100"), tx.preview("source_text", 200).alias("p200"))


def _noted(spark, sf) -> DataFrame:
    """Blocks with links, references and formulas added."""
    tail = " see https://doi.org/10.1000/ab1 and [3,4], (Smith et al., 2020), mail a.b@example.org, $x'+1$ `code` Fig. 2 on page 12"
    return _blocks(spark, sf).withColumn("source_text", F.concat("source_text", F.lit(tail)))


#: Patterns whose RE2 and Java forms agree (no look-around, back-reference or word boundary).
PORTABLE = ["latex_apostrophe", "latex_display", "latex_text_ops", "latex_inline", "latex_inline_paren", "latex_escaped_brace", "code_block", "code_inline", "doi", "arxiv", "url_full", "email", "citation_bracket", "citation_author"]


@query
def mask_counts_by_type(spark, sf):
    counts = masking.counts_by_type("source_text")
    names = F.array(*(F.struct(F.lit(k).alias("mask_type"), counts[k].alias("n")) for k in PORTABLE))
    return _noted(spark, sf).select(F.explode(names).alias("x")).groupBy("x.mask_type").agg(F.sum("x.n").cast("long").alias("n"))


@query
def mask_counts_all_types(spark, sf):
    """All mask types, also those that RE2 cannot say (no SQL)."""
    counts = masking.counts_by_type("source_text")
    names = F.array(*(F.struct(F.lit(k).alias("mask_type"), n.alias("n")) for k, n in counts.items()))
    return _noted(spark, sf).select(F.explode(names).alias("x")).groupBy("x.mask_type").agg(F.sum("x.n").cast("long").alias("n"))


@query
def mask_roundtrip(spark, sf):
    """Masked and unmasked again: equal to the source, everything restored."""
    m = masking.mask(_noted(spark, sf))
    back = masking.unmask(F.col("masked_text"), F.col("masks"))
    return m.withColumn("back", back).select("doc_id", "pos", (F.col("back.text") == F.col("source_text")).alias("same"), F.size("back.missing").alias("missing"), (F.col("back.restored") == F.size("masks")).alias("all_restored"), (F.size(masking.missing(F.col("masked_text"), F.col("masks"))) == 0).alias("all_present"))


@query
def mask_spans(spark, sf):
    m = masking.spans(_noted(spark, sf))
    return m.select("doc_id", "pos", F.explode("spans").alias("s")).select("doc_id", "pos", "s.start", "s.end", F.col("s.name").alias("mask_type"))


@query
def mask_placeholders(spark, sf):
    m = masking.mask(_noted(spark, sf))
    return m.select("doc_id", "pos", "masked_text", F.to_json("masks").alias("masks"))


@query
def masking_report(spark, sf):
    return report.masking(masking.mask(_noted(spark, sf)))


@query
def residue_cleanup(spark, sf):
    t = F.concat(F.lit("<<URL_0001>> "), F.col("source_text"), F.lit(" ......  (voir page suivante) PLACEHOLDER"))
    return _blocks(spark, sf).select("doc_id", "pos", masking.clean_residue(t).alias("text"))


@query
def glossary_term_hits(spark, sf):
    return glossary.hits(_blocks(spark, sf), glossary.demo(spark)).select("doc_id", "pos", "term")


@query
def glossary_many_terms(spark, sf):
    """Blocks that hold each longer word of the benchmark: a glossary of as many terms as there are such words."""
    words = read_table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("source")).distinct()
    g = words.select(F.xxhash64("source").alias("term_id"), "source", F.upper("source").alias("target"), F.col("source").startswith("t").alias("case_sensitive"))
    return glossary.hits(_blocks(spark, sf), g).groupBy("term").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("doc_id").alias("documents"))


@query
def glossary_adherence(spark, sf):
    return glossary.adherence(_translated(spark, sf), glossary.demo(spark), ["lang"])


@query
def glossary_apply(spark, sf):
    return _blocks(spark, sf).select("doc_id", "pos", _rewrite(F.col("source_text")).alias("text"))


@query
def glossary_prompt_section(spark, sf):
    return glossary.prompt_section(glossary.hits(_blocks(spark, sf), glossary.demo(spark)), ["doc_id", "pos"], 3)


def _loaded(spark, sf) -> DataFrame:
    """Glossary loads: part names, twice with other targets and letters."""
    p = read_table(spark, sf, "part")
    one = p.select(F.lower("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_type").alias("domain"), F.col("p_partkey").alias("load_seq"))
    return one.unionByName(p.select(F.upper("p_name").alias("source"), F.col("p_type").alias("target"), F.col("p_type").alias("domain"), (F.col("p_partkey") * 3 + 1).alias("load_seq")).where("load_seq % 2 = 0"))


@query
def glossary_merge_override(spark, sf):
    return glossary.merge(_loaded(spark, sf)).select(F.lower("source").alias("source"), "load_seq")


@query
def glossary_swap(spark, sf):
    return glossary.swap(_loaded(spark, sf))


@query
def glossary_by_domain(spark, sf):
    return glossary.merge(_loaded(spark, sf)).groupBy("domain").agg(F.count(F.lit(1)).alias("total_terms"))


@query
def glossary_lookup(spark, sf):
    g = glossary.merge(_loaded(spark, sf)).select(F.lower("source").alias("k"), "load_seq")
    return read_table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("k")).join(g, "k", "left").select("p_partkey", "load_seq")


@query
def learned_glossary(spark, sf):
    return glossary.learned(_translated(spark, sf))


@query
def missing_translations(spark, sf):
    return coverage.defects(_translated(spark, sf)).select("doc_id", "pos", "reason")


@query
def identity_failures(spark, sf):
    b = _translated(spark, sf)
    return b.where(tx.identity_failure("source_text", "translated_text")).select("doc_id", "pos")


@query
def truncation_suspects(spark, sf):
    finish = F.when(F.col("pos") % 13 == 5, "length").otherwise("stop")
    return _translated(spark, sf).where(tx.truncated("source_text", "translated_text", finish)).select("doc_id", "pos")


@query
def coverage_by_doc(spark, sf):
    return coverage.by_document(_translated(spark, sf))


@query
def coverage_rollup_page(spark, sf):
    return coverage.by_page(_translated(spark, sf))


@query
def failure_report(spark, sf):
    return coverage.failure_report(_translated(spark, sf))


@query
def final_guard(spark, sf):
    second = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("[2] "), "source_text"))
    return coverage.final_guard(_translated(spark, sf), F.col("translated_text"), second).select("doc_id", "pos", "final_text", "attempt")


@query
def repair_failed(spark, sf):
    upper = lambda b: b.withColumn("translated_text", F.when(F.col("pos") % 2 == 0, F.upper("source_text")).otherwise(F.col("translated_text")))
    rules = lambda b: b.withColumn("translated_text", F.concat(F.lit("[fr] "), translate.rule_translate(F.col("source_text"))))
    return coverage.repair(_translated(spark, sf), [upper, rules]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def failed_semi_join(spark, sf):
    b = _translated(spark, sf)
    return b.join(coverage.defects(b).select("doc_id", "pos"), ["doc_id", "pos"], "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query
def validation_summary(spark, sf):
    return coverage.validate(_translated(spark, sf))


@query
def quality_gate(spark, sf):
    conf = F.when(F.col("pos") % 5 == 0, 0.3).otherwise(0.9)
    masks = F.array(F.struct(F.lit("e").alias("placeholder")))
    return _translated(spark, sf).select("doc_id", "pos", F.coalesce(coverage.quality_gate(F.col("source_text"), F.col("translated_text"), masks, conf, 0.5), F.lit(False)).alias("passed"))


@query
def numeric_consistency(spark, sf):
    b = _translated(spark, sf).withColumn("source_text", F.concat(F.lit("1,5 and 12 "), "source_text"))
    b = b.withColumn("translated_text", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("1.5 et 13 "), "translated_text")).otherwise(F.col("translated_text")))
    return metrics.numeric_consistency(b, ["lang"])


@query
def layout_fidelity(spark, sf):
    b = _translated(spark, sf).withColumn("x0", F.when(F.col("pos") % 7 != 3, F.col("x0")))
    return metrics.layout_fidelity(b, ["doc_id"])


@query
def context_window(spark, sf):
    return context.window(_blocks(spark, sf), 3).select("doc_id", "pos", F.md5(F.array_join("context", "\n")).alias("context_hash"), F.size("context").alias("n"))


@query
def block_context(spark, sf):
    x = context.translated_before(_translated(spark, sf), 5)
    return x.select("doc_id", "pos", F.size("context").alias("n"), F.md5(F.array_join(F.transform("context", lambda p: p["translated_text"]), "\n")).alias("context_hash"))


@query
def previous_translations(spark, sf):
    x = context.last_translations(_translated(spark, sf), 3)
    return x.select("doc_id", "pos", F.size("previous").alias("n"), F.md5(F.array_join("previous", "\n")).alias("previous_hash"))


@query
def block_links(spark, sf):
    return context.links(_blocks(spark, sf)).select("doc_id", "pos", "block_no", "previous_pos", "next_pos")


@query
def merge_across_pages(spark, sf):
    b = _blocks(spark, sf).withColumn("page", F.floor(F.col("pos") / 2).cast("int")).withColumn("source_text", F.when(F.col("pos") % 3 == 1, F.regexp_replace("source_text", r"[.]\s*$", "")).otherwise(F.col("source_text")))
    return context.continued(b).select("doc_id", "pos", "parts", F.md5("source_text").alias("text_hash"))


def _scored(spark, sf) -> DataFrame:
    return scoring.score(_candidates(spark, sf), TERMS)


@query
def score_dimensions(spark, sf):
    return _scored(spark, sf).select("doc_id", "pos", "candidate_id", *(_r(c).alias(c) for c in ("fluency", "adequacy", "terminology", "format")))


@query
def score_consistency(spark, sf):
    return _scored(spark, sf).select("doc_id", "pos", "candidate_id", _r("consistency").alias("consistency"))


@query
def rerank_best(spark, sf):
    return scoring.rerank(_scored(spark, sf), ["doc_id", "pos"]).where("rank = 1").select("doc_id", "pos", "candidate_id")


@query
def rerank_stats(spark, sf):
    return scoring.rerank_stats(_scored(spark, sf), ["doc_id", "pos"])


@query
def score_report_tiers(spark, sf):
    return scoring.tiers(_scored(spark, sf), ["lang"])


@query
def worst_blocks(spark, sf):
    x = _scored(spark, sf).where("candidate_id = 0").select("doc_id", "pos", _r("total").alias("total"))
    return x.orderBy("total", "doc_id", "pos").limit(20)


@query
def dedup_translate(spark, sf):
    out = translate.translate_distinct(_blocks(spark, sf), translate.rule_translate(F.col("source_text")))
    return out.select("doc_id", "pos", F.md5("translated_text").alias("translated_hash"))


def _keyed(spark, sf) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", "pos", "lang", "source_text", translate.key(F.col("source_text"), F.col("lang"), F.lit("fr")).alias("key"))


def _now() -> Column:
    return F.expr("timestamp '2024-06-10 00:00:00'")


def _cache(spark, sf) -> DataFrame:
    """Every third text, written some days ago."""
    k = _keyed(spark, sf).where("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").alias("d"), F.min("source_text").alias("value"))
    return k.select("key", "value", F.expr("timestamp '2024-06-10 00:00:00' - make_interval(0, 0, 0, cast(d % 11 as int))").alias("ts"), F.col("d").alias("insert_seq"))


@query
def cache_lookup(spark, sf):
    x = translate.lookup(_keyed(spark, sf), _cache(spark, sf), _now())
    return x.select("doc_id", "pos", F.col("cached").isNotNull().alias("hit"))


@query
def cache_miss(spark, sf):
    return translate.misses(_keyed(spark, sf), _cache(spark, sf), _now()).select("doc_id", "pos")


@query
def cache_stats(spark, sf):
    return translate.cache_stats(_keyed(spark, sf), _cache(spark, sf), _now())


@query
def cache_fifo_evict(spark, sf):
    c = _cache(spark, sf).withColumn("shard", F.substring("key", 1, 1)).withColumn("insert_seq", F.struct("insert_seq", "key"))
    return translate.evict(c, 10, ["shard"]).select("shard", "key")


@query
def cascade_failover(spark, sf):
    s = F.col("source_text")
    x = translate.cascade(_blocks(spark, sf), [F.when(F.col("pos") % 4 == 0, s), F.when(F.col("pos") % 4 == 1, F.lit(" ")).when(F.col("pos") % 4 == 2, F.upper(s)), F.when(F.col("pos") % 4 == 1, F.lower(s))])
    return x.groupBy("lang", "service").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark, sf) -> DataFrame:
    b = _translated(spark, sf)
    return b.select("lang", F.struct("doc_id", "pos").alias("pair_id"), F.col("translated_text").alias("hypothesis"), _rewrite(F.col("source_text")).alias("reference"))


@query
def bleu_corpus(spark, sf):
    return metrics.bleu(_pairs(spark, sf), ["lang"])


@query
def chrf_corpus(spark, sf):
    return metrics.chrf(_pairs(spark, sf), ["lang"])


@query
def metric_bundle(spark, sf):
    b = _translated(spark, sf)
    return metrics.numeric_consistency(b, ["lang"]).join(metrics.layout_fidelity(b, ["lang"]), "lang").join(glossary.adherence(b, glossary.demo(spark), ["lang"]).withColumnRenamed("rate", "adherence"), "lang").join(metrics.comet(b, ["lang"]), "lang").select("lang", "consistency", "fidelity", "adherence", "comet")


def _detections(spark, sf) -> DataFrame:
    b = _blocks(spark, sf)
    shift = (F.col("pos") % 5) * 40.0
    return b.select("doc_id", "page", F.col("pos").alias("det_idx"), F.when(F.col("pos") % 2 == 0, "text").otherwise("figure").alias("cls"), (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")


@query
def iou_match(spark, sf):
    return layout.match_detections(_blocks(spark, sf), _detections(spark, sf)).select("doc_id", "pos", "det_idx", "cls", "iou")


@query
def layout_iou_mean(spark, sf):
    return layout.mean_iou(_blocks(spark, sf), _detections(spark, sf))


@query
def column_detection(spark, sf):
    return layout.columns(_blocks(spark, sf))


@query
def reading_order(spark, sf):
    return layout.reading_order(_blocks(spark, sf)).select("doc_id", "pos", "reading_no")


@query
def placement_plan(spark, sf):
    return layout.placement(_blocks(spark, sf)).select("doc_id", "pos", "y", "fits")


@query
def font_fit(spark, sf):
    return layout.font_fit(_blocks(spark, sf).withColumn("font_size", F.lit(11.0)).withColumn("y1", F.col("y0") + 200)).select("doc_id", "pos", "fit")


@query
def class_mapping(spark, sf):
    return _detections(spark, sf).select(layout.class_type(F.concat("cls", F.lit(" block"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def render_text(spark, sf):
    return report.render_text(_translated(spark, sf))


@query
def render_markdown(spark, sf):
    return report.render_markdown(_translated(spark, sf))


@query
def extraction_report(spark, sf):
    return report.extraction(_blocks(spark, sf))


@query
def prompt_build(spark, sf):
    b = context.translated_before(_translated(spark, sf), 5)
    s = glossary.prompt_section(glossary.hits(_blocks(spark, sf), glossary.demo(spark)), ["doc_id", "pos"], 20)
    x = report.build_prompt(b.join(s, ["doc_id", "pos"], "left"), context=F.col("context"), section=F.col("section"), source=F.col("lang"))
    return x.select("doc_id", "pos", F.md5("prompt").alias("prompt_hash"))


def _records(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(F.col("event_type").alias("template"), F.col("event_id").alias("seq"), (F.col("user_id") % 100).cast("double").alias("bleu"), (F.col("event_id") % 90).cast("double").alias("chrf"), (F.col("event_id") % 4 != 0).alias("success"))


@query
def template_best(spark, sf):
    u = _records(spark, sf).groupBy("template").agg(F.avg("bleu").alias("bleu"), F.avg("bleu").alias("chrf"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.count(F.lit(1)).alias("usage"), F.min("seq").alias("template_no"))
    return report.best_template(u)


@query
def template_weak(spark, sf):
    return report.weak_templates(_records(spark, sf), 0.9)


@query
def template_progress(spark, sf):
    return report.template_progress(_records(spark, sf))


@query
def cost_by_model(spark, sf):
    calls = read_table(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("user_id") * 7 % 1000).alias("tokens"))
    rates = spark.createDataFrame([("click", 0.005), ("view", 0.003), ("signup", 0.00014), ("purchase", 0.01)], "model string, rate double")
    return report.cost(calls, rates)


@query
def rate_window(spark, sf):
    return events.rate(read_table(spark, sf, "events"), 3600, 30)


@query
def circuit_breaker_islands(spark, sf):
    o = read_table(spark, sf, "events").select(F.col("event_type").alias("service"), F.col("event_id").alias("seq"), "ts", (F.col("user_id") % 3 == 0).alias("ok"))
    return events.breaker(o)


@query
def chunk_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.size(translate.chunk(F.col("text"), 450)).alias("chunks"), F.md5(F.array_join(translate.chunk(F.col("text"), 450), "|")).alias("chunks_hash"))


@query
def template_progress_resumed(spark, sf):
    """The later half of the records on top of the state that the earlier half left."""
    r = _records(spark, sf)
    return report.template_progress(r.where("seq % 2 = 1"), state=report.template_progress(r.where("seq % 2 = 0")))


@query
def merge_and_split_back(spark, sf):
    """No SQL: cuts minimise a cost (tested against all cuts)."""
    b = _blocks(spark, sf).withColumn("page", F.floor(F.col("pos") / 2).cast("int")).withColumn("source_text", F.when(F.col("pos") % 3 == 1, F.regexp_replace("source_text", r"[.]\s*$", "")).otherwise(F.col("source_text")))
    x = context.split_back(context.part_lengths(b).withColumn("translated_text", translate.rule_translate(F.col("source_text"))))
    return x.select("doc_id", "pos", F.size("translated_parts").alias("parts"), F.md5(F.array_join("translated_parts", "|")).alias("parts_hash"))


@query
def score_write_back(spark, sf):
    """Nested documents of their lines; every third block gets a score and a missing placeholder."""
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    block = lambda t, i: F.struct(i.cast("string").alias("block_id"), t.alias("source_text"), F.array().cast("array<string>").alias("missing"), F.create_map(F.lit("total"), F.lit(0.5)).alias("scores"))
    nested = docs.select("document_id", F.array(F.struct(F.lit("main").alias("segment_id"), F.transform(F.split("text", "\n"), block).alias("blocks"))).alias("segments"))
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("k", "t")).where("k % 3 = 1")
    updates = lines.select("document_id", F.col("k").cast("string").alias("block_id"), F.create_map(F.lit("total"), F.round(F.length("t") / 1000, 3)).alias("scores"), F.array(F.concat(F.lit("<<M_"), F.col("k").cast("string"), F.lit(">>"))).alias("missing"))
    x = report.write_back(nested, updates, {"scores": "scores", "missing": "missing"})
    b = F.explode(F.col("segments")[0]["blocks"])
    return x.select("document_id", b.alias("b")).groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.sum(F.col("b.scores")["total"]), 3).alias("total"), F.sum(F.size("b.missing")).alias("missing"), F.md5(F.array_join(F.array_sort(F.flatten(F.collect_list("b.missing"))), ",")).alias("missing_hash"))


@query
def cache_upsert(spark, sf):
    """Two overlapping writes to a fresh table, and what a lookup finds afterwards."""
    import uuid

    from ..sources.scratch import shared_folder

    path = f"{shared_folder(spark)}/loomtext-cache-{uuid.uuid4().hex}"
    b = _blocks(spark, sf).where("pos < 3").select("doc_id", "pos", cache.key(F.col("source_text"), F.lit("en"), F.lit("fr"), F.lit("rules")).alias("key"), "source_text")
    age = lambda c: _now() - F.make_interval(days=(c % 9).cast("int"))
    one = b.where("doc_id % 2 = 0").select("key", F.concat(F.lit("one "), F.col("doc_id").cast("string")).alias("value"), age(F.col("doc_id")).alias("ts"))
    two = b.where("doc_id % 3 = 0").select("key", F.concat(F.lit("two "), F.col("doc_id").cast("string")).alias("value"), age(F.col("doc_id") + 4).alias("ts"))
    cache.upsert(one, path, _now())
    cache.upsert(two, path, _now())
    return cache.get(b, path, _now()).select("doc_id", "pos", "cached")


@query
def context_window_segments(spark, sf):
    """Pages stand for segments: no context goes beyond one."""
    return context.window(_blocks(spark, sf), 3, ("doc_id", "page")).select("doc_id", "pos", F.md5(F.array_join("context", "\n")).alias("context_hash"), F.size("context").alias("n"))


def _masked(spark, sf) -> DataFrame:
    """Masked blocks; every fourth one's translation lost its first placeholder, others are missing."""
    m = masking.mask(_noted(spark, sf), patterns=[p for p in masking.PATTERNS if p[0] == "citation_bracket"])
    t = F.when(F.col("pos") % 4 == 0, F.replace(F.col("masked_text"), F.col("masks")[0]["placeholder"], F.lit(""))).when(F.col("pos") % 4 == 1, " ").otherwise(F.col("masked_text"))
    return m.withColumn("translated_text", F.explode(F.array(t)))


@query
def validation_masks(spark, sf):
    b = _masked(spark, sf)
    lost = F.when(tx.blank("translated_text"), 0).otherwise(F.size(masking.missing(F.col("translated_text"), F.col("masks"))))
    return coverage.validate(b, restored=F.size("masks") - lost, expected=F.size("masks"))


@query
def validation_texts(spark, sf):
    b = _masked(spark, sf)
    lost = F.when(tx.blank("translated_text"), 0).otherwise(F.size(masking.missing(F.col("translated_text"), F.col("masks"))))
    return report.validation_text(b, coverage.validate(b, restored=F.size("masks") - lost, expected=F.size("masks")))


@query
def metric_bundle_full(spark, sf):
    """The bundle with BLEU and chrF."""
    p = _pairs(spark, sf)
    return _all["metric_bundle"](spark, sf).join(metrics.bleu(p, ["lang"]), "lang").join(metrics.chrf(p, ["lang"]), "lang")


@query
def conversation_context(spark, sf):
    c = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("text").alias("source_text"))
    return context.window(c, 2).select(F.col("doc_id").alias("conv_id"), F.col("pos").alias("turn"), F.size("context").alias("n"), F.md5(F.array_join("context", "\n")).alias("context_hash"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all)
