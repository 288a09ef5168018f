"""Reports, prompts and rendered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .coverage import ratio


def document_stats(blocks: DataFrame) -> DataFrame:
    can = tx.is_translatable("block_type")
    n, done = F.count_if(can), F.count_if(can & ~tx.blank("translated_text"))
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), n.alias("translatable"), done.alias("translated"), F.round(100 * ratio(done, n), 4).alias("progress"), F.count_distinct("block_type").alias("types"))


def ordered_text(parts: Column, separator: str = "\n\n") -> Column:
    """Texts of collected (pos, text) structs in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), separator)


def shown() -> Column:
    return F.when(tx.blank("translated_text"), F.col("source_text")).otherwise(F.col("translated_text"))


def render_text(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", F.struct("pos", shown().alias("text")).alias("p")).groupBy("doc_id").agg(ordered_text(F.collect_list("p")).alias("text"))


def render_markdown(blocks: DataFrame) -> DataFrame:
    t = F.when(F.col("block_type") == "TITLE", F.concat(F.lit("# "), shown())).when(F.col("block_type").isin("HEADING", "SUBHEADING"), F.concat(F.lit("## "), shown())).when(F.col("block_type") == "EQUATION", F.concat(F.lit("$$"), shown(), F.lit("$$"))).otherwise(shown())
    return blocks.select("doc_id", F.struct("pos", t.alias("text")).alias("p")).groupBy("doc_id").agg(ordered_text(F.collect_list("p")).alias("text"))


#: Prompt templates (invented wording), by name.
TEMPLATES = {
    "scientific_expert": "You translate scientific papers from {source} to {target}.\nTerms:\n{glossary}\nContext:\n{context}\nText:\n{text}",
    "contextual_expert": "Translate from {source} to {target}; keep to the context.\nContext:\n{context}\nTerms:\n{glossary}\nText:\n{text}",
    "iterative_refinement": "Improve this {target} translation of a {source} text.\nTerms:\n{glossary}\nText:\n{text}",
}


def build_prompt(blocks: DataFrame, template: str = "scientific_expert", context: Column | None = None, section: Column | None = None, source: Column | None = None, target: Column | None = None) -> DataFrame:
    """blocks with `prompt`: the named template (unknown ones: scientific_expert), the last three context pairs and the glossary section."""
    pairs = F.transform(F.slice(context, F.greatest(F.size(context) - 2, F.lit(1)), F.lit(3)), lambda p: F.concat(p["source_text"], F.lit(" -> "), p["translated_text"])) if context is not None else F.array().cast("array<string>")
    said = F.when(F.size(pairs) == 0, "No previous context").otherwise(F.array_join(pairs, "\n"))
    values = {"source": F.lit("en") if source is None else source, "target": F.lit("fr") if target is None else target, "glossary": F.coalesce(section if section is not None else F.lit(None).cast("string"), F.lit("No specific terms")), "context": said, "text": F.col("source_text")}
    t = F.lit(TEMPLATES.get(template, TEMPLATES["scientific_expert"]))
    for name in ("source", "target", "glossary", "context", "text"):
        t = F.replace(t, F.lit("{" + name + "}"), values[name])
    return blocks.withColumn("prompt", t)


def best_template(usage: DataFrame, least: int = 10, default: str = "scientific_expert") -> DataFrame:
    """The template with the best mix of BLEU, chrF and success among those used often enough, else the default."""
    s = 0.4 * F.col("bleu") / 100 + 0.4 * F.col("chrf") / 100 + 0.2 * F.col("success_rate")
    return usage.where(F.col("usage") >= least).agg(F.coalesce(F.max_by("template", F.struct(F.round(s, 9), -F.col("template_no"))), F.lit(default)).alias("template"))


#: Records of a template are smoothed in slices of so many sequence numbers.
SLICE = 10_000


def template_progress(records: DataFrame, rate: float = 0.1, state: DataFrame | None = None) -> DataFrame:
    """Smoothed BLEU and chrF, success rate and usage of each template after its records (template, seq, bleu, chrf, success).

    A record moves a mean m to (1 - rate) * m + rate * value, from 0 or from the loaded state (template, bleu, chrf, success_rate, usage).
    Such steps compose: a slice of records is one step, m * (1 - rate)^n + sum, however it is divided. So slices are summed side by side
    and a template of any history is never in one task; only slices are then put in order. Equal sequence numbers come in order of their values.
    """
    keep = 1 - rate
    sliced = records.withColumn("slice", F.floor(F.col("seq") / SLICE))
    own = Window.partitionBy("template", "slice")  # a slice
    ahead = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("seq", "bleu", "chrf", "success"))
    weight = rate * F.pow(F.lit(keep), ahead)
    parts = sliced.select("template", "slice", "success", *((weight * F.col(c)).alias(c) for c in ("bleu", "chrf")))
    steps = parts.groupBy("template", "slice").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"), F.sum("bleu").alias("bleu"), F.sum("chrf").alias("chrf"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy("template").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a slice
    steps = steps.withColumn("fade", F.pow(F.lit(keep), later))
    x = steps.groupBy("template").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), *(F.sum(F.col(c) * F.col("fade")).alias(c) for c in ("bleu", "chrf")))
    if state is not None:
        old = state.select("template", F.col("bleu").alias("b0"), F.col("chrf").alias("c0"), F.col("success_rate").alias("s0"), F.col("usage").alias("n0"))
        x = x.join(old, "template", "full")
    else:
        x = x.withColumns({"b0": F.lit(0.0), "c0": F.lit(0.0), "s0": F.lit(0.0), "n0": F.lit(0)})
    v = lambda c: F.coalesce(c, F.lit(0))
    usage = v("n") + v("n0")
    smooth = lambda c, c0: F.round(v(c0) * F.pow(F.lit(keep), v("n")) + v(c), 6)
    return x.select("template", smooth("bleu", "b0").alias("bleu"), smooth("chrf", "c0").alias("chrf"), F.round((v("ok") + v("s0") * v("n0")) / usage, 6).alias("success_rate"), usage.alias("usage"))


def weak_templates(records: DataFrame, threshold: float = 0.4, last: int = 100) -> DataFrame:
    """Templates whose mean BLEU over the last records is below the threshold (in hundredths); `strong` asks for a stronger prompt below 30."""
    top = records.orderBy(F.desc("seq")).limit(last)  # the report is over these
    return top.groupBy("template").agg(F.avg("bleu").alias("m")).where(F.col("m") < 100 * threshold).select("template", F.round("m", 6).alias("bleu"), (F.col("m") < 30).alias("strong"))


def cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens and cost by model; rates are per thousand tokens."""
    x = calls.join(F.broadcast(rates), "model", "left")  # rates: a row for each model
    return x.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") / 1000 * F.coalesce("rate", F.lit(0.0))), 6).alias("cost"))


def extraction(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "pos", "block_type", tx.is_translatable("block_type").alias("is_translatable"), tx.preview("source_text", 200).alias("text"), F.length("source_text").alias("length"))


def masking(masked: DataFrame) -> DataFrame:
    """For each document: masks, JSON of masks by type, blocks with masks, and JSON of these blocks in order (pos, num_masks, masked_text, masks). Zeros and empty JSON where there are none."""
    n = F.coalesce(F.size("masks"), F.lit(0))
    kinds = F.transform(F.coalesce("masks", F.array().cast(masked.schema["masks"].dataType)), lambda m: m["mask_type"])
    item = F.to_json(F.struct("pos", n.alias("num_masks"), "masked_text", "masks"))
    x = masked.select("doc_id", n.alias("n"), kinds.alias("kinds"), F.when(n > 0, F.struct("pos", item.alias("text"))).alias("p"))
    x = x.groupBy("doc_id").agg(F.sum("n").alias("total_masks"), F.flatten(F.collect_list("kinds")).alias("kinds"), F.count_if(F.col("n") > 0).alias("blocks_with_masks"), F.collect_list("p").alias("p"))
    counted = F.transform(F.array_sort(F.array_distinct("kinds")), lambda k: F.struct(k, F.size(F.filter("kinds", lambda m: m == k)).alias("n")))
    return x.select("doc_id", "total_masks", F.to_json(F.map_from_entries(counted)).alias("by_type"), "blocks_with_masks", F.concat(F.lit("["), ordered_text(F.col("p"), ","), F.lit("]")).alias("blocks"))


def document_json(blocks: DataFrame) -> DataFrame:
    """One JSON string for each document, blocks in order."""
    cols = [c for c in blocks.columns if c != "doc_id"]
    item = F.struct("pos", F.to_json(F.struct(*cols)).alias("text"))
    return blocks.select("doc_id", item.alias("p")).groupBy("doc_id").agg(F.concat(F.lit("["), ordered_text(F.collect_list("p"), ","), F.lit("]")).alias("json"))


def validation_text(blocks: DataFrame, validated: DataFrame, ids: int = 5) -> DataFrame:
    """A report in words for each document: verdict, coverage, and the first blocks that are missing, copies, or lack placeholders.

    blocks: translated ones, with masks where there are any. validated: coverage.validate() of them. All three lists come from one pass over the blocks.
    """
    name = F.col("pos").cast("string")
    can, blank = tx.is_translatable("block_type"), tx.blank("translated_text")
    found = lambda kind, items: F.transform(items, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("item")))
    if_so = lambda c: F.array_compact(F.array(F.when(c, name)))
    parts = [found("missing", if_so(can & blank)), found("copies", if_so(can & tx.identity_failure("source_text", "translated_text")))]
    if "masks" in blocks.columns:
        lost = F.when(~blank, F.transform(_gone(), lambda m: F.concat(name, F.lit(" "), m["placeholder"], F.lit(" ("), m["mask_type"], F.lit(")"))))
        parts.append(found("lost", F.coalesce(lost, F.array().cast("array<string>"))))
    each = Window.partitionBy("doc_id", "kind")
    rows = blocks.select("doc_id", "pos", F.explode(F.concat(*parts)).alias("i")).select("doc_id", "pos", "i.kind", "i.item")
    rows = rows.withColumns({"_k": F.row_number().over(each.orderBy("pos", "item")), "_n": F.count(F.lit(1)).over(each)}).where(F.col("_k") <= ids)
    titles = {"missing": "without a translation", "copies": "copied from the source", "lost": "lost placeholders"}
    of = lambda k, c: F.when(F.col("kind") == k, c)
    lists = rows.groupBy("doc_id").agg(*(c for k in titles for c in (F.array_sort(F.collect_list(of(k, F.struct("_k", "item")))).alias(k), F.max(of(k, F.col("_n"))).alias(f"{k}_n"))))
    x = validated.join(lists, "doc_id", "left")
    line = lambda k: F.when(F.col(f"{k}_n").isNotNull(), F.concat(F.col(f"{k}_n").cast("string"), F.lit(f" {titles[k]}: "), F.array_join(F.transform(k, lambda t: t["item"]), ", "), F.when(F.col(f"{k}_n") > ids, F.concat(F.lit(" and "), (F.col(f"{k}_n") - ids).cast("string"), F.lit(" more"))).otherwise("")))
    head = F.concat(F.when(F.col("is_valid"), "valid").otherwise("not valid"), F.lit(": "), F.col("translated").cast("string"), F.lit(" of "), F.col("translatable").cast("string"), F.lit(" blocks translated"))
    return x.select("doc_id", F.concat_ws("\n", head, *map(line, titles)).alias("report"))


def _gone() -> Column:
    """Masks whose placeholder the translation doesn't hold."""
    return F.filter("masks", lambda m: ~F.contains(F.col("translated_text"), m["placeholder"]))


def lost_masks(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, placeholder, mask_type) of placeholders that a translation doesn't hold; untranslated blocks lose none."""
    return blocks.where(~tx.blank("translated_text")).select("doc_id", "pos", F.explode(_gone()).alias("m")).select("doc_id", "pos", "m.placeholder", "m.mask_type")


def write_back(documents: DataFrame, updates: DataFrame, fields: dict[str, str], by: str = "document_id", block: str = "block_id") -> DataFrame:
    """Nested documents whose blocks take the values of keyed updates; fields: {field of a block: column of updates}.

    Blocks are updated where they stand: no document is taken apart and put together again. Documents and blocks without an update, and
    fields whose update is null, stay as they are; of several updates of one block the last one by their values counts; unknown ones go nowhere.
    A document's updates come as one map, as large as its own blocks at most.
    """
    value = F.struct(*(F.col(c).alias(f) for f, c in fields.items()))
    one = updates.where(F.col(block).isNotNull()).groupBy(by, block).agg(F.max_by(value, F.to_json(value)).alias("_v"))
    given = one.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(block, "_v"))).alias("_given"))

    def updated(b: Column) -> Column:
        new = F.element_at("_given", b[block])
        for f in fields:
            b = b.withField(f, F.coalesce(new[f], b[f]))
        return b

    changed = F.transform("segments", lambda s: s.withField("blocks", F.transform(s["blocks"], updated)))
    return documents.join(given, by, "left").withColumn("segments", F.when(F.col("_given").isNull(), F.col("segments")).otherwise(changed)).drop("_given")
