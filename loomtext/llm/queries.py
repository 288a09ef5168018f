"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, decontaminate, filter_audit, jaccard, licenses, line_dedup, periodic_runs, quality, shards, suffix_dedup, token_counts, toxicity, url_filters
from .oracles import oracle_sql
from .common import load, scratch_root


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, and digests of its ids and of the text decoded from them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    path = _path("byte_bpe_50k.json")
    coded = codec.encode(docs, path).select("doc_id", "ids")
    out = codec.decode(coded, path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base measures, base_failed and the verdict."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    x, names = quality.judge(docs)
    return x.select("doc_id", *(F.col(c).alias(n) for n, c in names.items() if n != "n_lines"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: score, held out or not, and the label predicted."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed, and the digest of what stays."""
    x, names = suffix_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col(names["removed"])
    return x.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size(removed).cast("long").alias("n_spans"),
        F.sha2(names["kept"], 256).alias("kept_sha256"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, license lines, licenses found, and the closest template."""
    x = licenses.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    f = lambda c: F.col(f"found.{c}")
    return x.select("doc_id", f("n_lines").alias("n_lines"), f("n_license_lines").alias("n_license_lines"), F.array_join(f("licenses"), ",").alias("licenses"), f("best.template").alias("best_template"), F.round(f("best.dice"), 6).alias("best_dice"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its shingle set and the smallest id that links lead to."""
    return jaccard.join(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens, and whether these exceed 512."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts.count_tokens(docs, _path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines removed, and the SHA-256 of what stays."""
    x, names = line_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_removed"]).alias("n_removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards are written, texts and all, and slots are read off them; each row's place: shard, slot, and shard of 25."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shards.write_shards(docs, f"{scratch_root(spark)}/loomtext-{uuid.uuid4().hex}")
    return shards.slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, load(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.n_hit())
    return out.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        "n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, order of the five filters and step: what is kept, removed, redundant and lost."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), load(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.mask_counts(docs, labels), "ABCDE")


#: The contract's rules: action, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that decides, and the verdict."""
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    x, names = url_filters.judge(load(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return x.select("page_id", *(F.col(c).alias(n) for n, c in names.items()))


def _with_tail(docs: DataFrame) -> DataFrame:
    """The contract's texts: of one document in ten, by the checksum of its id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    d = docs.withColumn("words", F.when(h % 10 == 0, words))
    n = F.size("words")
    d = d.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: runs, the longest one, and digests of all runs and of the words that stay."""
    x, names = periodic_runs.find(_with_tail(load(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col(names["runs"])
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    x = x.withColumn("longest", longest)
    length = -F.col("longest.shorter")
    return x.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(names["collapsed"], 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_codec, op2_quality_rules, op3_toxicity, op4_suffix_dedup, op5_license_scan, op6_jaccard_join, op7_token_counts, op8_line_dedup, op9_shuffled_shards, op10_decontamination, op11_filter_audit, op12_url_filters, op13_periodic_runs)}


__all__ = ["oracle_sql", "queries"]
