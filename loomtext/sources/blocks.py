"""Sources: documents as ordered blocks, nested document JSON, glossaries, configuration."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import BLOCK_TYPES, DOCUMENT


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: doc_id, lang, pos (line number from 0), source_text, block_type, page, box. No shuffle."""
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "source_text")).where(F.col("source_text").rlike(r"\S"))
    x0, y0 = 50.0 + 260 * (F.col("pos") % 2), 50.0 + 30 * (F.col("pos") % 20)
    return lines.select("doc_id", "lang", "pos", "source_text", tx.layout_type("source_text").alias("block_type"), F.floor(F.col("pos") / 20).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 240).alias("x1"), (y0 + 20).alias("y1"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents from JSON files, one document a file; missing keys are null."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def flatten(documents: DataFrame) -> DataFrame:
    """Blocks of nested documents in reading order. Types come as NAME or Prefix.NAME; unknown ones are PARAGRAPH."""
    seg = documents.select(F.col("document_id").alias("doc_id"), "source_lang", "target_lang", F.posexplode("segments").alias("seg", "s"))
    rows = seg.select("doc_id", "source_lang", "target_lang", "seg", F.col("s.segment_id").alias("segment_id"), F.posexplode("s.blocks").alias("k", "b"))
    kind = F.element_at(F.split(F.coalesce("b.block_type", F.lit("")), r"\."), -1)
    known = F.when(kind.isin(BLOCK_TYPES), kind).otherwise("PARAGRAPH")
    # seg and k order blocks within a document; pos follows them
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "k")) - 1
    return rows.withColumn("pos", pos).select("doc_id", "source_lang", "target_lang", "segment_id", "pos", *(F.col(f"b.{c}").alias(c) for c in ("block_id", "source_text", "translated_text", "masked_text", "bbox", "font", "masks", "metadata", "scores")), known.alias("block_type"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, domain, load_seq) from JSON files {domain, terms: {source: target}} or plain {source: target} maps."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    terms = F.coalesce(F.from_json(F.get_json_object("value", "$.terms"), "map<string,string>"), F.from_json("value", "map<string,string>"))
    domain = F.coalesce(F.get_json_object("value", "$.domain"), F.regexp_extract("file", r"^(.*?)(_[a-z]{2}[-_][a-z]{2})?\.json$", 1))
    return raw.select(domain.alias("domain"), F.posexplode(F.map_entries(terms)).alias("load_seq", "t")).select("t.key", "t.value", "domain", "load_seq").toDF("source", "target", "domain", "load_seq")


def load_config(defaults: dict, path: str | None = None, prefix: str = "LOOMTEXT_", environ: dict | None = None) -> dict:
    """Settings: environment over file over defaults. Files hold `key: value` lines or JSON."""
    found = dict(defaults)
    if path and os.path.exists(path):
        import json

        with open(path, encoding="utf-8") as f:
            content = f.read()
        try:
            found |= json.loads(content)
        except ValueError:
            found |= {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in content.splitlines() if ":" in line and not line.lstrip().startswith("#"))}
    for k, v in found.items():
        given = (environ if environ is not None else os.environ).get(prefix + k.upper())
        if given is not None:
            found[k] = type(v)(given) if isinstance(v, (int, float, str)) and not isinstance(v, bool) else given.lower() in ("1", "true", "yes") if isinstance(v, bool) else given
    return found
