"""Glossary operators. Glossaries are small dimensions: their size is checked before they are broadcast."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import automaton

#: A demonstration glossary of frequent tokens (matching is by substring).
DEMO = [("the", "le"), ("and", "et"), ("of", "de"), ("for", "pour"), ("that", "que"), ("tion", "cion")]
#: Glossaries of more bytes (texts, and ROW_BYTES a term) aren't held in one automaton.
AUTOMATON_BYTES, ROW_BYTES = 32 << 20, 32
#: Dictionaries that come with the library: JSON files {domain, direction, terms}.
SHIPPED = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "glossaries")


def demo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, t, "demo", False) for k, (s, t) in enumerate(DEMO)], "term_id int, source string, target string, domain string, case_sensitive boolean")


def shipped_domains() -> list[str]:
    return sorted(f.removesuffix("_en_fr.json") for f in os.listdir(SHIPPED) if f.endswith("_en_fr.json"))


def load_domains(spark: SparkSession, names: list[str] | None = None, direction: str = "en-fr") -> DataFrame:
    """The shipped dictionaries of these domains (all; unknown ones have no terms) as one glossary, the last one's terms over earlier
    ones'. direction fr-en: targets and sources change places."""
    rows = []
    for name in shipped_domains() if names is None else names:
        path = os.path.join(SHIPPED, f"{name}_en_fr.json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                content = json.load(f)
            rows += [(s, t, content["domain"]) if direction == "en-fr" else (t, s, content["domain"]) for s, t in content["terms"].items()]
    return numbered(spark.createDataFrame([(s, t, d, k) for k, (s, t, d) in enumerate(rows)], "source string, target string, domain string, load_seq long"))


def numbered(loaded: DataFrame) -> DataFrame:
    """A glossary (term_id, source, target, domain, case_sensitive) of loaded terms, last write wins; ids follow the order of loading."""
    return merge(loaded).select(F.col("load_seq").alias("term_id"), "source", "target", "domain", F.lit(False).alias("case_sensitive"))


def merge(glossaries: DataFrame) -> DataFrame:
    """The last loaded term of each lower-cased source wins."""
    w = Window.partitionBy(F.lower("source")).orderBy(F.desc("load_seq"))
    return glossaries.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def swap(glossary: DataFrame) -> DataFrame:
    return glossary.select(F.col("target").alias("source"), F.col("source").alias("target"))


def matches(text: Column, term: Column, case_sensitive: Column) -> Column:
    return F.when(case_sensitive, F.contains(text, term)).otherwise(F.contains(F.lower(text), F.lower(term)))


def glossary_bytes(glossary: DataFrame) -> int:
    """Bytes of a glossary's texts and numbers."""
    size = F.octet_length(F.coalesce("source", F.lit(""))) + F.octet_length(F.coalesce("target", F.lit(""))) + ROW_BYTES
    return glossary.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def hits(blocks: DataFrame, glossary: DataFrame) -> DataFrame:
    """Blocks with each term that stands in their source text (no word boundaries), a row for each pair.

    Substring matching has no equality key. Glossaries of up to AUTOMATON_BYTES are scanned for by one automaton, which each
    worker builds once: time grows with the texts and what is found in them, not with the terms. Beyond that each block meets
    only the terms whose first three characters it holds. Null texts and terms match nothing, an empty term every text.
    """
    if glossary_bytes(glossary) > AUTOMATON_BYTES:
        return _hits_by_heads(blocks, glossary)
    rows = glossary.select("term_id", "source", "target", F.coalesce("case_sensitive", F.lit(False)).alias("exact"), F.lower("source").alias("low"), "case_sensitive").collect()
    spark = blocks.sparkSession
    kind = glossary.select("term_id", F.col("source").alias("term"), F.col("target").alias("term_target"), "case_sensitive").schema
    terms = spark.createDataFrame([(k, r.term_id, r.source, r.target, r.case_sensitive) for k, r in enumerate(rows)], T.StructType([T.StructField("_term", T.IntegerType()), *kind.fields]))
    found = automaton.scan(blocks, [(F.lower("source_text"), [None if r.exact else r.low for r in rows]), (F.col("source_text"), [r.source if r.exact else None for r in rows])], "_found")
    return found.withColumn("_term", F.explode("_found")).join(F.broadcast(terms), "_term").drop("_term", "_found")


def _hits_by_heads(blocks: DataFrame, glossary: DataFrame) -> DataFrame:
    """hits() by an equality join on the terms' first three characters."""
    terms = glossary.select("term_id", F.col("source").alias("term"), F.col("target").alias("term_target"), "case_sensitive")
    on = matches(F.col("source_text"), F.col("term"), F.col("case_sensitive"))
    exact = F.coalesce("case_sensitive", F.lit(False))
    compared = F.when(exact, F.col("term")).otherwise(F.lower("term"))
    keyed = terms.withColumn("head", F.concat(F.when(exact, "=").otherwise("~"), F.substring(compared, 1, 3)))

    def starts(text: Column, mark: str) -> Column:
        """All substrings of at most three characters, the empty one too, behind the mark."""
        of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1)), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(k))))
        return F.concat(F.array(F.lit(mark)), of(1), of(2), of(3))

    # a term has one head and a block each head once, so every pair comes out once
    heads = F.array_distinct(F.concat(starts(F.lower("source_text"), "~"), starts(F.col("source_text"), "=")))
    return blocks.withColumn("head", F.explode(heads)).join(keyed, "head").where(on).drop("head")


def adherence(pairs: DataFrame, glossary: DataFrame, by: list[str]) -> DataFrame:
    """Terms found in sources, those whose target stands in the translation, and the rate (1 where none is found)."""
    x = hits(pairs, glossary).where("term <> '' and term_target <> ''")
    kept = F.contains(F.lower(F.coalesce("translated_text", F.lit(""))), F.lower("term_target"))
    counts = x.groupBy(*by).agg(F.count(F.lit(1)).alias("found"), F.count_if(kept).alias("enforced"))
    return pairs.select(*by).distinct().join(counts, by, "left").select(*by, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("enforced", F.lit(0)).alias("enforced"), F.round(F.coalesce(F.col("enforced") / F.col("found"), F.lit(1.0)), 6).alias("rate"))


def rewrite(terms: list[tuple[str, str]]):
    """A Column function that replaces terms, longest first, equal lengths in the given order."""
    ordered = sorted(((s, t) for s, t in terms if s and t), key=lambda p: -len(p[0]))

    def run(c: Column) -> Column:
        for s, t in ordered:
            c = F.replace(c, F.lit(s), F.lit(t))
        return c

    return run


def prompt_section(found: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """Bullets of the first terms found in each block, in the glossary's order."""
    w = Window.partitionBy(*by).orderBy("term_id")
    top = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "term", "term_target"))), lambda t: F.format_string("- %s -> %s", t["term"], t["term_target"]))
    return top.groupBy(*by).agg(F.concat(F.lit("Glossary:\n"), F.array_join(lines, "\n")).alias("section"))


def learned(pairs: DataFrame) -> DataFrame:
    """Long source words with the first word of the translation they first came with, for each language; first write wins."""
    #: Words not learned.
    stop = ["the", "and", "for", "with", "that"]
    first = F.regexp_extract(F.lower("translated_text"), tx.WORDS, 0)
    # a generator of its own: below the one of words, so that it is made once for each block, not for each word
    x = pairs.where(~tx.blank("translated_text")).select("lang", "doc_id", "pos", "source_text", F.explode(F.array(first)).alias("target"))
    x = x.select("lang", "doc_id", "pos", "target", F.posexplode_outer(tx.words(F.lower("source_text"))).alias("k", "word"))
    x = x.where((F.length("word") > 3) & ~F.col("word").isin(stop))
    return x.groupBy("lang", "word").agg(F.min_by("target", F.struct("doc_id", "pos", "k")).alias("target"))


def export(glossary: DataFrame, domain: str | None = None) -> DataFrame:
    """One JSON object for each domain, with its terms in order of their sources."""
    g = glossary if domain is None else glossary.where(F.col("domain") == domain)
    terms = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "target"))))
    return g.groupBy("domain").agg(F.count(F.lit(1)).alias("total_terms"), F.to_json(terms).alias("terms"))
