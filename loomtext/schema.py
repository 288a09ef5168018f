"""Row types of the document model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Block types in their order (ordinals from 1), and those that are not translated.
BLOCK_TYPES = ["PARAGRAPH", "HEADING", "SUBHEADING", "EQUATION", "CODE", "TABLE", "FIGURE", "CAPTION", "LIST_ITEM", "REFERENCE", "FOOTNOTE", "HEADER", "FOOTER", "ABSTRACT", "TITLE", "AUTHOR", "METADATA"]
UNTRANSLATED = ["EQUATION", "CODE", "HEADER", "FOOTER", "METADATA"]

BBOX = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")), T.StructField("page", T.IntegerType()), T.StructField("confidence", T.DoubleType())])
FONT = T.StructType(
    [
        T.StructField("family", T.StringType()),
        T.StructField("size", T.DoubleType()),
        *(T.StructField(c, T.StringType()) for c in ("weight", "style", "color", "alignment", "decoration")),
        *(T.StructField(c, T.DoubleType()) for c in ("line_height", "letter_spacing", "word_spacing")),
        *(T.StructField(c, T.BooleanType()) for c in ("is_small_caps", "is_all_caps")),
        T.StructField("list_style", T.StringType()),
        T.StructField("list_indent", T.DoubleType()),
        T.StructField("heading_level", T.IntegerType()),
    ]
)
MASK = T.StructType([T.StructField("original", T.StringType()), T.StructField("placeholder", T.StringType()), T.StructField("mask_type", T.StringType()), T.StructField("preserve_formatting", T.BooleanType())])
METADATA = T.StructType(
    [
        T.StructField("backend", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        *(T.StructField(c, T.DoubleType()) for c in ("duration", "confidence")),
        T.StructField("glossary_terms_used", T.ArrayType(T.StringType())),
        T.StructField("context_used", T.BooleanType()),
        T.StructField("candidates_generated", T.IntegerType()),
        T.StructField("reranking_applied", T.BooleanType()),
        *(T.StructField(c, T.StringType()) for c in ("prompt_template", "model_name", "status", "failure_reason", "finish_reason")),
        T.StructField("was_truncated", T.BooleanType()),
        *(T.StructField(c, T.IntegerType()) for c in ("retry_count", "restored_masks")),
        T.StructField("missing_placeholders", T.ArrayType(T.StringType())),
    ]
)
BLOCK = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("block_id", "source_text", "translated_text", "masked_text", "block_type")),
        T.StructField("bbox", BBOX),
        T.StructField("font", FONT),
        T.StructField("masks", T.ArrayType(MASK)),
        T.StructField("metadata", METADATA),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
SEGMENT = T.StructType([*(T.StructField(c, T.StringType()) for c in ("segment_id", "segment_type", "title")), T.StructField("blocks", T.ArrayType(BLOCK))])
DOCUMENT = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("document_id", "source_lang", "target_lang", "title", "source_path")),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("segments", T.ArrayType(SEGMENT)),
        T.StructField("glossary_terms", T.MapType(T.StringType(), T.StringType())),
    ]
)
GLOSSARY = T.StructType([*(T.StructField(c, T.StringType()) for c in ("source", "target", "domain")), T.StructField("case_sensitive", T.BooleanType()), T.StructField("load_seq", T.IntegerType())])
