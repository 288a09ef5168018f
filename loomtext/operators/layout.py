"""Page layout: boxes, detections, columns, reading order, placement plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

BOX = ("x0", "y0", "x1", "y1")


def match_detections(blocks: DataFrame, detections: DataFrame, least: float = 0.3) -> DataFrame:
    """Each block with the detection of most overlap on its page (IoU over `least`; equal ones: the first). Blocks without one stay."""
    d = detections.select("doc_id", "page", F.col("det_idx"), F.col("cls"), *(F.col(c).alias(f"d_{c}") for c in BOX))
    x = blocks.join(d, ["doc_id", "page"], "left")
    over = tx.iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"d_{c}") for c in BOX))
    x = x.withColumn("iou", over)
    best = F.max_by(F.struct("det_idx", "cls", "iou"), F.struct(F.round("iou", 9), -F.col("det_idx")))
    hit = x.where(F.col("iou") > least).groupBy("doc_id", "pos").agg(best.alias("d")).select("doc_id", "pos", F.col("d.det_idx").alias("det_idx"), F.col("d.cls").alias("cls"), F.round("d.iou", 6).alias("iou"))
    return blocks.join(hit, ["doc_id", "pos"], "left")


def mean_iou(source: DataFrame, rendered: DataFrame, least: float = 0.3) -> DataFrame:
    """For each document: mean of the best IoU of its first page's boxes, and the share over `least`."""
    r = rendered.where("page = 0").select("doc_id", *(F.col(c).alias(f"r_{c}") for c in BOX))
    over = tx.iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"r_{c}") for c in BOX))
    x = source.where("page = 0").join(r, "doc_id", "left").groupBy("doc_id", "pos").agg(F.coalesce(F.max(over), F.lit(0.0)).alias("best"))
    return x.groupBy("doc_id").agg(F.round(F.avg("best"), 6).alias("mean_iou"), F.round(F.avg((F.col("best") > least).cast("double")), 6).alias("share"))


def columns(blocks: DataFrame, gap: float = 50.0) -> DataFrame:
    """Columns of each page: distinct left edges in order, a new column where the step to the next is `gap` or more."""
    x = blocks.select("doc_id", "page", "x0").distinct()
    w = Window.partitionBy("doc_id", "page").orderBy("x0")
    step = (F.col("x0") - F.lag("x0").over(w) >= gap).cast("int")
    return x.withColumn("new", F.coalesce(step, F.lit(0))).groupBy("doc_id", "page").agg((F.sum("new") + 1).alias("columns"))


def reading_order(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "pos")
    return blocks.withColumn("reading_no", F.row_number().over(w))


def placement(blocks: DataFrame, top: float = 50.0, line: float = 15.0, pad: float = 10.0, bottom: float = 750.0) -> DataFrame:
    """Simple pages: where each text starts (running sum of heights), and whether it still fits on the page."""
    lines = F.ceil(F.greatest(F.length("source_text"), F.lit(1)) / 80.0)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    y = top + F.coalesce(F.sum(line * lines + pad).over(w), F.lit(0.0))
    return blocks.withColumns({"y": y, "fits": y <= bottom})


def font_fit(blocks: DataFrame, least: float = 0.75, line_height: float = 1.2, width: float = 0.5) -> DataFrame:
    """The largest step of a shrinking ladder at which a text's estimated area fits into its box; null: none does."""
    #: The ladder.
    steps = [1.0, 0.95, 0.9, 0.85, 0.8, least]
    size = F.coalesce(F.col("font_size"), F.lit(11.0))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    need = lambda s: F.ceil(F.length("source_text") * width * size * s / w) * size * s * line_height
    out: Column = F.when(F.lit(False), 0.0)
    for s in steps:
        out = out.when(need(s) <= h, F.lit(s))
    return blocks.withColumn("fit", out)


def pages(blocks: DataFrame, start: int = 0, end: int | None = None, most: int | None = None) -> DataFrame:
    """Blocks of a range of pages [start, end), at most `most` of them."""
    last = min(x for x in (end, None if most is None else start + most, 2**31 - 1) if x is not None)
    return blocks.where((F.col("page") >= max(0, start)) & (F.col("page") < last))


#: Detector classes and block types; a name that holds another's takes its type.
CLASSES = {"title": "TITLE", "plain text": "PARAGRAPH", "text": "PARAGRAPH", "figure": "FIGURE", "figure caption": "CAPTION", "table": "TABLE", "table caption": "CAPTION", "isolate formula": "EQUATION", "formula": "EQUATION", "header": "HEADER", "footer": "FOOTER", "list": "LIST_ITEM", "abandon": "METADATA"}


def class_type(cls: Column) -> Column:
    """Exact name first, then the first that holds it or is held by it, else PARAGRAPH."""
    low = F.lower(cls)
    out = F.when(F.lit(False), "")
    for name, kind in CLASSES.items():
        out = out.when(low == name, kind)
    for name, kind in CLASSES.items():
        out = out.when(F.contains(low, F.lit(name)) | F.contains(F.lit(name), low), kind)
    return out.otherwise("PARAGRAPH")
