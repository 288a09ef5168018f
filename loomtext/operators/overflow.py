"""Texts that don't fit their boxes: free space around them, boxes grown into it, what moves to further pages, and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes tried before a text counts as overflowing, and those tried after growing its box failed.
LADDER = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75)
REDUCED = (0.9, 0.85)
STRATEGIES = ("smart", "shrink", "expand", "append_pages", "marker+append_pages")
MARKER = "(continued on overflow page)"
ADDED = ("how", "new_y0", "new_y1", "size")


@dataclass(frozen=True)
class Page:
    """Points: the page, its margin, the least size, the size of a font that isn't given, the width of a column in the search for space."""

    width: float = 612.0
    height: float = 792.0
    margin: float = 10.0
    least_size: float = 6.0
    readable: float = 8.0
    size: float = 11.0
    line_height: float = 1.2
    letter: float = 0.5
    grain: float = 12.0


def needed(text: Column, width: Column, size: Column, page: Page = Page()) -> Column:
    """Estimated height of a text: its lines, or those that its letters fill, times size and line height. No text needs none."""
    lines = F.greatest(F.size(F.split(text, "\n")).cast("double"), F.ceil(F.length(text) * page.letter * size / F.greatest(width, F.lit(1.0))).cast("double"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(lines * size * page.line_height)


def space(boxes: DataFrame, page: Page = Page()) -> DataFrame:
    """doc_id, page, pos of each needy box, with the room above and below it (columns `above`, `below`).

    boxes: doc_id, page, pos, x0, y0, x1, y1, needy. Boxes that share a column of `grain` points are in each other's way. A gap between two
    needy boxes is halved, any other gap is its needy neighbour's; so grown boxes never meet. Each page is swept column by column with running
    minima and maxima, in work that grows with boxes times columns; pages without a needy box are left before that.
    """
    here = ["doc_id", "page"]
    x = boxes.withColumn("_any", F.max("needy").over(Window.partitionBy(*here))).where("_any").drop("_any")
    column = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(page.width - 1)) / page.grain
    first = F.floor(column(F.col("x0"))).cast("int")
    x = x.withColumn("strip", F.explode(F.sequence(first, F.greatest(first, (F.ceil(column(F.col("x1"))) - 1).cast("int")))))
    w = Window.partitionBy(*here, "strip").rowsBetween(Window.unboundedPreceding, -1)
    down, up = w.orderBy(F.desc("y0"), F.desc("pos")), w.orderBy("y0", "pos")
    calm = ~F.col("needy")
    below = F.least(F.lit(page.height - page.margin) - F.col("y1"), F.min(F.when(calm, F.col("y0"))).over(down) - F.col("y1"), (F.min(F.when(F.col("needy"), F.col("y0"))).over(down) - F.col("y1")) / 2)
    above = F.least(F.col("y0") - page.margin, F.col("y0") - F.max(F.when(calm, F.col("y1"))).over(up), (F.col("y0") - F.max(F.when(F.col("needy"), F.col("y1"))).over(up)) / 2)
    x = x.withColumns({"below": below, "above": above}).where("needy")
    return x.groupBy(*here, "pos").agg(*(F.greatest(F.min(c), F.lit(0.0)).alias(c) for c in ("above", "below")))


def resolve(blocks: DataFrame, strategy: str = "smart", text: str = "source_text", page: Page = Page()) -> DataFrame:
    """Each block (doc_id, page, pos, box, text) with how its text is placed, its grown box and its size.

    how: fits (at a size of the ladder); down, up, both (box grown); reduced; append (moves to further pages); cut (does not fit and stays);
    unplaced (a box without all coordinates, in nobody's way). Columns named as the added ones are replaced; a font_size column is
    used where it isn't null. doc_id and pos tell blocks apart; repeated rows stand in each other's way.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    size = F.coalesce(F.col("font_size").cast("double"), F.lit(page.size)) if "font_size" in blocks.columns else F.lit(page.size)
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    need = lambda s: needed(F.col(text), width, s, page)
    step = F.when(F.lit(False), F.lit(0.0))
    for s in LADDER:
        at = size * s if s > LADDER[-1] else F.greatest(F.lit(page.least_size), size * s)
        step = step.when(need(at) <= height, at)
    x = blocks.drop(*ADDED).withColumns({"_size": size, "_fit": step, "_whole": width.isNotNull() & height.isNotNull()})
    x = x.withColumn("_needy", F.col("_fit").isNull() & F.col("_whole"))
    room = space(x.where("_whole").select("doc_id", "page", "pos", "x0", "y0", "x1", "y1", F.col("_needy").alias("needy")), page)
    room = room.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("pos").alias("_k"), F.col("above").alias("_above"), F.col("below").alias("_below"))
    x = x.join(room, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")) & F.col("pos").eqNullSafe(F.col("_k")) & F.col("_needy"), "left")
    grow, above, below = need(F.col("_size")) - height, F.col("_above"), F.col("_below")
    y0, y1 = F.col("y0"), F.col("y1")
    put = lambda how, top, bottom, s: F.struct(F.lit(how).alias("how"), top.alias("new_y0"), bottom.alias("new_y1"), s.alias("size"))
    out = F.when(~F.col("_whole"), put("unplaced", y0, y1, F.col("_size"))).when(~F.col("_needy"), put("fits", y0, y1, F.col("_fit")))
    if strategy == "smart":
        out = out.when((below > 20) & (below >= grow), put("down", y0, y1 + F.least(grow * 1.2, below), F.col("_size")))
        out = out.when((above > 20) & (above >= grow), put("up", y0 - F.least(grow * 1.2, above), y1, F.col("_size")))
        rise, sink = (F.least(c * 0.8, grow * 0.5) for c in (above, below))
        out = out.when((above + below > 40) & (rise + sink >= grow), put("both", y0 - rise, y1 + sink, F.col("_size")))
        for s in [F.col("_size") * r for r in REDUCED] + [F.greatest(F.lit(page.readable), F.col("_size") * REDUCED[-1])]:
            out = out.when(need(s) * 0.95 <= height, put("reduced", y0, y1, s))
    elif strategy == "expand":
        s, bottom = F.col("_size") * 0.8, y1 + F.least(below, F.lit(100.0))
        out = out.when(need(s) <= bottom - y0, put("down", y0, bottom, s)).otherwise(put("cut", y0, bottom, s))
    elif strategy == "shrink":
        out = out.when(need(F.lit(page.least_size)) <= height, put("reduced", y0, y1, F.lit(page.least_size))).otherwise(put("cut", y0, y1, F.lit(page.least_size)))
    if strategy not in ("expand", "shrink"):
        out = out.otherwise(put("append", y0, y1, F.col("_size")))
    return x.withColumn("_put", out).select(*(c for c in blocks.columns if c not in ADDED), *(F.col(f"_put.{c}").alias(c) for c in ADDED), F.col("_needy").alias("overflowed"))


def shown(text: Column, how: Column, strategy: str) -> Column:
    """What stands in a block's own box: nothing, or the marker, where its text moves to further pages."""
    return F.when(how == "append", F.lit(MARKER if strategy.startswith("marker") else "")).otherwise(text)


def appended(resolved: DataFrame, text: str = "source_text", page: Page = Page()) -> DataFrame:
    """Texts that move, with the further page (from 1) and the height at which each starts; a text is as high as a page's width makes it.

    Each starts at the running height of those before it in its document; a page starts where a multiple of the usable height is passed.
    """
    usable = page.height - 2 * page.margin
    high = needed(F.col(text), F.lit(page.width - 2 * page.margin), F.col("size"), page)
    w = Window.partitionBy("doc_id").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, -1)
    x = resolved.where("how = 'append'").withColumn("start", F.coalesce(F.sum(high).over(w), F.lit(0.0)))
    return x.withColumns({"extra_page": F.floor(F.col("start") / usable).cast("long") + 1, "extra_y": page.margin + F.col("start") % usable})


def report(resolved: DataFrame, strategy: str = "smart", text: str = "source_text", texts: bool = True) -> DataFrame:
    """doc_id and its report as JSON {total_overflows, strategy, events}, for documents with an overflow; texts that move are in it (`texts`)."""
    moved = F.col("how") == "append"
    event = [F.col("pos").alias("block_id"), F.col("page"), F.length(text).alias("text_length"), F.when(moved & (F.lit(strategy) == "smart"), "append_pages").otherwise(strategy).alias("strategy")]
    if texts:
        event += [F.when(moved, F.col(text)).alias("full_text"), F.when(moved, F.col("size")).alias("fontsize")]
    events = F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", F.struct(*event).alias("event")))), lambda e: e["event"])
    x = resolved.where("overflowed").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), events.alias("events"))
    return x.select("doc_id", F.to_json(F.struct(F.col("n").alias("total_overflows"), F.lit(strategy).alias("strategy"), "events")).alias("report"))
