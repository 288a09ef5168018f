"""Progress of runs: done so far, share, rate and time left after each step, and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import PART, in_ranges

ADDED = ("completed", "failed", "skipped", "percentage", "elapsed", "rate", "eta")


def follow(steps: DataFrame, parts: int | None = None) -> DataFrame:
    """Each step (run, seq, ts, status, and any others) with the state of its run after it.

    status: completed, failed or skipped. A run's total is its column `total`, or the number of its steps; columns named as the added ones are replaced.
    eta is null while nothing is completed, or no time has passed. Order is ts, seq, status; steps without a time come first, at the run's start.

    Sums run in two passes, so that a run of any length is spread over tasks: the log is cut by range, each part adds up its own
    steps, and a part that continues a run gets what the parts before it have (at most one row a part, broadcast).
    """
    x = steps.drop(*ADDED)
    keys = [F.col(c).asc_nulls_first() for c in ("run", "ts", "seq", "status")]
    table = in_ranges(x, keys, parts)
    kinds = ADDED[:3]
    is_kind = lambda k: F.coalesce((F.col("status") == k).cast("long"), F.lit(0))
    sums = table.groupBy("run", PART).agg(*(F.sum(is_kind(k)).alias(k) for k in kinds), F.count(F.lit(1)).alias("steps"), F.min("ts").alias("begin"))
    before = Window.partitionBy("run").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col("run").alias("_run"), F.col(PART).alias("_at"), *(F.sum(k).over(before).alias(f"_{k}") for k in kinds), F.min("begin").over(before).alias("_begin"), F.count(F.lit(1)).over(before).alias("_seen")).where("_seen > 0").drop("_seen")
    totals = sums.groupBy(F.col("run").alias("_run")).agg(F.sum("steps").alias("_steps"))
    y = table.join(F.broadcast(carried), F.col("run").eqNullSafe(F.col("_run")) & (F.col(PART) == F.col("_at")), "left").drop("_run", "_at")
    if "total" not in x.columns:
        y = y.join(totals, F.col("run").eqNullSafe(F.col("_run"))).drop("_run")
    w = Window.partitionBy(PART, "run").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, 0)
    count = {k: F.sum(is_kind(k)).over(w) + F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in kinds}
    y = y.withColumns(count | {"_begin": F.least("_begin", F.min("ts").over(Window.partitionBy(PART, "run")))})
    total = F.col("total" if "total" in x.columns else "_steps")
    elapsed = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("_begin"), F.col("ts")) / F.lit(1e6), F.lit(0.0))
    rate = F.coalesce(F.try_divide(F.col("completed").cast("double"), F.col("elapsed")), F.lit(0.0))
    y = y.withColumns({"elapsed": elapsed, "percentage": F.coalesce(F.try_divide(F.col("completed") * 100.0, total.cast("double")), F.lit(0.0))})
    y = y.withColumn("rate", rate).withColumn("eta", F.try_divide((total - F.col("completed")).cast("double"), F.col("rate")))
    return y.select(*x.columns, *ADDED)


def message(text: Column, share: Column, block: Column | None = None, blocks: Column | None = None, page: Column | None = None, pages: Column | None = None) -> Column:
    """`[42%] text (Block 3/7) (Page 1/2)`; block and page count from 0, parts whose numbers are missing are left out."""
    out = [F.format_string("[%.0f%%] %s", F.bround(share.cast("double") * 100, 0), text)]
    for name, at, of in (("Block", block, blocks), ("Page", page, pages)):
        if at is not None and of is not None:
            out.append(F.when(at.isNotNull() & of.isNotNull(), F.format_string(f" ({name} %d/%d)", at.cast("long") + 1, of.cast("long"))))
    return F.concat_ws("", *out)
