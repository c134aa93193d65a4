"""List numbering: counters with resets, markers, indents, separators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def counters(items: DataFrame, keys: list[str], order: list[str], level: str = "ilvl", start: str | None = "start", restart: str | None = None, override: str | None = None, levels: int = 9) -> DataFrame:
    """Adds ``number``: the item's count at its level.

    Items of a shallower level reset deeper counters; with ``restart`` (a column
    of the level's own limit) only levels below that limit do, and 0 means none.
    ``override`` (non-null on the first item of an instance that restarts)
    begins the count anew at its value.
    """
    w = W.Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(W.Window.unboundedPreceding, 0)
    marked = items
    if override:
        marked = marked.withColumn("_over", F.col(override).isNotNull())
    else:
        marked = marked.withColumn("_over", F.lit(False))
    # For each level: how many resets it has seen.  Deeper levels only look at shallower rows.
    limit = F.col(restart) if restart else F.lit(None).cast("int")
    segments = []
    for k in range(levels):
        level_limit = F.max(F.when(F.col(level) == k, limit)).over(W.Window.partitionBy(*keys))
        marked = marked.withColumn(f"_limit{k}", level_limit)
        resets = ((F.col(level) < k) & F.coalesce(F.col(level) < F.col(f"_limit{k}"), F.lit(True))) | ((F.col(level) == k) & F.col("_over"))
        segments.append(F.when(F.col(level) == k, F.sum(F.when(resets, 1).otherwise(0)).over(running)))
    marked = marked.withColumn("_segment", F.coalesce(*segments, F.lit(0)))
    inside = W.Window.partitionBy(*keys, level, "_segment").orderBy(*order)
    first = F.coalesce(F.first(F.col(override)).over(inside) if override else F.lit(None).cast("int"), F.col(start) if start else F.lit(1), F.lit(1))
    out = marked.withColumn("number", (first + F.row_number().over(inside) - 1).cast("int"))
    return out.drop("_segment", "_over", *[f"_limit{k}" for k in range(levels)])


def first_use(items: DataFrame, keys: list[str], order: list[str], override: str) -> DataFrame:
    """Keeps ``override`` on the first item of every numbering instance only."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn(override, F.when(F.row_number().over(w) == 1, F.col(override)))


def markers(items: DataFrame) -> DataFrame:
    """Adds ``marker`` and its ``width``: a bullet, the number, or blanks for unnumbered items."""
    mark = F.when(F.col("num_fmt") == "bullet", F.lit("- ")).when(F.col("num_fmt") == "none", F.lit("")).otherwise(F.concat(F.col("number").cast("string"), F.lit(". ")))
    return items.withColumn("marker", mark).withColumn("width", F.greatest(F.length(mark), F.lit(2)))


def indents(items: DataFrame, keys: list[str], order: list[str], levels: int = 9) -> DataFrame:
    """Adds ``indent``: the summed marker widths of the open shallower items."""
    w = W.Window.partitionBy(*keys).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    total = F.lit(0)
    for k in range(levels):
        # The last item at level k counts if no shallower item came after it.
        at = F.last(F.when(F.col("ilvl") <= k, F.struct(F.col("ilvl").alias("l"), F.col("width").alias("w"))), ignorenulls=True).over(w)
        total = total + F.when((F.col("ilvl") > k) & (at["l"] == k), at["w"]).otherwise(0)
    return items.withColumn("indent", total)


def separators(blocks: DataFrame, keys: list[str], order: list[str], list_id: str = "list_id") -> DataFrame:
    """Adds ``separate``: the block starts a list right after another one, so a comment must part them."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(list_id).over(w)
    return blocks.withColumn("separate", F.col(list_id).isNotNull() & before.isNotNull() & (before != F.col(list_id)))
