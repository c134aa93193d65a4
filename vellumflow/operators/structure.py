"""Order, nesting and naming: subtrees, fields, slugs, notes, media names, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellumflow.functions import strings


def drop_depth(events: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, name: str = "depth") -> DataFrame:
    """Adds the number of open subtrees at every row; the closing row counts as inside."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(W.Window.unboundedPreceding, 0)
    before = w.rowsBetween(W.Window.unboundedPreceding, -1)
    opened = F.sum(F.when(opens, 1).otherwise(0)).over(running)
    closed = F.coalesce(F.sum(F.when(closes, 1).otherwise(0)).over(before), F.lit(0))
    return events.withColumn(name, (opened - closed).cast("long"))


def frames(marks: DataFrame, keys: list[str], order: str, kind: str = "kind") -> DataFrame:
    """Intervals of nested begin/separate/end marks: ``depth, b, sep, e``; an unclosed one ends with the stream (null ``e``)."""
    w = W.Window.partitionBy(*keys).orderBy(order)
    step = F.when(F.col(kind) == "begin", 1).when(F.col(kind) == "end", -1).otherwise(0)
    level = F.sum(step).over(w.rowsBetween(W.Window.unboundedPreceding, 0)) + F.when(F.col(kind) == "end", 1).otherwise(0)
    leveled = marks.withColumn("depth", level).where(F.col("depth") > 0)
    inside = W.Window.partitionBy(*keys, "depth").orderBy(order)
    numbered = leveled.withColumn("frame", F.sum(F.when(F.col(kind) == "begin", 1).otherwise(0)).over(inside.rowsBetween(W.Window.unboundedPreceding, 0)))
    pick = lambda k: F.min(F.when(F.col(kind) == k, F.col(order)))
    return numbered.groupBy(*keys, "depth", "frame").agg(pick("begin").alias("b"), pick("separate").alias("sep"), pick("end").alias("e")).where(F.col("b").isNotNull()).drop("frame")


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str, end: str, value: str) -> DataFrame:
    """Points inside some interval of their keys (ends count as inside), with the innermost one's ``value``.

    Intervals nest or lie apart, and their columns are the keys, ``begin``, ``end`` and ``value``.  By running sums: the
    number of open intervals at a point is the level of the innermost, which is the last that opened at that level.
    """
    edge = lambda c, order, v: intervals.select(*keys, F.col(c).cast("long").alias("_at"), F.lit(order).alias("_edge"), v.alias("_open"))
    value_of = F.struct(F.col(value).alias("v"))
    rows = points.join(intervals.select(*keys).distinct(), keys, "left_semi").withColumns({"_at": F.col(at).cast("long"), "_edge": F.lit(1)})
    both = rows.unionByName(edge(begin, 0, value_of).unionByName(edge(end, 2, F.lit(None).cast(intervals.select(value_of.alias("x")).schema["x"].dataType))), allowMissingColumns=True)
    deep = drop_depth(both, keys, ["_at", "_edge"], F.col("_edge") == 0, F.col("_edge") == 2, "_level")
    level = W.Window.partitionBy(*keys, "_level").orderBy("_at", "_edge").rowsBetween(W.Window.unboundedPreceding, 0)
    found = deep.withColumn("_open", F.last("_open", ignorenulls=True).over(level)).where((F.col("_edge") == 1) & (F.col("_level") > 0))
    return found.select(*points.columns, F.col("_open.v").alias(value))


def slugs(headings: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Adds ``slug``: repeated ones get ``-1``, ``-2`` ... in document order."""
    based = headings.withColumn("_base", strings.slug(F.col(text)))
    n = F.row_number().over(W.Window.partitionBy(*keys, "_base").orderBy(*order)) - 1
    return based.withColumn("slug", F.when(n == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n.cast("string")))).drop("_base")


def wanted_marks(marks: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Bookmarks (keys, bookmark) that some link of their document (keys, dest) leads to."""
    wanted = links.where(F.startswith("dest", F.lit("#"))).select(*keys, F.expr("substring(dest, 2)").alias("bookmark")).distinct()
    return marks.join(wanted, [*keys, "bookmark"], "left_semi")


def renumber(references: DataFrame, keys: list[str], item: list[str], order: list[str], rank: str | None = None) -> DataFrame:
    """Items numbered from 1 by first reference (by ``rank`` first): keys, item, ``number``."""
    least = F.min(F.struct(*([rank] if rank else []), *order))
    firsts = references.groupBy(*keys, *item).agg(least.alias("_first"))
    w = W.Window.partitionBy(*keys).orderBy("_first", *item) if keys else W.Window.orderBy("_first", *item)
    return firsts.withColumn("number", F.row_number().over(w).cast("int")).drop("_first")


def media_names(images: DataFrame, keys: list[str], target: str, order: list[str], extension: str = "ext") -> DataFrame:
    """One generated name per distinct target: ``image1.png`` ... in order of first use; input names never reach a path."""
    firsts = images.groupBy(*keys, target).agg(F.min(F.struct(*order)).alias("_first"), F.min(extension).alias(extension))
    n = F.row_number().over(W.Window.partitionBy(*keys).orderBy("_first", target))
    return firsts.withColumn("out_name", F.concat(F.lit("image"), n.cast("string"), F.lit("."), F.col(extension))).drop("_first")


def join_deleted_marks(paragraphs: DataFrame, keys: list[str], order: str = "seq", deleted: str = "mark_deleted") -> DataFrame:
    """Adds ``joined``: paragraphs whose mark was deleted share their successor's number."""
    w = W.Window.partitionBy(*keys).orderBy(order)
    starts = F.when(F.coalesce(F.lag(deleted).over(w), F.lit(False)), 0).otherwise(1)
    return paragraphs.withColumn("joined", F.sum(starts).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))


def assemble(blocks: DataFrame, keys: list[str], order: list[str], text: str = "md", separator: str = "\n\n", name: str = "markdown") -> DataFrame:
    """One text per key: the blocks in order, one blank line apart."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return blocks.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), separator).alias(name))


def run_status(statuses: DataFrame, status: str = "status") -> DataFrame:
    """The run's verdict over documents: 0 all converted, 6 some, else the smallest failure."""
    good, bad = F.count_if(F.col(status) == 0), F.count_if(F.col(status) != 0)
    return statuses.agg(good.alias("converted"), bad.alias("failed"), F.when(bad == 0, 0).when(good > 0, 6).otherwise(F.min(status)).alias("verdict"))
