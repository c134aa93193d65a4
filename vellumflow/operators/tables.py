"""Tables: grid positions, vertical merges, header choice, alignment, pipe rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellumflow.operators.package import attr


def grid_positions(cells: DataFrame, row_keys: list[str], order: list[str], span: str = "span") -> DataFrame:
    """Adds ``grid_col`` (from 1): one more than the spans of the row's earlier cells."""
    w = W.Window.partitionBy(*row_keys).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    return cells.withColumn("grid_col", (F.lit(1) + F.coalesce(F.sum(span).over(w), F.lit(0))).cast("int"))


def row_spans(cells: DataFrame, column_keys: list[str], order: list[str], restart: str = "restart") -> DataFrame:
    """Adds ``merge`` (the number of the vertical group) and ``rowspan`` (its cells): a restart opens a group."""
    w = W.Window.partitionBy(*column_keys).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    numbered = cells.withColumn("merge", F.sum(F.when(F.col(restart), 1).otherwise(0)).over(w))
    return numbered.withColumn("rowspan", F.count("*").over(W.Window.partitionBy(*column_keys, "merge")))


def header_rows(rows: DataFrame, table_keys: list[str], flagged: str = "is_header") -> DataFrame:
    """Adds ``header``: the first flagged row, else the first row."""
    w = W.Window.partitionBy(*table_keys).orderBy(F.desc(F.coalesce(F.col(flagged), F.lit(False))), "row")
    return rows.withColumn("header", F.row_number().over(w) == 1)


def unlooked(content: DataFrame, rows: DataFrame, table_keys: list[str], flagged: str = "is_header") -> DataFrame:
    """Keys of the tables whose look turns first-row formatting off (its own attribute, else bit 0x20 of the mask) and that flag no row."""
    mask = F.conv(attr("w:val"), 16, 10).cast("long").bitwiseAND(F.lit(0x20))
    on = F.coalesce(F.lower(attr("w:firstRow")).isin("1", "true", "on"), mask != 0)
    off = content.where((F.col("ns") == "w") & (F.col("name") == "tblLook") & ~on).select("doc_id", "part", F.col("near")["tbl"].alias("tbl")).distinct()
    return off.join(rows.where(flagged).select(*table_keys).distinct(), table_keys, "left_anti")


def delimiter(jc):
    """The delimiter cell of a column's justification."""
    return F.when(jc == "center", F.lit(":---:")).when(jc.isin("right", "end"), F.lit("---:")).when(jc.isin("left", "start"), F.lit(":---")).otherwise(F.lit("---"))


def pad_grid(cells: DataFrame, table_keys: list[str], width: str = "n_cols") -> DataFrame:
    """Every (row, grid column) of every table, with empty text where no cell begins.

    ``cells`` has table_keys, row, grid_col, text, and the table's column count.
    """
    rows = cells.groupBy(*table_keys, "row").agg(F.max(width).alias(width))
    grid = rows.select(*table_keys, "row", F.explode(F.sequence(F.lit(1), F.greatest(F.col(width), F.lit(1)))).alias("grid_col"))
    return grid.join(cells.select(*table_keys, "row", "grid_col", "text"), [*table_keys, "row", "grid_col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def pipe_rows(cells: DataFrame, table_keys: list[str]) -> DataFrame:
    """One line per row: ``| a | b |``."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("grid_col", "text"))), lambda x: x["text"])
    return cells.groupBy(*table_keys, "row").agg(F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |")).alias("line"))


def pipe_tables(cells: DataFrame, table_keys: list[str], headers: DataFrame | None = None, aligns: DataFrame | None = None) -> DataFrame:
    """One Markdown table per key: header line, delimiter line, the other rows in order.

    ``headers`` (keys, row) names the header row, row 1 by default; ``aligns``
    (keys, grid_col, jc) the columns' justification.
    """
    lines = pipe_rows(cells, table_keys)
    first = cells.groupBy(*table_keys).agg(F.min("row").alias("header_row"), F.max("grid_col").alias("width"))
    if headers is not None:
        first = first.drop("header_row").join(headers.select(*table_keys, F.col("row").alias("header_row")), table_keys)
    if aligns is None:
        rule = first.select(*table_keys, F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int"))).alias("rule"))
    else:
        rule = aligns.groupBy(*table_keys).agg(F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grid_col", delimiter(F.col("jc")).alias("d")))), lambda x: x["d"]), " | "), F.lit(" |")).alias("rule"))
    ordered = F.array_sort(F.collect_list(F.struct((F.col("row") != F.col("header_row")).alias("body"), "row", "line")))
    joined = lines.join(first.select(*table_keys, "header_row"), table_keys).groupBy(*table_keys).agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    return joined.join(rule, table_keys).select(*table_keys, F.array_join(F.concat(F.slice("lines", F.lit(1), F.lit(1)), F.array("rule"), F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))), "\n").alias("markdown"))


def html_tables(cells: DataFrame, table_keys: list[str]) -> DataFrame:
    """One HTML table per key with column and row spans; ``cells`` has row, grid_col, span, restart and html."""
    spanned = row_spans(cells, [*table_keys, "grid_col"], ["row"]).where("restart")
    attribute = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    tag = F.when(F.col("row") == 1, F.lit("th")).otherwise(F.lit("td"))
    one = F.concat(F.lit("<"), tag, attribute("colspan", "span"), attribute("rowspan", "rowspan"), F.lit(">"), "html", F.lit("</"), tag, F.lit(">"))
    rows = spanned.withColumn("one", one).groupBy(*table_keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grid_col", "one"))), lambda x: x["one"]), "").alias("inner"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "inner"))), lambda x: F.concat(F.lit("<tr>"), x["inner"], F.lit("</tr>"))), "\n")
    return rows.groupBy(*table_keys).agg(F.concat(F.lit("<table>\n"), joined, F.lit("\n</table>")).alias("markdown"))
