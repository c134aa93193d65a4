"""Runs: islands of equal formatting, toggles, whitespace hoisting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellumflow.functions import strings

#: Bits of a span's format, in delimiter order from outside in.
FMT = {"bold": 1, "italic": 2, "strike": 4, "code": 8, "sup": 16, "sub": 32, "underline": 64, "highlight": 128}


def islands(rows: DataFrame, keys: list[str], order: list[str], same: list[str], name: str = "island") -> DataFrame:
    """Adds the number of the run of rows with equal ``same`` columns that a row belongs to (from 1)."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(*[F.lit(None).cast("boolean")], F.lit(False))
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn(name, F.sum(F.when(first | changed, 1).otherwise(0)).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))


def coalesce_runs(spans: DataFrame, keys: list[str], order: str, same: list[str], text: str = "text") -> DataFrame:
    """One row per island: its first ``order`` value, the ``same`` columns, and the joined text."""
    numbered = islands(spans, keys, [order], same)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), "")
    return numbered.groupBy(*keys, "island").agg(F.min(order).alias(order), *[F.first(c, ignorenulls=False).alias(c) for c in same], whole.alias(text))


def toggle(direct: Column, defaults: Column, trues_in_styles: Column) -> Column:
    """Effective toggle: direct formatting is final, defaults that are true beat styles, else an odd number of style trues."""
    return F.when(direct.isNotNull(), direct).when(F.coalesce(defaults, F.lit(False)), F.lit(True)).otherwise(F.coalesce(trues_in_styles, F.lit(0)) % 2 == 1)


def fmt_bits(**flags: Column) -> Column:
    """The format number of boolean columns."""
    out = F.lit(0)
    for name, flag in flags.items():
        out = out + F.when(F.coalesce(flag, F.lit(False)), F.lit(FMT[name])).otherwise(F.lit(0))
    return out


def has(fmt: Column, name: str) -> Column:
    return fmt.bitwiseAND(F.lit(FMT[name])) != 0


def hoist(spans: DataFrame, order: str = "seq") -> DataFrame:
    """Formatted spans in up to three rows: outer whitespace carries no format.  Adds ``piece`` to order by."""
    lead, core, tail = strings.hoisted(F.col("text"))
    plain = F.lit(0)
    parts = F.when((F.col("fmt") == 0) | F.col("text").isNull(), F.array(F.struct(F.lit(0).alias("piece"), F.col("fmt").alias("fmt"), F.col("text").alias("text")))).otherwise(
        F.array(F.struct(F.lit(0).alias("piece"), plain.alias("fmt"), lead.alias("text")), F.struct(F.lit(1).alias("piece"), F.col("fmt").alias("fmt"), core.alias("text")), F.struct(F.lit(2).alias("piece"), plain.alias("fmt"), tail.alias("text")))
    )
    others = [c for c in spans.columns if c not in ("fmt", "text")]
    return spans.select(*others, F.inline(parts)).where((F.col("text") != "") | F.col("text").isNull())


def decorate(text: Column, fmt: Column, underline: str = "drop", highlight: str = "drop") -> Column:
    """Delimiters around escaped (or code) text; sup and sub, and underline and highlight where asked, as HTML."""
    out = text
    if highlight == "mark":
        out = F.when(has(fmt, "highlight"), F.concat(F.lit("<mark>"), out, F.lit("</mark>"))).otherwise(out)
    if underline == "u":
        out = F.when(has(fmt, "underline"), F.concat(F.lit("<u>"), out, F.lit("</u>"))).otherwise(out)
    for name, tag in (("sub", "sub"), ("sup", "sup")):
        out = F.when(has(fmt, name), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    for name, mark in (("strike", "~~"), ("italic", "*"), ("bold", "**")):
        out = F.when(has(fmt, name) & ~has(fmt, "code"), F.concat(F.lit(mark), out, F.lit(mark))).otherwise(out)
    return out
