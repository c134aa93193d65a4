"""Package model: content types, relationships and the parts they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import strings

# Endings of relationship types, and content types of a main part.
MAIN_TYPES = [
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.template.main+xml",
    "application/vnd.ms-word.document.macroenabled.main+xml",
    "application/vnd.ms-word.template.macroenabledtemplate.main+xml",
]
# File name extensions of image content types.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tif", "image/svg+xml": "svg", "image/webp": "webp", "image/x-emf": "emf", "image/emf": "emf", "image/x-wmf": "wmf", "image/wmf": "wmf"}


def attr(name: str) -> Column:
    return F.element_at("attrs", F.lit(name))


def with_override(keyed: DataFrame, default: DataFrame, override: DataFrame, default_on: list[str], override_on: list[str], value: str) -> DataFrame:
    """Left joins to a default and an override table; the override wins."""
    a = default.select(*default_on, F.col(value).alias("_default"))
    b = override.select(*override_on, F.col(value).alias("_override"))
    return keyed.join(a, default_on, "left").join(b, override_on, "left").withColumn(value, F.coalesce("_override", "_default")).drop("_default", "_override")


def content_types(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``doc_id, part_key, content_type``: Override by part name, else Default by extension."""
    ct = nodes.where((F.col("part") == "[content_types].xml") & (F.col("ns") == "ct"))
    default = ct.where(F.col("name") == "Default").select("doc_id", F.lower(attr("Extension")).alias("extension"), F.lower(attr("ContentType")).alias("content_type")).dropDuplicates(["doc_id", "extension"])
    override = ct.where(F.col("name") == "Override").select("doc_id", F.lower(F.ltrim(attr("PartName"), F.lit("/"))).alias("part_key"), F.lower(attr("ContentType")).alias("content_type")).dropDuplicates(["doc_id", "part_key"])
    keyed = parts.where("part_key is not null").select("doc_id", "part_key", F.lower(F.regexp_extract("part_key", r"\.([^./]*)$", 1)).alias("extension"))
    return with_override(keyed, default, override, ["doc_id", "extension"], ["doc_id", "part_key"], "content_type").drop("extension")


def relationships(nodes: DataFrame) -> DataFrame:
    """``doc_id, source_part, rel_id, rel_type, target, external, target_part``: ids belong to their part."""
    rels = nodes.where((F.col("ns") == "rel") & (F.col("name") == "Relationship"))
    source = F.regexp_replace(F.regexp_replace("part", r"_rels/([^/]*)\.rels$", "$1"), r"^_rels/\.rels$", "")
    out = rels.select("doc_id", source.alias("source_part"), attr("Id").alias("rel_id"), F.regexp_extract(attr("Type"), r"([^/]*)$", 1).alias("rel_type"), attr("Target").alias("target"), (F.lower(F.coalesce(attr("TargetMode"), F.lit(""))) == "external").alias("external"))
    return out.withColumn("target_part", F.when(~F.col("external"), F.lower(strings.resolve_path(F.col("source_part"), F.col("target")))))


def resolve_rels(refs: DataFrame, rels: DataFrame) -> DataFrame:
    """Refs (doc_id, source_part, rel_id) with their relationship's columns; unknown ids keep nulls."""
    return refs.join(rels, ["doc_id", "source_part", "rel_id"], "left")


def main_parts(rels: DataFrame, types: DataFrame) -> DataFrame:
    """``doc_id, main_part``: the package's document relationship, else the first part of a main content type."""
    by_rel = rels.where((F.col("source_part") == "") & (F.col("rel_type") == "officeDocument")).groupBy("doc_id").agg(F.min("target_part").alias("by_rel"))
    by_type = types.where(F.col("content_type").isin(MAIN_TYPES)).groupBy("doc_id").agg(F.min("part_key").alias("by_type"))
    known = types.select("doc_id", F.col("part_key").alias("by_rel"), F.lit(True).alias("there")).distinct()
    return by_rel.join(known, ["doc_id", "by_rel"], "left").withColumn("by_rel", F.when(F.col("there"), F.col("by_rel"))).join(by_type, "doc_id", "full").select("doc_id", F.coalesce("by_rel", "by_type").alias("main_part")).where("main_part is not null")


def parts_by_type(rels: DataFrame, mains: DataFrame, rel_type: str) -> DataFrame:
    """``doc_id, part`` of the main part's relationship of a type (styles, numbering, footnotes ...)."""
    found = rels.join(mains, (rels["doc_id"] == mains["doc_id"]) & (rels["source_part"] == mains["main_part"])).where((F.col("rel_type") == rel_type) & F.col("target_part").isNotNull())
    return found.groupBy(rels["doc_id"]).agg(F.min("target_part").alias("part"))


def stories(rels: DataFrame, mains: DataFrame) -> DataFrame:
    """``doc_id, part, story``: every main part as the body, and its notes parts."""
    out = mains.select("doc_id", F.col("main_part").alias("part"), F.lit("body").alias("story"))
    for name in ("footnotes", "endnotes"):
        out = out.unionByName(parts_by_type(rels, mains, name).withColumn("story", F.lit(name)))
    return out


def missing_inputs(requested: DataFrame, found: DataFrame, on: str = "path") -> DataFrame:
    """Requested inputs that were not found."""
    return requested.join(found.select(on).distinct(), on, "left_anti")


def extension_of(content_type: Column, part: Column) -> Column:
    """Media extension from the content type, else from the part's own (letters and digits only), else bin."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    own = F.regexp_extract(F.lower(part), r"\.([a-z0-9]{1,8})$", 1)
    return F.coalesce(F.element_at(known, content_type), F.nullif(own, F.lit("")), F.lit("bin"))
