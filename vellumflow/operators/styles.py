"""Style and numbering resolution: inheritance chains with a depth cap, layered properties, toggles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import strings
from vellumflow.session import staged

from .package import attr

MAX_DEPTH = 16
# The properties that toggle.
TOGGLES = ["b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "outline", "shadow", "emboss", "imprint", "vanish"]
# Style names with a meaning of their own.
CODE_STYLES = ["html preformatted", "preformatted text", "source code", "code"]
CODE_SPAN_STYLES = ["code", "html code", "verbatim char", "source text", "macro text"]
QUOTE_STYLES = ["quote", "intense quote", "block text"]
LINK_STYLES = ["hyperlink", "internet link"]
# Monospaced fonts.
MONOSPACE = ["consolas", "courier", "courier new", "cascadia code", "cascadia mono", "lucida console", "menlo", "monaco", "dejavu sans mono", "liberation mono", "fira code", "fira mono", "jetbrains mono", "source code pro", "roboto mono", "ubuntu mono", "ibm plex mono"]


def chains(parents: DataFrame, keys: list[str], node: str, parent: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Every node with each of its ancestors: keys, node, ``ancestor``, ``depth`` (0 is itself).

    One equi-join a round, each staged in the shared folder, until no chain goes
    on or the cap is reached; a cycle ends where it would repeat, and unknown
    parents end a chain.
    """
    own = staged(parents.select(*keys, F.col(node).alias("node"), F.col(parent).alias("up")), "parents")
    step = own.select(*keys, F.col("node").alias("_next"), F.col("up").alias("_above"))
    level = own.select(*keys, "node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"), F.col("up").alias("_next"), F.array("node").alias("_seen"))
    out = level.drop("_next", "_seen")
    for k in range(1, depth):
        onward = level.where(F.col("_next").isNotNull() & ~F.array_contains("_seen", F.col("_next"))).join(step, [*keys, "_next"])
        level = staged(onward.select(*keys, "node", F.col("_next").alias("ancestor"), F.lit(k).alias("depth"), F.col("_above").alias("_next"), F.concat("_seen", F.array("_next")).alias("_seen")), "chain")
        if level.isEmpty():
            break
        out = out.unionByName(level.drop("_next", "_seen"))
    return out


def chains_sql(parents: DataFrame, node: str, parent: str, depth: int = MAX_DEPTH) -> DataFrame:
    """The same closure as one recursive query, for parents without further keys."""
    view = "_chain_parents"
    parents.select(F.col(node).alias("n"), F.col(parent).alias("p")).createOrReplaceTempView(view)
    return parents.sparkSession.sql(f"""
        WITH RECURSIVE c(node, ancestor, depth) AS (
            SELECT n, n, 0 FROM {view}
            UNION ALL
            SELECT c.node, v.p, c.depth + 1 FROM c JOIN {view} v ON c.ancestor = v.n WHERE v.p IS NOT NULL AND c.depth + 1 < {depth}
        ) SELECT node, ancestor, min(depth) AS depth FROM c GROUP BY node, ancestor""")


def run_properties(nodes: DataFrame, owner: str) -> DataFrame:
    """Run properties by owner element (``r``, ``style`` ...): ``doc_id, part, owner, prop, value, on``."""
    inside = nodes.where(F.col("near")["rPr"].isNotNull() & (F.col("parent") == F.col("near")["rPr"]) & F.col("near")["rPrChange"].isNull() & (F.col("ns") == "w"))
    at = inside.where(F.col("near")[owner].isNotNull())
    return at.select("doc_id", "part", F.col("near")[owner].alias("owner"), F.col("name").alias("prop"), attr("w:val").alias("value"), strings.on_off(attr("w:val"), F.lit(True)).alias("on"), "attrs")


def font_name(attrs: Column) -> Column:
    """The font that run properties name, or a reference to the theme's, which comes first."""
    return F.coalesce(F.concat(F.lit("theme:"), attrs["w:asciiTheme"]), attrs["w:ascii"])


def theme_fonts(nodes: DataFrame) -> DataFrame:
    """``doc_id, major_font, minor_font`` of the theme part."""
    latin = nodes.where((F.col("ns") == "a") & (F.col("name") == "latin"))
    inside = lambda name: F.max(F.when(F.col("near")[name].isNotNull(), attr("typeface")))
    return latin.groupBy("doc_id").agg(inside("majorFont").alias("major_font"), inside("minorFont").alias("minor_font"))


def themed(font: Column) -> Column:
    """References to the theme as its fonts."""
    return F.when(F.startswith(font, F.lit("theme:major")), F.coalesce("major_font", F.lit(""))).when(F.startswith(font, F.lit("theme:minor")), F.coalesce("minor_font", F.lit(""))).otherwise(font)


def styles(nodes: DataFrame) -> DataFrame:
    """``doc_id, style_id, type, name_norm, based_on, is_default`` and the style's own properties as maps."""
    own = nodes.where((F.col("ns") == "w") & (F.col("name") == "style")).select("doc_id", "part", F.col("seq").alias("owner"), attr("w:styleId").alias("style_id"), F.coalesce(attr("w:type"), F.lit("paragraph")).alias("type"), F.coalesce(strings.on_off(attr("w:default"), attr("w:default").isNotNull()), F.lit(False)).alias("is_default"))
    child = nodes.where((F.col("ns") == "w") & F.col("near")["style"].isNotNull())
    direct = child.where(F.col("parent") == F.col("near")["style"]).groupBy("doc_id", "part", F.col("near")["style"].alias("owner")).agg(F.max(F.when(F.col("name") == "name", attr("w:val"))).alias("name"), F.max(F.when(F.col("name") == "basedOn", attr("w:val"))).alias("based_on"))
    props = run_properties(nodes, "style").groupBy("doc_id", "part", "owner").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("prop").isin(TOGGLES), F.struct("prop", "on")))).alias("toggles"),
        F.map_from_entries(F.collect_set(F.when(~F.col("prop").isin([*TOGGLES, "rFonts"]), F.struct("prop", F.coalesce("value", F.lit("true")))))).alias("props"),
        F.max(F.when(F.col("prop") == "rFonts", font_name(F.col("attrs")))).alias("font"),
    )
    para = child.where(F.col("near")["pPr"].isNotNull() & F.col("near")["rPr"].isNull()).groupBy("doc_id", "part", F.col("near")["style"].alias("owner")).agg(
        F.max(F.when(F.col("name") == "outlineLvl", attr("w:val"))).alias("outline"),
        F.max(F.when(F.col("name") == "numId", attr("w:val"))).alias("num_id"),
        F.max(F.when(F.col("name") == "ilvl", attr("w:val"))).alias("ilvl"),
    )
    keys = ["doc_id", "part", "owner"]
    joined = own.join(direct, keys, "left").join(props, keys, "left").join(para, keys, "left")
    return joined.withColumn("name_norm", strings.normal_name(F.coalesce("name", "style_id"))).dropDuplicates(["doc_id", "style_id"]).drop("part", "owner", "name")


def resolve_styles(style_rows: DataFrame) -> DataFrame:
    """Per style: toggles set true along its chain (a list of names, repeats kept), nearest other properties, names in the chain."""
    style_rows = staged(style_rows, "styles")
    closure = chains(style_rows, ["doc_id"], "style_id", "based_on")
    above = closure.join(style_rows.withColumnRenamed("style_id", "ancestor"), ["doc_id", "ancestor"])
    near = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    layered = F.array_sort(F.collect_list(F.struct("depth", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("own"))), lambda a, b: b["depth"] - a["depth"])
    merged = F.aggregate(layered, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(x["own"], k)), x["own"]))
    toggled = F.flatten(F.collect_list(F.map_keys(F.map_filter(F.coalesce("toggles", F.create_map().cast("map<string,boolean>")), lambda k, v: v))))
    return above.groupBy("doc_id", F.col("node").alias("style_id")).agg(
        toggled.alias("trues"), merged.alias("props"), near("font"), near("outline"), near("num_id"), near("ilvl"),
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "name_norm", "ancestor"))), lambda x: F.struct(x["name_norm"].alias("name"), x["ancestor"].alias("id"))).alias("chain"),
        F.max(F.when(F.col("depth") == 0, F.col("type"))).alias("type"), F.max(F.when(F.col("depth") == 0, F.col("is_default"))).alias("is_default"),
    )


def heading_level(chain: Column, outline: Column) -> Column:
    """The level (1 to 6) of a chain of styles (name, id): by names, ids, title and subtitle, else by outline level; null for body text."""
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    level = F.array_max(F.transform(chain, lambda x: F.coalesce(number(x["name"], "^heading ?([1-9])$"), number(F.lower(x["id"]), "^(?:heading|(?:ü|u)?berschrift)([1-9])$"))))
    named = lambda name: F.exists(chain, lambda x: x["name"] == name)
    found = F.coalesce(level, F.when(named("title"), 1), F.when(named("subtitle"), 2), F.when(outline.between(0, 8), outline + 1))
    return F.when(found > 6, 6).otherwise(found)


def doc_defaults(nodes: DataFrame) -> DataFrame:
    """``doc_id, default_toggles, default_font``."""
    inside = nodes.where((F.col("ns") == "w") & F.col("near")["rPrDefault"].isNotNull() & F.col("near")["rPr"].isNotNull())
    return inside.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.when(F.col("name").isin(TOGGLES), F.struct("name", strings.on_off(attr("w:val"), F.lit(True)))))).alias("default_toggles"), F.max(F.when(F.col("name") == "rFonts", font_name(F.col("attrs")))).alias("default_font"))


def numbering(nodes: DataFrame, style_numbers: DataFrame) -> DataFrame:
    """``doc_id, num_id, abstract_id, ilvl, num_fmt, start, lvl_restart, lvl_left, start_override`` with overrides applied.

    ``style_numbers`` (doc_id, style_id, num_id) lets an abstract definition that delegates to a style be followed, once
    for each link up to a small cap; loops leave it without levels.
    """
    w = nodes.where(F.col("ns") == "w")
    keys = ["doc_id", "part"]
    levels = w.where((F.col("name") == "lvl")).select(*keys, "seq", F.col("near")["abstractNum"].alias("a_seq"), F.col("near")["num"].alias("n_seq"), attr("w:ilvl").cast("int").alias("ilvl"))
    inner = w.where(F.col("near")["lvl"].isNotNull() & ((F.col("parent") == F.col("near")["lvl"]) | (F.col("name") == "ind") & F.col("near")["pPr"].isNotNull())).groupBy(*keys, F.col("near")["lvl"].alias("seq")).agg(F.max(F.when(F.col("name") == "numFmt", attr("w:val"))).alias("num_fmt"), F.max(F.when(F.col("name") == "start", attr("w:val"))).cast("int").alias("start"), F.max(F.when(F.col("name") == "lvlRestart", attr("w:val"))).cast("int").alias("lvl_restart"), F.max(F.when(F.col("name") == "ind", F.coalesce(attr("w:left"), attr("w:start")))).cast("int").alias("lvl_left"))
    filled = levels.join(inner, [*keys, "seq"], "left")
    abstract = w.where(F.col("name") == "abstractNum").select(*keys, F.col("seq").alias("a_seq"), attr("w:abstractNumId").alias("abstract_id"))
    links = w.where(F.col("name").isin("numStyleLink", "styleLink") & F.col("near")["abstractNum"].isNotNull()).groupBy(*keys, F.col("near")["abstractNum"].alias("a_seq")).agg(F.max(F.when(F.col("name") == "numStyleLink", attr("w:val"))).alias("delegates"))
    abstract = abstract.join(links, [*keys, "a_seq"], "left")
    nums = w.where(F.col("name") == "num").select(*keys, F.col("seq").alias("n_seq"), attr("w:numId").alias("num_id"))
    target = w.where((F.col("name") == "abstractNumId") & F.col("near")["num"].isNotNull()).groupBy(*keys, F.col("near")["num"].alias("n_seq")).agg(F.max(attr("w:val")).alias("abstract_id"))
    nums = nums.join(target, [*keys, "n_seq"])
    # Follow numStyleLink: num -> abstract -> style -> num -> abstract, at most three hops.
    hops = nums.select("doc_id", "num_id", F.col("abstract_id").alias("home"))
    to_style = abstract.select("doc_id", F.col("abstract_id").alias("home"), "delegates")
    onward = style_numbers.where("num_id is not null").select("doc_id", F.col("style_id").alias("delegates"), F.col("num_id").alias("_num")).join(nums.select("doc_id", F.col("num_id").alias("_num"), F.col("abstract_id").alias("next_home")), ["doc_id", "_num"]).drop("_num")
    for _ in range(3):
        hops = hops.join(to_style, ["doc_id", "home"], "left").join(onward, ["doc_id", "delegates"], "left").select("doc_id", "num_id", F.coalesce("next_home", "home").alias("home"))
    base = filled.where("n_seq is null").join(abstract.select(*keys, "a_seq", "abstract_id"), [*keys, "a_seq"]).select("doc_id", F.col("abstract_id").alias("home"), "ilvl", "num_fmt", "start", "lvl_restart", "lvl_left")
    replaced = filled.where("n_seq is not null").join(nums.select(*keys, "n_seq", "num_id"), [*keys, "n_seq"]).select("doc_id", "num_id", "ilvl", F.col("num_fmt").alias("r_fmt"), F.col("start").alias("r_start"), F.col("lvl_restart").alias("r_restart"), F.col("lvl_left").alias("r_left"))
    over = w.where((F.col("name") == "startOverride") & F.col("near")["lvlOverride"].isNotNull())
    over = over.alias("o").join(w.where(F.col("name") == "lvlOverride").select(*keys, F.col("seq").alias("p_seq"), attr("w:ilvl").cast("int").alias("ilvl")).alias("p"), (F.col("o.doc_id") == F.col("p.doc_id")) & (F.col("o.part") == F.col("p.part")) & (F.col("o.parent") == F.col("p_seq")))
    over = over.select(F.col("o.doc_id").alias("doc_id"), F.col("o.part").alias("part"), F.col("o.near")["num"].alias("n_seq"), "ilvl", F.col("o.attrs")["w:val"].cast("int").alias("start_override")).join(nums.select(*keys, "n_seq", "num_id"), [*keys, "n_seq"]).select("doc_id", "num_id", "ilvl", "start_override")
    out = hops.join(base, ["doc_id", "home"]).join(replaced, ["doc_id", "num_id", "ilvl"], "left").join(over, ["doc_id", "num_id", "ilvl"], "left")
    return out.select("doc_id", "num_id", F.col("home").alias("abstract_id"), "ilvl", F.coalesce("r_fmt", "num_fmt", F.lit("decimal")).alias("num_fmt"), F.coalesce("r_start", "start", F.lit(1)).alias("start"), F.coalesce("r_restart", "lvl_restart").alias("lvl_restart"), F.coalesce("r_left", "lvl_left").alias("lvl_left"), "start_override").dropDuplicates(["doc_id", "num_id", "ilvl"])
