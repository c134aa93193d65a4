"""Packages to Markdown: the whole conversion as one plan of joins, windows and ordered aggregates.

Every table is keyed by ``doc_id`` and ``part`` and ordered by ``seq``, the
position of an element in its part, so nothing relies on row order.  Python runs
only where archives are inflated and XML is tokenised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellumflow.functions import escape, strings
from vellumflow.operators import lists, package, runs, structure, styles, tables
from vellumflow.operators.package import attr
from vellumflow.session import staged
from vellumflow.sources import docx

# Subtrees that accepting all changes, or reading current properties, leaves out.
GONE = ["del", "moveFrom", "rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "tcPrChange", "trPrChange", "cellDel"]
# Code points of two symbol fonts and the characters that they show.
SYMBOLS = {"symbol": {0xB7: "•", 0xD7: "⋅", 0xB1: "±", 0xB3: "≥", 0xA3: "≤", 0xB9: "≠", 0xAE: "→", 0xAC: "←", 0xA5: "∞", 0x61: "α", 0x62: "β", 0x67: "γ", 0x64: "δ", 0x6D: "μ", 0x70: "π", 0x53: "Σ", 0x57: "Ω"}, "wingdings": {0xA7: "▪", 0xFC: "✓", 0xFB: "✗", 0xFE: "☑", 0xA8: "☐", 0xE0: "→", 0x4A: "☺", 0x6C: "●", 0x6E: "■"}}
# Signs of linear mathematics by group: before it, and around several pieces.
MATH = {"num": ("", "(", ")"), "den": ("/", "(", ")"), "sup": ("^", "{", "}"), "sub": ("_", "{", "}")}
PARA = ["doc_id", "part", "p"]


@dataclass(frozen=True)
class Options:
    """Policies; the defaults are the plain ones."""

    hard_break: str = "backslash"
    images: bool = True
    underline: str = "drop"
    highlight: str = "drop"
    toc: str = "skip"
    ascii_punct: bool = False
    autolink: bool = False
    #: ``{name}`` stands for the document's own name, so that several documents' pictures keep apart.
    media_dir: str = "media"
    no_break: str = "keep"
    image_size: bool = False
    header_row: str = "first"
    tables: str = "gfm"
    comments: str = "drop"
    ruby: str = "base"
    caps: docx.Caps = field(default_factory=docx.Caps)


@dataclass
class Converted:
    """``documents`` (doc_id, status, markdown, message), ``media`` (doc_id, folder, out_name, content), ``diagnostics``."""

    documents: DataFrame
    media: DataFrame
    diagnostics: DataFrame


def near(name: str) -> Column:
    return F.col("near")[name]


def accepted(nodes: DataFrame) -> DataFrame:
    """Nodes without deletions and old properties."""
    return nodes.where(~F.coalesce(F.col("name").isin(GONE), F.lit(False)) & ~F.exists(F.map_keys("near"), lambda k: k.isin(GONE)))


def refused_branches(kept: DataFrame) -> DataFrame:
    """``doc_id, part, b, to`` of the branches of alternate content that are not taken."""
    branches = kept.where((F.col("ns") == "mc") & F.col("name").isin("Choice", "Fallback"))
    rank = F.when((F.col("name") == "Choice") & F.forall(F.split(F.trim(F.coalesce(attr("Requires"), F.lit("?"))), r"\s+"), lambda x: x.isin(docx.UNDERSTOOD)), 0).when(F.col("name") == "Fallback", 1).otherwise(2)
    order = W.Window.partitionBy("doc_id", "part", "parent").orderBy(rank, "seq")
    return branches.withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) | (rank == 2)).select("doc_id", "part", F.col("seq").alias("b"), F.col("end_seq").alias("to"))


def live(nodes: DataFrame) -> DataFrame:
    """Nodes of accepted content: no deletions or old properties, one branch of alternate content."""
    kept = accepted(nodes)
    return outside(kept, refused_branches(kept), "b", "to")


def outside(rows: DataFrame, intervals: DataFrame, begin: str, end: str) -> DataFrame:
    """Rows whose ``seq`` lies in none of their part's intervals: where no interval is open, by running sums."""
    edge = lambda at, order: intervals.select("doc_id", "part", F.col(at).cast(rows.schema["seq"].dataType).alias("seq"), F.lit(order).alias("_edge"))
    both = rows.withColumn("_edge", F.lit(1)).unionByName(edge(begin, 0).unionByName(edge(end, 2)), allowMissingColumns=True)
    deep = structure.drop_depth(both, ["doc_id", "part"], ["seq", "_edge"], F.col("_edge") == 0, F.col("_edge") == 2, "_depth")
    return deep.where((F.col("_edge") == 1) & (F.col("_depth") == 0)).drop("_edge", "_depth")


def outside_any(rows: DataFrame, intervals: DataFrame, label: str) -> DataFrame:
    """``outside`` of intervals (``b``, ``to``) that are staged first: where there are none, rows need no sorting."""
    intervals = staged(intervals, label)
    return rows if intervals.isEmpty() else outside(rows, intervals, "b", "to")


def field_frames(nodes: DataFrame) -> DataFrame:
    """Complex fields: ``doc_id, part, depth, b, sep, e, instr`` (an unclosed one reaches to the end)."""
    marks = nodes.where((F.col("name") == "fldChar") & (F.col("ns") == "w")).select("doc_id", "part", "seq", attr("w:fldCharType").alias("kind"))
    found = structure.frames(marks, ["doc_id", "part"], "seq").withColumn("last", F.coalesce("e", F.lit(2**31 - 1)))
    parts = nodes.where(F.col("name").isin("instrText") & (F.col("ns") == "w")).select("doc_id", "part", F.col("seq").alias("i"), F.col("text").alias("it"))
    # An instruction belongs to the deepest field that is still in its instruction there.
    deepest = structure.innermost(parts, found.select("doc_id", "part", F.col("b").alias("from"), F.coalesce("sep", "last").alias("to"), "b"), ["doc_id", "part"], "i", "from", "to", "b")
    instr = deepest.groupBy("doc_id", "part", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "it"))), lambda x: x["it"]), "").alias("instr"))
    return found.join(instr, ["doc_id", "part", "b"], "left").withColumn("instr", F.coalesce("instr", F.lit("")))


def field_link(instr: Column) -> Column:
    """The destination of a HYPERLINK or linked REF field, else null."""
    word, to = strings.field_keyword(instr), strings.field_argument(instr)
    anchor = strings.field_switch(instr, "l")
    hyper = F.when((to != "") & F.coalesce(anchor != "", F.lit(False)), F.concat(to, F.lit("#"), anchor)).when(to != "", to).when(anchor != "", F.concat(F.lit("#"), anchor))
    return F.when(word == "HYPERLINK", hyper).when((word == "REF") & strings.field_switch(instr, "h").isNotNull(), F.concat(F.lit("#"), to))


def _ruling() -> Column:
    """Whether a node is a drawn horizontal rule."""
    return (F.col("ns") == "v") & F.col("name").isin("rect", "line") & F.coalesce(F.lower(attr("o:hr")).isin("t", "true", "1"), F.lit(False))


def paragraphs(nodes: DataFrame) -> DataFrame:
    """One row per paragraph with its own properties; ``nodes`` are all nodes of story parts."""
    p = nodes.where((F.col("name") == "p") & (F.col("ns") == "w")).select("doc_id", "part", F.col("seq").alias("p"), near("tbl").alias("tbl"), near("tr").alias("tr"), near("tc").alias("tc"), F.coalesce(near("footnote"), near("endnote")).alias("note"))
    props = nodes.where(near("p").isNotNull() & (_ruling() | (F.col("ns") == "w") & near("pPr").isNotNull() & near("pPrChange").isNull()))
    of = lambda name, inside="pPr", value=attr("w:val"): F.max(F.when((F.col("name") == name) & (F.col("parent") == near(inside)) & near("rPr").isNull(), value))
    own = props.groupBy("doc_id", "part", near("p").alias("p")).agg(
        of("pStyle").alias("p_style"), of("numId", "numPr").alias("own_num"), of("ilvl", "numPr").alias("own_ilvl"), of("outlineLvl").alias("own_outline"),
        of("ind", value=F.coalesce(attr("w:left"), attr("w:start"))).cast("int").alias("ind_left"), of("jc").alias("jc"),
        F.max(_ruling() | F.col("name").isin("bottom", "between") & near("pBdr").isNotNull()).alias("ruled"),
        F.max((F.col("name") == "del") & near("rPr").isNotNull()).alias("mark_deleted"),
    )
    return p.join(own, PARA, "left").withColumns({"ruled": F.coalesce("ruled", F.lit(False)), "mark_deleted": F.coalesce("mark_deleted", F.lit(False))})


def _symbol() -> Column:
    code = F.conv(F.coalesce(attr("w:char"), F.lit("0")), 16, 10).cast("int")
    low = F.when(code.between(0xF000, 0xF0FF), code - 0xF000).otherwise(code)
    out = F.lit(None).cast("string")
    for font, table in SYMBOLS.items():
        known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        out = F.coalesce(out, F.when(F.lower(attr("w:font")) == font, F.element_at(known, low)))
    return F.coalesce(out, F.when(code.between(0xE000, 0xF8FF), F.when(low.between(32, 126), F.char(low)).otherwise(F.lit("�"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def tokens(nodes: DataFrame, ruby: str = "base") -> DataFrame:
    """Content in paragraphs, in order: ``kind`` text, note, image or nothing but a place (bookmarks); ``ruby`` text goes or stands in brackets after its base."""
    w, name = F.col("ns") == "w", F.col("name")
    in_run = near("r").isNotNull() & near("rPr").isNull() & near("pPr").isNull()
    wrap = F.coalesce(attr("w:type"), F.lit("textWrapping")) == "textWrapping"
    text = (
        F.when(w & (name == "t") & in_run, F.col("text"))
        .when(w & name.isin("tab", "ptab") & in_run, F.lit(" "))
        .when(w & (name == "br") & in_run & wrap, F.lit("\n"))
        .when(w & (name == "cr") & in_run, F.lit("\n"))
        .when(w & (name == "noBreakHyphen") & in_run, F.lit("-"))
        .when(w & (name == "sym") & in_run, _symbol())
        .when((F.col("ns") == "m") & (name == "t"), F.col("text"))
    )
    note = F.when(w & (name == "footnoteReference"), F.lit("footnotes")).when(w & (name == "endnoteReference"), F.lit("endnotes"))
    embed = F.when((F.col("ns") == "a") & (name == "blip"), F.coalesce(attr("r:embed"), attr("r:link"))).when((F.col("ns") == "v") & (name == "imagedata"), attr("r:id"))
    kind = F.when(text.isNotNull(), F.lit("text")).when(note.isNotNull(), F.lit("note")).when(embed.isNotNull(), F.lit("image")).when(w & (name == "commentReference"), F.lit("comment"))
    rows = nodes.where(near("p").isNotNull()).withColumn("kind", kind).where(F.col("kind").isNotNull())
    rows = rows.withColumn("said", text).join(math_signs(nodes), ["doc_id", "part", "seq"], "left")
    rows = rows.where(near("rt").isNull()) if ruby == "base" else ruby_in_brackets(rows)
    text = F.when(F.col("kind") == "text", F.concat(F.coalesce("sign", F.lit("")), "said", F.coalesce("close", F.lit(""))))
    return rows.select("doc_id", "part", "seq", near("p").alias("p"), near("r").alias("run"), "kind", text.alias("text"), note.alias("note_story"), F.when(note.isNotNull() | (name == "commentReference"), attr("w:id")).alias("note_id"), embed.alias("rel_id"), F.coalesce(F.when(name == "imagedata", attr("o:title")), F.lit(None)).alias("title"), near("hyperlink").alias("hyperlink"), near("fldSimple").alias("simple"), near("drawing").alias("drawing"))


def ruby_in_brackets(rows: DataFrame) -> DataFrame:
    """Ruby text after its base, in brackets: both exchange their places, the places themselves stay."""
    inside = rows.where(near("ruby").isNotNull())
    each = W.Window.partitionBy("doc_id", "part", near("ruby"))
    above = near("rt").isNotNull()
    turn = F.row_number().over(each.orderBy(above, "seq"))
    first, last = F.min(F.when(above, F.col("seq"))).over(each), F.max(F.when(above, F.col("seq"))).over(each)
    inside = inside.withColumns({"_slots": F.sort_array(F.collect_list("seq").over(each)), "_turn": turn, "_first": first, "_last": last})
    opened = F.when(F.col("seq") == F.col("_first"), F.concat(F.lit("("), F.coalesce("sign", F.lit("")))).otherwise(F.col("sign"))
    closed = F.when(F.col("seq") == F.col("_last"), F.concat(F.coalesce("close", F.lit("")), F.lit(")"))).otherwise(F.col("close"))
    inside = inside.withColumns({"sign": opened, "close": closed, "seq": F.element_at("_slots", F.col("_turn"))}).drop("_slots", "_turn", "_first", "_last")
    return rows.where(near("ruby").isNull()).unionByName(inside)


def math_signs(nodes: DataFrame) -> DataFrame:
    """``doc_id, part, seq, sign, close``: what stands before and after a piece of linear mathematics.

    The first piece of a denominator or script carries its sign; where there are several pieces, these and those of a
    numerator are put together, outer groups outside.
    """
    pieces = nodes.where((F.col("ns") == "m") & (F.col("name") == "t"))
    groups = pieces.select("doc_id", "part", "seq", F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), near(k).alias("at")) for k in MATH]), lambda g: g["at"].isNotNull())).alias("g"))
    ends = groups.groupBy("doc_id", "part", "g").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), (F.count("*") > 1).alias("many"))
    of = lambda n: F.element_at(F.create_map(*[F.lit(x) for k, v in MATH.items() for x in (k, v[n])]), F.col("g.kind"))
    ends = ends.withColumns({"sign": F.concat(of(0), F.when(F.col("many"), of(1)).otherwise(F.lit(""))), "close": F.when(F.col("many"), of(2)).otherwise(F.lit(""))})
    each = ends.select("doc_id", "part", F.inline(F.array(F.struct(F.col("first").alias("seq"), F.col("g.at").alias("at"), F.col("sign"), F.lit("").alias("close")), F.struct(F.col("last").alias("seq"), (-F.col("g.at")).alias("at"), F.lit("").alias("sign"), F.col("close")))))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), "").alias(c)
    return each.groupBy("doc_id", "part", "seq").agg(joined("sign"), joined("close"))


def comment_texts(nodes: DataFrame) -> DataFrame:
    """``doc_id, note_id, remark``: each comment as an HTML comment (double hyphens would end it)."""
    about = nodes.where((F.col("ns") == "w") & (F.col("name") == "comment")).select("doc_id", F.col("seq").alias("c"), attr("w:id").alias("note_id"), F.coalesce(attr("w:author"), F.lit("")).alias("author"))
    said = nodes.where((F.col("ns") == "w") & (F.col("name") == "t") & near("comment").isNotNull()).groupBy("doc_id", near("comment").alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("said"))
    inner = F.replace(F.concat("author", F.lit(": "), F.coalesce("said", F.lit(""))), F.lit("--"), F.lit("- -"))
    return about.join(said, ["doc_id", "c"], "left").select("doc_id", "note_id", F.concat(F.lit("<!-- "), inner, F.lit(" -->")).alias("remark"))


def convert_files(files: DataFrame, options: Options = Options()) -> Converted:
    """Convert ``files`` (path, content, and a name if media folders ask for it).  Tables that several steps read are staged in the shared folder."""
    parts = staged(docx.unzip_parts(files, options.caps), "parts")
    every = staged(docx.parse_xml(docx.xml_parts(parts), options.caps), "every")
    nodes = every.where("error is null")
    types, rels = staged(package.content_types(nodes, parts), "types"), staged(package.relationships(nodes), "rels")
    mains = staged(package.main_parts(rels, types), "mains")
    story = package.stories(rels, mains)
    by_part = lambda name: nodes.join(package.parts_by_type(rels, mains, name), ["doc_id", "part"], "left_semi")

    # -- styles and numbering --------------------------------------------
    style_nodes = by_part("styles")
    resolved = staged(styles.resolve_styles(styles.styles(style_nodes)), "resolved")
    defaults = styles.doc_defaults(style_nodes)
    themes = styles.theme_fonts(by_part("theme"))
    nums = staged(styles.numbering(by_part("numbering"), resolved.select("doc_id", "style_id", "num_id")), "nums")

    # -- content ---------------------------------------------------------
    story = staged(story, "story")
    in_story = nodes.join(story.select("doc_id", "part"), ["doc_id", "part"], "left_semi")
    kept = accepted(in_story)
    separators = in_story.where(F.col("name").isin("footnote", "endnote") & attr("w:type").isNotNull() & (attr("w:type") != "normal")).select("doc_id", "part", F.col("seq").alias("b"), F.col("end_seq").alias("to"))
    gone = refused_branches(kept).unionByName(separators)
    if options.toc == "skip":
        marks = outside(kept.where(F.col("name").isin("docPartGallery", "sdt")), gone, "b", "to")
        gallery = marks.where((F.col("name") == "docPartGallery") & (attr("w:val") == "Table of Contents")).select("doc_id", "part", near("sdt").alias("seq"))
        toc = marks.where("name = 'sdt'").select("doc_id", "part", "seq", "end_seq").join(gallery, ["doc_id", "part", "seq"])
        gone = gone.unionByName(toc.select("doc_id", "part", F.col("seq").alias("b"), F.col("end_seq").alias("to")))
    content = staged(outside_any(kept, gone, "gone"), "content")
    frames = staged(field_frames(content), "frames")
    silent = frames.select("doc_id", "part", "b", F.coalesce("sep", "last").alias("to"))
    if options.toc == "skip":
        silent = silent.unionByName(frames.where(strings.field_keyword(F.col("instr")) == "TOC").select("doc_id", "part", "b", F.col("last").alias("to")))
        silent = silent.unionByName(content.where((F.col("name") == "fldSimple") & (strings.field_keyword(attr("w:instr")) == "TOC")).select("doc_id", "part", F.col("seq").alias("b"), F.col("end_seq").alias("to")))
    included = frames.where((strings.field_keyword(F.col("instr")) == "INCLUDEPICTURE") & (strings.field_argument(F.col("instr")) != "")).select("doc_id", "part", "b", F.col("last").alias("to"), strings.field_argument(F.col("instr")).alias("url"))
    silent = silent.unionByName(included.select("doc_id", "part", "b", "to"))
    said = outside_any(tokens(content, options.ruby), silent, "silent")

    # -- paragraphs ------------------------------------------------------
    paras = paragraphs(in_story.where(near("del").isNull() & near("moveFrom").isNull())).join(content.where("name = 'p'").select("doc_id", "part", F.col("seq").alias("p")), PARA, "left_semi")
    default_p = resolved.where("is_default and type = 'paragraph'").groupBy("doc_id").agg(F.min("style_id").alias("_default"))
    known = resolved.select("doc_id", F.col("style_id").alias("style"), F.col("trues").alias("p_trues"), F.col("props").alias("p_props"), F.col("font").alias("p_font"), "outline", F.col("num_id").alias("style_num"), F.col("ilvl").alias("style_ilvl"), "chain")
    paras = paras.join(default_p, "doc_id", "left").withColumn("style", F.coalesce("p_style", "_default")).drop("_default").join(known, ["doc_id", "style"], "left")
    ids = F.coalesce(F.transform("chain", lambda x: x["name"]), F.array(strings.normal_name(F.coalesce("style", F.lit("")))))
    heading = styles.heading_level(F.coalesce("chain", F.array(F.struct(strings.normal_name(F.coalesce("style", F.lit(""))).alias("name"), F.coalesce("style", F.lit("")).alias("id")))), F.coalesce("own_outline", "outline").cast("int"))
    is_in = lambda names: F.arrays_overlap(ids, F.array(*map(F.lit, names)))
    paras = paras.withColumns({"heading": heading, "quoted": is_in(styles.QUOTE_STYLES), "coded": is_in(styles.CODE_STYLES), "num_id": F.nullif(F.coalesce("own_num", "style_num"), F.lit("0")), "ilvl": F.coalesce(F.col("own_ilvl"), F.col("style_ilvl"), F.lit("0")).cast("int")})
    joined = structure.join_deleted_marks(paras, ["doc_id", "part"], "p")
    lead = joined.groupBy("doc_id", "part", "joined").agg(F.min("p").alias("lead"))
    paras = staged(joined.join(lead, ["doc_id", "part", "joined"]), "paras")
    said = said.join(paras.select(*PARA, "lead", "heading", "p_trues", "p_props", "p_font"), PARA).withColumn("p", F.col("lead")).drop("lead")
    paras = paras.where("p = lead")

    # -- runs ------------------------------------------------------------
    run_rows = styles.run_properties(in_story.where(near("p").isNotNull() & near("pPr").isNull()), "r")
    direct = run_rows.groupBy("doc_id", "part", F.col("owner").alias("run")).agg(F.map_from_entries(F.collect_set(F.when(F.col("prop").isin(styles.TOGGLES), F.struct("prop", "on")))).alias("d_toggles"), F.map_from_entries(F.collect_set(F.when(~F.col("prop").isin([*styles.TOGGLES, "rFonts"]), F.struct("prop", F.coalesce("value", F.lit("true")))))).alias("d_props"), F.max(F.when(F.col("prop") == "rFonts", styles.font_name(F.col("attrs")))).alias("d_font"))
    said = said.join(direct, ["doc_id", "part", "run"], "left").withColumn("r_style", F.col("d_props")["rStyle"])
    char = resolved.select("doc_id", F.col("style_id").alias("r_style"), F.col("trues").alias("r_trues"), F.col("props").alias("r_props"), F.col("font").alias("r_font"), F.transform("chain", lambda x: x["name"]).alias("r_names"))
    said = said.join(char, ["doc_id", "r_style"], "left").join(defaults, "doc_id", "left").join(themes, "doc_id", "left")

    def toggled(name: str) -> Column:
        of = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x == name)), F.lit(0))
        from_p = of(F.col("p_trues"))
        if name == "b":
            from_p = F.when(F.col("heading").isNull(), from_p).otherwise(0)  # a heading's weight is its style's
        return runs.toggle(F.col("d_toggles")[name], F.col("default_toggles")[name], F.greatest(from_p, F.lit(0)) + F.greatest(of(F.col("r_trues")), F.lit(0)))

    prop = lambda name: F.coalesce(F.col("d_props")[name], F.col("r_props")[name], F.col("p_props")[name])
    plain_on = lambda name: F.coalesce(F.lower(prop(name)).isin("1", "true", "on"), F.lit(False))
    font = F.lower(styles.themed(F.coalesce("d_font", "r_font", "p_font", "default_font", F.lit(""))))
    code = F.coalesce(F.arrays_overlap("r_names", F.array(*map(F.lit, styles.CODE_SPAN_STYLES))), F.lit(False)) | font.isin(styles.MONOSPACE)
    linkish = F.coalesce(F.arrays_overlap("r_names", F.array(*map(F.lit, styles.LINK_STYLES))), F.lit(False))
    fmt = runs.fmt_bits(bold=toggled("b") & ~code, italic=toggled("i") & ~code, strike=toggled("strike") | plain_on("dstrike"), code=code, sup=prop("vertAlign") == "superscript", sub=prop("vertAlign") == "subscript", underline=(F.coalesce(prop("u"), F.lit("none")) != "none") & ~linkish, highlight=F.coalesce(prop("highlight"), F.lit("none")) != "none")
    words = strings.visible(F.when(toggled("caps"), F.upper("text")).otherwise(F.col("text")))
    if options.ascii_punct:
        words = strings.ascii_punctuation(words)
    shown = said.where(~(toggled("vanish") | plain_on("webHidden")) | (F.col("kind") != "text"))
    shown = shown.withColumns({"fmt": F.when(F.col("kind") == "text", fmt).otherwise(0), "text": F.when(F.col("kind") == "text", words).otherwise(F.col("text"))}).select(*PARA, "seq", "kind", "text", "fmt", "note_story", "note_id", "rel_id", "title", "hyperlink", "simple", "drawing").where("kind <> 'text' or text <> ''")

    # -- links -----------------------------------------------------------
    hyper = content.where((F.col("name") == "hyperlink") & (F.col("ns") == "w")).select("doc_id", F.col("part").alias("source_part"), F.col("seq").alias("hyperlink"), attr("r:id").alias("rel_id"), attr("w:anchor").alias("anchor"))
    hyper = package.resolve_rels(hyper, rels).select("doc_id", F.col("source_part").alias("part"), "hyperlink", F.coalesce(F.concat("target", F.coalesce(F.concat(F.lit("#"), "anchor"), F.lit(""))), F.concat(F.lit("#"), "anchor")).alias("h_dest"))
    simple = content.where((F.col("name") == "fldSimple") & (F.col("ns") == "w")).select("doc_id", "part", F.col("seq").alias("simple"), field_link(attr("w:instr")).alias("s_dest"))
    linked = frames.withColumn("f_dest", field_link(F.col("instr"))).where("f_dest is not null and sep is not null").select("doc_id", "part", "sep", "last", F.struct("b", "f_dest").alias("f"))
    shown = shown.join(hyper, ["doc_id", "part", "hyperlink"], "left").join(simple, ["doc_id", "part", "simple"], "left")
    ranged = structure.innermost(shown.select("doc_id", "part", "seq"), linked, ["doc_id", "part"], "seq", "sep", "last", "f").groupBy("doc_id", "part", "seq").agg(F.max("f").alias("f"))
    shown = shown.join(ranged, ["doc_id", "part", "seq"], "left")
    shown = staged(shown.withColumn("dest", F.coalesce("h_dest", "s_dest", F.col("f.f_dest"))).withColumn("link", F.when(F.col("dest").isNotNull(), F.coalesce("hyperlink", "simple", "f.b"))).drop("f", "h_dest", "s_dest", "hyperlink", "simple"), "shown")

    # -- notes, images ---------------------------------------------------
    note_refs = shown.where("kind = 'note'").join(story.where("story = 'body'").select("doc_id", "part"), ["doc_id", "part"], "left_semi")
    numbers = staged(structure.renumber(note_refs.withColumn("rank", F.when(F.col("note_story") == "footnotes", 0).otherwise(1)), ["doc_id"], ["note_story", "note_id"], ["seq"], "rank").withColumnRenamed("number", "note_no"), "numbers")
    described = F.when(F.col("name") == "docPr", F.coalesce(F.nullif(attr("descr"), F.lit("")), F.nullif(attr("title"), F.lit("")), attr("name")))
    names = content.where((F.col("ns") == "wp") & F.col("name").isin("docPr", "extent")).groupBy("doc_id", "part", near("drawing").alias("drawing")).agg(F.max(described).alias("descr"), F.max(F.when(F.col("name") == "extent", attr("cx").try_cast("long"))).alias("cx"))
    pictures = package.resolve_rels(shown.where("kind = 'image'").select("doc_id", F.col("part").alias("source_part"), "seq", "rel_id"), rels).withColumnRenamed("source_part", "part")
    pictures = pictures.join(types.select("doc_id", F.col("part_key").alias("target_part"), "content_type"), ["doc_id", "target_part"], "left").withColumn("ext", package.extension_of(F.col("content_type"), F.col("target_part")))
    files_out = staged(structure.media_names(pictures.where("target_part is not null"), ["doc_id"], "target_part", ["part", "seq"]), "files-out")
    own = F.col("name") if "name" in files.columns else F.regexp_replace(F.regexp_extract(F.replace("path", F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"\.[^.]*$", "")
    files_out = files_out.join(files.select(F.col("path").alias("doc_id"), F.replace(F.lit(options.media_dir), F.lit("{name}"), own).alias("folder")), "doc_id")
    sources = pictures.join(files_out.select("doc_id", "target_part", "folder", "out_name"), ["doc_id", "target_part"], "left").select("doc_id", "part", "seq", F.when(F.col("external"), F.col("target")).otherwise(F.concat("folder", F.lit("/"), "out_name")).alias("src"))
    said_about = comment_texts(by_part("comments")) if options.comments == "html" else None
    shown = shown.join(numbers, ["doc_id", "note_story", "note_id"], "left").join(names, ["doc_id", "part", "drawing"], "left").join(sources, ["doc_id", "part", "seq"], "left")
    alt = escape.alt_text(F.coalesce("descr", "title", F.lit("")))
    picture = F.concat(F.lit("!["), alt, F.lit("]("), escape.destination(F.col("src")), F.lit(")")) if options.images else alt
    if options.images and options.image_size:
        sized = F.concat(F.lit('<img src="'), F.replace(escape.destination(F.col("src")), F.lit('"'), F.lit("%22")), F.lit('" alt="'), F.replace(escape.html(F.coalesce("descr", "title", F.lit(""))), F.lit('"'), F.lit("&quot;")), F.lit('" width="'), F.floor(F.col("cx") / 9525).cast("string"), F.lit('">'))
        picture = F.coalesce(sized, picture)
    if said_about is None:
        shown = shown.where("kind <> 'comment'").withColumn("remark", F.lit(None).cast("string"))
    else:
        shown = shown.join(said_about.withColumn("kind", F.lit("comment")), ["doc_id", "kind", "note_id"], "left")
    raw = F.when(F.col("kind") == "comment", F.col("remark")).when(F.col("kind") == "note", F.concat(F.lit("[^"), F.col("note_no").cast("string"), F.lit("]"))).when(F.col("kind") == "image", picture)
    spans = shown.select(*PARA, "seq", F.when(F.col("kind") == "text", F.lit("text")).otherwise(F.concat("kind", F.col("seq").cast("string"))).alias("kind"), F.coalesce(raw, F.col("text")).alias("text"), "fmt", "link", "dest").where("text is not null")

    where = content.where("name = 'fldChar'").select("doc_id", "part", F.col("seq").alias("b"), near("p").alias("p"))
    spans = spans.unionByName(included.join(where, ["doc_id", "part", "b"]).select(*PARA, F.col("b").alias("seq"), F.concat(F.lit("image"), "b").alias("kind"), F.concat(F.lit("![]("), escape.destination("url"), F.lit(")")).alias("text"), F.lit(0).alias("fmt"), F.lit(None).cast("int").alias("link"), F.lit(None).cast("string").alias("dest")))

    # -- bookmarks and slugs ---------------------------------------------
    spans = staged(runs.coalesce_runs(spans, PARA, "seq", ["kind", "fmt", "link", "dest"]).drop("island"), "spans")
    plain = spans.where("kind = 'text'").groupBy(*PARA).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("plain"), F.bool_and(runs.has(F.col("fmt"), "code")).alias("all_code"))
    heads = structure.slugs(paras.where("heading is not null").join(plain, PARA).select(*PARA, F.trim("plain").alias("text")), ["doc_id"], ["part", "p"])
    marks = content.where((F.col("name") == "bookmarkStart") & (F.col("ns") == "w")).select("doc_id", "part", "seq", near("p").alias("p"), attr("w:name").alias("bookmark"))
    marks = marks.join(heads.select(*PARA, "slug"), PARA, "left").groupBy("doc_id", "bookmark").agg(F.min(F.struct("part", "seq", "p", "slug")).alias("m")).select("doc_id", "bookmark", "m.*")
    target = staged(structure.wanted_marks(marks, spans, ["doc_id"]), "target")
    anchors = target.where("slug is null and p is not null").select(*PARA, F.lit(-1).alias("seq"), F.lit("anchor").alias("kind"), F.concat(F.lit('<a id="'), escape.html("bookmark"), F.lit('"></a>')).alias("text"), F.lit(0).alias("fmt"), F.lit(None).cast("int").alias("link"), F.lit(None).cast("string").alias("dest"))
    spans = spans.join(target.select("doc_id", F.concat(F.lit("#"), "bookmark").alias("dest"), F.concat(F.lit("#"), F.col("slug")).alias("at_slug")), ["doc_id", "dest"], "left").withColumn("dest", F.coalesce("at_slug", "dest")).drop("at_slug")

    # -- inline text -----------------------------------------------------
    pieces = runs.hoist(spans.withColumn("fmt", F.when(F.col("kind") == "text", F.col("fmt")).otherwise(0)))
    pieces = pieces.withColumn("at", F.col("seq") * 4 + F.col("piece"))
    merged = runs.coalesce_runs(pieces, PARA, "at", ["kind", "fmt", "link", "dest"]).drop("island")
    merged = merged.unionByName(anchors.withColumnRenamed("seq", "at"))
    safe = F.when(F.col("kind") != "text", F.col("text")).when(runs.has(F.col("fmt"), "code"), escape.code_span(F.col("text"))).otherwise(strings.no_break_entity(escape.inline(F.col("text"))) if options.no_break == "entity" else escape.inline(F.col("text")))
    merged = merged.withColumn("md", runs.decorate(safe, F.col("fmt"), options.underline, options.highlight))
    by_link = runs.islands(merged, PARA, ["at"], ["link", "dest"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "md"))), lambda x: x["md"]), "")
    bare = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    grouped = by_link.groupBy(*PARA, "island").agg(F.first("dest").alias("dest"), F.min("at").alias("at"), ordered.alias("md"), bare.alias("bare"))
    lead_ws, core, tail_ws = strings.hoisted(F.col("md"))
    link = F.concat(lead_ws, F.lit("["), core, F.lit("]("), escape.destination(F.col("dest")), F.lit(")"), tail_ws)
    if options.autolink:
        link = F.coalesce(strings.autolink(F.col("bare"), F.col("dest")), link)
    grouped = grouped.withColumn("md", F.when(F.col("dest").isNull(), F.col("md")).when(core == "", F.col("md")).otherwise(link))
    inline = grouped.groupBy(*PARA).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "md"))), lambda x: x["md"]), "").alias("inline"))
    paras = staged(paras.join(inline, PARA, "left").join(plain, PARA, "left").withColumn("inline", F.coalesce("inline", F.lit(""))), "inline")

    # -- tables ----------------------------------------------------------
    cells = staged(table_blocks(content, paras, options.header_row, options.tables), "cells")

    # -- blocks ----------------------------------------------------------
    is_rule = (F.trim("inline") == "") & F.col("ruled") | F.coalesce(F.col("plain"), F.lit("")).rlike(r"^\s*(-{3,}|\*{3,}|_{3,})\s*$")
    body = paras.where("tbl is null").where((F.trim(F.regexp_replace("inline", " ", " ")) != "") | is_rule)
    kind = F.when(is_rule, F.lit("rule")).when(F.col("heading").isNotNull(), F.lit("heading")).when(F.col("coded") | F.coalesce(F.col("all_code"), F.lit(False)), F.lit("code")).when(F.col("quoted"), F.lit("quote")).otherwise(F.lit("text"))
    body = body.withColumn("kind", kind).join(nums, ["doc_id", "num_id", "ilvl"], "left").withColumn("listed", F.col("abstract_id").isNotNull() & (F.col("kind") == "text"))
    items = list_items(body.where("listed"))
    body = staged(body.join(items, PARA, "left").withColumn("list_id", F.when(F.col("listed"), F.concat("abstract_id", F.lit("/"), F.coalesce(F.col("restarted"), F.lit(0)).cast("string")))), "body")
    body = body.join(continuations(body, cells), PARA, "left")
    line = F.trim(escape.lines(strings.hard_breaks(F.col("inline"), "backslash")) if options.hard_break == "backslash" else escape.lines(strings.hard_breaks(F.col("inline"), "spaces")))
    text = (
        F.when(F.col("kind") == "rule", F.lit("---"))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "), F.trim(F.replace(F.col("inline"), F.lit("\n"), F.lit(" ")))))
        .when(F.col("kind") == "code", F.coalesce("plain", F.lit("")))
        .when(F.col("inner").isNotNull(), F.concat(F.repeat(F.lit(" "), F.col("inner")), strings.indent_lines(line, F.col("inner"))))
        .when(F.col("listed") & (F.col("num_fmt") != "none"), F.concat(F.repeat(F.lit(" "), F.col("indent")), "marker", strings.indent_lines(line, F.col("indent") + F.col("width"))))
        .otherwise(line)
    )
    body = body.select("doc_id", "part", "p", "note", "kind", text.alias("md"), F.when(F.col("inner").isNotNull(), F.col("home_list")).when(F.col("num_fmt") != "none", F.col("list_id")).alias("list_id"), F.col("inner").isNotNull().alias("inner"))
    blocks = body.unionByName(cells.select("doc_id", "part", "p", "note", F.lit("table").alias("kind"), "md", F.lit(None).cast("string").alias("list_id"), F.lit(False).alias("inner")))
    blocks = staged(blocks, "blocks")
    return finish(blocks, story, numbers, content, parts, every, mains, files_out, files)


def list_items(listed: DataFrame) -> DataFrame:
    """Numbers, markers and indents of list paragraphs: PARA, marker, width, indent, restarted."""
    order = ["p"]
    once = lists.first_use(listed, ["doc_id", "part", "num_id", "ilvl"], order, "start_override")
    counted = lists.counters(once, ["doc_id", "part", "abstract_id"], order, restart="lvl_restart", override="start_override")
    restarted = F.sum(F.when(F.col("start_override").isNotNull() & (F.col("ilvl") == 0), 1).otherwise(0)).over(W.Window.partitionBy("doc_id", "part", "abstract_id").orderBy("p").rowsBetween(W.Window.unboundedPreceding, 0))
    marked = lists.markers(counted).withColumn("restarted", restarted)
    return lists.indents(marked, ["doc_id", "part", "abstract_id"], order).select(*PARA, "marker", "width", "indent", "restarted")


def continuations(body: DataFrame, cells: DataFrame) -> DataFrame:
    """Paragraphs that go on with the list item before them: PARA, inner (blanks before them), home_list.

    Such a paragraph has no number but the item's indentation, or belongs to a level without
    numbers, and nothing but others like it stands between.
    """
    none = F.col("listed") & (F.col("num_fmt") == "none")
    item = F.col("listed") & ~none
    left = F.when(F.col("listed"), F.coalesce("ind_left", "lvl_left")).otherwise(F.col("ind_left"))
    rows = body.select(*PARA, "note", item.alias("item"), none.alias("none"), ((F.col("kind") == "text") & F.col("num_id").isNull()).alias("plainly"), left.alias("left"), (F.col("indent") + F.col("width")).alias("offset"), "list_id")
    rows = rows.unionByName(cells.select(*PARA, "note", F.lit(False).alias("item"), F.lit(False).alias("none"), F.lit(False).alias("plainly")), allowMissingColumns=True)
    so_far = W.Window.partitionBy("doc_id", "part", "note").orderBy("p").rowsBetween(W.Window.unboundedPreceding, 0)
    home = F.last(F.when(F.col("item"), F.struct("left", "offset", "list_id")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("home", home)
    fits = ~F.col("item") & F.col("home").isNotNull() & (F.col("none") | F.col("plainly") & F.coalesce((F.col("left") > 0) & (F.col("left") == F.col("home.left")), F.lit(False)))
    rows = rows.withColumn("fits", fits)
    rows = rows.withColumn("breaks", F.sum(F.when(F.col("item") | F.col("fits"), 0).otherwise(1)).over(so_far))
    since = F.last(F.when(F.col("item"), F.col("breaks")), ignorenulls=True).over(so_far)
    return rows.withColumn("since", since).where("fits and breaks = since").select(*PARA, F.col("home.offset").alias("inner"), F.col("home.list_id").alias("home_list"))


def table_blocks(content: DataFrame, paras: DataFrame, header_row: str = "first", form: str = "gfm") -> DataFrame:
    """One Markdown block per outermost table: ``doc_id, part, p`` (the table's place), ``note``, ``md``.

    Text of nested tables, however deep, stands in the outer cell.  With
    ``header_row`` "empty" a blank header comes before all rows, with "look" where
    the table's look has no first row and no row is flagged.  Tables that hold
    others become HTML, with ``form`` "html-on-merge" those with merged cells too,
    with "flat" none.
    """
    w = F.col("ns") == "w"
    tables_ = content.where(w & (F.col("name") == "tbl")).select("doc_id", "part", F.col("seq").alias("tbl"), near("tbl").alias("outer"), near("tc").alias("outer_tc"), F.coalesce(near("footnote"), near("endnote")).alias("note"))
    homes = paras.where("tbl is not null").select("doc_id", "part", "p", "tbl", "tc", "inline", "plain", "jc")
    # Every inner table's outermost one, and the cell of it that it stands in: each round doubles the levels that are climbed.
    up = staged(tables_.where("outer is not null").select("doc_id", "part", "tbl", "outer", "outer_tc"), "nested")
    while True:
        above = up.select("doc_id", "part", F.col("tbl").alias("outer"), F.col("outer").alias("far"), F.col("outer_tc").alias("far_tc"))
        climbed = up.join(above, ["doc_id", "part", "outer"], "left")
        if climbed.where("far is not null").isEmpty():
            break
        up = staged(climbed.select("doc_id", "part", "tbl", F.coalesce("far", "outer").alias("outer"), F.coalesce("far_tc", "outer_tc").alias("outer_tc")), "nested")
    homes = homes.join(up, ["doc_id", "part", "tbl"], "left").select("doc_id", "part", "p", F.coalesce("outer", "tbl").alias("tbl"), F.when(F.col("outer").isNotNull(), F.col("outer_tc")).otherwise(F.col("tc")).alias("tc"), "inline", "plain", "jc")
    top = tables_.where("outer is null")
    grid = content.where(w & (F.col("name") == "gridCol")).groupBy("doc_id", "part", near("tbl").alias("tbl")).agg(F.count("*").cast("int").alias("n_grid"))
    cell = content.where(w & (F.col("name") == "tc")).select("doc_id", "part", F.col("seq").alias("tc"), near("tr").alias("tr"), near("tbl").alias("tbl")).join(top.select("doc_id", "part", "tbl", "note"), ["doc_id", "part", "tbl"])
    props = content.where(w & near("tcPr").isNotNull() & (F.col("parent") == near("tcPr"))).groupBy("doc_id", "part", near("tc").alias("tc")).agg(F.max(F.when(F.col("name") == "gridSpan", attr("w:val").cast("int"))).alias("span"), F.max(F.when(F.col("name") == "vMerge", F.coalesce(attr("w:val"), F.lit("continue")))).alias("v_merge"))
    cell = cell.join(props, ["doc_id", "part", "tc"], "left").withColumn("span", F.coalesce("span", F.lit(1)))
    row_no = F.dense_rank().over(W.Window.partitionBy("doc_id", "part", "tbl").orderBy("tr"))
    cell = tables.grid_positions(cell.withColumn("row", row_no), ["doc_id", "part", "tbl", "row"], ["tc"])
    texts = homes.where(F.trim("inline") != "").groupBy("doc_id", "part", "tc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.trim("inline").alias("t")))), lambda x: x["t"]), "\n").alias("joined"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.trim(F.coalesce("plain", F.lit(""))).alias("t")))), lambda x: x["t"]), "\n").alias("bare"))
    jc = homes.groupBy("doc_id", "part", "tc").agg(F.min_by("jc", "p").alias("jc"))
    keys = ["doc_id", "part", "tbl"]
    cell = cell.join(texts, ["doc_id", "part", "tc"], "left").join(jc, ["doc_id", "part", "tc"], "left").join(grid, keys, "left")
    widths = cell.groupBy(*keys).agg(F.greatest(F.max("n_grid"), F.max(F.col("grid_col") + F.col("span") - 1)).alias("n_cols"))
    body = F.when(F.coalesce(F.col("v_merge"), F.lit("restart")) == "restart", escape.table_cell(F.coalesce("joined", F.lit("")))).otherwise(F.lit(""))
    padded = tables.pad_grid(cell.select(*keys, "row", "grid_col", body.alias("text")).join(widths, keys), keys)
    flagged = content.where(w & (F.col("name") == "tblHeader")).select("doc_id", "part", near("tr").alias("tr")).distinct().withColumn("is_header", F.lit(True))
    rows = cell.select(*keys, "tr", "row").distinct().join(flagged, ["doc_id", "part", "tr"], "left")
    headers = tables.header_rows(rows, keys).where("header")
    if header_row != "first":
        bare = padded.select(*keys).distinct() if header_row == "empty" else tables.unlooked(content, rows, keys)
        blank = padded.join(bare, keys, "left_semi").select(*keys, F.lit(0).alias("row"), "grid_col", F.lit("").alias("text")).distinct()
        padded = padded.select(*keys, "row", "grid_col", "text").unionByName(blank)
        headers = headers.join(bare, keys, "left_anti").select(*keys, "row").unionByName(blank.select(*keys, "row").distinct())
    first_jc = cell.where("row = 1").select(*keys, "grid_col", "jc")
    aligns = padded.select(*keys, "grid_col").distinct().join(first_jc, [*keys, "grid_col"], "left")
    made = tables.pipe_tables(padded, keys, headers, aligns)
    if form != "flat":
        merged = up.select("doc_id", "part", F.col("outer").alias("tbl"))
        if form == "html-on-merge":
            merged = merged.unionByName(cell.where((F.col("span") > 1) | F.col("v_merge").isNotNull()).select(*keys))
        merged = merged.distinct()
        rich = tables.html_tables(cell.join(merged, keys, "left_semi").withColumns({"restart": F.coalesce(F.col("v_merge"), F.lit("restart")) == "restart", "html": F.replace(escape.html(F.coalesce("bare", F.lit(""))), F.lit("\n"), F.lit("<br>"))}), keys)
        made = made.join(rich.withColumnRenamed("markdown", "_html"), keys, "left").select(*keys, F.coalesce("_html", "markdown").alias("markdown"))
    return made.join(top.select(*keys, "note"), keys).select("doc_id", "part", F.col("tbl").alias("p"), "note", F.col("markdown").alias("md"))


def finish(blocks: DataFrame, story: DataFrame, numbers: DataFrame, content: DataFrame, parts: DataFrame, every: DataFrame, mains: DataFrame, files_out: DataFrame, files: DataFrame) -> Converted:
    """Group code and quotes, part lists, append notes, and give every input its status."""
    blocks = blocks.join(story, ["doc_id", "part"])
    flow = ["doc_id", "part", "note"]
    grouped = runs.islands(blocks.withColumn("group", F.when(F.col("kind").isin("code", "quote"), F.col("kind")).otherwise(F.col("p").cast("string"))), flow, ["p"], ["group"])
    first = lambda c: F.min_by(c, F.col("p")).alias(c)
    parts_of = F.transform(F.array_sort(F.collect_list(F.struct("p", "md"))), lambda x: x["md"])
    merged = grouped.groupBy(*flow, "story", "island").agg(F.min("p").alias("p"), first("kind"), first("list_id"), first("inner"), parts_of.alias("all"))
    merged = merged.withColumn("md", F.when(F.col("kind") == "code", escape.fence(F.array_join("all", "\n"))).when(F.col("kind") == "quote", strings.quote_lines(F.array_join("all", "\n\n"))).otherwise(F.element_at("all", 1)))
    w = W.Window.partitionBy(*flow).orderBy("p")
    parted = lists.separators(merged, flow, ["p"])
    same = F.col("list_id").eqNullSafe(F.lag("list_id").over(w)) & F.col("list_id").isNotNull()
    glue = F.when(F.row_number().over(w) == 1, F.lit("")).when(same & ~F.col("inner"), F.lit("\n")).when(F.col("separate"), F.lit("\n\n<!-- -->\n\n")).otherwise(F.lit("\n\n"))
    glued = parted.withColumn("md", F.concat(glue, "md"))
    flows = structure.assemble(glued, [*flow, "story"], ["p"], separator="", name="text")
    body = flows.where("story = 'body'").select("doc_id", F.lit(0).alias("no"), F.col("text").alias("md"))
    ids = content.where(F.col("name").isin("footnote", "endnote") & (F.col("ns") == "w")).select("doc_id", "part", F.col("seq").alias("note"), attr("w:id").alias("note_id"))
    notes = flows.where("story <> 'body'").join(ids, ["doc_id", "part", "note"]).withColumnRenamed("story", "note_story").join(numbers, ["doc_id", "note_story", "note_id"])
    notes = notes.select("doc_id", F.col("note_no").alias("no"), F.concat(F.lit("[^"), F.col("note_no").cast("string"), F.lit("]: "), strings.indent_lines(F.col("text"), F.lit(4))).alias("md"))
    made = structure.assemble(body.unionByName(notes), ["doc_id"], ["no"]).withColumn("markdown", F.concat("markdown", F.lit("\n")))
    refused = parts.where("status <> 0").groupBy("doc_id").agg(F.max("status").alias("bad"), F.max("error").alias("why"))
    broken = every.where("error is not null").join(mains, (every["doc_id"] == mains["doc_id"]) & (every["part"] == mains["main_part"])).select(mains["doc_id"], F.col("error").alias("xml_error")).dropDuplicates(["doc_id"])
    found = files.select(F.col("path").alias("doc_id")).join(refused, "doc_id", "left").join(mains, "doc_id", "left").join(broken, "doc_id", "left").join(made, "doc_id", "left")
    status = F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("main_part").isNull(), docx.STATUS["not_a_package"]).when(F.col("xml_error").isNotNull(), docx.STATUS["not_a_package"]).otherwise(0)
    message = F.coalesce("why", F.when(F.col("main_part").isNull(), F.lit("no main document part")), "xml_error")
    documents = found.select("doc_id", status.cast("int").alias("status"), F.when(status == 0, F.coalesce("markdown", F.lit(""))).alias("markdown"), message.alias("message"))
    whole = F.coalesce("content", F.udf(docx.unpacked, "binary")("packed"))
    media = files_out.join(parts.select("doc_id", F.col("part_key").alias("target_part"), whole.alias("content")), ["doc_id", "target_part"], "left").select("doc_id", "target_part", "folder", "out_name", "content")
    errors = documents.where("status <> 0").select("doc_id", F.lit("error").alias("level"), F.col("status").alias("code"), "message")
    parse = every.where("error is not null").select("doc_id", F.lit("warning").alias("level"), F.lit(0).alias("code"), F.concat("part", F.lit(": "), "error").alias("message"))
    vector = media.where(F.col("out_name").rlike(r"\.(emf|wmf)$")).select("doc_id", F.lit("warning").alias("level"), F.lit(0).alias("code"), F.concat("out_name", F.lit(": few viewers show this format")).alias("message"))
    lost = media.where("content is null").select("doc_id", F.lit("warning").alias("level"), F.lit(0).alias("code"), F.concat("target_part", F.lit(": missing from the package")).alias("message"))
    drawn = content.where((F.col("ns") == "a") & (F.col("name") == "graphicData") & F.coalesce(attr("uri").rlike("/(chart|diagram)$"), F.lit(False))).select("doc_id", F.lit("warning").alias("level"), F.lit(0).alias("code"), F.concat("part", F.lit(": a "), F.regexp_extract(attr("uri"), "([a-z]+)$", 1), F.lit(" has no picture and is left out")).alias("message"))
    return Converted(documents, media.where("content is not null"), errors.unionByName(parse).unionByName(vector).unionByName(lost).unionByName(drawn))
