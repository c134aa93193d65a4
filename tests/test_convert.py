"""Packages converted end to end; the fixture groups that the specification names."""

import pytest
from packages import TYPES, W, archive, document, item, package, para, rels, run, style

from vellumflow.plans.convert import Options, convert_files
from vellumflow.sources import docx

STYLES = "".join([
    style("Normal", default=True), style("heading 1", id="Heading1", rpr="<w:b/>"), style("heading 9", id="berschrift9"), style("Quote"), style("HTML Preformatted", id="HTMLPreformatted"),
    style("BoldPara", rpr="<w:b/>"), style("Strong", "character", rpr="<w:b/>"), style("Child", based="BoldPara"), style("LoopA", based="LoopB", rpr="<w:i/>"), style("LoopB", based="LoopA"), style("Hyperlink", "character", rpr="<w:u w:val='single'/>"), style("Verbatim Char", "character", id="VerbatimChar"),
])
NUMBERS = """<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="2"><w:start w:val="1"/><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum>
<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num><w:num w:numId="4"><w:abstractNumId w:val="1"/></w:num>"""


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{para(run(text)) if text else para()}</w:tc>"


def table(*rows, columns=2):
    return f'<w:tbl><w:tblPr/><w:tblGrid>{"<w:gridCol/>" * columns}</w:tblGrid>{"".join(f"<w:tr>{chr(10).join(r)}</w:tr>" for r in rows)}</w:tbl>'


def deep(levels):
    """Tables in tables, a text in each."""
    inner = ""
    for k in reversed(range(levels)):
        inner = f"<w:tbl><w:tblGrid><w:gridCol/></w:tblGrid><w:tr><w:tc>{para(run(f't{k}'))}{inner}{para()}</w:tc></w:tr></w:tbl>"
    return inner


def mt(text):
    return f"<m:r><m:t>{text}</m:t></m:r>"


FIELD = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'
INSTR = "<w:r><w:instrText>{}</w:instrText></w:r>"
RUBY = "<w:r><w:ruby><w:rubyPr/><w:rt>" + run("ru") + run("by") + "</w:rt><w:rubyBase>" + run("base") + "</w:rubyBase></w:ruby></w:r>"
INDENTED = """<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="none"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num>"""
PNG = b"\x89PNG fake"
BLIP = '<w:drawing><wp:inline><wp:docPr id="1" name="Picture 1" descr="a [nice] view"/><a:graphic><a:graphicData uri="x/picture"><pic:pic><pic:blipFill><a:blip r:embed="rIdI"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing>'

CASES = {
    "split": (package(document(para(run("Hel", "<w:b/>"), "<w:proofErr/>", run("lo", "<w:b/>")))), "**Hello**\n"),
    "space": (package(document(para(run("bold ", "<w:b/>"), run("text")), para(run("x\u00a0", "<w:i/>"), run("y")))), "**bold** text\n\n*x*\u00a0y\n"),
    "toggle": (package(document(para(run("a", "<w:rStyle w:val='Strong'/>"), props="<w:pStyle w:val='BoldPara'/>"), para(run("b"), props="<w:pStyle w:val='Child'/>"), para(run("c", "<w:b w:val='0'/>"), props="<w:pStyle w:val='BoldPara'/>"), para(run("d"), props="<w:pStyle w:val='LoopA'/>")), STYLES), "a\n\n**b**\n\nc\n\n*d*\n"),
    "headings": (package(document(para(run("One"), props="<w:pStyle w:val='Heading1'/>"), para(run("Nine"), props="<w:pStyle w:val='berschrift9'/>"), para(run("Out"), props="<w:outlineLvl w:val='1'/>")), STYLES), "# One\n\n###### Nine\n\n## Out\n"),
    "lists": (package(document(item("a", 1), item("b", 2), item("deep", 1, 1), item("c", 1), item("five", 3), item("six", 3), item("dot", 4), item("dangling", 9)), numbering=NUMBERS), "1. a\n2. b\n   - deep\n3. c\n\n<!-- -->\n\n5. five\n6. six\n\n<!-- -->\n\n- dot\n\ndangling\n"),
    "table": (package(document(table([cell("a|b"), cell("c")], [cell("wide", "<w:gridSpan w:val='2'/>")], [cell("top", "<w:vMerge w:val='restart'/>"), cell("")], [cell("", "<w:vMerge/>"), cell("z")]))), "| a\\|b | c |\n| --- | --- |\n| wide |  |\n| top |  |\n|  | z |\n"),
    "fields": (package(document(para(FIELD.format("begin"), INSTR.format(' HYPERLINK "https://x.y/a b" '), FIELD.format("separate"), run("go"), FIELD.format("end")), para(FIELD.format("begin"), INSTR.format(" TOC \\o "), FIELD.format("separate"), run("stale"), FIELD.format("begin"), INSTR.format("PAGEREF x"), FIELD.format("separate"), run("7"), FIELD.format("end"), FIELD.format("end"), run("kept")), para('<w:fldSimple w:instr=" PAGE ">' + run("3") + "</w:fldSimple>"), para(FIELD.format("begin"), INSTR.format("DATE"), FIELD.format("separate"), run("today")))), "[go](https://x.y/a%20b)\n\nkept\n\n3\n\ntoday\n"),
    "links": (package(document(para('<w:bookmarkStart w:id="0" w:name="top"/>', run("My Head!"), props="<w:pStyle w:val='Heading1'/>"), para('<w:hyperlink r:id="rIdL">' + run("bold link", "<w:b/><w:rStyle w:val='Hyperlink'/>") + "</w:hyperlink>", run(" and "), '<w:hyperlink w:anchor="top">' + run("up") + "</w:hyperlink>", '<w:hyperlink w:anchor="none"></w:hyperlink>')), STYLES, links=[("rIdL", "hyperlink", "https://e.org/(x)", "External")]), "# My Head!\n\n[**bold link**](https://e.org/%28x%29) and [up](#my-head)\n"),
    "notes": (package(document(para(run("x"), '<w:r><w:footnoteReference w:id="7"/></w:r>', run(" y"), '<w:r><w:footnoteReference w:id="2"/></w:r>')), footnotes='<w:footnote w:id="-1" w:type="separator">' + para(run("sep")) + '</w:footnote><w:footnote w:id="2">' + para(run("two")) + '</w:footnote><w:footnote w:id="7">' + para("<w:r><w:footnoteRef/></w:r>", run("seven")) + para(run("more")) + "</w:footnote>"), "x[^1] y[^2]\n\n[^1]: seven\n\n    more\n\n[^2]: two\n"),
    "changes": (package(document(para(run("a"), '<w:ins w:id="1">' + run("b") + "</w:ins>", '<w:del w:id="2"><w:r><w:delText>gone</w:delText></w:r></w:del>', "<w:moveFrom>" + run("from") + "</w:moveFrom>", "<w:moveTo>" + run("to") + "</w:moveTo>"), para(run("joined "), props="<w:rPr><w:del w:id='3'/></w:rPr>"), para(run("here")))), "abto\n\njoined here\n"),
    "image": (package(document(para('<w:r><mc:AlternateContent><mc:Choice Requires="wps">' + BLIP + "</mc:Choice><mc:Fallback>" + BLIP + "</mc:Fallback></mc:AlternateContent></w:r>"), para(f"<w:r>{BLIP}</w:r>")), links=[("rIdI", "image", "media/pic.png")], extra={"word/media/pic.png": PNG}), "![a \\[nice\\] view](media/image1.png)\n\n![a \\[nice\\] view](media/image1.png)\n"),
    "code": (package(document(para(run("x = `1`"), props="<w:pStyle w:val='HTMLPreformatted'/>"), para(run("y *= 2"), props="<w:pStyle w:val='HTMLPreformatted'/>"), para(run("use "), run("a`b", "<w:rStyle w:val='VerbatimChar'/>"), run(" or "), run("mono", "<w:rFonts w:ascii='Consolas'/>"))), STYLES), "```\nx = `1`\ny *= 2\n```\n\nuse ``a`b`` or `mono`\n"),
    "quote": (package(document(para(run("one"), props="<w:pStyle w:val='Quote'/>"), para(run("two"), props="<w:pStyle w:val='Quote'/>")), STYLES), "> one\n>\n> two\n"),
    "escape": (package(document(para(run("1. not a list")), para(run("# x *y* _z_ [a] &amp;amp; &lt;T&gt;")), para(run("a"), "<w:r><w:br/></w:r>", run("--- b")), para(run("pre"), '<w:r><w:br w:type="page"/></w:r>', run("post\u00ad")), para(props="<w:pBdr><w:bottom w:val='single'/></w:pBdr>"))), "1\\. not a list\n\n\\# x \\*y\\* \\_z\\_ \\[a\\] &amp;amp; \\<T>\n\na\\\n--- b\n\nprepost\n\n---\n"),
    "hidden": (package(document(para(run("a"), run("secret", "<w:vanish/>"), run("b", "<w:caps/>"), run("2", "<w:vertAlign w:val='superscript'/>"), run("s", "<w:strike/>")), para(), para(run("  ")))), "aB<sup>2</sup>~~s~~\n"),
    "strict": (package(document(para(run("strict"), props=""), ns=W.replace("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main"))), "strict\n"),
    "wrapped": (package(document("<w:sdt><w:sdtPr/><w:sdtContent>" + para("<w:smartTag>" + run("in") + "</w:smartTag>") + '</w:sdtContent></w:sdt><w:sdt><w:sdtPr><w:docPartObj><w:docPartGallery w:val="Table of Contents"/></w:docPartObj></w:sdtPr><w:sdtContent>' + para(run("toc")) + "</w:sdtContent></w:sdt>", para(run("é"), '<w:r><w:sym w:font="Symbol" w:char="F0B7"/></w:r>'))), "in\n\né•\n"),
    "doctype": (package('<!DOCTYPE x [<!ENTITY e "boom">]>' + document(para(run("&e;")))), None),
    "legacy": (b"\xd0\xcf\x11\xe0 old file", None),
    "encrypted": (b"\xd0\xcf\x11\xe0" + "EncryptedPackage".encode("utf-16-le"), None),
    "nonsense": (b"just text", None),
    "no main": (archive({"[Content_Types].xml": TYPES, "_rels/.rels": rels()}), None),
    "twice": (archive([("[Content_Types].xml", TYPES), ("_rels/.rels", rels(("rId1", "officeDocument", "word/document.xml"))), ("word/document.xml", document(para(run("first")))), ("WORD/document.xml", document(para(run("second")))), ("../evil", "x")]), "first\n"),
    "theme": (package(document(para(run("mono", "<w:rFonts w:asciiTheme='minorHAnsi'/>"), run(" plain", "<w:rFonts w:asciiTheme='majorHAnsi'/>"))), links=[("rIdT", "theme", "theme/theme1.xml")], extra={"word/theme/theme1.xml": f'<a:theme {W}><a:majorFont><a:latin typeface="Arial"/></a:majorFont><a:minorFont><a:latin typeface="Menlo"/></a:minorFont></a:theme>'}), "`mono` plain\n"),
    "text box": (package(document(para(run("out"), "<w:r><w:pict><w:txbxContent>" + para(run("boxed")) + "</w:txbxContent></w:pict></w:r>"), para(run("after")))), "out\n\nboxed\n\nafter\n"),
    "math": (package(document(para(run("x="), "<m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f><m:sSup><m:e><m:r><m:t>c</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>"))), "x=a/bc^2\n"),
    "nested": (package(document("<w:tbl><w:tblGrid><w:gridCol/></w:tblGrid><w:tr><w:tc>" + para(run("outer")) + table([cell("in1"), cell("in2")]) + para() + "</w:tc></w:tr></w:tbl>")), "<table>\n<tr><th>outer<br>in1<br>in2</th></tr>\n</table>\n"),
    "deep": (package(document(deep(6))), "<table>\n<tr><th>" + "<br>".join(f"t{k}" for k in range(6)) + "</th></tr>\n</table>\n"),
    "style ids": (package(document(para(run("Eins"), props="<w:pStyle w:val='Heading1'/>"), para(run("Zwei"), props="<w:pStyle w:val='berschrift2'/>")), style("Titel der Ebene eins", id="Heading1") + style("Ebene zwei", id="berschrift2")), "# Eins\n\n## Zwei\n"),
    "long math": (package(document(para("<m:oMath><m:f><m:num>" + mt("a") + "</m:num><m:den>" + mt("b") + mt("+") + mt("c") + "</m:den></m:f>" + mt("=") + "<m:sSup><m:e>" + mt("x") + "</m:e><m:sup>" + mt("i") + mt("j") + "</m:sup></m:sSup></m:oMath>"))), "a/(b+c)=x^{ij}\n"),
    "drawn rule": (package(document(para(run("a")), para("<w:r><w:pict><v:rect o:hr='t'/></w:pict></w:r>"), para(run("b"))).replace("<w:document ", "<w:document xmlns:o='urn:schemas-microsoft-com:office:office' ")), "a\n\n---\n\nb\n"),
    "picture field": (package(document(para(FIELD.format("begin"), INSTR.format(' INCLUDEPICTURE "https://x.y/p.png" '), FIELD.format("separate"), run("stale"), FIELD.format("end"), run(" seen")))), "![](https://x.y/p.png) seen\n"),
    "ignorable": (package(document(para(run("a"), "<x:extra>" + run("gone") + "</x:extra>", "<y:extra>" + run("b") + "</y:extra>", "<x:kept>" + run("c") + "</x:kept>")).replace("<w:document ", "<w:document xmlns:x='urn:x' xmlns:y='urn:y' mc:Ignorable='w14 x' mc:ProcessContent='x:kept' ")), "abc\n"),
    "ruby": (package(document(para(run("see "), RUBY, run(" there")))), "see base there\n"),
    "continued": (package(document(item("a", 5), para(run("more"), props="<w:ind w:left='720'/>"), item("none", 5, 1), item("b", 5), para(run("other"), props="<w:ind w:left='360'/>"), para(run("apart"), props="<w:ind w:left='720'/>"), item("c", 5)), numbering=INDENTED), "1. a\n\n   more\n\n   none\n2. b\n\nother\n\napart\n\n3. c\n"),
    "empty": (package(document()), ""),
}


@pytest.fixture(scope="module")
def converted(spark):
    files = spark.createDataFrame([(k, bytearray(v[0])) for k, v in CASES.items()], "path string, content binary").repartition(2)
    made = convert_files(files)
    return {r["doc_id"]: r for r in made.documents.collect()}, made.media.collect(), made.diagnostics.collect()


@pytest.mark.parametrize("name", [k for k, v in CASES.items() if v[1] is not None])
def test_markdown(converted, name):
    got = converted[0][name]
    assert got["status"] == 0, got["message"]
    assert got["markdown"] == CASES[name][1]


def test_refused_inputs_are_rows(converted):
    docs, _, diagnostics = converted
    bad = {k for k, v in CASES.items() if v[1] is None}
    assert {k for k, r in docs.items() if r["status"] == docx.STATUS["not_a_package"]} == bad
    assert docs["encrypted"]["message"] == "encrypted document"
    assert "legacy" in docs["legacy"]["message"]
    assert bad <= {r["doc_id"] for r in diagnostics}


def test_media_once(converted):
    media = [r for r in converted[1] if r["doc_id"] == "image"]
    assert [(r["out_name"], bytes(r["content"])) for r in media] == [("image1.png", PNG)]


def test_caps():
    bomb = archive({"a.xml": b"0" * 3_000_000})
    small = docx.Caps(ratio=100, ratio_from=1 << 20)
    assert [r[5] for r in docx.inflate("x", bomb, small)] == [3]
    assert [r[6] for r in docx.inflate("x", bomb, docx.Caps(total_bytes=1000))] == ["inflated size is over the limit"]
    assert [r[6] for r in docx.inflate("x", bomb, docx.Caps(entries=0))] == ["too many entries"]


def test_utf16_part_and_depth():
    rows = docx.tokenise('<?xml version="1.0" encoding="UTF-16"?><a>é</a>'.encode("utf-16"), docx.Caps())
    assert rows[0][7] == "é"
    with pytest.raises(Exception, match="nest"):
        docx.tokenise(b"<a>" * 40 + b"</a>" * 40, docx.Caps(depth=20))


def test_options(spark):
    files = spark.createDataFrame([("o", bytearray(package(document(para(run("u", "<w:u w:val='single'/>"), run("h", "<w:highlight w:val='yellow'/>"), "<w:r><w:br/></w:r>", run("“q” – x…"))))))], "path string, content binary")
    got = convert_files(files, Options(underline="u", highlight="mark", hard_break="spaces", ascii_punct=True)).documents.first()["markdown"]
    assert got == '<u>u</u><mark>h</mark>  \n"q" -- x...\n'


def test_further_options(spark):
    remark = f'<w:comments {W}><w:comment w:id="3" w:author="Ann">' + para(run("why -- this")) + "</w:comment></w:comments>"
    merged = table([cell("wide", "<w:gridSpan w:val='2'/>")], [cell("top", "<w:vMerge w:val='restart'/>"), cell("x&amp;y")], [cell("", "<w:vMerge/>"), cell("z")])
    body = document(para(f"<w:r>{BLIP.replace('<wp:docPr', '<wp:extent cx=@952500@ cy=@1@/><wp:docPr'.replace('@', chr(34)))}</w:r>"), table([cell("a"), cell("b")]), para(run("said"), '<w:r><w:commentReference w:id="3"/></w:r>'), merged)
    files = spark.createDataFrame([("o", bytearray(package(body, links=[("rIdI", "image", "media/pic.png"), ("rIdC", "comments", "comments.xml")], extra={"word/media/pic.png": PNG, "word/comments.xml": remark})))], "path string, content binary")
    got = convert_files(files, Options(image_size=True, header_row="empty", comments="html", tables="html-on-merge")).documents.first()["markdown"]
    assert got == '<img src="media/image1.png" alt="a [nice] view" width="100">\n\n|  |  |\n| --- | --- |\n| a | b |\n\nsaid<!-- Ann: why - - this -->\n\n<table>\n<tr><th colspan="2">wide</th></tr>\n<tr><td rowspan="2">top</td><td>x&amp;y</td></tr>\n<tr><td>z</td></tr>\n</table>\n'


def test_flat_tables_and_no_break_spaces(spark):
    files = spark.createDataFrame([("o", bytearray(package(document(deep(3), para(run("a\u00a0b"))))))], "path string, content binary")
    got = convert_files(files, Options(tables="flat", no_break="entity")).documents.first()["markdown"]
    assert got == "| t0<br>t1<br>t2 |\n| --- |\n\na&nbsp;b\n"


def test_header_by_look(spark):
    looks = ["<w:tblLook w:firstRow='0'/>", "<w:tblLook w:val='04A0'/>", "<w:tblLook w:val='0480'/>", "", "<w:tblLook w:firstRow='0' w:val='0020'/>"]
    flag = "<w:trPr><w:tblHeader/></w:trPr>"
    bodies = [f"<w:tbl><w:tblPr>{look}</w:tblPr><w:tblGrid><w:gridCol/></w:tblGrid><w:tr>{flag if k == 4 else ''}{cell('a')}</w:tr><w:tr>{cell('b')}</w:tr></w:tbl>" for k, look in enumerate(looks)]
    files = spark.createDataFrame([(str(k), bytearray(package(document(b)))) for k, b in enumerate(bodies)], "path string, content binary")
    got = [r["markdown"] for r in convert_files(files, Options(header_row="look")).documents.orderBy("doc_id").collect()]
    first, blank = "| a |\n| --- |\n| b |\n", "|  |\n| --- |\n| a |\n| b |\n"
    assert got == [blank, first, blank, first, first]


def test_two_pictures_in_a_link(spark):
    link = '<w:hyperlink r:id="rIdL">' + f"<w:r>{BLIP}</w:r><w:r>{BLIP}</w:r>" + "</w:hyperlink>"
    files = spark.createDataFrame([("o", bytearray(package(document(para(link)), links=[("rIdI", "image", "media/pic.png"), ("rIdL", "hyperlink", "https://x.y/", "External")], extra={"word/media/pic.png": PNG})))], "path string, content binary")
    one = r"![a \[nice\] view](media/image1.png)"
    assert convert_files(files).documents.first()["markdown"] == f"[{one}{one}](https://x.y/)\n"


def test_ruby_in_brackets(spark):
    files = spark.createDataFrame([("o", bytearray(package(document(para(run("see "), RUBY, run(" there"))))))], "path string, content binary")
    assert convert_files(files, Options(ruby="paren")).documents.first()["markdown"] == "see base(ruby) there\n"
