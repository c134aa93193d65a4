"""Word-processing packages made of strings, for the tests."""

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
BASE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*items):
    """(id, type, target[, mode]) as a relationships part."""
    rows = "".join(f'<Relationship Id="{i[0]}" Type="{BASE}/{i[1]}" Target="{i[2]}"' + (f' TargetMode="{i[3]}"' if len(i) > 3 else "") + "/>" for i in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def run(text, props=""):
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def para(*inner, props=""):
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}{"".join(inner)}</w:p>'


def item(text, num, level=0):
    return para(run(text), props=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def document(*blocks, ns=W):
    return f'<w:document {ns}><w:body>{"".join(blocks)}<w:sectPr/></w:body></w:document>'


def package(body, styles=None, numbering=None, footnotes=None, links=(), extra=None):
    parts = {"[Content_Types].xml": TYPES, "_rels/.rels": rels(("rId1", "officeDocument", "word/document.xml")), "word/document.xml": body}
    own = list(links)
    for name, text, tag in (("styles", styles, "styles"), ("numbering", numbering, "numbering"), ("footnotes", footnotes, "footnotes")):
        if text is not None:
            parts[f"word/{name}.xml"] = f"<w:{tag} {W}>{text}</w:{tag}>"
            own.append((f"rId_{name}", name, f"{name}.xml"))
    parts["word/_rels/document.xml.rels"] = rels(*own)
    return archive(parts | (extra or {}))


def archive(parts, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in parts.items() if isinstance(parts, dict) else parts:
            z.writestr(name, text)
    return out.getvalue()


def style(name, kind="paragraph", id=None, based=None, rpr="", ppr="", default=False):
    return f'<w:style w:type="{kind}" w:styleId="{id or name.replace(" ", "")}"{" w:default=\'1\'" if default else ""}><w:name w:val="{name}"/>{f"<w:basedOn w:val=\'{based}\'/>" if based else ""}<w:pPr>{ppr}</w:pPr><w:rPr>{rpr}</w:rPr></w:style>'
