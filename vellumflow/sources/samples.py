"""Packages made from table rows: the inverse of the reader, for round trips and benches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.session import prepare, staged

_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SPACES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def paragraph_of(text: str) -> str:
    """A plain paragraph; line ends become breaks."""
    lines = [f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n")]
    return f"<w:p><w:r>{'<w:br/>'.join(lines)}</w:r></w:p>"


def _style(name: str, kind: str = "paragraph", based: str = "", props: str = "") -> str:
    on = f'<w:basedOn w:val="{based}"/>' if based else ""
    return f'<w:style w:type="{kind}" w:styleId="{name.replace(" ", "")}"><w:name w:val="{name}"/>{on}<w:rPr>{props}</w:rPr></w:style>'


def _fixed_parts() -> dict[str, str]:
    """Styles, a numbering definition with two instances, and the main part's relationships."""
    styles = [_style("Heading 1"), _style("Heading 2", based="Heading1"), _style("Quote"), _style("BoldPara", props="<w:b/>"), _style("Child", based="BoldPara"), _style("Strong", "character", props="<w:b/>"), _style("Hyperlink", "character", props="<w:u w:val='single'/>")]
    levels = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{f}"/></w:lvl>' for k, f in enumerate(("decimal", "bullet", "lowerRoman")))
    nums = "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="0"/></w:num>' for k in (1, 2))
    own = "".join(f'<Relationship Id="rId_{x}" Type="{_DOC}/{x}" Target="{x}.xml"/>' for x in ("styles", "numbering", "footnotes"))
    own += f'<Relationship Id="rIdL" Type="{_DOC}/hyperlink" Target="https://e.org/(x)" TargetMode="External"/>'
    return {
        "word/styles.xml": f"<w:styles {_SPACES}>{''.join(styles)}</w:styles>",
        "word/numbering.xml": f'<w:numbering {_SPACES}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum>{nums}</w:numbering>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{own}</Relationships>',
    }


def write_packages(rows: Iterable[tuple], fixed: dict[str, str], filled: list[tuple[str, str, str]]) -> Iterator[tuple[str, bytes]]:
    """A path and a package for each path of ``rows`` (path, part, XML), which are in this order.

    ``fixed`` parts are the same in all packages; ``filled`` ones (name, XML before and after) take the rows of their
    place in the list, compressed as they come, so that no part is held whole.
    """
    for path, of_path in groupby(rows, itemgetter(0)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in fixed.items():
                z.writestr(name, text)
            by_part = groupby(of_path, itemgetter(1))
            now = next(by_part, None)
            for k, (name, before, after) in enumerate(filled):
                with z.open(name, "w") as f:
                    f.write(before.encode())
                    while now and now[0] == k:
                        while some := list(islice(now[1], 256)):
                            f.write("".join(r[2] for r in some).encode())
                        now = next(by_part, None)
                    f.write(after.encode())
        yield path, out.getvalue()


def made_packages(rows: DataFrame, order: list[str], fixed: dict[str, str], filled: list[tuple[str, str, str]], plain: bool = False) -> DataFrame:
    """``path, content`` of rows (path, part, text and what else orders them); ``plain`` texts become paragraphs.  Staged, since it is read more than once."""
    prepare(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000))
        listed = (r for s in some for r in zip(*(s.column(c).to_pylist() for c in ("path", "part", "text")), strict=True))
        if plain:
            listed = ((path, part, paragraph_of(text)) for path, part, text in listed)
        made: list[tuple[str, bytes]] = []
        size = 0
        for path, content in write_packages(listed, fixed, filled):
            made.append((path, content))
            size += len(content)
            if len(made) >= 1000 or size >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.binary()))], ["path", "content"])
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.binary()))], ["path", "content"])

    sorted_rows = rows.repartition("path").sortWithinPartitions("path", "part", *order).select("path", "part", "text")
    return staged(sorted_rows.mapInArrow(run, "path string, content binary"), "files")


def packages_of(rows: DataFrame, key: str, order: str, xml: str, note: str) -> DataFrame:
    """``path, content``: one package per key with its rows' blocks and footnotes, both XML, in order, with styles, numbering and links to use."""
    types = _TYPES.replace("<Override", '<Default Extension="xml" ContentType="application/xml"/><Override', 1)
    filled = [(f"word/{name}.xml", f"<w:{tag} {_SPACES}>{inner}", f"{close}</w:{tag}>") for name, tag, inner, close in (("document", "document", "<w:body>", "</w:body>"), ("footnotes", "footnotes", "", ""))]
    both = F.array(*[F.struct(F.lit(k).alias("part"), F.coalesce(F.col(c), F.lit("")).alias("text")) for k, c in enumerate((xml, note))])
    texts = rows.select(F.col(key).cast("string").alias("path"), F.col(order).alias("_order"), F.inline(both)).where("part = 0 or text <> ''")
    return made_packages(texts, ["_order", "text"], {"[Content_Types].xml": types, "_rels/.rels": _RELS, **_fixed_parts()}, filled)


def packages(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``path, content``: one package per key with its rows as plain paragraphs in order."""
    texts = rows.select(F.col(key).cast("string").alias("path"), F.col(order).alias("_order"), F.lit(0).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return made_packages(texts, ["_order", "text"], {"[Content_Types].xml": _TYPES, "_rels/.rels": _RELS}, [("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>', "</w:body></w:document>")], plain=True)
