"""Word-processing packages as rows: files, parts, XML nodes.

Two small Python table functions do what columns cannot: inflate a ZIP within
limits, and tokenise XML with namespaces.  A bad file or part becomes a row with
a status and a message, never a failed job.  Neither holds a large XML part or
its nodes whole.
"""

from __future__ import annotations

import codecs
import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.session import prepare

PARTS = "doc_id string, part_name string, part_key string, entry_ordinal int, content binary, status int, error string, packed binary"
NODES = "doc_id string, part string, seq int, end_seq int, parent int, depth int, ns string, name string, attrs map<string,string>, text string, near map<string,int>, error string"

# Exit codes of a conversion, by document and for the whole run.
STATUS = {"ok": 0, "usage": 1, "unreadable": 2, "not_a_package": 3, "output": 4, "internal": 5, "partial": 6}

# Namespace URIs, the strict ones beside the transitional ones that they stand for.
NAMESPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
    "http://schemas.openxmlformats.org/package/2006/content-types": "ct",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://purl.oclc.org/ooxml/drawingml/main": "a",
    "http://schemas.openxmlformats.org/drawingml/2006/picture": "pic",
    "http://purl.oclc.org/ooxml/drawingml/picture": "pic",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp",
    "http://purl.oclc.org/ooxml/drawingml/wordprocessingDrawing": "wp",
    "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "http://purl.oclc.org/ooxml/officeDocument/math": "m",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "urn:schemas-microsoft-com:vml": "v",
    "urn:schemas-microsoft-com:office:office": "o",
    "http://schemas.microsoft.com/office/word/2010/wordprocessingShape": "wps",
}
XML = "http://www.w3.org/XML/1998/namespace"
COMPATIBILITY = "http://schemas.openxmlformats.org/markup-compatibility/2006"
# Extension prefixes whose content is understood.
UNDERSTOOD = ["wps", "wpg", "wpc", "wp14", "w14", "w15", "a14"]

#: Bytes up to which an XML part is held whole; a larger one is packed, and read in pieces of ``CHUNK`` bytes.
WHOLE = 1 << 20
CHUNK = 1 << 16
#: Rows, and bytes or characters, that a batch holds before it goes out.
BATCH_ROWS, BATCH_SIZE = 4096, 8 << 20


@dataclass(frozen=True)
class Caps:
    """Limits while inflating; sizes in headers are not trusted."""

    total_bytes: int = 512 << 20
    ratio: int = 1000
    ratio_from: int = 4 << 20
    entries: int = 10_000
    depth: int = 256


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, modificationTime, length, content`` of every input."""
    return spark.read.format("binaryFile").load(paths)


def find_inputs(spark: SparkSession, requested: list[str]) -> tuple[list[str], DataFrame]:
    """Inputs that can be read, in order, and a row for each that cannot; all are looked at before any verdict."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    good, bad = [], []
    for k, name in enumerate(requested):
        try:
            at = jvm.org.apache.hadoop.fs.Path(name)
            ok = at.getFileSystem(conf).getFileStatus(at).isFile()
        except Exception:
            ok = False
        (good if ok else bad).append((k, name))
    rows = spark.createDataFrame([(n, k, "error", STATUS["unreadable"], "cannot open input") for k, n in bad], "doc_id string, ordinal int, level string, code int, message string")
    return [n for _, n in good], rows


def inflate(doc_id: str, content: bytes, caps: Caps) -> Iterator[tuple]:
    """Rows of PARTS for one file: its entries in directory order, or one row with the reason why not.

    An XML part of more than ``WHOLE`` bytes is ``packed`` (a raw deflate stream) and has no content.
    """
    if content[:4] == b"\xd0\xcf\x11\xe0":
        encrypted = "EncryptedPackage".encode("utf-16-le") in content
        yield doc_id, None, None, None, None, STATUS["not_a_package"], "encrypted document" if encrypted else "legacy .doc is not supported", None
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        entries = archive.infolist()
        if len(entries) > caps.entries:
            raise ValueError("too many entries")
        left = caps.total_bytes
        for k, e in enumerate(entries):
            if e.is_dir():
                continue
            if e.flag_bits & 1:
                raise ValueError("encrypted entry")
            if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError("unsupported compression method")
            name = e.filename.replace("\\", "/").lstrip("/")
            xml = name.lower().endswith((".xml", ".rels"))
            size, kept, packer, packed = 0, bytearray(), None, bytearray()
            with archive.open(e) as f:
                while chunk := f.read(CHUNK):
                    size += len(chunk)
                    kept += chunk
                    if size > left:
                        raise ValueError("inflated size is over the limit")
                    if size > caps.ratio_from and size > caps.ratio * max(e.compress_size, 1):
                        raise ValueError("compression ratio is over the limit")
                    if xml and len(kept) > WHOLE:
                        packer = packer or zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
                        packed += packer.compress(kept)
                        kept.clear()
            left -= size
            if packer:
                packed += packer.compress(kept) + packer.flush()
            yield doc_id, name, name.lower(), k, None if packer else bytes(kept), STATUS["ok"], None, bytes(packed) if packer else None
    except (zipfile.BadZipFile, ValueError, EOFError, zlib.error, NotImplementedError, RuntimeError, OSError) as e:
        yield doc_id, None, None, None, None, STATUS["not_a_package"], str(e) or type(e).__name__, None


def pieces(content: bytes | None, packed: bytes | None) -> Iterator[bytes]:
    """A part's bytes, at most ``CHUNK`` at a time."""
    if packed is None:
        content = content or b""
        yield from (content[k : k + CHUNK] for k in range(0, len(content), CHUNK))
        return
    unpacker = zlib.decompressobj(-zlib.MAX_WBITS)
    for k in range(0, len(packed), CHUNK):
        rest = packed[k : k + CHUNK]
        while rest:
            if piece := unpacker.decompress(rest, CHUNK):
                yield piece
            rest = unpacker.unconsumed_tail
    while piece := unpacker.decompress(b"", CHUNK):
        yield piece


def unpacked(packed: bytes | None) -> bytes | None:
    """A packed part's bytes."""
    return None if packed is None else b"".join(pieces(None, packed))


def unzip_parts(files: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """PARTS of every file (``path``, ``content``); of entries that repeat a name the first in the directory counts."""
    prepare(files.sparkSession)
    kind = pa.schema([("doc_id", pa.string()), ("part_name", pa.string()), ("part_key", pa.string()), ("entry_ordinal", pa.int32()), ("content", pa.binary()), ("status", pa.int32()), ("error", pa.string()), ("packed", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for doc, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                seen: set[str] = set()
                for row in inflate(doc, content.as_py() or b"", caps):
                    if row[2] is None or row[2] not in seen:
                        seen.add(row[2])
                        rows.append(row)
                        size += len(row[4] or b"") + len(row[7] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_SIZE:
                        yield _batch(rows, kind)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, kind)

    return files.select("path", "content").mapInArrow(run, PARTS)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; maps are dictionaries."""

    def column(values: tuple, f: pa.Field) -> pa.Array:
        if not pa.types.is_map(f.type):
            return pa.array(values, f.type)
        ends = [0]
        for m in values:
            ends.append(ends[-1] + len(m))
        keys, items = [k for m in values for k in m], [v for m in values for v in m.values()]
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, f.type.key_type), pa.array(items, f.type.item_type))

    return pa.RecordBatch.from_arrays([column(values, f) for values, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


class _Refused(Exception):
    pass


@lru_cache(4096)
def _split(name: str) -> tuple[str, str]:
    """The prefix that stands for a name's namespace, and its local part."""
    uri, _, local = name.rpartition("\x01")
    return ("xml" if uri == XML else NAMESPACES.get(uri, uri)), local


@lru_cache(4096)
def _attribute(name: str) -> str:
    prefix, local = _split(name)
    return f"{prefix}:{local}" if prefix else name


def _refuse(*_: object) -> None:
    raise _Refused("document type declarations are refused")


def _as_utf8(raw: Iterable[bytes]) -> Iterator[bytes]:
    """XML in UTF-8 or UTF-16 as valid UTF-8, piece by piece."""
    decoder = None
    for piece in raw:
        if decoder is None:
            wide = piece[:2] in (b"\xff\xfe", b"\xfe\xff")
            decoder = codecs.getincrementaldecoder("utf-16" if wide else "utf-8")("replace")
            head = decoder.decode(piece).encode()
            yield head.replace(b'encoding="UTF-16"', b'encoding="UTF-8"', 1) if wide else head
        else:
            yield decoder.decode(piece).encode()
    if decoder is not None:
        yield decoder.decode(b"", True).encode()


def check(raw: Iterable[bytes], caps: Caps) -> None:
    """Raises what ``closed_nodes`` would for the same part, and keeps nothing."""
    parser = expat.ParserCreate(namespace_separator="\x01")
    depth = 0

    def start(*_: object) -> None:
        nonlocal depth
        if depth >= caps.depth:
            raise _Refused("elements nest too deeply")
        depth += 1

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, _refuse
    for piece in _as_utf8(raw):
        parser.Parse(piece, False)
    parser.Parse(b"", True)


def closed_nodes(raw: Iterable[bytes], caps: Caps) -> Iterator[tuple]:
    """Nodes of one XML part as they close: (seq, end_seq, parent, depth, ns, name, attrs, text, near).

    ``seq`` counts elements in document order; ``end_seq`` is the last seq
    inside; ``near`` holds, by local name, the closest enclosing elements.
    Document types are refused, so no entity can expand.  Elements of namespaces
    that an enclosing element declares ignorable, and that are not understood,
    are left out with all they hold, unless their content is to be processed.
    Only open elements and those of one piece of ``raw`` are held.
    """
    parser = expat.ParserCreate(namespace_separator="\x01")
    parser.buffer_text = True
    closed: list[tuple] = []
    stack: list[list] = []  # seq, parent, ns, name, attrs, texts, near, what is near for elements inside
    prefixes: dict[str, list[str]] = {}
    ignorable: list[set[tuple[str, str]]] = [set()]
    processed: list[set[tuple[str, str]]] = [set()]
    count = skipped = 0

    def declared(prefix: str | None, uri: str | None) -> None:
        prefixes.setdefault(prefix or "", []).append(uri or "")

    def undeclared(prefix: str | None) -> None:
        prefixes[prefix or ""].pop()

    def named(above: set[tuple[str, str]], attrs: dict[str, str], kind: str) -> set[tuple[str, str]]:
        """``above``, and namespaces, or elements of them, that an attribute of the compatibility namespace lists."""
        if not (listed := attrs.get(f"{COMPATIBILITY}\x01{kind}")):
            return above
        pairs = [x.rpartition(":")[::2] if kind == "ProcessContent" else (x, "*") for x in listed.split()]
        return above | {(prefixes[p][-1], local) for p, local in pairs if prefixes.get(p) and (kind == "ProcessContent" or p not in UNDERSTOOD and prefixes[p][-1] not in NAMESPACES)}

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal count, skipped
        if len(stack) + skipped >= caps.depth:
            raise _Refused("elements nest too deeply")
        if skipped:
            skipped += 1
            return
        ns, local = _split(name)
        ignored, kept = named(ignorable[-1], attrs, "Ignorable"), named(processed[-1], attrs, "ProcessContent")
        if (ns, "*") in ignored and not {(ns, local), (ns, "*")} & kept:
            skipped = 1
            return
        ignorable.append(ignored)
        processed.append(kept)
        near, parent = (stack[-1][7], stack[-1][0]) if stack else ({}, None)
        stack.append([count, parent, ns, local, {_attribute(k): v for k, v in attrs.items()}, [], near, {**near, local: count}])
        count += 1

    def end(_: str) -> None:
        nonlocal skipped
        if skipped:
            skipped -= 1
            return
        ignorable.pop()
        processed.pop()
        seq, parent, ns, local, attrs, texts, near, _inside = stack.pop()
        closed.append((seq, count - 1, parent, len(stack), ns, local, attrs, "".join(texts), near))

    def data(text: str) -> None:
        if stack and not skipped:
            stack[-1][5].append(text)

    parser.StartNamespaceDeclHandler, parser.EndNamespaceDeclHandler = declared, undeclared
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, data, _refuse
    for piece in _as_utf8(raw):
        parser.Parse(piece, False)
        yield from closed
        closed.clear()
    parser.Parse(b"", True)
    yield from closed


def tokenise(content: bytes, caps: Caps) -> list[tuple]:
    """All nodes of one XML part in document order, as ``closed_nodes`` gives them."""
    return sorted(closed_nodes(pieces(content, None), caps), key=lambda n: n[0])


def parse_xml(parts: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """NODES of the given parts, in no order; a part that cannot be parsed gives one row with its error.

    A packed part is checked before any of its nodes goes out, and then read once more.
    """
    prepare(parts.sparkSession)
    kind = pa.schema([("doc_id", pa.string()), ("part", pa.string()), ("seq", pa.int32()), ("end_seq", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("ns", pa.string()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("near", pa.map_(pa.string(), pa.int32())), ("error", pa.string())])

    def found(content: bytes | None, packed: bytes | None) -> Iterable[tuple]:
        try:
            if packed is None:
                return [(*n, None) for n in closed_nodes(pieces(content, None), caps)]
            check(pieces(None, packed), caps)
        except (expat.ExpatError, _Refused, UnicodeError) as e:
            return [(None, None, None, None, None, None, {}, None, {}, str(e))]
        return ((*n, None) for n in closed_nodes(pieces(None, packed), caps))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for doc, part, content, packed in zip(b.column("doc_id").to_pylist(), b.column("part_key").to_pylist(), b.column("content"), b.column("packed"), strict=True):
                for n in found(content.as_py(), packed.as_py()):
                    rows.append((doc, part, *n))
                    size += len(n[7] or "")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_SIZE:
                        yield _batch(rows, kind)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, kind)

    return parts.select("doc_id", "part_key", "content", "packed").mapInArrow(run, NODES)


def xml_parts(parts: DataFrame) -> DataFrame:
    """The parts that the conversion reads as XML; media stay as they are."""
    return parts.where((F.col("status") == 0) & F.col("part_key").rlike(r"\.(xml|rels)$"))
