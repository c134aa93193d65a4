"""Outputs: Markdown and media files, diagnostics, the run's exit code."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from vellumflow.operators import structure


def stem(path: str) -> str:
    """File name without folders and extension."""
    return posixpath.splitext(posixpath.basename(path.replace("\\", "/")))[0] or "document"


def names_of(paths: list[str], together: bool) -> dict[str, str]:
    """Each input's name: its stem, with ``-1``, ``-2`` ... where inputs that share a folder (or go to one, ``together``) share it."""
    taken: set[tuple[str, str]] = set()
    out: dict[str, str] = {}
    for p in dict.fromkeys(paths):
        folder, name, n = "" if together else posixpath.dirname(p), stem(p), 0
        while (folder, (found := f"{name}-{n}" if n else name).lower()) in taken:
            n += 1
        taken.add((folder, found.lower()))
        out[p] = found
    return out


def _local(path: str) -> str:
    return path.removeprefix("file:")


def write_files(rows: DataFrame, path: str, content: str) -> None:
    """Write each row's bytes or text to its path, on the executor that holds it; the folder must be shared."""

    def write(part: Iterable[Row]) -> None:
        import os

        for r in part:
            at, data = _local(r[path]), r[content]
            os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
            draft = f"{at}.part"
            with open(draft, "wb") as f:  # bytes as they are: line ends stay LF, no byte-order mark
                f.write(data.encode("utf-8") if isinstance(data, str) else bytes(data))
            os.replace(draft, at)

    rows.select(path, content).foreachPartition(write)


def write_markdown(documents: DataFrame, output: str | None, several: bool, names: dict[str, str], crlf: bool = False, bom: bool = False) -> DataFrame:
    """Write converted documents; ``output`` is the file for one input and the folder for several, without it they go beside their inputs.

    Returns doc_id and out_path.
    """
    text = F.replace(F.col("markdown"), F.lit("\n"), F.lit("\r\n")) if crlf else F.col("markdown")
    text = F.concat(F.lit("\ufeff"), text) if bom else text
    named = documents.where("status = 0").join(F.broadcast(documents.sparkSession.createDataFrame(list(names.items()), "doc_id string, name string")), "doc_id")  # one row for each argument
    folder = F.regexp_replace("doc_id", r"[^/]*$", "") if output is None else F.lit(output.rstrip("/") + "/")
    at = F.concat(folder, "name", F.lit(".md")) if several or output is None else F.lit(output)
    ready = named.select("doc_id", at.alias("out_path"), text.alias("content"))
    write_files(ready, "out_path", "content")
    return ready.select("doc_id", "out_path")


def write_media(media: DataFrame, base: str | None) -> None:
    """Write media under generated names only, in their documents' folders under ``base`` or beside the inputs."""
    under = F.regexp_replace("doc_id", r"[^/]*$", "") if base is None else F.lit(f"{base.rstrip('/')}/" if base else "")
    folder = F.when(F.startswith("folder", F.lit("/")), F.col("folder")).otherwise(F.concat(under, "folder"))
    write_files(media.select(F.concat(folder, F.lit("/"), "out_name").alias("at"), "content"), "at", "content")


def exit_code(documents: DataFrame) -> int:
    """The run's verdict."""
    return int(structure.run_status(documents).first()["verdict"] or 0)
