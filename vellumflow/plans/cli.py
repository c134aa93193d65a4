"""Command line: options, validation, messages and exit codes."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellumflow.plans.convert import Options, convert_files
from vellumflow.sources import docx, sinks

VERSION = "0.1.0"
USAGE = """Usage: vellumflow [options] <input.docx> ...
  -o, --output <path>              the .md file for one input, the folder for several
  -j, --threads <n>                local worker threads (default: all cores)
  --media-dir <dir>                image folder (default <stem>_media); of several inputs, each has its own inside
  --no-images                      alternative text only
  --hard-break=<backslash|spaces>  line breaks (default backslash)
  --underline=<drop|u>             underlined text (default drop)
  --highlight=<drop|mark>          highlighted text (default drop)
  --tables=<gfm|html-on-merge|flat>  tables that pipes cannot show (default gfm: HTML if they hold tables)
  --header-row=<first|empty|look>  table headers (default first; look: blank where the table's look has no first row)
  --toc=<skip|keep>                tables of contents (default skip)
  --comments=<drop|html>           comments (default drop)
  --ruby=<base|paren>              ruby text: left out, or in brackets after its base (default base)
  --no-break=<keep|entity>         no-break spaces (default keep)
  --ascii-punct                    quotes, dashes and ellipses in ASCII
  --autolink                       <url> where the text is the target
  --image-size                     pictures with their width, as HTML
  --crlf, --bom                    Windows line ends, byte-order mark
  --stdout                         Markdown to standard output, one input only
  -q, --quiet                      errors only
  --version                        print the version
  -h, --help                       print this text
"""


@dataclass
class CommandLine:
    inputs: list[str] = field(default_factory=list)
    output: str | None = None
    media_dir: str | None = None
    threads: int = 0
    stdout: bool = False
    quiet: bool = False
    images: bool = True
    crlf: bool = False
    bom: bool = False
    policies: dict[str, str | bool] = field(default_factory=dict)
    show: str | None = None


#: Policies with their values, and such that are on or off; they are fields of ``Options``.
CHOICES = {"--hard-break": ("backslash", "spaces"), "--underline": ("drop", "u"), "--highlight": ("drop", "mark"), "--tables": ("gfm", "html-on-merge", "flat"), "--header-row": ("first", "empty", "look"), "--toc": ("skip", "keep"), "--comments": ("drop", "html"), "--ruby": ("base", "paren"), "--no-break": ("keep", "entity")}
SWITCHES = ("--ascii-punct", "--autolink", "--image-size")


class UsageError(ValueError):
    """A command line that cannot be run; the exit code is 1."""


def whole_number(text: str) -> int | None:
    """Digits only, up to 2^32-1."""
    if not text.isascii() or not text.isdigit():
        return None
    n = int(text)
    return n if n <= 0xFFFFFFFF else None


def parse(arguments: list[str], cores: int | None = None) -> CommandLine:
    """Options and operands in order; help and version win over what follows, an earlier mistake wins over them."""
    cores = cores or os.cpu_count() or 1
    found, rest = CommandLine(threads=cores), list(arguments)
    if not rest:
        raise UsageError("no input file given")

    def value(option: str, inline: str | None) -> str:
        if inline is None:
            if not rest:
                raise UsageError(f"option requires a value: {option}")
            inline = rest.pop(0)
        if not inline:
            raise UsageError(f"option value is empty: {option}")
        return inline

    flags = {"-q": "quiet", "--quiet": "quiet", "--stdout": "stdout", "--crlf": "crlf", "--bom": "bom"}
    while rest:
        a = rest.pop(0)
        name, eq, tail = a.partition("=")
        inline = tail if eq else None
        if a in ("-h", "--help", "--version"):
            return CommandLine(show="version" if a == "--version" else "help")
        if a in flags:
            setattr(found, flags[a], True)
        elif a == "--no-images":
            found.images = False
        elif a == "-o" or name == "--output":
            found.output = value(name if name == "--output" else a, inline if name == "--output" else None)
        elif name == "--media-dir":
            found.media_dir = value(name, inline)
        elif a == "-j" or name == "--threads":
            text = value(name if name == "--threads" else a, inline if name == "--threads" else None)
            n = whole_number(text)
            if not n:
                raise UsageError(f"--threads takes a whole number of at least 1, not {text}")
            if n > cores:
                raise UsageError(f"--threads must be 1 to {cores}, the number of cores here")
            found.threads = n
        elif a in SWITCHES:
            found.policies[a[2:].replace("-", "_")] = True
        elif name in CHOICES:
            text = value(name, inline)
            if text not in CHOICES[name]:
                raise UsageError(f"{name} takes {' or '.join(CHOICES[name])}, not {text}")
            found.policies[name[2:].replace("-", "_")] = text
        elif not a:
            raise UsageError("empty argument")
        elif a.startswith("-"):
            raise UsageError(f"unrecognised option: {a}")
        else:
            found.inputs.append(a)
    if not found.inputs:
        raise UsageError("no input file given")
    if found.stdout and len(found.inputs) > 1:
        raise UsageError("--stdout takes a single input file")
    if found.stdout and found.output is not None:
        raise UsageError("--stdout and --output cannot both be given")
    return found


def report(message: str) -> None:
    """One diagnostic line, after what was printed before."""
    sys.stdout.flush()
    print(f"vellumflow: {message}", file=sys.stderr)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    """Convert the given inputs; the exit code."""
    try:
        given = parse(arguments)
    except UsageError as e:
        report(str(e))
        print(USAGE, end="", file=sys.stderr)
        return docx.STATUS["usage"]
    if given.show:
        print(USAGE if given.show == "help" else f"vellumflow {VERSION}\n", end="")
        return docx.STATUS["ok"]
    spark = spark or SparkSession.builder.master(f"local[{given.threads}]").getOrCreate()
    good, missing = docx.find_inputs(spark, given.inputs)
    lost = missing.orderBy("ordinal").collect()  # one row for each argument
    for r in lost:
        report(f"{r['message']}: {r['doc_id']}")
    if lost:
        return docx.STATUS["unreadable"]
    several = len(good) > 1
    names = sinks.names_of(good, together=several and given.output is not None)
    media_dir = given.media_dir or "{name}_media"
    if given.media_dir and several:
        media_dir = f"{given.media_dir}/{{name}}"
    files = docx.read_files(spark, good).join(F.broadcast(spark.createDataFrame(list(names.items()), "path string, name string")), "path")
    made = convert_files(files, Options(images=given.images, media_dir=media_dir, **given.policies))
    for r in made.diagnostics.orderBy("doc_id").toLocalIterator():
        if r["level"] == "error" or not given.quiet:
            report(f"{r['doc_id']}: {r['message']}")
    try:
        if given.stdout:
            print(made.documents.first()["markdown"] or "", end="")
        else:
            sinks.write_markdown(made.documents, given.output, several, names, given.crlf, given.bom)
            if given.images:
                sinks.write_media(made.media, given.output if several else os.path.dirname(given.output) if given.output else None)
    except OSError as e:
        report(str(e))
        return docx.STATUS["output"]
    return sinks.exit_code(made.documents)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
