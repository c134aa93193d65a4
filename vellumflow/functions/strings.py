"""String rules of the conversion: names, slugs, paths, whitespace, field instructions, option values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace for delimiter placement: ordinary white space and the no-break space.
SPACE = r"[\s\u00A0]"
#: Characters that join into emoji sequences.
EMOJI = "\u2600-\u27bf\ufe0f\\x{1F000}-\\x{1FAFF}"


def normal_name(name: Column) -> Column:
    """Style name key: lower case, ``_20_`` as a blank, blanks collapsed."""
    return F.trim(F.lower(F.regexp_replace(F.replace(name, F.lit("_20_"), F.lit(" ")), r"\s+", " ")))


def slug(text: Column) -> Column:
    """Heading anchor: lower case, no punctuation but ``-`` and ``_``, blanks as ``-``."""
    return F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M} _-]", ""), F.lit(" "), F.lit("-"))


def hoisted(text: Column) -> tuple[Column, Column, Column]:
    """Leading whitespace, core and trailing whitespace; a blank text is all leading."""
    lead = F.regexp_extract(text, f"^({SPACE}*)", 1)
    core = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    tail = F.when(core == "", F.lit("")).otherwise(F.regexp_extract(text, f"({SPACE}*)$", 1))
    return lead, core, tail


def visible(text: Column) -> Column:
    """Without soft hyphens and zero-width characters; joiners inside emoji sequences stay."""
    out = F.regexp_replace(text, "[\u00ad\u200b\u200c]", "")
    # An emoji with its joiner is kept whole; Java cannot look behind at characters outside the basic plane.
    return F.regexp_replace(out, f"([{EMOJI}]\u200d(?=[{EMOJI}]))|\u200d", "$1")


def ascii_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes and ellipses in ASCII."""
    out = F.translate(text, "\u2018\u2019\u201c\u201d", "''\"\"")
    for raw, plain in (("\u2013", "--"), ("\u2014", "--"), ("\u2026", "...")):
        out = F.replace(out, F.lit(raw), F.lit(plain))
    return out


def no_break_entity(text: Column) -> Column:
    return F.replace(text, F.lit("\u00a0"), F.lit("&nbsp;"))


def resolve_path(source_part: Column, target: Column) -> Column:
    """A relationship target as a part name: relative to the source's folder, ``/`` from the root, ``..`` folded inside the package."""
    folder = F.regexp_replace(source_part, "[^/]*$", "")
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def unsafe_path(name: Column) -> Column:
    """Names that must never become a path: parents, roots, backslashes, drives, streams."""
    return name.rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|\\|:")


def quote_lines(text: Column) -> Column:
    """``> `` before every line; a bare ``>`` before empty ones."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def indent_lines(text: Column, width: Column) -> Column:
    """Lines after the first, indented; empty ones stay empty."""
    parts = F.split(text, "\n", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when((i == 0) | (x == ""), x).otherwise(F.concat(F.repeat(F.lit(" "), width), x))), "\n")


def hard_breaks(text: Column, style: str = "backslash") -> Column:
    """Line ends inside a paragraph as hard breaks."""
    return F.replace(text, F.lit("\n"), F.lit("\\\n" if style == "backslash" else "  \n"))


def autolink(text: Column, url: Column) -> Column:
    """``<url>`` where the text is the target itself, else null."""
    return F.when((text == url) & url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*$"), F.concat(F.lit("<"), url, F.lit(">")))


def field_keyword(instruction: Column) -> Column:
    return F.upper(F.regexp_extract(instruction, r"^\s*(\S+)", 1))


def field_argument(instruction: Column) -> Column:
    """The first argument that is no switch, without quotes."""
    rest = F.regexp_replace(instruction, r"^\s*\S+\s*", "")
    return F.when(rest.rlike(r'^"'), F.regexp_extract(rest, r'^"([^"]*)"', 1)).when(rest.rlike(r"^\\"), F.lit("")).otherwise(F.regexp_extract(rest, r"^([^\s\\]*)", 1))


def field_switch(instruction: Column, letter: str) -> Column:
    """The argument of a switch (empty where it has none), null where the switch is missing."""
    found = instruction.rlike(rf"\\{letter}(\s|$|\")")
    return F.when(found, F.coalesce(F.nullif(F.regexp_extract(instruction, rf'\\{letter}\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(instruction, rf"\\{letter}\s+([^\s\\\"]+)", 1)))


def on_off(value: Column, present: Column) -> Column:
    """Three states: null where unspecified; true for no value, 1, true, on; false for anything else."""
    return F.when(present, F.coalesce(F.lower(value).isin("1", "true", "on"), F.lit(True)))


def parse_ui32(text: Column) -> Column:
    """A whole number of digits only, up to 2^32-1; else null."""
    n = F.expr("try_cast(NULL AS DECIMAL(20,0))") if text is None else text.try_cast("decimal(38,0)")
    return F.when(text.rlike("^[0-9]+$") & (F.length(F.regexp_replace(text, "^0+", "")) <= 10) & (n <= F.lit(4294967295)), n.cast("long"))


def match_value(argument: Column, name: Column) -> Column:
    """The value of ``--name=value``; empty for ``--name``; null where the argument is another option."""
    return F.when(argument == name, F.lit("")).when(F.startswith(argument, F.concat(name, F.lit("="))), F.substr(argument, F.length(name) + 2, F.length(argument)))
