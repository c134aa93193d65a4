"""Markdown escaping by context, as column expressions.

Code boundaries are decided before any of these is applied, and line-start
rules run on assembled lines, never on single spans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inline(text: Column) -> Column:
    """``* _ ` [ ] \\``, doubled tildes, ``<`` that could open a tag, ``!`` before ``[``, entities."""
    out = F.regexp_replace(text, r"([\\*_`\[\]])", r"\\$1")
    out = F.regexp_replace(out, "~~", r"\\~\\~")
    out = F.regexp_replace(out, r"<([A-Za-z/!?])", r"\\<$1")
    out = F.regexp_replace(out, r"!\\\[", r"\\!\\[")
    return entity(out)


def entity(text: Column) -> Column:
    """``&`` only where an entity follows."""
    return F.regexp_replace(text, r"&([a-zA-Z0-9]+;|#[0-9]+;|#[xX][0-9a-fA-F]+;)", "&amp;$1")


def line_start(line: Column) -> Column:
    """The first character of a line that would otherwise begin a block."""
    out = F.regexp_replace(line, r"^(\s*)(#{1,6})(\s|$)", r"$1\\$2$3")
    out = F.regexp_replace(out, r"^(\s*)>", r"$1\\>")
    out = F.regexp_replace(out, r"^(\s*)([-+])(\s|$)", r"$1\\$2$3")
    out = F.regexp_replace(out, r"^(\s*)([0-9]{1,9})([.)])(\s|$)", r"$1$2\\$3$4")
    # A whole line of one rule or underline character; stars and underscores are escaped inline already.
    return F.regexp_replace(out, r"^(\s*)(=+\s*|-[-\s]*-\s*)$", r"$1\\$2")


def lines(text: Column) -> Column:
    """:func:`line_start` on every physical line, so that hard breaks cannot be ambushed."""
    return F.array_join(F.transform(F.split(text, "\n", -1), line_start), "\n")


def table_cell(text: Column) -> Column:
    """Pipes escaped everywhere (code included), line ends as ``<br>``."""
    return F.replace(F.replace(text, F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit("<br>"))


#: Code points that would end or break a link destination: controls, blanks, parentheses and angle brackets.
ENCODED = [*range(1, 33), 40, 41, 60, 62, 127]


def destination(url: Column | str) -> Column:
    """Percent-encoding of what would end a link destination; never a backslash."""
    url = F.col(url) if isinstance(url, str) else url
    out = url
    for code in ENCODED:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike("[\\x01-\\x20()<>\\x7F]"), out).otherwise(url)


def alt_text(text: Column) -> Column:
    """Image alt text: one line, inline-escaped."""
    return inline(F.regexp_replace(text, r"[\r\n]+", " "))


def html(text: Column) -> Column:
    """Text inside raw HTML."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def longest_backticks(text: Column) -> Column:
    """Length of the longest run of backticks."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))


def code_span(text: Column) -> Column:
    """An inline code span: a delimiter longer than any run inside, a blank on each side where a backtick is at an edge."""
    ticks = F.repeat(F.lit("`"), longest_backticks(text) + 1)
    pad = F.when(F.startswith(text, F.lit("`")) | F.endswith(text, F.lit("`")), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(ticks, pad, text, pad, ticks)


def fence(text: Column) -> Column:
    """A fenced block, its fence longer than any backtick run inside and at least three."""
    ticks = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backticks(text) + 1))
    return F.concat(ticks, F.lit("\n"), text, F.lit("\n"), ticks)


CONTEXTS = {
    "inline": inline,
    "lineStart": lines,
    "tableCell": lambda c: table_cell(inline(c)),
    "linkText": inline,
    "linkDest": destination,
    "altText": alt_text,
    "codeSpan": code_span,
    "codeBlock": fence,
    "html": html,
}


def escape(text: Column, context: str) -> Column:
    """Text made safe for one of the nine output contexts."""
    return CONTEXTS[context](text)
