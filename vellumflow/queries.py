"""Registered queries: each rule over the driver's tables, and the same in SQL.

The tables hold no packages, so each rule runs on rows that stand for its
input: customers' orders as lists, order lines as table cells, users' events as
runs.  The ``docx_`` queries make packages from table rows and convert them; the
``md_`` queries call the operators one by one, all of which the conversion or
the command line uses, but for ``md_pages_to_markdown``: web pages by a chain of
replacements, an extension with no part in the conversion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vellumflow.functions import escape, strings, vectors
from vellumflow.operators import lists, package, runs, structure, styles, tables
from vellumflow.plans import convert
from vellumflow.plans.convert import convert_files
from vellumflow.sources import samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL forms of the escaping rules (RE2 has no look-around) -----------------
def _sql_entity(x: str) -> str:
    return rf"regexp_replace({x}, '&([a-zA-Z0-9]+;|#[0-9]+;|#[xX][0-9a-fA-F]+;)', '&amp;\1', 'g')"


def _sql_inline(x: str) -> str:
    x = rf"regexp_replace({x}, '([\\*_`\[\]])', '\\\1', 'g')"
    x = rf"replace({x}, '~~', '\~\~')"
    x = rf"regexp_replace({x}, '<([A-Za-z/!?])', '\\<\1', 'g')"
    x = rf"replace({x}, '!\[', '\!\[')"
    return _sql_entity(x)


def _sql_line(x: str) -> str:
    for pattern, to in ((r"^(\s*)(#{1,6})(\s|$)", r"\1\\\2\3"), (r"^(\s*)>", r"\1\\>"), (r"^(\s*)([-+])(\s|$)", r"\1\\\2\3"), (r"^(\s*)([0-9]{1,9})([.)])(\s|$)", r"\1\2\\\3\4"), (r"^(\s*)(=+\s*|-[-\s]*-\s*)$", r"\1\\\2")):
        x = f"regexp_replace({x}, '{pattern}', '{to}')"
    return x


def _sql_dest(x: str) -> str:
    for code in escape.ENCODED:
        x = f"replace({x}, chr({code}), '%{code:02X}')"
    return x


# Texts hold almost nothing to escape, so each gets a start that does, by its id.
_STARTS = ["", "# ", "- ", "1. ", "> ", "*x* _y_ [z] `q` ", "a~~b <T> ![i] AT&T &amp; &#12; ", "===", "2) ", "+ c\\ ", "```code`` ", "--- "]


def salted(doc: DataFrame) -> DataFrame:
    start = F.element_at(F.array(*map(F.lit, _STARTS)), (F.col("doc_id") % len(_STARTS) + 1).cast("int"))
    return doc.select("doc_id", F.concat(start, F.col("text")).alias("t"))


_SALTED = "(SELECT doc_id, list_extract([" + ", ".join("'" + s.replace("'", "''") + "'" for s in _STARTS) + f"], CAST(doc_id % {len(_STARTS)} + 1 AS INTEGER)) || text AS t FROM documents)"


def text_query(name: str, column: Callable[[Column], Column], sql: Callable[[str], str], out: str = "md") -> None:
    query(name, f"SELECT doc_id, {sql('t')} AS {out} FROM {_SALTED}")(lambda spark, d: salted(read(spark, d, "documents")).select("doc_id", column(F.col("t")).alias(out)))


_LONGEST = "CAST(coalesce(list_max(list_transform(regexp_extract_all({x}, '`+'), lambda z: len(z))), 0) AS INTEGER)"
text_query("md_escape_inline", escape.inline, _sql_inline)
text_query("md_escape_line_start", escape.lines, lambda x: f"array_to_string(list_transform(string_split({x}, chr(10)), lambda y: {_sql_line('y')}), chr(10))")
text_query("md_escape_entity", escape.entity, _sql_entity)
text_query("md_escape_table_cell", lambda c: escape.table_cell(F.concat(c, F.lit(" | "), c)), lambda x: f"replace(replace({x} || ' | ' || {x}, '|', '\\|'), chr(10), '<br>')")
text_query("md_escape_destination", lambda c: escape.destination(F.concat(c, F.char(F.col("doc_id") % 31 + 1), F.char(F.lit(127)))), lambda x: _sql_dest(f"({x} || chr(CAST(doc_id % 31 + 1 AS INTEGER)) || chr(127))"))
text_query("md_escape_alt_text", escape.alt_text, lambda x: _sql_inline(f"regexp_replace({x}, '[\\r\\n]+', ' ', 'g')"))
text_query("md_escape_html", escape.html, lambda x: f"replace(replace({x}, '&', '&amp;'), '<', '&lt;')")
text_query("md_backtick_run", escape.longest_backticks, lambda x: _LONGEST.format(x=x), "longest")
text_query("md_code_span", escape.code_span, lambda x: f"repeat('`', {_LONGEST.format(x=x)} + 1) || CASE WHEN {x} LIKE '`%' OR {x} LIKE '%`' THEN ' ' ELSE '' END || {x} || CASE WHEN {x} LIKE '`%' OR {x} LIKE '%`' THEN ' ' ELSE '' END || repeat('`', {_LONGEST.format(x=x)} + 1)")
text_query("md_code_fence", escape.fence, lambda x: f"repeat('`', greatest(3, {_LONGEST.format(x=x)} + 1)) || chr(10) || {x} || chr(10) || repeat('`', greatest(3, {_LONGEST.format(x=x)} + 1))")
text_query("md_normal_name", strings.normal_name, lambda x: f"trim(lower(regexp_replace(replace({x}, '_20_', ' '), '\\s+', ' ', 'g')))", "name")
text_query("md_ascii_punctuation", lambda c: strings.ascii_punctuation(F.concat(F.lit("‘a’ “b” – — …"), c)), lambda x: f"replace(replace(replace(translate('‘a’ “b” – — …' || {x}, '‘’“”', '''''\"\"'), '–', '--'), '—', '--'), '…', '...')")
text_query("md_no_break_space", lambda c: strings.no_break_entity(F.replace(c, F.lit(" "), F.lit("\u00a0"))), lambda x: f"replace(replace({x}, ' ', chr(160)), chr(160), '&nbsp;')")
text_query("md_strip_invisible", lambda c: strings.visible(F.replace(c, F.lit("e"), F.lit("e\u00ad\u200b"))), lambda x: f"regexp_replace(replace({x}, 'e', 'e' || chr(173) || chr(8203)), '[' || chr(173) || chr(8203) || chr(8204) || ']', '', 'g')")


@query("md_whitespace_hoist", "SELECT doc_id, regexp_extract(t, '^([\\s\u00a0]*)', 1) AS lead, regexp_replace(t, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g') AS core, CASE WHEN regexp_replace(t, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g') = '' THEN '' ELSE regexp_extract(t, '([\\s\u00a0]*)$', 1) END AS tail FROM (SELECT doc_id, repeat(' ', CAST(doc_id % 3 AS INTEGER)) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END || repeat('\u00a0', CAST(doc_id % 2 AS INTEGER)) AS t FROM documents)")
def md_whitespace_hoist(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")), F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("text")), F.repeat(F.lit("\u00a0"), (F.col("doc_id") % 2).cast("int")))
    lead, core, tail = strings.hoisted(F.col("t"))
    return read(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", lead.alias("lead"), core.alias("core"), tail.alias("tail"))


@query("md_hard_break", "SELECT doc_id, replace(text, chr(10), '\\' || chr(10)) AS backslash, replace(text, chr(10), '  ' || chr(10)) AS spaces FROM documents")
def md_hard_break(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", strings.hard_breaks(F.col("text")).alias("backslash"), strings.hard_breaks(F.col("text"), "spaces").alias("spaces"))


@query("md_quote_lines", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) AS md FROM documents")
def md_quote_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", strings.quote_lines(F.col("text")).alias("md"))


@query("md_lines_in_paragraph", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: " + _sql_line("x") + "), chr(10)) AS md FROM documents")
def md_lines_in_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", escape.lines(F.col("text")).alias("md"))


_H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
_SLUG = f"replace(regexp_replace(lower({_H1}), '[^\\p{{L}}\\p{{N}}\\p{{M}} _-]', '', 'g'), ' ', '-')"


@query("md_slug_dedupe", f"SELECT page_id, CASE WHEN n = 1 THEN base ELSE base || '-' || (n - 1) END AS slug FROM (SELECT page_id, {_SLUG} AS base, row_number() OVER (PARTITION BY {_SLUG} ORDER BY page_id) AS n FROM pages)")
def md_slug_dedupe(spark: SparkSession, d: str) -> DataFrame:
    heads = read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("text"))
    return structure.slugs(heads, [], ["page_id"]).select("page_id", "slug")


_PAGE_STEPS = [(r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", ""), (r"(?s)^.*?<article>(.*?)</article>.*$", "G1"), (r"(?s)<h1>(.*?)</h1>", "# G1\n\n"), (r"<a href=\"([^\"]*)\">([^<]*)</a>", "[G2](G1)"), (r"<li>", "\n- "), (r"</?ul>", "\n"), (r"<br>", "\\\\\n"), (r"<p>", "\n\n"), (r"<[^>]*>", ""), (r"\n{3,}", "\n\n"), (r"\\\n+(\n|$)", "G1"), (r"^\s+|\s+$", "")]


def _page_sql() -> str:
    x = "html"
    for pattern, to in _PAGE_STEPS:
        to = to.replace("G1", "\\1").replace("G2", "\\2")
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"SELECT page_id, {x} AS markdown FROM pages"


@query("md_pages_to_markdown", _page_sql())
def md_pages_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("html")
    for pattern, to in _PAGE_STEPS:
        x = F.regexp_replace(x, pattern, to.replace("G1", "$1").replace("G2", "$2"))
    return read(spark, d, "pages").select("page_id", x.alias("markdown"))


# -- runs, toggles, fields -----------------------------------------------------
_ISLANDS = "SELECT user_id, event_id, event_type, sum(changed) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS changed FROM events)"


@query("md_run_coalesce", f"SELECT user_id, CAST(island AS BIGINT) AS island, min(event_id) AS event_id, event_type, string_agg(CAST(event_id AS VARCHAR), '' ORDER BY event_id) AS text FROM ({_ISLANDS}) GROUP BY user_id, island, event_type")
def md_run_coalesce(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("text"))
    return runs.coalesce_runs(spans, ["user_id"], "event_id", ["event_type"])


@query("md_toggle_xor", "SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN toxic = 1 WHEN doc_id % 5 = 0 THEN TRUE ELSE (doc_id % 7) % 2 = 1 END AS bold FROM labels")
def md_toggle_xor(spark: SparkSession, d: str) -> DataFrame:
    direct = F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), F.col("toxic") == 1)
    return read(spark, d, "labels").select("doc_id", runs.toggle(direct, F.col("doc_id") % 5 == 0, F.col("doc_id") % 7).alias("bold"))


@query("md_format_delimiters", "SELECT doc_id, CASE WHEN b THEN '**' ELSE '' END || CASE WHEN i THEN '*' ELSE '' END || CASE WHEN s THEN '~~' ELSE '' END || CASE WHEN p THEN '<sup>' ELSE '' END || 'x' || CASE WHEN p THEN '</sup>' ELSE '' END || CASE WHEN s THEN '~~' ELSE '' END || CASE WHEN i THEN '*' ELSE '' END || CASE WHEN b THEN '**' ELSE '' END AS md FROM (SELECT doc_id, doc_id % 2 = 1 AS b, doc_id % 3 = 1 AS i, doc_id % 5 = 1 AS s, doc_id % 7 = 1 AS p FROM documents)")
def md_format_delimiters(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("doc_id")
    return read(spark, d, "documents").select("doc_id", runs.decorate(F.lit("x"), runs.fmt_bits(bold=x % 2 == 1, italic=x % 3 == 1, strike=x % 5 == 1, sup=x % 7 == 1)).alias("md"))


_MARKS = "SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'end' ELSE 'separate' END AS kind FROM events"


@query("md_field_frames", f"""
WITH m AS ({_MARKS}),
leveled AS (SELECT *, sum(CASE kind WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + CASE WHEN kind = 'end' THEN 1 ELSE 0 END AS depth FROM m),
numbered AS (SELECT *, sum(CASE WHEN kind = 'begin' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, depth ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS frame FROM leveled WHERE depth > 0)
SELECT user_id, CAST(depth AS BIGINT) AS depth, min(CASE WHEN kind = 'begin' THEN event_id END) AS b, coalesce(min(CASE WHEN kind = 'separate' THEN event_id END), -1) AS sep, coalesce(min(CASE WHEN kind = 'end' THEN event_id END), -1) AS e
FROM numbered GROUP BY user_id, depth, frame HAVING min(CASE WHEN kind = 'begin' THEN event_id END) IS NOT NULL""")
def md_field_frames(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "purchase", "end").otherwise("separate")
    return structure.frames(read(spark, d, "events").select("user_id", "event_id", kind.alias("kind")), ["user_id"], "event_id").fillna(-1, ["sep", "e"])


@query("md_subtree_depth", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS depth FROM events")
def md_subtree_depth(spark: SparkSession, d: str) -> DataFrame:
    return structure.drop_depth(read(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "depth")


@query("md_field_instruction", "SELECT event_id, upper(event_type) AS keyword, 'https://x.y/' || event_id AS argument, CASE WHEN event_id % 3 = 0 THEN 'a' || user_id END AS anchor FROM events")
def md_field_instruction(spark: SparkSession, d: str) -> DataFrame:
    instr = F.concat(F.lit(" "), F.col("event_type"), F.lit(' "https://x.y/'), F.col("event_id").cast("string"), F.lit('"'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(' \\l "a'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.lit(" \\h")))
    e = read(spark, d, "events").select("event_id", instr.alias("i"))
    return e.select("event_id", strings.field_keyword(F.col("i")).alias("keyword"), strings.field_argument(F.col("i")).alias("argument"), strings.field_switch(F.col("i"), "l").alias("anchor"))


@query("md_alternate_branch", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 2 ELSE 1 END, event_id) AS n FROM events) WHERE n = 1 AND event_type <> 'signup'")
def md_alternate_branch(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are choices that are understood, signups such that are not, other events fallbacks."""
    kind = F.col("event_type")
    attrs = F.when(kind == "purchase", F.create_map(F.lit("Requires"), F.lit("wps w14"))).when(kind == "signup", F.create_map(F.lit("Requires"), F.lit("wps other"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit("p").alias("part"), F.col("event_id").alias("seq"), F.col("event_id").alias("end_seq"), F.lit(0).alias("parent"), F.lit("mc").alias("ns"), F.when(kind.isin("purchase", "signup"), "Choice").otherwise("Fallback").alias("name"), attrs.alias("attrs"), F.create_map().cast("map<string,int>").alias("near"))
    return convert.live(nodes).select(F.col("doc_id").alias("user_id"), F.col("seq").alias("event_id"))


@query("md_join_deleted_marks", "SELECT user_id, event_id, CAST(sum(CASE WHEN coalesce(gone, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS joined FROM (SELECT user_id, event_id, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS gone FROM events)")
def md_join_deleted_marks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("mark_deleted"))
    return structure.join_deleted_marks(e, ["user_id"], "event_id").select("user_id", "event_id", "joined")


# -- lists ---------------------------------------------------------------------
def orders_as_items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("list"), F.col("o_orderkey").alias("item"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("ilvl"), F.col("o_orderstatus").alias("status"))


_ITEMS = "SELECT o_custkey AS list, o_orderkey AS item, CAST(o_orderpriority[1] AS INTEGER) - 1 AS ilvl, o_orderstatus AS status FROM orders"
_SEGMENTS = "CASE ilvl " + " ".join(f"WHEN {k} THEN sum(CASE WHEN ilvl < {k} THEN 1 ELSE 0 END) OVER w" for k in range(5)) + " END"
_COUNTED = f"SELECT *, CAST(row_number() OVER (PARTITION BY list, ilvl, segment ORDER BY item) AS INTEGER) AS number FROM (SELECT *, {_SEGMENTS} AS segment FROM ({_ITEMS}) WINDOW w AS (PARTITION BY list ORDER BY item ROWS UNBOUNDED PRECEDING))"


@query("md_list_counter", f"SELECT list, item, ilvl, number FROM ({_COUNTED})")
def md_list_counter(spark: SparkSession, d: str) -> DataFrame:
    return lists.counters(orders_as_items(spark, d), ["list"], ["item"], start=None).select("list", "item", "ilvl", "number")


@query("md_list_indent", f"""
WITH c AS (SELECT *, greatest(len(CAST(number AS VARCHAR)) + 2, 2) AS width FROM ({_COUNTED}))
SELECT list, item, CAST({" + ".join(f"CASE WHEN ilvl > {k} AND last_value(CASE WHEN ilvl <= {k} THEN ilvl END IGNORE NULLS) OVER w = {k} THEN last_value(CASE WHEN ilvl <= {k} THEN width END IGNORE NULLS) OVER w ELSE 0 END" for k in range(5))} AS INTEGER) AS indent
FROM c WINDOW w AS (PARTITION BY list ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def md_list_indent(spark: SparkSession, d: str) -> DataFrame:
    counted = lists.counters(orders_as_items(spark, d), ["list"], ["item"], start=None).withColumn("num_fmt", F.lit("decimal"))
    return lists.indents(lists.markers(counted), ["list"], ["item"], levels=5).select("list", "item", F.col("indent").cast("int").alias("indent"))


@query("md_list_separator", f"SELECT list, item, coalesce(lag(status) OVER (PARTITION BY list ORDER BY item) <> status, FALSE) AS separate FROM ({_ITEMS})")
def md_list_separator(spark: SparkSession, d: str) -> DataFrame:
    return lists.separators(orders_as_items(spark, d), ["list"], ["item"], "status").select("list", "item", F.coalesce("separate", F.lit(False)).alias("separate"))


# -- tables --------------------------------------------------------------------
_CELL_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
_CELL_SQL = ", ".join(_CELL_ORDER)


@query("md_grid_position", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 + coalesce(sum(CAST(l_quantity AS INTEGER) % 3 + 1) OVER (PARTITION BY l_orderkey ORDER BY {_CELL_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS grid_col FROM lineitem")
def md_grid_position(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "lineitem").withColumn("span", F.col("l_quantity").cast("int") % 3 + 1)
    return tables.grid_positions(cells, ["l_orderkey"], _CELL_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "grid_col")


@query("md_row_span", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(merge AS BIGINT) AS merge, count(*) OVER (PARTITION BY l_orderkey, merge) AS rowspan FROM (SELECT *, sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY {_CELL_SQL} ROWS UNBOUNDED PRECEDING) AS merge FROM lineitem)")
def md_row_span(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "lineitem").withColumn("restart", F.col("l_returnflag") != "N")
    return tables.row_spans(cells, ["l_orderkey"], _CELL_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "merge", "rowspan")


@query("md_header_row", "SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE 1 END, n_nationkey) = 1 AS header FROM nation")
def md_header_row(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("row"), (F.col("n_nationkey") % 4 == 3).alias("is_header"))
    return tables.header_rows(rows, ["n_regionkey"]).select("n_regionkey", F.col("row").alias("n_nationkey"), "header")


@query("md_table_render", "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def md_table_render(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    body = n.select("n_regionkey", (F.col("n_nationkey") + 2).alias("row"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("grid_col", "text"))
    head = n.select("n_regionkey").distinct().select("n_regionkey", F.lit(1).alias("row"), F.posexplode(F.array(F.lit("key"), F.lit("name"))).alias("grid_col", "text"))
    return tables.pipe_tables(head.unionByName(body).withColumn("grid_col", F.col("grid_col") + 1), ["n_regionkey"])


@query("md_pad_grid", """
WITH c AS (SELECT c_nationkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey),
grid AS (SELECT c_nationkey, o_custkey, unnest(range(1, n + 1)) AS g FROM (SELECT DISTINCT c_nationkey, o_custkey FROM c) JOIN (SELECT c_nationkey, max(g) AS n FROM c GROUP BY c_nationkey) USING (c_nationkey))
SELECT c_nationkey, o_custkey, CAST(g AS INTEGER) AS grid_col, coalesce(o_orderstatus, '') AS text FROM grid LEFT JOIN c USING (c_nationkey, o_custkey, g)""")
def md_pad_grid(spark: SparkSession, d: str) -> DataFrame:
    """Nations are tables, customers rows, orders cells; a table is as wide as its widest row."""
    n = F.row_number().over(W.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    cells = read(spark, d, "orders").withColumn("grid_col", n).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.col("o_custkey").alias("row"), "grid_col", F.col("o_orderstatus").alias("text"))
    widths = cells.groupBy("c_nationkey").agg(F.max("grid_col").alias("n_cols"))
    return tables.pad_grid(cells.join(widths, "c_nationkey"), ["c_nationkey"]).select("c_nationkey", F.col("row").alias("o_custkey"), "grid_col", "text")


@query("md_column_alignment", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN ':---:' WHEN 'PROMO' THEN '---:' WHEN 'STANDARD' THEN ':---' ELSE '---' END AS delimiter FROM part")
def md_column_alignment(spark: SparkSession, d: str) -> DataFrame:
    jc = F.when(F.col("p_type") == "ECONOMY", "center").when(F.col("p_type") == "PROMO", "right").when(F.col("p_type") == "STANDARD", "left")
    return read(spark, d, "part").select("p_partkey", tables.delimiter(jc).alias("delimiter"))


# -- package lookups ------------------------------------------------------------
@query("md_style_chain", """
WITH RECURSIVE parents AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS up FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
c AS (SELECT node, node AS ancestor, 0 AS depth FROM parents UNION ALL SELECT c.node, p.up, c.depth + 1 FROM c JOIN parents p ON c.ancestor = p.node WHERE p.up IS NOT NULL AND c.depth < 15)
SELECT node, ancestor, depth FROM c""")
def md_style_chain(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    parents = read(spark, d, "customer").select(tag("c", "c_custkey").alias("node"), tag("n", "c_nationkey").alias("up"))
    parents = parents.unionByName(read(spark, d, "nation").select(tag("n", "n_nationkey").alias("node"), tag("r", "n_regionkey").alias("up")))
    parents = parents.unionByName(read(spark, d, "region").select(tag("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up")))
    return styles.chains(parents.withColumnRenamed("node", "_n"), [], "_n", "up", depth=4)


@query("md_rel_resolution", "SELECT n.n_nationkey AS doc_id, CAST(n.n_regionkey + n.n_nationkey % 2 AS INTEGER) AS rel_id, r_name AS target FROM nation n LEFT JOIN region ON r_regionkey = n.n_regionkey + n.n_nationkey % 2")
def md_rel_resolution(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("p").alias("source_part"), (F.col("n_regionkey") + F.col("n_nationkey") % 2).cast("int").alias("rel_id"))
    rels = read(spark, d, "region").select(F.lit("p").alias("source_part"), F.col("r_regionkey").alias("rel_id"), F.col("r_name").alias("target"))
    rels = refs.select("doc_id").distinct().join(rels)  # every document has the same five relationships
    return package.resolve_rels(refs, rels).select("doc_id", "rel_id", "target")


@query("md_missing_inputs", "SELECT c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def md_missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    return package.missing_inputs(read(spark, d, "customer").select(F.col("c_custkey").alias("path")), read(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("path")))


@query("md_content_type", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#5') THEN 'override/' || p_brand ELSE 'default/' || lower(p_type) END AS content_type FROM part")
def md_content_type(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    default = p.select("p_type").distinct().withColumn("content_type", F.concat(F.lit("default/"), F.lower("p_type")))
    override = p.where(F.col("p_brand").isin("Brand#11", "Brand#5")).select("p_brand").distinct().withColumn("content_type", F.concat(F.lit("override/"), F.col("p_brand")))
    return package.with_override(p.select("p_partkey", "p_type", "p_brand"), default, override, ["p_type"], ["p_brand"], "content_type").select("p_partkey", "content_type")


@query("md_path_resolve", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'word/media/' || p_partkey || '.png' WHEN 1 THEN 'media/' || p_partkey || '.png' WHEN 2 THEN 'root/' || p_partkey ELSE 'word/x/' || p_partkey END AS target_part FROM part")
def md_path_resolve(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    m = F.col("p_partkey") % 4
    target = F.when(m == 0, F.concat(F.lit("media/"), key, F.lit(".png"))).when(m == 1, F.concat(F.lit("../media/"), key, F.lit(".png"))).when(m == 2, F.concat(F.lit("/root/"), key)).otherwise(F.concat(F.lit("./x/y/../"), key))
    return read(spark, d, "part").select("p_partkey", strings.resolve_path(F.lit("word/document.xml"), target).alias("target_part"))


@query("md_media_names", "SELECT l_suppkey, l_partkey, 'image' || row_number() OVER (PARTITION BY l_suppkey ORDER BY f, l_partkey) || '.png' AS out_name FROM (SELECT l_suppkey, l_partkey, min(l_orderkey) AS f FROM lineitem GROUP BY l_suppkey, l_partkey)")
def md_media_names(spark: SparkSession, d: str) -> DataFrame:
    images = read(spark, d, "lineitem").withColumn("ext", F.lit("png"))
    return structure.media_names(images, ["l_suppkey"], "l_partkey", ["l_orderkey"]).select("l_suppkey", "l_partkey", "out_name")


@query("md_note_renumber", "SELECT l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY f, l_partkey) AS INTEGER) AS number FROM (SELECT l_suppkey, l_partkey, min(l_orderkey) AS f FROM lineitem GROUP BY l_suppkey, l_partkey)")
def md_note_renumber(spark: SparkSession, d: str) -> DataFrame:
    return structure.renumber(read(spark, d, "lineitem"), ["l_suppkey"], ["l_partkey"], ["l_orderkey"])


@query("md_bookmark_targets", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 7 = o_orderkey % 7)")
def md_bookmark_targets(spark: SparkSession, d: str) -> DataFrame:
    """Customers are bookmarks of seven documents; an order of status P links to its customer's, if it is in the same document."""
    marks = read(spark, d, "customer").select((F.col("c_custkey") % 7).alias("doc_id"), F.col("c_custkey").cast("string").alias("bookmark"), "c_custkey")
    links = read(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("doc_id"), F.concat(F.when(F.col("o_orderstatus") == "P", "#").otherwise("x#"), F.col("o_custkey").cast("string")).alias("dest"))
    return structure.wanted_marks(marks, links, ["doc_id"]).select("c_custkey")


# -- documents and runs ----------------------------------------------------------
@query("md_status_rollup", "SELECT count(*) FILTER (toxic = 0) AS converted, count(*) FILTER (toxic <> 0) AS failed, CAST(CASE WHEN count(*) FILTER (toxic <> 0) = 0 THEN 0 WHEN count(*) FILTER (toxic = 0) > 0 THEN 6 ELSE 3 END AS INTEGER) AS verdict FROM labels")
def md_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return structure.run_status(read(spark, d, "labels").select((F.col("toxic") * 3).cast("int").alias("status")))


@query("md_doc_assemble", "SELECT conv_id, string_agg('**' || role || '** ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def md_doc_assemble(spark: SparkSession, d: str) -> DataFrame:
    blocks = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("**"), "role", F.lit("** "), "text").alias("md"))
    return structure.assemble(blocks, ["conv_id"], ["turn"])


@query("md_stories_union", "SELECT n_nationkey AS doc_id, 'n' || n_nationkey AS part, 'body' AS story FROM nation UNION ALL SELECT s_nationkey, min('s' || s_suppkey), CASE s_suppkey % 3 WHEN 0 THEN 'footnotes' ELSE 'endnotes' END FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY s_nationkey, s_suppkey % 3")
def md_stories_union(spark: SparkSession, d: str) -> DataFrame:
    """Nations are documents; their suppliers are related parts, of which notes are stories."""
    kind = F.element_at(F.array(*map(F.lit, ("footnotes", "endnotes", "styles"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rels = read(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.concat(F.lit("n"), "s_nationkey").alias("source_part"), kind.alias("rel_type"), F.concat(F.lit("s"), "s_suppkey").alias("target_part"))
    return package.stories(rels, read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("main_part")))


@query("md_heading_level", "SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN least(p_size % 9 + 1, 6) WHEN 1 THEN least(p_size % 9 + 1, 6) WHEN 2 THEN p_size % 2 + 1 ELSE least(p_size % 3 + 5, 6) END AS INTEGER) AS level FROM part")
def md_heading_level(spark: SparkSession, d: str) -> DataFrame:
    """Levels by a style's name, by its id, by title and subtitle, and by outline level."""
    n, size = F.col("p_size") % 4, F.col("p_size")
    number = lambda x: x.cast("int").cast("string")
    name = F.when(n == 0, F.concat(F.lit("Heading_20_ "), number(size % 9 + 1))).when((n == 2) & (size % 2 == 0), F.lit("Title")).when(n == 2, F.lit("Subtitle")).otherwise(F.lit("Überschrift"))
    id_ = F.when(n == 1, F.concat(F.when(size % 5 == 0, "Heading").otherwise("berschrift"), number(size % 9 + 1))).otherwise(F.lit("a"))
    chain = F.array(F.struct(strings.normal_name(name).alias("name"), id_.alias("id")), F.struct(F.lit("normal").alias("name"), F.lit("Normal").alias("id")))
    return read(spark, d, "part").select("p_partkey", styles.heading_level(chain, F.when(n == 3, (size % 3 + 4).cast("int"))).cast("int").alias("level"))


@query("md_autolink", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<' || url || '>' ELSE '[page](' || " + _sql_dest("url") + " || ')' END AS md FROM pages")
def md_autolink(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.lit("page"))
    link = F.concat(F.lit("["), text, F.lit("]("), escape.destination(F.col("url")), F.lit(")"))
    return read(spark, d, "pages").select("page_id", F.coalesce(strings.autolink(text, F.col("url")), link).alias("md"))


@query("md_on_off", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'unspecified' WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'true' WHEN 4 THEN 'false' ELSE 'true' END AS state FROM documents")
def md_on_off(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 6
    value = F.when(m == 2, "0").when(m == 3, "on").when(m == 4, "banana").when(m == 5, "true")
    return read(spark, d, "documents").select("doc_id", F.coalesce(strings.on_off(value, m != 0).cast("string"), F.lit("unspecified")).alias("state"))


@query("md_parse_number", "SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 4294967295 WHEN 4 THEN doc_id ELSE -1 END AS n FROM documents")
def md_parse_number(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 6
    text = F.when(m == 0, "").when(m == 1, "4294967295").when(m == 2, "4294967296").when(m == 3, "-1").when(m == 4, F.concat(F.lit("00"), F.col("doc_id").cast("string"))).otherwise("1 ")
    return read(spark, d, "documents").select("doc_id", F.coalesce(strings.parse_ui32(text), F.lit(-1)).alias("n"))


@query("md_option_value", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'v' || doc_id WHEN 1 THEN '' END AS value FROM documents")
def md_option_value(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 3
    argument = F.when(m == 0, F.concat(F.lit("--output=v"), F.col("doc_id").cast("string"))).when(m == 1, "--output").otherwise("--outputs=x")
    return read(spark, d, "documents").select("doc_id", strings.match_value(argument, F.lit("--output")).alias("value"))


@query("docx_round_trip", "SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(0 AS INTEGER) AS status, string_agg(" + "array_to_string(list_transform(string_split(replace(" + _sql_inline("text") + ", chr(10), '\\' || chr(10)), chr(10)), lambda x: " + _sql_line("x") + "), chr(10))" + ", chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY conv_id")
def docx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations become packages, and the packages Markdown: archive, XML, styles, runs, escaping and assembly in one query."""
    files = samples.packages(read(spark, d, "conversations"), "conv_id", "turn", "text")
    return convert_files(files).documents.select("doc_id", "status", "markdown")


# Customers of a nation are the blocks of its document.
_NAME = "'name ' || c_custkey"


def nations(spark: SparkSession, d: str, block: Column, notes: Column | None = None) -> DataFrame:
    """One package per nation, with a block of XML for each of its customers in order, converted."""
    rows = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("key"), "c_custkey", block.alias("xml"), (F.lit("") if notes is None else notes).alias("note"))
    made = convert_files(samples.packages_of(rows, "key", "c_custkey", "xml", "note")).documents
    return made.select(F.col("doc_id").cast("long").alias("c_nationkey"), "status", "markdown")


def nation_sql(md: str, rows: str = "customer", glue: str = "chr(10) || chr(10)") -> str:
    return f"SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(0 AS INTEGER) AS status, string_agg({md}, {glue} ORDER BY c_custkey) || chr(10) AS markdown FROM {rows} GROUP BY c_nationkey"


def _xml(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _run(text: Column, props: str = "") -> Column:
    return _xml(f"<w:r><w:rPr>{props}</w:rPr><w:t>", text, "</w:t></w:r>")


def _para(*inner: Column | str, props: str = "") -> Column:
    return _xml(f"<w:p><w:pPr>{props}</w:pPr>", *inner, "</w:p>")


def _turn(cases: list[Column]) -> Column:
    return F.element_at(F.array(*cases), (F.col("c_custkey") % len(cases) + 1).cast("int"))


def _customer() -> Column:
    return F.concat(F.lit("name "), F.col("c_custkey").cast("string"))


# Quotes that follow each other are one block.
_QUOTED = "(SELECT *, CASE WHEN lag(c_custkey) OVER w IS NULL THEN '' WHEN lag(c_custkey % 6) OVER w = 4 AND c_custkey % 6 = 4 THEN chr(10) || '>' || chr(10) ELSE chr(10) || chr(10) END AS glue FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))"


@query("docx_styles", nation_sql(f"glue || CASE c_custkey % 6 WHEN 0 THEN '## ' || {_NAME} WHEN 1 THEN '**' || {_NAME} || '**' WHEN 2 THEN {_NAME} WHEN 3 THEN '*~~' || {_NAME} || '~~*' WHEN 4 THEN '> ' || {_NAME} ELSE '`' || {_NAME} || '`' || 'A<sup>2</sup>' END", _QUOTED, "''"))
def docx_styles(spark: SparkSession, d: str) -> DataFrame:
    """Headings, toggles that styles inherit and cancel, direct formatting, quotes, code and hidden runs."""
    style = "<w:pStyle w:val='{}'/>".format
    return nations(spark, d, _turn([
        _para(_run(_customer()), props=style("Heading2")), _para(_run(_customer()), props=style("Child")), _para(_run(_customer(), "<w:rStyle w:val='Strong'/>"), props=style("BoldPara")),
        _para(_run(_customer(), "<w:i/><w:strike/>")), _para(_run(_customer()), props=style("Quote")), _para(_run(_customer(), "<w:rFonts w:ascii='Consolas'/>"), _run(F.lit("gone"), "<w:vanish/>"), _run(F.lit("a"), "<w:caps/>"), _run(F.lit("2"), "<w:vertAlign w:val='superscript'/>")),
    ]))


_TREE = "SELECT c_nationkey, c_custkey, c_custkey % 3 AS ilvl FROM customer"
_TREE_SEGMENTS = "CASE ilvl " + " ".join(f"WHEN {k} THEN sum(CASE WHEN ilvl < {k} THEN 1 ELSE 0 END) OVER w" for k in range(3)) + " END"
_TREE_COUNTED = f"SELECT *, CASE ilvl WHEN 1 THEN '- ' ELSE row_number() OVER (PARTITION BY c_nationkey, ilvl, segment ORDER BY c_custkey) || '. ' END AS marker FROM (SELECT *, {_TREE_SEGMENTS} AS segment FROM ({_TREE}) WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING))"
_TREE_INDENT = " + ".join(f"CASE WHEN ilvl > {k} AND last_value(CASE WHEN ilvl <= {k} THEN ilvl END IGNORE NULLS) OVER w = {k} THEN last_value(CASE WHEN ilvl <= {k} THEN greatest(len(marker), 2) END IGNORE NULLS) OVER w ELSE 0 END" for k in range(3))


@query("docx_lists", nation_sql(f"repeat(' ', CAST(indent AS INTEGER)) || marker || {_NAME}", f"(SELECT *, {_TREE_INDENT} AS indent FROM ({_TREE_COUNTED}) WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", "chr(10)"))
def docx_lists(spark: SparkSession, d: str) -> DataFrame:
    """One list of three levels, numbers, bullets and numbers again, by two instances of one definition."""
    number = _xml("<w:numPr><w:ilvl w:val='", (F.col("c_custkey") % 3).cast("string"), "'/><w:numId w:val='", (F.col("c_custkey") % 2 + 1).cast("string"), "'/></w:numPr>")
    return nations(spark, d, _xml("<w:p><w:pPr>", number, "</w:pPr>", _run(_customer()), "</w:p>"))


@query("docx_tables", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(0 AS INTEGER) AS status, '| key | name | sum |' || chr(10) || '| --- | --- | ---: |' || chr(10) || string_agg(CASE c_custkey % 3 WHEN 0 THEN '| ' || c_custkey || ' | a\\|b<br>' || c_custkey || ' | x |' WHEN 1 THEN '| ' || c_custkey || ' |  | x |' ELSE '| ' || c_custkey || ' |  |  |' END, chr(10) ORDER BY c_custkey) || chr(10) AS markdown FROM customer GROUP BY c_nationkey")
def docx_tables(spark: SparkSession, d: str) -> DataFrame:
    """One table: a header, pipes and line ends in cells, spans, short rows, alignment."""
    first = F.row_number().over(W.Window.partitionBy("c_nationkey").orderBy("c_custkey")) == 1
    last = F.row_number().over(W.Window.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))) == 1
    key = F.col("c_custkey").cast("string")
    cell = lambda text, props="", jc="": _xml(f"<w:tc><w:tcPr>{props}</w:tcPr>", _para(_run(text), props=jc), "</w:tc>")
    right = "<w:jc w:val='right'/>"
    head = _xml("<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid><w:tr>", cell(F.lit("key")), cell(F.lit("name")), cell(F.lit("sum"), jc=right), "</w:tr>")
    two = _xml("<w:tc>", _para(_run(F.lit("a|b"))), _para(_run(key)), "</w:tc>")
    row = _xml("<w:tr>", _turn([_xml(cell(key), two, cell(F.lit("x"))), _xml(cell(key, "<w:gridSpan w:val='2'/>"), cell(F.lit("x"))), cell(key)]), "</w:tr>")
    return nations(spark, d, _xml(F.when(first, head).otherwise(F.lit("")), row, F.when(last, F.lit("</w:tbl>")).otherwise(F.lit(""))))


@query("docx_links", nation_sql(f"CASE WHEN n = 1 THEN '# Name ' || c_custkey || '!' WHEN c_custkey % 3 = 0 THEN '[' || {_NAME} || '](https://e.org/%28x%29)' WHEN c_custkey % 3 = 1 THEN '[**' || {_NAME} || '**](https://x.y/' || c_custkey || ')' ELSE 'see [' || {_NAME} || '](#name-' || first || ')' END", "(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer)"))
def docx_links(spark: SparkSession, d: str) -> DataFrame:
    """Links by relationship, by field, and to a bookmark at a heading."""
    first = F.row_number().over(W.Window.partitionBy("c_nationkey").orderBy("c_custkey")) == 1
    head = _para("<w:bookmarkStart w:id='0' w:name='top'/>", _run(_xml("Name ", F.col("c_custkey").cast("string"), "!")), props="<w:pStyle w:val='Heading1'/>")
    mark = "<w:r><w:fldChar w:fldCharType='{}'/></w:r>".format
    field = _para(mark("begin"), "<w:r><w:instrText> HYPERLINK \"https://x.y/", F.col("c_custkey").cast("string"), "\" </w:instrText></w:r>", mark("separate"), _run(_customer(), "<w:b/>"), mark("end"))
    link = lambda to: _xml(f"<w:hyperlink {to}>", _run(_customer(), "<w:rStyle w:val='Hyperlink'/>"), "</w:hyperlink>")
    return nations(spark, d, F.when(first, head).otherwise(_turn([_para(link("r:id='rIdL'")), field, _para("<w:r><w:t xml:space='preserve'>see </w:t></w:r>", link("w:anchor='top'"))])))


@query("docx_fields", nation_sql(f"CASE c_custkey % 4 WHEN 0 THEN '' || c_custkey WHEN 2 THEN 'on ' || {_NAME} ELSE 'in ' || {_NAME} END", "(SELECT * FROM customer WHERE c_custkey % 4 <> 1)"))
def docx_fields(spark: SparkSession, d: str) -> DataFrame:
    """Results of simple and of nested fields, a contents field that goes, insertions and deletions, alternate content, controls."""
    mark = "<w:r><w:fldChar w:fldCharType='{}'/></w:r>".format
    instr = "<w:r><w:instrText>{}</w:instrText></w:r>".format
    page = _para("<w:fldSimple w:instr=' PAGE '>", _run(F.col("c_custkey").cast("string")), "</w:fldSimple>")
    toc = _para(mark("begin"), instr(" TOC \\o "), mark("separate"), _run(F.lit("stale")), mark("begin"), instr("PAGEREF x"), mark("separate"), _run(F.lit("7")), mark("end"), mark("end"))
    date = _para("<w:r><w:t xml:space='preserve'>on </w:t></w:r>", mark("begin"), instr("DATE "), mark("begin"), instr("X"), mark("end"), mark("separate"), _run(_customer()), mark("end"))
    changed = _xml("<w:sdt><w:sdtContent>", _para("<w:ins w:id='1'><w:r><w:t xml:space='preserve'>in </w:t></w:r></w:ins><w:del w:id='2'><w:r><w:delText>out</w:delText></w:r></w:del>", "<w:r><mc:AlternateContent><mc:Choice Requires='unknown'><w:t>no</w:t></mc:Choice><mc:Fallback><w:t>", _customer(), "</w:t></mc:Fallback></mc:AlternateContent></w:r>"), "</w:sdtContent></w:sdt>")
    return nations(spark, d, _turn([page, toc, date, changed]))


@query("docx_notes", f"""
WITH c AS (SELECT *, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS n FROM customer)
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(0 AS INTEGER) AS status,
       string_agg({_NAME} || CASE WHEN c_custkey % 3 = 0 THEN '[^' || CAST(n AS INTEGER) || ']' ELSE '' END, chr(10) || chr(10) ORDER BY c_custkey)
       || coalesce(chr(10) || chr(10) || string_agg('[^' || CAST(n AS INTEGER) || ']: note ' || c_custkey || chr(10) || chr(10) || '    more', chr(10) || chr(10) ORDER BY c_custkey) FILTER (c_custkey % 3 = 0), '') || chr(10) AS markdown
FROM c GROUP BY c_nationkey""")
def docx_notes(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes of two paragraphs, numbered by first reference; notes that nothing refers to go."""
    key = F.col("c_custkey").cast("string")
    reference = F.when(F.col("c_custkey") % 3 == 0, _xml("<w:r><w:footnoteReference w:id='", key, "'/></w:r>")).otherwise(F.lit(""))
    note = _xml("<w:footnote w:id='", key, "'>", _para("<w:r><w:footnoteRef/></w:r>", _run(F.concat(F.lit("note "), key))), _para(_run(F.lit("more"))), "</w:footnote>")
    return nations(spark, d, _para(_run(_customer()), reference), note)


# -- vectors and bits ---------------------------------------------------------------
@query("vec_lane_max", "SELECT vec_id, list_max(embedding) AS largest, list_max(embedding[1:3]) AS largest3 FROM embeddings")
def vec_lane_max(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", vectors.lane_max(F.col("embedding")).alias("largest"), vectors.lane_max(F.col("embedding"), 3).alias("largest3"))


@query("vec_scale3", "SELECT vec_id, e[1] * 0.5 AS x, e[2] * 0.5 AS y, e[3] * 0.5 AS z, e[4] AS w FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)")
def vec_scale3(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.scale3(F.col("embedding").cast("array<double>"), F.lit(0.5))
    return read(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate("xyzw")])


@query("vec_fused", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS lane, e[i] * e[len(e) + 1 - i] + e[i] AS madd, e[i] * e[len(e) + 1 - i] - e[i] AS msub, e[i] - e[i] * e[len(e) + 1 - i] AS nmadd, abs(e[i]) AS magnitude FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings))")
def vec_fused(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    lanes = [vectors.fused(e, F.reverse(e), e, k).alias(n) for k, n in (("fmadd", "madd"), ("fmsub", "msub"), ("fnmadd", "nmadd"))]
    whole = read(spark, d, "embeddings").select("vec_id", *lanes, vectors.absolute(e).alias("magnitude"))
    return whole.select("vec_id", F.posexplode(F.arrays_zip("madd", "msub", "nmadd", "magnitude")).alias("lane", "x")).select("vec_id", "lane", "x.*")


@query("vec_splat", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS lane, e[i] * -1 + 1 AS complement FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings))")
def vec_splat(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    lanes = vectors.fused(e, vectors.splat(F.lit(-1.0), F.size(e)), vectors.splat(F.lit(1.0), F.size(e)))
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(lanes).alias("lane", "complement"))


@query("vec_filled", "SELECT p_partkey, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, p_size AS v FROM (SELECT p_partkey, p_size, r, unnest(range(0, 2)) AS c FROM (SELECT p_partkey, p_size, unnest(range(0, p_size % 3 + 1)) AS r FROM part))")
def vec_filled(spark: SparkSession, d: str) -> DataFrame:
    grid = vectors.filled(F.col("p_size"), (F.col("p_size") % 3 + 1).cast("int"), 2)
    rows = read(spark, d, "part").select("p_partkey", F.posexplode(grid).alias("r", "row"))
    return rows.select("p_partkey", "r", F.posexplode("row").alias("c", "v"))


@query("num_min_max", "SELECT o_orderkey, CASE WHEN o_totalprice < o_custkey * 100 THEN o_totalprice ELSE o_custkey * 100 END AS low, CASE WHEN o_totalprice > o_custkey * 100 THEN o_totalprice ELSE o_custkey * 100 END AS high FROM orders")
def num_min_max(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("o_totalprice"), (F.col("o_custkey") * 100).cast("double")
    return read(spark, d, "orders").select("o_orderkey", vectors.minimum(a, b).alias("low"), vectors.maximum(a, b).alias("high"))


@query("bit_round_nearest", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(f"l_partkey - 300 & {-n} AS down{n}, l_partkey - 300 + {n - 1} & {-n} AS up{n}" for n in vectors.NEAREST) + " FROM lineitem")
def bit_round_nearest(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_partkey") - 300
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[f(x, n).alias(f"{name}{n}") for n in vectors.NEAREST for name, f in (("down", vectors.round_down), ("up", vectors.round_up))])


@query("bit_masks", "SELECT p_partkey, (p_partkey & p_size) = p_size AS all_true, (p_partkey & p_size) = 0 AS all_false, printf('%02X%02X%02X', p_partkey & 255, (p_partkey >> 8) & 255, (p_partkey >> 16) & 255) AS low24 FROM part")
def bit_masks(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_partkey"), F.col("p_size").cast("long")
    return read(spark, d, "part").select("p_partkey", vectors.all_true(a, b).alias("all_true"), vectors.all_false(a, b).alias("all_false"), F.hex(vectors.low24(a)).alias("low24"))


@query("num_rotate", "SELECT c_custkey, round(c_acctbal - 2 * sin(1.0), 6) AS x1, round(c_custkey + 2 * cos(1.0), 6) AS y1, round(c_acctbal * cos(0.5) - c_custkey * sin(0.5), 6) AS x2, round(c_acctbal * sin(0.5) + c_custkey * cos(0.5), 6) AS y2 FROM customer")
def num_rotate(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    moved, turned = vectors.move_along(x, y, F.lit(1.0), F.lit(2.0)), vectors.rotate(x, y, F.lit(0.5))
    return read(spark, d, "customer").select("c_custkey", *[F.round(c, 6).alias(n) for c, n in ((moved["x"], "x1"), (moved["y"], "y1"), (turned["x"], "x2"), (turned["y"], "y2"))])
