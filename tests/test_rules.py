"""The rule queries against DuckDB, and scalar vectors of the specification."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumflow.functions import escape, strings, vectors
from vellumflow.operators import lists, runs, structure, styles, tables
from vellumflow.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(table, columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in table)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    assert rows(got.collect(), columns) == rows([dict(zip(names, r, strict=True)) for r in want.fetchall()], columns)


VECTORS = [
    (escape.line_start, [("# h", "\\# h"), ("#x", "#x"), ("- a", "\\- a"), ("1998. x", "1998\\. x"), ("1) y", "1\\) y"), ("===", "\\==="), ("---", "\\---"), ("> q", "\\> q"), ("3.5 x", "3.5 x"), ("-x", "-x")]),
    (escape.inline, [("*a_`[]\\", "\\*a\\_\\`\\[\\]\\\\"), ("~~", "\\~\\~"), ("<T> a < b", "\\<T> a < b"), ("![x", "\\!\\[x"), ("AT&T &amp; &#12; &#x1f;", "AT&T &amp;amp; &amp;#12; &amp;#x1f;")]),
    (escape.code_span, [("a", "`a`"), ("a`b", "``a`b``"), ("``", "``` `` ```"), ("`a", "`` `a ``")]),
    (escape.fence, [("x", "```\nx\n```"), ("```", "````\n```\n````")]),
    (escape.destination, [("a b(c)<d>\n", "a%20b%28c%29%3Cd%3E%0A")]),
    (escape.table_cell, [("a|b\nc", "a\\|b<br>c")]),
    (strings.normal_name, [("Source_20_Text", "source text"), ("Heading   1", "heading 1")]),
    (strings.slug, [("My Head! (x) a_b-c", "my-head-x-a_b-c"), ("Été", "été")]),
    (strings.visible, [("a­b​c‍", "abc"), ("\U0001f469‍\U0001f680", "\U0001f469‍\U0001f680")]),
    (strings.quote_lines, [("a\n\nb", "> a\n>\n> b")]),
    (strings.field_keyword, [(' hyperlink "x"', "HYPERLINK")]),
    (strings.field_argument, [(' HYPERLINK "a b" \\l "c"', "a b"), (' HYPERLINK \\l "c"', ""), (" REF mark \\h", "mark")]),
    (lambda c: strings.parse_ui32(c).cast("string"), [("", None), ("0", "0"), ("4294967295", "4294967295"), ("4294967296", None), ("-1", None), ("1 ", None), ("9" * 60, None), ("000000000000007", "7")]),
    (lambda c: strings.on_off(c, F.lit(True)).cast("string"), [(None, "true"), ("0", "false"), ("off", "false"), ("on", "true"), ("banana", "false")]),
    (lambda c: strings.unsafe_path(c).cast("string"), [("../x", "true"), ("a/../b", "true"), ("/a", "true"), ("C:x", "true"), ("a\\b", "true"), ("n:s", "true"), ("a/b..c", "false")]),
    (lambda c: strings.resolve_path(F.lit("word/document.xml"), c), [("media/a.png", "word/media/a.png"), ("../a", "a"), ("/b/c", "b/c"), ("../../../x", "x"), ("./y", "word/y")]),
]


@pytest.mark.parametrize("case", range(len(VECTORS)))
def test_scalar_vectors(spark, case):
    function, pairs = VECTORS[case]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [b for _, b in pairs]


def test_bits_and_lanes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert [get(vectors.round_up(F.lit(x), 8)) for x in (0, 1, 8, 13, -13)] == [0, 8, 8, 16, -8]
    assert [get(vectors.round_down(F.lit(x), 8)) for x in (0, 7, 8, 13, -13)] == [0, 0, 8, 8, -16]
    assert get(vectors.all_true(F.lit(6), F.lit(2))) and not get(vectors.all_true(F.lit(6), F.lit(3))) and get(vectors.all_false(F.lit(6), F.lit(1)))
    nan = float("nan")
    assert get(vectors.minimum(F.lit(nan), F.lit(1.0))) == 1.0 and get(vectors.maximum(F.lit(nan), F.lit(1.0))) == 1.0
    assert bytes(get(vectors.low24(F.lit(0x01020304)))) == b"\x04\x03\x02"
    assert get(vectors.rotate(F.lit(1.0), F.lit(0.0), F.lit(0.0)))["x"] == 1.0
    assert get(vectors.scale3(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), F.lit(2.0))) == [2.0, 4.0, 6.0, 4.0]


def test_toggle_truth_table(spark):
    cases = [(None, None, 0, False), (None, None, 1, True), (None, None, 2, False), (None, None, 3, True), (False, True, 1, False), (True, False, 2, True), (None, True, 2, True), (None, False, 1, True)]
    got = spark.createDataFrame(cases, "d boolean, f boolean, n int, want boolean").select(runs.toggle(F.col("d"), F.col("f"), F.col("n")).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


def test_chains_survive_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "missing"), ("d", "c")], "n string, p string")
    got = sorted(map(tuple, styles.chains(parents, [], "n", "p").collect()))
    assert got == [("a", "a", 0), ("a", "b", 1), ("b", "a", 1), ("b", "b", 0), ("c", "c", 0), ("d", "c", 1), ("d", "d", 0)]
    sql = {(r["node"], r["ancestor"]) for r in styles.chains_sql(parents.where("n in ('c', 'd')"), "n", "p").collect()}
    assert {("d", "c"), ("d", "d")} <= sql


def test_restart_limit_and_override(spark):
    items = [(1, 0, None, None), (2, 1, None, 1), (3, 2, None, 1), (4, 1, None, 1), (5, 2, None, 1), (6, 0, None, None), (7, 2, None, 1), (8, 0, 7, None), (9, 0, None, None)]
    rows_ = spark.createDataFrame([(1, *i) for i in items], "list int, item int, ilvl int, over int, lim int")
    got = {r["item"]: r["number"] for r in lists.counters(rows_, ["list"], ["item"], start=None, restart="lim", override="over").collect()}
    # Level 2 restarts after level 0 only (its limit is 1), so item 5 continues; an override begins at its value.
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 1, 8: 7, 9: 8}


def test_unclosed_and_nested_frames(spark):
    marks = [(1, "begin"), (2, "begin"), (3, "separate"), (4, "end"), (5, "separate"), (6, "end"), (7, "begin"), (8, "separate")]
    got = sorted((r["b"], r["sep"], r["e"], r["depth"]) for r in structure.frames(spark.createDataFrame([("d", *m) for m in marks], "doc string, i int, kind string"), ["doc"], "i").collect())
    assert got == [(1, 5, 6, 1), (2, 3, 4, 2), (7, 8, None, 1)]


def test_run_status(spark):
    verdict = lambda *s: structure.run_status(spark.createDataFrame([(x,) for x in s], "status int")).first()["verdict"]
    assert (verdict(0, 0), verdict(0, 3), verdict(3, 3)) == (0, 6, 3)


def test_alignment_and_header(spark):
    cells = spark.createDataFrame([(1, r, c, f"{r}{c}") for r in (1, 2) for c in (1, 2)], "t int, row int, grid_col int, text string")
    heads, aligns = spark.createDataFrame([(1, 2)], "t int, row int"), spark.createDataFrame([(1, 1, "center"), (1, 2, "right")], "t int, grid_col int, jc string")
    assert tables.pipe_tables(cells, ["t"], heads, aligns).first()["markdown"] == "| 21 | 22 |\n| :---: | ---: |\n| 11 | 12 |"
