"""Benchmark decontamination by verified n-gram windows, in DataFrame expressions only.

Benchmark items become windows of ``NGRAM`` words (a shorter item is one
window).  While the set of windows is at most ``MAX_SET`` (checked by a count),
it is broadcast with the tasks as two hash sets: one of hashed window ends,
which almost every training window fails, and one of the windows' full texts,
filed by hash, which verifies the rest and names the items.  A larger benchmark
takes the other way, with equal results: hashed training windows are joined to
hashed benchmark windows, and the hits verified by joining full window texts;
each benchmark window meets the rows in ``SALTS`` shares, so that a passage that
many documents hold spreads over tasks.

Defined results: null or wordless text has no words and no hits; repeated rows
are judged one by one; repeated items and items of one text all count; an item
without words is never found; null item_ids count as the id ``null``; empty
tables give no rows, or no hits; other columns are kept by ``clean`` and not
read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, held, staged

NGRAM = 13
#: Windows that may travel with the tasks (about 100 bytes each).
MAX_SET = 20_000
SALTS = 16
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_HITS = "array<struct<pos: int, len: int>>"


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; empty for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _GAP), ""), F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """``gram, len, item``: every distinct window of every item."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i")
    return words.select("item", "w", size.alias("len"), starts).select(F.array_join(F.slice("w", F.col("i") + 1, F.col("len")), " ").alias("gram"), "len", "item").distinct()


def _covered(hits: Column) -> Column:
    """Words inside any of the (pos, len) windows, which are sorted by pos."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def step(acc: Column, h: Column) -> Column:
        end = h["pos"] + h["len"]
        return F.struct((acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], h["pos"]))).alias("total"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, zero, step, lambda acc: acc["total"])


def _by_set(docs: DataFrame, windows: list) -> DataFrame:
    """Adds ``hits`` and ``items`` from windows (gram, len, item, ends, key) that travel with the tasks."""
    none = F.array().cast("array<string>")
    if not windows:
        return docs.withColumns({"hits": F.array().cast(_HITS), "items": none})
    ids = sorted({r["item"] for r in windows})
    number = {x: k for k, x in enumerate(ids)}
    items: dict[str, set[int]] = {}
    ends: dict[int, set[int]] = {}
    for r in windows:
        items.setdefault(r["gram"], set()).add(number[r["item"]])
        ends.setdefault(r["len"], set()).add(r["ends"])
    slots: list[list[str]] = [[] for _ in items]
    for gram, key in {r["gram"]: r["key"] for r in windows}.items():
        slots[key % len(slots)].append(gram + "\x02" + " ".join(map(str, sorted(items[gram]))))
    # Words hold no control characters, so these separate them.  Item ids may hold anything and travel in hexadecimal.
    table = F.split(F.lit("\x01".join("\x03".join(x) for x in slots)), "\x01")
    names = F.split(F.lit(",".join(x.encode().hex() for x in ids)), ",")
    parts = []
    for size, hashes in sorted(ends.items()):
        anchored = f"xxhash64(concat_ws(' ', get(words, i), get(words, i + {size - 1}))) IN ({', '.join(f'{h}L' for h in sorted(hashes))})"
        parts.append(f"transform(filter(IF(n_words >= {size}, sequence(0, n_words - {size}), array()), i -> {anchored}), i -> named_struct('pos', i, 'len', {size}, 'gram', array_join(slice(words, i + 1, {size}), ' ')))")

    def verified(h: Column) -> Column:
        filed = F.get(table, F.pmod(F.xxhash64(h["gram"]), F.lit(len(slots))).cast("int"))
        return F.struct(h["pos"].alias("pos"), h["len"].alias("len"), F.try_element_at(F.str_to_map(filed, F.lit("\x03"), F.lit("\x02")), h["gram"]).alias("told"))

    found = held(docs, near=F.expr(f"array_sort(concat({', '.join(parts)}))"))
    found = held(found, told=F.filter(F.transform("near", verified), lambda h: h["told"].isNotNull())).drop("near")
    numbers = F.array_distinct(F.flatten(F.transform("told", lambda h: F.split(h["told"], " "))))
    named = F.array_sort(F.transform(numbers, lambda k: F.unhex(F.get(names, k.cast("int"))).cast("string")))
    hits = F.transform("told", lambda h: F.struct(h["pos"].alias("pos"), h["len"].alias("len")))
    return found.withColumns({"hits": hits, "items": F.when(F.size("told") > 0, named).otherwise(none)}).drop("told")


def _by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``hits`` and ``items`` by joins, for benchmarks of any size."""
    windows = staged(windows.select("gram", "len", "item", F.xxhash64(F.split("gram", " ")).alias("h")), "windows")
    sizes = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most NGRAM
    row, salt = free_name(docs, "row_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
    small = keyed.select(F.col(row).alias("row"), "words", "n_words", F.pmod(F.xxhash64(row, F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt"))
    none = F.array().cast("array<struct<pos: int, len: int, h: bigint>>")

    def hashes(size: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.col("n_words") - size), lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), F.xxhash64(F.slice("words", i + 1, size)).alias("h")))
        return F.when(F.col("n_words") >= size, each).otherwise(none)

    spots = F.concat(*[hashes(k) for k in sizes]) if sizes else none
    near = small.select("row", "salt", F.inline(spots)).join(windows.select("h", salt).distinct(), ["h", "salt"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("pos", "len")).alias("near"))
    grams = F.transform("near", lambda h: F.struct(h["pos"].alias("pos"), h["len"].alias("len"), F.array_join(F.slice("words", h["pos"] + 1, h["len"]), " ").alias("gram")))
    hits = small.select("row", "words", "salt").join(near, "row").select("row", "salt", F.inline(grams)).join(windows.select("gram", "item", salt), ["gram", "salt"])
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("found"), F.array_sort(F.collect_set("item")).alias("named")).withColumnsRenamed({"row": f"{row}_", "found": f"{row}_found", "named": f"{row}_named"})
    joined = keyed.join(per_row, F.col(row) == F.col(f"{row}_"), "left")
    return joined.withColumns({"hits": F.coalesce(f"{row}_found", F.array().cast(_HITS)), "items": F.coalesce(f"{row}_named", F.array().cast("array<string>"))}).drop(row, f"{row}_", f"{row}_found", f"{row}_named")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, max_set: int = MAX_SET) -> DataFrame:
    """Adds to every row: words, n_words, hits (window starts and lengths), items, n_hit, contaminated."""
    windows = windows_of(benchmark, n)
    words = F.split("gram", " ")
    keyed = windows.select("gram", "len", "item", F.xxhash64(F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1))).alias("ends"), F.xxhash64("gram").alias("key"))
    first = keyed.limit(max_set + 1).collect()  # bounded by max_set
    split = held(docs, words=words_of(F.col("text").cast("string"))).withColumn("n_words", F.size("words"))
    found = _by_set(split, first) if len(first) <= max_set else _by_join(split, windows)
    return found.withColumn("n_hit", _covered(F.col("hits"))).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit").cast("long") * ONE_IN >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, max_set=max_set)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, even where ``use`` refers to it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_hits(text: Column, hits: Column) -> Column:
    """The text without the words inside any hit and the gap before each."""
    gaps, words = F.split(text, _RAW_WORD, -1), F.regexp_extract_all(text, F.lit(f"({_RAW_WORD})"), F.lit(1))

    def cut(b: Column) -> Column:
        def piece(w: Column, i: Column) -> Column:
            return F.when(F.exists(b["hits"], lambda h: (h["pos"] <= i) & (i < h["pos"] + h["len"])), F.lit("")).otherwise(F.concat(F.get(b["gaps"], i), w))

        return F.concat(F.array_join(F.transform(b["words"], piece), ""), F.get(b["gaps"], F.size(b["words"])))

    return _bound(F.struct(gaps.alias("gaps"), words.alias("words"), hits.alias("hits")), cut)


def clean(docs: DataFrame, benchmark: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` without contaminated rows, and without the hit spans of the others; same columns."""
    columns = {c: F.col(c) for c in docs.columns}
    inner = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    found = scan(inner, benchmark, max_set=max_set).where(~F.col("contaminated"))
    text = F.when(F.size("hits") > 0, without_hits(F.col("text"), F.col("hits"))).otherwise(F.col("text"))
    return found.select(*[(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)) for c in columns])
