"""Personal data: fixed forms, and bootstrapped contexts that find more.

Matches of the fixed forms (email, ip, card, phone) are the seeds.  The words
around a seed are lexical patterns; whatever else stands in the same patterns
is an instance not yet known: a word, or up to six words in a row that hold
digits, without the punctuation at its edges and whatever its shape.  Spark
scores the bipartite graph of patterns and instances in rounds: a pattern's
confidence for a kind is the believed share of its distinct instances, an
instance's belief is one minus the product of its accepted patterns' doubts.
Patterns with enough distinct instances and confidence are accepted, and
instances with enough belief are spans of that kind where an accepted pattern
holds; those that could name somebody (six characters or more, with a digit or
an @) are spans wherever they stand, and what stands around them there is
evidence for the next round.

Everything is DataFrame expressions.  Texts are searched only for patterns that
enough known instances support; none is found without them.  Instances are
distinct without regard to case.  A pattern whose instances in a part of the
texts are already too many for its confidence is left out before the rest is
searched: more texts can only add instances, so nothing is lost by it.  What the
part does not hold says nothing, and what is accepted is counted over all texts.
Of a context word the ``NEAR`` characters next to the span count.

Defined results: null text is empty; repeated rows are judged one by one but
count once as evidence; an empty table gives no rows; other columns are kept by
``mask`` and not read otherwise.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, staged

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Distinct believed instances and confidence that a pattern needs, and belief that an instance needs.
SUPPORT, CONFIDENCE, BELIEF = 8, 0.8, 0.8
#: Characters of a context word that count.
NEAR = 100
#: Before all texts are searched, one text in so many is, to leave out patterns that cannot be accepted.
PARTS = (64, 8)
#: Hashed patterns that may travel with the tasks (about 30 bytes each); more are joined.
MAX_KEYS = 500_000

# The forms, written so that a run that cannot match is left at once: possessive runs, starts only where a run starts
# (or where the match before ended), and for cards only runs of 13 digits or more.
_FORM = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_GATE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(_FORM["card"]),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
# What may be an instance: up to six words with digits, a blank between them, or any word.
_PIECE = r"[^\s0-9]++(?!\S)|\S++(?: (?=\S*[0-9])\S++){0,5}"
_EDGE = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_LEAD, _TRAIL = rf"^(?:(?!\+[0-9]){_EDGE})*", rf"(?<!{_EDGE}){_EDGE}+$"
#: Stands for every character of a seed.
_BLOT = "\x00"
_SPANS = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches of a form with their code-point spans; those that fail their test are left out.

    The parts between matches and the matches themselves alternate, so running lengths give the spans.
    """
    empty = F.array().cast(_SPANS)
    parts, found = F.split(text, _FORM[kind], -1), F.regexp_extract_all(text, F.lit(_FORM[kind]), F.lit(0))
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["value"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("part"), b.alias("value")))
    spans = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(_GATE[kind](text), F.filter(spans, lambda s: _valid(kind, s["value"]))).otherwise(empty)


def _contexts(text: Column, s: Column) -> Column:
    """The two patterns around a span: the two words before it, and one word on each side; punctuation that touches it is left out."""
    reach = 4 * NEAR
    before = F.lower(F.substr(text, F.greatest(s["start"] - reach + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(reach)).cast("int")))
    after = F.lower(F.substr(text, (s["end"] + 1).cast("int"), F.lit(reach)))
    before = F.regexp_replace(before, rf"(?<!{_EDGE}){_EDGE}+$", "")
    two, one = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1), F.regexp_extract(before, r"(\S+)\s*$", 1)
    return _patterns(F.regexp_replace(two, r"\s+", " "), one, F.regexp_extract(after, rf"^{_EDGE}*+\s*(\S+)", 1))


def _patterns(two: Column, one: Column, after: Column) -> Column:
    return F.array(F.concat(F.right(two, F.lit(2 * NEAR)), F.lit(" _")), F.concat(F.right(one, F.lit(NEAR)), F.lit(" _ "), F.left(after, F.lit(NEAR))))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key and base spans in kind order for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.withColumns({k: matches(F.col("text"), k) for k in KINDS}).withColumn("base", F.concat(*KINDS))


def found_in(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, base spans in kind order, seen (every seed with its patterns), and the text with base spans blotted out."""
    rows = _texts(docs)
    seen = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), _contexts(F.col("text"), s).alias("patterns")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", "text_key", base.alias("base"), seen.alias("seen"), F.when(F.size("base") > 0, _shade(F.col("text"), F.col("base"))).otherwise(F.col("text")).alias("shade"))


def _shade(text: Column, spans: Column) -> Column:
    """The text with every span blotted out, at its length."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        blot = F.repeat(F.lit(_BLOT), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blot).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))


def pieces_in(found: DataFrame) -> DataFrame:
    """``doc_id, text_key, i, piece, patterns`` of every piece that is no seed, in lower case."""
    rows = held(found.select("doc_id", "text_key", F.lower("shade").alias("low")), pieces=F.regexp_extract_all("low", F.lit(f"({_PIECE})"), F.lit(1)))
    n, none = F.size("pieces"), F.array(F.lit(""))
    two_back, back, ahead = F.slice(F.concat(none, none, "pieces"), F.lit(1), n), F.slice(F.concat(none, "pieces"), F.lit(1), n), F.concat(F.slice("pieces", F.lit(2), n), none)
    each = rows.where(n > 0).select("doc_id", "text_key", F.posexplode(F.arrays_zip(two_back.alias("two_back"), back.alias("back"), F.col("pieces"), ahead.alias("ahead"))).alias("i", "x"))
    each = each.select("doc_id", "text_key", "i", F.col("x.two_back").alias("two_back"), F.col("x.back").alias("back"), F.col("x.pieces").alias("piece"), F.col("x.ahead").alias("ahead")).where(~F.contains("piece", F.lit(_BLOT)))
    last = lambda c: F.substring_index(c, " ", -1)
    two = F.when(F.contains("back", F.lit(" ")), F.substring_index("back", " ", -2)).when(F.col("two_back") == "", F.lit("")).otherwise(F.concat(last("two_back"), F.lit(" "), F.col("back")))
    return each.select("doc_id", "text_key", "i", "piece", _patterns(two, last("back"), F.substring_index("ahead", " ", 1)).alias("patterns"))


def _stripped(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns``, and ``lead, trail, instance``: a piece without the punctuation at its edges, and the lengths of that."""
    lead, trail = F.regexp_extract("piece", _LEAD, 0), F.regexp_extract("piece", _TRAIL, 0)
    rows = held(rows, lead=F.length(lead), trail=F.length(trail)).where(F.col("lead") < F.length("piece"))
    return rows.select(*columns, "lead", "trail", F.substr("piece", F.col("lead") + 1, F.length("piece") - F.col("lead") - F.col("trail")).alias("instance"))


def candidates_in(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, text_key, i, pattern, lead, trail, instance`` of every piece in one of ``patterns`` (pattern)."""
    each = pieces_in(found).select("doc_id", "text_key", "i", "piece", F.explode("patterns").alias("pattern"))
    few = patterns.select("pattern").distinct().limit(MAX_KEYS + 1).count() <= MAX_KEYS
    if few:  # equal hashes of different patterns do no harm: patterns are joined by their text later
        each = each.join(F.broadcast(patterns.select(F.xxhash64("pattern").alias("_key")).distinct()), F.xxhash64("pattern") == F.col("_key"), "left_semi")
    else:
        each = each.join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    return _stripped(each, "doc_id", "text_key", "i", "pattern")


def _telling(instance: Column) -> Column:
    return (F.length(instance) >= 6) & instance.rlike("[0-9@]")


def _told(found: DataFrame, *columns: str) -> DataFrame:
    """``columns, lead, trail, instance`` of every piece that could name somebody."""
    return _stripped(pieces_in(found).where(_telling(F.col("piece"))), *columns).where(_telling(F.col("instance")))


def _scored(found: DataFrame, scores: DataFrame, seeds: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """All distinct ``pattern, instance`` hits of the patterns that can be accepted, and ``pattern, kind, confidence`` of those that are."""

    def judged(hits: DataFrame, scores: DataFrame) -> DataFrame:
        """``scores`` with the confidence that the instances in ``hits`` and seeds leave; null where these hold none of a pattern."""
        wanted = scores.select("pattern").distinct()
        both = hits.join(wanted, "pattern", "left_semi").unionByName(seeds.select("pattern", "instance").join(wanted, "pattern", "left_semi"))
        instances = both.distinct().groupBy("pattern").agg(F.count("*").alias("instances"))
        return scores.join(instances, "pattern", "left").withColumn("confidence", F.col("mass") / F.col("instances")).drop("instances")

    for parts in PARTS:  # mass is of all texts, so confidence can only be too high here; a pattern that no text of the part holds stays
        part = found.where(F.pmod(F.xxhash64("text_key", F.lit("part")), F.lit(parts)) == 0)
        bounds = judged(candidates_in(part, scores).select("pattern", "instance").distinct(), scores)
        scores = staged(bounds.where(F.col("confidence").isNull() | (F.col("confidence") >= CONFIDENCE)).drop("confidence"), f"pii-possible-{label}")
    hits = staged(candidates_in(found, scores).select("pattern", "instance").distinct(), f"pii-hits-{label}")
    return hits, staged(judged(hits, scores).where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"), f"pii-accepted-{label}")


def discover(found: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """``doc_id, text_key, kind, start, end`` of what accepted patterns reveal; None if no pattern is accepted."""
    seen = found.select(F.inline("seen"))
    seeds = staged(seen.select(F.explode("patterns").alias("pattern"), F.col("value").alias("instance"), "kind").distinct(), "pii-edges").withColumn("belief", F.lit(1.0))
    known, accepted, beliefs = seeds, None, None
    for k in range(rounds):
        scores = staged(known.groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("belief").alias("mass")).where(F.col("support") >= SUPPORT), f"pii-scores-{k}")
        if scores.isEmpty():
            return None
        hits, accepted = _scored(found, scores, seeds, str(k))
        if accepted.isEmpty():
            return None
        evidence = hits.join(accepted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"))
        beliefs = staged(evidence.where(F.col("belief") >= BELIEF), f"pii-beliefs-{k}")
        if beliefs.isEmpty():
            return None
        if k < rounds - 1:
            placed = hits.join(accepted.select("pattern", "kind"), "pattern").join(beliefs, ["instance", "kind"])
            around = _told(found, "patterns").join(beliefs, "instance").withColumn("pattern", F.explode("patterns"))
            known = seeds.unionByName(placed.select(seeds.columns)).unionByName(around.select(seeds.columns)).distinct()
    best = beliefs.groupBy("instance").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind"))
    place = ["doc_id", "text_key", "i", "lead", "trail", "kind"]
    here = candidates_in(found, accepted).join(best, "instance").join(accepted, ["pattern", "kind"], "left_semi").select(place)
    anywhere = _told(found, "doc_id", "text_key", "i").join(best, "instance").select(place)
    spots = here.unionByName(anywhere).distinct().withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = spots.join(found.select("doc_id", "text_key", "shade"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    rows = held(rows, pieces=F.regexp_extract_all("shade", F.lit(f"({_PIECE})"), F.lit(1)), gaps=F.split("shade", _PIECE, -1))
    length = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda s, v: s + F.length(v))
    start = (length(F.col("gaps"), F.col("i") + 1) + length(F.col("pieces"), F.col("i")) + F.col("lead")).cast("long")
    return rows.select("doc_id", "text_key", "kind", start.alias("start"), (start + F.length(F.get("pieces", F.col("i"))) - F.col("lead") - F.col("trail")).alias("end"))


def _ordered(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    rank = F.expr("map(" + ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS)) + ")")
    keyed = F.transform(spans, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, spans (base and discovered, ordered) per row."""
    found = staged(found_in(docs), "pii-found")
    more = discover(found)
    if more is None:
        return found.select("doc_id", "text_key", "base", _ordered(F.col("base")).alias("spans"))
    more = more.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    both = found.select("doc_id", "text_key", "base").alias("a").join(more.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")), "left")
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return both.select("a.doc_id", "a.text_key", "base", _ordered(F.concat("base", F.coalesce("more", none))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return extract(docs).select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap, the earlier one holds."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        told = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], told).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every personal span masked; same columns and rows."""
    found = extract(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")).distinct()
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))
    joined = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    new = F.when(F.col("_spans").isNotNull(), masked(F.col("_text"), F.col("_spans"))).otherwise(F.col("_text"))
    return joined.select(*[(new.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c)) for c in docs.columns])
