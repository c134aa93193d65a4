"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of documents.  In every round (one window of ``window``
tokens) a source's deficit grows by its target share of the window, and it
sends documents while they fit its deficit; what it could not send is carried
to the next round.  For a queue that always has work this has a closed form: a
document whose tokens end at position ``e`` of its queue leaves in the first
round ``r`` with ``r * share * window >= e``.  So rounds need only running sums
within each source, and deficits carry across windows and partitions with no
sequential driver.  Documents in (round, source, queue) order form one token
stream, which is cut at every ``window`` tokens: all sequences but the last are
full, and over any run of windows each source holds its share within one
document.

Targets default to each source's share of all tokens, so that every queue lasts
to the end; given targets hold until a queue runs out, and the rest then keep
their relative shares.  Sources without a target, or with none above zero, are
sent when all others are.

A queue's order is a hash of doc_id and text, so it does not depend on how the
input is split.  Running sums are taken in three levels (bounded buckets,
groups of bucket totals, group totals), so a source with a third of all rows is
spread over many tasks.

Defined results: null text is one end id; null sources form one queue; repeated
rows are packed one by one; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bpe import DEFAULT_BPE
from .common import staged
from .huffman_ids import encode_documents, unpack

WINDOW = 2048
#: Rows of a bucket and buckets of a group, each of which one task sorts for a running sum; bounds on memory, not on data.
BUCKET_ROWS, GROUP_BUCKETS = 500, 1_000


def sums_before(totals: DataFrame, by: list[str]) -> DataFrame:
    """``totals`` (by, bucket, n) to ``by, bucket, base``: the sum of ``n`` over all earlier buckets."""
    earlier = (W.Window.unboundedPreceding, -1)
    grouped = totals.withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    inner = W.Window.partitionBy(*by, "group").orderBy("bucket").rowsBetween(*earlier)
    outer = W.Window.partitionBy(*by).orderBy("group").rowsBetween(*earlier)
    top = grouped.groupBy(*by, "group").agg(F.sum("n").alias("group_n")).withColumn("group_base", F.coalesce(F.sum("group_n").over(outer), F.lit(0))).drop("group_n")
    within = grouped.withColumn("in_group", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return within.join(top, [*by, "group"]).select(*by, "bucket", (F.col("group_base") + F.col("in_group")).alias("base"))


def queue_ends(counts: DataFrame, quantum: DataFrame) -> DataFrame:
    """Adds ``queue_end``: tokens of the document's source up to and including it, in hash order; and the source's ``quantum``."""
    buckets = max(1, -(-counts.count() // BUCKET_ROWS))
    rows = counts.withColumn("queue_key", F.xxhash64("doc_id", "order_hash")).withColumn("bucket", F.floor((F.col("queue_key").cast("double") / 2.0**64 + 0.5) * buckets))
    within = W.Window.partitionBy("source", "bucket").orderBy("queue_key", "doc_id", "order_hash", "row_id").rowsBetween(W.Window.unboundedPreceding, 0)
    base = sums_before(rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")), ["source"]).join(quantum, "source", "left")
    ends = rows.withColumn("in_bucket", F.sum("n_tokens").over(within)).join(base, ["source", "bucket"])
    return ends.select("row_id", "source", "n_tokens", "quantum", (F.col("base") + F.col("in_bucket")).alias("queue_end"))


def stream_starts(ordered: DataFrame, rounds_per_bucket: int) -> DataFrame:
    """Adds ``stream_start``: tokens before the document in (round, source, queue) order."""
    rows = ordered.withColumn("bucket", F.floor(F.col("round") / rounds_per_bucket))
    base = sums_before(rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n")), [])
    within = W.Window.partitionBy("bucket").orderBy("round", "source", "queue_end", "row_id").rowsBetween(W.Window.unboundedPreceding, -1)
    return rows.withColumn("in_bucket", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, "bucket").withColumn("stream_start", F.col("base") + F.col("in_bucket")).drop("base", "in_bucket", "bucket")


def plan_stream(counts: DataFrame, window: int = WINDOW, targets: DataFrame | None = None) -> DataFrame:
    """``row_id, doc_id, order_hash, source, n_tokens`` to ``row_id, stream_start`` by deficit round-robin.

    ``targets`` (source, share) sets the mixture; shares need not sum to one.
    """
    if targets is None:
        share = counts.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("share"))
    else:
        given = targets.select(F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("share").cast("double").alias("share"))
        share = given.where((F.col("share") > 0) & (F.col("share") < float("inf"))).groupBy("source").agg(F.sum("share").alias("share"))
    total = share.agg(F.sum("share").alias("total")).first()["total"] or 1.0
    ends = queue_ends(counts, share.select("source", (F.col("share") / F.lit(total) * window).alias("quantum")))
    rounds = ends.withColumn("round", F.ceil(F.col("queue_end") / F.col("quantum")))
    if targets is not None:
        last = rounds.agg(F.max("round").alias("last")).first()["last"] or 0
        rounds = rounds.withColumn("round", F.coalesce("round", F.lit(last) + F.ceil(F.col("queue_end") / F.lit(window))))
    mean = counts.agg(F.avg("n_tokens").alias("m")).first()["m"] or 1.0
    return stream_starts(rounds.drop("quantum"), max(1, int(BUCKET_ROWS * mean / window))).select("row_id", "stream_start")


def cut(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece of each placed document, with the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            out: list[list[int]] = [[] for _ in names]
            for doc, n, blob, at in zip(*(b.column(x).to_pylist() for x in ("doc_id", "n_tokens", "ids", "stream_start")), strict=True):
                ids, done = unpack(blob, n).astype("<u4"), 0
                while done < n:
                    seq, offset = divmod(at + done, window)
                    length = min(window - offset, n - done)
                    for column, value in zip(out, (doc, done, length, zlib.crc32(ids[done : done + length].tobytes()), n, seq, offset), strict=True):
                        column.append(value)
                    done += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return placed.select("doc_id", "n_tokens", "ids", "stream_start").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 1, vocabulary: str = DEFAULT_BPE, targets: DataFrame | None = None) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source) into sequences of ``window`` tokens.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    ids = staged(encode_documents(docs.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(""))), end_id, vocabulary, extra="source").withColumn("row_id", F.monotonically_increasing_id()), "packing-ids")
    starts = plan_stream(ids.select("row_id", "doc_id", "order_hash", "source", "n_tokens"), window, targets)
    return cut(ids.select("row_id", "doc_id", "n_tokens", "ids").join(starts, "row_id"), window)
