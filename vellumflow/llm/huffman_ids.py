"""Token-id files: canonical length-limited Huffman coding in independent blocks.

Texts are encoded once and their ids staged.  Global id counts (at most one per
vocabulary entry) give code lengths by package-merge, limited to
``MAX_BITS`` so that one table lookup decodes one id.  Codes are canonical, so
the lengths alone restore them.  A shard holds the documents of one doc_id
range, ascending; each document is a run of blocks of at most ``BLOCK`` ids,
each starting at a byte, and the shard lists every block's bit offset.  Any
block decodes without the others; a shard's blocks are decoded side by side.

A folder holds all that reading needs: ``shards`` (rows of Parquet: ``shard,
part, doc_ids, doc_tokens, block_bits, payload``), ``lengths`` (``id, length``)
and ``format`` (``version, block``); any store that Spark reaches will do.  More
than 2^``MAX_BITS`` different ids take as many bits as they need, up to 24.

Defined results: null text is empty (only the end id); rows with one doc_id
follow each other in text-hash order, each with its own start; null doc_ids
come first; an empty table gives empty files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bpe import DEFAULT_BPE, byte_bpe
from .common import gone_at_exit, prepare, shared_dir, staged

MAX_BITS = 18
BLOCK = 512
#: Ids in one stored row, and documents in one range; both bound a task's memory, not the data.
PART_IDS = 1 << 20
RANGE_DOCS = 4000

FORMAT = 1
IDS_SCHEMA = "doc_id long, order_hash long, n_tokens long, ids binary"
SHARD_SCHEMA = "shard long, part long, doc_ids array<long>, doc_tokens array<long>, block_bits array<long>, payload binary"


def encode_documents(docs: DataFrame, end_id: int, vocabulary: str = DEFAULT_BPE, extra: str = "") -> DataFrame:
    """Ids of each row's whole text and ``end_id``, as little-endian 16-bit numbers (32-bit where the vocabulary needs it).

    ``extra`` names one string column to carry along.
    """
    prepare(docs.sparkSession)
    ranked = byte_bpe(vocabulary).proven()
    names = ["doc_id", "order_hash", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, ranked)
        kind = np.uint16 if max(bpe.size, end_id + 1) <= 1 << 16 else np.uint32
        for b in batches:
            n, ids = [], []
            for text in b.column("text"):
                got = np.append(bpe.encode(text.as_py() or ""), np.uint32(end_id))
                n.append(len(got))
                ids.append(got.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], [*names, "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("order_hash"), *([F.col(extra).cast("string").alias(extra)] if extra else []), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, order_hash long, " + (f"{extra} string, " if extra else "") + "n_tokens long, ids binary")


def unpack(blob: bytes, n: int) -> np.ndarray:
    """The ids of one staged row, as unsigned 32-bit numbers."""
    return np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32).astype(np.uint32)


def id_counts(ids: DataFrame) -> DataFrame:
    """Global count of every id: one partial histogram a task, then a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            sizes, blobs = b.column("n_tokens").to_pylist(), b.column("ids").to_pylist()
            for i, j in runs_of(sizes, PART_IDS):
                got = np.bincount(unpack(b"".join(blobs[i:j]), sum(sizes[i:j])), minlength=len(total))
                got[: len(total)] += total
                total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return ids.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits (MAX_BITS, or what so many ids need) by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    limit = limit or min(24, max(MAX_BITS, (len(used) - 1).bit_length()))
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weights))
        merged = merged[rank]
        packages = merged[0 : len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (len(used) - 1)
    length = np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in (length, id) order."""
    codes = np.zeros(len(lengths), np.uint64)
    code, previous = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - previous
            previous = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every ``MAX_BITS``-bit window: the id that it starts with, and that id's code length."""
    top = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.int64(1) << (top - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    n = int(spans.sum())
    symbol[:n], size[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbol, size


def encode_blocks(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, documents: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """Bits of consecutive documents' ids; each block of at most ``BLOCK`` ids starts at a byte.  Also each block's bytes.

    ``documents`` holds the number of ids of each document (one, by default).
    """
    documents = np.array([len(ids)]) if documents is None else documents
    size = lengths[ids].astype(np.int64)
    first = block_starts(documents)
    block_bytes = (np.add.reduceat(size, first) + 7) // 8
    begin = (np.cumsum(block_bytes) - block_bytes) * 8
    at = np.cumsum(size) - size
    at += np.repeat(begin - at[first], np.diff(np.append(first, len(ids))))
    # A code lies within two neighbouring 32-bit words; bits of different codes never overlap, so sums are unions.
    wide = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    where, total = at >> 5, int(block_bytes.sum())
    words = -(-total // 4) + 1
    out = np.bincount(where, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words + 1)
    out += np.bincount(where + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)
    return out.astype(">u4").tobytes()[:total], block_bytes


def block_starts(documents: np.ndarray) -> np.ndarray:
    """Positions of the first ids of all blocks of consecutive documents."""
    per = -(-documents // BLOCK)
    inner = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(np.cumsum(documents) - documents, per) + inner * BLOCK


def runs_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive sizes that sum to about ``most``; a larger one stands alone."""
    begin, held = 0, 0
    for k, n in enumerate(sizes):
        if k > begin and held + n > most:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def decode_blocks(payload: bytes, bits: np.ndarray, sizes: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All blocks of a shard side by side: blocks start at ``bits`` and hold ``sizes`` ids; returns the ids in order."""
    top = int(len(symbol) - 1).bit_length()
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-sizes, kind="stable")
    at, left = bits[order].astype(np.int64), sizes[order]
    start = (np.cumsum(sizes) - sizes)[order]
    out = np.empty(int(sizes.sum()), np.uint32)
    active = np.searchsorted(-left, -np.arange(int(sizes.max(initial=0))), side="left")
    shift, mask = 32 - top, np.uint32((1 << top) - 1)
    for step, n in enumerate(active):
        a = at[:n]
        code = (window[a >> 3] >> (shift - (a & 7)).astype(np.uint32)) & mask
        out[start[:n] + step] = symbol[code]
        a += length[code]
    return out


def write_shards(ids: DataFrame, lengths: np.ndarray, path: str) -> None:
    """Code the staged ids and write shards in ascending doc_id order, code lengths and format to the folder ``path``."""
    spark = ids.sparkSession
    bounds = range_bounds(ids)
    packed = spark.sparkContext.broadcast(lengths.tobytes())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.frombuffer(packed.value, np.uint8)
        codes = canonical_codes(size)
        for b in batches:
            bits, blocks = [], []
            sizes, blobs = b.column("n_tokens").to_pylist(), b.column("ids").to_pylist()
            for i, j in runs_of(sizes, PART_IDS):
                n = np.asarray(sizes[i:j], np.int64)
                payload, each = encode_blocks(unpack(b"".join(blobs[i:j]), int(n.sum())), codes, size, n)
                block_ends, byte_ends = np.cumsum(-(-n // BLOCK)).tolist(), np.append(0, np.cumsum(each))
                for first, last in zip([0, *block_ends], block_ends, strict=False):
                    bits.append(payload[byte_ends[first] : byte_ends[last]])
                    blocks.append(each[first:last].tolist())
            keep = ["shard", "doc_id", "order_hash", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(blocks, pa.list_(pa.int64())), pa.array(bits, pa.binary())], [*keep, "blocks", "bits"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, held, ids_held = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            blocks = np.concatenate([np.asarray(r[2], np.int64) for r in held])
            row = [shard, part, [r[0] for r in held], [r[1] for r in held], ((np.cumsum(blocks) - blocks) * 8).tolist(), b"".join(r[3] for r in held)]
            return pa.RecordBatch.from_pylist([dict(zip(SHARD_NAMES, row, strict=True))], schema=SHARD_ARROW)

        for b in batches:
            for s, d, n, blocks, bits in zip(*(b.column(x).to_pylist() for x in ("shard", "doc_id", "n_tokens", "blocks", "bits")), strict=True):
                if held and (s != shard or ids_held >= PART_IDS):
                    yield flush()
                    part, held, ids_held = part + 1 if s == shard else 0, [], 0
                elif s != shard:
                    part = 0
                shard = s
                held.append((d, n, blocks, bits))
                ids_held += n
        if held:
            yield flush()

    coded = ids.withColumn("shard", shard_of(F.col("doc_id"), bounds)).mapInArrow(code, "shard long, doc_id long, order_hash long, n_tokens long, blocks array<long>, bits binary")
    sized = coded.repartition(min(max(len(bounds) + 1, 1), 20_000), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "order_hash")
    sized.mapInArrow(gather, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/shards")
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id long, length int").coalesce(1).write.parquet(f"{path}/lengths")
    spark.createDataFrame([(FORMAT, BLOCK)], "version int, block int").coalesce(1).write.parquet(f"{path}/format")


SHARD_NAMES = ["shard", "part", "doc_ids", "doc_tokens", "block_bits", "payload"]
SHARD_ARROW = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("block_bits", pa.list_(pa.int64())), ("payload", pa.binary())])


def range_bounds(ids: DataFrame) -> list[int]:
    """Ascending first doc_ids of the second and later ranges, of about ``RANGE_DOCS`` rows each (at most 20,000 ranges)."""
    n = ids.count()
    ranges = min(-(-n // RANGE_DOCS), 20_000)
    if ranges < 2:
        return []
    found = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges).alias("q")).first()["q"]
    return sorted(set(found or []))


def shard_of(doc_id, bounds: list[int]):
    """Index of the range that holds ``doc_id``, by binary search in the expression's literal bounds."""
    if not bounds:
        return F.lit(0).cast("long")

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(F.coalesce(doc_id < F.lit(bounds[mid]), F.lit(True)), search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(bounds) <= 64:
        return search(0, len(bounds))
    # Many ranges: count the bounds that are not above the id, first among every 128th, then among the 128 after it.
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= doc_id))
    coarse = below(literal(bounds[::128]))
    fine = below(F.slice(literal(bounds), F.greatest(coarse - 1, F.lit(0)) * 128 + 1, F.lit(128)))
    return F.when(doc_id.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * 128 + fine).cast("long")


def read_lengths(spark: SparkSession, path: str) -> np.ndarray:
    """The code lengths of a folder's files; at most one for each vocabulary entry."""
    told = spark.read.parquet(f"{path}/format").first()
    if (told["version"], told["block"]) != (FORMAT, BLOCK):
        raise ValueError(f"files of format {told['version']} with blocks of {told['block']} ids")
    rows = spark.read.parquet(f"{path}/lengths").toArrow()
    at = rows.column("id").to_numpy()
    out = np.zeros(int(at.max(initial=0)) + 1, np.uint8)
    out[at] = rows.column("length").to_numpy()
    return out


def block_sizes(documents: np.ndarray) -> np.ndarray:
    """Ids in every block of consecutive documents."""
    per = -(-documents // BLOCK)
    sizes = np.full(int(per.sum()), BLOCK, np.int64)
    sizes[np.cumsum(per) - 1] = documents - (per - 1) * BLOCK
    return sizes


def read_block(spark: SparkSession, path: str, shard: int, part: int, block: int) -> np.ndarray:
    """The ids of one block, decoded from its bit offset alone."""
    row = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").where((F.col("shard") == shard) & (F.col("part") == part)).first()
    symbol, size = decode_table(read_lengths(spark, path))
    ids = block_sizes(np.asarray(row["doc_tokens"], np.int64))[block : block + 1]
    first = row["block_bits"][block] // 8
    return decode_blocks(bytes(row["payload"][first : first + BLOCK * 3 + 4]), np.zeros(1, np.int64), ids, symbol, size)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Decode a folder's files: per document doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    packed = spark.sparkContext.broadcast(read_lengths(spark, path).tobytes())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, size = decode_table(np.frombuffer(packed.value, np.uint8))
        for b in batches:
            for r in b.to_pylist():
                n = np.asarray(r["doc_tokens"], np.int64)
                ids = decode_blocks(r["payload"], np.asarray(r["block_bits"], np.int64), block_sizes(n), symbol, size)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].astype("<u4").tobytes()) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(n), pa.int64()), pa.array([r["part"]] * len(n), pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["shard", "part", "doc_id", "within", "n_tokens", "ids_crc32"])

    totals = shards.select("shard", "part", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    offsets = running_offsets(totals)
    rows = shards.mapInArrow(decode, "shard long, part long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["shard", "part"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def running_offsets(totals: DataFrame, group: int = 256) -> DataFrame:
    """Sum of ``n`` over all earlier (shard, part): within groups of shards, then over the few groups."""
    grouped = totals.withColumn("g", F.floor(F.col("shard") / group))
    inner = W.Window.partitionBy("g").orderBy("shard", "part").rowsBetween(W.Window.unboundedPreceding, -1)
    outer = W.Window.orderBy("g").rowsBetween(W.Window.unboundedPreceding, -1)
    base = grouped.groupBy("g").agg(F.sum("n").alias("g_n")).select("g", F.coalesce(F.sum("g_n").over(outer), F.lit(0)).alias("g_before"))
    return grouped.withColumn("in_group", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, "g").select("shard", "part", (F.col("g_before") + F.col("in_group")).alias("before"))


def write_ids(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str = DEFAULT_BPE) -> None:
    """Encode, count, code and write all texts to the folder ``path``."""
    ids = staged(encode_documents(docs, end_id, vocabulary), "ids")
    found = id_counts(ids).toArrow().to_pandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    write_shards(ids, code_lengths(counts), path)


def huffman_round_trip(docs: DataFrame, end_id: int = 0, vocabulary: str = DEFAULT_BPE) -> DataFrame:
    """Write all texts to a folder that goes with the driver's JVM, and read it back; one row per document from the files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/vellumflow-id-files-{uuid.uuid4().hex}"
    write_ids(docs, path, end_id, vocabulary)
    gone_at_exit(spark, path)
    return read_shards(spark, path)
