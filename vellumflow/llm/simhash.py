"""SimHash near-duplicate groups with pivot distance tables.

Each distinct fingerprint gets a table row of Hamming distances to ``PIVOTS``
reference fingerprints, computed once and carried with it.  Two fingerprints within distance d
differ by at most d in every coordinate, so a pair whose largest coordinate
difference exceeds d is discarded without being compared; survivors are
verified bit by bit.

Which pairs meet at all follows from the pigeonhole principle: split into
``b`` bit blocks, fingerprints within 3 bits agree on some b-3 of them, so each
fingerprint is filed under every choice of b-3 blocks (``b`` grows with the
number of fingerprints so that files stay small).  A file of more than
``FILE_ROWS`` is split into blocks of pairs of sub-files, so no task holds an
unbounded group, and every task reports a spanning forest of its links, never
all pairs.  Rows of a fingerprint that more than one row in ``HOT_SHARE`` has
(so less than that many fingerprints) meet its component in shares.  Components then come from alternating large-star and small-star
rounds on the forest, each round staged in the shared folder.

Defined results: null or blank text has fingerprint 0, linked like any other;
repeated rows keep one row each; null doc_ids take part and never become a
component id unless all members are null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, shuffle_width, staged

RADIUS = 3
PIVOTS = 24
FILE_ROWS = 4096
HOT_SHARE = 1000


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit fingerprint of a text's word shingles."""
    import xxhash

    if not text:
        return 0
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, 42)]
    else:
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(raw), 16384):
        ones += np.unpackbits(raw[k : k + 16384], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row's whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((simhash(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances (rows: fingerprints) to fixed random reference fingerprints."""
    references = np.random.default_rng(20240229).integers(0, 2**64, pivots, np.uint64)
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for every component of the links (u, v): its smallest member and the others."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    others = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[others]], nodes[others]


def with_pivots(nodes: DataFrame) -> DataFrame:
    """``fp, pivots``: every fingerprint with its row of the pivot distance table, a byte a distance."""
    prepare(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pivot_table(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(table))])
            yield pa.RecordBatch.from_arrays([b.column("fp"), rows.cast(pa.binary())], ["fp", "pivots"])

    return nodes.select("fp").mapInArrow(run, "fp long, pivots binary")


def _links(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between fingerprints (as unsigned, with their pivot distances) that share a key; keys are sorted."""
    held_u, held_v, held = [], [], 0
    step, i = 1, np.flatnonzero(keys[1:] == keys[:-1]) if len(keys) > 1 else np.zeros(0, np.int64)
    while len(i):
        near = i[np.abs(table[i, 0] - table[i + step, 0]) <= radius]
        for p in range(1, table.shape[1], 4):
            if not len(near):
                break
            near = near[np.abs(table[near, p : p + 4] - table[near + step, p : p + 4]).max(axis=1) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        held_u.append(fps[near])
        held_v.append(fps[near + step])
        held += len(near)
        if held > 1_000_000:
            u, v = _forest(np.concatenate(held_u), np.concatenate(held_v))
            held_u, held_v, held = [u], [v], len(u)
        step += 1
        i = i[i + step < len(keys)]
        i = i[keys[i] == keys[i + step]]
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(held_u), np.concatenate(held_v))


def files_of(nodes: DataFrame, count: int, radius: int) -> DataFrame:
    """Each fingerprint under every choice of ``b - radius`` of ``b`` bit blocks: ``file, fp, pivots``."""
    blocks = radius + 2
    while count / 2 ** (64 * (blocks - radius) / blocks) > 1 / 16 and blocks < radius + 5:
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for choice, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(choice), F.col("fp").bitwiseAND(F.lit(signed).cast("long"))))
    return nodes.select("fp", "pivots", F.explode(F.array(*keys)).alias("file"))


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest's links ``u, v`` of all pairs of fingerprints within ``radius`` bits, found file by file."""
    nodes = staged(with_pivots(nodes), "pivot-table")
    filed = files_of(nodes, nodes.count(), radius)
    hot = filed.groupBy("file").agg(F.count("*").alias("rows")).where(F.col("rows") > FILE_ROWS).select("file", F.ceil(F.col("rows") / FILE_ROWS).alias("parts"))
    own = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    split = filed.join(hot, "file", "left").select("file", "fp", "pivots", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
    keyed = split.select(F.xxhash64("file", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, table = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, PIVOTS), np.int8)

        def answer(n: int) -> pa.RecordBatch:
            u, v = _links(keys[:n], fps[:n], table[:n], radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            keys = np.concatenate([keys, b.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            table = np.concatenate([table, np.frombuffer(b"".join(b.column("pivots").to_pylist()), np.int8).reshape(-1, PIVOTS)])
            if len(keys) >= 200_000:
                n = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if n:
                    yield answer(n)
                    keys, fps, table = keys[n:], fps[n:], table[n:]
        if len(keys):
            yield answer(len(keys))

    prepare(nodes.sparkSession, 20_000)
    return keyed.repartition(shuffle_width(nodes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node: alternating large-star and small-star rounds until nothing changes."""
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = staged(small.select("a", "b"), "star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        state = now


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    prints = staged(fingerprints(docs), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "nodes")
    roots = connected(near_links(nodes.select("fp"), radius))
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    share = max(nodes.agg(F.sum("copies").alias("n")).first()["n"] or 0, HOT_SHARE) / HOT_SHARE
    parts = F.when(F.col("copies") > share, F.ceil(F.col("copies") / share)).otherwise(F.lit(1)).cast("int")
    named = linked.join(lowest, "root").select("fp", "component_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    hot = nodes.where(F.col("copies") > share).select(F.col("fp").alias("hot"), parts.alias("parts"))  # less than HOT_SHARE rows
    dealt = prints.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left").select("doc_id", "fp", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    return dealt.join(named, ["fp", "part"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` that are the first of their group (smallest doc_id; rows that repeat it stay together); same columns."""
    name = free_name(docs, "first")
    first = components(docs.select("doc_id", "text"), radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
