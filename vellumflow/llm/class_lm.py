"""Class-based bigram language model: exchange clustering, class transitions, word emissions.

Every training word has a class.  The ``HEAD_UNITS`` most frequent words are
exchanged one by one, sweep after sweep: each moves to the class that most
raises the class bigram likelihood, while all other words stand together beside
them.  Then every other training word is moved by itself, in one distributed
sweep: its counts of classes before and after it, over all training text, say
in which class it raises the likelihood most.  Only words that training has not
seen have no class of their own; they take the class that holds most words seen
once, and there the share that smoothing leaves.  A token's probability is
P(class | class before) from smoothed transitions between the words' classes,
times P(word | class) from smoothed counts of all training words; it sums to
one over all words, the unseen one included.

Words with their counts and classes are a table of any size: words of the
``HEAD_WORDS`` most frequent (a proven bound) are looked up where the text is
read; each document's rarer words become rows that join the table and return
to their document, so nothing that grows with the corpus is broadcast or
collected.

Defined results: null text is empty and holds only the end token; repeated rows
are scored one by one; with an empty training fold every word is unseen and the
model is uniform; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

HEAD_UNITS = 2048
HEAD_WORDS = 100_000
CLASSES = 48
SWEEPS = 8
#: Additive smoothing of emissions, and the weight of class frequencies in transitions.
ADD, BACKOFF = 0.1, 20.0
#: The end token: no word holds a blank.
END = b" "
#: Units of the exchange beyond the head words: all other words together, and the end token.  Each keeps a class of its own.
OTHER_UNIT, END_UNIT = HEAD_UNITS, HEAD_UNITS + 1
UNITS = HEAD_UNITS + 2
END_CLASS, OTHER_CLASS = CLASSES, CLASSES + 1
#: Classes that may stand beside a word, cells of neighbour counts, and counts whose gains are tabled.
SIDES = CLASSES + 2
CELLS, SMALL = 2 * SIDES, 64
#: Stands for the class of a rarer word until the table of words gives it.
RARE = 255
#: A document's own row: has an id, id, training, tokens, known head tokens, their log counts, bytes of the class sequence; then that and the turns.
_OWN = "<?q?qqdq"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII blanks."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def token_stream(texts: list[str | None]) -> list[bytes]:
    """All tokens of some texts, an end token before the first and after each."""
    stream = [END]
    for t in texts:
        stream += words_of(t)
        stream.append(END)
    return stream


def count_words(texts: DataFrame) -> DataFrame:
    """Counts of all words and end tokens: ``word binary, n long``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            held[END] += b.num_rows
            held.update(chain.from_iterable(map(words_of, b.column("text").to_pylist())))
            if len(held) > 150_000:
                yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD_WORDS) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``, most frequent first: a count threshold from a log-scale histogram, then a filter."""
    level = F.floor(F.log2("n") * 64)
    bins = sorted(((r["level"], r["k"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, lowest = 0, None
    for at, k in bins:
        if total + k > most:
            break
        total, lowest = total + k, at
    if lowest is None:
        return []
    rows = counts.where(level >= F.lit(lowest)).toArrow().to_pandas()
    return sorted(zip(map(bytes, rows["word"]), rows["n"].tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def bigram_counts(texts: DataFrame, head: dict[bytes, int]) -> np.ndarray:
    """Unit bigram counts over all texts, end tokens on both sides: a matrix of bounded size."""
    shared = texts.sparkSession.sparkContext.broadcast({**head, END: END_UNIT})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, total, held = shared.value.get, np.zeros(UNITS * UNITS, np.int64), []

        def add() -> None:
            total[:] += np.bincount(np.concatenate(held), minlength=UNITS * UNITS)
            held.clear()

        for b in batches:
            stream = token_stream(b.column("text").to_pylist())
            u = np.fromiter(map(unit, stream, repeat(OTHER_UNIT)), np.int64, len(stream))
            held.append(u[:-1] * UNITS + u[1:])
            if sum(map(len, held)) > 2_000_000:
                add()
        if held:
            add()
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["cell", "n"])

    rows = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS * UNITS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(UNITS, UNITS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit; the last two units, all other words and the end token, keep the classes ``classes + 1`` and ``classes``."""
    units, k = len(bigrams) - 2, classes + 2
    n = bigrams.astype(np.float64)
    mass = n.sum(axis=1)
    order = np.argsort(-mass[:units], kind="stable")
    cls = np.empty(units + 2, np.int64)
    cls[order] = np.arange(units) % classes
    cls[units:] = classes + 1, classes
    one = np.zeros((units + 2, k))
    one[np.arange(units + 2), cls] = 1.0
    table = one.T @ n @ one
    left, right = table.sum(axis=1), table.sum(axis=0)
    cols = n.T.copy()
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not mass[w] and not cols[w].any():
                continue
            out = np.bincount(cls, weights=n[w], minlength=k)
            into = np.bincount(cls, weights=cols[w], minlength=k)
            own, old = n[w, w], cls[w]
            out[old] -= own
            into[old] -= own
            w_left, w_right = out.sum() + own, into.sum() + own
            table[old, :] -= out
            table[:, old] -= into
            table[old, old] -= own
            left[old] -= w_left
            right[old] -= w_right
            rows = _xlogx(table + out) - _xlogx(table)
            columns = (_xlogx(table.T + into) - _xlogx(table.T))
            diagonal = np.diag(table)
            gain = rows.sum(axis=1) - np.diag(rows) + columns.sum(axis=1) - np.diag(columns) + _xlogx(diagonal + out + into + own) - _xlogx(diagonal)
            gain -= _xlogx(left + w_left) - _xlogx(left) + _xlogx(right + w_right) - _xlogx(right)
            gain[classes:] = -np.inf
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            moved += new != old
            cls[w] = new
            table[new, :] += out
            table[:, new] += into
            table[new, new] += own
            left[new] += w_left
            right[new] += w_right
        if not moved:
            break
    return cls


def neighbour_counts(texts: DataFrame, units: dict[bytes, int], cls: np.ndarray) -> DataFrame:
    """``word binary, cells binary``: counts of classes around every word that is not a unit of its own.

    A cell is a class before the word, or SIDES plus a class after it; each is packed as count * 128 + cell.
    A word has one row for each flush of a task, none is left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast({**{w: int(cls[u]) for w, u in units.items()}, END: END_CLASS})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {w: i for i, w in enumerate(shared.value)}
        classes, first = np.fromiter(shared.value.values(), np.int64, len(heads)), len(heads)
        ids, held, size = dict(heads), [], 0

        def flush() -> pa.RecordBatch:
            names = list(ids)[first:]
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            word, at = np.divmod(keys, CELLS)
            starts = np.searchsorted(word, np.arange(first, first + len(names) + 1)) * 4
            cells = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer((n * 128 + at).astype(np.uint32))])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), cells], ["word", "cells"])

        for b in batches:
            stream = token_stream(b.column("text").to_pylist())
            number = ids.setdefault  # a new word gets the next number
            w = np.fromiter((number(x, len(ids)) for x in stream), np.int64, len(stream))
            c = np.full(len(w), OTHER_CLASS)
            known = w < first
            c[known] = classes[w[known]]
            at = np.flatnonzero(~known)
            held += [w[at] * CELLS + c[at - 1], w[at] * CELLS + SIDES + c[at + 1]]
            size += len(at)
            if len(ids) - first > 150_000 or size > 3_000_000:
                if len(ids) > first:
                    yield flush()
                ids, held, size = dict(heads), [], 0
        if len(ids) > first:
            yield flush()

    return texts.mapInArrow(run, "word binary, cells binary")


class Placer:
    """The best class of words by their neighbours, against the units' class bigrams."""

    def __init__(self, table: np.ndarray):
        left, right = table.sum(axis=1)[:CLASSES], table.sum(axis=0)[:CLASSES]
        #: For every cell, the bigrams that a word in class g would add to.
        self.cells = np.concatenate([table, table.T])[:, :CLASSES]
        small = np.arange(SMALL)[:, None, None]
        self.added = self._step(self.cells, small).astype(np.float32)
        self.sides = left, right
        once = self.added[1] - (self._step(left, 1) + self._step(right, 1)) / 2
        #: The class of a word that stands once, between two classes.
        self.single = (once[:SIDES, None] + once[None, SIDES:]).argmax(axis=2)

    @staticmethod
    def _step(x: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        return _xlogx(x + k) - _xlogx(x)

    def place(self, words: int, owner: np.ndarray, cell: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and class of every word; ``owner`` (sorted) says whose cell it is, each (owner, cell) once in order."""
        n = np.bincount(owner, weights=np.where(cell < SIDES, k, 0), minlength=words)
        begin, once, found = np.searchsorted(owner, np.arange(words)), n == 1, np.empty(words, np.int64)
        found[once] = self.single[cell[begin[once]], cell[begin[once] + 1] - SIDES]
        rest = np.flatnonzero(~once)
        if len(rest):
            of = np.flatnonzero(~once[owner])
            cell, k = cell[of], k[of]
            added = self.added[np.minimum(k, SMALL - 1), cell]
            many = np.flatnonzero(k >= SMALL)
            added[many] = self._step(self.cells[cell[many]], k[many, None])
            gain = np.add.reduceat(added, np.searchsorted(owner[of], rest), axis=0, dtype=np.float64)
            left, right = self.sides
            gain -= self._step(left, n[rest, None]) + self._step(right, n[rest, None])
            found[rest] = gain.argmax(axis=1)
        return n.astype(np.int64), found


def placed_words(neighbours: DataFrame, table: np.ndarray) -> DataFrame:
    """``word binary, n long, cls int`` of every word in ``neighbours``."""
    shared = neighbours.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = Placer(shared.value)

        def done(words: list[bytes], cells: list[bytes]) -> pa.RecordBatch:
            fresh = np.fromiter((i == 0 or words[i] != words[i - 1] for i in range(len(words))), bool, len(words))
            names = [words[i] for i in np.flatnonzero(fresh).tolist()]
            code = np.frombuffer(b"".join(cells), np.uint32).astype(np.int64)
            owner = np.repeat(np.cumsum(fresh) - 1, np.fromiter(map(len, cells), np.int64, len(cells)) // 4)
            keys, at = np.unique(owner * CELLS + code % 128, return_inverse=True)
            k = np.bincount(at, weights=code // 128, minlength=len(keys)).astype(np.int64)
            n, found = placer.place(len(names), keys // CELLS, keys % CELLS, k)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n), pa.array(found, pa.int32())], ["word", "n", "cls"])

        words: list[bytes] = []
        cells: list[bytes] = []
        for b in batches:
            words += b.column("word").to_pylist()
            cells += b.column("cells").to_pylist()
            if len(words) > 20_000:
                # The last word may go on in the next batch.
                end = len(words) - 1
                while end and words[end - 1] == words[-1]:
                    end -= 1
                if end:
                    yield done(words[:end], cells[:end])
                    words, cells = words[end:], cells[end:]
        if words:
            yield done(words, cells)

    return neighbours.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, cls int")


def place(texts: DataFrame) -> tuple[dict, DataFrame]:
    """The bounded part of the classes, and ``word, n, cls`` of all training words and the end token."""
    spark = prepare(texts.sparkSession, 500)
    counted = staged(count_words(texts), "word-counts")
    of_end = F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("n")).otherwise(0))
    size = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(of_end, F.lit(0)).alias("ends")).first()
    frequent = head_words(counted)
    units = {w: i for i, (w, _) in enumerate([x for x in frequent if x[0] != END][:HEAD_UNITS])}
    cls = exchange(bigrams := bigram_counts(texts, units))
    one = np.zeros((UNITS, SIDES))
    one[np.arange(UNITS), cls] = 1.0
    n = dict(frequent)
    alone = [(bytearray(w), int(n[w]), int(cls[u])) for w, u in units.items()]
    alone += [(bytearray(END), int(size["ends"]), END_CLASS)] if size["ends"] else []
    placed = placed_words(neighbour_counts(texts, units, cls), one.T @ bigrams @ one)
    counts = staged(placed.unionByName(spark.createDataFrame(alone, "word binary, n long, cls int")), "word-classes")
    rows = counts.where(F.col("n") >= F.lit(frequent[-1][1] if frequent else 1 << 62)).toArrow()  # those of ``frequent``
    found = dict(zip(rows.column("word").to_pylist(), rows.column("cls").to_pylist(), strict=True))
    words, mass, once = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.count("*").alias("words"), F.sum("n").alias("mass"), F.count_if(F.col("n") == 1).alias("once")).collect():
        words[r["cls"]], mass[r["cls"]] = r["words"], r["mass"]
        once[min(r["cls"], CLASSES - 1)] += r["once"] * (r["cls"] < CLASSES)
    unseen = int(once.argmax())
    words[unseen] += 1
    with np.errstate(divide="ignore"):
        spread = np.log10(np.where(words > 0, mass + ADD * words, 1.0))
    return {"unseen": unseen, "spread": spread, "head": frequent, "head_cls": np.array([found[w] for w, _ in frequent], np.uint8), "ends": int(size["ends"]), "n": int(size["n"]), "v": int(size["v"])}, counts


class Scorer:
    """The bounded part of the model: head words with their counts and classes."""

    def __init__(self, model: bytes):
        m = pickle.loads(model)
        self.index = {w: i for i, (w, _) in enumerate(m["head"])}
        self.head_cls, self.head_log = m["head_cls"], np.log10(np.array([c for _, c in m["head"]], np.float64) + ADD)
        self.end_log, self.end_known = float(np.log10(m["ends"] + ADD)), int(m["ends"] > 0)

    def read(self, text: str | None) -> tuple[int, int, float, np.ndarray, np.ndarray, list[bytes]]:
        """Tokens, known head tokens and their log counts, all tokens' classes with the end token on both sides, and the rarer words:
        where they stand is class RARE, in turn the numbers of distinct ones."""
        words = words_of(text)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        seq = np.full(len(words) + 2, END_CLASS, np.uint8)
        known, gaps = at >= 0, np.flatnonzero(at < 0)
        seq[1:-1][known] = self.head_cls[at[known]]
        seq[gaps + 1] = RARE
        rare: dict[bytes, int] = {}
        turn = np.fromiter((rare.setdefault(words[i], len(rare)) for i in gaps.tolist()), np.uint32, len(gaps))
        return len(words) + 1, int(known.sum()) + self.end_known, float(self.head_log[at[known]].sum()) + self.end_log, seq, turn, list(rare)


@lru_cache(maxsize=1)
def _scorer(model: bytes) -> Scorer:
    return Scorer(model)


def classed(docs: DataFrame, base: dict, counts: DataFrame) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, logs, seq`` of every row of ``docs`` (doc_id, train, text): the log counts of its
    tokens, and the classes of all its tokens between end tokens, a byte each."""
    spark = prepare(docs.sparkSession, 500)
    shared = spark.sparkContext.broadcast(pickle.dumps(base, protocol=5))
    schema = pa.schema([("row_id", pa.int64()), ("at", pa.int32()), ("word", pa.binary()), ("own", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)

        def done() -> pa.RecordBatch:
            size = np.asarray(sizes)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) - 1
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size), pa.int64()), pa.array(at, pa.int32()), pa.array(words, pa.binary()), pa.array(owns, pa.binary())], schema=schema)

        for b in batches:
            ids, sizes, words, owns = [], [], [], []
            for row, doc, train, text in zip(b.column("row_id").to_pylist(), b.column("doc_id").to_pylist(), b.column("train").to_pylist(), b.column("text"), strict=True):
                tokens, known, logs, seq, turn, rare = scorer.read(text.as_py())
                ids.append(row)
                sizes.append(len(rare) + 1)
                # The document's own row carries a word that matches nothing and, unlike a null, spreads evenly.
                words.append(b" %d" % row)
                words += rare
                owns.append(struct.pack(_OWN, doc is not None, doc or 0, train, tokens, known, logs, len(seq)) + seq.tobytes() + turn.tobytes())
                owns += repeat(None, len(rare))
                if len(words) > 50_000:
                    yield done()
                    ids, sizes, words, owns = [], [], [], []
            if ids:
                yield done()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = struct.calcsize(_OWN)

        def done(rows: pa.Table) -> pa.RecordBatch:
            at, n, cls = (rows.column(c).to_numpy() for c in ("at", "n", "cls"))
            begin, log = np.flatnonzero(at < 0), np.log10(n + ADD)
            out: list[list] = [[] for _ in range(6)]
            for a, own in zip(begin.tolist(), rows.column("own").take(pa.array(begin)).to_pylist(), strict=True):
                has, doc, train, tokens, known, logs, size = struct.unpack_from(_OWN, own)
                seq = own[top : top + size]
                of = np.frombuffer(own, np.uint32, offset=top + size) + a + 1  # a document's rarer words follow it in turn
                if len(of):
                    known += int((n[of] > 0).sum())
                    logs += log[of].sum()
                    whole = np.frombuffer(seq, np.uint8).copy()
                    whole[whole == RARE] = cls[of]
                    seq = whole.tobytes()
                for column, x in zip(out, (doc if has else None, train, tokens, known, logs, seq), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "train", "n_tokens", "n_known", "logs", "seq"])

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > 20_000:
                rows = pa.Table.from_batches(held)
                end = int(np.flatnonzero(rows.column("at").to_numpy() < 0)[-1])  # the last document may go on
                if end:
                    yield done(rows[:end])
                held, size = rows[end:].to_batches(), rows.num_rows - end
        if size:
            yield done(pa.Table.from_batches(held))

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "train", F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(split, "row_id long, at int, word binary, own binary")
    joined = parts.join(counts, "word", "left").select("row_id", "at", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cls", F.lit(base["unseen"])).alias("cls"), "own")
    return joined.repartition("row_id").sortWithinPartitions("row_id", "at").mapInArrow(gather, "doc_id long, train boolean, n_tokens long, n_known long, logs double, seq binary")


def transitions(rows: DataFrame) -> np.ndarray:
    """Log10 probabilities of a class after a class, from the sequences of ``rows``."""
    side = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, np.int64)
        for b in batches:
            for seq in b.column("seq").to_pylist():
                c = np.frombuffer(seq, np.uint8).astype(np.int64)
                total += np.bincount(c[:-1] * side + c[1:], minlength=side * side)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    table = np.zeros(side * side)
    for r in rows.select("seq").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most side * side
        table[r["cell"]] = r["n"]
    table = table.reshape(side, side)
    prior = (table.sum(axis=0) + 1) / (table.sum() + side)
    return np.log10((table + BACKOFF * prior) / (table.sum(axis=1, keepdims=True) + BACKOFF))


def fit(texts: DataFrame) -> tuple[bytes, DataFrame, dict[str, int]]:
    """The bounded part of the model, the table of all words' counts and classes, and N and V."""
    base, counts = place(texts)
    rows = classed(texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("train"), "text"), base, counts)
    return pickle.dumps({**base, "moves": transitions(rows)}, protocol=5), counts, {"n": base["n"], "v": base["v"]}


def score(rows: DataFrame, base: dict, moves: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity for every row of ``classed``."""
    shared = rows.sparkSession.sparkContext.broadcast((moves, base["spread"], float(np.log10(base["n"] + ADD * (base["v"] + 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, spread, base_spread = shared.value
        steps = moves - spread[None, :]
        for b in batches:
            gains = []
            for seq in b.column("seq").to_pylist():
                c = np.frombuffer(seq, np.uint8)
                gains.append(steps[c[:-1], c[1:]].sum())
            logs, tokens = b.column("logs").to_numpy(), b.column("n_tokens").to_numpy()
            total = logs + np.array(gains, np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("n_known"), pa.array(logs - tokens * base_spread), pa.array(total), pa.array(10.0 ** (-total / tokens))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    found = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
    return found.select("doc_id", "n_tokens", "n_known", F.lit(base["n"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def fit_and_score(docs: DataFrame, train: Column) -> DataFrame:
    """Learn from the rows that satisfy ``train``, score all rows."""
    base, counts = place(docs.where(train).select(F.col("text").cast("string").alias("text")))
    rows = staged(classed(docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), "text"), base, counts), "word-sequences")
    return score(rows, base, transitions(rows.where("train")))
