"""Language identification of mixed-language text.

Texts are cut into words at blanks and where the script of letters changes.  A
word's script narrows its candidates to the languages that training saw in that
script; character n-grams score the word under each candidate and no other;
Viterbi with a penalty for every switch then labels the words, and runs of one
label are spans.  A document's language is the one whose spans hold most
letters, its score their share.

The model is fitted on a bounded sample of labelled rows (``TRAIN_DOCS``,
chosen by a hash of doc_id and text), of which small languages give all their
rows and large ones equal shares; every whole text is labelled.  All tables
keep to ``CELLS`` cells: with more languages, n-grams share fewer buckets.

Defined results: ``und`` with score 0 for null texts and texts without a
letter, or where nothing was learned; letters of a script that no language was
learned in take the label around them and count for no language, so a text of
nothing else has score 0; equal shares go to the language first in the
alphabet; repeated rows are labelled one by one; rows with null lang teach
nothing; an empty table gives an empty table; other columns are not read.
``keep_identified`` keeps every text that has a letter if nothing was learned,
as there is no language then to reject it by.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Labelled rows used for fitting, at most (in expectation); a bounded sample is enough for n-gram tables.
TRAIN_DOCS = 12_000
#: Languages that can be learned; the most frequent labels of all labelled rows.
MAX_LANGS = 8192
#: Cells of the n-gram table, of the table of known words, and a quarter of those of texts that wait for Viterbi.
CELLS = 1 << 23
#: Hash buckets of character n-grams, at most.
BUCKETS = 1 << 17
#: Score of a language that is no candidate: no text can make up for it.
EXCLUDED = -1e6
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script if at least this share of its training letters are in it.
SCRIPT_SHARE = 0.02
WORD_LIMIT = 200_000

# First code points of script ranges, and the script that each begins.
SCRIPT_STARTS = [0x0000, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0xAC00, 0xD7B0]
SCRIPT_NAMES = ["latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "bengali", "indic", "thai", "lao", "georgian", "hangul", "other", "latin", "greek", "other", "hiragana", "katakana", "han", "hangul", "other"]


_FOREIGN = re.compile("[^\x00-\u024f\u1e00-\u1eff\u2000-\u206f]")


def _script(letter: str) -> str:
    return SCRIPT_NAMES[bisect_right(SCRIPT_STARTS, ord(letter)) - 1]


def script_of(word: str) -> str:
    """Script of the word's first letter; empty for no letter."""
    return next((_script(c) for c in word if c.isalpha()), "")


def cut(word: str) -> list[str]:
    """The word cut where the script of its letters changes; other characters stay with the letters before them."""
    out, start, script = [], 0, ""
    for i, c in enumerate(word):
        if c.isalpha():
            now = _script(c)
            if script and now != script:
                out.append(word[start:i])
                start = i
            script = now
    return [*out, word[start:]]


def raw_words(text: str) -> list[str]:
    """Words of a text as they are written."""
    return [p for w in text.split() for p in cut(w)] if _FOREIGN.search(text) else text.split()


def words_of(text: str) -> list[str]:
    """Words of a text in lower case, as many as ``raw_words``."""
    return [w.lower() for w in raw_words(text)] if _FOREIGN.search(text) else text.lower().split()


def buckets_for(langs: int) -> int:
    """Buckets of n-grams, a power of two, so that the table keeps to CELLS."""
    return min(BUCKETS, 1 << (CELLS // max(langs, 1)).bit_length() - 1)


def ngram_hashes(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- and 3-grams of words framed by one blank before and two after, and where each word's begin."""
    codes = np.frombuffer((" " + "   ".join(words) + "    ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 3 for w in words), np.int64, len(words))
    begin = np.cumsum(size) - size
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    two = ((a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(buckets)
    three = ((a * np.uint64(0xC2B2AE3D) + b * np.uint64(0x27D4EB2F) + c * np.uint64(0x165667B1)) >> np.uint64(5)) % np.uint64(buckets)
    return np.stack([two, three])[:, : int(size.sum())].astype(np.int64), begin


def even_share(sizes: list[int], most: int) -> float:
    """The largest number of rows that every language may give so that all together give ``most``; smaller ones give all."""
    left = float(most)
    for k, n in enumerate(sorted(sizes)):
        share = left / (len(sizes) - k)
        if n > share:
            return share
        left -= n
    return float(max(sizes, default=0))


def learnable(docs: DataFrame, fold_ok: Column) -> DataFrame:
    """The bounded training sample: labelled rows of the fold, of every learned language, thinned by a hash of doc_id and text where there are many.

    The languages are the most frequent labels of all these rows, so one with few rows is learned from each of them.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & fold_ok)
    lang = F.col("lang").cast("string")
    found = rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    share = even_share([r["n"] for r in found], TRAIN_DOCS)
    parts = {r["lang"]: 1_000_000_000 if r["n"] <= share else int(1_000_000_000 * share / r["n"]) + 1 for r in found}
    part = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), lang) if parts else F.lit(0)
    rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("sample")), F.lit(1_000_000_000)) < F.coalesce(part, F.lit(0)))
    return rows.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))


def fit(sample: DataFrame) -> bytes:
    """Script shares and n-gram log-likelihoods for every learned language, in at most CELLS cells."""
    spark = prepare(sample.sparkSession)
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # at most MAX_LANGS
    buckets, shared = buckets_for(len(langs)), spark.sparkContext.broadcast({x: j for j, x in enumerate(langs)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        grams: dict[int, np.ndarray] = {}
        scripts: dict[tuple[int, str], int] = {}

        def rows(lang: np.ndarray, script: list[str], bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(script, pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["lang", "script", "bucket", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for j, found in grams.items():
                at = np.flatnonzero(found)
                yield rows(np.full(len(at), j), [""] * len(at), at, found[at])
            grams.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = [w for w in words_of(text) if any(c.isalpha() for c in w)]
                if not words:
                    continue
                j = index[lang]
                found = np.bincount(ngram_hashes(words, buckets)[0].ravel(), minlength=buckets)
                grams[j] = grams[j] + found if j in grams else found
                for w in words:
                    key = (j, "latin" if w.isascii() else script_of(w))
                    scripts[key] = scripts.get(key, 0) + len(w)
            if len(grams) * buckets > CELLS:
                yield from flush()
        yield from flush()
        if scripts:
            yield rows(np.array([k[0] for k in scripts]), [k[1] for k in scripts], np.full(len(scripts), -1), np.array(list(scripts.values())))

    found = sample.mapInArrow(count, "lang int, script string, bucket int, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n"))
    rows = found.where("bucket >= 0").select("lang", "bucket", "n").toArrow()
    n = np.zeros((buckets, len(langs)), np.int64)
    n[rows.column("bucket").to_numpy(), rows.column("lang").to_numpy()] = rows.column("n").to_numpy()
    seen = [(r["lang"], r["script"], r["n"]) for r in found.where("bucket < 0").collect()]  # at most languages x scripts
    letters = np.zeros(len(langs))
    for j, _, k in seen:
        letters[j] += k
    kept = np.flatnonzero(letters)
    weights = np.empty((buckets, len(kept)), np.float32)
    for i, j in enumerate(kept):
        column = n[:, j] + 0.05
        weights[:, i] = np.log(column / column.sum())
    masks = {script: np.zeros(len(langs), bool) for _, script, _ in seen}
    for j, script, k in seen:
        masks[script][j] = k >= SCRIPT_SHARE * letters[j]
    return pickle.dumps(([langs[j] for j in kept], weights, {k: m[kept] for k, m in masks.items() if m.any()}))


class Labeller:
    def __init__(self, model: bytes):
        #: ``masks``: the languages that are candidates for a script.
        self.langs, self.weights, self.masks = pickle.loads(model)
        self.most = max(4096, min(WORD_LIMIT, CELLS // max(len(self.langs), 1)))
        self.words: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)
        #: Letters of each word, and those of them in a script that some language was learned in.
        self.letters, self.sure = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        letters = np.fromiter((sum(map(str.isalpha, w)) if not w.isalpha() else len(w) for w in new), np.int64, len(new))
        scores, sure = np.zeros((len(new), len(self.langs)), np.float32), np.zeros(len(new), np.int64)
        groups: dict[str, list[int]] = {}
        for i, (w, n) in enumerate(zip(new, letters.tolist(), strict=True)):
            if n:
                groups.setdefault("latin" if w.isascii() else script_of(w), []).append(i)
        for script, at in groups.items():
            if script in self.masks:
                candidates, rows = np.flatnonzero(self.masks[script]), np.asarray(at)
                grams, begin = ngram_hashes([new[i] for i in at], len(self.weights))
                found = np.full((len(at), len(self.langs)), EXCLUDED, np.float32)
                for j in candidates:
                    found[:, j] = np.add.reduceat(self.weights[grams[0], j], begin) + np.add.reduceat(self.weights[grams[1], j], begin)
                scores[rows] = found - found.max(axis=1, keepdims=True)
                sure[rows] = letters[rows]
        base = len(self.words)
        self.words.update((w, base + i) for i, w in enumerate(new))
        self.scores = np.concatenate([self.scores, scores])
        self.letters, self.sure = np.concatenate([self.letters, letters]), np.concatenate([self.sure, sure])

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per text: the label of each word by Viterbi, each word's letters of known scripts, and all letters."""
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        mixed: list[int] = []
        waiting: list[np.ndarray] = []

        def settle() -> None:
            """Texts that switch go through Viterbi side by side, longest first."""
            order = sorted(range(len(mixed)), key=lambda k: -len(waiting[k]))
            if order:
                sizes = np.array([len(waiting[k]) for k in order])
                begin = np.cumsum(sizes) - sizes
                labels = viterbi(np.concatenate([waiting[k] for k in order]), np.arange(int(sizes.sum())), begin, sizes, SWITCH_PENALTY)
                for k, a, n in zip(order, begin.tolist(), sizes.tolist(), strict=True):
                    found[mixed[k]] = (labels[a : a + n], *found[mixed[k]][1:])
            mixed.clear()
            waiting.clear()

        for part in _chunks([words_of(t or "") for t in texts], self.most // 2):
            sizes = [len(w) for w in part]
            flat, end = self._known(part), 0
            for n in sizes:
                at = flat[end : end + n]
                end += n
                scores = self.scores[at]
                single = single_label(scores, SWITCH_PENALTY)
                found.append((np.full(n, single or 0, np.int16), self.sure[at], int(self.letters[at].sum())))
                if single is None:
                    mixed.append(len(found) - 1)
                    waiting.append(scores)
            if sum(map(len, waiting)) * len(self.langs) > 4 * CELLS:
                settle()
        settle()
        return found

    def _known(self, split: list[list[str]]) -> np.ndarray:
        """Rows of the score table for all words, scoring new ones first."""
        new = list(dict.fromkeys(w for w in chain.from_iterable(split) if w not in self.words))
        if new:
            if len(self.words) + len(new) > self.most:
                new = list(dict.fromkeys(chain.from_iterable(split)))
                self.words.clear()
                self.scores, self.letters, self.sure = self.scores[:0], self.letters[:0], self.sure[:0]
            self.learn(new)
        return np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))


def _chunks(split: list[list[str]], most: int) -> Iterator[list[list[str]]]:
    """Texts in runs of about ``most`` words; a longer text stands alone."""
    part, n = [], 0
    for words in split:
        if part and n + len(words) > most:
            yield part
            part, n = [], 0
        part.append(words)
        n += len(words)
    if part:
        yield part


def single_label(scores: np.ndarray, penalty: float) -> int | None:
    """The label of a text whose best path never switches, if that is certain.

    A path that uses label k of the largest sum switches at least once for every
    segment in another label, so it loses if no stretch gains more than one
    switch costs.  A path of s segments that never uses k switches s - 1 times
    only: it loses too if its first and last segment, a prefix and a suffix of
    the text, together gain no more than one switch costs.
    """
    if not len(scores):
        return 0
    total = scores.sum(axis=0, dtype=np.float64)
    k = int(total.argmax())
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, k : k + 1], axis=0, out=gain[1:])
    stretch = (gain - np.minimum.accumulate(gain, axis=0)).max()
    ends = gain.max() + (gain[-1] - gain).max()
    return k if stretch <= penalty and ends <= penalty else None


def viterbi(scores: np.ndarray, words: np.ndarray, begin: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label sequences of many texts in lockstep, longest first; a switch costs ``penalty``."""
    out = np.zeros(len(words), np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    if not longest:
        return out
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    total = scores[words[begin[: active[0]]]].astype(np.float64)
    rows = np.arange(len(sizes))
    final, jumps, sources = np.zeros(len(sizes), np.int64), np.zeros((len(words), scores.shape[1]), bool), np.zeros(len(words), np.int16)
    for t in range(longest):
        n = int(active[t])
        if t:
            if n < len(total):
                final[n : len(total)] = total[n:].argmax(axis=1)
                total = total[:n]
            at = begin[:n] + t
            best = total.argmax(axis=1)
            switched = total[rows[:n], best][:, None] - penalty
            jump = total < switched
            jumps[at], sources[at] = jump, best
            total = np.where(jump, switched, total)
            total += scores[words[at]]
    final[: len(total)] = total.argmax(axis=1)
    state = final
    for t in range(longest - 1, -1, -1):
        n = int(active[t])
        at = begin[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = np.where(jumps[at, state[:n]], sources[at], state[:n])
    return out


@lru_cache(maxsize=2)
def _labeller(model: bytes) -> Labeller:
    return Labeller(model)


def spans_of(text: str, labels: np.ndarray, langs: list[str]) -> list[tuple[int, int, str]]:
    """Runs of one label as (start, end, language) in characters of the text."""
    out: list[tuple[int, int, str]] = []
    at = 0
    for word, k in zip(raw_words(text), labels.tolist(), strict=True):
        start = text.index(word, at)
        at = start + len(word)
        if out and out[-1][2] == langs[k]:
            out[-1] = (out[-1][0], at, langs[k])
        else:
            out.append((start, at, langs[k]))
    return out


def identify(docs: DataFrame, model: bytes, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for every row; with ``with_spans`` also the labelled spans."""
    spark = prepare(docs.sparkSession, 1000)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared.value)
        langs = labeller.langs
        for b in batches:
            texts = b.column("text").to_pylist()
            pred, score, spans = [], [], []
            for text, (labels, sure, letters) in zip(texts, labeller.label(texts) if langs else [(np.zeros(0, int), np.zeros(0, int), 0)] * len(texts), strict=True):
                mass = np.bincount(labels, weights=sure, minlength=max(len(langs), 1))
                k = int(mass.argmax())
                pred.append(langs[k] if letters else "und")
                score.append(float(mass[k] / letters) if letters else 0.0)
                if with_spans:
                    # lower() can change a word's length, never the number of words
                    spans.append([{"start": s, "end": e, "lang": l} for s, e, l in spans_of(text, labels, langs)] if letters else [])
            columns, names = [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<start: long, end: long, lang: string>>" if with_spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: bytes, min_share: float) -> DataFrame:
    """Rows of ``docs`` whose main language holds at least ``min_share`` of the letters (all with letters, if none was learned); same columns."""
    shared = prepare(docs.sparkSession, 1000).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            if labeller.langs:
                keep = []
                for labels, sure, letters in labeller.label(texts):
                    mass = np.bincount(labels, weights=sure, minlength=len(labeller.langs))
                    keep.append(bool(letters and mass.max() >= min_share * letters))
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
