"""Exact sentencepiece BPE token counts at every prefix, by dynamic programming.

A piece of such a vocabulary never continues past a blank that follows another
character, so a text falls into independent segments: a run of blanks and the
characters up to the next blank.  Within a segment the encoding of each prefix
is the encoding of a shorter prefix plus one last token, and exactly one last
token fits: the one that stays unmerged next to the token before it.  Filling
that table left to right gives the token count of every prefix, so truncation
and budget questions need no second encoding.  Where only the whole segment's
count is asked for, the table is filled from its end, for no more prefixes than
the candidates for a last token lead to.

Defined results: null text counts as empty (no tokens); repeated rows are
counted row by row; an empty table gives an empty table; other columns are not
read.  Characters outside the vocabulary cost one token per UTF-8 byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, source_file

DEFAULT_PIECES = "piece_bpe_32k.model"
BLANK = "▁"
_ONE = (1,)
#: Rank of a pair that no piece joins.
_NEVER = 1e30
#: More than there are pieces and characters.
_PAIR = 1 << 32
#: Segments of at most so many characters after the first blank stay cached.
CACHED = 64
_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*")


def _words(text: str) -> list[str]:
    """What follows the first blank of every segment of a text that is not empty."""
    words = text.replace(BLANK, " ").split(" ")
    if "" in words:  # blanks in a row, or at an edge
        words = [s[1:] for s in _SEGMENT.findall(BLANK + text.replace(" ", BLANK))]
    return words


class PrefixCounter:
    """Token counts for all prefixes of texts under one sentencepiece BPE model."""

    def __init__(self, path: str = DEFAULT_PIECES, cache_limit: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=source_file(path))
        sp, self.rank, self.bytes_of = self.model, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.rank[piece] = -sp.get_score(i)
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.rank):
            raise ValueError("a piece of this model spans a blank; segments would not be independent")
        if sp.encode("ﬁ Å  x ", out_type=str) != [*self._spell("▁ﬁ"), *self._spell("▁Å"), *self._spell("▁▁x"), BLANK]:
            raise ValueError("this model rewrites texts before encoding; its counts need another operator")
        self.longest = max(map(len, self.rank))
        #: Lengths of the tokens that end with given three characters (or two, where no longer token does), longest first.
        ends: dict[str, set[int]] = {}
        for p in self.rank:
            if len(p) > 2:
                ends.setdefault(p[-3:], {1, 2} if p[-2:] in self.rank else {1}).add(len(p))
            elif len(p) == 2:
                ends.setdefault(p, {1, 2})
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.steps: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        #: Pieces and other characters by number (0 is a segment's start), and what each costs.
        self.names = ["", *self.rank]
        self.numbers = {p: k for k, p in enumerate(self.names)}
        self.costs = [0, *[1] * len(self.rank)]
        #: Whether the token of one number stays unmerged after that of another (times ``_PAIR``).
        self.fits: dict[int, bool] = {}
        #: Counts of segments by what follows their first blank: those of late, and those of before, which come back when they are met again.
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.cache_limit = cache_limit

    def _merge(self, text: str, seen: list[tuple[float, str, str]] | None = None) -> list[str]:
        """Plain BPE over a short text: best-ranked adjacent pair first, leftmost on ties; ``seen`` gets every merge's rank and the parts at both ends after it."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(a + b, _NEVER), i) for i, (a, b) in enumerate(pairwise(parts)))
            if best[0] >= _NEVER:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if seen is not None:
                seen.append((best[0], parts[0], parts[-1]))
        return parts

    def _steps_of(self, token: str) -> tuple[list[float], list[str], list[str]] | None:
        """The merges that make a token: the rank of each next one, and the first and last part before it; None if they do not make it."""
        if token not in self.steps:
            seen = [(0.0, token[0], token[-1])]
            whole = self._merge(token, seen) == [token]
            ranks, first, last = map(list, zip(*seen, strict=True))
            self.steps[token] = ([*ranks[1:], _NEVER], first, last) if whole else None
        return self.steps[token]

    def _fit(self, before: str, token: str) -> bool:
        """Whether both stay as they are next to each other: no merge across their border is ever the best one, or the leftmost of the best."""
        left, right = self._steps_of(before) if before else None, self._steps_of(token)
        if not before or left is None or right is None:
            return not before and right is not None
        (ranks, _, last), (other_ranks, first, _) = left, right
        i = j = 0
        while True:
            a, b, across = ranks[i], other_ranks[j], self.rank.get(last[i] + first[j], _NEVER)
            if across < a and across <= b and across < _NEVER:
                return False
            if a == b == _NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def _spell(self, text: str) -> list[str]:
        return [y for x in self._merge(text) for y in ([x] if x in self.rank else [f"<0x{b:02X}>" for b in x.encode("utf-8", "replace")])]

    def _fill(self, segment: str, end: int, last: list[int | None], counts: list[int]) -> int:
        """The number of the last token of the prefix of ``end`` characters; ``last`` and ``counts`` hold those already known and get this one."""
        numbers, fits = self.numbers, self.fits
        sizes = self.sizes.get(segment[end - 3 : end]) if end > 2 else None
        for size in sizes or self.sizes.get(segment[end - 2 if end > 1 else 0 : end], _ONE):
            start = end - size
            if start < 0:
                continue
            token = numbers.get(segment[start:end])
            if token is None:
                if size > 1:
                    continue
                token = self._numbered(segment[start:end])
            before = last[start]
            if before is None:
                before = self._fill(segment, start, last, counts)
            pair = before * _PAIR + token
            ok = fits.get(pair)
            if ok is None:
                ok = fits[pair] = self._fit(self.names[before], self.names[token])
            if ok:
                last[end], counts[end] = token, counts[start] + self.costs[token]
                return token
        raise AssertionError(f"no last token fits at {end}")

    def _numbered(self, character: str) -> int:
        """The number of a character that is no piece; it costs its bytes."""
        self.names.append(character)
        self.costs.append(len(character.encode("utf-8", "replace")))
        return self.numbers.setdefault(character, len(self.numbers))

    def segment_table(self, segment: str) -> list[int]:
        """Counts for prefixes of length 0..n of one segment, each exact."""
        last: list[int | None] = [0, *[None] * len(segment)]
        counts = [0] * len(last)
        for end in range(1, len(last)):
            if last[end] is None:
                self._fill(segment, end, last, counts)
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        return counts

    def learn(self, words: Iterable[str]) -> None:
        """Cache the counts of new segments, each a blank and a word; sorted, each reuses the table of the prefix it shares with the one before."""
        met = set(words)
        wanted = met.difference(self.cache)
        if len(self.cache) + len(wanted) > self.cache_limit:
            self.older, self.cache, wanted = self.cache, {}, met
        known, older = self.cache, self.older
        last: list[int | None] = [0, *[None] * (CACHED + 1)]
        counts, none, before = [0] * len(last), [None] * len(last), ""
        for word in sorted(wanted):
            if word in older:
                known[word] = older[word]
                continue
            segment = BLANK + word
            end = len(segment)
            if len(word) > CACHED:
                known[word] = self.segment_table(segment)[-1]
                continue
            shared = 0
            for a, b in zip(segment, before):  # noqa: B905
                if a != b:
                    break
                shared += 1
            last[shared + 1 : end + 1] = none[shared:end]
            if last[end] is None:
                self._fill(segment, end, last, counts)
            known[word], before = counts[end], segment
        if len(self.fits) > 1_000_000:
            self.fits.clear()

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        split = [_words(t) if t else [] for t in texts]
        met = set(chain.from_iterable(split))
        self.learn(met)
        known = self.cache
        counts = [sum(map(known.__getitem__, words)) for words in split]
        for word in [w for w in met if len(w) > CACHED]:
            del known[word]
        return counts

    def prefix_counts(self, text: str | None) -> list[int]:
        """Exact counts for the prefixes of 0, 1, ... len(text) characters."""
        out, base = [0], 0
        if text:
            for k, s in enumerate(_SEGMENT.findall(BLANK + text.replace(" ", BLANK))):
                counts = self.segment_table(s)
                # The first blank of the text is the model's own; no character of the text stands for it.
                out += [base + c for c in counts[2 if k == 0 else 1 :]]
                base += counts[-1]
        return out

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix whose own encoding has at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return (text or "")[: max(i for i, c in enumerate(counts) if c <= max(budget, 0))]


@lru_cache(maxsize=2)
def prefix_counter(path: str = DEFAULT_PIECES) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, model: str = DEFAULT_PIECES, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (``n_tokens > limit``)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for b in batches:
            n = counter.count_all(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
