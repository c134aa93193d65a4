"""Byte-level BPE ids of a ``tokenizers`` file, at the speed of a rank-based encoder.

The file's own library is the authority.  Texts made only of characters that
every regular-expression engine classifies alike (printable ASCII, tab, line
ends, and Latin letters up to U+024F) are encoded by a rank encoder built from
the same file.  The two agree there if merge order is id order and the library
encodes every token's own bytes as that token (``ByteBpe.proven``): when two
neighbours spell a token c, no earlier merge has crossed the edges of c, so the
merges inside it were those of c alone, and the two neighbours are the pair that
the file lists for c.  Otherwise, and for every other text, the ids come from
the library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .common import source_file

DEFAULT_BPE = "byte_bpe_50k.json"
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    def __init__(self, path: str = DEFAULT_BPE, ranked: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        where = source_file(path)
        self.library = Tokenizer.from_file(where)
        with open(where, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.size = 1 + max([*ranks.values(), *special.values()])
        self.special = special
        self.tokens = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.checked: bool | None = None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        order = sorted(ranks.values())
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        by_rank = [vocab[a + b] for a, b in merges]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        # A rank encoder is the same function only if merge order is id order and nothing else rewrites the text.
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special) if ranked and plain and by_rank == sorted(by_rank) and order == list(range(len(order))) else None

    def proven(self) -> bool:
        """Whether every token's own bytes are one token to the library, so that the rank encoder gives its ids."""
        if self.checked is None:
            model = self.library.model
            self.checked = all([t.id for t in model.tokenize(token)] == [i] for token, i in self.tokens.items())
        return self.checked

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit numbers, special strings handled as the library does by default."""
        if self.fast is not None and (text.isascii() and text.isprintable() or not _UNUSUAL.search(text)):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str = DEFAULT_BPE, ranked: bool = True) -> ByteBpe:
    """``ranked``: whether ``proven`` held, which a driver asks once for all workers."""
    return ByteBpe(path, ranked)
