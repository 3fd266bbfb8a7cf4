"""Token ids of whole texts with a public word-piece vocabulary.

The vocabulary's tokenizer drops white space, lower-cases and splits words by a
pattern before merging, so a text's ids are the ids of its white-space-separated
chunks, one after another. Chunks repeat, so a worker keeps the ids of those it
has met (a bounded cache); pieces of plain Latin letters, digits and punctuation
are merged by a byte-pair encoder loaded with the same ranks, and any chunk with
other characters goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

END_OF_WORD = "</w>"
#: Entries after which a worker forgets what it has met.
CACHE_ENTRIES = 400_000
_BREAK = b"\xff\xff\xff\xff"
#: Printable ASCII and Latin-1 letters in UTF-8; their lower-casing is one to one.
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
#: The splitting pattern of the vocabulary's tokenizer, for lower-cased plain text; a line break is a piece of its own.
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves and the rest as U+0100 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids`` gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = {t["content"] for t in spec["added_tokens"]}
        of = _byte_of_char()
        # 0xFF never occurs in UTF-8, so it can stand for the end of a word.
        ranks = {bytes(of[c] for c in token.removesuffix(END_OF_WORD)) + (b"\xff" if token.endswith(END_OF_WORD) else b""): i for token, i in spec["model"]["vocab"].items() if token not in names}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn_plain(self, chunks: list[bytes]) -> None:
        """Ids of plain chunks: split and looked up together, one line each."""
        found = _PIECES.findall(b"\n".join(chunks).decode().lower() + "\n")
        pieces, merge = self.pieces, self.merge
        if len(pieces) > CACHE_ENTRIES:
            pieces.clear()
        pieces["\n"] = _BREAK
        for piece in set(found).difference(pieces):
            pieces[piece] = array("I", merge(piece.encode() + b"\xff")).tobytes()
        flat = b"".join(map(pieces.__getitem__, found))
        ends = (np.flatnonzero(np.frombuffer(flat, "<u4") == 0xFFFFFFFF) * 4).tolist()
        starts = [0, *(e + 4 for e in ends[:-1])]
        self.known.update(zip(chunks, map(flat.__getitem__, map(slice, starts, ends)), strict=True))

    def _learn(self, chunks: set[bytes]) -> None:
        plain, other = [], []
        for chunk in chunks:
            (plain if _PLAIN.match(chunk) and b"<|" not in chunk else other).append(chunk)
        if plain:
            self._learn_plain(plain)
        for chunk in other:
            self.known[chunk] = array("I", self.full.encode(chunk.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        known, split = self.known, [t.split() for t in texts]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        if new := set().union(*split).difference(known):
            self._learn(new)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)

