"""Byte-level BPE encoding and decoding in linear time.

A piece's encoding is the only sequence of tokens in which no two neighbours
would have merged across their border.  An Aho-Corasick automaton over the
tokens, their bytes mapped to Latin-1 characters, gives the longest token at
each place.  The encoder takes it if it is compatible with the token before,
otherwise the next shorter prefix that is a token; where none is left it goes
back one token and never tries that end again, so each place is left at most
once.  Compatibility of two tokens is worked out by undoing their merges, latest
first, and remembered.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.rows import map_rows

#: Pieces remembered with their ids, in each Python worker.
REMEMBERED = 300_000
#: Characters of a long text that are split at a time.
SLICE = 1 << 20

#: Fixed value: the public pattern, and the same as the re module knows it, exact for texts without ODD characters.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]+|_+)+|\s+(?!\S)|\s+")
_BREAK = re.compile(r"(?<=\S)(?=\s)")


@functools.cache
def _odd() -> frozenset[str]:
    """Characters that the re module's classes place otherwise than the pattern's Unicode categories."""
    found = set("\x1c\x1d\x1e\x1f")
    for n in range(128, sys.maxunicode + 1):
        c = chr(n)
        kind = unicodedata.category(c)
        letter, number = kind[0] == "L", kind[0] == "N"
        as_letter, as_number = c.isalnum() and not c.isdecimal(), c.isdecimal()
        if letter != as_letter or number != as_number:
            found.add(c)
    return frozenset(found)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.slow, self.known_pattern = ranks, regex.compile(pattern), pattern == KNOWN
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, n in ranks.items():
            self.tokens[n] = token
        self.sizes = [len(t) for t in self.tokens]
        self.names = [str(n) for n in range(size)]
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[tuple[int, int], int] = {}
        self.prefix = [-1] * size
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._learn()

    def _learn(self) -> None:
        """In the order of ranks, the two tokens each token is merged from; tokens that no merge makes are never matched."""
        self.automaton = ahocorasick.Automaton()
        made = set()
        for n, token in enumerate(self.tokens):
            if len(token) > 1:
                for cut in range(len(token) - 1, 0, -1):
                    a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                    if a in made and b in made and a < n and b < n and self._compatible(a, b):
                        self.halves[n] = a, b
                        self.joined[a, b] = n
                        break
                else:
                    continue
            elif not token:
                continue
            made.add(n)
            self.automaton.add_word(token.decode("latin-1"), (n, len(token)))
        self.fits.clear()
        self.automaton.make_automaton()
        for n in made:
            token = self.tokens[n]
            self.prefix[n] = next((a for cut in range(len(token) - 1, 0, -1) if (a := self.ranks.get(token[:cut])) in made), -1)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens: undo the later merge of the two, and see if the border's pair would have merged before it.

        Of equal ranks the left is merged first, so at the border a's merge goes
        before an equal one and b's after it.
        """
        halves, joined = self.halves, self.joined
        before = len(halves)
        while True:
            across = joined.get((a, b))
            if across is not None and across < before:
                return False
            undo_a, undo_b = halves[a], halves[b]
            if undo_a is None and undo_b is None:
                return True
            if undo_b is None or (undo_a is not None and a > b):
                before, a = a, undo_a[1]
            else:
                before, b = b + 1, undo_b[0]

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size = len(data)
        longest = [-1] * size
        for end, (n, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = n
        sizes, prefix, fits = self.sizes, self.prefix, self.fits
        open_ = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + sizes[token]
            if open_[end]:
                if out:
                    pair = (out[-1], token)
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) > 2 * REMEMBERED:
                            fits.clear()
                        good = fits[pair] = self._compatible(*pair)
                else:
                    good = True
                if good:
                    out.append(token)
                    at = end
                    if at < size:
                        token = longest[at]
                    continue
            token = prefix[token]
            while token < 0:
                open_[at] = 0
                last = out.pop()
                at -= sizes[last]
                token = prefix[last]
        return tuple(out)

    def slices(self, text: str) -> Iterator[str]:
        """text in parts that end where no piece of the known pattern can go on: after a character that is not white space, before one that is."""
        if not self.known_pattern:
            yield text
            return
        at = 0
        while len(text) - at > SLICE:
            cut = _BREAK.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern; for the known one by a faster equal where the text allows it."""
        if not self.known_pattern:
            return [m[0] for m in self.slow.finditer(text)]
        if text.isascii() and not (set("\x1c\x1d\x1e\x1f") & set(text)) or _odd().isdisjoint(set(text)):
            return FAST.findall(text)
        return self.slow.findall(text)

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids, in lists of bounded size."""
        known = self.known
        for part in self.slices(text):
            pieces = self.pieces(part)
            found = list(map(known.get, pieces))
            if None in found:
                if len(known) > REMEMBERED:
                    known.clear()
                for n, ids in enumerate(found):
                    if ids is None:
                        piece = pieces[n]
                        ids = known.get(piece)
                        if ids is None:
                            ids = self.merge(piece)
                            if len(piece) < 64:
                                known[piece] = ids
                        found[n] = ids
            yield list(itertools.chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token and rank of each line of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@functools.lru_cache(maxsize=2)
def codec(data: bytes, pattern: str) -> Codec:
    """Kept for the life of a Python worker."""
    return Codec(read_ranks(data), pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes and, if asked for, ids: one row for each row of docs.

    vocabulary: path of a rank file, read on the driver and sent to the tasks
    (its size is the vocabulary's, about a megabyte).  Null text: empty, no tokens.
    """
    with open(vocabulary, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        coder = codec(sent.value, pattern)

        def row(doc_id: int, text: str | None) -> Iterator[tuple]:
            names, digest, decoded, n, size, every = coder.names, hashlib.sha256(), hashlib.sha256(), 0, 0, []
            for ids in coder.encode(text or ""):
                if ids:
                    digest.update(("," * (n > 0) + ",".join(map(names.__getitem__, ids))).encode())
                    back = coder.decode(ids)
                    decoded.update(back)
                    n, size = n + len(ids), size + len(back)
                    if with_ids:
                        every += ids
            yield (doc_id, n, digest.hexdigest(), decoded.hexdigest(), size, *([every] if with_ids else ()))

        return row

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids, start)
