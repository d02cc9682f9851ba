"""Alignment of two tokenizations of the same text at their common byte offsets.

A is a byte-level BPE, B a sentence-piece model that puts a space before the text.
Both are laid over the bytes of space + text.  An offset where tokens of both end is
a cut.  Cuts are found by divide and conquer: in an interval between two known cuts
an end of A near the middle is looked up among the ends of B by bisection, walking
outwards until one is common; the halves follow.  An interval without a common end
inside is a group.  All open intervals of a batch of texts are worked on at once.

In a group, each end of A or B but the last closes one more pair of overlapping
tokens: the links.  Links are counted over the corpus by (A id, B id).

Texts that are null or empty, or whose tokens do not spell space + text, have no
tokens: zeros and ''.  Each row gives a row, repeated ones and null ids too.  Other
columns are not read, so their names are free.  Strings of special tokens are plain
text.  Texts of any length are taken whole.

Links are summed by block (the texts of a task up to BLOCK_CHARS) before they are
shuffled, and the counts come back by block, so a pair that is in every text costs a
row for each block; pairs that are in many blocks are split by Spark as a skewed join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.rows import give_back, map_rows
from lodestar.llm.shared import settle

#: Characters of text that are aligned at once, and those of a block of counts.
BATCH_CHARS, BLOCK_CHARS = 1 << 18, 1 << 22

GROUPS = "array<struct<a: array<int>, b: array<int>, end: long>>"


# vocabularies


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones of Latin-1 for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(2)
def byte_level(path: str, pattern: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """Encoder and token bytes of a byte-level vocabulary file.

    Where each merge makes the next id, ids are ranks and tiktoken, which is faster,
    gives the same ids; else the file's own library encodes.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters = _byte_letters()
    special = {t["id"] for t in told.get("added_tokens", ())}
    spelt = {n: bytes(letters[c] for c in s) for s, n in told["model"]["vocab"].items() if n not in special}
    table = [spelt.get(n, b"") for n in range(1 + max([*spelt, *special]))]
    split = told.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    made = [bytes(letters[c] for c in a + b) for a, b in merges]
    if split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer") and table[256 : 256 + len(made)] == made:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: n for n, b in spelt.items()}, special_tokens={})
        return lambda text: np.array(own.encode_ordinary(text), dtype=np.int64), table

    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path)
    held.encode_special_tokens = True
    return lambda text: np.array(held.encode(text, add_special_tokens=False).ids, dtype=np.int64), table


@lru_cache(2)
def pieces(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """Encoder and token bytes of a sentence-piece model."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [held.id_to_piece(n) for n in range(held.get_piece_size())]
    table = [bytes([int(s[3:5], 16)]) if held.is_byte(n) else b"" if held.is_control(n) else s.replace("▁", " ").encode() for n, s in enumerate(names)]
    return lambda text: np.array(held.encode(text), dtype=np.int64), table


# one batch of texts


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ends_a and in ends_b, ascending, of the offsets in both.

    last_a and last_b are the places of common ends known before: the ends of the texts.
    """
    cut_a, cut_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    cut_a[last_a] = cut_b[last_b] = True
    from_a, from_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
    open_ = (from_a, last_a, from_b, last_b)
    while True:
        # an end inside is needed on both sides; other intervals are groups
        inner = (open_[1] > open_[0]) & (open_[3] > open_[2])
        lo_a, hi_a, lo_b, hi_b = (x[inner] for x in open_)
        if not len(lo_a):
            return np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        middle = (lo_a + hi_a - 1) // 2
        at_a, at_b = np.full(len(lo_a), -1), np.zeros(len(lo_a), dtype=np.int64)
        left, step = np.arange(len(lo_a)), 0
        while len(left):
            for side in (-1, 1) if step else (1,):
                here = middle[left] + side * step
                real = (here >= lo_a[left]) & (here < hi_a[left])
                who, here = left[real], here[real]
                there = np.searchsorted(ends_b, ends_a[here])
                hit = ends_b[there] == ends_a[here]
                at_a[who[hit]], at_b[who[hit]] = here[hit], there[hit]
                left = left[at_a[left] < 0]
            step += 1
            left = left[(middle[left] - step >= lo_a[left]) | (middle[left] + step < hi_a[left])]
        found = at_a >= 0
        lo_a, hi_a, lo_b, hi_b, at_a, at_b = (x[found] for x in (lo_a, hi_a, lo_b, hi_b, at_a, at_b))
        cut_a[at_a] = cut_b[at_b] = True
        open_ = tuple(np.concatenate(x) for x in ((lo_a, at_a + 1), (at_a, hi_a), (lo_b, at_b + 1), (at_b, hi_b)))


class Batch:
    """Texts laid end to end: their tokens, groups and links. Each text has tokens on both sides."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], wide_a: np.ndarray, wide_b: np.ndarray):
        self.a, self.b = np.concatenate(ids_a), np.concatenate(ids_b)
        self.upto_a, self.upto_b = np.cumsum([len(x) for x in ids_a]), np.cumsum([len(x) for x in ids_b])
        self.ends_a, self.ends_b = np.cumsum(wide_a[self.a]), np.cumsum(wide_b[self.b])
        self.last_a, self.last_b = common_cuts(self.ends_a, self.ends_b, self.upto_a - 1, self.upto_b - 1)
        self.upto_group = np.searchsorted(self.last_a, self.upto_a - 1) + 1  # groups up to each text's end

    def spans(self, upto: np.ndarray) -> list[tuple[int, int]]:
        return list(zip([0, *upto[:-1].tolist()], upto.tolist()))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and b of the overlapping tokens: one for each end, a common end once."""
        inner = np.ones(len(self.b), dtype=bool)
        inner[self.last_b] = False
        inner = np.flatnonzero(inner)
        return np.concatenate([np.arange(len(self.a)), np.searchsorted(self.ends_a, self.ends_b[inner])]), np.concatenate([np.searchsorted(self.ends_b, self.ends_a), inner])

    def spelt(self, words_a: np.ndarray, words_b: np.ndarray) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 of each text. words_x: of each id its digits and a comma, then of each its digits and the mark that closes its side of a group."""
        close_a, close_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        close_a[self.last_a] = len(words_a) // 2
        close_b[self.last_b] = len(words_b) // 2
        of_a = np.searchsorted(self.last_a, np.arange(len(self.a)))
        of_b = np.searchsorted(self.last_b, np.arange(len(self.b)))
        said = np.empty(len(self.a) + len(self.b), dtype=object)
        said[np.arange(len(self.a)) + np.concatenate([[0], self.last_b + 1])[of_a]] = words_a[self.a + close_a]
        said[np.arange(len(self.b)) + (self.last_a + 1)[of_b]] = words_b[self.b + close_b]
        said = said.tolist()
        return [b"".join(said[s:e])[:-1] for s, e in self.spans(self.upto_a + self.upto_b)]


@lru_cache(4)
def _marks(n: int, close: str) -> np.ndarray:
    out = np.empty(2 * n, dtype=object)
    out[:] = [b"%d," % x for x in range(n)] + [b"%d%b" % (x, close.encode()) for x in range(n)]
    return out


def _batches(a_path: str, b_path: str, pattern: str, told: Callable[[list, Batch], Iterable[tuple]], nothing: Callable[[object], tuple], after: Callable[[int], Iterable[tuple]] = lambda chars: ()):
    """A row function for map_rows: texts gathered to batches; told gives the rows of a batch, nothing that of a text without tokens."""
    (encode_a, table_a), (encode_b, table_b) = byte_level(a_path, pattern), pieces(b_path)
    wide_a, wide_b = np.array([len(x) for x in table_a]), np.array([len(x) for x in table_b])
    names_a, names_b = (np.array([*t, None], dtype=object)[:-1] for t in (table_a, table_b))
    held: list[tuple] = []
    chars = 0

    def flush() -> Iterable[tuple]:
        nonlocal held, chars
        if held:
            yield from told([h[0] for h in held], Batch([h[1] for h in held], [h[2] for h in held], wide_a, wide_b))
        done, held, chars = chars, [], 0
        yield from after(done)

    def each(doc_id, text) -> Iterable[tuple]:
        nonlocal chars
        if text:
            a, b, data = encode_a(" " + text), encode_b(text), (" " + text).encode()
            if len(a) and len(b) and b"".join(names_a[a].tolist()) == data and b"".join(names_b[b].tolist()) == data:
                held.append((doc_id, a, b))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield from flush()
                return
        yield nothing(doc_id)

    each.finish = flush
    return each


# operators


def groups(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id and the groups of each text in order: ids of A, ids of B and the byte offset in space + text where the group ends."""

    def start():
        def told(ids, x):
            from_a, from_b = np.concatenate([[0], x.last_a[:-1] + 1]), np.concatenate([[0], x.last_b[:-1] + 1])
            base = 0
            for doc_id, (s, e) in zip(ids, x.spans(x.upto_group)):
                out = []
                for g in range(s, e):
                    end = int(x.ends_a[x.last_a[g]])
                    out.append({"a": x.a[from_a[g] : x.last_a[g] + 1].tolist(), "b": x.b[from_b[g] : x.last_b[g] + 1].tolist(), "end": end - base})
                base = end
                yield doc_id, out

        return _batches(a_path, b_path, pattern, told, lambda doc_id: (doc_id, []))

    return map_rows(docs, ["doc_id", "text"], f"doc_id long, groups {GROUPS}", start)


_ALIGNED = "doc_id long, block long, whole boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<long>"


def _aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """A row for each text with its distinct links, and one (whole) for each block with their sums. pair is A id * 2^32 + B id."""

    def start():
        context = TaskContext.get()
        block, gathered, size = (context.partitionId() if context else 0) << 32, [], 0
        words = _marks(len(byte_level(a_path, pattern)[1]), "|"), _marks(len(pieces(b_path)[1]), ";")

        def told(ids, x):
            at_a, at_b = x.links()
            pair = (x.a[at_a] << 32) | x.b[at_b]
            known, pair = np.unique(pair, return_inverse=True)
            of = np.searchsorted(x.upto_a, at_a, side="right")
            both, times = np.unique(of * len(known) + pair, return_counts=True)
            upto = np.searchsorted(both, np.arange(1, len(ids) + 1) * len(known))
            link = known[both % len(known)]
            gathered.append((known, np.bincount(pair, minlength=len(known))))
            n_a, n_b, n_groups = (np.diff(u, prepend=0).tolist() for u in (x.upto_a, x.upto_b, x.upto_group))
            for n, (doc_id, said, (s, e)) in enumerate(zip(ids, x.spelt(*words), x.spans(upto))):
                yield doc_id, block, False, n_a[n], n_b[n], n_groups[n], int(times[s:e].sum()), hashlib.sha256(said).hexdigest(), link[s:e], times[s:e]

        def after(chars):
            nonlocal block, size
            size += chars
            if gathered and (size >= BLOCK_CHARS or chars < BATCH_CHARS):
                pair, at = np.unique(np.concatenate([p for p, _ in gathered]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([n for _, n in gathered])).astype(np.int64)
                gathered.clear()
                yield None, block, True, None, None, None, None, None, pair, times
                block, size = block + 1, 0

        return _batches(a_path, b_path, pattern, told, lambda doc_id: (doc_id, None, False, 0, 0, 0, 0, "", [], []), after)

    return map_rows(docs, ["doc_id", "text"], _ALIGNED, start)


def _block_pairs(aligned: DataFrame) -> DataFrame:
    links = aligned.where("whole").select("block", F.explode(F.arrays_zip("pair", "times")).alias("x"))
    return links.select("block", F.col("x.pair").alias("pair"), F.col("x.times").alias("times"))


def _counts(block_pairs: DataFrame) -> DataFrame:
    """pair, count, best: whether no pair of the same B id counts more. A B id's pairs are at most the vocabulary of A."""
    total = block_pairs.groupBy("pair").agg(F.sum("times").alias("count"))
    own = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return total.select("pair", "count", (F.col("count") == F.max("count").over(own)).alias("best"))


def vocabulary_map(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """a_id, b_id, count, best: how many links of all texts hold each pair of ids, and whether that is the B id's highest."""
    found = _counts(_block_pairs(settle(_aligned(docs, a_path, b_path, pattern), "aligned")))
    return found.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "count", "best")


def _scored(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The texts of a block with the corpus counts of their links."""

    def flat(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy()

    pair = known.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, count, best = pair[order], known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]
    at = np.searchsorted(pair, flat(docs, "pair"))
    times = flat(docs, "times")
    upto = np.concatenate([[0], np.cumsum(docs.column("pair").combine_chunks().value_lengths().to_numpy())])
    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[upto]) for x in (times * best[at], times * count[at])]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = pa.table([*(docs.column(c) for c in names), *map(pa.array, sums), docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])
    give_back()
    return out


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text: its alignment and how common its links are in all texts."""
    aligned = settle(_aligned(docs, a_path, b_path, pattern), "aligned")
    pairs = _block_pairs(aligned)
    counts = settle(_counts(pairs), "link-counts")
    known = pairs.join(counts, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = aligned.where("not whole")
    scored = rows.where("block is not null").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_scored, schema)
    none = F.lit(0).cast("long")
    return scored.unionByName(rows.where("block is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none.alias("n_best"), none.alias("count_sum"), "groups_sha256"))
