"""Token alignment, top-k search and the prefix trie against brute force, and on odd tables."""

import hashlib
import json
import random
import zlib
from bisect import bisect
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import align, knn, trie
from lodestar.llm.shared import table

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11 alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain_groups(text, libraries):
    """(A ids, B ids, end) of each group by the set of common ends, and the links by a walk; None without tokens."""
    a, b = libraries
    spelt = align.byte_level(PATHS[0], public_tokenizers.PATTERN)[1], align.pieces(PATHS[1])[1]
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if any(b"".join(s[i] for i in side) != (" " + text).encode() for s, side in zip(spelt, ids)):
        return None
    ends = [np.cumsum([len(s[i]) for i in side]).tolist() for s, side in zip(spelt, ids)]
    at, groups, links = [0, 0], [], Counter()
    for cut in sorted(set(ends[0]) & set(ends[1])):
        upto = [bisect(e, cut) for e in ends]
        groups.append((ids[0][at[0] : upto[0]], ids[1][at[1] : upto[1]], cut))
        at = upto
    i = j = 0
    while i < len(ends[0]) and j < len(ends[1]):
        links[ids[0][i], ids[1][j]] += 1
        x, y = ends[0][i], ends[1][j]
        i, j = i + (x <= y), j + (y <= x)
    return groups, links


def plain_alignment(rows, libraries):
    held = [(doc_id, plain_groups(text, libraries)) for doc_id, text in rows]
    total = sum((h[1] for _, h in held if h), Counter())
    best = {}
    for (_, y), n in total.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for doc_id, h in held:
        if h is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = h
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
        sizes = sum(len(x) for x, _, _ in groups), sum(len(y) for _, y, _ in groups), len(groups), sum(links.values())
        out.append((doc_id, *sizes, sum(n for p, n in links.items() if total[p] == best[p[1]]), sum(n * total[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr), total, best


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    texts = [
        None, "", " ", "   two  spaces ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ spells a space", "a\0b", "日本語のテキスト、そして漢字。" * 30, "é漢😀👩‍👩‍👧 ½", "\n\n\t tabs\r\n", "a" * 3000, " " * 500,
        "".join(rng.choice("ab cé漢\n😀.,1") for _ in range(30_000)), "same text", "same text", "ﬁ ｆｕｌｌ", " x", "Naïve café " * 2000,
    ]
    return [(n if n != 3 else None, t) for n, t in enumerate(texts)]


def test_alignment_of_all_documents(spark, libraries, odd_texts):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + odd_texts
    df = spark.createDataFrame([(t, d, "x", 1) for d, t in docs], "text string, doc_id long, block string, pair long")  # names that the operator uses inside
    want, total, best = plain_alignment(docs, libraries)
    for parts in (1, 5):
        assert rows_of(align.align(df.repartition(parts), *PATHS, public_tokenizers.PATTERN)) == want
    found = align.vocabulary_map(df, *PATHS, public_tokenizers.PATTERN).collect()
    assert {(r.a_id, r.b_id): (r["count"], r.best) for r in found} == {p: (n, n == best[p[1]]) for p, n in total.items()}


def test_groups_spell_the_text(spark, libraries, odd_texts):
    df = spark.createDataFrame(odd_texts, "doc_id long, text string")
    got = {r.doc_id: [(g.a, g.b, g.end) for g in r.groups] for r in align.groups(df, *PATHS, public_tokenizers.PATTERN).collect()}
    want = {d: plain_groups(t, libraries) for d, t in odd_texts}
    assert got == {d: h[0] if h else [] for d, h in want.items()}


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(df, *PATHS, public_tokenizers.PATTERN).collect() == []
    df = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert rows_of(align.align(df, *PATHS, public_tokenizers.PATTERN)) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2 + [(None, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_are_the_common_ends():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 10, 200, 3000):
        for share in (0.02, 0.3, 0.9):
            ends = [np.unique(np.append(rng.choice(n * 5, size=max(1, int(n * 5 * share))) + 1, n * 5 + 1)) for _ in range(2)]
            last = [np.array([len(e) - 1]) for e in ends]
            at_a, at_b = align.common_cuts(*ends, *last)
            want = np.intersect1d(*ends)
            assert ends[0][at_a].tolist() == ends[1][at_b].tolist() == want.tolist()


def test_vocabulary_whose_ids_are_no_ranks(tmp_path, libraries):
    told = json.load(open(PATHS[0], encoding="utf-8"))
    told["model"]["merges"] = told["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(told), encoding="utf-8")
    encode, spelt = align.byte_level(str(tmp_path / "v.json"), public_tokenizers.PATTERN)
    own = Tokenizer.from_file(str(tmp_path / "v.json"))
    text = " the other way round, <|endoftext|>"
    own.encode_special_tokens = True
    assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids and b"".join(spelt[i] for i in encode(text)) == text.encode()


# 12 search


def plain_top(rows, k=10):
    """Exact whole numbers, all pairs."""
    held = []
    for key, vector in rows:
        if vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            held.append((key, [max(-(2**63), min(2**63 - 1, int(np.floor(y)))) if np.isfinite(y := 1024 * float(x)) else (2**63 - 1 if y > 0 else -(2**63)) for x in vector]))
    out = []
    for q, v in held:
        if q is not None and q % 100 == 0:
            scored = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), key is None, key or 0, key) for key, w in held if key != q]
            out += [(q, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def search(spark, rows, **limits):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string, v string")
    return rows_of(knn.top_k(knn.quantized(df), F.col("vec_id") % 100 == 0, **limits))


def test_search_on_odd_vectors(spark):
    rng = np.random.default_rng(7)
    vectors = [(n, rng.normal(size=8).astype(np.float32).tolist()) for n in range(1, 401)]
    vectors += [(100, [0.5] * 8), (100, [0.5] * 8), (500, [0.0] * 8), (-200, [1.0, -1.0]), (600, []), (None, [2.0] * 8), (None, [2.0] * 8), (601, None), (602, [None] + [1.0] * 7), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (700, None)]
    vectors += [(n, [0.25] * 8) for n in range(1001, 1300)]  # a vector that many rows hold: ties
    rows = [(k, v, 1, "c", "v") for k, v in vectors]
    want = plain_top(vectors)
    assert search(spark, rows) == want
    assert search(spark, rows, pivots=5, block=1, slot=37) == want
    assert search(spark, rows, pivots=40, block=3, slot=1000) == want


def test_cells_far_from_a_query_are_left_out(spark):
    """Clusters on axes: the pruned join reads few cells and finds the same."""
    rng = np.random.default_rng(8)
    vectors = [(n, (np.eye(8)[n % 8] * 4 + rng.normal(size=8) * 0.01).astype(np.float32).tolist()) for n in range(800)]
    rows = [(k, v, 1, "c", "v") for k, v in vectors]
    assert search(spark, rows, pivots=8, block=1) == plain_top(vectors)
    between = np.array([[0.0, 10.0], [10.0, 0.0]])
    assert knn._reaches(between, np.array([1.0, 1.0]), [(0, 5, 1.0), (1, 9, 1.0)], 5).tolist() == [2.0, 2.0]
    assert knn._reaches(between, np.array([1.0, 1.0]), [(0, 5, 1.0), (1, 9, 1.0)], 6).tolist() == [12.0, 2.0]
    assert knn._slotted(np.array([3, 4, 25, 0, 2]), 10) == [(0, 1), (0, 1), (1, 3), (3, 1), (4, 1)]


def test_search_of_huge_numbers_few_rows_and_none(spark):
    huge = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [3e15, 7.0]), (4, [1e12, 5.0])]
    assert search(spark, [(k, v, 1, "c", "v") for k, v in huge]) == plain_top([(k, np.array(v, dtype=np.float32).tolist()) for k, v in huge])
    big = [(0, [1e6, 1.0]), (1, [2e6, 2.0]), (2, [2e6, 3.0]), (3, [5e6, -7.0])]
    assert search(spark, [(k, v, 1, "c", "v") for k, v in big]) == plain_top(big)
    assert search(spark, []) == search(spark, [(100, [1.0], 1, "c", "v")]) == search(spark, [(101, [1.0], 1, "c", "v"), (102, [1.0], 1, "c", "v")]) == []


# 13 trie


def plain_trie(rows):
    """Nodes by dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    cut = lambda c: c - int(np.fmod(c, 100))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(cut(c), [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    for p, held in members.items():
        kids = [q for q in below[p] if len(q) == len(p) + 1]
        leaves = [q for q in below[p] if not any(len(r) > len(q) for r in below[q])]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        ends = ",".join(map(str, sorted(c for c in held if len(whole[c]) == len(p))))
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, node long"


def tries(spark, rows, **limits):
    return rows_of(trie.nodes(spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS), **limits))


def test_trie_of_odd_conversations(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 12), *range(95, 112), 205, 206, 207, -100, -101, -5, 10**12 + 7]:
        for turn in range(rng.randrange(1, 8)):
            rows.append((c, turn, rng.choice(["user", None, ""]), rng.choice(["a", "b é", None, "", "😀"])))
    rows += [(7, None, "user", "first"), (7, None, "user", "also first"), (8, 3, "user", "tie"), (8, 3, "user", "another tie"), (None, 1, "user", "nobody"), (99, 0, None, None), (98, 2, "user", "x"), (98, 2, "user", "x"), (98, 2, "user", "x")]
    want = plain_trie(rows)
    assert any(r[1] > 3 and r[3] > 1 for r in want)
    for height in (2, 16):
        assert tries(spark, rows, height=height) == want


def test_trie_of_long_conversations(spark):
    """Deeper than several bands, with branches at many depths."""
    rows = []
    for c, upto in ((0, 130), (100, 130), (104, 90), (108, 17), (111, 128)):
        rows += [(c, n, "r", "same" if n < upto // 2 + 6 else f"{c % 3}") for n in range(upto)]
    want = plain_trie(rows)
    for height in (4, 16):
        assert tries(spark, rows, height=height) == want


def test_trie_of_one_and_of_none(spark):
    with pytest.raises(ValueError):
        tries(spark, [(1, 0, "r", "t")], height=1)
    assert tries(spark, []) == [] == tries(spark, [(None, 1, "r", "t")])
    one = [(1, 0, "r", "text")]  # its first turns come from a conversation that is not there
    assert tries(spark, one) == plain_trie(one) and len(plain_trie(one)) == 1
    same = [(c, n, "r", "xy") for c in range(300) for n in range(3)]
    assert tries(spark, same) == plain_trie(same)
