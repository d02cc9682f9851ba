"""Near-duplicates by Order MinHash with verification by banded alignment.

A document is the sequence of its runs of five words.  Each sketch takes the few
runs, labelled by how often they stood before, with the smallest hashes under
its own permutation, and keeps their order in the text.  Documents that share a
sketch are candidates, so candidates agree in runs and in their order, as
documents of small edit distance do.

A sketch's documents are not paired all with all: each meets two of them, one by
chance and the hub, the one that most others share sketches with, as the text
that others are copies of does.  A pair is a link if alignment in a band, as wide
as the similarity allows, leaves M runs in common in order with
M / (a + b - M) >= 0.8, a and b the numbers of runs.

Two documents of a sketch that are then not in one class may still be a link.
What they share is what they share of the hub, at most what the one with less of
it has, and runs that the hub lacks.  Where the former is too little they share
some of the latter, and so one of the first of them in any fixed order, as a
prefix filter says.  So these documents are grouped anew, by hub and such a run.
Copies with edits of their own share none, nor do texts that have but a passage
in common with the hub.  Groups of a few documents are paired; a larger one gets
a hub of its own, is held against it, and is grouped by runs that both hubs lack,
and so on.  The runs left shrink with each hub, so this ends; each step is linear
in its rows, and no link is lost.  Documents that have enough of the hub's runs
for a link with a shorter text, yet are none with the hub, meet those of such a
length.  Classes are the connected components of the links.

Equal word sequences are one node from the start.  A node's id is a 64-bit hash
of its words; among n different texts n**2 / 2**65 pairs are expected to share
one (0.02 at a billion).
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import words
from lodestar.llm.rows import map_rows
from lodestar.llm.shared import bare_names, settle

RUN, SIMILAR = 5, 0.8
#: Sketches of a document; runs in each, for documents of LONG runs or more and for those of fewer than SHORT.
SKETCHES, LONG_ORDER, SHORT_ORDER = 24, 5, 2
LONG, SHORT = 25, 32
#: Documents of a group that are paired; in a larger group each meets a hub.
FEW = 32
#: Pairs with one pivot that meet its text in one place.
SHARE = 256
#: Bytes kept of a run's hash.
WIDTH = 5
#: Hashes worked on at a time.
BLOCK = 1 << 21

_ODD = words.mix64(np.arange(1, 4 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def label(runs: np.ndarray) -> np.ndarray:
    """A hash of each run and how often it stood before."""
    return words.mix64(runs + words.occurrence(runs).astype(np.uint64) * _STEP)


def sketches(runs: np.ndarray, order: int, first: int) -> np.ndarray:
    """SKETCHES keys; each hashes the order runs that are smallest under its permutation, in text order."""
    labelled = label(runs)
    order = min(order, len(runs))
    step = max(1, BLOCK // len(runs))
    keys = []
    for at in range(0, SKETCHES, step):
        odd = _ODD[first + at : first + min(SKETCHES, at + step), None]
        if len(runs) > order:
            places = np.argpartition((labelled ^ (odd >> np.uint64(7))) * odd, order - 1, axis=1)[:, :order]
            places.sort(axis=1)
        else:
            places = np.broadcast_to(np.arange(order), (len(odd), order))
        key = odd[:, 0].copy()
        for c in range(order):
            key = words.mix64(key * _STEP + labelled[places[:, c]])
        keys.append(key)
    return np.concatenate(keys)


def pack(runs: np.ndarray) -> bytes:
    """WIDTH bytes of each run."""
    return runs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8")[:, 0]


def sign(text: str | None) -> tuple[int, int, list[int], bytes]:
    """Node id, number of runs, keys and packed runs of one text."""
    hashes = words.word_hashes((text or "").encode())
    if not len(hashes):
        return 0, 0, [], b""
    runs = words.shingles(hashes, RUN)
    spread = words.mix64(hashes + words.mix64(np.arange(1, len(hashes) + 1, dtype=np.uint64) * _STEP))
    node = int(words.mix64(np.array([spread.sum(dtype=np.uint64) ^ np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])
    keys = []
    if len(runs) >= LONG:
        keys.append(sketches(runs, LONG_ORDER, 0))
    if len(runs) < SHORT:
        keys.append(sketches(runs, SHORT_ORDER, SKETCHES))
    return node, len(runs), np.unique(np.concatenate(keys)).view(np.int64).tolist(), pack(runs)


def common_in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of a and b whose pairs stand at most band places apart.

    One bit for each place of a in the band; a bit is 0 where the length grows.
    A row of b is one addition on the bits.
    """
    spots: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(a.tolist()):
        spots[x].append(i)
    many = {x: sum(1 << i for i in at) for x, at in spots.items() if len(at) > 64}
    size, width, low, gone = len(a), 2 * band + 1, 0, 0
    full = (1 << width) - 1
    bits = full
    for j, x in enumerate(b.tolist()):
        move = min(j - band, size) - low
        if move > 0:
            gone += move - (bits & ((1 << move) - 1)).bit_count()
            bits = bits >> move | ((1 << move) - 1) << (width - move) if move < width else full
            low += move
        at = spots.get(x)
        if at is None:
            continue
        if len(at) > 64:
            hits = many[x] >> low & full
        else:
            hits = 0
            for i in at[bisect.bisect_left(at, low) :] if len(at) > 1 else at:
                if low <= i < low + width:
                    hits |= 1 << (i - low)
        hits &= bits
        if hits:
            bits = (bits + hits | bits - hits) & full
    return gone + width - bits.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """M / (a + b - M) by banded alignment if it is least or more; else some lower value. No runs on either side: 0."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    band = int(n + m - 2 * need) + 1
    k = min(n, m)
    differs = np.flatnonzero(a[:k] != b[:k])
    head = int(differs[0]) if len(differs) else k
    differs = np.flatnonzero(a[n - (k - head) :][::-1] != b[m - (k - head) :][::-1])
    tail = int(differs[0]) if len(differs) else k - head
    both = head + tail
    x, y = a[head : n - tail], b[head : m - tail]
    if len(x) and len(y):
        both += common_in_order(x, y, band)
    return both / (n + m - both)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return map_rows(
        picked, ["doc_id", "text_key", "text"], "doc_id long, text_key long, node long, n int, keys array<long>, runs binary",
        lambda: lambda doc_id, key, text: [(doc_id, key, *sign(text))],
    )


def least_common(a: int, b: int, least: float) -> int:
    """Runs that texts of a and b runs must share at least to be a link."""
    return math.ceil(least * (a + b) / (1 + least) - 1e-9)


def beyond(x: np.ndarray, cover: np.ndarray, floor: int, least: float) -> tuple[int, bool, list[int], int]:
    """How x, labelled runs of a text, differs from cover; floor is the size of the shortest text that x may meet.

    The number of runs in both; whether these alone suffice for a link with a text
    as short as floor; the first of the runs that cover lacks, of which one is
    shared in any link that needs one; and how many such runs come after the first.
    """
    own = np.setdiff1d(x, cover, assume_unique=True)
    shared = len(x) - len(own)
    lacks = least_common(len(x), max(floor, math.ceil(least * len(x) - 1e-9)), least) - shared
    own.sort()
    return shared, lacks <= 0, own[: max(0, len(own) - max(1, lacks) + 1)].view(np.int64).tolist(), len(own) - 1


COMPARED = "base long, node long, pivot long, n int, link boolean, shared int, enough boolean, own array<long>, after int, floor int"


def compare(pairs: DataFrame, runs: DataFrame, covers: DataFrame | None, least: float) -> DataFrame:
    """COMPARED of pairs(base, node, pivot, floor). Without floor it is asked only whether they are a link.

    covers(base, cover) has the labelled runs of the hubs before.  The joins are by
    sorting at every size, as they must be at a large one.
    """
    wanted = pairs.select("node").union(pairs.select("pivot")).distinct()
    runs = runs.select("node", "runs").join(wanted.hint("merge"), "node", "left_semi")
    # a pivot of many pairs is dealt out
    many = pairs.groupBy("pivot").agg(F.count("*").alias("times")).where(F.col("times") > SHARE)
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("times") / SHARE)), F.lit(0).cast("long"))
    place = F.struct("base", "pivot", part.alias("part"))
    pairs = settle(pairs.join(many, "pivot", "left").withColumn("place", place).drop("times"), "near-dealt")
    second = pairs.select("place").distinct().select("place", "place.base", F.col("place.pivot").alias("node")).hint("merge").join(runs.withColumnRenamed("runs", "y"), "node")
    # a hub's cover goes with the hub's text, so that no task holds all documents of a hub
    second = second.withColumn("cover", F.lit(None).cast("binary")) if covers is None else second.hint("merge").join(covers, "base", "left")
    first = pairs.hint("merge").join(runs.withColumnRenamed("runs", "x"), "node")
    # few bytes take long to align, so tasks are not joined to larger ones by their bytes
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = first.repartition(tasks, "place").hint("merge").join(second.select("place", "y", "cover").repartition(tasks, "place"), "place")

    def row(base: int, node: int, pivot: int, floor: int | None, x: bytes, y: bytes, cover: bytes | None) -> Iterator[tuple]:
        a, b = unpack(x), unpack(y)
        found = base, node, pivot, len(a), similarity(a, b, least) >= least
        if floor is None:
            yield (*found, None, None, None, None, None)
        else:
            yield (*found, *beyond(label(a), label(b) if cover is None else np.frombuffer(cover, np.uint64), floor, least), floor)

    return map_rows(both, ["base", "node", "pivot", "floor", "x", "y", "cover"], COMPARED, lambda: row)


def hubs(groups: DataFrame, key: list[str]) -> DataFrame:
    """base, node, pivot, floor, before: the documents of each group, held against its hub; each once for one hub and hubs before."""
    heads = groups.groupBy(*key).agg(F.max(F.struct("reach", "node")).alias("hub"))
    met = groups.join(heads, key).select(F.col("base").alias("before"), "node", "n", F.col("hub.node").alias("pivot")).where("node != pivot").distinct()
    met = met.withColumn("base", F.when(F.col("before").isNull(), F.col("pivot")).otherwise(F.xxhash64("before", "pivot")))
    floors = met.groupBy("base").agg(F.min("n").alias("floor"))
    return met.join(floors, "base").select("base", "node", "pivot", "floor", "before")


def widen(asked: DataFrame, runs: DataFrame, covers: DataFrame | None) -> DataFrame:
    """covers of asked: the labelled runs of the hub and those before."""
    steps = asked.select("base", "before", "pivot").distinct()
    new = steps.join(runs.select(F.col("node").alias("pivot"), "runs"), "pivot")
    old = runs.select(F.col("node").alias("before"), F.col("runs").alias("old"), F.lit(None).cast("binary").alias("cover"))
    if covers is not None:
        old = covers.select(F.col("base").alias("before"), F.lit(None).cast("binary").alias("old"), "cover")

    def row(base: int, x: bytes, old: bytes | None, cover: bytes | None) -> Iterator[tuple]:
        before = label(unpack(old)) if cover is None else np.frombuffer(cover, np.uint64)
        yield base, np.union1d(label(unpack(x)), before).tobytes()

    return map_rows(new.join(old, "before"), ["base", "runs", "old", "cover"], "base long, cover binary", lambda: row)


def regroup(compared: DataFrame, labels: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of hubs whose documents are not one class: by a run that the hub lacks, and those that have enough of the hub's runs.

    The first is base, run, node, n, reach, component, shared, rest, size, only for
    groups of two classes or more; size is the number of documents in the group,
    rest that of runs that the hub lacks after this one.  The second is base, node,
    n, component, shared, floor, off; off: not of the hub's class.
    """
    rows = compared.where("own is not null").join(labels.select("node", F.col("component").alias("_c")), "node", "left").join(labels.select(F.col("node").alias("pivot"), F.col("component").alias("_d")), "pivot", "left").join(reach, "node")
    component, off = F.coalesce("_c", "node"), F.coalesce("_c", "node") != F.coalesce("_d", "pivot")
    rows = settle(rows.select("base", "node", "n", "reach", component.alias("component"), "shared", off.alias("off"), "enough", "own", "after", "floor"), "near-compared")
    split = rows.groupBy("base").agg(F.max("off").alias("split"), F.max(F.col("off") & F.col("enough")).alias("loose")).where("split").drop("split")
    rows = rows.join(split, "base")
    kept = ["base", "node", "n", "reach", "component", "shared"]
    own = settle(rows.select(*kept, "after", F.posexplode("own").alias("at", "run")).select(*kept, "run", (F.col("after") - F.col("at")).alias("rest")), "near-own")
    sizes = own.groupBy("base", "run").agg(F.count("*").alias("size"), F.min("component").alias("_c"), F.max("component").alias("_d")).where("_c < _d").drop("_c", "_d")
    loose = rows.where("loose and enough").select("base", "node", "n", "component", "shared", "floor", "off")
    return settle(own.join(sizes, ["base", "run"]), "near-groups"), settle(loose, "near-loose")


def few_pairs(groups: DataFrame, least: float, few: int) -> DataFrame:
    """node, pivot: pairs of documents of two classes that may be a link, in groups of few documents or fewer."""
    small = groups.where(F.col("size") <= few).groupBy("base", "run").agg(F.collect_list(F.struct("component", "node", "n", "shared", "rest")).alias("items"))
    may = f"""x.component < y.component and least(x.n, y.n) >= {least} * greatest(x.n, y.n)
        and least(x.shared, y.shared) + least(x.rest, y.rest) + 1 >= {least / (1 + least)} * (x.n + y.n) - 1e-9"""
    return small.select(F.expr(f"inline(flatten(transform(items, x -> transform(filter(items, y -> {may}), y -> named_struct('node', x.node, 'pivot', y.node)))))"))


def loose_pairs(loose: DataFrame, least: float) -> DataFrame:
    """node, pivot: pairs, not both of the hub's class, for a link of which what both have of the hub may suffice; they meet by the length that this allows."""
    longest = F.floor(F.col("shared") * ((1 + least) / least) - F.col("n") + 1e-9).cast("int")
    lengths = F.expr("if(m >= f, sequence(f, m), array())")
    x = loose.where("off").withColumn("m", longest).withColumn("f", F.greatest("floor", F.ceil(F.col("n") * least - 1e-9).cast("int")))
    x = x.select("base", "node", "component", F.explode(lengths).alias("n"))
    y = loose.select("base", "n", F.col("node").alias("pivot"), F.col("component").alias("_d"), "shared")
    # a text of at least its own share of both lengths
    return x.join(y, ["base", "n"]).where("component != _d").select("node", "pivot")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links lead to, for each node of links(a, b).

    Each round takes the smallest label among a node and its neighbours, then that
    label's own label, until nothing changes.
    """
    edges = settle(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "near-edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        better = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = settle(better.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) < F.col("component")).alias("moved")), "near-labels")
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels


def absorb(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links; only links between different components are followed."""
    named = lambda of, to: labels.select(F.col("node").alias(of), F.col("component").alias(to))
    across = links.join(named("a", "c"), "a", "left").join(named("b", "d"), "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    across = settle(across.where("a != b").distinct(), "near-across")
    if across.isEmpty():
        return labels
    merged = components(across)
    moved = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return settle(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "near-labels")


def classes(docs: DataFrame, *, least: float = SIMILAR, few: int = FEW, **columns) -> DataFrame:
    """doc_id, text_key, class_id, class_size, is_first: one row for each row of docs.

    class_id: the smallest doc_id of the class.  is_first: the row, or one of
    several equal rows, that stands for the class.  Null and empty texts, and
    those of white space only, are one class.  Texts of the same words are copies
    whatever white space they have; texts of fewer than five words are near only
    to their copies.  A null id is smaller than all others.  An empty table gives
    no rows.
    """
    signed = settle(signatures(docs, **columns), "near-signed")
    keyed = signed.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    members = settle(keyed.join(shared, "key").distinct(), "near-members")
    runs = signed.where("n > 0").select("node", "runs").dropDuplicates(["node"]).join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    runs = settle(runs, "near-runs")
    reach = settle(members.groupBy("node").agg(F.sum("size").alias("reach")), "near-reach")
    grouped = members.join(reach, "node").withColumn("base", F.lit(None).cast("long"))
    asked, covers, labels = settle(hubs(grouped, ["key"]), "near-asked"), None, None
    plain = members.join(members.groupBy("key").agg(F.min("node").alias("pivot")), "key").select("node", "pivot")
    while True:
        plain = plain.where("node != pivot").distinct()
        none = F.lit(None)
        pairs = asked.drop("before").unionByName(plain.select(none.cast("long").alias("base"), "node", "pivot", none.cast("int").alias("floor")))
        pairs = settle(pairs, "near-pairs")
        if pairs.isEmpty():
            break
        compared = settle(compare(pairs, runs, covers, least), "near-links")
        new = compared.where("link").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        labels = components(new) if labels is None else absorb(labels, new)
        if asked.isEmpty():
            break
        groups, loose = regroup(compared, labels, reach)
        # a hub leaves its group, so groups get smaller at each step until all are of few documents
        plain = few_pairs(groups, least, few).unionByName(loose_pairs(loose, least))
        asked = settle(hubs(groups.where(F.col("size") > few), ["base", "run"]), "near-asked")
        if not asked.isEmpty():
            covers = settle(widen(asked, runs, covers), "near-covers")
    rows = signed.select("doc_id", "text_key", "node")
    if labels is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component"))
    rows = settle(rows.select("doc_id", "text_key", "component"), "near-rows")
    least_row = F.min(F.struct("doc_id", "text_key"))
    heads = settle(rows.groupBy("component").agg(least_row.alias("h"), F.count("*").alias("class_size")), "near-heads")
    joined = rows.join(heads, "component")
    return joined.select("doc_id", "text_key", F.col("h.doc_id").alias("class_id"), "class_size", F.struct("doc_id", "text_key").eqNullSafe(F.col("h")).alias("is_first"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their class, one for each, with all columns of docs, whatever their names.

    Of several rows with the id and text that stand for a class, the first by all
    other columns that can be ordered stays, null first.  Null and empty texts and those of white space are
    one class, so one of their rows stays.  An empty table stays empty.
    """
    firsts = classes(docs, id_col=id_col, text_col=text_col, **options).where("is_first").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    firsts = firsts.groupBy("id", "key").agg(F.count("*").alias("times"))
    bare, back = bare_names(docs)
    at, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    keyed = bare.withColumn("text_key", F.xxhash64(text))
    kept = keyed.join(firsts, F.col(at).cast("long").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    order = [F.col(c).asc_nulls_first() for c, kind in bare.dtypes if not re.search("map|variant|interval", kind) and c != text]
    first = Window.partitionBy("id", "key").orderBy(*order)
    again = kept.where("times > 1").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    return kept.where("times = 1").unionByName(again).select(*back)
