"""Mixing sources to target weights by pivotal dependent rounding.

Every document holds a fractional number of copies, equal for all documents of
its source.  Whole copies are kept as they are.  The fractions of one source are
paired: words move between the two at random, each direction with the
probability that leaves both expectations unchanged, until one of the two is
integral.  The other, the residual, meets the next document.  Folds of about
FAN documents leave one residual each, and these are folded again: a reduction
tree whose depth is the logarithm of the largest source, and in which no task
ever holds a whole source.  The words of a source are conserved at each step, so
a source misses by one document, the last residual.  Documents of over half the
mean size are rounded first; what their last residual misses is spread evenly
over the fractions of the small ones, so that in the end a source misses its
target by less than one small document, if it has enough of them.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import bare_names, settle

#: Weights of the sources in code point order, repeated from the start.
WEIGHTS = (5, 2, 1)
#: The mix's size as a share of the size of all documents.
SHARE = 1.5
#: How often a document may be taken at most.
MOST = 2
#: Documents in one fold of the tree, on average.
FAN = 64
#: Bytes of the table of sources up to which it is sent to all tasks; a larger one is joined by sorting, with large sources split by Spark.
BROADCAST = 16 << 20
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) with rank, from 0 in code point order, null last.

    The rank is the row's place in its sorted partition plus the rows of the
    partitions before; only one row for each partition meets in one task.
    """
    place = F.monotonically_increasing_id()
    ordered = settle(sizes.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size", place.alias("_place")), "mix-sources")
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.withColumn("_part", part).join(before, "_part").select("source", "source_size", (row + F.col("_before")).alias("rank"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, rank, target: shares of the total by weight, none above most times its source.

    Raising one common level, each source takes level * weight until it is full.
    The level is found by repeating: give what the full sources leave to the
    others by weight.  Each pass is one small aggregate.
    """
    picks = F.array(*[F.lit(int(w)) for w in weights])
    ranked = settle(
        ranked_sources(sizes).select("source", "source_size", "rank", F.element_at(picks, (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("_w"), (F.col("source_size") * most).alias("_cap")),
        "mix-targets",
    )
    first = ranked.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    total, level, full = share * (first.size or 0), None, -1
    level = total / first.w if first.w else 0.0
    while True:
        is_full = F.col("_cap") <= F.lit(level) * F.col("_w")
        x = ranked.agg(F.sum(F.when(is_full, F.col("_cap")).otherwise(0)).alias("cap"), F.sum(F.when(is_full, 0).otherwise(F.col("_w"))).alias("w"), F.count_if(is_full).alias("n")).first()
        if not x.n or x.n == full or not x.w:
            break
        full, level = x.n, (total - x.cap) / x.w
    return ranked.select("source", "source_size", "rank", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def _random(*parts: str) -> str:
    return f"(cast(xxhash64({', '.join(parts)}) & {(1 << 52) - 1}L as double) / {float(1 << 52)!r}D)"


def _fold(items: str, seed: int) -> str:
    """SQL that folds items (arrays of struct<d, k, size, whole, mass>) into struct<r, out>.

    r: the residual, null if none; out: the decided documents with up, 0 or 1.
    """
    kind = "struct<d: bigint, k: bigint, size: bigint, whole: bigint, mass: double>"
    done = "struct<d: bigint, k: bigint, size: bigint, whole: bigint, up: int>"
    a, b, room_a, room_b = "s.r.mass", "x.mass", "(s.r.size - s.r.mass)", "(x.size - x.mass)"
    gain, lose = f"least({room_a}, {b})", f"least({a}, {room_b})"
    up = f"{_random('s.r.d', 's.r.k', 'x.d', 'x.k', f'{seed}L')} * ({gain} + {lose}) < {lose}"

    def left(who: str, mass: str) -> str:
        return f"cast(named_struct('d', {who}.d, 'k', {who}.k, 'size', {who}.size, 'whole', {who}.whole, 'mass', {mass}) as {kind})"

    def ended(**ups: int) -> str:
        return "concat(s.out, array(" + ", ".join(f"cast(named_struct('d', {w}.d, 'k', {w}.k, 'size', {w}.size, 'whole', {w}.whole, 'up', {u}) as {done})" for w, u in (("s.r" if n == "r" else "x", u) for n, u in ups.items())) + "))"

    def state(residual: str, out: str) -> str:
        return f"named_struct('r', {residual}, 'out', {out})"

    none = f"cast(null as {kind})"
    return f"""aggregate({items},
      {state(none, f'cast(array() as array<{done}>)')},
      (s, x) -> case
        when s.r is null then {state(left('x', 'x.mass'), 's.out')}
        when {up} then case
          when {room_a} = {b} then {state(none, ended(r=1, x=0))}
          when {room_a} < {b} then {state(left('x', f'{b} - {room_a}'), ended(r=1))}
          else {state(left('s.r', f'{a} + {b}'), ended(x=0))} end
        else case
          when {a} = {room_b} then {state(none, ended(r=0, x=1))}
          when {a} < {room_b} then {state(left('x', f'{b} + {a}'), ended(r=0))}
          else {state(left('s.r', f'{a} - {room_b}'), ended(x=1))} end
        end)"""


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, fan: int = FAN, seed: int = 20) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken: one row for each row of docs.

    Null text: size 0.  Null source: a source of its own, after all others.
    Rows that repeat an id, source and size are drawn separately.  Random numbers
    are hashes of ids and seed, so reruns agree.  Documents of size 0 are taken
    with 0 words and copies 1.  An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    counted = settle(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "mix-documents")
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n"))
    aimed = targets(sizes.select("source", "source_size"), weights, share, most)
    per = settle(aimed.join(sizes.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-rates")
    about = per.agg(F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if about.bytes + 64 * about.n <= BROADCAST:
        per = F.broadcast(per)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rows = counted.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).withColumn("whole", F.floor(rate)).withColumn("part", rate - F.col("whole"))
    is_split = (F.col("size") > 0) & (F.col("part") > 0)
    is_small = F.col("size") * 2 * F.col("n") <= F.col("source_size")
    still = settle(
        rows.select("rank", F.col("doc_id").alias("d"), "k", "size", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(1).cast("long")).alias("whole"), (F.col("part") * F.col("size")).alias("mass"), "n", is_split.alias("_split"), is_small.alias("_small")),
        "mix-parts",
    )
    depth = max(1, math.ceil(math.log(max(per.agg(F.max("n").alias("n")).first().n or 0, 1), fan) + 1e-9))
    large, missed = _round(still.where("_split and not _small").drop("_split", "_small"), depth, fan, seed)
    small = still.where("_split and _small").drop("_split", "_small")
    spare = small.groupBy("rank").agg(F.sum("size").alias("_spare")).join(missed, "rank").select("rank", (F.col("missed") / F.col("_spare")).alias("_shift"))
    if 64 * about.n <= BROADCAST:
        spare = F.broadcast(spare)
    shift = F.coalesce("_shift", F.lit(0.0)) * F.col("size")
    small = small.join(spare, "rank", "left").withColumn("mass", F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.col("mass") - shift))).drop("_shift")
    small, _ = _round(small, depth, fan, seed + 1000)
    every = still.where("not _split").select(*_KEPT, F.lit(0).alias("up")).unionByName(large).unionByName(small)
    copies = F.col("whole") + F.col("up")
    return every.join(per.drop("n"), "rank").select(F.col("d").alias("doc_id"), "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


_KEPT = ("rank", "d", "k", "size", "whole")


def _round(live: DataFrame, depth: int, fan: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Round the masses of live by a tree of depth levels: the decided documents, and for each source what its last residual missed by."""
    decided = []
    for level in range(depth):
        groups = F.ceil(F.col("n") / F.lit(float(fan) ** (level + 1)))
        dealt = live.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed + 100 + level), "d", "k"), groups.cast("long")))
        item = F.struct((-F.col("size")).alias("z"), F.xxhash64(F.lit(seed + 200 + level), "d", "k").alias("o"), "d", "k", "size", "whole", "mass")
        folds = dealt.groupBy("rank", "_g").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
        folds = settle(folds.select("rank", "n", F.expr(_fold("items", seed + level)).alias("f")), f"mix-level{level}")
        decided.append(folds.select("rank", F.inline("f.out")).select(*_KEPT, "up"))
        live = folds.where("f.r is not null").select("rank", "n", "f.r.*")
    drawn = live.select(*_KEPT, "mass", F.expr(f"{_random('d', 'k', f'{seed + 77}L')} * size < mass").cast("int").alias("up"))
    decided.append(drawn.select(*_KEPT, "up"))
    every = decided[0]
    for x in decided[1:]:
        every = every.unionByName(x)
    return every, drawn.groupBy("rank").agg(F.sum(F.col("up") * F.col("size") - F.col("mass")).alias("missed"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs repeated as often as it is taken, with the columns of docs, whatever their names.

    Null and empty texts are taken once, as their words weigh nothing.  Rows that
    share id, source and size, so also repeated rows, share out the copies drawn for
    them in the order of their columns, null first.  An empty table stays empty.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    copies = mix(docs, **options).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words")).agg(F.array_sort(F.collect_list("copies")).alias("drawn"))
    bare, _ = bare_names(docs)
    at, text, source = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    pair = F.col(at).cast("long").eqNullSafe(F.col("id")) & F.col(source).eqNullSafe(F.col("of")) & (word_count(F.col(text)) == F.col("words"))
    joined = bare.join(copies, pair)
    rest = [F.col(c).asc_nulls_first() for c, kind in bare.dtypes if not re.search("map|variant|interval", kind) and c != text]
    order = Window.partitionBy("id", "of", "words").orderBy(*rest, F.col(text).asc_nulls_first())
    many = joined.where(F.size("drawn") > 1).withColumn("n", F.element_at("drawn", F.row_number().over(order)))
    both = joined.where(F.size("drawn") == 1).withColumn("n", F.element_at("drawn", 1)).unionByName(many)
    repeated = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int")))).where("k > 0")
    return repeated.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)])
