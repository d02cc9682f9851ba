"""Exact top-k search by inner product, as a Voronoi kNN join.

Vectors become whole numbers, floor(1024 * component).  With m the longest norm of all,
a vector x stands as (x, sqrt(m^2 - |x|^2)) and a query q as (q, 0): their squared
distance is |q|^2 + m^2 - 2 q.x, so the nearest are those of the largest inner product,
and the triangle inequality holds.

Pivots (means of a bounded sample) cut this space into cells.  The summary of a cell
counts its vectors by bins of their distance to the pivot.  For all queries of a cell,
the distance at which summaries alone prove k others near enough is their reach; a
vector goes to a group of query cells only if, by the triangle inequality, it may lie
within the reach of one of them.  Groups are dealt in blocks of queries and their
vectors in slots of bounded size, so a full cell is many tasks; each solves its block
by exact whole-number products.  Bounds leave a slack that covers rounding, and
a bound that is not a number prunes nothing.

Vectors that are null, or hold a null or a component that is not finite, take no part.
Shorter vectors count as filled up with zeros.  Components and scores beyond 64 bits
count as the ends of that range.  A row's own id, and so each row of the same id, is
no candidate.  Repeated rows are candidates each, and queries each.  A null id is
never a query and comes last among equal scores.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.rows import give_back, send_package
from lodestar.llm.shared import settle

SCALE = 1024
#: Cells; rows of the sample whose means are their pivots; bins of a cell's summary.
PIVOTS, SAMPLE, BINS = 64, 1024, 64
#: Queries of a block and vectors of a slot: what a task holds, about.
BLOCK, SLOT = 2048, 16384
#: Share of the longest norm by which a bound may be wrong.
SLACK = 1e-5


def quantized(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as whole numbers."""
    number = lambda x: x.cast("double")
    usable = lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * number(x)))
    return df.where(F.col(vector).isNotNull() & F.forall(vector, usable)).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of float64, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to the pivots."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]])


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots: rows spread over x, moved to the means of their cells a few times."""
    pivots = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(5):
        near = _gaps(x, pivots).argmin(1)
        for cell in range(len(pivots)):
            if (near == cell).any():
                pivots[cell] = x[near == cell].mean(0)
    return pivots


def _in_cells(df: DataFrame, pivots: np.ndarray, longest: float | None) -> DataFrame:
    """df with cell and gap, its distance to the cell's pivot; longest is None for queries, which stand at height 0."""
    width = pivots.shape[1] - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cell int, gap double"
    send_package(df.sparkSession.sparkContext)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            x = np.hstack([x, np.zeros((len(x), 1))]) if longest is None else _lifted(x, longest)
            gaps = _gaps(x, pivots)
            cell = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(x)), cell])], names=[*batch.schema.names, "cell", "gap"])
        give_back()

    return df.mapInArrow(run, schema)


def _reaches(between: np.ndarray, spread: np.ndarray, bins: list, k: int) -> np.ndarray:
    """For each query cell the distance within which k vectors are sure to lie for every query of it. bins: (cell, count, largest gap)."""
    cell, count, far = (np.array(x) for x in zip(*bins))
    out = np.full(len(spread), np.inf)
    for i in range(len(spread)):
        bound = spread[i] + between[i, cell] + far
        order = np.argsort(bound)
        at = np.searchsorted(np.cumsum(count[order]), k)
        if at < len(order):
            out[i] = bound[order][at]
    return out


def _grouped(queries: np.ndarray, between: np.ndarray, block: int) -> np.ndarray:
    """A group for each query cell: near cells together while they hold up to a block of queries."""
    group, made = np.full(len(queries), -1), 0
    for seed in np.argsort(-queries, kind="stable"):
        if queries[seed] == 0 or group[seed] >= 0:
            continue
        total = 0
        for cell in np.argsort(between[seed], kind="stable"):
            if group[cell] < 0 and queries[cell] and (total == 0 or total + queries[cell] <= block):
                group[cell], total = made, total + queries[cell]
        made += 1
    return group


def _slotted(sizes: np.ndarray, slot: int) -> list[tuple[int, int]]:
    """(first slot, slots) of each cell: small ones share a slot, larger ones have several."""
    out, at, room = [], 0, 0
    for n in sizes.tolist():
        if n <= room:
            out.append((at - 1, 1))
            room -= n
        else:
            many = max(1, -(-n // slot))
            out.append((at, many))
            at, room = at + many, slot - n if many == 1 else 0
    return out


def _solve(k: int, width: int):
    def best(scores: np.ndarray, ids: np.ndarray, own: int) -> np.ndarray:
        """Places of the k highest scores of other ids, ties by place: data come in order of id."""
        other = np.flatnonzero(ids != own)
        row = scores[other]
        if len(row) > k:
            keep = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            other, row = other[keep], row[keep]
        return other[np.argsort(-row, kind="stable")][:k]

    def products(q: pa.Array, x: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Exact scores of blocks of queries, from the first query's place: in doubles while they are exact, else in Python's whole numbers."""
        a, b = _matrix(q, width), _matrix(x, width)
        step = max(1, (1 << 21) // max(1, len(b)))
        if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**52:
            for at in range(0, len(a), step):
                yield at, a[at : at + step] @ b.T
            return
        ends = np.iinfo(np.int64)
        pad = lambda c: np.array([[*r, *[0] * (width - len(r))] for r in c.to_pylist()], dtype=object).reshape(len(c), width)
        a, b = pad(q), pad(x)
        for at in range(len(a)):
            yield at, np.clip(a[at : at + 1] @ b.T, int(ends.min) + 1, int(ends.max)).astype(np.int64)

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        names = ["query_id", "variant", "copies", "vec_id", "score"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        if not queries.num_rows or not data.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        data = data.sort_by("vec_id")  # nulls last
        column = data.column("vec_id").combine_chunks()
        ids = column.fill_null(1).to_numpy(zero_copy_only=False)  # 1 is no query's id
        own = queries.column("vec_id").to_pylist()
        who, found, score = [], [], []
        for at, scores in products(queries.column("v").combine_chunks(), data.column("v").combine_chunks()):
            for n, row in enumerate(scores):
                top = best(row, ids, own[at + n])
                who.append(np.full(len(top), at + n))
                found.append(top)
                score.append(row[top].astype(np.int64))
        who, found = np.concatenate(who), pa.array(np.concatenate(found))
        given = [queries.column(c).take(pa.array(who)) for c in ("vec_id", "variant", "copies")]
        out = pa.table([*given, column.take(found), pa.array(np.concatenate(score))], names=names)
        give_back()
        return out

    return solve


def top_k(df: DataFrame, is_query: Column, k: int = 10, *, pivots: int = PIVOTS, block: int = BLOCK, slot: int = SLOT) -> DataFrame:
    """query_id, rank, vec_id, score: the k others of highest inner product for each row of quantized vectors that is_query holds for.

    is_query may read vec_id and v, and holds for no row without an id.  k, pivots, block and slot are at least 1.
    """
    spark = df.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = df.where(is_query & F.col("vec_id").isNotNull())
    longest, width = df.agg(F.max(norm), F.max(F.size("v"))).first()
    own = asked.groupBy("vec_id").count().agg(F.max("count")).first()[0]  # rows that are no candidates of a query, at most
    if own is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = df.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v")
    seen = pa.array([r.v for r in sample.collect()], pa.list_(pa.int64()))
    centres = _means(_lifted(_matrix(seen, width), longest), pivots)

    data = settle(_in_cells(df, centres, longest), "knn-data")
    variant = F.md5(F.array_join("v", ","))
    queries = settle(_in_cells(asked.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("variant", variant), centres, None), "knn-queries")

    # summaries: at most pivots * (BINS + 1) rows, and pivots rows of queries
    by_bin = F.least(F.floor(F.col("gap") / F.lit(2 * longest / BINS or 1.0)), F.lit(BINS))
    bins = [tuple(r) for r in data.groupBy("cell", by_bin.alias("bin")).agg(F.count("*").alias("n"), F.max("gap").alias("far")).select("cell", "n", "far").collect()]
    asking = {r.cell: r for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("far")).collect()}
    n_cells = len(centres)
    between, spread = _gaps(centres, centres), np.array([asking[i].far if i in asking else 0.0 for i in range(n_cells)])
    slack = SLACK * longest + 1e-9
    reach = _reaches(between, spread, bins, k + own) + slack
    n_queries = np.array([asking[i].n if i in asking else 0 for i in range(n_cells)])
    group = _grouped(n_queries, between, block)
    blocks = [-(-int(n_queries[group == g].sum()) // block) for g in range(group.max() + 1)]
    sizes = np.zeros(n_cells, dtype=np.int64)
    for cell, n, _ in bins:
        sizes[cell] += n
    slots = _slotted(sizes, slot)

    # what each group needs of each cell: at most pivots ^ 2 rows
    needs, visits = [], set()
    for g in range(len(blocks)):
        members = np.flatnonzero(group == g)
        for j in np.flatnonzero(sizes):
            low = (between[members, j] - spread[members] - reach[members]).min() - slack
            high = (between[members, j] + spread[members] + reach[members]).max() + slack
            if not (max(far for cell, _, far in bins if cell == j) < low):
                needs.append((int(j), g, blocks[g], *slots[j], float(low), float(high)))
                visits.add((g, *slots[j]))
    need = F.broadcast(spark.createDataFrame(needs, "cell int, grp int, blocks int, first int, slots int, low double, high double"))
    visit = F.broadcast(spark.createDataFrame(sorted(visits), "grp int, first int, slots int"))
    of = F.broadcast(spark.createDataFrame([(c, int(g), blocks[g]) for c, g in enumerate(group) if g >= 0], "cell int, grp int, blocks int"))

    spot = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("slots")).cast("int")
    sent = data.join(need, "cell").where(~(F.col("gap") < F.col("low")) & ~(F.col("gap") > F.col("high")))
    sent = sent.select("vec_id", "v", "grp", spot.alias("slot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    part = F.pmod(F.xxhash64("vec_id", "variant"), F.col("blocks")).cast("int").alias("block")
    asks = queries.join(of, "cell").select("vec_id", "v", "variant", "copies", "grp", part)
    asks = asks.join(visit, "grp").select("vec_id", "v", "variant", "copies", "grp", "block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot"))
    asks = asks.select("vec_id", "v", "variant", "copies", F.col("grp").alias("q_grp"), F.col("block").alias("q_block"), F.col("slot").alias("q_slot"))
    solved = asks.groupBy("q_grp", "q_block", "q_slot").cogroup(sent.groupBy("grp", "block", "slot")).applyInArrow(_solve(k, width), "query_id long, variant string, copies long, vec_id long, score long")
    ordered = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = solved.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
    repeated = F.explode(F.expr("array_repeat(0, cast(copies as int))"))
    return ranked.select("query_id", "rank", "vec_id", "score", repeated.alias("_copy")).drop("_copy")


#: DuckDB: all products. Holds for tables without repeated ids and null ids.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_dot_product(q.e, d.e) desc, d.vec_id) as integer) as rank,
  d.vec_id, cast(list_dot_product(q.e, d.e) as bigint) as score
from v q join v d on d.vec_id <> q.vec_id where q.vec_id % 100 = 0 qualify rank <= 10
"""
