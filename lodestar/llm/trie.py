"""The prefix trie of conversations, with totals of subtrees by bands of depth.

A node is a distinct sequence of the first d turns (role, text); the root is the empty
one.  A node's key is a digest of d and of sums, over its turns, of hashes of (place,
turn): sums of prefixes can be taken in parts, so a conversation of any length is
spread over tasks.  Rows are dealt by range of (conversation, place); each part adds
the sums of the parts before it.

Totals of subtrees: depths are cut into bands of a fixed height.  A node explodes only
to its ancestors in its own band.  The tops of bands form a trie of their own, whose
depths are cut again, until one band is left.  Completed totals of a band's top then
go to the ancestors in the band above.  A row is so sent to at most the band's height
of nodes in each of log(depth) rounds.  Ancestors of a node are those of the path of
its smallest member, which is also the smallest member of all nodes below on that path.

Null roles and texts are empty ones.  Equal turns of a conversation (null ones come
first) are ordered by the digest of role and text; repeated rows are turns each.  Rows
without a conv_id take no part.  An empty table has no nodes.  Other columns are not
read, so their names are free.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.rows import map_rows
from lodestar.llm.shared import settle

#: Depths of a band.
HEIGHT = 16
#: Leading turns that a conversation may take from the first of its hundred, at most.
SHARED = 5
#: Characters of conversation ids that are hashed at once.
CHUNK = 1 << 16


def _running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with sums of all rows of key up to and with each row, in order, which has no ties within key.

    No task holds a key: rows are dealt by range, and parts add what is before them.
    """
    dealt = df.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    cut = settle(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "running")
    parts = cut.groupBy(key, "_part").agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in sums])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    nothing = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select(key, "_part", *[nothing(F.sum(f"_all_{n}").over(before)).alias(f"_before_{n}") for n in sums])
    joined = cut.join(parts, [key, "_part"])
    return joined.select(*df.columns, *[(F.col(f"_before_{n}") + F.sum(f"_{n}").over(within)).alias(n) for n in sums])


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, chars: the turns of each conversation, pos from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    return _running(turns, "conv_id", ["turn", "digest", "tie"], {"upto": F.lit(1).cast("long")}).select("conv_id", (F.col("upto") - 1).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their turns with the first h taken from the first conversation of the hundred: conv_id, depth from 1, digest, chars. h is crc32 of the id, modulo 6.

    turns is read several times.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED + 1)).cast("long")
    convs = turns.where("pos = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = turns.where(F.col("pos") < SHARED).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    taken = convs.join(heads.groupBy("base").agg(F.count("*").alias("n")), "base", "left")
    taken = taken.select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("m"))
    first = taken.join(heads, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "chars")
    rest = turns.join(taken, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "digest", "chars")
    return convs.select("conv_id"), first.unionByName(rest)


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, chars: the nodes of each conversation, from the root on."""

    def hashed(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), "depth", "digest").cast("decimal(20,0)")

    def key(depth: Column, *sums: Column) -> Column:
        return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("decimal(38,0)").cast("string") for s in sums]))

    a, b, depth = F.col("a"), F.col("b"), F.col("depth")
    summed = _running(turns.withColumns({"x": hashed(1), "y": hashed(2)}), "conv_id", ["depth"], {"a": F.col("x"), "b": F.col("y")})
    below = summed.select("conv_id", "depth", key(depth, a, b).alias("node"), key(depth - 1, a - F.col("x"), b - F.col("y")).alias("parent"), "chars")
    none = F.lit(0)
    top = convs.select("conv_id", none.cast("long").alias("depth"), key(none, none, none).alias("node"), F.lit(None).cast("string").alias("parent"), none.cast("long").alias("chars"))
    return top.unionByName(below)


def ends(paths_: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids, in ascending order, of the conversations that end at a node, joined by commas.

    A digest needs all bytes in order, so ids are joined to chunks where they are sorted, and only the chunks of a node meet, one after the other.
    """
    last = paths_.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    in_order = last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def chunks():
        node, first, held, size = None, None, [], 0

        def flush():
            nonlocal held, size
            if held:
                yield node, first, ",".join(held)
            held, size = [], 0

        def each(here, conv_id):
            nonlocal node, first, size
            if here != node or size >= CHUNK:
                yield from flush()
            if not held:
                node, first = here, conv_id
            held.append(str(conv_id))
            size += len(held[-1]) + 1

        each.finish = flush
        return each

    def digests():
        node, hashed = None, None

        def flush():
            if hashed is not None:
                yield node, hashed.hexdigest()

        def each(here, said):
            nonlocal node, hashed
            if here != node:
                yield from flush()
                node, hashed = here, hashlib.sha256(said.encode())
            else:
                hashed.update(b"," + said.encode())

        each.finish = flush
        return each

    parts = map_rows(in_order, ["node", "conv_id"], "node string, first long, said string", chunks)
    return map_rows(parts.repartition("node").sortWithinPartitions("node", "first"), ["node", "said"], "node string, ends_sha256 string", digests)


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def roll_up(items: DataFrame, height: int = HEIGHT) -> DataFrame:
    """node, leaves, saved: the totals over each node's subtree.

    items: conv_id, depth, node, rep, leaves, saved, a row for each node of each path.
    rep marks the path of a node's smallest member, and its row has the node's own
    values, other rows none.  height is at least 2, else bands would not get fewer.
    """
    if height < 2:
        raise ValueError("a band has at least two depths")
    band = F.floor(F.col("depth") / height).cast("long")
    held = F.struct("depth", "node", "rep", "leaves", "saved")
    by_band = items.groupBy("conv_id", band.alias("band")).agg(F.sort_array(F.collect_list(held)).alias("path"))  # up to height of them
    from_each = by_band.select("path", F.posexplode("path").alias("at", "x")).where("x.rep")
    inside = _summed(from_each.select(F.explode(F.slice("path", F.lit(1), F.col("at") + 1)).alias("up"), "x.leaves", "x.saved").select("up.node", "leaves", "saved"))
    if items.agg(F.max("depth")).first()[0] < height:
        return inside
    inside = settle(inside, "trie-inside")
    tops = items.where(F.col("depth") % height == 0).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "node", "rep")
    none = F.lit(None).cast("long")
    above = tops.where("rep").join(inside, "node").unionByName(tops.where("not rep").withColumns({"leaves": none, "saved": none}))
    above = settle(above.select("conv_id", "depth", "node", "rep", "leaves", "saved"), "trie-tops")
    complete = settle(roll_up(above, height), "trie-complete")
    carried = above.where("rep and depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), "node").join(complete, "node").drop("node")
    to_band = carried.join(by_band.select("conv_id", "band", F.col("path.node").alias("up")), ["conv_id", "band"])
    return _summed(inside.unionByName(to_band.select(F.explode("up").alias("node"), "leaves", "saved")))


def nodes(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = settle(paths(*rebuilt(settle(ordered(conversations), "turns"))), "trie-paths")
    if steps.isEmpty():
        return steps.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    found = steps.groupBy("node", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    children = steps.where("parent is not null").groupBy("parent", "node").agg(F.lit(1).alias("one")).groupBy("parent").agg(F.count("*").alias("n_children"))
    found = found.join(children.withColumnRenamed("parent", "node"), "node", "left")
    found = settle(found.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    own = found.select("node", "conv_id", F.lit(True).alias("_rep"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    items = steps.select("conv_id", "depth", "node").join(own, ["node", "conv_id"], "left")
    totals = roll_up(items.select("conv_id", "depth", "node", F.coalesce("_rep", F.lit(False)).alias("rep"), "leaves", "saved"), height)
    # most nodes may hang on the root, whose smallest member is one value
    root = F.broadcast(found.where("depth = 0").select(F.col("conv_id").alias("_first")))
    parents = found.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = found.where("depth > 1").join(parents, "parent")
    shallow = found.where("depth <= 1").join(root).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("_first"))).drop("_first")
    whole = deep.unionByName(shallow).join(totals, "node").join(ends(steps), "node", "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


#: DuckDB: each node of each smallest member's path adds to all nodes above. crc32 is bit by bit, -1 standing for a shift. For tables without equal turns.
ORACLE = f"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
  string_split(conv_id::varchar, ''), lambda s: [ord(s)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x:
  case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end)) % {SHARED + 1} as h from (select distinct conv_id from t)),
k as (select c.*, least(h, coalesce(n, 0)) as m from c left join (select conv_id as base, count(*) as n from t group by 1) using (base)),
r as (select k.conv_id, pos + 1 as depth, role, text from k join t on t.conv_id = k.base where pos < h
  union all select k.conv_id, pos - h + m + 1, role, text from k join t using (conv_id) where pos >= h),
p as (select conv_id, depth, length(text) as chars, md5(string_agg(md5(role) || md5(text), '') over (partition by conv_id order by depth)) as node from r
  union all select conv_id, 0, 0, 'root' from c),
q as (select *, lag(node) over (partition by conv_id order by depth) as parent, depth = max(depth) over (partition by conv_id) as is_end from p),
n as (select node, depth, parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(chars) as saved,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends_sha256 from q group by all),
d as (select parent as node, count(*) as n_children from n where parent is not null group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join d using (node)),
s as (select q.node, sum((n_children = 0)::bigint) as n_leaves, sum(saved) as saved_tokens from f join q on q.conv_id = f.conv_id and q.depth <= f.depth group by 1)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, f.ends_sha256
from f join s using (node) left join n u on u.node = f.parent
"""
