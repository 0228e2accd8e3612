"""The trie of conversations' beginnings, and totals of its subtrees by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolake.llm.common import Scratch, written
from neurolake.llm.variants import crc32_sql

#: Conversations that begin as their group's first one does, and the most turns they take from it.
GROUP, MOST_SHARED = 100, 5
#: Ids in a row of text on their way to a digest.
PART = 1000


def turn_keys(conversations: DataFrame, tables: Scratch) -> DataFrame:
    """``conv_id, block, place, k1, k2, chars``: turns in order, each known by 128 bits of a hash of its role and text.

    Turns are dealt out by ranges of conversation and order; a conversation that lies across several tasks is as many blocks, which
    are numbered from the counts of those before. Text isn't shuffled.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    keys = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("digest"),
        F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), role, text).alias("k2"), F.char_length(text).alias("chars"),
    )
    order = ["turn", "role", "digest"]
    dealt = keys.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id())
    dealt = tables.written(dealt, "turns")
    counts = dealt.groupBy("conv_id", "block").agg(F.count("*").alias("rows"))
    ahead = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("conv_id", "block", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    here = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order))
    placed = dealt.withColumn("here", here).join(counts, ["conv_id", "block"])
    return placed.select("conv_id", "block", (F.col("here") + F.col("ahead")).cast("int").alias("place"), "k1", "k2", "chars")


def with_shared_beginnings(turns: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on their group's first: turns, and the ids of all.

    The first h turns of conversation c are those of conversation c - c % GROUP (all of them, if it has fewer; none, if it isn't there), then
    come c's own after its first h; h is the crc32 of c's decimal digits modulo MOST_SHARED + 1.
    """
    turns = tables.written(turns, "placed")
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("rows"))
    convs = blocks.groupBy("conv_id").agg(F.sum("rows").alias("n"))
    first = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).cast("int"))
    convs = convs.join(first, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int").alias("k"))
    convs = tables.written(convs, "conversations")
    # a conversation of very many turns meets its plan block by block
    plans = blocks.select("conv_id", "block").join(convs.select("conv_id", "h", "k"), "conv_id")
    own = turns.join(plans, ["conv_id", "block"]).where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("k"))
    given = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") <= MOST_SHARED)).select(F.col("conv_id").alias("base"), "place", "k1", "k2", "chars")
    given = given.join(convs.select("conv_id", "base", "k"), "base").where("place <= k").withColumn("block", F.lit(-1))
    columns = ["conv_id", "block", "place", "k1", "k2", "chars"]
    return own.select(*columns).unionByName(given.select(*columns)), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, q1, q2, chars, ends``: of each turn the hash of the way to it, and of the way to the one before.

    A way's hash is the exclusive or of hashes of its turns and their places, so blocks of a conversation are hashed side by side.
    """
    t = turns.select("conv_id", "block", F.col("place").alias("depth"), "chars", *[F.xxhash64(F.lit(i), "place", "k1", "k2").alias(f"t{i}") for i in (1, 2)])
    blocks = t.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.max("depth").alias("deepest"))
    line = Window.partitionBy("conv_id")
    earlier = line.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0).cast("long")).alias(f"c{i}") for i in (1, 2)]
    blocks = blocks.select("conv_id", "block", *carried, F.max("deepest").over(line).alias("last"))
    inner = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.bit_xor(f"t{i}").over(inner).alias(f"l{i}") for i in (1, 2)]).join(blocks, ["conv_id", "block"])
    p = [F.col(f"l{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)]
    return t.select("conv_id", "depth", p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("t1")).alias("q1"), p[1].bitwiseXOR(F.col("t2")).alias("q2"), "chars", (F.col("depth") == F.col("last")).alias("ends"))


WAY = ["depth", "p1", "p2"]


def _joined_ids(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of a way as text, at most PART in a row."""
    for b in rows:
        out, at = [], 0
        ways = list(zip(b["depth"], b["p1"], b["p2"], strict=True))
        ids = b["conv_id"].tolist()
        while at < len(ids):
            end = at + 1
            while end < len(ids) and end - at < PART and ways[end] == ways[at]:
                end += 1
            out.append((*ways[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        yield pd.DataFrame(out, columns=[*WAY, "first_id", "ids"])


def _digests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A way's digest, of its rows in order: what was read is in the digest's state, not in memory."""
    way, state = None, None
    for b in rows:
        out = []
        for depth, p1, p2, ids in zip(b["depth"], b["p1"], b["p2"], b["ids"], strict=True):
            if way == (depth, p1, p2):
                state.update(b"," + ids.encode())
            else:
                if way is not None:
                    out.append((*way, state.hexdigest()))
                way, state = (depth, p1, p2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=[*WAY, "ends_sha256"])
    if way is not None:
        yield pd.DataFrame([(*way, state.hexdigest())], columns=[*WAY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` of ``depth, p1, p2, conv_id``. Ids are sorted over all tasks and joined to rows of text there; a digest
    can only be taken in order, so a way's rows then pass through one task, which holds none of them."""
    ids = ends.select(*WAY, "conv_id").repartitionByRange(*WAY, "conv_id").sortWithinPartitions(*WAY, "conv_id")
    parts = ids.mapInPandas(_joined_ids, "depth int, p1 long, p2 long, first_id long, ids string")
    parts = parts.repartition(*WAY).sortWithinPartitions(*WAY, "first_id")
    return parts.mapInPandas(_digests, "depth int, p1 long, p2 long, ends_sha256 string")


def subtree_sums(tree: DataFrame, values: list[str], tables: Scratch) -> DataFrame:
    """``id`` and each of ``values`` summed over its subtree, by parallel tree contraction.

    ``tree``: ``id, parent`` (null for a root) and the values. A round is two steps. Rake: leaves give their sums to their parents and go.
    Compress: where a node has one child left and a hash of its id and the round says so, and not so of the child if that has one child too, the child
    is hung on the node's parent, and the node, now a leaf, goes in the next round; what it lacks is its child's total. So a chain loses a
    share of its nodes in each round as a bush does, and rounds are logarithmic in the number of nodes however deep the tree. At the end
    contracted nodes are expanded again: each adds the total of the child that it lost, by doubling along such children.
    A node of very many children is a sum that tasks prepare; a round is a written table.
    """
    live, gone, lost, round_ = tables.written(tree.select("id", "parent", *values), "live"), [], [], 0
    while True:
        round_ += 1
        below = live.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k"))
        here = live.join(below, "id", "left").withColumn("leaf", F.col("k").isNull() & F.col("parent").isNotNull())
        raked = here.where("leaf").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("less"), *[F.sum(v).alias(f"_{v}") for v in values])
        here = here.join(raked, "id", "left")
        sums = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        heads = F.pmod(F.xxhash64(F.lit(round_), "id"), F.lit(2)) == 1
        single = ~F.col("leaf") & F.col("parent").isNotNull() & (F.col("k") - F.coalesce("less", F.lit(0)) == 1)
        here = here.select("id", "parent", "leaf", *sums, (single & heads).alias("out"))
        chain = here.where("out").select(F.col("id").alias("over"), F.col("parent").alias("above"))
        hung = here.join(chain, (F.col("parent") == F.col("over")) & ~F.col("leaf") & ~F.col("out"), "left")
        hung = tables.written(hung.select("id", F.coalesce("above", "parent").alias("parent"), *values, "leaf", "over"), "round")
        gone.append(hung.where("leaf").select("id", *values))
        lost.append(hung.where("over is not null").select(F.col("over").alias("id"), F.col("id").alias("next")))
        live = hung.where("not leaf").select("id", "parent", *values)
        if not live.where("parent is not null").limit(1).count():
            break
    total, links = live.select("id", *values), lost[0]
    for more in gone:
        total = total.unionByName(more)
    for more in lost[1:]:
        links = links.unionByName(more)
    total = tables.written(total.join(links, "id", "left"), "totals")
    while total.where("next is not null").limit(1).count():
        child = total.select(F.col("id").alias("next"), F.col("next").alias("after"), *[F.col(v).alias(f"_{v}") for v in values])
        grown = total.where("next is not null").join(child, "next").select("id", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values], F.col("after").alias("next"))
        total = total.where("next is null").unionByName(tables.written(grown, "totals"))
    return total.select("id", *values)


def _trie(turns: DataFrame, convs: DataFrame, tables: Scratch) -> DataFrame:
    ways = tables.written(prefixes(turns), "ways")
    nothing = [F.lit(0).cast("long").alias(c) for c in ("p1", "p2")]
    nodes = ways.groupBy(*WAY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    # one row; none without conversations
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(0).alias("depth"), *nothing, "n_convs", "conv_id", F.lit(0).alias("chars"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = tables.written(nodes.unionByName(root), "nodes")
    # a node is its smallest conversation at its depth
    named = lambda conv, depth: F.struct(F.col(conv).alias("conv_id"), depth.cast("int").alias("depth"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(above, ["depth", "q1", "q2"], "left")
    tree = tree.select(named("conv_id", F.col("depth")).alias("id"), F.when(F.col("depth") > 0, named("parent_conv_id", F.col("depth") - 1)).alias("parent"), *WAY, "n_convs", "chars")
    tree = tables.written(tree, "tree")
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = tables.written(tree.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "tree")
    worth = tree.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(worth, ["n_leaves", "saved_tokens"], tables)
    turnless = convs.join(ways.where("ends").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).alias("depth"), *nothing, "conv_id")
    ends = end_digests(ways.where("ends").select(*WAY, "conv_id").unionByName(turnless))
    out = tree.join(sums, "id").join(ends, WAY, "left")
    return out.select(
        "id.conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent.conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, shared: bool = False) -> DataFrame:
    """A row for each distinct beginning of conversations, with totals of what begins so.

    ``conversations``: ``conv_id`` (an integer), ``turn, role, text``; other columns are not looked at. Turns are ordered by ``turn``, null first; ties
    by role, then by the text's MD5; null roles and texts are empty. ``shared``: conversations are rebuilt first (``with_shared_beginnings``).

    A node of depth d is a distinct sequence of first d turns, the root that of none. Returns ``conv_id`` (the smallest whose conversation begins
    so), ``depth, parent_conv_id`` (null for the root), ``n_convs`` that begin so, ``n_children``, ``n_leaves`` (childless nodes in its subtree, itself
    included), ``saved_tokens`` (over its subtree, n_convs - 1 times the code points of a node's last text: what needn't be computed twice) and
    ``ends_sha256`` of the ids of the conversations that are no longer, ascending, joined by commas.

    Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns like others. An empty table gives an empty result.
    Sequences are told apart by 128 bits of a hash.
    """
    tables = Scratch(conversations.sparkSession)
    turns = turn_keys(conversations, tables)
    if shared:
        turns, convs = with_shared_beginnings(turns, tables)
    else:
        turns = tables.written(turns, "placed")
        convs = tables.written(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id"), "conversations")
    out = written(_trie(turns, convs, tables), "trie")
    tables.drop()
    return out


#: Of the rebuilt conversations.
SQL = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as i
      from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, count(*) as n from t group by 1),
k as (select c.conv_id, c.base, h, least(h, coalesce(b.n, 0)) as k from (select *, {crc32_sql("cast(conv_id as varchar)")} % 6 as h from c) c left join c b on b.conv_id = c.base),
r as (select k.conv_id, i as depth, role, text from k join t on t.conv_id = base and i <= k.k union all select conv_id, i - h + k.k, role, text from k join t using (conv_id) where i > h),
p as (select conv_id, depth, length(text) as chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by depth)) as way from r
      union all select conv_id, 0, 0, '' from c),
n as (select depth, way, min(conv_id) as id, count(*) as n_convs, min(chars) as chars from p group by 1, 2),
q as (select p.conv_id, p.depth, n.id from p join n using (depth, way)),
e as (select n.*, q.id as parent from n left join q on q.conv_id = n.id and q.depth = n.depth - 1),
ch as (select parent as id, depth - 1 as depth, count(*) as n_children from e where depth > 0 group by 1, 2),
y as (select n.id, n.depth, case when n_children is null then 1 else 0 end as leaf, (n_convs - 1) * chars as saved from n left join ch using (id, depth)),
sb as (select q.id, q.depth, sum(leaf) as n_leaves, sum(saved) as saved_tokens from q join y on y.id = q.conv_id and y.depth >= q.depth group by 1, 2),
la as (select conv_id, max(depth) as depth from p group by 1),
en as (select q.id, q.depth, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends from la join q using (conv_id, depth) group by 1, 2)
select e.id as conv_id, e.depth, parent as parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens,
       coalesce(ends, sha256('')) as ends_sha256
from e left join ch using (id, depth) join sb using (id, depth) left join en using (id, depth)
"""
