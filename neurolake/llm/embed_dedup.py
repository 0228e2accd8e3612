"""Near-duplicate vectors: links of cosine 0.9 or more, found by NN-descent over small balls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolake.llm.common import connected_components, written
from neurolake.llm.vectors import one_per_id, stacked, valid

COSINE = 0.9
ANGLE = math.acos(COSINE)
#: Vectors within half that angle of one vector are all linked to each other; a trifle less, for rounding.
BALL = math.cos(ANGLE / 2) + 1e-6
#: Nearest neighbours of a list. Beyond them it holds as many that could matter for a link as a chunk, others each round; all found count.
NEIGHBOURS = 10
ROUNDS = 3
#: Hash tables for balls and for the first lists; chunks of a vertex's neighbours, and of a ball's members, for one task's step.
BALL_TABLES, FIRST_TABLES, JOIN_CHUNK, MEMBER_CHUNK = 12, 5, 24, 256
#: Rows that one call in a task compares, group by group.
BATCH = 4096
#: Rounds go on while more than this share of lists improves, up to MOST_ROUNDS.
IMPROVING, MOST_ROUNDS = 0.02, 6
#: Share of links that must be found: of those of AUDITED vectors, and of all by the estimate of recapture; or else the search goes on.
TARGET, AUDITED = 0.999, 256
#: Draws of fresh hash tables, at the least bound, against which what was found is held; descents; then all units are compared in blocks of so many.
DRAWS, DESCENTS, EXACT_BLOCK = 12, 2, 2048


def _unit(column) -> np.ndarray:
    x = stacked(column)
    # scaled first, so that squares of very large or small components stay finite
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(rows: DataFrame, d: int, tables: int, bits: int, seed: int) -> DataFrame:
    """``bucket, vec_id`` for each table: signs of ``bits`` random projections."""
    planes = np.random.default_rng(seed).standard_normal((d, tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def hashes(batches):
        for b in batches:
            signs = (_unit(b["embedding"]) @ planes > 0).reshape(len(b), tables, bits)
            codes = (signs * weights).sum(axis=2) * 64 + np.arange(tables)
            yield pd.DataFrame({"vec_id": b["vec_id"], "bucket": list(codes)})

    return rows.select("vec_id", "embedding").mapInPandas(hashes, "vec_id long, bucket array<long>").select("vec_id", F.explode("bucket").alias("bucket"))


def _cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b, sim`` of pairs ``a, b``."""

    def dots(batches):
        for b in batches:
            if len(b):
                sim = np.einsum("ij,ij->i", _unit(b["ea"]), _unit(b["eb"]))
                yield pd.DataFrame({"a": b["a"], "b": b["b"], "sim": sim})

    left = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    right = rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInPandas(dots, "a long, b long, sim double")


def _balls(rows: DataFrame, d: int, n: int) -> DataFrame:
    """``vec_id, unit``: the smallest pivot, of the vector's buckets, in whose ball it lies, or else itself."""
    bits = min(50, max(8, math.ceil(math.log2(max(n, 2))) + 4))
    hashed = written(_hashed(rows, d, BALL_TABLES, bits, 3), "ball-buckets")
    pivots = hashed.groupBy("bucket").agg(F.min("vec_id").alias("b"), F.count("*").alias("c")).where("c > 1").select("bucket", "b")
    pairs = hashed.join(pivots, "bucket").where("vec_id != b").select(F.col("vec_id").alias("a"), "b").distinct()
    near = _cosines(pairs, rows).where(F.col("sim") >= BALL).groupBy("a").agg(F.min_by(F.struct("b", "sim"), "b").alias("x"))
    near = near.select(F.col("a").alias("vec_id"), F.col("x.b").alias("unit"), F.acos(F.least("x.sim", F.lit(1.0))).alias("off"))
    return rows.select("vec_id").join(near, "vec_id", "left").select("vec_id", F.coalesce("unit", "vec_id").alias("unit"), F.coalesce("off", F.lit(0.0)).alias("off"))


def _best(candidates: DataFrame, done: int) -> DataFrame:
    """Lists ``a, b, sim, useful, rank``: each vertex's NEIGHBOURS nearest, and of the others that could hold a link a draw of this round."""
    unique = candidates.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("useful").alias("useful"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    drawn = Window.partitionBy("a", "useful").orderBy(F.xxhash64("a", "b", F.lit(done)), "b")
    ranked = unique.withColumn("rank", F.row_number().over(order)).withColumn("turn", F.row_number().over(drawn))
    return ranked.where((F.col("rank") <= NEIGHBOURS) | (F.col("useful") & (F.col("turn") <= JOIN_CHUNK))).drop("turn")


def _group_pairs(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each member of a group, all others that could hold a link with it, and its nearest that beat what its list holds already."""
    s = np.clip(x @ x.T, -1.0, 1.0)
    same = ids[:, None] == ids[None, :]
    useful = ~same & (np.arccos(s) <= radius[:, None] + radius[None, :] + ANGLE + 1e-6)
    s[same] = -2
    top = min(NEIGHBOURS, len(ids) - 1)
    near = s >= np.partition(s, -top, axis=1)[:, -top, None]
    rows, cols = np.nonzero(useful | ((s > worst[:, None]) & near & (s > -2)))
    return ids[rows], ids[cols], s[rows, cols], useful[rows, cols]


def _many_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Several groups of ``group, chunk`` at once: a task's call holds about BATCH rows, and no group is compared with another."""
    order = np.lexsort((pdf["chunk"].to_numpy(), pdf["group"].to_numpy()))
    pdf = pdf.iloc[order]
    g, c = pdf["group"].to_numpy(), pdf["chunk"].to_numpy()
    cuts = np.nonzero((np.diff(g) != 0) | (np.diff(c) != 0))[0] + 1
    ids, x, worst, radius = pdf["vec_id"].to_numpy(), _unit(pdf["embedding"]), pdf["worst"].to_numpy(), pdf["radius"].to_numpy()
    parts = [_group_pairs(ids[i:j], x[i:j], worst[i:j], radius[i:j]) for i, j in zip([0, *cuts], [*cuts, len(pdf)], strict=True) if j - i > 1]
    a, b, s, u = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else ([], [], [], [])
    return pd.DataFrame({"a": a, "b": b, "sim": s, "useful": u})


def _in_batches(rows: DataFrame, n: int) -> DataFrame:
    """Pairs of ``rows`` (group, chunk, vec_id, embedding, radius, worst) of about ``n`` vectors' groups."""
    batches = max(1, n // BATCH)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("group", "chunk"), F.lit(batches)))
    return dealt.groupBy("batch").applyInPandas(_many_groups, "a long, b long, sim double, useful boolean")


def _first_lists(units: DataFrame, d: int, n: int, again: int) -> DataFrame:
    """Pairs of vectors that share a coarse bucket, each bucket cut into chunks, in an order of its own."""
    bits = min(50, max(1, round(math.log2(max(n, 2) / 12))))
    hashed = _hashed(units, d, FIRST_TABLES, bits, 4 + again)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("bucket", "vec_id", F.lit(again)), "vec_id")) - 1
    hashed = hashed.withColumn("chunk", F.floor(place / JOIN_CHUNK)).join(units, "vec_id").withColumn("worst", F.lit(-1.0))
    return _in_batches(hashed.withColumnRenamed("bucket", "group"), n * FIRST_TABLES)


def _round(lists: DataFrame, units: DataFrame, n: int, done: int) -> DataFrame:
    """New pairs: neighbours and reverse neighbours of a vertex, taken together, in chunks of an order of the vertex and round."""
    both = lists.select(F.col("a").alias("v"), F.col("b").alias("vec_id")).union(lists.select(F.col("b").alias("v"), F.col("a").alias("vec_id"))).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("v", "vec_id", F.lit(done)), "vec_id")) - 1
    worst = lists.where(F.col("rank") == NEIGHBOURS).select(F.col("a").alias("vec_id"), F.col("sim").alias("worst"))
    held = units.join(worst, "vec_id", "left").withColumn("worst", F.coalesce("worst", F.lit(-1.0)))
    joined = both.withColumn("chunk", F.floor(place / JOIN_CHUNK)).join(held, "vec_id")
    return _in_batches(joined.withColumnRenamed("v", "group"), n * 2 * NEIGHBOURS)


def neighbour_graph(units: DataFrame, d: int, n: int, before: DataFrame | None = None, again: int = 0) -> tuple[DataFrame, DataFrame]:
    """NN-descent over ``units`` (vec_id, embedding, radius): lists of near units, refined until few of their nearest improve, from
    ``before`` and fresh hash tables; and ``a, b`` of all pairs met on the way that could hold a link."""
    new = written(_first_lists(units, d, n, again), "pairs")
    met = [new]
    keep = ["a", "b", "sim", "useful"]
    done = again * MOST_ROUNDS
    lists = written(_best(new if before is None else new.union(before.select(keep)), done), "lists")
    for k in range(1, MOST_ROUNDS + 1):
        new = written(_round(lists, units, n, done + k), "pairs")
        met.append(new)
        after = written(_best(lists.select(keep).union(new), done + k), "lists")
        nearest = F.col("rank") <= NEIGHBOURS
        changed = None if k < ROUNDS else after.where(nearest).join(lists.where(nearest), ["a", "b"], "left_anti").select("a").distinct().count()
        lists = after
        if changed is not None and changed <= IMPROVING * n:
            break
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.union(more)
    return lists, pairs.where("useful").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hits(x: pd.DataFrame, y: pd.DataFrame | None = None) -> pd.DataFrame:
    """``vec_id, n, unit, lowest``: links of each vector of ``x`` to those of ``y`` (without it, to others of ``x``) in other units, and
    the lowest unit that such links lead to."""
    one = y is None
    y = x if one else y
    a, b = x["unit"].to_numpy(dtype=np.int64), y["unit"].to_numpy(dtype=np.int64)
    ex = _unit(x["embedding"])
    hit = (ex @ (ex if one else _unit(y["embedding"])).T >= COSINE) & (a[:, None] != b[None, :])
    most = np.iinfo(np.int64).max
    la, lb, before = a.copy(), b.copy(), None
    while before is None or (la != before[0]).any() or (lb != before[1]).any():
        before = la, lb
        la = np.minimum(la, np.where(hit, lb[None, :], most).min(axis=1))
        lb = la if one else np.minimum(lb, np.where(hit, la[:, None], most).min(axis=0))
    out = pd.DataFrame({"vec_id": x["vec_id"].to_numpy(), "n": hit.sum(axis=1), "unit": a, "lowest": la})
    if not one:
        out = pd.concat([out, pd.DataFrame({"vec_id": y["vec_id"].to_numpy(), "n": hit.sum(axis=0), "unit": b, "lowest": lb})])
    return out[out["n"] > 0]


HITS = "vec_id long, n long, unit long, lowest long"


def _counted(gangs: DataFrame, placed: DataFrame, sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """``_hits`` of all pairs of blocks of each gang (``unit, gang``): blocks are about MEMBER_CHUNK vectors of one large unit, or of small ones.

    A large unit's own blocks don't meet, nor do those of two large units whose radii say that they can't be linked.
    """
    homes = sizes.join(gangs, "unit").withColumn("large", F.col("size") > MEMBER_CHUNK)
    small = homes.where("not large").groupBy("gang").agg(F.sum("size").alias("small"))
    homes = homes.join(small, "gang", "left").withColumn("home", F.when(F.col("large"), F.col("unit")).otherwise(F.col("gang")))
    homes = homes.withColumn("chunks", F.ceil(F.when(F.col("large"), F.col("size")).otherwise(F.col("small")) / MEMBER_CHUNK))
    key = ["gang", "large", "home", "chunk"]
    members = placed.select("vec_id", "unit").join(homes.select("unit", "gang", "large", "home", "chunks"), "unit")
    members = members.select("vec_id", "unit", *key[:3], F.pmod(F.xxhash64("vec_id"), F.col("chunks")).alias("chunk"))
    of_gang = Window.partitionBy("gang")
    blocks = members.groupBy(*key).count().drop("count").withColumn("part", F.row_number().over(of_gang.orderBy("large", "home", "chunk")))
    blocks = written(blocks.withColumn("parts", F.count("*").over(of_gang)), "blocks")
    members = written(members.join(blocks, key).select("vec_id", "unit", "gang", "part", "parts").join(rows, "vec_id"), "members")

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_hits(g) for _, g in pdf.groupby("gang")])

    few = members.where("parts = 1").withColumn("batch", F.pmod(F.xxhash64("gang"), F.lit(max(1, sizes.count() // BATCH))))
    lone = few.groupBy("batch").applyInPandas(alone, HITS)

    i, j = (blocks.where("parts > 1").select("gang", *[F.col(c).alias(f"{c}_{k}") for c in ("large", "home", "part")]) for k in "ij")
    tasks = i.join(j, "gang").where("part_i <= part_j and not (large_i and large_j and home_i = home_j)")
    both = F.col("large_i") & F.col("large_j")
    apart = _cosines(tasks.where(both).select(F.col("home_i").alias("a"), F.col("home_j").alias("b")).distinct(), rows)
    for c in "ab":
        apart = apart.join(sizes.select(F.col("unit").alias(c), F.col("radius").alias(f"r{c}")), c)
    apart = apart.where(F.acos(F.greatest(F.least("sim", F.lit(1.0)), F.lit(-1.0))) > F.col("ra") + F.col("rb") + ANGLE + 1e-6)
    tasks = tasks.join(apart.select(F.col("a").alias("home_i"), F.col("b").alias("home_j"), F.lit(True).alias("apart")), ["home_i", "home_j"], "left")
    tasks = written(tasks.where(~both | F.col("apart").isNull()).select("gang", "part_i", "part_j"), "tasks")
    key = ["gang", "part_i", "part_j"]
    left = tasks.join(members.select("gang", F.col("part").alias("part_i"), "vec_id", "unit", "embedding"), key[:2])
    right = tasks.where("part_i < part_j").join(members.select("gang", F.col("part").alias("part_j"), "vec_id", "unit", "embedding"), [key[0], key[2]])
    right = right.select(*[F.col(k).alias(f"{k}_") for k in key], *[F.col(c).alias(c) for c in ("vec_id", "unit", "embedding")])
    met = left.groupBy(*key).cogroup(right.groupBy(*[f"{k}_" for k in key]))
    across = met.applyInPandas(lambda x, y: _hits(x, y if len(y) else None), HITS)
    return written(lone.unionByName(across), "crossing")


def _linked(everything: DataFrame, rows: DataFrame, placed: DataFrame, sizes: DataFrame, near: DataFrame) -> DataFrame:
    """The result from ``near``, pairs of units: all links between members of units that a path of such pairs connects."""
    gangs = written(connected_components(near), "gangs").select(F.col("node").alias("unit"), F.col("component").alias("gang"))
    crossing = _counted(gangs, placed, sizes, rows)
    groups = connected_components(crossing.select(F.col("unit").alias("a"), F.col("lowest").alias("b")).distinct())
    counts = crossing.groupBy("vec_id").agg(F.sum("n").alias("across"))
    named = placed.select("vec_id", "unit").join(sizes.select("unit", "size"), "unit").join(groups.withColumnRenamed("node", "unit"), "unit", "left")
    named = named.withColumn("component", F.coalesce("component", "unit"))
    lowest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(lowest, "component").join(counts, "vec_id", "left")
    linked = linked.select("vec_id", (F.col("size") - 1 + F.coalesce("across", F.lit(0))).alias("links"), F.col("component_id").alias("lowest"))
    out = everything.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("lowest", "vec_id")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    return written(out, "links")


def near_duplicate_vectors(embeddings: DataFrame) -> DataFrame:
    """Links between vectors of cosine 0.9 or more, as counts and components.

    ``embeddings``: ``vec_id, embedding``; other columns (labels) are left. Returns a row a vec_id: ``vec_id, n_links,
    component_id, kept``.

    Vectors within half the link's angle of a common pivot are one unit: they are all linked, by the triangle inequality
    of angles. NN-descent over the units' pivots refines lists of neighbours: the neighbours and reverse neighbours of each
    vertex are compared with each other. Every pair met that could carry links, that is up to the link's angle plus both
    units' radii, connects two units, in a list or not; members of all units so connected are compared in blocks and counted.

    No pair below the threshold is ever linked; one above is missed only where no path of pairs met connects its units. What is missing is
    audited twice. Where links are rare, a sample of vectors holds none, so fresh hash tables that know nothing of the descent are drawn: what they find and it
    hasn't is added, and how much of what it has they find again says how much both may have missed (``recaptured``). And the links of
    AUDITED vectors are counted against all others. While either says that less than TARGET was found, a descent begins again from other hash
    tables; after DESCENTS of them all units are compared in blocks, which is exact and costs their square. Null, zero or non-finite vectors, and those of another length than most, link with nothing. A null vec_id
    makes a row with null ids, kept. Rows that repeat a vec_id are one (the smallest vector). Empty tables give no rows.
    """
    everything = written(one_per_id(embeddings), "vectors")
    rows = valid(everything)
    head = rows.limit(1).collect()
    alone = everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not head:
        return alone
    d, n = len(head[0]["embedding"]), rows.count()
    placed = written(_balls(rows, d, n), "balls")
    sizes = placed.groupBy("unit").agg(F.count("*").alias("size"), F.max("off").alias("radius"))
    sizes = written(sizes, "units")
    units = written(rows.join(sizes.select(F.col("unit").alias("vec_id"), "radius"), "vec_id"), "centres")
    true, many = written(_true_links(rows, AUDITED), "audit"), sizes.count()
    lists, near = None, None
    for again in range(DESCENTS):
        lists, more = neighbour_graph(units, d, many, lists, again)
        near = written(more if near is None else near.union(more).distinct(), "near")
        near, missing = recaptured(units, d, many, near, again)
        if missing <= 1 - TARGET:
            out = _linked(everything, rows, placed, sizes, near)
            if _recall(true, out) >= TARGET:
                return out
    return _linked(everything, rows, placed, sizes, written(near.union(_all_pairs(units, many)).distinct(), "near"))


def recaptured(units: DataFrame, d: int, n: int, near: DataFrame, again: int) -> tuple[DataFrame, float]:
    """``near`` (pairs of units that could hold a link) with those that fresh hash tables show, and the share that is missing still.

    Tables are drawn until they alone have met a share r of the pairs of ``near``. Of the pairs that they met a share u was new. Both searches are independent, so of
    all pairs about (1 - r) u are in neither. Without any pair that is no estimate: then tables are drawn until two vectors at the threshold would share a bucket
    with a probability of 0.99. There are as many draws at most as make that TARGET, a number that grows as a small root of the number of vectors.
    """
    fresh, draws = None, 0
    known = near.count()
    bits = min(50, max(1, round(math.log2(max(n, 2) / 12))))
    once = (1 - ANGLE / math.pi) ** bits
    most = max(DRAWS, math.ceil(math.log(1 - TARGET) / math.log(1 - once) / FIRST_TABLES))
    while True:
        met = _first_lists(units, d, n, 1000 + again * DRAWS + draws).where("useful").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        draws += 1
        fresh = written(met if fresh is None else fresh.union(met).distinct(), "fresh")
        found, seen = fresh.count(), fresh.join(near, ["a", "b"], "left_semi").count()
        if known or found:
            missing = (1 - seen / max(known, 1)) * (1 - seen / max(found, 1))
            done = missing <= 1 - TARGET
        else:
            missing = 0.0
            done = (1 - once) ** (draws * FIRST_TABLES) <= 0.01
        if done or draws == most:
            return written(near.union(fresh).distinct(), "near"), missing


def _all_pairs(units: DataFrame, n: int) -> DataFrame:
    """``a, b``: pairs of units that could hold a link, by comparing all in blocks of about EXACT_BLOCK; each unit goes to as many tasks as there are blocks."""
    blocks = -(-n // EXACT_BLOCK)
    own = units.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = own.select("vec_id", "embedding", "radius", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf["own"].to_numpy() == pdf["i"].to_numpy()
        x, y = pdf[low], pdf[~low] if (pdf["i"] != pdf["j"]).any() else pdf
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        angle = np.arccos(np.clip(_unit(x["embedding"]) @ _unit(y["embedding"]).T, -1.0, 1.0))
        r, c = np.nonzero(angle <= x["radius"].to_numpy()[:, None] + y["radius"].to_numpy()[None, :] + ANGLE + 1e-6)
        a, b = x["vec_id"].to_numpy()[r], y["vec_id"].to_numpy()[c]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()

    return rows.groupBy("i", "j").applyInPandas(compare, "a long, b long")


def _true_links(rows: DataFrame, sample: int) -> DataFrame:
    """``vec_id, n``: links of ``sample`` vectors (those with the smallest hashes), counted against all others."""
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # bounded: ``sample`` vectors
    ids, x = few["vec_id"].to_numpy(), _unit(few["embedding"]) if len(few) else None

    def count(batches):
        total = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            total += ((x @ _unit(b["embedding"]).T >= COSINE) & (ids[:, None] != b["vec_id"].to_numpy()[None, :])).sum(axis=1)
        yield pd.DataFrame({"vec_id": ids, "n": total})

    return rows.mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))


def _recall(true: DataFrame, result: DataFrame) -> float:
    both = true.join(result, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not both[0] else both[1] / both[0]


def recall_audit(embeddings: DataFrame, result: DataFrame, sample: int = 256) -> float:
    """Share of the links of ``sample`` vectors (those with the smallest hashes), counted against all others, that ``result`` has."""
    return _recall(_true_links(valid(one_per_id(embeddings)), sample), result)


#: The exact result, for small tables.
SQL = """with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0), ln as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as node, vec_id as root from embeddings union select ln.b, root from reach join ln on ln.a = node)
select vec_id, (select count(*) from ln where a = vec_id) as n_links, (select min(root) from reach where node = vec_id) as component_id,
(select min(root) from reach where node = vec_id) = vec_id as kept from embeddings"""
