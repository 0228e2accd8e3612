"""Nearest neighbours by inner product over randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurolake.llm.common import written
from neurolake.llm.vectors import inner, one_per_id, stacked, valid

K = 20
#: Standard errors that the bound allows for; at 1.9 a true neighbour is missed with a probability of a few per cent at most.
EPSILON = 2.2
#: Bits of a code: one a component, and no fewer than these. Vectors with fewer components get zeros as further ones before they are
#: turned; the errors shrink with the root of the bits.
LEAST_BITS = 256
#: Components of the vectors of a block, about.
BLOCK = 1 << 21
#: Queries that meet a block at once.
AT_ONCE = 128
#: Vectors that give every query its first threshold: a bounded sample, those with the smallest hashes.
SAMPLE = 4096
#: Vectors are searched in levels, each this many times the one before; a level's k-th best score is the next one's threshold,
#: so that a query's blocks return about k * WIDEN rows a level, however many blocks there are.
WIDEN = 16
#: What single precision may take from a bound, in units of the lengths.
ROUNDING = 1e-5
SEED = 11


def rotation(d: int, bits: int | None = None) -> np.ndarray:
    """``bits`` rows (``d``, if none) and ``d`` orthonormal columns, random but the same everywhere: turns vectors that have zeros behind their components."""
    bits = bits or d
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, d)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, packed to 64-bit words."""
    pad = -bits.shape[-1] % 64
    bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])
    return np.packbits(bits, axis=-1).view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, their lengths, and the inner products of residual directions with their codes."""
    r = x - centre
    length = np.linalg.norm(r, axis=1)
    u = (r / np.where(length > 0, length, 1)[:, None]) @ turn.T
    return _words((u > 0).astype(np.uint8)), length, np.abs(u).sum(axis=1) / np.sqrt(len(turn))


def decoded(codes: np.ndarray, lengths: np.ndarray, fits: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose inner products with rotated queries estimate those of the residuals, and the bounds of their errors for queries of length one."""
    signs = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1)[:, :bits].astype(np.float32)
    fit = np.maximum(fits, 1e-12)
    errors = EPSILON * lengths * np.sqrt(np.maximum(1 - fits**2, 0)) / fit / np.sqrt(max(bits - 1, 1))
    return (2 * signs - 1) * (lengths / fit / np.sqrt(bits)).astype(np.float32)[:, None], errors


def estimates(q, codes, lengths, fits, centre, turn) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of each query with each coded vector, and the bounds of their errors."""
    rows, errors = decoded(codes, lengths, fits, len(turn))
    return (q @ centre)[:, None] + (q @ turn.T).astype(np.float32) @ rows.T, np.linalg.norm(q, axis=1)[:, None] * errors


def search_block(qid, q, floor, vid, x, code, length, fit, centre, turn, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of a block for each query, none below the query's floor: rows (query, vector, score).

    Estimates and their bounds come from one matrix product, in units of the query's length and of the longest vector, so that
    single precision does for vectors of any length; only vectors whose upper bound reaches the floor get a true product.
    """
    unit = max(length.max(), np.linalg.norm(centre))
    rows, errors = decoded(code, length / unit, fit, len(turn))
    block = np.concatenate([rows, errors[:, None], np.ones((len(rows), 1))], axis=1, dtype=np.float32).T
    parts = []
    for at in range(0, len(q), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        size = np.linalg.norm(q[some], axis=1)
        turned = q[some] / size[:, None]
        upper = np.concatenate([turned @ turn.T, np.ones((len(size), 1)), (turned @ (centre / unit))[:, None]], axis=1, dtype=np.float32) @ block
        least = floor[some] / size / unit - ROUNDING
        rows, cols = np.nonzero(~(upper < least[:, None].astype(np.float32)))
        other = qid[some][rows] != vid[cols]
        rows, cols = rows[other] + at, cols[other]
        score = np.empty(len(rows))
        for i in range(0, len(rows), 1 << 12):
            s = slice(i, i + (1 << 12))
            score[s] = inner(q[rows[s]], x[cols[s]])
        good = score >= floor[rows]
        rows, cols, score = rows[good], cols[good], score[good]
        order = np.lexsort((vid[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        parts.append((qid[rows[best]], vid[cols[best]], score[best]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def best_of(qid, q, ids, x, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every query's floor on a sample, and the sample's ids and scores that set it: the exact ``k`` best, the floor being the last of ``k``."""
    floor, near, scores = np.full(len(q), -np.inf), np.empty(len(q), object), np.empty(len(q), object)
    longest = np.linalg.norm(x, axis=1).max()
    for at in range(0, len(q), AT_ONCE):
        product = q[at : at + AT_ONCE] @ x.T
        product[qid[at : at + AT_ONCE, None] == ids] = -np.inf
        for i, s in enumerate(product, at):
            # rounding may differ from one way of summing to another
            low = np.partition(s, -k)[-k] - 1e-9 * longest * np.linalg.norm(q[i]) if len(s) > k else -np.inf
            top = np.nonzero((s >= low) & (s > -np.inf))[0]
            true = inner(np.broadcast_to(q[i], (len(top), q.shape[1])), x[top])
            order = np.lexsort((ids[top], -true))[:k]
            near[i], scores[i] = ids[top[order]], true[order]
            if len(order) == k:
                floor[i] = scores[i][-1]
    return floor, near, scores


def nearest(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """For every row whose vec_id ``every`` divides, its ``k`` nearest of all other rows by inner product.

    ``embeddings``: ``vec_id, embedding``; other columns are left. Returns ``query_id, rank, vec_id, score``: rank from
    1, nearest first, ties to the smaller vec_id; score is the inner product of the original vectors in double precision.

    Every vector gets a code: the signs of its randomly rotated residual from the mean, packed in 64-bit words, its
    residual's length, and how well the code fits. From these each inner product is estimated with a bound on its error;
    vectors whose upper bound reaches the k-th best score known (first on a bounded sample) are ranked by their true inner
    products. All queries meet all vectors, in blocks of both, so a block's task is bounded
    and the number of blocks grows with the tables.

    Vectors that are null, zero, hold null or non-finite components, or differ in length from most, take no part. Rows
    that repeat a vec_id count once (the smallest vector). With fewer than k candidates all are returned; with none, or an
    empty table, there are no rows.
    """
    spark = embeddings.sparkSession
    rows = written(valid(one_per_id(embeddings)), "vectors")
    head = rows.limit(1).collect()
    if not head:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = len(head[0]["embedding"])
    turn = rotation(d, max(d, LEAST_BITS))

    def sums(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)], "total": [stacked(b["embedding"]).sum(axis=0)]})

    parts = rows.select("embedding").mapInPandas(sums, "n long, total array<double>")
    mean = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(d)]).first()
    n, centre = mean["n"], np.array([mean[f"t{i}"] for i in range(d)]) / mean["n"]
    n_queries = rows.where(F.col("vec_id") % every == 0).count()
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # bounded: SAMPLE vectors
    sample = spark.sparkContext.broadcast((few["vec_id"].to_numpy(), stacked(few["embedding"])))
    # each vector is sent to all blocks of queries, each query to all blocks of vectors: few blocks, but enough tasks
    c_blocks = max(1, -(-n // int(np.clip(n // 64, 1024, max(1024, BLOCK // d)))))
    q_blocks = max(1, -(-n_queries // max(1024, BLOCK // d)))

    def coded(batches):
        for b in batches:
            code, length, fit = encode(stacked(b["embedding"]), centre, turn)
            yield b.assign(code=[c.tobytes() for c in code], length=length, fit=fit)

    def floors(batches):
        ids, x = sample.value
        for b in batches:
            if len(b):
                floor, near, scores = best_of(b["vec_id"].to_numpy(), stacked(b["embedding"]), ids, x, k)
                yield b.assign(floor=floor, near=near, scores=scores)

    kind = rows.schema["embedding"].dataType.simpleString()
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    each = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
    vectors = written(rows.mapInPandas(coded, f"vec_id long, embedding {kind}, code binary, length double, fit double").withColumn("cb", block(c_blocks)), "codes")
    queries = written(rows.where(F.col("vec_id") % every == 0).mapInPandas(floors, f"vec_id long, embedding {kind}, floor double, near array<long>, scores array<double>").withColumn("qb", block(q_blocks)), "queries")
    # the sample's best are results already: a query never has fewer than these
    known = queries.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("z")).select("query_id", F.col("z.near").alias("vec_id"), F.col("z.scores").alias("score"))
    queries = queries.drop("near", "scores")

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        code = np.frombuffer(b"".join(x["code"]), dtype=np.uint64).reshape(len(x), -1)
        a, b, s = search_block(
            q["vec_id"].to_numpy(), stacked(q["embedding"]), q["floor"].to_numpy(), x["vec_id"].to_numpy(), stacked(x["embedding"]), code, x["length"].to_numpy(), x["fit"].to_numpy(), centre, turn, k,
        )
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, low, reach = None, 0, SAMPLE * WIDEN
    while low < c_blocks:
        high = c_blocks if reach >= n else min(c_blocks, max(low + 1, c_blocks * reach // n))
        xs = vectors.where((F.col("cb") >= low) & (F.col("cb") < high)).withColumn("qb", each(0, q_blocks))
        qs = queries.withColumn("cb", each(low, high))
        found = qs.groupBy("qb", "cb").cogroup(xs.groupBy("qb", "cb")).applyInPandas(search, "query_id long, vec_id long, score double")
        found = (known if best is None else best).unionByName(found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        low, reach = high, reach * WIDEN
        if low < c_blocks:
            best = written(best.drop("rank"), "best")
            kth = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("c")).where(F.col("c") == k)
            queries = queries.join(kth.select(F.col("query_id").alias("vec_id"), "kth"), "vec_id", "left")
            queries = queries.select("vec_id", "embedding", F.greatest("floor", "kth").alias("floor"), "qb")
    return best.select("query_id", "rank", "vec_id", "score")


#: The exact result, for small tables.
SQL = """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0), s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score from v q, v c where q.vec_id % 20 = 0 and c.vec_id != q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s) select * from r where rank <= 20"""
