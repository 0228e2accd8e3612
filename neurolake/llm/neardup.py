"""Near-duplicate documents: banded MinHash, odd sketches, and a check on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurolake.llm.common import Scratch, connected_components, roots, shuffle_partitions, written

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair of similarity 0.75 shares no band with probability (1 - 0.75^5)^32 = 0.0002.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch. At 0.75 the sketch's estimate has a standard error of 0.04; pairs five of these below are dropped.
BITS = 512
LEAST_ESTIMATE = 0.56
#: Samples and bits of the finer sketches by which sets are compared across components; their estimate's standard error is 0.0185,
#: and pairs 4.5 of these below the threshold are dropped.
FINE_SAMPLES, FINE_BITS, FINE_LEAST = 1024, 4096, 0.667
#: Finer bands: a pair of similarity 0.75 shares none with probability (1 - 0.75^10)^160 = 0.0001, one of 0.5 does with 0.15 and one of 0.33 with 0.002.
FINE_BANDS, FINE_ROWS = 160, 10
#: Rounds in which components are paired with the largest of their buckets by their nearest sets; sets of a component that meet others at once.
AGAIN, CHUNK = 3, 256
#: Sets that a rare shingle joins pair by pair, at most this many squared pairs; beyond that in blocks.
BUSY = 64


def most_bits(bits: int, samples: int, least: float) -> int:
    """The XOR of two sketches has about bits / 2 * (1 - (1 - 2 / bits) ^ d) bits when the samples differ in d elements."""
    return math.floor(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - least))))


MOST_BITS, FINE_MOST_BITS = most_bits(BITS, SAMPLES, LEAST_ESTIMATE), most_bits(FINE_BITS, FINE_SAMPLES, FINE_LEAST)

_rng = np.random.default_rng(20240607)


def _odd(dtype, *shape: int) -> np.ndarray:
    return _rng.integers(0, np.iinfo(dtype).max, size=shape, dtype=dtype, endpoint=True) | dtype(1)


_ODD, _ADD = _odd(np.uint32, SAMPLES), _odd(np.uint32, SAMPLES)
_FINE_ODD, _FINE_ADD = _odd(np.uint32, FINE_SAMPLES), _odd(np.uint32, FINE_SAMPLES)
_PLACE, _BAND, _FINE_BAND = _odd(np.uint64, SHINGLE, SHINGLE), _odd(np.uint64, BANDS, ROWS), _odd(np.uint64, FINE_BANDS, FINE_ROWS)
_PICK = np.stack([_rng.permutation(FINE_SAMPLES)[:FINE_ROWS] for _ in range(FINE_BANDS)])
#: Words' hashes: a weight for each byte (none for white space) times powers of BASE.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = np.where(_SPACE, np.uint64(0), _odd(np.uint64, 256))
BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once.
BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [base] * n, dtype=np.uint64), dtype=np.uint64)


_UP, _DOWN = _powers(BASE, BLOCK), _powers(pow(BASE, -1, 1 << 64), BLOCK)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words, A-Z in lower case, in order.

    A word is the polynomial of its bytes' weights in BASE, mod 2^64: the difference of two running sums over the text, moved to the
    power 0. Words beyond 64 bytes, where such polynomials are weak against made-up input, are hashed by xxHash.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(raw) <= BLOCK:
        return _hashed(raw)
    words, parts, some, size = raw.split(), [], [], 0
    for w in words:
        if some and size + len(w) > BLOCK:
            parts.append(_hashed(b" ".join(some)))
            some, size = [], 0
        some.append(w if len(w) < BLOCK else w[:65])
        size += len(some[-1]) + 1
        if len(w) >= BLOCK:
            parts.append(_hashed(b" ".join(some)))
            parts[-1][-1] = xxhash.xxh3_64_intdigest(w)
            some, size = [], 0
    return np.concatenate([*parts, _hashed(b" ".join(some))])


def _hashed(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[b] * _UP[: len(b)], dtype=np.uint64)])
    turn = np.diff(_SPACE[b].astype(np.int8), prepend=1, append=1)
    start, end = np.nonzero(turn == -1)[0], np.nonzero(turn == 1)[0]
    out = _mix((total[end] - total[start]) * _DOWN[start])
    for i in np.nonzero(end - start > 64)[0]:
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return out


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(len(h), SHINGLE)
    total = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _PLACE[k - 1, j]
    return np.unique(_mix(total))


def _lowest(hashes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """MinHash samples: for each function the least of its values on the upper halves of the set's hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(odd), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(low, (x[at : at + 256, None] * odd + add).min(axis=0), out=low)
    return low.astype(np.uint64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parities of how many samples, each hashed with its number, fall on each bit."""
    places = _mix(samples | np.arange(len(samples), dtype=np.uint64) << np.uint64(32)) % np.uint64(bits)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _banded(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _mix((rows * weights).sum(axis=1, dtype=np.uint64) + np.arange(len(weights), dtype=np.uint64)).view(np.int64)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and the odd sketch of a set."""
    low = _lowest(hashes, _ODD, _ADD)
    return _banded(low.reshape(BANDS, ROWS), _BAND), odd_sketch(low, BITS)


def _key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, mark, text in zip(b["doc_id"], b["mark"], b["text"], strict=True):
            h = shingles(text)
            rows.append((doc, mark, len(h), _key(h), *signature(h)) if len(h) else (doc, mark, 0, None, None, None))
        yield pd.DataFrame(rows, columns=["doc_id", "mark", "n", "key", "bands", "sketch"]).astype({"doc_id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        right = [_key(s) == k for s, k in zip(sets, b["key"], strict=True)]
        yield pd.DataFrame({"sid": b["sid"], "hashes": [s.tobytes() for s in sets]})[right]


def _fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        low = [_lowest(np.frombuffer(h, dtype=np.uint64), _FINE_ODD, _FINE_ADD) for h in b["hashes"]]
        yield pd.DataFrame({"sid": b["sid"], "n": [len(h) // 8 for h in b["hashes"]], "component": b["component"], "bands": [_banded(x[_PICK], _FINE_BAND) for x in low], "fine": [odd_sketch(x, FINE_BITS) for x in low]})


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yes = []
        for x, y in zip(b["xa"], b["xb"], strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield b.loc[yes, [c for c in b.columns if c not in ("xa", "xb")]]


def _sized(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _apart(a: Column, b: Column, bits: int) -> Column:
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, bits // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def _both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``pairs`` with ``value`` of ``table`` (by sid) for a and b, as xa and xb."""
    for c in "ba":
        pairs = pairs.join(table.select(F.col("sid").alias(c), F.col(value).alias(f"x{c}")), c)
    return pairs


def _sketched(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b: sids) those of which sizes and odd sketches leave a similarity of 0.75 possible."""
    a, b = F.col("xa"), F.col("xb")
    near = _sized(a["n"], b["n"]) & (_apart(a["sketch"], b["sketch"], BITS) <= MOST_BITS)
    return _both(pairs, side, "s").where(near).drop("xa", "xb")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` those whose full sets are similar enough."""
    kept = ", ".join(f"{c} long" for c in pairs.columns)
    return _both(pairs, sets, "hashes").mapInPandas(_linked, kept)


def _full_sets(docs: DataFrame, needed: DataFrame, tables: Scratch) -> DataFrame:
    """``sid, hashes`` of ``needed`` (sid, key, low, mark), made again from the texts of the rows that stand for them."""
    least = lambda c: F.coalesce(c, F.lit(-(1 << 63)))  # noqa: E731  so that null ids meet
    rows = needed.select("sid", "key", least(F.col("low")).alias("doc_id"), "mark")
    texts = docs.withColumn("doc_id", least(F.col("doc_id"))).join(rows, ["doc_id", "mark"]).select("sid", "key", "text")
    sets = tables.written(texts.mapInPandas(_sets, "sid long, hashes binary"), "sets")
    if sets.count() > sets.select("sid").distinct().count():  # rows that repeat an id and its text
        sets = tables.written(sets.groupBy("sid").agg(F.first("hashes").alias("hashes")), "sets")
    return sets


def _mixed(own: DataFrame) -> DataFrame:
    """``own`` (bucket, sid, component) of buckets that hold several components, with the largest's name as ``main``."""
    sizes = own.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("k")).where("k > 1")
    return own.join(main.select("bucket", F.col("m.component").alias("main")), "bucket")


def _placed(own: DataFrame, groups: DataFrame) -> DataFrame:
    """``own`` with its components renamed as ``groups`` (node, component) says."""
    groups = groups.select(F.col("node").alias("component"), F.col("component").alias("into"))
    others = [c for c in own.columns if c != "component"]
    return own.join(groups, "component", "left").select(*others, F.coalesce("into", "component").alias("component"))


def _near_main(best: bool):
    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each group, pairs of a set outside the main component and one in it that sizes and finer sketches leave; the nearest only, if ``best``."""
        pdf = pdf.sort_values(["main", "i", "j", "large"])
        large, sid, part, n = (pdf[c].to_numpy() for c in ("large", "sid", "component", "n"))
        bits = np.stack(pdf["fine"].to_numpy()).view(np.uint64)
        cuts = np.nonzero((np.diff(pdf[["main", "i", "j"]].to_numpy(), axis=0) != 0).any(axis=1))[0] + 1
        out = []
        for at, end in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            mid = at + int((~large[at:end]).sum())
            x, y = bits[at:mid], bits[mid:end]
            if not len(x) or not len(y):
                continue
            far = np.zeros((len(x), len(y)), dtype=np.int64)
            for w in range(bits.shape[1]):
                far += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
            nx, ny = n[at:mid, None], n[None, mid:end]
            far[100 * np.minimum(nx, ny) < PERCENT * np.maximum(nx, ny)] = FINE_BITS
            r, c = (np.arange(len(x)), far.argmin(axis=1)) if best else np.nonzero(far <= FINE_MOST_BITS)
            some = far[r, c] <= FINE_MOST_BITS
            r, c = r[some] + at, c[some] + mid
            out.append((sid[r], sid[c], part[r], part[c], far[r - at, c - mid]))
        return pd.DataFrame(dict(zip(("a", "b", "ca", "cb", "far"), map(np.concatenate, zip(*out)) if out else [[]] * 5, strict=True)))

    return near


def _to_main(own: DataFrame, fine: DataFrame, best: bool) -> DataFrame:
    """Pairs of a set and a member of the largest component of one of its buckets, which meet in chunks of both; ``best``: one for two components."""
    rows = own.select("main", "sid", "component", (F.col("component") == F.col("main")).alias("large")).distinct()
    chunks = rows.groupBy("main").agg(*[F.ceil(F.count_if(F.col("large") == x) / CHUNK).alias(c) for c, x in (("ci", False), ("cj", True))])
    each = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    own_chunk = lambda c: F.array(F.pmod(F.xxhash64("sid"), F.col(c)))
    rows = rows.join(chunks, "main").join(fine.drop("component", "bands"), "sid")
    rows = rows.withColumn("i", F.explode(F.when(F.col("large"), each("ci")).otherwise(own_chunk("ci"))))
    rows = rows.withColumn("j", F.explode(F.when(F.col("large"), own_chunk("cj")).otherwise(each("cj")))).drop("ci", "cj")
    batches = shuffle_partitions(own.sparkSession) * 4
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("main", "i", "j"), F.lit(batches)))
    pairs = rows.groupBy("batch").applyInPandas(_near_main(best), "a long, b long, ca long, cb long, far long")
    if best:
        pairs = pairs.groupBy("ca", "cb").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b", "ca", "cb")
    return pairs.select("a", "b", "ca", "cb")


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a shingle of sets, a bounded number of rows at once."""
    for b in batches:
        some, size = [], 0
        for sid, component, raw in [*zip(b["sid"], b["component"], b["hashes"], strict=True), (None, None, b"")]:
            if sid is None or size > 1 << 18:
                if some:
                    n = np.array([len(h) for _, _, h in some])
                    yield pd.DataFrame({"sid": np.repeat([x[0] for x in some], n), "component": np.repeat([x[1] for x in some], n), "n": np.repeat(n, n), "h": np.concatenate([h for _, _, h in some])})
                some, size = [], 0
            if sid is not None:
                some.append((sid, component, np.frombuffer(raw, dtype=np.int64)))
                size += len(raw) // 8


def _prefixes(rest: DataFrame, sets: DataFrame, tables: Scratch) -> DataFrame:
    """``h, sid, component, n, index``: of each set the rarest shingles, of which it must share one with any set that is similar enough.

    A set of n shingles shares at least 3/4 n with such a set, so one of its n - ceil(3/4 n) + 1 rarest; with one as large or larger
    at least 6/7 n, so one of its n - ceil(6/7 n) + 1 rarest (``index``). Rarest: in the order of how many sets of ``rest`` hold a shingle. Those
    that one set holds alone meet nothing, and need no row; nor do those that sets of one component hold alone.
    """
    spread = tables.written(rest.join(sets, "sid").mapInPandas(_spread, "sid long, component long, n long, h long"), "shingles")
    often = spread.groupBy("h").agg(F.count("*").alias("sets"), (F.min("component") != F.max("component")).alias("mixed")).where("sets > 1")
    often = tables.written(often, "shared-shingles")
    of_set = Window.partitionBy("sid")
    known = spread.join(often, "h").withColumn("place", F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("sets", "h")))
    least = lambda up, down: F.col("n") - F.ceil(F.col("n") * up / down) + 1
    rows = known.where(F.col("mixed") & (F.col("place") <= least(3, 4))).select("h", "sid", "component", "n", (F.col("place") <= least(6, 7)).alias("index"))
    return tables.written(rows, "prefixes")


def _near_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the two sides of each group, pairs of different components that sizes and finer sketches leave."""
    pdf = pdf.sort_values(["h", "i", "j", "right"])
    keys = pdf[["h", "i", "j"]].to_numpy()
    right, sid, part, n = (pdf[c].to_numpy() for c in ("right", "sid", "component", "n"))
    bits = np.stack(pdf["fine"].to_numpy()).view(np.uint64)
    cuts = np.nonzero((np.diff(keys, axis=0) != 0).any(axis=1))[0] + 1
    out = []
    for at, end in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        mid = at + int((~right[at:end]).sum())
        far = np.zeros((mid - at, end - mid), dtype=np.int64)
        for w in range(bits.shape[1]):
            far += np.bitwise_count(bits[at:mid, None, w] ^ bits[None, mid:end, w])
        nx, ny = n[at:mid, None], n[None, mid:end]
        far[(100 * np.minimum(nx, ny) < PERCENT * np.maximum(nx, ny)) | (part[at:mid, None] == part[None, mid:end])] = FINE_BITS
        r, c = np.nonzero(far <= FINE_MOST_BITS)
        out.append((sid[r + at], sid[c + mid], part[r + at], part[c + mid]))
    a, b, ca, cb = map(np.concatenate, zip(*out, strict=True))
    swap = a > b
    return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "ca": np.where(swap, cb, ca), "cb": np.where(swap, ca, cb)}).drop_duplicates()


def _in_blocks(rows: DataFrame, fine: DataFrame) -> DataFrame:
    """Pairs of sets that hold one of the shingles of ``rows``, which very many hold: in blocks of about CHUNK, one component's or several small ones', and
    no block with another of its own component alone."""
    parts = rows.groupBy("h", "component").agg(F.count("*").alias("size"))
    small = parts.where(F.col("size") <= CHUNK).groupBy("h").agg(F.ceil(F.sum("size") / CHUNK).alias("shares"))
    parts = parts.join(small, "h", "left").withColumn("one", F.col("size") > CHUNK)
    home = F.when(F.col("one"), F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component"), F.coalesce("shares", F.lit(1))))
    parts = parts.select("h", "component", "one", home.alias("home"), F.when(F.col("one"), F.ceil(F.col("size") / CHUNK)).otherwise(1).alias("cuts"))
    placed = rows.join(parts, ["h", "component"]).withColumn("cut", F.pmod(F.xxhash64("sid"), F.col("cuts")))
    placed = placed.withColumn("i", F.xxhash64("one", "home", "cut"))
    blocks = placed.select("h", "i", "one", "home").distinct()
    tasks = blocks.join(blocks.select("h", F.col("i").alias("j"), F.col("one").alias("one_j"), F.col("home").alias("home_j")), "h")
    tasks = tasks.where("i <= j and not (one and one_j and home = home_j)").select("h", "i", "j")
    value = placed.select("h", "i", "sid", "component").join(fine.select("sid", "n", "fine"), "sid")
    left = tasks.join(value, ["h", "i"]).withColumn("right", F.lit(False))
    other = tasks.join(value.withColumnRenamed("i", "j"), ["h", "j"]).withColumn("right", F.lit(True))
    batches = shuffle_partitions(rows.sparkSession) * 4
    both = left.unionByName(other).withColumn("batch", F.pmod(F.xxhash64("h", "i", "j"), F.lit(batches)))
    return both.groupBy("batch").applyInPandas(_near_blocks, "a long, b long, ca long, cb long")


def _across(rest: DataFrame, sets: DataFrame, fine: DataFrame, tables: Scratch) -> DataFrame:
    """Pairs of sets of ``rest`` (sid, component) of different components that can be similar enough: they share one of their rarest shingles, and sizes and
    finer sketches leave them. Sets that share only what very many share, such as a template, don't meet."""
    rows = _prefixes(rest, sets, tables)
    sizes = rows.groupBy("h").agg(F.count_if("index").alias("indexed"), F.count("*").alias("all")).where("indexed > 0 and all > 1")
    sizes = tables.written(sizes.select("h", (F.col("indexed") * F.col("all") > BUSY * BUSY).alias("busy")), "prefix-sizes")
    quiet = rows.join(sizes.where("not busy").select("h"), "h")
    a = quiet.where("index").select("h", F.col("sid").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"))
    b = quiet.select("h", F.col("sid").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    few = a.join(b, "h").where(ordered & (F.col("ca") != F.col("cb")) & _sized(F.col("na"), F.col("nb"))).select("a", "b", "ca", "cb").distinct()
    near = _apart(F.col("xa"), F.col("xb"), FINE_BITS) <= FINE_MOST_BITS
    few = _both(few, fine, "fine").where(near).select("a", "b", "ca", "cb")
    many = _in_blocks(rows.join(sizes.where("busy").select("h"), "h"), fine)
    return few.unionByName(many).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents that links of similarity 0.75 or more hold together.

    ``docs``: ``doc_id, text``; other columns are left. A document's set holds its distinct shingles of five words, or
    its whole sequence if that is shorter. Returns ``doc_id, n_shingles, component_id, kept`` a row: component_id is
    the smallest doc_id that links reach, kept says that this is the row's own.

    1. Rows with equal sets become one (a partial aggregate, so a hot group of copies is no one task's work).
    2. Each set's MinHash samples are cut into BANDS buckets. A set is paired with the smallest one of the fullest of its buckets; size and
       odd sketch drop pairs far below the threshold, the full sets decide the rest. Groups of copies thus cost as many pairs as members.
    3. Sets of buckets that still hold several components are dealt anew by FINE_BANDS finer bands, which unlike texts with a common
       passage hardly share. Sets outside the largest component of one of their buckets meet its members there, in chunks, by finer
       sketches; in each of at most AGAIN rounds the nearest two sets of two components are compared in full.
    4. In buckets that are mixed even then, all members of the largest component and of others that the finer sketches leave are compared in full. Sets outside of
       it meet each other where they share one of their rarest shingles, as any pair of that similarity must; so texts of one template, which share what all of
       them share, don't meet, and work grows with the documents. What sizes and finer sketches leave is compared in full. Pairs within a component can add nothing. So a link is missed only if its sets share no band, or no finer
       one: with a probability below 0.0003 at 0.75.

    Null or empty text, or text without words: an empty set, linked with nothing. Null doc_id: never smallest; a group of
    null ids has a null component. Repeated rows have equal sets. Rows of one doc_id and different texts are told apart.
    An empty table gives no rows. Sets are 64-bit hashes of shingles: two shingles of a pair of documents of n shingles
    collide with probability below n^2 / 2^63. The result is a written table; those on the way to it are deleted.
    """
    tables = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("mark", F.xxhash64("text"))
    schema = "doc_id long, mark long, n long, key binary, bands array<long>, sketch array<long>"
    signed = tables.written(texts.mapInPandas(_signatures, schema), "signatures")
    row = F.min_by(F.struct(F.col("doc_id").alias("low"), "mark", "n", "bands", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id"))
    distinct = signed.where("n > 0").groupBy("key").agg(row.alias("s")).select(F.monotonically_increasing_id().alias("sid"), "key", "s.*")
    distinct = tables.written(distinct, "distinct")
    side = distinct.select("sid", F.struct("n", "sketch").alias("s"))
    members = distinct.select("sid", F.explode("bands").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("sid").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    members = tables.written(members.join(pivots, "bucket"), "buckets")
    needed = members.select("sid").distinct().join(distinct, "sid").select("sid", "key", "low", "mark")
    sets = _full_sets(texts, needed, tables)

    first = members.where("sid != pivot").groupBy("sid").agg(F.max_by("pivot", F.struct("c", "bucket")).alias("b"))
    first = tables.written(_sketched(first.select(F.col("sid").alias("a"), "b"), side), "pairs")
    links = tables.written(_confirmed(first, sets), "links")
    steps = [roots(links.select(F.col("a").alias("node"), F.col("b").alias("parent")))]
    own = tables.written(_placed(members.select("bucket", "sid", F.col("sid").alias("component")), steps[0]), "placed")
    rest = tables.written(_mixed(own).select("sid", "component").distinct(), "rest")
    if not rest.isEmpty():
        fine = tables.written(rest.join(sets, "sid").mapInPandas(_fine, "sid long, n long, component long, bands array<long>, fine array<long>"), "fine")
        own = fine.select("sid", "component", F.explode("bands").alias("bucket"))
        for again in range(AGAIN + 1):
            own = tables.written(_mixed(own), "placed")
            if again == AGAIN:
                break
            found = tables.written(_confirmed(_to_main(own, fine, best=True), sets), "links")
            if found.isEmpty():
                break
            steps.append(connected_components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
            own = _placed(own.select("sid", "component", "bucket"), steps[-1])
        others = tables.written(own.where("component != main").select("sid", "component").distinct(), "others")
        pairs = tables.written(_to_main(own, fine, best=False).unionByName(_across(others, sets, fine, tables)), "pairs")
        found = tables.written(_confirmed(pairs, sets), "links")
        if not found.isEmpty():
            steps.append(connected_components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))

    named = distinct.select("key", "low", F.col("sid").alias("component"))
    for groups in steps:
        named = _placed(named, groups)
    named = tables.written(named, "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    out = signed.select("doc_id", "n", "key").join(named.join(lowest, "component").select("key", "component_id"), "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    out = written(out, "near-duplicates")
    tables.drop()
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept: of each group its smallest doc_id, with all columns; of rows that repeat a doc_id and text, one."""
    found = near_duplicates(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rows.dropDuplicates(["doc_id", "text"]) if repeated else rows


#: Every pair, by an inverted index of shingles; for small tables.
SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
shingles as (
    select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
    from words, unnest(range(1, greatest(len(w) - 3, 2))) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id != b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from words union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id, w.doc_id = r.component_id as kept
from words w left join sizes s using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) r using (doc_id)
"""
