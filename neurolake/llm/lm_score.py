"""Language-model scores: a weighted backoff automaton over words, with one over the bytes of their spelling below it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolake.llm.common import Scratch, words_of, written
from neurolake.llm.toxicity import remainder

#: Taken off each count of an arc; what is taken off is the weight of the state's failure arc.
DISCOUNT = 0.75
#: Tokens of a block: what a task holds at once, but for a single longer text.
BLOCK = 500_000
#: Characters of the corpus for each part of the counts, so that a part's task stays as small at any size.
PART_CHARS = 4_000_000
#: Words that hold this share of a bounded sample of texts have their pairs spread over all parts. This decides only which task counts a pair.
HOT_SHARE, HOT_TEXTS = 0.005, 1000
#: Contexts of three bytes share this many states, by a hash; those of two and one have states of their own.
CLASSES = 1 << 15
START, END_BYTE = 0x20, 0x0A
#: Words that are spelt at once.
SPELT = 32_768


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed(x: np.ndarray, dtype: str = "<u8") -> bytes:
    """Numbers as planes of bytes, of which the high ones are mostly zero and compress well."""
    x = np.ascontiguousarray(x, dtype=dtype)
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unpacked(raw: bytes, dtype: str = "<u8") -> np.ndarray:
    d = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(d.itemsize, -1).T).view(d).ravel()


def _blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a block: its texts' ids, tokens as numbers, and the words that these stand for, the end of a text (an empty word) first."""
    number, docs, ids, size, k = _Numbers(), [], [], 0, 0
    place = TaskContext.get().partitionId() << 24

    def out() -> pd.DataFrame:
        doc_id, absent, held, length = zip(*docs, strict=True)
        row = {"block": place + k, "doc_id": list(doc_id), "absent": list(absent), "held": list(held), "length": list(length), "ids": packed(np.concatenate(ids), "<u4"), "vocabulary": b"\n".join(number)}
        return pd.DataFrame([row])

    for b in batches:
        for doc, absent, held, text in zip(b["doc_id"], b["absent"], b["held"], b["text"], strict=True):
            if not number:
                number[b""] = 0
            w = words_of(text)
            ids.append(np.fromiter(map(number.__getitem__, w), dtype=np.uint32, count=len(w)))
            ids.append(np.zeros(1, dtype=np.uint32))
            docs.append((doc, absent, held, len(w) + 1))
            size += len(w) + 1
            if size >= BLOCK:
                yield out()
                number.clear()
                docs, ids, size, k = [], [], 0, k + 1
    if docs:
        yield out()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Block:
    """A block's tokens and pairs of neighbours, and the order in which they go to the parts and come back."""

    def __init__(self, row: pd.Series, parts: int, hot: np.ndarray):
        self.names = row["vocabulary"].split(b"\n")
        self.doc_id, self.held = np.array(row["doc_id"], dtype=np.int64), np.array(row["held"], dtype=bool)
        self.absent = np.array(row["absent"], dtype=bool)
        self.length = np.array(row["length"])
        self.ids = unpacked(row["ids"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.learn = np.repeat(~self.held, self.length)
        before = np.concatenate([[0], self.ids[:-1]])
        before[self.first] = 0  # a text begins at the state of an end
        size = len(self.names)
        pair, self.pair = np.unique(before * size + self.ids, return_inverse=True)
        del before
        self.a, self.b = pair // size, pair % size
        h = self.hash = _hashes(self.names)
        self.part = (h % np.uint64(parts)).astype(np.int64)
        self.spread = np.isin(h, hot)
        spread = self.spread[self.a]
        self.pair_part = np.where(spread, _mix(h[self.a] + h[self.b] * np.uint64(3)) % np.uint64(parts), h[self.a] % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(self.part, kind="stable")
        self.rank = np.empty_like(self.order)
        self.rank[self.order] = np.arange(size)
        self.pair_order = np.argsort((self.pair_part * 2 + spread) * size + self.rank[self.a], kind="stable")


def _sent(parts: int, hot: np.ndarray):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's counts in training texts, a row a part; words and pairs of held-out texts ask for theirs with a count of 0."""
        for b in batches:
            for _, row in b.iterrows():
                yield counts(row)

    def counts(row: pd.Series) -> pd.DataFrame:
        x = Block(row, parts, hot)
        n = np.bincount(x.ids[x.learn], minlength=len(x.names))
        pn = np.bincount(x.pair[x.learn], minlength=len(x.a))
        cut, pcut = (np.searchsorted(p[o], np.arange(parts + 1)) for p, o in ((x.part, x.order), (x.pair_part, x.pair_order)))
        rows = []
        for p in np.nonzero((np.diff(cut) > 0) | (np.diff(pcut) > 0))[0]:
            own, pairs = x.order[cut[p] : cut[p + 1]], x.pair_order[pcut[p] : pcut[p + 1]]
            # contexts that the part owns are among its words, in their order; the spread ones come after them, with their hashes
            near = len(pairs) - int(x.spread[x.a[pairs]].sum())
            runs = np.bincount(x.rank[x.a[pairs[:near]]] - cut[p], minlength=len(own))
            far = x.a[pairs[near:]]
            start = np.nonzero(np.diff(far, prepend=-1))[0]
            after = x.hash[x.b[pairs]]
            rows.append((p, b"\n".join([x.names[i] for i in own]) if len(own) else None, packed(n[own], "<u4"), packed(runs, "<u4"), packed(x.hash[far[start]]), packed(np.diff(start, append=len(far)), "<u4"),
                         packed(after >> np.uint64(32), "<u4"), packed(after & np.uint64(0xFF), "<u1"), packed(pn[pairs], "<u4")))
        return pd.DataFrame(rows, columns=["part", "names", "n", "runs", "far", "far_runs", "after", "low", "pn"]).assign(block=row["block"])

    return send


BLOCKS = "block long, doc_id array<long>, absent array<boolean>, held array<boolean>, length array<long>, ids binary, vocabulary binary"
SENT = "part int, names binary, n binary, runs binary, far binary, far_runs binary, after binary, low binary, pn binary, block long"
REPLY = "block long, part int, c binary, kinds binary, n binary, grams binary, times binary, hot array<long>, hot_kinds array<long>, tokens long, words long"


def _merged(hot: np.ndarray):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """A part's counts over the corpus: sent back to each block in its order; and the part's share of sums, of n-grams of spellings and of spread contexts."""
        pdf = pdf.sort_values("block")
        names = [x.split(b"\n") if x is not None else [] for x in pdf["names"]]
        words = [_hashes(x) for x in names]
        word, at, place = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        c = np.bincount(place, weights=np.concatenate([unpacked(n, "<u4") for n in pdf["n"]]), minlength=len(word)).astype(np.int64)
        sizes = [0]
        before, after = [], []
        for own, runs, far, more, t, low in zip(words, pdf["runs"], pdf["far"], pdf["far_runs"], pdf["after"], pdf["low"], strict=True):
            before += [np.repeat(own, unpacked(runs, "<u4")), np.repeat(unpacked(far), unpacked(more, "<u4"))]
            after.append(unpacked(t, "<u4").astype(np.uint64) << np.uint64(8) | unpacked(low, "<u1"))
            sizes.append(len(after[-1]))
        before, after, ends = np.concatenate(before), np.concatenate(after), np.cumsum(sizes)
        _, first, pair = np.unique(_mix(before) + after * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        n = np.bincount(pair, weights=np.concatenate([unpacked(x, "<u4") for x in pdf["pn"]]), minlength=len(first)).astype(np.int64)
        context, kinds = np.unique(before[first[n > 0]], return_counts=True)
        spread = np.isin(context, hot)
        own_kinds = np.zeros(len(word), dtype=np.int64)
        _, i, j = np.intersect1d(word, context[~spread], assume_unique=True, return_indices=True)
        own_kinds[i] = kinds[~spread][j]
        replies, low = [], 0
        for k, (block, w) in enumerate(zip(pdf["block"], words, strict=True)):
            some = place[low : low + len(w)]
            low += len(w)
            replies.append((block, packed(c[some]), packed(own_kinds[some]), packed(n[pair[ends[k] : ends[k + 1]]])))
        names = [w for x in names for w in x]
        grams, times = spelling_counts([names[k] for k in at[c > 0]])
        out = pd.DataFrame(replies, columns=["block", "c", "kinds", "n"])
        sums = {"block": [None], "grams": [packed(grams, "<u4")], "times": [packed(times)], "hot": [context[spread].view(np.int64)], "hot_kinds": [kinds[spread]], "tokens": [int(c.sum())], "words": [int((c > 0).sum())]}
        out = pd.concat([out.assign(hot=None, hot_kinds=None), pd.DataFrame(sums)]).assign(part=pdf["part"].iloc[0]).astype({"block": "Int64", "tokens": "Int64", "words": "Int64"})
        return out[[x.split()[0] for x in REPLY.split(", ")]]

    return merge


def _positions(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Each word's bytes and its end, one after the other, with the three bytes before each, which are start marks before a word's begin."""
    b = np.frombuffer(b"\n".join(words) + b"\n", dtype=np.uint8).astype(np.int64) if words else np.zeros(0, dtype=np.int64)
    back, gone = [], np.zeros(len(b), dtype=bool)
    for k in (1, 2, 3):
        x = np.concatenate([np.full(min(k, len(b)), END_BYTE), b[: max(len(b) - k, 0)]])
        gone = gone | (x == END_BYTE)
        back.append(np.where(gone, START, x))
    return b, *back


def _classes(x1: np.ndarray, x2: np.ndarray, x3: np.ndarray) -> np.ndarray:
    return ((x3 << 16 | x2 << 8 | x1) * 0x9E3779B1 >> 12) % CLASSES


def spelling_codes(words: list[bytes]) -> np.ndarray:
    """n-grams of spellings: of three bytes as they are, and of a hashed context of three with its next byte from 2^24 on."""
    b, x1, x2, x3 = _positions(words)
    return np.concatenate([x2 << 16 | x1 << 8 | b, (1 << 24) + (_classes(x1, x2, x3) << 8 | b)])


def spelling_counts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    some = [np.unique(spelling_codes(words[at : at + SPELT]), return_counts=True) for at in range(0, len(words), SPELT)]
    if not some:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes, place = np.unique(np.concatenate([c for c, _ in some]), return_inverse=True)
    return codes, np.bincount(place, weights=np.concatenate([n for _, n in some])).astype(np.int64)


class Spelling:
    """An automaton over bytes: states are contexts of three (hashed), two and one byte; a state's failure arc leads to the next shorter one.

    Absolute discounting, interpolated, over the distinct words of the training texts, down to a uniform byte: the probabilities of a
    word's bytes and its end sum to one at every state.
    """

    def __init__(self, codes: np.ndarray, times: np.ndarray):
        two, three = codes < 1 << 24, codes >= 1 << 24
        self.direct3, self.fail3 = self._level(codes[three] - (1 << 24), times[three], CLASSES)
        self.direct2, self.fail2 = self._level(codes[two], times[two], 1 << 16)
        one = np.bincount(codes[two] & 0xFFFF, weights=times[two], minlength=1 << 16)
        none = one.reshape(256, 256).sum(axis=0)
        d0, f0 = self._level(np.nonzero(none)[0], none[none > 0], 1)
        d1, f1 = self._level(np.nonzero(one)[0], one[one > 0], 256)
        every = np.arange(256)
        self.lower = d1(*np.divmod(np.arange(1 << 16), 256)) + np.repeat(f1, 256) * np.tile(d0(0 * every, every) + f0[0] / 256, 256)

    @staticmethod
    def _level(codes: np.ndarray, times: np.ndarray, contexts: int):
        """Arcs of one level's states, as a function of context and byte, with rows for states that have any; and failure weights."""
        context = codes >> 8
        total, kinds = np.bincount(context, weights=times, minlength=contexts), np.bincount(context, minlength=contexts)
        row = np.cumsum(kinds > 0) * (kinds > 0)
        direct = np.zeros((row.max(initial=0) + 1) << 8, dtype=np.float32)
        direct[row[context] << 8 | codes & 0xFF] = (times - DISCOUNT) / total[context]
        return lambda c, b: direct[row[c] << 8 | b], np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)

    def bytes_log10(self, words: list[bytes]) -> np.ndarray:
        return np.log10(self.likely(*_positions(words)))

    def likely(self, b: np.ndarray, x1: np.ndarray, x2: np.ndarray, x3: np.ndarray) -> np.ndarray:
        """The probability of byte ``b`` after x3, x2, x1."""
        two, three = x2 << 8 | x1, _classes(x1, x2, x3)
        return self.direct3(three, b) + self.fail3[three] * (self.direct2(two, b) + self.fail2[two] * self.lower[x1 << 8 | b])

    def log10(self, words: list[bytes]) -> np.ndarray:
        """A word's logarithm: the sum over its bytes and its end."""
        out = []
        for at in range(0, len(words), SPELT):
            some = words[at : at + SPELT]
            size = np.array([len(w) + 1 for w in some])
            out.append(np.add.reduceat(self.bytes_log10(some), np.cumsum(size) - size))
        return np.concatenate(out)


_spelling: dict[int, Spelling] = {}


def _scored(parts: int, hot: np.ndarray, hot_kinds: np.ndarray, n: int, v: int, shared):
    def score(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if shared.value[0] not in _spelling:  # a worker serves one corpus after another
            _spelling.clear()
            _spelling[shared.value[0]] = Spelling(*shared.value[1:])
        x = Block(blocks.iloc[0], parts, hot)
        replies = replies.sort_values("part")
        c, kinds, pn = np.zeros(len(x.names), np.int64), np.zeros(len(x.names), np.int64), np.zeros(len(x.a), np.int64)
        for where, order, column in ((c, x.order, "c"), (kinds, x.order, "kinds"), (pn, x.pair_order, "n")):
            where[order] = np.concatenate([unpacked(r) for r in replies[column]]).astype(np.int64)
        _, i, j = np.intersect1d(x.hash, hot, return_indices=True)
        kinds[i] = hot_kinds[j]
        # the root: a word's discounted share, and below it its spelling
        spelt = np.log10(DISCOUNT * v / n) + _spelling[shared.value[0]].log10(x.names) if n else _spelling[shared.value[0]].log10(x.names)
        root = np.where(c > 0, np.log10(np.maximum(c - DISCOUNT, 1e-300) / max(n, 1) + 10.0**spelt), spelt)
        # left to right: the state is the token before, an arc a pair, else the failure arc to the root
        count = np.maximum(c, 1).astype(float)
        fail = np.log10(np.where(kinds > 0, DISCOUNT * kinds / count, 1.0))
        down = fail[x.a] + root[x.b]
        step = np.where(pn > 0, np.log10(np.maximum(pn - DISCOUNT, 1e-300) / count[x.a] + 10.0**down), down)[x.pair]
        base = np.log10((c + 1) / (n + (v + 1)))[x.ids]
        sums = lambda y: np.array([y[i : i + k].sum() for i, k in zip(x.first, x.length, strict=True)])
        return pd.DataFrame({
            "doc_id": pd.Series(x.doc_id, dtype="Int64").mask(x.absent), "held_out": x.held, "n_tokens": x.length, "n_known": sums((c > 0)[x.ids]), "train_tokens": n,
            "base_score": sums(base), "score": sums(step),
        })

    return score


def _hot_words(texts: DataFrame) -> np.ndarray:
    """Hashes of at most 1 / HOT_SHARE words that are frequent in HOT_TEXTS texts."""

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(w for t in b["text"] for w in words_of(t))
            yield pd.DataFrame({"h": [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in n], "n": list(n.values())})

    n = texts.select("text").limit(HOT_TEXTS).mapInPandas(shares, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    some = n.where(F.col("n") >= HOT_SHARE * total).select("h").toPandas()["h"]  # bounded by HOT_SHARE
    words = {xxhash.xxh3_64_intdigest(b""), *(int(h) + (1 << 63) for h in some)}
    return np.array(sorted(words), dtype=np.uint64)


def score_texts(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """log10 probabilities of every text, under an add-one unigram base and under the automaton.

    ``docs``: ``doc_id, text``; other columns are left. Returns ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``. Learnt from texts whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as an empty text).

    The automaton's states are all words of the training texts; each pair of neighbours there is an arc, with its discounted share of
    the state's tokens, and what the discount takes is the weight of the failure arc to the root. At the root each word has its
    discounted share likewise, and the failure arc leads to its spelling: states of three, two and one byte before. A text begins at the
    state of an end. Each level's probabilities sum to one over all words, known or not, so ``score`` is the
    logarithm of the text's probability; there is no floor, and a longer unknown word is less likely.

    Texts are dealt once, as numbers of their tokens in a written table, into blocks of about BLOCK tokens, a row each. A block sends each distinct
    token and pair once to the part of the counts that owns it (``parts``: as many as PART_CHARS gives), and gets back what the
    corpus holds of it; so a task holds a block or a part, and the driver the n-grams of spellings, of which there are at most 2^25. All
    counts are exact, at any size and cut (pairs are told apart by 64 bits of a hash of the first and 40 of the second word). Null or
    empty text: the end alone. Repeated rows count as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Scratch(spark)
    held = remainder(F.col("doc_id"), 7) == 2
    doc = F.col("doc_id").cast("long")
    # a column of longs with nulls would reach Python as doubles
    texts = docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("absent"), F.col("text").cast("string").alias("text"), held.alias("held"))
    if parts is None:
        parts = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS))
    hot = _hot_words(texts)
    blocks = tables.written(texts.mapInPandas(_blocked, BLOCKS), "lm-blocks")
    sent = blocks.mapInPandas(_sent(parts, hot), SENT)
    replies = tables.written(sent.groupBy("part").applyInPandas(_merged(hot), REPLY), "lm-replies")
    sums = replies.where("block is null")
    n, v = (x or 0 for x in sums.agg(F.sum("tokens"), F.sum("words")).first())
    kinds = sums.select(F.explode(F.arrays_zip("hot", "hot_kinds")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_kinds").alias("kinds")).toPandas()  # bounded: one a hot word
    known = dict(zip(kinds["hot"].to_numpy(dtype=np.int64).view(np.uint64).tolist(), kinds["kinds"].tolist(), strict=True))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, t in zip(b["grams"], b["times"], strict=True):
                yield pd.DataFrame({"code": unpacked(g, "<u4").astype(np.int64), "times": unpacked(t).astype(np.int64)})

    grams = sums.select("grams", "times").mapInPandas(spread, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).toPandas()  # bounded: 2^25
    codes, times = grams["code"].to_numpy(dtype=np.int64), grams["times"].to_numpy(dtype=np.float64)
    shared = spark.sparkContext.broadcast((int.from_bytes(np.random.default_rng().bytes(7), "little"), codes, times))
    score = _scored(parts, hot, np.array([known.get(h, 0) for h in hot.tolist()], dtype=np.int64), n, v, shared)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = replies.where("block is not null").select("block", "part", "c", "kinds", "n")
    out = written(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(score, schema), "lm-scores")
    tables.drop()
    return out
