"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolake.llm.common import written

THRESHOLD = 0.7
#: A labelled token: its contexts (the two words beside it) lie in toxic documents this many times as often as in others, in at
#: least so many different ones, and at least this many standard errors above chance. Counting contexts and not documents
#: keeps words of copied passages out.
RATIO, CONTEXTS, ERRORS = 8.0, 4, 5.0
#: Bounds of what is learnt from on the driver: labelled words, windows of tokens, documents. Those with the smallest hashes.
MOST_WORDS, MOST_WINDOWS = 20_000, 30_000
#: Labelled documents that are learnt from at most, those whose ids have the smallest hashes.
MOST_DOCS = 20_000
#: Tokens on each side of a window's middle.
AROUND = 8
STEPS, RATE, RIDGE = 300, 0.1, 1e-3
#: Characters of a longer word's beginning.
BEGINNING = 5

_token = re.compile(r"\w+")


def _beginning(word: str) -> str:
    """What words of a family share: a token of its own for words that aren't known whole."""
    return word[:BEGINNING] + "*"


@dataclass(frozen=True)
class Tagger:
    """``words``: emission scores of the toxic state for known tokens and beginnings of tokens; all others share ``other``. ``moves``: transition scores
    of the two states (clean, toxic); ``start``: that of beginning toxic. ``blend``: weights of a document's features."""

    words: dict[str, float]
    other: float
    moves: np.ndarray
    start: float
    blend: np.ndarray


def marginals(tagger: Tagger, known: list[tuple[int, float]], n: int) -> np.ndarray:
    """Probabilities of the toxic state at the ``known`` (position, emission) tokens of a sequence of ``n`` tokens.

    Forward-backward, exact: between known tokens every step is the same matrix, so a stretch of k is its k-th power.
    """
    move = np.exp(tagger.moves)
    plain = np.array([1.0, math.exp(tagger.other)])
    values, left = np.linalg.eig(move * plain)  # a step onto a token that isn't known
    right = np.linalg.inv(left)
    top = values.real.max()

    def stretch(k: int) -> np.ndarray:
        return ((left * (values / top) ** k) @ right).real

    at = np.array([p for p, _ in known])
    emit = np.exp(np.array([[0.0, e] for _, e in known]))
    gaps = np.diff(at) - 1
    first = np.array([1.0, math.exp(tagger.start)])
    if at[0] == 0:
        a = first * emit[0]
    else:
        a = (first * plain) @ stretch(at[0] - 1) @ move * emit[0]
    forward = [a / a.sum()]
    for k, g in enumerate(gaps):
        a = forward[-1] @ stretch(g) @ move * emit[k + 1]
        forward.append(a / a.sum())
    b = stretch(n - 1 - at[-1]) @ np.ones(2)
    backward = [b / b.sum()]
    for k in range(len(gaps) - 1, -1, -1):
        b = stretch(gaps[k]) @ (move @ (emit[k + 1] * backward[-1]))
        backward.append(b / b.sum())
    both = np.array(forward) * np.array(backward[::-1])
    return both[:, 1] / both.sum(axis=1)


def lowered(text: str) -> str:
    """In lower case, with every character where it was: only a capital I with a dot would become two."""
    return text.replace("\u0130", "i").lower()


def tagged(tagger: Tagger, text: str) -> tuple[list[tuple[int, int, float]], float, int]:
    """Known tokens as (start, end, probability of toxic), their expected number of toxic ones, and the number of all tokens."""
    words = tagger.words
    lower = lowered(text)
    tokens = _token.findall(lower)
    get = words.get
    known = [(i, e) for i, w in enumerate(tokens) if (e := get(w, get(w[:BEGINNING] + "*"))) is not None]
    if not known:
        return [], 0.0, len(tokens)
    p = marginals(tagger, known, len(tokens))
    spans, k = [], 0
    for i, m in enumerate(_token.finditer(lower)):
        if k < len(known) and i == known[k][0]:
            spans.append((m.start(), m.end(), float(p[k])))
            k += 1
    return spans, float(p.sum()), len(tokens)


def features(tagger: Tagger, text: str) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    spans, expected, n = tagged(tagger, text)
    best = max((p for _, _, p in spans), default=0.0)
    return spans, np.array([1.0, best, math.log1p(expected), 100 * expected / max(n, 20)])


def _counts(rows: DataFrame) -> DataFrame:
    """``word, toxic, clean``: different contexts of each word, by label."""

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                seen = set()
                for text, y in zip(b["text"].iloc[at : at + 256], b["toxic"].iloc[at : at + 256], strict=True):
                    w = ["", *_token.findall(lowered(text or "")), ""]
                    seen.update((w[i], w[i - 1], w[i + 1], y) for i in range(1, len(w) - 1))
                    seen.update((_beginning(w[i]), w[i - 1], w[i + 1], y) for i in range(1, len(w) - 1) if len(w[i]) > BEGINNING)
                yield pd.DataFrame(list(seen), columns=["word", "before", "after", "toxic"])

    each = rows.select("text", "toxic").mapInPandas(contexts, "word string, before string, after string, toxic int").distinct()
    return each.groupBy("word").agg(F.sum("toxic").cast("long").alias("bad"), F.sum(1 - F.col("toxic")).cast("long").alias("good"))


def labelled_words(rows: DataFrame) -> dict[str, float]:
    """Words that toxic documents hold far more often than others, with their log odds; at most MOST_WORDS, the surest first."""
    counts = written(_counts(rows), "word-counts")
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not total["bad"]:
        return {}
    share = total["bad"] / (total["bad"] + (total["good"] or 0))
    ratio = ((F.col("bad") + 0.5) / total["bad"]) / ((F.col("good") + 0.5) / max(total["good"] or 0, 1))
    n = F.col("bad") + F.col("good")
    sure = (F.col("bad") - n * share) / F.sqrt(n * share * (1 - share) + 1e-9)
    found = counts.withColumn("ratio", ratio).withColumn("sure", sure)
    found = found.where((F.col("ratio") >= RATIO) & (F.col("bad") >= CONTEXTS) & (F.col("sure") >= ERRORS))
    return {r["word"]: math.log(r["ratio"]) for r in found.orderBy(F.desc("sure"), "word").limit(MOST_WORDS).collect()}


def _windows(rows: DataFrame, words: set[str]) -> pd.DataFrame:
    """Windows of tokens about labelled words, and one at random a document: ids (-1 for unknown) and 0/1 labels."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, label in zip(b["text"], b["toxic"], strict=True):
                w = _token.findall(lowered(text or ""))
                w = [x if x in words else y if (y := _beginning(x)) in words else "-" for x in w]
                hits = [i for i, x in enumerate(w) if x != "-"]
                for i in [*hits, *([zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(w)] if w else [])]:
                    part = w[max(0, i - AROUND) : i + AROUND + 1]
                    out.append((" ".join(part), int(label)))
            yield pd.DataFrame(out, columns=["tokens", "toxic"])

    cuts = rows.select("text", "toxic").mapInPandas(cut, "tokens string, toxic int")
    cuts = cuts.groupBy("tokens", "toxic").agg(F.count("*").alias("n"))
    return cuts.orderBy(F.xxhash64("tokens", "toxic"), "tokens", "toxic").limit(MOST_WINDOWS).toPandas()  # bounded


def fit_field(windows: pd.DataFrame, odds: dict[str, float]) -> tuple[dict[str, float], float, np.ndarray, float]:
    """Maximum likelihood, with a ridge, of the field over labelled windows; gradients from forward-backward."""
    names = sorted(odds)
    place = {w: i for i, w in enumerate(names)}
    m, width = len(names), 2 * AROUND + 1
    ids = np.full((len(windows), width), m)
    mask = np.zeros((len(windows), width))
    for r, t in enumerate(windows["tokens"]):
        some = [place.get(x, m) for x in t.split(" ")]
        ids[r, : len(some)], mask[r, : len(some)] = some, 1
    toxic = windows["toxic"].to_numpy()[:, None]
    labels = ((ids < m) & (toxic == 1) & (mask > 0)).astype(float)
    weight = np.log1p(windows["n"].to_numpy(dtype=float))[:, None]
    emission = np.array([*(min(odds[w], 4.0) for w in names), -3.0])
    prior = emission.copy()
    moves, start = np.zeros((2, 2)), -1.0
    state = {k: [0.0, 0.0] for k in "emt"}
    scale = max(float((weight * mask).sum()), 1.0)

    def adam(key: str, value, gradient, step: int):
        one, two = state[key]
        one, two = 0.9 * one + 0.1 * gradient, 0.999 * two + 0.001 * gradient**2
        state[key] = [one, two]
        return value + RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)

    for step in range(1, STEPS + 1):
        e = np.exp(np.stack([np.zeros_like(mask), emission[ids]], axis=2))
        move = np.exp(moves)
        f, b = np.zeros_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0] * [1.0, math.exp(start)]
        f[:, 0] /= f[:, 0].sum(axis=1, keepdims=True)
        for j in range(1, width):
            new = f[:, j - 1] @ move * e[:, j]
            new = np.where(mask[:, j, None] > 0, new, f[:, j - 1])
            f[:, j] = new / new.sum(axis=1, keepdims=True)
        for j in range(width - 2, -1, -1):
            new = (b[:, j + 1] * e[:, j + 1]) @ move.T
            new = np.where(mask[:, j + 1, None] > 0, new, b[:, j + 1])
            b[:, j] = new / new.sum(axis=1, keepdims=True)
        p = f * b
        p = (p / p.sum(axis=2, keepdims=True))[:, :, 1]
        gap = (labels - p) * mask * weight
        gradient = np.bincount(ids.ravel(), weights=gap.ravel(), minlength=m + 1) / scale
        emission = adam("e", emission, gradient - RIDGE * (emission - prior) / max(m, 1), step)
        pairs = f[:, :-1, :, None] * move * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        inside = (mask[:, 1:] * weight)[:, :, None, None]
        seen = np.stack([1 - labels, labels], axis=2)
        real = seen[:, :-1, :, None] * seen[:, 1:, None, :]
        moves = adam("m", moves, ((real - pairs) * inside).sum(axis=(0, 1)) / scale - RIDGE * moves, step)
        start = float(adam("t", start, float(gap[:, 0].sum()) / scale - RIDGE * start, step))
    return {w: float(emission[i]) for w, i in place.items()}, float(emission[m]), moves, start


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(labelled: DataFrame) -> Tagger:
    """Learn from ``doc_id, text, toxic`` (0/1; rows with a null label are left): words, then the field, then the blend."""
    rows = labelled.where("toxic is not null").select("doc_id", "text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    rows = written(rows, "labelled")
    odds = labelled_words(rows)
    no_words = Tagger({}, -3.0, np.zeros((2, 2)), -1.0, np.array([-3.0, 0, 0, 0]))
    if not odds:
        return no_words
    tagger = Tagger(*fit_field(_windows(rows, set(odds)), odds), no_words.blend)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(tagger, t or "")[1] for t in b["text"]]
            yield pd.DataFrame(x, columns=list("abcd")).assign(y=b["toxic"].to_numpy())

    x = rows.mapInPandas(described, "a double, b double, c double, d double, y int").toPandas()  # at most MOST_DOCS
    blend = _logistic(x[list("abcd")].to_numpy(), x["y"].to_numpy().astype(float))
    return Tagger(tagger.words, tagger.other, tagger.moves, tagger.start, blend)


def score_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``doc_id, score, predicted, spans`` of every document; spans are the tokens tagged toxic: start, end, probability.

    Offsets count code points, ends exclusive. Null or empty text: the score of a text without any labelled word. Null
    doc_id stays null. Repeated rows score alike. Whole texts are read, whatever their length; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # bounded: MOST_WORDS words

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                spans, x = features(t, text or "")
                score = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ t.blend)))))
                hits = [{"start": s, "end": e, "p": p} for s, e, p in spans if p >= 0.5]
                out.append((doc, score, int(score >= THRESHOLD), hits))
            yield pd.DataFrame(out, columns=["doc_id", "score", "predicted", "spans"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(scored, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def without_toxic(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The rows of ``docs`` whose texts score below THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        t = shared.value
        return texts.map(lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(t, x or "")[1] @ t.blend)))))).astype(float)

    return docs.where(score(F.col("text").cast("string")) < THRESHOLD)


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def learn(docs: DataFrame, labels: DataFrame) -> Tagger:
    """The tagger of at most MOST_DOCS rows of ``labels`` whose crc32(doc_id) mod 3 is not 1, with the texts of ``docs``."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCS)
    return fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs`` (``doc_id, text``), learnt from ``labels`` (``doc_id, toxic``) outside the held-out third.

    Adds ``held_out``: whether crc32 of the doc_id as text, modulo 3, is 1. A doc_id with several labels counts as toxic if
    any of them is. Without labels every score is that of a text without labelled words.
    """
    scores = score_documents(docs, learn(docs, labels))
    return scores.withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
