"""Packing documents into fixed windows of tokens, in order, by dynamic programming."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
#: Costs in tokens of padding: a window that ends inside a document at a sentence end, one that ends elsewhere, any window.
SENTENCE_CUT, HARD_CUT, WINDOW = 8, 64, 4
#: Sentence ends closer than GAP to the last candidate are no candidates; stretches without one get a hard one each STRETCH.
GAP, STRETCH = 24, 512
#: Tokens that are planned at once; the last window of a block is planned again with the next block.
BLOCK = 1 << 20
#: Pieces of words whose ids a worker remembers.
MEMO = 500_000
#: Characters of texts whose words are looked up together.
AT_ONCE = 1 << 22

# The tokenizer composes characters (NFC), folds white space and lower-cases, then splits into pieces that never hold white
# space and encodes the bytes of each on its own; so equal pieces have equal ids, and remembering them is exact. For
# characters beyond these (combining marks, other scripts, odd spaces, letters with special case rules) the tokenizer gets
# the text itself.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u0148\u014a-\u017e]")
_PLAIN = [chr(c) for c in range(0x21, 0x17F) if not _OTHER.match(chr(c))]
_LETTERS, _DIGITS = (re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == kind)) for kind in "LN")
#: What the tokenizer splits plain words into.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")
#: Words that end a sentence: a stop, and no letter or digit at the end.
_STOP = r"[.!?]([^\x00]*[^\p{L}\p{N}])?$"
#: The steps before its model that the above holds for.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# byte-level models spell a byte that is no visible character of Latin-1 by one from 256 on
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


class _Places(dict):
    """Numbers pieces as they come; ``new`` has those without ids yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of ranges, one range after the other, and how many items come before each range (and in all)."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return np.repeat(begin - total[:-1], size) + np.arange(total[-1]), total


class WordIds:
    """Ids of texts, by remembered pieces of words; exactly those of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in steps["added_tokens"]]
        self.known = all(steps[k] == v for k, v in _STEPS.items()) and steps["model"]["type"] == "BPE" and all(t.startswith("<|") for t in special)
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self) -> None:
        """Give ids to the new pieces."""
        pieces, self.places.new = self.places.new, []
        if not pieces:
            return
        tokenize = self.model.tokenize
        spelt = (p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(_SPELT) for p in pieces)
        got = [[t.id for t in tokenize(p)] for p in spelt]
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        total, first = int(size.sum()), self.places[pieces[0]]
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(pieces) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        where = slice(first, first + len(pieces))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), dtype="<u4", count=total)
        self.size[where] = size
        self.begin[where] = self.used + np.cumsum(size) - size
        self.used += total

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        ends = [i + 1 for i, (a, b) in enumerate(got.offsets) if any(x in text[a:b] for x in ".!?")]
        return np.array(got.ids, dtype="<u4"), np.array(ends, dtype=np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, one word after the other, where each begins, and how many it has."""
        known = self.places  # a piece that stands alone is one again
        pieces = [(w,) if w in known else _PIECE.findall(w) for w in words]
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        k = np.fromiter(map(self.places.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=int(n.sum()))
        self._learn()
        where, total = _spread(self.begin[k], self.size[k])
        border = total[np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])]
        return self.ids[where], border[:-1], np.diff(border)

    def _plain(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts of plain characters in lower case: words are numbered within them first, and each different one is taken apart once."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = lists.flatten().dictionary_encode()
        word = words.indices.to_numpy()
        ids, begin, size = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        where, total = _spread(begin[word], size[word])
        ids = ids[where]
        stops = np.nonzero(pc.match_substring_regex(words.dictionary, _STOP).to_numpy(zero_copy_only=False)[word])[0]
        border = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        held = np.searchsorted(stops, border)
        for i, j, m, n in zip(border[:-1], border[1:], held[:-1], held[1:], strict=True):
            yield ids[total[i] : total[j]], total[stops[m:n] + 1] - total[i]

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and after how many of them sentences end."""
        some: list[str] = []
        size = 0
        for t in texts:
            plain = self.known and not ("<|" in t or _OTHER.search(t))
            if some and (not plain or size + len(t) > AT_ONCE):
                yield from self._plain(some)
                some, size = [], 0
            if plain:
                some.append(t.lower())
                size += len(t)
            else:
                yield self._whole(t)
        if some:
            yield from self._plain(some)
        if len(self.places) > MEMO:
            self._forget()


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One a worker, so that tasks after the first find words remembered."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def candidates(n: int, ends: np.ndarray, skip: int) -> tuple[list[int], list[int]]:
    """Where a document of ``n`` ids may be cut beyond ``skip``, and at which cost; its end costs nothing."""
    at, cost, last = [], [], skip
    for e in [*ends[(ends > skip) & (ends < n)].tolist(), n]:
        if e < n and e - last < GAP:
            continue
        while e - last > STRETCH:
            last += STRETCH
            at.append(last)
            cost.append(HARD_CUT)
        if e > last or e == n:
            if at and at[-1] == e:
                at.pop(), cost.pop()
            at.append(e)
            cost.append(0 if e == n else SENTENCE_CUT)
            last = e
    return at, cost


def plan(at: list[int], cost: list[int], capacity: int = CAPACITY) -> list[int]:
    """Ends of windows over positions ``at`` (rising, from above 0) with least padding plus cut costs.

    best[j] = cost[j] + WINDOW + min over i with at[j] - at[i] <= capacity of best[i] + capacity - (at[j] - at[i]). As
    best[i] + at[i] is all that depends on i, a queue with rising values holds the minimum of the sliding range. A
    window whose length is a power of two needs no padding: those few predecessors are looked up by position.
    """
    p = [0, *at]
    places, powers = np.array(p, dtype=np.int64), [1 << k for k in range(5, capacity.bit_length()) if 1 << k < capacity]
    whole: dict[int, list[int]] = {}  # those that a window of a power of two leads back to
    for q in powers:
        k = np.maximum(np.searchsorted(places, places - q, side="right") - 1, 0)
        hit = np.nonzero(places[k] == places - q)[0]
        for j, i in zip(hit.tolist(), k[hit].tolist(), strict=True):
            whole.setdefault(j, []).append(i)
    best, prev = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    get, pop, left = whole.get, queue.pop, queue.popleft
    for j in range(1, len(p)):
        x = p[j]
        low = x - capacity
        while queue[0][1] < low:
            left()
        v, _, i = queue[0]
        v += capacity - x
        for k in get(j, ()):
            if best[k] < v:
                v, i = best[k], k
        v += cost[j - 1] + WINDOW
        best[j], prev[j] = v, i
        v += x
        while queue and queue[-1][0] >= v:
            pop()
        queue.append((v, x, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = prev[j]
    return cuts[::-1]


def _packer(path: str, capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, sequence = encoder(path), TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # document, ids, sentence ends, ids that are already out
        size = 0

        def flush(final: bool) -> pd.DataFrame:
            nonlocal held, size, sequence
            at, cost, base = [], [], 0
            for _, ids, ends, skip in held:
                a, c = candidates(len(ids), ends, skip)
                at += [base + x - skip for x in a]
                cost += c
                base += len(ids) - skip
            cuts = plan(at, cost, capacity)
            if not final:
                cuts = cuts[:-1]
            out, k, base = [], 0, 0
            for stop in cuts:
                offset = 0
                while base < stop:
                    doc, ids, ends, skip = held[k]
                    n = min(len(ids) - skip, stop - base)
                    out.append((doc, skip, n, ids[skip : skip + n].tobytes(), len(ids), sequence, offset))
                    base, offset = base + n, offset + n
                    held[k] = (doc, ids, ends, skip + n)
                    k += skip + n == len(ids)
                sequence += 1
            held = held[k:]
            size = sum(len(ids) - skip for _, ids, _, skip in held)
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            for doc, (ids, ends) in zip(b["doc_id"], (x for at in range(0, len(texts), 1024) for x in encode(texts[at : at + 1024])), strict=True):
                held.append((None if pd.isna(doc) else int(doc), np.append(ids, np.uint32(END_ID)).astype("<u4"), ends, 0))
                size += len(ids) + 1
                if size >= BLOCK:
                    yield flush(False)
        if held:
            yield flush(True)

    return pack


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut the token stream of each input partition into windows of at most ``capacity`` ids.

    ``docs``: ``doc_id, text``; other columns are left. A document's ids are the tokenizer's, then END_ID. Returns one
    row a piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.
    Order within a partition is kept; windows never span partitions, so the work needs no shuffle and a lost task is
    packed again alike. sequence_id is the partition's number times 2^33 plus a running number.

    Null or empty text: the end id alone. Null doc_id: kept as null. Repeated rows: packed each. Very long texts: cut
    over as many windows as they need. An empty table gives no rows. Memory is bounded by BLOCK ids plus one document.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_packer(tokenizer_path, capacity), PIECES)
