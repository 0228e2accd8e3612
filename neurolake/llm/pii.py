"""Personal data: exact patterns, and spans that a semi-Markov conditional random field adds to them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, in the order that ties take.
KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Stretches with digits that the field is fitted on: a bounded sample, those with the smallest hashes. Pieces of an entity at most.
MOST_ZONES, MOST_PIECES = 400, 14
STEPS, RATE, RIDGE = 60, 0.2, 1e-3
SEED = 5

# A match can't start inside a run of digits (or, for mail, of local characters) unless it could have started at the run's
# begin; saying so keeps long runs from being tried at each of their places.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ZONE = re.compile(r"[0-9](?:[\x20().+-]*[0-9])*")
_PIECE = re.compile(r"[0-9]+|[^0-9\x20]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    at, used = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > used and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", begin, m.end()
            used = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact patterns: per kind leftmost matches that don't overlap, less those that fail their check."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of digits and what stands between and before them, that could hold an entity. Linear in the text, whatever it holds."""
    out = []
    for m in _ZONE.finditer(text):
        s, e = m.span()
        while s and text[s - 1] in "+(":
            s -= 1
        if e - s >= 7:
            out.append((s, e))
    return out


def _pieces(zone: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PIECE.finditer(zone)]


def segment_features(zone: str, kind: str) -> list[str]:
    """Features of a whole candidate span: what its digits, separators and groups are like."""
    d = _only_digits(zone)
    seps = "".join(sorted(set(zone) - set("0123456789")))
    groups = re.findall("[0-9]+", zone)
    out = [f"{kind}", f"{kind} seps {seps}", f"{kind} groups {min(len(groups), 6)}", f"{kind} plus {zone[0] == '+'}"]
    if kind == "card":
        # a sum that holds by chance is no card: it counts together with the sizes of the groups
        form = "-".join(str(len(g)) for g in groups)
        out.append(f"card both {luhn(d) and 12 <= len(d) <= 19 and not set(zone) - set('0123456789 -')} {form}")
    elif kind == "phone":
        out += [f"phone size {'ok' if 9 <= len(d) <= 15 else 'no'}", f"phone both {zone[0] == '+' and 9 <= len(d) <= 15}"]
    else:
        out += [f"ip form {bool(_IP.fullmatch(zone))}", f"ip both {bool(_IP.fullmatch(zone)) and _octets(zone)}"]
    return out


_FIELD_KINDS = ("ip", "card", "phone")
_ENDS = frozenset("0123456789")


def candidates(zone: str) -> tuple[int, list[tuple[int, int, str, list[str]]]]:
    """The number of pieces, and the bounded segments that an entity could be: from a digit, plus or bracket to a digit."""
    p = _pieces(zone)
    out = []
    for i, (s, _) in enumerate(p):
        if zone[s] not in "+(" and zone[s] not in _ENDS:
            continue
        for j in range(i, min(i + MOST_PIECES, len(p))):
            e = p[j][1]
            if zone[e - 1] in _ENDS and e - s >= 7:
                out += [(i, j + 1, k, segment_features(zone[s:e], k)) for k in _FIELD_KINDS]
    return len(p), out


class SpanField:
    """A semi-Markov field: a segmentation's score is the sum of its spans' feature weights; pieces outside spans score 0."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def scored(self, zone: str) -> tuple[int, list[tuple[int, int, str, float]]]:
        n, some = candidates(zone)
        w = self.weights
        return n, [(i, j, k, sum(w.get(f, 0.0) for f in fs)) for i, j, k, fs in some]

    def spans(self, zone: str) -> list[tuple[str, int, int]]:
        """The best segmentation: boundaries and kinds at once, by dynamic programming over ends of bounded spans.

        Segments are those of ``candidates``, scored as their end comes up and not kept, so a zone of any length takes memory for its pieces only.
        """
        p, w = _pieces(zone), self.weights
        n = len(p)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], e = best[j - 1], p[j - 1][1]
            if zone[e - 1] not in _ENDS:
                continue
            for i in range(max(0, j - MOST_PIECES), j):
                s = p[i][0]
                if e - s < 7:
                    break
                if zone[s] not in "+(" and zone[s] not in _ENDS:
                    continue
                for k in _FIELD_KINDS:
                    score = best[i] + sum(w.get(f, 0.0) for f in segment_features(zone[s:e], k))
                    if score > best[j]:
                        best[j], back[j] = score, (i, k)
        out, j = [], n
        while j:
            if back[j]:
                i, k = back[j]
                out.append((k, p[i][0], p[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def fit_field(examples: list[tuple[str, set[tuple[str, int, int]]]]) -> SpanField:
    """Maximum likelihood, with a ridge, of labelled zones: gradients from a forward-backward pass over segments."""
    names: dict[str, int] = {}
    flat, size, ex, begin, end, true = [], [], [], [], [], []
    for k, (zone, gold) in enumerate(examples):
        p = _pieces(zone)
        for i, j, kind, fs in candidates(zone)[1]:
            flat += [names.setdefault(f, len(names)) for f in fs]
            size.append(len(fs))
            ex.append(k)
            begin.append(i)
            end.append(j)
            true.append((kind, p[i][0], p[j - 1][1]) in gold)
    flat, size, ex, begin, end, true = (np.array(x, dtype=np.int64) for x in (flat, size, ex, begin, end, true))
    many, longest, first = len(examples), int(end.max(initial=0)), np.cumsum(size) - size
    ends, begins = ([np.nonzero(x == j)[0] for j in range(longest + 1)] for x in (end, begin))
    w, one, two = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for step in range(1, STEPS + 1) if len(flat) else ():
        score = np.add.reduceat(w[flat], first)
        # all examples take their j-th piece at once; one that has ended keeps its sum
        ahead, behind = np.zeros((2, longest + 1, many))
        for j in range(1, longest + 1):
            r = ends[j]
            ahead[j] = ahead[j - 1]
            np.logaddexp.at(ahead[j], ex[r], ahead[begin[r], ex[r]] + score[r])
        for i in range(longest - 1, -1, -1):
            r = begins[i]
            behind[i] = behind[i + 1]
            np.logaddexp.at(behind[i], ex[r], behind[end[r], ex[r]] + score[r])
        likely = np.exp(ahead[begin, ex] + score + behind[end, ex] - ahead[longest, ex])
        gradient = np.bincount(flat, weights=np.repeat((true - likely) / many, size), minlength=len(names)) - RIDGE * w
        one, two = 0.9 * one + 0.1 * gradient, 0.99 * two + 0.01 * gradient**2
        w += RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return SpanField({f: float(w[i]) for f, i in names.items()})


def examples(found: list[str]) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Zones that the patterns label whole, with what teaches the limits: the same zone broken (no entity), and two of them side by side."""
    rng = np.random.default_rng(SEED)
    whole = [(z, {s}) for z in found for s in base_spans(z) if s[0] in _FIELD_KINDS and s[1:] == (0, len(z))][:MOST_ZONES]
    out = list(whole)
    for z, gold in whole:
        ((kind, _, _),) = gold
        if kind == "card":
            out.append((z[:-1] + str((int(z[-1]) + 1 + int(rng.integers(8))) % 10), set()))
        elif kind == "phone":
            out.append((z[1:], set()))
        else:
            out.append((re.sub("^[0-9]+", str(256 + int(rng.integers(700))), z), set()))
        other, second = whole[int(rng.integers(len(whole)))]
        ((k2, _, e2),) = second
        both = f"{z} {other}"
        out.append((both, {(kind, 0, len(z)), (k2, len(z) + 1, len(z) + 1 + e2)}))
    return [(z, g) for z, g in out if all(luhn(_only_digits(z[s:e])) for k, s, e in g if k == "card")]


#: Fixed forms of each kind that the field is also shown, so that tables without personal data give a usable field.
FIXED = ["4111111111111111", "4012 8888 8888 1881", "3782-822463-10005", "+1 (202) 555-0143", "+44 20 7946 0958", "+14155550123", "192.0.2.17", "8.8.8.8", "203.0.113.255"]


def learn(docs: DataFrame) -> SpanField:
    """A field fitted on a bounded sample of the documents' stretches of digits."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = {t[s:e] for t in b["text"] if t and _DIGITS.search(t) for s, e in zones(t) if e - s <= 40}
            yield pd.DataFrame({"zone": pd.Series(sorted(some), dtype=object)})

    found = docs.select("text").mapInPandas(sample, "zone string").distinct()
    # for each outward form of digits a few, so that rare forms are there too
    shape = F.regexp_replace("zone", "[0-9]", "9")
    few = found.select(F.xxhash64("zone").alias("h"), "zone", shape.alias("shape")).orderBy("h", "zone").limit(20 * MOST_ZONES).toPandas()  # bounded
    zones_, seen = [], {}
    for z, s in zip(few["zone"], few["shape"], strict=True):
        seen[s] = seen.get(s, 0) + 1
        if seen[s] <= 40:
            zones_.append(z)
    return fit_field(examples([*FIXED, *zones_]))


def added_spans(text: str, base: list[tuple[str, int, int]], field: SpanField) -> list[tuple[str, int, int]]:
    """Spans of the field's best segmentations that overlap none of ``base`` (sorted by start)."""
    out, k = [], 0
    taken = []  # what the patterns have found, as stretches that don't overlap
    for _, b, c in base:
        if taken and b <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], c)
        else:
            taken.append([b, c])
    for s, e in zones(text):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        # they split the zone; only the rest is segmented
        free, at, j = [], s, k
        while j < len(taken) and taken[j][0] < e:
            free.append((at, taken[j][0]))
            at = taken[j][1]
            j += 1
        free = [(b, c) for b, c in [*free, (at, e)] if c > b]
        if sum(len(_DIGITS.findall(text, b, c)) for b, c in free) < 4:
            continue
        out += [(kind, b + x, b + y) for b, c in free if c - b >= 7 for kind, x, y in field.spans(text[b:c])]
    return out


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_personal_data(docs: DataFrame, field: SpanField | None = None) -> DataFrame:
    """``doc_id, spans`` of every document: kind, start, end (code points, end exclusive) and whether an exact pattern gave it.

    ``docs``: ``doc_id, text``; other columns are left. Spans are sorted by start, then kind as listed in KINDS. The field
    (learnt from ``docs`` if none is given) adds spans where the patterns fail, such as two numbers run together; it never
    removes or changes a pattern's span. Null or empty text: no spans. Null doc_id stays; repeated rows give equal spans; an
    empty table no rows. Whole texts are read on the scan's partitions; no row meets another.
    """
    field = field or learn(docs)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                base = base_spans(text) if text else []
                more = added_spans(text, base, field) if text and _DIGITS.search(text) else []
                rows = [(*s, True) for s in base] + [(*s, False) for s in more]
                rows.sort(key=lambda s: (s[1], _ORDER[s[0]], s[2]))
                out.append([{"kind": k, "start": s, "end": e, "base": x} for k, s, e, x in rows])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": out})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(find, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, field: SpanField | None = None) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets; overlapping spans become one, of the first's kind.

    Keeps every row and column; ``n_chars``, where there is one, becomes the new length. Null texts stay null.
    """
    field = field or learn(docs)

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = sorted([*base, *added_spans(text, base, field)], key=lambda s: (s[1], _ORDER[s[0]], s[2]))
        parts, at, shown = [], 0, -1
        for k, s, e in spans:
            if s >= shown:
                parts += [text[at:s], f"<{k.upper()}>"]
            at = shown = max(shown, e)
        return "".join([*parts, text[at:]])

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean(t) if t and ("@" in t or _DIGITS.search(t)) else t)

    out = docs.withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
