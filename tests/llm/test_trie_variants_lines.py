"""Shared lines, spelling variants and the trie of beginnings against plain versions, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from neurolake.llm import common, line_dedup, prefix_trie, variants
from tests.llm.test_text_operators import ODD, SCHEMA

EXTRA = ("n", "key", "line", "pos", "h1", "n_lines", "n_dropped", "places", "keeper", "word", "row", "place", "block", "depth", "copy")


def with_extra(df):
    for c in EXTRA:
        df = df.withColumn(c, F.lit("x"))
    return df


# Lines


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_lines(rows, min_chars=20, min_docs=3):
    """doc_id and text in, doc_id, number of lines, number dropped and text left out."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    keeper = {k: max(d for d in docs if d is not None) for k, docs in held.items() if len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


def cleaned(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())


SHARED = "This line stands on very many pages"
LINES = [
    (1, f"{SHARED}\nown words of the first document\n{SHARED}\n"), (2, f"\t {SHARED.upper()} \r\nshort\n\nshort"), (3, f"{SHARED}\x0b\n{SHARED}"), (4, SHARED),
    (5, "É is not é in a key of this line"), (6, "é is not é in a key of this line"), (7, "É is not é in a key of THIS line"), (8, "É is not é in a key of this line"),
    (9, "only two documents hold this line"), (9, "only two documents hold this line"), (10, "only two documents hold this line"), (11, "x" * 20), (12, "X" * 20), (13, "x" * 20 + "\n\n"), (14, "x" * 19), (15, "x" * 19), (16, "x" * 19),
    (None, SHARED), (17, None), (18, ""), (19, "\n\n"), (20, "aé" * 9 + "b\nlast"), (21, "aé" * 9 + "b"), (22, "aé" * 9 + "b"), (2, "another row of two\n" + SHARED), (2, "another row of two\n" + SHARED),
]


def test_shared_lines_against_a_plain_version(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").repartition(5)
    assert cleaned(line_dedup.drop_shared_lines(docs)) == plain_lines(LINES)
    assert cleaned(line_dedup.drop_shared_lines(docs, 5, 2)) == plain_lines(LINES, 5, 2)


def test_a_document_of_very_many_lines(spark):
    """Work in proportion to lines, with every second one dropped."""
    text = "\n".join(f"{'a line that others hold too' if i % 2 else 'a line of its own'} {i}" for i in range(20_000))
    rows = [(1, text), (2, text.replace("of its own", "of the second")), (3, text.replace("of its own", "of the third"))]
    assert cleaned(line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_lines(rows)


def test_shared_lines_on_odd_rows(spark):
    docs = with_extra(spark.createDataFrame(ODD, SCHEMA).repartition(3))
    out = line_dedup.drop_shared_lines(docs)
    assert set(out.columns) == set(docs.columns) and dict(out.dtypes)["n_lines"] == "bigint"
    assert cleaned(out) == plain_lines([r[:2] for r in ODD])
    assert {r["places"] for r in out.collect()} == {"x"}
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_shared_lines_run_without_python(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    plan = line_dedup.drop_shared_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Words


def plain_counts(rows, every):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(n):
    form, out = {}, set()
    around = {w: [v for v in n if near(v, w)] for w in n}
    for w, some in around.items():
        if some:
            best = min(some, key=lambda v: (-n[v], v))
            form[w] = best if n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if form.get(w) else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words_of_documents(spark):
    rows = [(r[0], r[1]) for r in common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").limit(60).collect()] + [(None, "Éxample éxample ÉXAMPLE ÉXAMPLE twice, twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (None, 3, 31):
        got = {r["word"]: r["n"] for r in variants.word_counts(docs, typo_every=every).collect()}
        assert got == plain_counts(rows, every)


@pytest.mark.parametrize("busy", [64, 0, 3])
def test_variants_against_all_pairs(spark, monkeypatch, busy):
    """Words a few edits apart, long runs of one letter, other scripts; with halves that few, all or some rows share."""
    import random

    monkeypatch.setattr(variants, "BUSY", busy)
    rng = random.Random(busy)
    base = ["aaaaaaa", "aaaaaaaa", "abababab", "straßenb", "naïvelyx", "mississippi", "banananas", "eeeeeeeeeeeeeee", "x" * 300, "ab", "a"]
    words = set(base)
    for w in base * 30:
        for _ in range(rng.choice([1, 1, 2, 3])):
            i, c = rng.randrange(len(w)), rng.choice("absxéÿ")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            w = w or "b"
        words.add(w)
    n = {w: rng.choice([1, 2, 2, 3, 20, 30, 200, 5000]) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert found(variants.spelling_variants(df)) == plain_variants(n)


def test_a_busy_half_costs_its_words(spark):
    """Thousands of words of one beginning: what meets is near, not all pairs."""
    words = spark.range(4000).selectExpr("concat('abcdefgh', translate(lpad(conv(id * 7919, 10, 7), 8, '0'), '0123456', 'stuvwxy')) as word", "2L as n")
    tables = common.Scratch(spark)
    met = variants.near_words(tables.written(words, "words"), tables)
    met.write.format("noop").mode("overwrite").save()
    assert met.where("length(a) - length(b) not in (0, 1)").count() == 0
    got = found(variants.spelling_variants(words))
    tails, around = defaultdict(set), defaultdict(set)
    plain = [r["word"] for r in words.collect()]
    for w in plain:
        for i in range(len(w)):
            tails[i, w[:i], w[i + 1 :]].add(w)
    for some in tails.values():
        for w in some:
            around[w] |= some - {w}
    assert {(r[0], r[4]) for r in got} == {(w, len(around[w])) for w in plain}
    assert met.count() == sum(map(len, around.values())) // 2 > 0


def test_variants_on_odd_rows(spark):
    docs = with_extra(spark.createDataFrame(ODD + [(9, "abcdefg " * 20, "en", "a", 1), (10, "abcdefgh abcdefgh", "en", "a", 1)], SCHEMA).repartition(3))
    got = found(variants.spelling_variants(variants.word_counts(docs)))
    assert got == {("abcdefg", None, "abcdefg", 20, 1, None), ("abcdefgh", "abcdefg", "abcdefg", 2, 1, 20)}
    assert variants.spelling_variants(variants.word_counts(docs.limit(0))).count() == 0


# Conversations


def plain_trie(rows, shared):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    if shared:
        def rebuilt(c):
            h = zlib.crc32(str(c).encode()) % 6
            return turns.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[c][h:]

        turns = {c: rebuilt(c) for c in turns}
    members = defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    children = Counter(w[:-1] for w in members if w)
    leaves, saved = Counter(), Counter()
    for w, convs in members.items():
        for d in range(len(w) + 1):
            leaves[w[:d]] += children[w] == 0
            saved[w[:d]] += (len(convs) - 1) * len(w[-1][1]) if w else 0
    out = set()
    for w, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(turns[c]) == len(w))
        out.add((convs[0], len(w), members[w[:-1]][0] if w else None, len(convs), children[w], leaves[w], saved[w], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    rows = [tuple(r) for r in df.select(*NODE).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def chat(n, seed=5):
    """Conversations with common beginnings, repeated ones, very short and very long ones; of some groups the first isn't there."""
    import random

    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-150, 450), n):
        if 200 <= c < 206:
            continue
        length = rng.choice([1, 2, 3, 5, 8]) if c != 77 else 90
        for t in range(length):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["yes", "no", "né", "a longer answer"]) if t < 3 or c == 77 else "same"))
    return rows


@pytest.mark.parametrize("shared", [False, True])
def test_trie_against_a_plain_version(spark, shared):
    rows = chat(300)
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    assert nodes(prefix_trie.prefix_trie(df, shared)) == plain_trie(rows, shared)


@pytest.mark.parametrize("shared", [False, True])
def test_trie_on_odd_rows(spark, shared):
    """Nulls, ties in turn, repeated rows, empty and very long texts, many conversations that end alike, more columns; then no rows."""
    rows = [
        (None, 1, "user", "belongs to nobody"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 5, "user", "first"), (2, 9, None, ""),
        (100, 1, "a", "bc"), (101, 1, "ab", "c"), (102, 3, "user", "x" * 300_000), *[(c, 0, "user", "hello") for c in range(103, 3000)],
    ]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    for c in ("block", "place", "k1", "chars", "id", "parent"):
        df = df.withColumn(c, F.lit("x"))
    assert nodes(prefix_trie.prefix_trie(df, shared)) == plain_trie(rows, shared)
    assert prefix_trie.prefix_trie(df.limit(0), shared).count() == 0


def test_sums_of_deep_and_wide_trees(spark):
    """A chain of 300 under a node of 300 leaves, with bushes along it, and two roots."""
    parent = {0: None, 1000: None, 1001: 1000}
    parent |= {i: i - 1 for i in range(1, 300)} | {i + 300: 0 for i in range(300)} | {i + 2000: i for i in range(0, 300, 7)} | {i + 3000: i + 2000 for i in range(0, 300, 7)}
    rows = [(i, p, i % 5) for i, p in parent.items()]
    sums = Counter()
    for i, _, v in rows:
        at = i
        while at is not None:
            sums[at] += v
            at = parent[at]
    tables = common.Scratch(spark)
    got = prefix_trie.subtree_sums(spark.createDataFrame(rows, "id long, parent long, v long"), ["v"], tables)
    assert {r["id"]: r["v"] for r in got.collect()} == {i: sums[i] for i in parent}
    assert sum("/round-" in p for p in tables.paths) < 40
    tables.drop()
