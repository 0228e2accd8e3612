"""The pipeline's stages, each held against a plain version on its own input."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from neurolake.llm import common, toxicity
from tests.conftest import SMALL
from tests.llm.test_text_operators import ODD, SCHEMA, brute_groups, check_packing, plain_spans


def plain_copies(rows):
    """Copies of each document: a source's share of characters to the power 0.7, quantiles of hashed numbers."""
    mass = defaultdict(int)
    for r in rows:
        mass[r["source"]] += len(r["text"] or "")
    want = sum(m**0.7 for m in mass.values() if m)
    out = Counter()
    for r in rows:
        m = mass[r["source"]]
        rate = sum(mass.values()) * m**0.7 / want / m if m else 1.0
        parts = max(1, math.ceil(rate / 16))
        for j in range(1, parts + 1):
            doc = "null" if r["doc_id"] is None else r["doc_id"]
            u = int(hashlib.md5(f"17:{doc}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            mean, k, p_k = rate / parts, 0, math.exp(-rate / parts)
            below = p_k
            while u >= below and k < 80:
                k += 1
                p_k *= mean / k
                below += p_k
            out[r["doc_id"]] += k
    return +out


def test_stages(spark):
    import public_tokenizers

    docs = common.table(spark, SMALL, "documents")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = common.written(stage(spark, docs, SMALL), name)
        assert docs.columns == list(p.COLUMNS)
        kept[name] = [r for r in docs.collect()]
        ids = Counter(r["doc_id"] for r in kept[name])
        assert set(ids) <= set(before)
        if name == "toxicity":
            tagger = toxicity.learn(common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels"))
            score = lambda text: 1 / (1 + math.exp(-float(toxicity.features(tagger, text or "")[1] @ tagger.blend)))
            assert set(ids) == {i for i, r in before.items() if score(r["text"]) < 0.7} and len(ids) < len(before)
        if name == "neardup":
            rows = sorted(before)
            _, groups = brute_groups([before[i]["text"] for i in rows])
            assert sorted(ids) == sorted({rows[g] for g in groups})
        if name == "pii":
            assert set(ids) == set(before)
            assert not any(plain_spans(r["text"]) for r in kept[name]) and all(r["n_chars"] == len(r["text"]) for r in kept[name])
            assert all(r["text"] == before[r["doc_id"]]["text"] for r in kept[name] if "<" not in r["text"])
        if name == "mix":
            assert ids == plain_copies(before.values())
            assert all(r["text"] == before[r["doc_id"]]["text"] for r in kept[name])
    pieces = p.STAGES[-1][1](spark, docs, SMALL)
    check_packing(docs, pieces, public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls, empty and very long texts, repeated rows, more columns with clashing names; then no rows at all."""
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for extra in ("n", "key", "copy", "score", "spans", "component_id", "shuffle_key"):
        docs = docs.withColumn(extra, F.lit("x"))
    got = stage(spark, docs, SMALL).collect()
    ids = Counter(r["doc_id"] for r in got)
    if name in ("toxicity", "pii"):
        assert ids == Counter(r[0] for r in ODD)
        assert Counter(r["text"] for r in got) == Counter(r[1] for r in ODD)
    if name == "neardup":  # of the equal texts one stays
        assert {i for i in ids if i in (5, 6)} == {5} and {i for i in ids if i in (7, 8)} == {7} and {1, 2, 3, 4, None} <= set(ids)
    if name == "mix":
        rows = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=False)) for r in ODD]
        assert ids == plain_copies(rows)
    if name == "pack":
        assert set(ids) == {r[0] for r in ODD}
    nothing = stage(spark, docs.limit(0), SMALL)
    assert nothing.count() == 0 and (name == "pack" or nothing.columns == list(p.COLUMNS))


def test_order_of_stages():
    assert [n for n, _ in p.STAGES] == ["toxicity", "neardup", "pii", "mix", "pack"]
