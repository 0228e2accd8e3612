"""Operators on embeddings against brute force, and on odd rows."""

import functools
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolake.llm import ann, common, embed_dedup

NAN, INF = float("nan"), float("inf")


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.9, 0.1]), (40, None), (60, [0.0, 0.0]), (1, [NAN, 1.0]), (2, [INF, 1.0]), (3, [1.0, None]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0]), (None, [1.0, 0.0]), (6, [-1.0, 0.5]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for extra in ("label", "rank", "score", "unit", "a", "sim"):
        df = df.withColumn(extra, F.lit("x"))
    return df


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    top = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([top[i], *(top[j] for j in np.nonzero(hit[i])[0])]) for i in range(len(x))]
        if new == top:
            break
        top = new
    return hit.sum(axis=1), top


def clustered(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 32))
    for k in range(0, 200, 4):
        x[k + 1 : k + 4] = x[k] + rng.normal(size=(3, 32)) * rng.uniform(0.05, 0.4)
    x[300:380] = x[299] + rng.normal(size=(80, 32)) * 0.2
    return x


def test_links_and_components(spark):
    x = clustered()
    degree, component = brute_links(x)
    t = table(spark, x)
    result = embed_dedup.near_duplicate_vectors(t)
    got = {r["vec_id"]: r for r in result.collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= degree).all() and found.sum() >= 0.98 * degree.sum()
    assert np.mean([got[i]["component_id"] == component[i] for i in range(len(x))]) > 0.98
    assert embed_dedup.recall_audit(t, result, 400) == pytest.approx(found.sum() / degree.sum())


def test_links_odd_rows(spark, odd, rows):
    got = {r[0]: r[1:] for r in rows(embed_dedup.near_duplicate_vectors(odd))}
    assert got[0] == (2, 0, True) and got[20] == (2, 0, False) and got[4] == (2, 0, False)
    for i in (40, 60, 1, 2, 3, 5, 6, 7):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert embed_dedup.near_duplicate_vectors(odd.where("false")).count() == 0
    assert embed_dedup.near_duplicate_vectors(odd.where("vec_id = 40")).count() == 1


def test_nearest_against_all(spark):
    x = clustered(1) * np.random.default_rng(2).uniform(0.2, 3, (400, 1)) + 0.5
    got = {}
    for r in ann.nearest(table(spark, x)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(score == pytest.approx(s[i]) for i, score in got[q].values())
        hit += len(set(order) & {i for i, _ in got[q].values()})
    assert hit / 400 >= 0.95


def test_nearest_over_levels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 30)
    monkeypatch.setattr(ann, "WIDEN", 2)
    x = np.random.default_rng(3).normal(size=(300, 16))
    got = ann.nearest(table(spark, x), every=50, k=5).collect()
    for q in range(0, 300, 50):
        s = x @ x[q]
        s[q] = -np.inf
        assert len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist())) >= 4


def test_ties_go_to_the_smaller_id(spark, rows):
    x = np.array([[1.0, 0.0]] * 5)
    got = rows(ann.nearest(table(spark, x, [0, 7, 3, 9, 5]), k=3))
    assert got == [(0, 1, 3, 1.0), (0, 2, 5, 1.0), (0, 3, 7, 1.0)]


def test_nearest_odd_rows(spark, odd, rows):
    got = rows(ann.nearest(odd))
    assert [r[:3] for r in got] == [(0, 1, 4), (0, 2, 20), (0, 3, 6), (20, 1, 0), (20, 2, 4), (20, 3, 6)]
    assert ann.nearest(odd.where("false")).count() == 0
    assert ann.nearest(odd.where("vec_id = 0")).count() == 0


def test_codes_estimate_within_their_bounds():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    turn, centre = ann.rotation(64), x.mean(axis=0)
    est, err = ann.estimates(q, *ann.encode(x, centre, turn), centre, turn)
    gap = np.abs(est - q @ x.T)
    assert (gap <= err).mean() > 0.95 and np.corrcoef(est.ravel(), (q @ x.T).ravel())[0, 1] > 0.7


@pytest.mark.parametrize("scale", [1.0, 1e60, 1e-60])
def test_few_vectors_get_true_products(monkeypatch, scale):
    """Vectors without any structure, of any length: the codes leave a few of a hundred pairs, and what reaches the floor is found."""
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(5000, 64)), rng.normal(size=(300, 64))
    x, q = x / np.linalg.norm(x, axis=1, keepdims=True) * scale, q / np.linalg.norm(q, axis=1, keepdims=True)
    true, ids, qid = q @ x.T, np.arange(5000), 10_000 + np.arange(300)
    floor, near, scores = ann.best_of(qid, q, ids[:500], x[:500], 20)
    assert all(set(near[i]) == set(np.argsort(-true[i, :500])[:20]) and floor[i] == scores[i][-1] for i in range(300))
    floor, products = np.sort(true, axis=1)[:, -20] - 1e-9 * scale, []
    monkeypatch.setattr(ann, "inner", lambda a, b: products.append(len(a)) or np.einsum("ij,ij->i", a, b))
    turn, centre = ann.rotation(64, ann.LEAST_BITS), x.mean(axis=0)
    rows, cols, score = ann.search_block(qid, q, floor, ids, x, *ann.encode(x, centre, turn), centre, turn, 20)
    assert sum(products) < 0.08 * true.size  # a bit a component leaves a fifth
    want = {(10_000 + i, j) for i in range(300) for j in np.argsort(-true[i])[:20]}
    assert len(want & set(zip(rows.tolist(), cols.tolist(), strict=True))) >= 0.98 * len(want)


@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 3000])
def test_inner_products_are_summed_in_order(n):
    from neurolake.llm.vectors import inner

    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, 70)) * 10.0 ** rng.integers(-8, 8, (n, 70)), rng.normal(size=(n, 70))
    want = [functools.reduce(operator.add, (u * v for u, v in zip(x, y, strict=True))) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert inner(a, b).tolist() == want


def test_components_of_a_long_chain(spark, rows):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(rows(common.connected_components(edges)))
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100
    assert common.connected_components(edges.where("false")).count() == 0


def test_links_of_a_dense_group_of_thousands(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:2500] = np.sqrt(0.92) * x[2999] + np.sqrt(0.08) * x[:2500]
    degree, component = brute_links(x)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicate_vectors(table(spark, x)).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert degree.sum() > 4_000_000 and (found <= degree).all() and found.sum() >= 0.999 * degree.sum()
    assert all(got[i]["component_id"] == component[i] for i in range(len(x)))


def rare(n=12_000, pairs=60, d=64, seed=11):
    """Random vectors of which a few pairs have a cosine of 0.905: no sample of a few hundred holds a link."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 2 * pairs, 2):
        side = rng.normal(size=d)
        side -= side @ x[k] * x[k]
        x[k + 1] = 0.905 * x[k] + np.sqrt(1 - 0.905**2) * side / np.linalg.norm(side)
    place = rng.permutation(n)
    return x[np.argsort(place)], place


def test_links_too_rare_for_a_sample(spark):
    x, place = rare()
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicate_vectors(table(spark, x)).collect()}
    for k in range(0, 120, 2):
        a, b = sorted((int(place[k]), int(place[k + 1])))
        assert got[a]["n_links"] == got[b]["n_links"] == 1 and got[b]["component_id"] == got[a]["component_id"] == a
    assert sum(r["n_links"] for r in got.values()) == 120


def test_recapture_says_what_a_descent_lost(spark):
    """With half of the pairs taken away, fresh tables bring them back and the estimate is near what is still missing."""
    x, place = rare(3000, 200)
    units = table(spark, x).withColumn("radius", F.lit(0.0))
    true = {tuple(sorted((int(place[k]), int(place[k + 1])))) for k in range(0, 400, 2)}
    half = spark.createDataFrame(sorted(true)[::2], "a long, b long")
    near, missing = embed_dedup.recaptured(units, 64, 3000, half, 0)
    have = {(r["a"], r["b"]) for r in near.collect()}
    assert have <= true and len(have) >= 0.99 * len(true) and missing <= 0.001
    nothing, missing = embed_dedup.recaptured(units.where("vec_id >= 0").limit(0), 64, 3000, half.limit(0), 0)
    assert nothing.count() == 0 and missing == 0.0


def test_comparing_all_units_in_blocks(spark, monkeypatch):
    x = clustered(3)
    for block in (37, 400, 5000):
        monkeypatch.setattr(embed_dedup, "EXACT_BLOCK", block)
        got = [tuple(r) for r in embed_dedup._all_pairs(table(spark, x).withColumn("radius", F.lit(0.0)), len(x)).select("a", "b").collect()]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert len(got) == len(set(got)) and set(got) == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.9 - 1e-6, 1)))}


def test_links_match_sql_where_there_are_links(spark):
    import duckdb
    import pandas as pd

    from tests.oracle import same

    x = clustered(5)[:260]
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame({"vec_id": range(len(x)), "embedding": [list(map(float, r)) for r in x]}))
    want = con.sql(embed_dedup.SQL).df()
    assert want["n_links"].sum() > 300
    same(embed_dedup.near_duplicate_vectors(table(spark, x)).toPandas(), want)
