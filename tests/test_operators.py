"""Values that the operators must give on small inputs."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neurolake.functions import columns as C
from neurolake.operators import intervals, plotdata, series, signal, spatial, trials, ttl
from neurolake.plans import recordings
from neurolake.sources import binary, flat
from neurolake.sources.probes import probe_contacts


def word_rows(spark, highs, n):
    return spark.createDataFrame([(t, int(any(a <= t < b for a, b in highs))) for t in range(n)], "tick long, word int")


def test_two_pulses(spark, rows):
    words = word_rows(spark, [(10, 20), (30, 40)], 100)
    assert rows(ttl.edges(ttl.line_states(words, 0))) == [(10, 1), (20, -1), (30, 1), (40, -1)]
    assert rows(ttl.line_pulses(words, 0)) == [(10, 20), (30, 40)]


def test_line_out_of_range():
    with pytest.raises(ValueError):
        C.bit(None, 16)


def test_edges_over_block_borders_and_gaps(spark, rows):
    states = spark.createDataFrame([(0, 0), (5, 1), (17, 0), (40, 0), (41, 1)], "tick long, hi int")
    from neurolake.operators.intervals import with_previous

    got = rows(with_previous(states, F.col("hi"), "tick", block=8).select("tick", "previous"))
    assert got == [(0, None), (5, 0), (17, 1), (40, 0), (41, 0)]


def test_states_other_than_0_and_1_fail(spark):
    with pytest.raises(Exception, match="0 or 1"):
        ttl.edges(spark.createDataFrame([(0, 0), (1, 2)], "tick long, hi int")).collect()


def test_high_resting_line_begins_with_falls(spark, rows):
    # toggles every two samples, high first, with a majority high
    words = spark.createDataFrame([(t, int((t // 2) % 2 == 0)) for t in range(102)], "tick long, word int")
    on = [r[0] for r in rows(ttl.line_pulses(words, 0))]
    assert on[:3] == [2, 6, 10]


def test_unequal_edges(spark, rows):
    edges = spark.createDataFrame([(10, 1), (20, -1), (30, 1), (40, -1), (50, 1)], "tick long, direction int")
    assert rows(ttl.pulses(edges)) == [(10, 20), (30, 40)]
    assert rows(ttl.pulses(edges, mode="reference")) == [(30, 20), (50, 40)]


def test_neighbours_do_not_depend_on_the_blocks(spark, rows):
    rng = np.random.default_rng(8)
    keys = lambda n: [None if k == 3 else int(k) for k in rng.integers(0, 4, n)]
    a = [(k, int(t), None if t % 7 == 0 else float(t % 5)) for k, t in zip(keys(60), rng.integers(-300, 300, 60), strict=True)]
    b = [(i, k, int(t)) for i, (k, t) in enumerate(zip(keys(200), rng.integers(-400, 400, 200), strict=True))] + [(999, 9, 5), (998, 1, None)]
    src, dst = spark.createDataFrame(a, "k int, tick long, v double"), spark.createDataFrame(b, "id int, k int, at long")
    held, near = [], []
    for i, k, t in b:
        own = sorted((u, v) for q, u, v in a if q == k and v is not None)
        before = [v for u, v in own if t is not None and u <= t]
        held.append((i, before[-1] if before else own[0][1] if own else None))
        ticks = sorted(u for q, u, _ in a if q == k)
        near.append((i, min(ticks, key=lambda u: (abs(u - t), u)) if ticks and t is not None else None))
    known = lambda got: [r for r in got if r[0] != 998]
    for block in (1, 10, 64, 1 << 20):
        assert known(rows(intervals.as_of(dst, src, "at", "tick", "v", ["k"], clamp=True, block=block), "id", "v")) == known(sorted(held))
        assert known(rows(intervals.nearest(dst, src, "at", "tick", ["k"], block), "id", "near")) == known(sorted(near))
    assert intervals.as_of(dst, src, "at", "tick", "v", ["k"]).count() == len(b)


def test_nearest_takes_the_earlier_of_a_tie(spark, rows):
    a = spark.createDataFrame([(0, t) for t in (2, 6, 18, 22, 38, 42)], "k int, tick long")
    b = spark.createDataFrame([(0, t) for t in (0, 10, 20, 40, 99)], "k int, at long")
    assert rows(intervals.nearest(b, a, "at", "tick", ["k"]), "at", "near") == [(0, 2), (10, 6), (20, 18), (40, 38), (99, 42)]


@pytest.mark.parametrize(("ticks", "low", "high", "closed", "n"), [([0, 5, 5, 10], 5, 10, "both", 3), ([0, 5, 10], 5, 10, "left", 1), ([20, 5, 15], 10, 20, "both", 2), ([], 0, 9, "both", 0)])
def test_interval_counts(spark, ticks, low, high, closed, n):
    s = spark.createDataFrame([(t,) for t in ticks], "tick long")
    i = spark.createDataFrame([(1, low, high)], "interval_id int, a long, b long")
    assert intervals.counted_in(s, i, "tick", "a", "b", ["interval_id"], 4, closed=closed).first()["n"] == n


def test_overlapping_intervals_each_count(spark, rows):
    s = spark.createDataFrame([(t,) for t in range(0, 100, 3)], "tick long")
    i = spark.createDataFrame([(1, 0, 9), (2, 10, 30), (3, 5, 12), (4, 200, 300)], "interval_id int, a long, b long")
    assert rows(intervals.counted_in(s, i, "tick", "a", "b", ["interval_id"], 7), "interval_id", "n") == [(1, 4), (2, 7), (3, 3), (4, 0)]


def test_rate(spark):
    df = spark.createDataFrame([(15, 30000)], "n long, d long")
    assert df.select(C.rate_hz(F.col("n"), F.col("d"), 30000)).first()[0] == 15.0
    with pytest.raises(Exception, match="positive"):
        df.select(C.rate_hz(F.col("n"), F.lit(0), 30000)).collect()


@pytest.mark.parametrize(("onsets", "half", "kept"), [([0, 100, 200], 500, [0]), ([0, 2000, 4000], 500, [0, 2000, 4000]), ([0, 150, 500, 650, 1200], 100, [0, 500, 1200]), ([], 5, []), ([7, 7, 3], 1, [3, 7])])
def test_thinning(spark, onsets, half, kept):
    e = spark.createDataFrame([("r", t) for t in onsets], "r string, tick long")
    assert sorted(x["tick"] for x in intervals.thinned(e, "tick", half, ["r"]).collect()) == kept


def test_thinning_equals_the_plain_walk(spark):
    rng = np.random.default_rng(0)
    times = rng.integers(0, 5000, 400).tolist()
    last, want = -math.inf, []
    for t in sorted(times):
        if t - last >= 60:
            want.append(t)
            last = t
    e = spark.createDataFrame([("r", t) for t in times], "r string, tick long")
    assert sorted(x["tick"] for x in intervals.thinned(e, "tick", 30, ["r"]).collect()) == want


def one_unit(spark, ticks, onsets):
    s = spark.createDataFrame([(1, t) for t in ticks], "unit_id long, tick long")
    t = spark.createDataFrame([(1, i, o) for i, o in enumerate(onsets)], "unit_id long, trial_id long, event_tick long")
    return s, t


def test_alignment_closedness(spark, rows):
    s, t = one_unit(spark, [-500, -200, 0, 150, 400, 500], [0])
    assert trials.aligned(s, t, 500, 30000.0).count() == 5
    assert trials.aligned(s, t, 500, 30000.0, "neither").count() == 4


def test_orders(spark, rows):
    rel = spark.createDataFrame([(1, 0, 5, 0.2), (1, 1, 1, -0.1), (1, 1, 2, 0.3), (1, 1, 3, 0.4)], "unit_id long, trial_id long, tick long, rel_s double")
    t = spark.createDataFrame([(1, i) for i in range(3)], "unit_id long, trial_id long")
    keys = trials.trial_keys(rel, t)
    by = lambda df: [r["trial_id"] for r in df.orderBy("place").collect()]
    assert by(trials.order_by_count_descending(keys)) == [1, 0, 2]
    assert by(trials.order_by_first_spike(keys)) == [1, 0, 2]
    assert by(trials.order_by_count_then_first(keys)) == [2, 0, 1]
    assert by(trials.order_by_first_positive(keys)) == [2, 0, 1]
    cov = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 1.0), (1, 2, 2.0)], "unit_id long, trial_id long, v double")
    assert by(trials.order_by_covariate(cov, "v")) == [1, 2, 0]
    assert by(trials.order_by_covariate(cov, "v", False)) == [2, 1, 0]


@pytest.mark.parametrize(("times", "want"), [([0.010, 0.014, 0.020], [0.4]), ([0, 0.002, 0.005, 0.011], [0.4, 2 / 3]), ([0.010, 0.010, 0.010, 0.020], [2.0]), ([0.01, 0.02], [])])
def test_cv2(spark, times, want):
    df = spark.createDataFrame([(0, float(t)) for t in times], "k int, t double")
    assert sorted(r["cv2"] for r in trials.interval_variability(df, "t", ["k"]).collect()) == pytest.approx(sorted(want))


def test_intervals_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(0, x) for x in (0.03, float("nan"), 0.01, 0.02, float("inf"))], "k int, t double")
    assert sorted(r["isi"] for r in trials.spike_intervals(df, "t", ["k"]).collect()) == pytest.approx([0.01, 0.01])


def test_last_bin_is_closed(spark, rows):
    rel = spark.createDataFrame([(1, 0, 0, v) for v in (0.0, 0.5, 1.0, 1.5, 2.0, 2.1, float("nan"))], "unit_id long, trial_id long, tick long, rel_s double")
    t = spark.createDataFrame([(1, 0), (1, 1)], "unit_id long, trial_id long")
    got = rows(trials.trial_histograms(rel, t, [0, 1, 2]), "trial_id", "bin", "count")
    assert got == [(0, 0, 2), (0, 1, 3), (1, 0, 0), (1, 1, 0)]


def test_bootstrap_is_the_same_each_time_and_holds_the_mean(spark):
    rng = np.random.default_rng(1)
    h = spark.createDataFrame([(1, i, 0, int(c)) for i, c in enumerate(rng.poisson(3, 40))], "unit_id long, trial_id long, bin int, count long")
    t = h.select("unit_id", "trial_id")
    a, b = (trials.bootstrap_interval(h, t, 1.0, 200, 95.0, 3).first() for _ in range(2))
    assert a == b
    mean = h.agg(F.avg("count")).first()[0]
    assert a["low"] < mean < a["high"]


@pytest.mark.parametrize("most,chunk", [(100_000, 7), (100_000, 1000), (5, 250)])
def test_bootstrap_draws_don_t_depend_on_how_they_are_made(spark, monkeypatch, most, chunk):
    """In chunks of any size, as matrices or as rows, against plain draws; units without a spike, and of one trial."""
    rng = np.random.default_rng(2)
    h = [(u, t, b, int(rng.poisson(u))) for u, n in ((0, 6), (1, 5), (2, 9), (3, 1)) for t in range(n) for b in range(3)]
    df = spark.createDataFrame(h, "unit_id long, trial_id long, bin int, count long").repartition(3)
    monkeypatch.setattr(trials, "MOST_TRIALS", most)
    got = {(r["unit_id"], r["bin"]): (r["low"], r["high"]) for r in trials.bootstrap_interval(df, df.select("unit_id", "trial_id").distinct(), 0.5, 60, 90.0, 11, chunk).collect()}
    for u, n in ((0, 6), (1, 5), (2, 9), (3, 1)):
        m = np.array([[c for uu, t, b, c in h if uu == u and t == i] for i in range(n)])
        means = []
        for rep in range(60):
            words = b"".join(hashlib.md5(f"11:{u}:{rep}:{g}".encode()).digest() for g in range(-(-n // 4)))
            means.append(m[np.frombuffer(words, ">u4")[:n] % n].sum(axis=0) / n / 0.5)
        low, high = np.percentile(means, [5, 95], axis=0)
        for b in range(3):
            assert got[u, b] == pytest.approx((low[b], high[b]))


@pytest.mark.parametrize("start", ["7:1:", "7:-123456789012:", "0:a unit's name \u00e9:", "7:" + "u" * 48 + ":", "7:" + "long" * 30 + ":"])
def test_words_of_draws_are_those_of_md5(start):
    """Counters of one to three digits, replicates of one to five, messages about and beyond a block."""
    for replicates, n in ((range(0, 120), 1), (range(98, 102), 450), (range(9_995, 10_003), 43), (range(5, 6), 5)):
        want = [np.frombuffer(b"".join(hashlib.md5(f"{start}{r}:{g}".encode()).digest() for g in range(-(-n // 4))), ">u4") for r in replicates]
        assert (trials._digest_words(start.encode(), replicates, n) == np.stack(want)).all()


def test_bootstrap_jobs_are_spread_over_tasks(spark):
    """Little data, much work: few bytes of jobs aren't put together into one task."""
    h = spark.range(400).selectExpr("id % 40 as unit_id", "id as trial_id", "0 as bin", "id % 3 as count")
    cells = h.select("unit_id", F.floor(F.col("trial_id") / 40).alias("i"), "bin", "count")
    sizes = h.groupBy("unit_id").agg(F.count("*").alias("n")).withColumn("bins", F.lit(2))
    sums = trials._drawn_sums(cells, sizes, 50, 3, 25)
    assert sums.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert {(r["unit_id"], r["bin"], r["times"]) for r in sums.groupBy("unit_id", "bin").agg(F.sum("times").alias("times")).collect()} == {(u, b, 50) for u in range(40) for b in range(2)}


def test_smoothing_keeps_the_sum_and_mirrors(spark):
    h = spark.createDataFrame([(0, b, 8 if b == 0 else 0) for b in range(6)], "k int, bin int, count long")
    got = {r["bin"]: r["smooth"] for r in trials.smoothed(h, ["k"], "count", 6, 1.0).collect()}
    assert sum(got.values()) == pytest.approx(8)
    assert got[0] > got[1] > got[2]


def test_zscore_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0), ("b", 2.0)], "k string, v double")
    got = sorted((r["k"], r["z"]) for r in series.zscored(df, "v", ["k"]).collect())
    assert got == [("a", -1.0), ("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]


def test_sample_hold_clamps(spark, rows):
    s = spark.createDataFrame([(0, 10, 1.0), (0, 20, 2.0)], "k int, t long, v double")
    q = spark.createDataFrame([(0, x) for x in (5, 10, 19, 25)], "k int, at long")
    assert rows(series.sample_hold(q, s, "at", "t", "v", ["k"]), "at", "v") == [(5, 1.0), (10, 1.0), (19, 1.0), (25, 2.0)]


def test_impulses_in_overlapping_bins_and_gaps(spark, rows):
    b = spark.createDataFrame([(0,), (5,), (20,)], "start long")
    e = spark.createDataFrame([(6,), (15,), (21,)], "tick long")
    assert rows(series.impulses(b, e, "tick", 10)) == [(0, 1.0), (5, 1.0), (20, 1.0)]


def test_envelope_drops_the_tail(spark, rows):
    df = spark.createDataFrame([(t, float(t % 4)) for t in range(10)], "tick long, v double")
    assert rows(series.envelope(df, "v", 4)) == [(0, 0.0, 3.0), (4, 0.0, 3.0)]


def matrix(df, leads=0):
    out = {}
    for r in df.collect():
        out[r["row"], r["col"]] = r["weight"]
    n, m = max(k[0] for k in out) + 1, max(k[1] for k in out) + 1
    return np.array([[out[i, j] for j in range(m)] for i in range(n)])


def test_basis_columns_sum_to_one_and_log_without_leads(spark):
    b = matrix(series.basis(spark, 40, 8, "log_raised_cosine"))
    assert b.sum(axis=0) == pytest.approx(np.ones(8))
    assert np.argmax(b[:, 0]) == 0
    assert np.argmax(b[:, -1]) == 39


def test_lead_knots_and_seam(spark):
    b = matrix(series.basis(spark, 50, 8, "log_raised_cosine", n_leads=20, n_lead_cols=2, lead=2.0))
    assert b.shape == (70, 10)
    assert np.abs((np.argmax(b[:, :2], axis=0) - 20) * 0.1 - [-2.0, -1.0]).max() <= 0.15
    assert (b[18:22].sum(axis=1) > 0).all()
    assert series.knot_centres(50, 11, 0.1, 4, 2.0) == pytest.approx([-2, -1.5, -1, -0.5, *np.linspace(0, 5, 11)])
    with pytest.raises(ValueError):
        series.basis(spark, 0, 3)


def test_design_equals_convolution(spark):
    rng = np.random.default_rng(2)
    x = rng.random(30) * (rng.random(30) < 0.3)
    s = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(x)], "r int, tick long, x double")
    w = series.basis(spark, 5, 3)
    k = matrix(w)
    for f, shift in ((series.design_columns, 0), (series.history_columns, 1)):
        got = {(r["tick"], r["col"]): r["y"] for r in f(s, w, ["r"]).collect()}
        for c in range(3):
            want = np.concatenate([np.zeros(shift), np.convolve(x, k[:, c])])[:30]
            assert [got[t, c] for t in range(30)] == pytest.approx(want.tolist())


def test_impulse_reaches_before_with_leads(spark):
    s = spark.createDataFrame([(0, t, float(t == 3)) for t in range(6)], "r int, tick long, x double")
    got = {(r["tick"], r["col"]): r["y"] for r in series.design_columns(s, series.basis(spark, 3, 2, n_leads=2, n_lead_cols=1, lead=0.2), ["r"]).collect()}
    assert any(got[1, c] > 0 for c in range(3)) and any(got[2, c] > 0 for c in range(3)) and got[0, 0] == 0


def frames(spark, x):
    return spark.createDataFrame([("r", t, [float(v) for v in row]) for t, row in enumerate(x)], "recording_id string, tick long, uv array<double>")


def back(df):
    return np.array([r["uv"] for r in df.orderBy("tick").collect()])


def test_common_median(spark):
    x = np.random.default_rng(0).normal(size=(20, 4))
    m = np.median(x[:, [0, 1, 3]], axis=1, keepdims=True)
    want = x.copy()
    want[:, [0, 1, 3]] -= m
    assert back(spatial.common_median_reference(frames(spark, x), [0, 1, 3])) == pytest.approx(want)
    assert back(spatial.common_median_reference(frames(spark, x), [0, 1, 3], "all")) == pytest.approx(x - m)


def test_whitening_decorrelates_and_round_trips(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 4)) @ rng.normal(size=(4, 4)) * 10
    fit = spatial.fit_whitening(frames(spark, x), [0, 1, 2, 3], epsilon=1.0, pad=0)
    y = back(spatial.apply_whitening(frames(spark, x), fit))
    off = lambda z: np.abs(np.corrcoef(z.T)[~np.eye(4, dtype=bool)]).mean()
    assert off(y) < 0.3 * off(x)
    assert y == pytest.approx(back(spatial.whiten(frames(spark, x), [0, 1, 2, 3], epsilon=1.0, pad=0)), rel=1e-10, abs=1e-10)
    binary.save_whitening(spark, fit, str(tmp_path / "fit"))
    assert binary.load_whitening(spark, str(tmp_path / "fit")) == fit
    with pytest.raises(ValueError):
        fit.check_filter(30000.0, 300.0, 4000.0, 3)
    with pytest.raises(ValueError):
        fit.row_of(9)


def test_robust_covariance_leaves_a_burst_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    loud = x.copy()
    loud[700:710] += 250
    true = np.cov(x.T)
    gap = lambda robust: np.abs(np.array(spatial.fit_whitening(frames(spark, loud), [0, 1, 2], robust=robust, pad=5).covariance) - true).max()
    assert gap(True) < 0.2 < gap(False)


def test_padding_rejects_neighbours_and_all_rejected_fails(spark):
    x = np.random.default_rng(6).normal(size=(300, 1))
    x[150] = 120
    assert 300 - spatial.clean_samples(frames(spark, x), [0.0], [1.0], 15, 6.0).count() == 31
    with pytest.raises(ValueError, match="clean"):
        spatial.fit_whitening(frames(spark, np.full((50, 2), 1000.0)), [0, 1], pad=0)
    with pytest.raises(ValueError):
        spatial.whitening_matrix(np.eye(2), 0.0)


def test_diagnostics_of_common_mode(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 20, (3000, 1)) + rng.normal(0, 2, (3000, 4))
    d = spatial.diagnostics(frames(spark, x), [0, 1, 2, 3])
    r = d.first()
    assert r["mean_abs_off_diag_corr"] > 0.8 and r["dominant_eigenvalue_fraction"] > 0.6 and abs(r["pc1_median_correlation"]) > 0.9
    line = d.select(spatial.diagnostics_line("raw")).first()[0]
    assert line.startswith("[raw] mean |off-corr|=0.9") and "common-mode" in line
    after = spatial.diagnostics(spatial.common_median_reference(frames(spark, x), [0, 1, 2, 3]), [0, 1, 2, 3]).first()
    assert after["pc1_median_correlation"] is None and after["residual_spatial_median_rms_uv"] < 1e-6


def test_subsample_plan(spark):
    ticks = spark.range(100000).select(F.lit("r").alias("recording_id"), F.col("id").alias("tick"))
    got = [r["tick"] for r in spatial.subsample(ticks, 100000, 3, 1000).orderBy("tick").collect()]
    assert got[0] == 0 and got[-1] >= 99000 and len(got) == 3000


@pytest.mark.parametrize("order", [2, 3])
def test_filter_gain(order):
    sos = signal.bandpass_sections(order=order)
    gain = lambda f: abs(np.prod([np.polyval(s[:3], np.exp(2j * np.pi * f / 30000)) / np.polyval(s[3:], np.exp(2j * np.pi * f / 30000)) for s in sos]))
    assert gain(300) == pytest.approx(2**-0.5, rel=1e-6) and gain(5000) == pytest.approx(2**-0.5, rel=1e-6) and gain(1200) == pytest.approx(1, abs=0.01)
    assert all(abs(np.roots(s[3:])).max() < 1 for s in signal.bandpass_sections(kind="bessel", order=2))
    with pytest.raises(ValueError):
        signal.bandpass_sections(kind="other")


def test_blocks_filter_as_the_whole(spark):
    x = np.random.default_rng(3).normal(size=6000)
    sos = signal.bandpass_sections()
    whole = signal.both_ways(sos, x[None, :])[0]
    f = spark.createDataFrame([("r", t, [float(v)]) for t, v in enumerate(x)], "recording_id string, tick long, uv array<double>")
    got = back(signal.blocks_to_frames(signal.filtered(signal.frames_to_blocks(f, 2000), sos), 2000))[:, 0]
    assert np.abs(got - whole).max() < 1e-6


def test_short_blocks_are_an_error(spark):
    f = spark.createDataFrame([("r", b, 0, [1.0] * 50) for b in range(4)], "recording_id string, block long, channel int, samples array<double>")
    with pytest.raises(Exception, match="shorter than the halo"):
        signal.filtered(f, signal.bandpass_sections()).collect()


def test_filter_is_its_difference_equation():
    x = np.random.default_rng(5).normal(size=(3, 700))
    sos = signal.bandpass_sections(kind="bessel", order=2)
    state = np.random.default_rng(6).normal(size=(len(sos), 2, 3))
    got, end = signal._run(sos, x, state)
    for row in range(3):
        z, y = state[:, :, row].copy(), []
        for v in x[row]:
            for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
                out = b0 * v + z[s, 0]
                z[s] = b1 * v - a1 * out + z[s, 1], b2 * v - a2 * out
                v = out
            y.append(v)
        assert got[row] == pytest.approx(np.array(y), abs=1e-10) and end[:, :, row] == pytest.approx(z, abs=1e-10)


def test_files_are_filtered_where_they_are_read(spark, tmp_path):
    x = np.random.default_rng(4).integers(-3000, 3000, (70_000, 2)).astype("<i2")
    (tmp_path / "v").mkdir()
    (tmp_path / "v/amp.dat").write_bytes(x.tobytes())
    sos = signal.bandpass_sections()
    out = recordings.filtered_voltage(spark, str(tmp_path / "v"), 2, sos)
    whole = signal.both_ways(sos, (x * 0.195).T).T
    assert np.abs(back(out) - whole).max() < 1e-3 and out.count() == len(x)  # samples are read in single precision
    recordings.preprocess_file(spark, str(tmp_path / "v"), str(tmp_path / "w"), 2, [0, 1], "cmr", layout="file")
    assert (tmp_path / "w/amp.dat").stat().st_size == x.nbytes
    recordings.preprocess_file(spark, str(tmp_path / "v"), str(tmp_path / "z"), 2, [0, 1], pad=0)
    assert binary.read_voltage(spark, str(tmp_path / "z"), 2).count() == len(x)
    moved, white = recordings.motion_inputs_of_file(spark, str(tmp_path / "v"), 2, [0, 1])
    assert moved.count() == white.count() == len(x)
    one = x[:4000, 0].copy()
    (tmp_path / "one").mkdir()
    (tmp_path / "one/c.dat").write_bytes(b"header" + one.tobytes())
    recordings.upsample_file(spark, str(tmp_path / "one"), str(tmp_path / "up"), header=6, layout="file")
    got = np.fromfile(tmp_path / "up/c.dat", "<i2")
    y = signal.both_ways(sos, (one * 0.195)[None, :].astype(np.float32).astype(float))[0]
    line = y[0] + (y[-1] - y[0]) / (len(y) - 1) * np.arange(4 * len(y)) / 4
    up = signal.resample_rows((y - line[::4])[None], 4)[0] + line
    assert len(got) == 4 * len(one) and (np.abs(got - np.trunc(up / 0.195)) <= 1).all() and np.mean(got == np.trunc(up / 0.195)) > 0.999


def test_upsampling_follows_the_signal(spark):
    fs, n = 30000, 3000
    tone = lambda t: 10 * np.sin(2 * np.pi * 300 * t) + 5 * np.cos(2 * np.pi * 1000 * t)
    f = spark.createDataFrame([("r", i, [float(v)]) for i, v in enumerate(tone(np.arange(n) / fs))], "recording_id string, tick long, uv array<double>")
    got = back(signal.blocks_to_frames(signal.resampled(signal.frames_to_blocks(f, 500), 4), 2000))[:, 0]
    assert len(got) == 4 * n
    assert np.abs(got - tone(np.arange(4 * n) / (4 * fs)))[1200:-1200].max() < 0.1


def samples_file(folder, name="amp.dat", ticks=5000, channels=3, header=b"", seed=0):
    x = np.random.default_rng(seed).integers(-30000, 30000, (ticks, channels)).astype("<i2")
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(header + x.tobytes())
    return x


def test_binary_round_trip(spark, rows, tmp_path):
    words = np.arange(1000, dtype="<u2") * 61 % 65521
    (tmp_path / "d").mkdir()
    (tmp_path / "d/digitalin.dat").write_bytes(b"head" + words.astype("<u2").tobytes())
    got = binary.read_digital(spark, str(tmp_path / "d"), header=4).orderBy("tick").collect()
    assert [r["word"] for r in got] == words.tolist() and got[0]["recording_id"] == "digitalin.dat"
    x = samples_file(tmp_path / "v")
    f = binary.read_voltage(spark, str(tmp_path / "v"), 3, per_task=6000)
    assert back(f) == pytest.approx(x * 0.195, rel=1e-6) and f.rdd.getNumPartitions() == 5
    # whole and in parts, in order and not, from other bounds than it was written with
    for layout, some, order in (("parts", f, True), ("file", f, True), ("parts", f.repartition(3), False), ("file", f.orderBy(F.desc("tick")), False)):
        out = tmp_path / f"{layout}-{order}"
        binary.write_samples(some, str(out), layout=layout, in_order=order)
        again = binary.read_voltage(spark, str(out), 3, per_task=2000)
        assert (np.rint(back(again) / 0.195).astype("<i2") == x).all()
        assert back(binary.read_voltage(spark, str(out), 3, ticks=[(990, 1011)])) == pytest.approx(x[990:1011] * 0.195, rel=1e-6)
        if layout == "file":
            assert (out / "amp.dat").read_bytes() == x.tobytes() and [p.name for p in out.iterdir()] == ["amp.dat"]
        with pytest.raises(Exception, match="FileExistsError"):
            binary.write_samples(f, str(out), layout=layout)
        binary.write_samples(f.where("tick < 100"), str(out), layout=layout, mode="overwrite")
        assert binary.read_voltage(spark, str(out), 3).count() == 100 and len(list(out.iterdir())) == (1 if layout == "file" else 2)
    with pytest.raises(Exception, match="whole number"):
        binary.read_voltage(spark, str(tmp_path / "v"), 7).collect()
    with pytest.raises(ValueError):
        binary.read_digital(spark, str(tmp_path / "d"), width=4)


def test_several_recordings_at_once(spark, tmp_path):
    a, b = samples_file(tmp_path / "v", "a.dat"), samples_file(tmp_path / "v", "b.dat", 700, seed=1)
    f = binary.read_voltage(spark, str(tmp_path / "v"), 3, per_task=6000)
    one = binary.read_voltage(spark, str(tmp_path / "v"), 3, recording="b.dat")
    assert one.rdd.getNumPartitions() == 1 and back(one) == pytest.approx(b * 0.195, rel=1e-6)
    assert binary.read_voltage(spark, str(tmp_path / "v" / "a*.dat"), 3).count() == 5000
    binary.write_samples(f, str(tmp_path / "w"))
    again = binary.read_voltage(spark, str(tmp_path / "w"), 3)
    for name, x in (("a.dat", a), ("b.dat", b)):
        assert back(again.where(F.col("recording_id") == name)) == pytest.approx(x * 0.195, rel=1e-6)


def test_only_ranges_that_are_asked_for_are_opened(spark, tmp_path):
    """Bytes of the parts that a scan plans and opens, counted."""
    x = samples_file(tmp_path / "v", ticks=100_000)
    opened = []

    class Counted(flat.Recording):
        def read(self, store, first, n):
            got = super().read(store, first, n)
            opened.append(len(got))
            return got

    options = {"path": str(tmp_path / "v"), "channels": "3", "scale": "1", "per_task": "60000"}
    for more, want, n in (({"ticks": "[[25000, 25500]]"}, x[25_000:25_500], 1), ({"segments": "3", "length": "1000"}, np.concatenate([x[:1000], x[49_500:50_500], x[-1000:]]), 3), ({"ticks": "[[99990, 200000]]"}, x[-10:], 1)):
        reader, got = flat.FlatReader(options | more), []
        opened.clear()
        for p in reader.partitions():
            p.recording = Counted(p.recording.name, p.recording.width, p.recording.parts)
            got += [np.stack(b.column("uv").to_numpy(zero_copy_only=False)) for b in reader.read(p)]
        assert (np.concatenate(got) == want).all() and sum(opened) == want.size * 2 and len(reader.partitions()) == n
    f = binary.read_voltage(spark, str(tmp_path / "v"), 3, scale=1.0, per_task=60_000, segments=3, length=1000)
    assert f.rdd.getNumPartitions() == 3 and (back(f) == np.concatenate([x[:1000], x[49_500:50_500], x[-1000:]])).all()
    assert (back(spatial.subsample(binary.read_voltage(spark, str(tmp_path / "v"), 3, scale=1.0), 100_000, 3, 1000)) == back(f)).all()
    assert binary.read_voltage(spark, str(tmp_path / "v"), 3, ticks=[(5, 5)]).count() == 0


def test_filters_and_resampling_where_samples_are_read(spark, tmp_path):
    """Ranges of any size give what the whole gives; no exchange of samples."""
    x = samples_file(tmp_path / "v", ticks=9000, channels=2) * 0.195
    sos = signal.bandpass_sections()
    whole = signal.both_ways(sos, x.T)
    for per_task in (8000, 1 << 20):
        f = binary.read_voltage(spark, str(tmp_path / "v"), 2, sections=sos, per_task=per_task)
        assert np.abs(back(f).T - whole).max() < 1e-3  # of thousands; samples are 32-bit floats before the filter
    line = whole[:, :1] + (whole[:, -1:] - whole[:, :1]) / 8999 * np.arange(9000)
    fine = whole[:, :1] + (whole[:, -1:] - whole[:, :1]) / 8999 * np.arange(36_000) / 4
    want = signal.resample_rows(whole - line, 4) + fine
    for per_task in (7000, 1 << 20):
        f = binary.read_voltage(spark, str(tmp_path / "v"), 2, sections=sos, up=4, per_task=per_task)
        assert "Exchange" not in f._jdf.queryExecution().toString()
        assert np.abs(back(f).T - want).max() < 1e-3
        assert np.abs(back(binary.read_voltage(spark, str(tmp_path / "v"), 2, sections=sos, up=4, ticks=[(12001, 12008)])).T - want[:, 12001:12008]).max() < 1e-3


def test_resampling_by_fractions():
    """Each output sample is the sum over neighbours of their distance's tap."""
    x, (taps, half) = np.random.default_rng(2).standard_normal(60), signal._sinc(3, 2, 5.0)
    plain = [sum(x[i] * taps[m * 2 - 3 * i + half] for i in range(60) if 0 <= m * 2 - 3 * i + half < len(taps)) for m in range(90)]
    assert np.allclose(signal.resample_rows(x[None], 3, 2)[0], plain)


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    samples_file(tmp_path / "v", ticks=3000)
    f = binary.read_voltage(spark, str(tmp_path / "v"), 3, per_task=6000)
    late = lambda bad: f.withColumn("uv", F.when(F.col("tick") == 2900, bad).otherwise(F.col("uv")))
    wrong = {
        "gaps or repeat": f.where("tick != 1500"), "repeat": f.unionByName(f.where("tick < 10")), "finite": late(F.array(F.lit(0.0), F.lit(float("nan")), F.lit(0.0)).cast("array<float>")),
        "null": late(F.lit(None)), "differ": late(F.array(F.lit(0.0)).cast("array<float>")), "sample is null": late(F.array(F.lit(0.0), F.lit(None), F.lit(1.0)).cast("array<float>")),
    }
    for layout in ("parts", "file"):
        for i, (message, some) in enumerate(wrong.items()):
            out = tmp_path / f"{layout}{i}"
            with pytest.raises(Exception, match=message):
                binary.write_samples(some, str(out), layout=layout)
            assert not out.exists()


def test_frames_in_no_order_are_refused(tmp_path):
    n = flat.MOST_RUNS + 1
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * n), pa.array(np.arange(n) * 2), pa.array([[0.0]] * n)], ["recording_id", "tick", "uv"])
    with pytest.raises(ValueError, match="out of order"):
        flat.FlatWriter({"path": str(tmp_path / "w"), "bit_depth": "1", "layout": "file"}, False).write(iter([batch]))


def test_a_task_that_fails_once_is_written_once(spark, tmp_path):
    """Runs of an attempt that died, and of one that ran twice, are no part of the recording."""
    x = samples_file(tmp_path / "v", ticks=300)
    batches = list(flat.FlatReader({"path": str(tmp_path / "v"), "channels": "3", "scale": "1"}).read(flat.TickRange(flat.recordings(str(tmp_path / "v"), 6)[0], 0, 300)))
    for layout in ("parts", "file"):
        w = flat.FlatWriter({"path": str(tmp_path / layout), "bit_depth": "1", "layout": layout}, False)

        def dies():
            yield from batches
            raise RuntimeError("lost")

        with pytest.raises(RuntimeError):
            w.write(dies())
        w.write(iter(batches))
        w.commit([w.write(iter(batches)), None])
        assert np.frombuffer(b"".join(r.read(flat.store_of(str(tmp_path / layout))[0], 0, 300) for r in flat.recordings(str(tmp_path / layout), 6)), "<i2").tobytes() == x.tobytes()
        assert sum(len(list(p.iterdir())) for p in (tmp_path / layout).iterdir() if p.is_dir()) == (1 if layout == "parts" else 0)


def test_sample_overflow(spark):
    df = spark.createDataFrame([(40000.0,), (2.5,), (-40000.0,)], "v double")
    got = df.select(C.quantised(F.col("v"), 1.0), C.quantised(F.col("v"), 1.0, overflow="wrap"), C.quantised(F.col("v"), 1.0, "truncate")).collect()
    assert [tuple(r) for r in got] == [(32767, -25536, 32767), (2, 2, 2), (-32768, 25536, -32768)]


def test_sorter_table(spark, rows, tmp_path):
    (tmp_path / "s.csv").write_text("made by x\ntime,unit,channel\n0.0021,2,7\n0.5,1,3\n0.6,2,7\n0.7,2,5\n0.8,1,2\n")
    s = binary.read_spike_csv(spark, str(tmp_path / "s.csv"), 30000)
    assert rows(s, "unit_id", "channel", "tick")[0] == (1, 2, 24000)
    assert rows(binary.unit_trains(s)) == [(1, [15000, 24000]), (2, [62, 18000, 21000])] or rows(binary.unit_trains(s))[1][1][0] == 62
    assert rows(binary.best_channels(s)) == [(1, 2), (2, 7)]


def test_probes(spark):
    for name, columns in (("Poly2", 2), ("poly3", 3)):
        df = probe_contacts(spark, name)
        assert df.count() == 32 and df.select("x_um").distinct().count() == columns
        assert sorted(r["device_channel"] for r in df.collect()) == list(range(32))
    with pytest.raises(ValueError):
        probe_contacts(spark, "other")


def test_pairs(spark):
    nan = float("nan")
    df = spark.createDataFrame([(10.0, 14.0), (0.0, 5.0), (5.0, 0.0), (nan, 8.0)], "x double, y double")
    assert [r["log2_ratio"] for r in plotdata.ratios(df).collect()] == pytest.approx([math.log2(1.4)])
    assert [r[0] for r in df.select(C.positive_finite(F.col("x"), F.col("y"))).collect()] == [True, False, False, False]


def test_layout_helpers():
    assert plotdata.grid_ratios(10, 10, 0.22, 0.22) == pytest.approx((0.22, 1.0, 1.0, 0.22))
    assert plotdata.grid_ratios(5, 20, 0.22, 0.22) == pytest.approx((0.055, 1.0, 1.0, 0.88))
    assert plotdata.diagonal_anchor((0, 20, 0, 30), True) == 10.0 and plotdata.diagonal_anchor((0, 1, 2, 3), True) is None
    assert plotdata.linspace(-2, 2, 10)[0] == -2 and len(plotdata.linspace(-2, 2, 10)) == 11
    assert plotdata.tick_label(2.0) == "2" and plotdata.tick_label(0.5) == "0.5"
    assert plotdata.microvolts_per_unit(-1, 2) == 1000.0
    assert plotdata.inset_bar_corners(1, 2, 5, 3)[0] == (4.5, 5.5)


def test_covariance_far_from_zero(spark):
    x = np.random.default_rng(1).standard_normal((400, 3))
    for offset in (0.0, 1e6):
        frames = spark.createDataFrame([("r", i, [float(v) for v in r]) for i, r in enumerate(x + offset)], "recording_id string, tick long, uv array<double>")
        assert np.allclose(spatial.covariance(frames, 1), np.cov(x.T), rtol=1e-8, atol=1e-9)


def test_middle_run_of_a_subsample(spark):
    got = [r["tick"] for r in spatial.subsample(spark.range(100).select(F.col("id").alias("tick")), 100, 3, 11).orderBy("tick").collect()]
    assert got == [*range(11), *range(45, 56), *range(89, 100)]


def test_reversed_intervals_are_an_error(spark):
    points, spans = spark.createDataFrame([(5,)], "t long"), spark.createDataFrame([(0, 9, 1)], "i long, lo long, hi long")
    with pytest.raises(Exception, match="ends before it starts"):
        intervals.counted_in(points, spans, "t", "lo", "hi", ["i"], 4.0).collect()


def test_unknown_bases_are_an_error(spark):
    for wrong in (dict(kind="foo"), dict(n_leads=2, n_lead_cols=0, lead=1.0), dict(n_lead_cols=2)):
        with pytest.raises(ValueError):
            series.basis(spark, 6, 2, **wrong)
    with pytest.raises(ValueError):
        series.lag_knots(6, 2, 0.1, kind="foo")
    split = series.split_basis(spark, 2, 6, 2, 2, "raised_cosine", lead=1.0)
    assert sorted(split.collect()) == sorted(series.basis(spark, 6, 2, "raised_cosine", 2, 2, 1.0).collect())
    assert plotdata.inset_default_height(5.0, 40) == pytest.approx(0.85)


def test_numbers_over_blocks(spark):
    rows = spark.range(1000).selectExpr("id * 7 as t", "id % 2 as k")
    got = intervals.numbered(rows, "t", ["k"], block=64).collect()
    assert all(r["n"] == r["t"] // 14 + 1 for r in got)


def test_pulses_have_no_single_task(spark):
    rows = spark.createDataFrame([(1, 1), (5, -1), (9, 1), (12, -1)], "tick long, direction int")
    for mode in ("causal", "reference"):
        assert sorted(tuple(r) for r in ttl.pulses(rows, mode=mode).collect()) == [(1, 5), (9, 12)]


def plain_walk(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("block", [None, 7, 40, 500])
def test_thinning_of_one_dense_island(spark, block):
    """A recording without any gap, and sparse and empty stretches of another; in blocks narrower and wider than the window."""
    rng = np.random.default_rng(3)
    dense = np.cumsum(rng.integers(1, 4, 3000)).tolist()
    rows = {"dense": dense, "sparse": (rng.integers(0, 60, 40) * 100).tolist(), "one": [5], "few": [1, 2, 3]}
    e = spark.createDataFrame([(k, t) for k, ts in rows.items() for t in ts], "r string, tick long").repartition(4)
    got = intervals.thinned(e, "tick", 10, ["r"], block)
    by = {}
    for r in got.collect():
        by.setdefault(r["r"], []).append(r["tick"])
    assert {k: sorted(v) for k, v in by.items()} == {k: plain_walk(ts, 20) for k, ts in rows.items()}
    if block is None:  # the dense one is nearly all rows, so nearly all tasks
        assert [k for k, _ in intervals.busy_keys(e, "tick", ["r"])] == ["dense"] and len(intervals.busy_keys(e, "tick", ["r"])[0][1]) == 3
    assert intervals.thinned(e.limit(0), "tick", 10, ["r"], block).count() == 0


@pytest.mark.parametrize("unit", [1, 1_000_000])
def test_blocks_follow_the_rows(spark, unit):
    """A key with half of all rows takes half of the tasks, whatever ticks count and wherever rows crowd; others are one block each."""
    crowd = [(0, int(unit * (i if i < 100 else 100 + i / 1000))) for i in range(4000)]
    rows = spark.createDataFrame(crowd + [(1 + i % 50, i * unit) for i in range(4000)], "k int, t long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        cut = intervals.blocks(rows, "t", ["k"]).groupBy("k", "_block").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    busy = [r["count"] for r in cut if r["k"] == 0]
    if unit > 1:
        assert len(busy) == 8 and max(busy) < 2 * 4000 / 8
    assert len(cut) - len(busy) == 50


@pytest.mark.parametrize("block", [None, 50])
def test_rows_before_over_blocks(spark, block):
    rng = np.random.default_rng(1)
    rows = [("a", int(t)) for t in rng.choice(100_000, 500, replace=False)] + [("b", 3), ("b", 9), ("c", 4), (None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "k string, t long").repartition(3)
    got = intervals.with_previous(df, F.col("t"), "t", ["k"], block, second="earlier").collect()
    for k in ("a", "b", "c", None):
        t = sorted(x for key, x in rows if key == k)
        want = {(x, t[i - 1] if i else None, t[i - 2] if i > 1 else None) for i, x in enumerate(t)}
        assert {(r["t"], r["previous"], r["earlier"]) for r in got if r["k"] == k} == want


def test_no_window_takes_a_busy_unit_whole(spark):
    """Intervals of a unit that is nearly all rows, with ties in time, against plain differences."""
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(0, 3000, 2000)) / 10.0
    df = spark.createDataFrame([(1, float(x)) for x in t] + [(2, 1.0), (2, 4.0), (3, float("nan"))], "unit_id int, t double").repartition(5)
    got = trials.spike_intervals(df, "t", ["unit_id"])
    assert sorted(r["isi"] for r in got.where("unit_id = 1").collect()) == pytest.approx(sorted(np.diff(t)))
    assert [r["isi"] for r in got.where("unit_id = 2").collect()] == [3.0]
    a, b = np.diff(t)[:-1], np.diff(t)[1:]
    ok = a + b > 0
    want = sorted(2 * np.abs(b - a)[ok] / (a + b)[ok])
    assert sorted(r["cv2"] for r in trials.interval_variability(df, "t", ["unit_id"]).collect()) == pytest.approx(want)


def test_the_median_is_sorted_once_a_frame(spark):
    """No sort and no choice of channels below the lambda over a frame's channels."""
    frames = spark.range(3).selectExpr("'r' as recording_id", "id as tick", "transform(sequence(1, 6), k -> k * 1.0d + id) as uv")
    for target in ("good", "all"):
        plan = spatial.common_median_reference(frames, [0, 2, 5], target)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sort_array") == 1 and "sort_array" not in plan[plan.rindex("transform(uv") :]


@pytest.mark.parametrize("sizes", [[250] * 24, [6000], [30, 25, 3000, 40, 1, 2000, 22, 35], [5, 4]])
def test_filters_with_low_corners_over_short_blocks(spark, sizes):
    """A corner of 1 Hz at 30 kHz remembers far more than a block."""
    sos = signal.bandpass_sections(1.0, 5000.0)
    n = sum(sizes)
    assert signal.halo_samples(sos) > 10 * max(sizes)
    x = np.cumsum(np.random.default_rng(5).standard_normal((2, n)), axis=1)
    edges = np.cumsum([0, *sizes])
    rows = [("r", c, b, [float(v) for v in x[c, edges[b] : edges[b + 1]]]) for c in range(2) for b in range(len(sizes))]
    blocks = spark.createDataFrame(rows, "recording_id string, channel int, block long, samples array<double>").repartition(3)
    got = {(r["channel"], r["block"]): r["samples"] for r in signal.filtered_exactly(blocks, sos).collect()}
    want = signal.both_ways(sos, x)
    for c in range(2):
        y = np.concatenate([got[c, b] for b in range(len(sizes))])
        assert np.abs(y - want[c]).max() < 1e-6 * max(1.0, np.abs(want).max())


@pytest.mark.parametrize("forward", [True, False])
def test_states_of_blocks_are_scanned_in_levels(spark, monkeypatch, forward):
    """Several levels of the scan, against states passed from block to block; and no round squares the size that the driver plans with."""
    monkeypatch.setattr(signal, "FAN", 3, raising=False)
    sos, rng = signal.bandpass_sections(), np.random.default_rng(8)
    n, left = rng.integers(1, 9, 41), rng.standard_normal((41, 6))
    rows = [("r", c, b, int(n[b]), [float(v) * (c + 1) for v in left[b]]) for c in range(2) for b in range(41)]
    ends = spark.createDataFrame(rows, "recording_id string, channel int, block long, n long, left array<double>").repartition(3)
    states = signal._starts(ends, sos, forward)
    assert states._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
    got = {(r["channel"], r["block"]): r["state"] for r in states.collect()}
    turn, z = signal._turn(sos), np.zeros(6)
    for b in range(41) if forward else range(40, -1, -1):
        if z.any():
            assert got[0, b] == pytest.approx(list(z)) and got[1, b] == pytest.approx(list(2 * z))
        z = np.linalg.matrix_power(turn, int(n[b])) @ z + left[b]


def test_percentiles_without_a_group_in_one_task(spark):
    """Exact, with ties, a null key, groups of one and of nothing; a group's values are no aggregation buffer."""
    from neurolake.operators import plotdata

    rng = np.random.default_rng(9)
    values = {"a": rng.standard_normal(3001), "b": rng.integers(0, 4, 500) * 1.0, None: np.array([5.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for accuracy in (10_000, 40):
        got = {r["k"]: r["q"] for r in plotdata.percentiles(df, "v", ["k"], [0.025, 0.5, 0.975, 1.0], accuracy).collect()}
        assert got == {r["k"]: r["q"] for r in df.where("v is not null").groupBy("k").agg(F.expr("percentile(v, array(0.025d, 0.5d, 0.975d, 1.0d))").alias("q")).collect()}
    plan = plotdata.forest(df, "v", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_medians_by_radix(spark):
    """Equal to exact percentiles: even and odd numbers, ties, negative and equal values, zeros of both signs, infinities; any partitioning."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 400):
        x = np.stack([rng.standard_normal(n) * 1e-3, rng.integers(-3, 3, n) * 1.0, np.full(n, -7.25), np.where(rng.random(n) < 0.5, 0.0, -0.0), rng.standard_normal(n) * 1e300, np.where(np.arange(n) % 3 == 0, np.inf, 1 + np.arange(n) * 1e-15)], axis=1)
        f = spark.createDataFrame([("r", i, [float(v) for v in r]) for i, r in enumerate(x)], "recording_id string, tick long, uv array<double>").repartition(3)
        med = spatial.exact_medians(f)
        assert med == [float(np.median(x[:, c])) for c in range(6)]
        assert spatial.exact_medians(f.select(*["recording_id", "tick"], F.slice("uv", 1, 4).alias("uv")), med[:4]) == [float(np.median(np.abs(x[:, c] - med[c]))) for c in range(4)]
    assert spatial.exact_medians(f.limit(0)) == [] and spatial.channel_deviations(f.limit(0)).count() == 0
    # what a task holds: digits, not values
    many = spark.range(20_000).selectExpr("'r' as recording_id", "id as tick", "array(1.0 + id * 1e-9) as uv")
    assert spatial._counted(many, {}, 48, None).count() == 1


def test_wrong_frames_are_an_error_of_the_fit(spark):
    rows = [("r", i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(100)]
    kind = "recording_id string, tick long, uv array<double>"
    assert spatial.fit_whitening(spark.createDataFrame(rows, kind), [0, 2], pad=0).good_channels == [0, 2]
    for bad, message in ((("r", 100, None), "1 frames are null"), (("r", 100, [1.0, 2.0]), "2 to 3 samples"), (("r", 100, [1.0, None, 3.0]), "1 hold null"), (("r", 100, [1.0, float("inf"), 3.0]), "1 hold null or non-finite")):
        with pytest.raises(ValueError, match=message):
            spatial.fit_whitening(spark.createDataFrame([*rows, bad], kind), [0, 2], pad=0)
    with pytest.raises(ValueError, match="channel 3"):
        spatial.fit_whitening(spark.createDataFrame(rows, kind), [0, 3], pad=0)
    with pytest.raises(TypeError):
        spatial.fit_whitening(spark.createDataFrame([("r", 0, [1, 2])], "recording_id string, tick long, uv array<int>"), [0], pad=0)
    with pytest.raises(ValueError):
        spatial.fit_whitening(spark.createDataFrame([], kind), [0], pad=0)


def test_basis_options_are_checked_as_one(spark):
    o = series.BasisOptions(6, 2, n_leads=2, n_lead_cols=2, lead=1.0)
    assert sorted(o.rows(spark).collect()) == sorted(series.basis(spark, 6, 2, "raised_cosine", 2, 2, 1.0).collect())
    assert o.centres(0.5) == series.knot_centres(6, 2, 0.5, 2, 1.0) == [-1.0, -0.5, 0.0, 3.0]
    for wrong in (dict(n_lags=0), dict(n_cols=0), dict(kind="foo"), dict(n_leads=2), dict(n_lead_cols=1), dict(n_leads=2, n_lead_cols=1), dict(offset=float("nan")), dict(n_leads=-1)):
        with pytest.raises(ValueError):
            series.BasisOptions(**(dict(n_lags=6, n_cols=2) | wrong))
    with pytest.raises(TypeError):
        series.BasisOptions(6.0, 2)


def test_frames_turned_to_blocks_and_back(spark):
    """In any order and partitioning, with gaps and several recordings; what is shuffled are runs."""
    rng = np.random.default_rng(8)
    rows = [(f"r{k}", t, [float(v) for v in rng.standard_normal(3)]) for k in range(2) for t in range(250)]
    f = spark.createDataFrame(rows, "recording_id string, tick long, uv array<double>")
    for some in (f, f.repartition(5), f.orderBy(F.rand(1))):
        blocks = signal.frames_to_blocks(some, 100)
        got = {(r["recording_id"], r["channel"], r["block"]): r["samples"] for r in blocks.collect()}
        assert len(got) == 18 and len(got["r1", 2, 2]) == 50
        assert got["r0", 1, 1] == [uv[1] for k, t, uv in rows if k == "r0" and 100 <= t < 200]
        assert sorted((r["recording_id"], r["tick"], r["uv"]) for r in signal.blocks_to_frames(blocks, 100).collect()) == sorted(rows)
