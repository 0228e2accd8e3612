"""The registered queries of the recording operators, each with the SQL of its rows where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neurolake.functions import columns as C
from neurolake.operators import intervals, plotdata, series, signal, spatial, trials, ttl
from neurolake.plans import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            own = not sql.lstrip().startswith("select")  # it goes on with subqueries of its own
            ORACLES[f.__name__] = f"with recursive {T.SQL}{',' if own else ''} {sql}"
        return f

    return add


# Histograms about events


@query("""select h.unit_id, h.bin, cast(sum("count") as bigint) as cnt, sum("count") / count(*) as p from hist h group by 1, 2 having sum("count") > 0""")
def psth_counts(spark, d):
    """Sparse histogram: what is counted is only grouped by bin, trials come in by their number."""
    rel = T.relative(spark, d).withColumn("bin", trials.bin_of(F.col("rel_s"), T.EDGES)).where("bin is not null")
    n = T.trial_rows(spark, d).groupBy("unit_id").agg(F.count("*").alias("n"))
    counts = rel.groupBy("unit_id", "bin").agg(F.count("*").alias("cnt")).join(n, "unit_id")
    return counts.select("unit_id", "bin", "cnt", (F.col("cnt") / F.col("n")).alias("p"))


@query("""select unit_id, trial_id, bin, "count" from hist""")
def histogram_dense(spark, d):
    return T.histograms(spark, d)


@query("""select unit_id, bin, sum("count") / count(*) as p from hist group by 1, 2""")
def psth_dense(spark, d):
    return trials.mean_histogram(T.histograms(spark, d))


@query("""m as (select unit_id, bin, sum("count") / count(*) as p from hist group by 1, 2),
pk as (select unit_id, arg_max(bin, p * 1000 - bin * 1e-9) as bin from m group by 1)
select unit_id, -21600e0 + 1800 * bin + 900 as peak_s, row_number() over (order by bin, unit_id) - 1 as place from pk""")
def psth_peak_order(spark, d):
    peaks = trials.peak_bins(trials.mean_histogram(T.histograms(spark, d)), T.EDGES)
    # one row a unit, so one task can number them
    return peaks.withColumn("place", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("peak_s", "unit_id")) - 1).cast("long"))


@query("""select unit_id, bin, cast(count(*) as bigint) as n, sum("count") / count(*) / 1800 as rate from hist group by 1, 2""")
def spike_rate(spark, d):
    return trials.spike_rate(T.histograms(spark, d), trials.bins(spark, T.EDGES))


@query("""cut as (select unit_id, trial_id, value * 100 as cutoff_s from tr),
alive as (select unit_id, bin, count(*) as n from cut join bins on cutoff_s >= lo group by 1, 2)
select h.unit_id, h.bin, coalesce(a.n, 0) as n, sum("count") / a.n / 1800 as rate from hist h left join alive a using (unit_id, bin) group by h.unit_id, h.bin, a.n""")
def spike_rate_survivors(spark, d):
    cut = T.trial_rows(spark, d).select("unit_id", "trial_id", (F.col("value") * 100).alias("cutoff_s"))
    return trials.spike_rate(T.histograms(spark, d), trials.bins(spark, T.EDGES), cut)


@query("""w as (select k, exp(-0.5 * k * k / 4.0) as w from range(-8, 9) as t(k)),
s as (select h.unit_id, h.trial_id, h.bin, sum(w * g."count") / (select sum(w) from w) as smooth
      from hist h, w, hist g where g.unit_id = h.unit_id and g.trial_id = h.trial_id
      and g.bin = case when (h.bin + k + 48) % 48 < 24 then (h.bin + k + 48) % 48 else 47 - (h.bin + k + 48) % 48 end group by 1, 2, 3)
select unit_id, trial_id, bin, round(smooth, 9) as smooth from s""")
def histogram_smoothed(spark, d):
    out = trials.smoothed(T.histograms(spark, d), trials.TRIAL, "count", len(T.EDGES) - 1, 2.0)
    return out.withColumn("smooth", F.round("smooth", 9))


@query("""c as (select tr.unit_id, tr.trial_id, count(rel_s) as c from tr left join rel on rel.unit_id = tr.unit_id and rel.trial_id = tr.trial_id and rel_s >= 0 and rel_s <= 20000 group by 1, 2)
select unit_id, avg(case when c > 1 then 1e0 else 0e0 end) as fraction from c group by 1""")
def burst_fraction(spark, d):
    return trials.burst_fraction(T.relative(spark, d), T.trial_rows(spark, d), 0.0, 20000.0)


@query("""nt as (select unit_id, trial_id, row_number() over (partition by unit_id order by trial_id) - 1 as i, count(*) over (partition by unit_id) as n from tr),
nu as (select distinct unit_id, n from nt),
wd as (select unit_id, n, rep, g, md5('7:' || unit_id || ':' || rep || ':' || g) as h from nu, range(10000) as r(rep), range((n + 3) // 4) as t(g)),
dr as (select unit_id, n, rep, cast('0x' || substr(h, 8 * w + 1, 8) as bigint) % n as i from wd, range(4) as t(w) where 4 * g + w < n),
dc as (select unit_id, n, rep, i, count(*) as drawn from dr group by 1, 2, 3, 4),
sm as (select dc.unit_id, rep, h.bin, sum(drawn * h."count") as total from dc join nt using (unit_id, i) join hist h on h.unit_id = dc.unit_id and h.trial_id = nt.trial_id and h."count" > 0 group by 1, 2, 3),
al as (select nu.unit_id, nu.n, b.bin, coalesce(total, 0) as total, count(*) as times from nu cross join range(10000) as r(rep) cross join bins b left join sm on sm.unit_id = nu.unit_id and sm.rep = r.rep and sm.bin = b.bin group by 1, 2, 3, 4),
cm as (select *, sum(times) over (partition by unit_id, bin order by total) as upto from al),
qt as (select unit_id, n, bin, min(total) filter (upto > 249) as a0, min(total) filter (upto > 250) as a1, min(total) filter (upto > 9749) as b0, min(total) filter (upto > 9750) as b1 from cm group by 1, 2, 3)
select unit_id, bin, round((a0 + (a1 - a0) * 0.975e0) / n / 1800, 12) as low, round((b0 + (b1 - b0) * 0.025e0) / n / 1800, 12) as high from qt""")
def bootstrap_ci(spark, d):
    out = trials.bootstrap_interval(T.histograms(spark, d), T.trial_rows(spark, d), 1800.0, 10_000, 95.0, 7)
    return out.select("unit_id", "bin", F.round("low", 12).alias("low"), F.round("high", 12).alias("high"))


# Intervals between spikes


@query("""i as (select unit_id, tick / 1e6 as t, tick / 1e6 - lag(tick / 1e6) over (partition by unit_id order by tick) as isi from sp)
select unit_id, t, isi from i where isi is not null""")
def isi(spark, d):
    times = T.spikes(spark, d).select("unit_id", (F.col("tick") / T.FS).alias("t"))
    return trials.spike_intervals(times, "t", ["unit_id"])


@query("""i as (select unit_id, tick / 1e6 as t, tick / 1e6 - lag(tick / 1e6) over w as b, lag(tick / 1e6) over w - lag(tick / 1e6, 2) over w as a from sp window w as (partition by unit_id order by tick))
select unit_id, t, 2 * abs(b - a) / (a + b) as cv2 from i where a + b > 0""")
def cv2(spark, d):
    times = T.spikes(spark, d).select("unit_id", (F.col("tick") / T.FS).alias("t"))
    return trials.interval_variability(times, "t", ["unit_id"])


@query("""i as (select unit_id, trial_id, rel_s - lag(rel_s) over w as b, lag(rel_s) over w - lag(rel_s, 2) over w as a from rel window w as (partition by unit_id, trial_id order by rel_s)),
c as (select unit_id, trial_id, count(*) as n, avg(2 * abs(b - a) / (a + b)) as m from i where a + b > 0 group by 1, 2)
select tr.unit_id, tr.trial_id, coalesce(n, 0) as n, round(m, 9) as mean_cv2 from tr left join c using (unit_id, trial_id)""")
def cv2_by_trial(spark, d):
    each = trials.interval_variability(T.relative(spark, d), "rel_s", trials.TRIAL).groupBy(*trials.TRIAL).agg(F.count("*").alias("n"), F.avg("cv2").alias("m"))
    out = T.trial_rows(spark, d).select(*trials.TRIAL).join(each, trials.TRIAL, "left")
    return out.select(*trials.TRIAL, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round("m", 9).alias("mean_cv2"))


# Digital lines


@query("select tick, cast(hi as integer) as hi from hi")
def ttl_line(spark, d):
    return ttl.line_states(T.words(spark, d), 4).select("tick", "hi")


@query("select sum(hi) <= count(*) - sum(hi) as rests_low from hi")
def ttl_polarity(spark, d):
    states = ttl.line_states(T.words(spark, d), 4).withColumn("recording_id", F.lit(0))
    return ttl.rests_low(states, ["recording_id"]).select("rests_low")


EDGE_SQL = "e as (select tick, hi - lag(hi) over (order by tick) as direction from hi)"


@query(f"{EDGE_SQL} select tick, cast(direction as integer) as direction from e where direction != 0")
def ttl_edges(spark, d):
    return ttl.edges(ttl.line_states(T.words(spark, d), 4))


@query(f"""{EDGE_SQL}, p as (select tick as onset_tick, lead(tick) over (order by tick) as offset_tick, direction, lead(direction) over (order by tick) as nx from e where direction != 0)
select onset_tick, offset_tick from p where direction = 1 and nx = -1""")
def ttl_pairs_causal(spark, d):
    return ttl.pulses(ttl.edges(ttl.line_states(T.words(spark, d), 4)))


@query(f"""{EDGE_SQL}, n as (select count(*) filter (direction = 1) as a, count(*) filter (direction = -1) as b from e),
u as (select tick, row_number() over (order by tick) - (select case when a > b then 1 else 0 end from n) as i from e where direction = 1),
f as (select tick, row_number() over (order by tick) as i from e where direction = -1)
select u.tick as onset_tick, f.tick as offset_tick from u join f using (i)""")
def ttl_pairs_by_position(spark, d):
    return ttl.pulses(ttl.edges(ttl.line_states(T.words(spark, d), 4)), mode="reference")


@query(f"""{EDGE_SQL}, p as (select tick as onset_tick, lead(tick) over (order by tick) as offset_tick, direction, lead(direction) over (order by tick) as nx from e where direction != 0),
r as (select case when sum(hi) <= count(*) - sum(hi) then 1 else -1 end as s from hi)
select onset_tick, offset_tick from p, r where direction = s and nx = -s""")
def ttl_pulses(spark, d):
    return ttl.line_pulses(T.words(spark, d), 4)


@query("""c as (select tr.unit_id, tr.trial_id, sp.tick, row_number() over (partition by tr.unit_id, tr.trial_id order by abs(sp.tick - event_tick), sp.tick) as r from tr left join sp using (unit_id))
select unit_id, trial_id, tick as near from c where r = 1""")
def ttl_nearest(spark, d):
    found = intervals.nearest(T.trial_rows(spark, d).select("unit_id", "trial_id", "event_tick"), T.spikes(spark, d), "event_tick", "tick", ["unit_id"])
    return found.select("unit_id", "trial_id", "near")


# Spikes in windows

HOUR = 3_600_000_000


def _intervals(spark, d):
    """From each view, as many minutes as its value."""
    v = T.events(spark, d).where("event_type = 'view'")
    return v.select("unit_id", F.col("event_id").alias("interval_id"), F.col("tick").alias("onset"), (F.col("tick") + F.floor("value").cast("long") * 60_000_000).alias("offset"))


INTERVAL_SQL = "iv as (select unit_id, event_id as interval_id, tick as onset, tick + cast(floor(value) as bigint) * 60000000 as \"offset\" from ev where event_type = 'view')"


@query(f"""{INTERVAL_SQL} select iv.unit_id, interval_id, count(sp.tick) as n from iv left join sp on sp.unit_id = iv.unit_id and sp.tick >= onset and sp.tick <= "offset" group by 1, 2""")
def interval_counts_closed(spark, d):
    out = intervals.counted_in(T.spikes(spark, d), _intervals(spark, d), "tick", "onset", "offset", ["unit_id", "interval_id"], HOUR, ["unit_id"], "both")
    return out.select("unit_id", "interval_id", "n")


@query(f"""{INTERVAL_SQL} select iv.unit_id, interval_id, count(sp.tick) as n from iv left join sp on sp.unit_id = iv.unit_id and sp.tick >= onset and sp.tick < "offset" group by 1, 2""")
def interval_counts_halfopen(spark, d):
    out = intervals.counted_in(T.spikes(spark, d), _intervals(spark, d), "tick", "onset", "offset", ["unit_id", "interval_id"], HOUR, ["unit_id"], "left")
    return out.select("unit_id", "interval_id", "n")


@query(f"""{INTERVAL_SQL}, c as (select iv.unit_id, interval_id, onset, "offset", count(sp.tick) as n from iv left join sp on sp.unit_id = iv.unit_id and sp.tick >= onset and sp.tick <= "offset" where "offset" > onset group by 1, 2, 3, 4)
select unit_id, interval_id, n * 1e6 / ("offset" - onset) as rate_hz from c""")
def interval_rate(spark, d):
    longer = _intervals(spark, d).where("offset > onset")
    out = intervals.counted_in(T.spikes(spark, d), longer, "tick", "onset", "offset", ["unit_id", "interval_id"], HOUR, ["unit_id"], "both")
    return out.select("unit_id", "interval_id", C.rate_hz(F.col("n"), F.col("offset") - F.col("onset"), T.FS).alias("rate_hz"))


WEEK = (1_704_067_200_000_000, 1_704_672_000_000_000)


@query(f"select unit_id, count(*) as n from sp where tick >= {WEEK[0]} and tick <= {WEEK[1]} group by 1")
def window_count(spark, d):
    return T.spikes(spark, d).where(F.col("tick").between(*WEEK)).groupBy("unit_id").agg(F.count("*").alias("n"))


@query("""select tr.unit_id, trial_id, sp.tick / 1e6 - event_tick / 1e6 as rel_s from tr join sp on tr.unit_id = sp.unit_id and sp.tick > event_tick - 21600000000 and sp.tick < event_tick + 21600000000""")
def aligned_open(spark, d):
    return T.relative(spark, d, "neither").select("unit_id", "trial_id", "rel_s")


@query("select unit_id, trial_id, rel_s from rel")
def aligned_halfopen(spark, d):
    return T.relative(spark, d).select("unit_id", "trial_id", "rel_s")


@query("select event_id, cast(round_even(value * 30.5, 0) as bigint) as rounded, cast(trunc(value * 30.5) as bigint) as cut from ev")
def ticks_from_seconds(spark, d):
    e = T.events(spark, d)
    return e.select("event_id", C.ticks_from_seconds(F.col("value"), 30.5).alias("rounded"), C.ticks_from_seconds(F.col("value"), 30.5, "truncate").alias("cut"))


@query("""k as (select unit_id, min(event_tick) as tick from tr group by 1
union all select k.unit_id, (select min(event_tick) from tr where tr.unit_id = k.unit_id and tr.event_tick >= k.tick + 172800000000) as tick from k where k.tick is not null)
select unit_id, tick from k where tick is not null""")
def greedy_thin(spark, d):
    rows = T.trial_rows(spark, d).select("unit_id", F.col("event_tick").alias("tick"))
    return intervals.thinned(rows, "tick", 86_400_000_000, ["unit_id"])


@query("select rel.unit_id, rel.trial_id, rel_s from rel join tr using (unit_id, trial_id) where rel_s < value * 100")
def before_cutoff(spark, d):
    cut = T.trial_rows(spark, d).select("unit_id", "trial_id", (F.col("value") * 100).alias("cutoff_s"))
    return trials.before_cutoff(T.relative(spark, d), cut).select("unit_id", "trial_id", "rel_s")


@query("""b as (select distinct unit_id, floor(tick / 3600000000.0)::bigint * 3600000000 as start from ev)
select b.unit_id, b.start, cast(count(sp.tick) as double) as x from b left join sp on sp.unit_id = b.unit_id and sp.tick >= start and sp.tick < start + 5400000000 group by 1, 2""")
def event_impulses(spark, d):
    bins = T.events(spark, d).select("unit_id", (F.floor(F.col("tick") / HOUR) * HOUR).alias("start")).distinct()
    return series.impulses(bins, T.spikes(spark, d), "tick", 5_400_000_000, ["unit_id"])


@query("""s as (select unit_id, tick, value from ev where event_type = 'view'), f as (select unit_id, arg_min(value, tick) as v0 from s group by 1)
select sp.unit_id, sp.tick, coalesce(s.value, f.v0) as value from sp asof left join s on sp.unit_id = s.unit_id and sp.tick >= s.tick left join f on f.unit_id = sp.unit_id""")
def sample_hold(spark, d):
    samples = T.events(spark, d).where("event_type = 'view'").select("unit_id", "tick", "value")
    return series.sample_hold(T.spikes(spark, d), samples, "tick", "tick", "value", ["unit_id"])


# Orders of trials


def _keys(spark, d):
    return trials.trial_keys(T.relative(spark, d), T.trial_rows(spark, d))


def _place(order: str) -> str:
    return f"select unit_id, trial_id, row_number() over (partition by unit_id order by {order}) - 1 as place from keyed"


@query(_place("positive_s, trial_id"))
def order_first_positive(spark, d):
    return trials.order_by_first_positive(_keys(spark, d)).select("unit_id", "trial_id", "place")


@query(_place("first_s, trial_id"))
def order_first_spike(spark, d):
    return trials.order_by_first_spike(_keys(spark, d)).select("unit_id", "trial_id", "place")


@query(_place("n desc, trial_id"))
def order_count(spark, d):
    return trials.order_by_count_descending(_keys(spark, d)).select("unit_id", "trial_id", "place")


@query(_place("n, first_s, trial_id"))
def order_count_first(spark, d):
    return trials.order_by_count_then_first(_keys(spark, d)).select("unit_id", "trial_id", "place")


def _covariate(spark, d):
    rows = T.trial_rows(spark, d)
    return rows.withColumn("value", F.when(F.col("value") > 150, float("nan")).otherwise(F.col("value")))


@query("select unit_id, trial_id, row_number() over (partition by unit_id order by case when value > 150 then 1 else 0 end, case when value > 150 then 0 else value end, trial_id) - 1 as place from tr")
def order_covariate(spark, d):
    return trials.order_by_covariate(_covariate(spark, d), "value").select("unit_id", "trial_id", "place")


@query("select unit_id, trial_id, row_number() over (partition by unit_id order by case when value > 150 then 1 else 0 end, case when value > 150 then 0 else value end desc, trial_id) - 1 as place from tr")
def order_covariate_descending(spark, d):
    return trials.order_by_covariate(_covariate(spark, d), "value", False).select("unit_id", "trial_id", "place")


@query("""o as (select unit_id, trial_id, row_number() over (partition by unit_id order by n desc, trial_id) - 1 as place from keyed)
select rel.unit_id, place, rel_s from rel join o using (unit_id, trial_id)""")
def raster_in_order(spark, d):
    order = trials.order_by_count_descending(_keys(spark, d))
    return trials.in_order(T.relative(spark, d), order).select("unit_id", "place", "rel_s")


def _subset(spark, d):
    """Trials of small value, the last first."""
    rows = T.trial_rows(spark, d).where("value < 40")
    return rows.select("unit_id", "trial_id", F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("trial_id"))).alias("pos"))


SUBSET_SQL = "sub as (select unit_id, trial_id, row_number() over (partition by unit_id order by trial_id desc) as pos from tr where value < 40)"


def _subset_place(order: str) -> str:
    return f"{SUBSET_SQL} select unit_id, trial_id, row_number() over (partition by unit_id order by {order}) - 1 as place from keyed join sub using (unit_id, trial_id)"


@query(_subset_place("first_s, pos"))
def subset_first_spike(spark, d):
    return trials.subset_order(_keys(spark, d), _subset(spark, d), "first_spike").select("unit_id", "trial_id", "place")


@query(_subset_place("n, pos desc"))
def subset_count(spark, d):
    return trials.subset_order(_keys(spark, d), _subset(spark, d), "count").select("unit_id", "trial_id", "place")


@query(_subset_place("n, first_s, pos"))
def subset_count_first(spark, d):
    return trials.subset_order(_keys(spark, d), _subset(spark, d), "count_first").select("unit_id", "trial_id", "place")


@query("""p as (select unit_id, trial_id, row_number() over (partition by unit_id order by trial_id) - 1 as pos from tr)
select unit_id, pos // 5 as row_id, count(*) as n, min(rel_s) as first_s from rel join p using (unit_id, trial_id) group by 1, 2""")
def raster_merged_rows(spark, d):
    pos = trials.ranked(T.trial_rows(spark, d), F.lit(0)).select("unit_id", "trial_id", F.col("place").alias("trial_pos"))
    rows = trials.merged_rows(T.relative(spark, d).join(pos, trials.TRIAL), 5)
    return rows.groupBy("unit_id", "row_id").agg(F.count("*").alias("n"), F.min("rel_s").alias("first_s"))


@query("""c as (select unit_id, count(*) as n from tr group by 1), k as (select unit_id, n, cast(i as integer) as row from c, range(0, 1000) as t(i) where i < n)
select unit_id, row, case when n = 1 then 5e0 else 0.2 + 9.6 * row / (n - 1) end as y, case when n <= 1 then least(0.4, 2.8) else least(0.4, 0.82 * 10e0 / n) end as mark from k""")
def raster_row_offsets(spark, d):
    n = T.trial_rows(spark, d).groupBy("unit_id").agg(F.count("*").cast("int").alias("n"))
    y = plotdata.row_offsets(F.lit(0.0), F.lit(10.0), F.col("n"), F.lit(0.2))
    mark = plotdata.line_length(F.lit(10.0), F.col("n"), F.lit(0), F.lit(0.4))
    return n.select("unit_id", F.posexplode(y).alias("row", "y"), mark.alias("mark")).withColumn("y", F.round("y", 9)).withColumn("mark", F.round("mark", 9))


ORACLES["raster_row_offsets"] = ORACLES["raster_row_offsets"].replace("select unit_id, row, case", "select unit_id, row, round(case").replace("end as y, case", "end, 9) as y, round(case").replace("end as mark", "end, 9) as mark")


# Summaries and series


@query("""s as (select unit_id, avg(value) as m, stddev_pop(value) as sd from ev group by 1)
select event_id, round(case when sd <= 1e-8 then 0 else (value - m) / sd end, 9) as z from ev join s using (unit_id)""")
def zscore(spark, d):
    return series.zscored(T.events(spark, d), "value", ["unit_id"]).select("event_id", F.round("z", 9).alias("z"))


@query("select cast(min(event_id) as bigint) as start, min(value) as low, max(value) as high from events group by event_id // 10 having count(*) = 10")
def envelope(spark, d):
    rows = T.table(spark, d, "events").select(F.col("event_id").alias("tick"), "value")
    return series.envelope(rows, "value", 10)


@query("""select l_shipmode_ as animal, l_linestatus as session, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.975), 6) as high,
cast(row_number() over (order by quantile_cont(v, 0.5), l_shipmode_, l_linestatus) - 1 as integer) as place
from (select l_returnflag as l_shipmode_, l_linestatus, l_extendedprice / l_quantity - 1500 as v from lineitem) group by 1, 2""")
def forest_ci(spark, d):
    out = _forest(spark, d)
    return out.select("animal", "session", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")], "place")


def _forest(spark, d):
    draws = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("animal"), F.col("l_linestatus").alias("session"), (F.col("l_extendedprice") / F.col("l_quantity") - 1500).alias("v"))
    return plotdata.forest(draws, "v", ["animal", "session"])


@query("""f as (select l_returnflag, l_linestatus, quantile_cont(l_extendedprice / l_quantity - 1500, 0.025) as low, quantile_cont(l_extendedprice / l_quantity - 1500, 0.975) as high from lineitem group by 1, 2)
select 1.1e0 * max(greatest(abs(low), abs(high))) as "limit" from f""")
def forest_limit(spark, d):
    return plotdata.forest_limit(_forest(spark, d))


def _pairs(spark, d):
    """Two rates of each order: its total over 100000, and the third digit group of its key; some zero, some negative."""
    o = T.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000 - 0.5).alias("x"), (F.pmod(F.col("o_custkey"), F.lit(97)).cast("double") / 20).alias("y"))


PAIR_SQL = "pr as (select o_orderkey as id, o_totalprice / 100000 - 0.5 as x, (o_custkey % 97)::double / 20 as y from orders)"


@query(f"{PAIR_SQL} select id, round(log2(y / x), 9) as log2_ratio from pr where x > 0 and y > 0")
def log2_ratio(spark, d):
    return plotdata.ratios(_pairs(spark, d)).select("id", F.round("log2_ratio", 9).alias("log2_ratio"))


@query(f"{PAIR_SQL} select id, x > 0 and y > 0 as usable from pr")
def positive_mask(spark, d):
    return _pairs(spark, d).select("id", C.positive_finite(F.col("x"), F.col("y")).alias("usable"))


@query(f"""{PAIR_SQL}, b as (select cast(k as integer) as bin, -4 + 0.8e0 * k as lo, -4 + 0.8e0 * (k + 1) as hi, k = 9 as is_last from range(10) as t(k)), v as (select log2(y / x) as v from pr where x > 0 and y > 0)
select bin, count(v) as "count" from b left join v on v >= lo and (v < hi or (is_last and v <= hi)) group by 1""")
def modulation_histogram(spark, d):
    rows = plotdata.ratios(_pairs(spark, d))
    return plotdata.histogram(rows, F.col("log2_ratio"), -4.0, 4.0, 10)


@query(f"""{PAIR_SQL}, b as (select cast(k as integer) as bin, -2 + 0.5e0 * k as lo, -2 + 0.5e0 * (k + 1) as hi, k = 7 as is_last from range(8) as t(k)), v as (select y - x as v from pr),
c as (select bin, count(v) as n from b left join v on v >= lo and (v < hi or (is_last and v <= hi)) group by 1)
select bin, n as "count" from c union all select -1, count(*) from v where v < -2 union all select 8, count(*) from v where v > 2""")
def diff_inset(spark, d):
    return plotdata.difference_bars(_pairs(spark, d), 2.0, 8)


@query(f"""{PAIR_SQL}, b as (select cast(k as integer) as bin, 0.5e0 * k as lo, 0.5e0 * (k + 1) as hi, k = 7 as is_last from range(8) as t(k)),
c as (select 'x' as axis, bin, count(x) as n from b left join pr on x >= lo and (x < hi or (is_last and x <= hi)) group by 2 union all
      select 'y', bin, count(y) from b left join pr on y >= lo and (y < hi or (is_last and y <= hi)) group by 2)
select axis, bin, n as "count", (select max(n) * 1.02e0 from c) as scale from c""")
def marginal_histogram(spark, d):
    return plotdata.marginals(_pairs(spark, d), (0.0, 4.0, 0.0, 4.0), 8)


@query(f"{PAIR_SQL} select min(x) - (max(x) - min(x)) * 0.06e0 as lo_x, max(x) + (max(x) - min(x)) * 0.06e0 as hi_x, min(y) - (max(y) - min(y)) * 0.06e0 as lo_y, max(y) + (max(y) - min(y)) * 0.06e0 as hi_y from pr")
def scatter_limits(spark, d):
    return plotdata.scatter_limits(_pairs(spark, d))


@query(f"""{PAIR_SQL}, l as (select min(x) - (max(x) - min(x)) * 0.06e0 as lo_x, max(x) + (max(x) - min(x)) * 0.06e0 as hi_x, min(y) - (max(y) - min(y)) * 0.06e0 as lo_y, max(y) + (max(y) - min(y)) * 0.06e0 as hi_y from pr)
select greatest(lo_x, lo_y) as low, least(hi_x, hi_y) as high from l""")
def unity_segment(spark, d):
    return plotdata.unity_segment(plotdata.scatter_limits(_pairs(spark, d)))


@query(f"""{PAIR_SQL}, g as (select log10(x) as x, log10(y) as y from pr where x > 0 and y > 0)
select round(pow(10, min(x) - (max(x) - min(x)) * 0.08e0), 9) as lo_x, round(pow(10, max(x) + (max(x) - min(x)) * 0.08e0), 9) as hi_x, round(pow(10, min(y) - (max(y) - min(y)) * 0.08e0), 9) as lo_y, round(pow(10, max(y) + (max(y) - min(y)) * 0.08e0), 9) as hi_y from g""")
def log_log_limits(spark, d):
    out = plotdata.log_limits(_pairs(spark, d).where(C.positive_finite(F.col("x"), F.col("y"))))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


# Design columns

SIGNAL_SQL = "sg as (select event_id as tick, case when event_type = 'click' then 1e0 else 0e0 end as x from events)"
RAISED_SQL = """rc as (select t.k as tau, c.k as col, case when abs(t.k / 9e0 - c.k / 3e0) * 3 <= 1 then 0.5 * (1 + cos((t.k / 9e0 - c.k / 3e0) * 3 * pi())) else 0 end as w from range(10) as t(k), range(4) as c(k)),
bs as (select tau, col, w / sum(w) over (partition by col) as w from rc)"""
LOG_RAISED_SQL = """rc as (select t.k as tau, c.k as col, (ln(1 + t.k) - c.k * ln(10) / 3) / (ln(10) / 3) as ph from range(10) as t(k), range(4) as c(k)),
rw as (select tau, col, case when abs(ph) <= 1 then 0.5 * (1 + cos(ph * pi())) else 0 end as w from rc),
bs as (select tau, col, w / sum(w) over (partition by col) as w from rw)"""


def _signal(spark, d):
    e = T.table(spark, d, "events")
    return e.select(F.lit(0).alias("recording_id"), F.col("event_id").alias("tick"), (F.col("event_type") == "click").cast("double").alias("x"))


def _design(out):
    return out.select("tick", F.col("col").cast("long").alias("col"), F.round("y", 9).alias("y"))


def _design_sql(shift: int = 0) -> str:
    return f"""dn as (select tick, c.k as col from sg, range(4) as c(k)), sm as (select sg.tick + tau + {shift} as tick, col, sum(x * w) as y from sg, bs where x != 0 group by 1, 2)
select dn.tick, dn.col, round(coalesce(y, 0), 9) as y from dn left join sm using (tick, col)"""


@query(f"{SIGNAL_SQL}, {RAISED_SQL}, {_design_sql()}")
def design_causal(spark, d):
    return _design(series.design_columns(_signal(spark, d), series.basis(spark, 10, 4), ["recording_id"]))


@query(f"{SIGNAL_SQL}, {LOG_RAISED_SQL}, {_design_sql(1)}")
def design_history(spark, d):
    return _design(series.history_columns(_signal(spark, d), series.basis(spark, 10, 4, "log_raised_cosine"), ["recording_id"]))


@query(f"""{SIGNAL_SQL}, kn as (select 0 as col, -2e0 as c, 1e0 as w union all select 1, -1e0, 1e0 union all select 2, 0e0, 6e0 union all select 3, 6e0, 6e0),
rw as (select t.k as tau, col, case when abs((t.k - c) / w) <= 1 then 0.5 * (1 + cos((t.k - c) / w * pi())) else 0 end as w from range(-2, 6) as t(k), kn),
bs as (select tau, col, w / sum(w) over (partition by col) as w from rw), {_design_sql()}""")
def design_acausal(spark, d):
    return _design(series.design_columns(_signal(spark, d), series.basis(spark, 6, 2, n_leads=2, n_lead_cols=2, lead=2.0), ["recording_id"]))


# Channels

MEDIAN_SQL = "md as (select tick, median(v) as m from fr where channel not in (3, 40, 63) group by 1)"
#: All channels but three that are taken as dead.
GOOD = [c for c in range(T.CHANNELS) if c not in (3, 40, 63)]


def _cells(frames, digits: int = 9):
    return frames.select("tick", F.posexplode("uv").alias("channel", "v")).select("tick", F.col("channel").cast("long").alias("channel"), F.round("v", digits).alias("v"))


@query(f"{MEDIAN_SQL} select tick, m from md")
def cmr_median(spark, d):
    return T.frames(spark, d).select("tick", C.median_of(C.picked(F.col("uv"), GOOD)).alias("m"))


@query(f"{MEDIAN_SQL} select tick, channel, round(case when channel in (3, 40, 63) then v else v - m end, 9) as v from fr join md using (tick)")
def cmr_apply(spark, d):
    return _cells(spatial.common_median_reference(T.frames(spark, d), GOOD))


@query(f"{MEDIAN_SQL} select tick, channel, round(v - m, 9) as v from fr join md using (tick)")
def cmr_apply_all(spark, d):
    return _cells(spatial.common_median_reference(T.frames(spark, d), GOOD, "all"))


DEVIATION_SQL = "cm as (select channel, quantile_cont(v, 0.5) as m from fr group by 1), ds as (select channel, any_value(m) as m, quantile_cont(abs(v - m), 0.5) * 1.4826e0 as sd from fr join cm using (channel) group by 1)"


@query(f"{DEVIATION_SQL} select channel, round(m, 9) as median, round(sd, 9) as sd from ds")
def channel_mad(spark, d):
    out = spatial.channel_deviations(T.frames(spark, d))
    return out.select(F.col("channel").cast("long").alias("channel"), F.round("median", 9).alias("median"), F.round("sd", 9).alias("sd"))


@query(f"""{DEVIATION_SQL}, bad as (select distinct tick from fr join ds using (channel) where abs(v - m) >= 2.5 * sd)
select distinct f.tick from fr f where not exists (select 1 from bad b where abs(f.tick - b.tick) <= 1)""")
def clean_samples(spark, d):
    frames = T.frames(spark, d)
    by = {r["channel"]: r for r in spatial.channel_deviations(frames).collect()}  # one row a channel
    return spatial.clean_samples(frames, [by[i]["median"] for i in range(T.CHANNELS)], [by[i]["sd"] for i in range(T.CHANNELS)], 1, 2.5).select("tick")


@query("select a.channel as i, b.channel as j, round(covar_samp(a.v, b.v), 6) as c from fr a join fr b using (tick) group by 1, 2")
def cov_matrix(spark, d):
    c = spatial.covariance(T.frames(spark, d), 1)
    n = len(c)
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(n) for j in range(n)], "i long, j long, c double").withColumn("c", F.round("c", 6))


def _product(name: str, a: str, b: str, of: str = "sum(a.v * b.v)") -> str:
    return f"{name} as materialized (select a.i, b.j, {of} as v from {a} a join {b} b on a.j = b.i group by 1, 2)"


#: The inverse root of a matrix ``cv`` by Newton and Schulz: Y and Z go to the root and the inverse root of what is cv less its trace.
ROOT_SQL = ", ".join(
    ["tc as (select sum(v) as t from cv where i = j)", "y0 as materialized (select i, j, v / t as v from cv, tc)", "z0 as materialized (select i, j, case when i = j then 1e0 else 0e0 end as v from cv)"]
    + [
        x for k in range(24) for x in (
            _product(f"t{k}", f"z{k}", f"y{k}", "((case when a.i = b.j then 3e0 else 0e0 end) - sum(a.v * b.v)) / 2"), _product(f"y{k + 1}", f"y{k}", f"t{k}"), _product(f"z{k + 1}", f"t{k}", f"z{k}"),
        )
    ] + ["w as (select i, j, v / sqrt(t) as v from z24, tc)"]
)
GOOD_SQL = f"{DEVIATION_SQL}, gd as (select tick, channel, v, m, sd from fr join ds using (channel) where channel not in (3, 40, 63))"


@query(f"""{GOOD_SQL}, bad as (select distinct tick from gd where abs(v - m) >= 4 * sd), cl as (select tick, channel, v - m as x from gd where tick not in (select tick from bad)),
mu as (select channel, avg(x) as mu from cl group by 1), ce as materialized (select tick, channel, x - mu as x from cl join mu using (channel)),
cv as materialized (select a.channel as i, b.channel as j, sum(a.x * b.x) / (count(*) - 1) + case when a.channel = b.channel then 10e0 else 0e0 end as v from ce a join ce b using (tick) group by 1, 2),
{ROOT_SQL}, sc as (select avg(sd) as s from ds where channel not in (3, 40, 63))
select gd.tick, w.i as channel, round(sum(w.v * (gd.v - m)) * any_value(s), 6) as v from gd join w on w.j = gd.channel, sc group by 1, 2
union all select tick, channel, round(v, 6) from fr where channel in (3, 40, 63)""")
def zca_apply(spark, d):
    return _cells(spatial.whiten(T.frames(spark, d), GOOD, pad=0), 6)


#: The first component by squaring a matrix again and again: it goes to the product of the component with itself.
DIAGNOSTICS_SQL = f"""{GOOD_SQL}, mu as (select channel, avg(v) as mu from gd group by 1), ce as materialized (select tick, channel, v - mu as x from gd join mu using (channel)),
cv as materialized (select a.channel as i, b.channel as j, avg(a.x * b.x) as v from ce a join ce b using (tick) group by 1, 2), tc as (select sum(v) as t from cv where i = j), q0 as materialized (select i, j, v / t as v from cv, tc),
{", ".join(f"{_product(f'r{k}', f'q{k}', f'q{k}')}, q{k + 1} as materialized (select i, j, v / (select sum(v) from r{k} where i = j) as v from r{k})" for k in range(24))},
dg as (select i, v from q24 where i = j order by v desc, i limit 1), pv as (select q.i, q.v / sqrt(dg.v) as v from q24 q, dg where q.j = dg.i), sg as (select case when sum(v) < 0 then -1e0 else 1e0 end as s from pv),
la as (select sum(a.v * cv.v * b.v) as l from cv join pv a on a.i = cv.i join pv b on b.i = cv.j), cr as (select avg(abs(cv.v / sqrt(x.v * y.v))) as c from cv join cv x on x.i = x.j and x.i = cv.i join cv y on y.i = y.j and y.i = cv.j where cv.i != cv.j),
sc as (select tick, sum(gd.v * pv.v * s) as pc, median(gd.v) as m from gd join pv on pv.i = gd.channel, sg group by 1),
st as (select case when stddev_pop(m) > 1e-3 and stddev_pop(pc) > 0 then corr(pc, m) end as r, sqrt(avg(m * m)) as rms, count(*) as n from sc),
di as (select c as mean_abs_off_diag_corr, (select median(sd) from ds where channel not in (3, 40, 63)) as median_mad_uv, l / t as dominant_eigenvalue_fraction, r as pc1_median_correlation, rms as residual_spatial_median_rms_uv, n as n_samples_used from cr, la, tc, st)"""
_MEASURES = ("mean_abs_off_diag_corr", "median_mad_uv", "dominant_eigenvalue_fraction", "pc1_median_correlation", "residual_spatial_median_rms_uv")


@query(f"{DIAGNOSTICS_SQL} select {', '.join(f'round({c}, 7) as {c}' for c in _MEASURES)}, n_samples_used from di")
def spatial_diagnostics(spark, d):
    return spatial.diagnostics(T.frames(spark, d), GOOD).select(*[F.round(c, 7).alias(c) for c in _MEASURES], "n_samples_used")


@query(f"""{DIAGNOSTICS_SQL}, h as (select *, mean_abs_off_diag_corr as c, dominant_eigenvalue_fraction as f from di)
select printf('[after bandpass] mean |off-corr|=%.3f, MAD median=%.1f uV, dominant eval fraction=%.2f, PC1 vs median r=%.3f (subsample n=%d)', c, median_mad_uv, f, pc1_median_correlation, n_samples_used) || ' -> ' ||
case when c >= 0.7 and f >= 0.6 then '{spatial.ADVICE["strong"]}' when c >= 0.35 and f >= 0.4 then '{spatial.ADVICE["correlated"]}' when c >= 0.35 then '{spatial.ADVICE["mixed"]}' when f < 0.4 then '{spatial.ADVICE["spread"]}' else '{spatial.ADVICE["moderate"]}' end as line,
case when c >= 0.35 and f >= 0.4 then '{spatial.ADVICE["cmr_high_one"]}' when c >= 0.35 then '{spatial.ADVICE["cmr_high"]}' else '{spatial.ADVICE["cmr_low"]}' end as after_cmr,
case when c <= 0.1 then '{spatial.ADVICE["zca_low"]}' else '{spatial.ADVICE["zca_high"]}' end as after_zca from h""")
def diagnostics_report(spark, d):
    rows = spatial.diagnostics(T.frames(spark, d), GOOD)
    return rows.select(spatial.diagnostics_line("after bandpass").alias("line"), spatial.reference_hint("cmr").alias("after_cmr"), spatial.reference_hint("zca").alias("after_zca"))


@query("""n as (select max(vec_id) + 1 as n from embeddings), s as (select unnest([0, n // 2 - 100 // 2, n - 100]) as s from n) select distinct vec_id as tick from embeddings, s where vec_id >= s and vec_id < s + 100""")
def subsample(spark, d):
    n = T.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return spatial.subsample(T.frames(spark, d), n, 3, 100).select("tick")


@query("select tick, channel, cast(greatest(least(round_even(v * 40 / 0.195e0, 0), 32767), -32768) as smallint) as rounded, cast(trunc(v / 0.195e0) as smallint) as cut from fr")
def int16_samples(spark, d):
    cells = T.frames(spark, d).select("tick", F.posexplode("uv").alias("channel", "v"))
    return cells.select("tick", F.col("channel").cast("long").alias("channel"), C.quantised(F.col("v") * 40, 0.195).alias("rounded"), C.quantised(F.col("v"), 0.195, "truncate").alias("cut"))


BLOCK = 4000


def _blocks(spark, d):
    e = T.table(spark, d, "events").select(F.lit("r0").alias("recording_id"), F.col("event_id").alias("tick"), F.array("value").alias("uv"))
    return signal.frames_to_blocks(e, BLOCK)


# Its response to one impulse, over the samples forward and then backward. The default band-pass, three sections with zeros at 1 and -1.
@query("""co as (select 0.055026134365847926e0 as g, -0.7434365662246591e0 as a1, 0.43695440832510224e0 as b1, -1.9388041445402757e0 as a2, 0.9428216336780428e0 as b2, -1.2555158189949591e0 as a3, 0.30191780036819943e0 as b3),
im as (select 0 as k, g as h, -a1 * g as p1, -g - b1 * g as p2, -a2 * g as q1, -g - b2 * g as q2, -a3 * g as r1, -g - b3 * g as r2 from co
union all select k + 1, p1 + q1 + r1, p2 - a1 * p1, -b1 * p1, q2 - a2 * (p1 + q1), -p1 - b2 * (p1 + q1), r2 - a3 * (p1 + q1 + r1), -(p1 + q1) - b3 * (p1 + q1 + r1) from im, co where k < 2200),
sg as (select event_id as t, value as x from events), n as (select max(t) as last, least(21, max(t)) as pad from sg),
ends as (select (select x from sg where t = 0) as x0, (select x from sg, n where t = last) as x1),
ex as (select t, x from sg union all select -t, 2 * x0 - x from sg, n, ends where t between 1 and pad union all select 2 * last - t, 2 * x1 - x from sg, n, ends where last - t between 1 and pad),
fw as (select e.t + k as t, sum(h * (x - c)) as y from ex e, im, n, (select x as c from ex, n where t = -pad) where e.t + k <= last + pad group by 1),
bw as (select f.t - k as t, sum(h * (y - c)) as v from fw f, im, n, (select y as c from fw, n where t = last + pad) where f.t - k between 0 and last group by 1)
select t as tick, round(v, 6) as v from bw""")
def bandpass(spark, d):
    out = signal.filtered(_blocks(spark, d), signal.bandpass_sections(), halo=BLOCK // 2)
    return out.select("block", F.posexplode("samples").alias("i", "v")).select((F.col("block") * BLOCK + F.col("i")).alias("tick"), F.round("v", 6).alias("v"))


@query(ORACLES["bandpass"].split("with recursive ")[1].removeprefix(f"{T.SQL},"))
def bandpass_exact(spark, d):
    """The same over blocks shorter than the filter's memory, by a scan of their states."""
    e = T.table(spark, d, "events").select(F.lit("r0").alias("recording_id"), F.col("event_id").alias("tick"), F.array("value").alias("uv"))
    out = signal.filtered_exactly(signal.frames_to_blocks(e, 300), signal.bandpass_sections())
    return out.select("block", F.posexplode("samples").alias("i", "v")).select((F.col("block") * 300 + F.col("i")).alias("tick"), F.round("v", 6).alias("v"))


@query("""sg as (select event_id as t, value as x from events), n as (select max(t) as last from sg),
ln as (select x0, (x1 - x0) / last as slope from (select (select x from sg where t = 0) as x0, (select x from sg, n where t = last) as x1), n),
tp as (select k, case when k = 0 then 1 else sin(pi() * k / 4e0) / (pi() * k / 4e0) end * (select sum(pow(2.5e0 * sqrt(1 - (k / 40e0) * (k / 40e0)), 2 * i) / pow(gamma(i + 1), 2)) from range(40) as s(i)) as w from range(-40, 41) as r(k)),
sm as (select 4 * t + k as m, sum((x - x0 - slope * t) * w) * 4 / (select sum(w) from tp) as y from sg, ln, tp group by 1)
select m as tick, round(y + x0 + slope * m / 4, 6) as v from sm, ln, n where m between 0 and 4 * last + 3""")
def upsample(spark, d):
    out = signal.resampled(_blocks(spark, d), 4)
    return out.select("block", F.posexplode("samples").alias("i", "v")).select((F.col("block") * BLOCK * 4 + F.col("i")).alias("tick"), F.round("v", 6).alias("v"))


def _recording(spark, rows, **options):
    """Rows written as a recording of flat 16-bit samples, where driver and executors find it."""
    from neurolake.cluster import shared_folder
    from neurolake.sources.binary import write_samples

    folder = f"{shared_folder(spark)}/recording-{uuid.uuid4().hex}"
    write_samples(rows, folder, in_order=False, **options)
    return folder


@query("select tick, channel, cast(greatest(least(round_even(v * 40 / 0.195e0, 0), 32767), -32768) as bigint) as bits from fr")
def flat_samples(spark, d):
    """What the flat sink wrote, by its bytes."""
    from neurolake.sources.binary import read_voltage

    f = T.frames(spark, d).withColumn("uv", F.transform("uv", lambda v: v * 40))
    cells = read_voltage(spark, _recording(spark, f), T.CHANNELS, scale=1.0).select("tick", F.posexplode("uv").alias("channel", "v"))
    return cells.select("tick", F.col("channel").cast("long").alias("channel"), F.col("v").cast("long").alias("bits"))


@query(ORACLES["upsample"].split("with recursive ")[1].removeprefix(f"{T.SQL},").replace("select event_id as t, value as x from events", "select event_id as t, trunc(value / 0.1e0) as x from events").replace("m / 4, 6)", "m / 4, 6) + 0e0"))
def upsample_flat(spark, d):
    """Resampled in the ranges that a recording is read in."""
    from neurolake.sources.binary import read_voltage

    e = T.table(spark, d, "events").select(F.lit("r0").alias("recording_id"), F.col("event_id").alias("tick"), F.array("value").alias("uv"))
    out = read_voltage(spark, _recording(spark, e, bit_depth=0.1, rounding="truncate"), 1, scale=1.0, up=4, per_task=1 << 16)
    return out.select("tick", (F.round(F.get("uv", F.lit(0)), 6) + 0.0).alias("v"))


# Units


@query("""c as (select user_id as unit_id, event_id % 16 as channel, count(*) as n from events where event_type = 'click' group by 1, 2),
r as (select unit_id, channel, row_number() over (partition by unit_id order by n desc, channel) as k from c) select unit_id, cast(channel as integer) as channel from r where k = 1""")
def unit_best_channel(spark, d):
    e = T.events(spark, d).where("event_type = 'click'").withColumn("channel", F.pmod(F.col("event_id"), F.lit(16)).cast("int"))
    from neurolake.sources.binary import best_channels

    return best_channels(e)


@query("select unit_id, count(*) as n, list(tick order by tick)[1] as first_tick, list(tick order by tick)[-1] as last_tick from sp group by 1")
def unit_trains(spark, d):
    from neurolake.sources.binary import unit_trains as pack

    trains = pack(T.spikes(spark, d).withColumn("row", F.col("tick")))
    return trains.select("unit_id", F.size("ticks").cast("long").alias("n"), F.get("ticks", F.lit(0)).alias("first_tick"), F.element_at("ticks", -1).alias("last_tick"))
