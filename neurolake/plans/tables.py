"""The given tables in the roles of a recording: events as spikes, alignment events and samples; embeddings as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.functions.columns import tick_of
from neurolake.operators import trials

#: Ticks are microseconds. Spikes are looked at six hours about an event, in bins of half an hour.
FS = 1e6
HALF_WINDOW = 21_600_000_000
EDGES = [-21600.0 + 1800.0 * k for k in range(25)]
#: Channels of a frame: all components of a vector.
CHANNELS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("unit_id"), tick_of("ts").alias("tick"), "event_type", "value")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'click'").select("unit_id", "tick")


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'error'").select("unit_id", F.col("event_id").alias("trial_id"), F.col("tick").alias("event_tick"), "value")


def relative(spark: SparkSession, sf_dir: str, closed: str = "left") -> DataFrame:
    return trials.aligned(spikes(spark, sf_dir), trial_rows(spark, sf_dir), HALF_WINDOW, FS, closed)


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.trial_histograms(relative(spark, sf_dir), trial_rows(spark, sf_dir), EDGES)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("tick"), F.floor("value").cast("int").alias("word"))


def frames(spark: SparkSession, sf_dir: str, scale: float = 100.0) -> DataFrame:
    """The components of each vector as channels, in microvolts; vec_id counts the ticks."""
    e = table(spark, sf_dir, "embeddings")
    uv = F.transform("embedding", lambda v: v.cast("double") * scale)
    return e.select(F.lit("r0").alias("recording_id"), F.col("vec_id").alias("tick"), uv.alias("uv"))


#: The same in SQL.
SQL = """
ev as (select event_id, user_id as unit_id, epoch_us(ts) as tick, event_type, value from events),
sp as (select unit_id, tick from ev where event_type = 'click'),
tr as (select unit_id, event_id as trial_id, tick as event_tick, value from ev where event_type = 'error'),
rel as (select tr.unit_id, trial_id, sp.tick, sp.tick / 1e6 - event_tick / 1e6 as rel_s from tr join sp on tr.unit_id = sp.unit_id
        and sp.tick >= event_tick - 21600000000 and sp.tick < event_tick + 21600000000),
bins as (select cast(k as integer) as bin, -21600e0 + 1800 * k as lo, -21600e0 + 1800 * (k + 1) as hi, k = 23 as is_last from range(24) as t(k)),
hist as (select tr.unit_id, tr.trial_id, b.bin, count(rel.rel_s) as "count" from tr cross join bins b
         left join rel on rel.unit_id = tr.unit_id and rel.trial_id = tr.trial_id and rel.rel_s >= b.lo and (rel.rel_s < b.hi or (b.is_last and rel.rel_s <= b.hi))
         group by 1, 2, 3),
words as (select event_id as tick, cast(floor(value) as integer) as word from events),
hi as (select tick, (word >> 4) & 1 as hi from words),
fr as (select vec_id as tick, i - 1 as channel, cast(embedding[i] as double) * 100 as v from embeddings, range(1, 65) as t(i)),
keyed as (select tr.unit_id, tr.trial_id, count(rel_s) as n, coalesce(min(rel_s), 'inf'::double) as first_s, coalesce(min(case when rel_s > 0 then rel_s end), 0.0) as positive_s
          from tr left join rel on tr.unit_id = rel.unit_id and tr.trial_id = rel.trial_id group by 1, 2)
"""
