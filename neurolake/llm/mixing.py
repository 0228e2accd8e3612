"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolake.llm.common import written

#: Sources' rates are broadcast up to this number of sources (a table of some 7 MB); beyond it they are joined by source and one of SALT salts.
MOST_BROADCAST, SALT = 10_000, 32
#: A rate above this is split into equal parts, each drawn on its own: sums of Poisson draws are Poisson again.
PART = 16.0
#: Terms of the distribution function; at a rate of PART the rest is below 1e-16.
TERMS = 80


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 of the parts, as a double in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """``source, rate``: mean repetitions that bring each source to its target share of characters.

    Target share: ``weights`` (any positive scale, sources that it leaves out get 0), or else a source's own share to the
    power ``temperature``. A source without any character keeps its share of nothing: rate ``epochs``.
    """
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        want = F.when(F.col("mass") > 0, F.pow("mass", F.lit(float(temperature)))).otherwise(0.0)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        want = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
        want = F.when(F.col("mass") > 0, want).otherwise(0.0)
    mass = mass.withColumn("want", want)
    totals = mass.agg(F.sum("mass").alias("all_mass"), F.sum("want").alias("all_want"))
    rate = F.lit(float(epochs)) * F.col("all_mass") * (F.col("want") / F.col("all_want")) / F.col("mass")
    # one row of two sums, so this cross join is a broadcast of a constant
    return mass.crossJoin(F.broadcast(totals)).select(
        "source", F.when(F.col("mass") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(float(epochs)).alias("rate")
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights, then shuffle globally.

    ``docs``: ``doc_id, text, source`` and any other columns. A document's number of copies is the Poisson quantile,
    at its source's mean repetition rate, of a uniform number hashed from ``seed`` and ``doc_id``: the same on every
    run, on a retried task and in any partitioning. Rows are spread over partitions, and sorted in them, by a hash of
    seed, doc_id and copy. Returns the columns of ``docs`` with ``copy`` (int, from 1) and ``shuffle_key`` (string);
    columns of these names in the input are replaced.

    Null doc_id: hashed as ``null``. Null source: a source of its own. Null or empty text: no mass, yet drawn at its source's
    rate. Rows with the same doc_id get the same number of copies. An empty table gives an empty result.

    The rates are a written table with a row a source. Up to MOST_BROADCAST of them are broadcast, so a document's text is shuffled once, by
    the hash that orders the result; beyond that documents are dealt by source and a salt of their ids, so that a hot source is SALT
    parts of a shuffle.
    """
    rates = source_rates(docs, weights, temperature, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    step = F.col("part_rate")
    start = F.exp(-step)
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(start.alias("p"), start.alias("f"), F.array(start).alias("all")),
        lambda acc, k: F.struct(
            (acc["p"] * step / k).alias("p"),
            (acc["f"] + acc["p"] * step / k).alias("f"),
            F.concat(acc["all"], F.array(acc["f"] + acc["p"] * step / k)).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    rates = (
        rates.withColumn("parts", parts).withColumn("part_rate", F.col("rate") / F.col("parts")).withColumn("cdf", cdf)
        .select(F.col("source").alias("rate_source"), "parts", "cdf")
    )
    rates = written(rates, "rates")
    others = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "doc_id", "source")
    same = F.col("source").eqNullSafe(F.col("rate_source"))
    if rates.count() <= MOST_BROADCAST:
        drawn = rows.join(F.broadcast(rates), same)
    else:
        salts = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
        drawn = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).join(salts, same & (F.col("salt") == F.col("rate_salt")))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: _uniform(F.lit(seed), F.col("doc_id"), j))
    counts = F.transform(draws, lambda u: F.size(F.filter("cdf", lambda f: u >= f)))
    count = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    copies = drawn.select("row", "doc_id", count.alias("count")).where("count > 0").select(
        "row", "doc_id", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy")
    )
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy"))
    dealt = copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("row.*", "copy", "shuffle_key")


#: The query's parameters are the defaults above: share ~ (characters of the source) ^ 0.7, one epoch, seed 17.
SQL = """
with docs as (select *, coalesce(length(text), 0) as len_ from documents),
mass as (select source, cast(sum(len_) as double) as mass from docs group by source),
want as (select source, mass, case when mass > 0 then pow(mass, 0.7) else 0 end as want from mass),
tot as (select sum(mass) as all_mass, sum(want) as all_want from want),
rate as (select source, case when mass > 0 then all_mass * (want / all_want) / mass else 1.0 end as rate from want, tot),
parts as (select source, rate, cast(greatest(ceil(rate / 16.0), 1) as integer) as parts from rate),
pmf as (select source, k, exp(-(rate / parts)) * pow(rate / parts, k) / factorial(cast(k as integer)) as p
        from parts, range(0, 33) as r(k)),
cdf as (select source, k, sum(p) over (partition by source order by k) as f from pmf),
draw as (select d.doc_id, d.source, j,
         cast(cast('0x' || substr(md5(concat_ws(':', '17', coalesce(cast(doc_id as varchar), 'null'), cast(j as varchar))), 1, 13) as bigint) as double) / 4503599627370496.0 as u
         from docs d join parts p on d.source is not distinct from p.source, unnest(range(1, p.parts + 1)) as t(j)),
hits as (select w.doc_id, w.j, count(c.k) as n from draw w left join cdf c
         on w.source is not distinct from c.source and w.u >= c.f group by w.doc_id, w.j),
counts as (select doc_id, cast(sum(n) as integer) as n from hits group by doc_id)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, cast(c.copy as integer) as copy,
       md5(concat_ws(':', '17s', coalesce(cast(d.doc_id as varchar), 'null'), cast(c.copy as varchar))) as shuffle_key
from documents d join (select doc_id, unnest(range(1, n + 1)) as copy from counts) c using (doc_id)
"""
