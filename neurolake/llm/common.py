"""What several operators share: the shared folder, written tables, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.cluster import shared_folder

#: Tokens of every word-based operator: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """The text's tokens in UTF-8, A-Z in lower case: bytes are split at just those six characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only, so that offsets and other scripts stay as they are."""
    return text.lower() if text.isascii() else text.translate(_UPPER_TO_LOWER)


def ascii_lowered(text: Column) -> Column:
    """``ascii_lower`` as a column."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Written tables of one operator; ``drop`` deletes them, once the result is a table of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables. The driver then also lets go of the shuffle files of plans that nothing refers to any more."""
        jvm = self.spark._jvm
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths.clear()
        jvm.System.gc()


def roots(parents: DataFrame) -> DataFrame:
    """``node, component`` of a forest: ``parents`` has ``node, parent`` once a node, with parent < node. Each round doubles the way up."""
    tables = Scratch(parents.sparkSession)
    up = tables.written(parents.select("node", F.col("parent").alias("component")), "up")
    while True:
        further = up.select(F.col("node").alias("component"), F.col("component").alias("next"))
        more = tables.written(up.join(further, "component", "left").select("node", "component", "next"), "up")
        moved = more.where("next is not null").limit(1).count()
        up = more.select("node", F.coalesce("next", "component").alias("component"))
        if not moved:
            break
    roots_ = up.select(F.col("component").alias("node"), "component").distinct()
    out = written(up.unionByName(roots_), "roots")
    tables.drop()
    return out


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    ``edges``: columns ``a``, ``b`` of any type with an order. Returns ``node``, ``component``. Alternates the large-star and
    small-star steps (Kiveris et al., 2014): every round links each node's larger neighbours, then its smaller ones,
    to the smallest neighbour. The edge list never leaves the executors; each round is a written table, deleted after the
    next. Loops and repeated edges don't matter; with no edges the result is empty.
    """
    tables = Scratch(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    pairs = tables.written(pairs, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every neighbour larger than u gets the smallest of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours get the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = tables.written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        # a star has each node once, and no centre of one star in another
        if now[0] == now[2] and (now == before or not pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()):
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out = written(out, "components")
    tables.drop()
    return out
