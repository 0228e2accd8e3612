"""Lines that many documents share, dropped from all but one of them, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolake.functions.columns import once
from neurolake.llm.common import Scratch, ascii_lowered

#: Stripped at both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2``: a row a line whose key is long enough; two hashes of other seeds, 128 bits, stand for the key."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    stripped = F.btrim("line", F.lit(BLANKS))
    keys = lines.where(F.char_length(stripped) >= min_chars).withColumn("key", ascii_lowered(stripped))
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def _without(lines: Column, positions: Column) -> Column:
    """An array without the elements at rising ``positions``: what lies between two of them in a row is one slice, so the work is linear."""

    def kept(all_: Column) -> Column:
        before, after = F.concat(F.array(F.lit(-1)), positions), F.concat(positions, F.array(F.size(all_)))
        return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(all_, a + 2, b - a - 1)))

    return once(lines, kept)  # split once, not once a position


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` of them hold; the one with the largest doc_id keeps its own.

    ``docs``: ``doc_id, text`` and any other columns. Lines are what lies between \\n. A line's key: BLANKS stripped at both ends, A-Z in
    lower case. Keys of less than ``min_chars`` code points are never dropped. Returns the columns of ``docs`` with ``text`` cleaned, and
    ``n_lines`` (before) and ``n_dropped``; columns of these two names in the input are replaced.

    Null text: as empty, one empty line; its text comes out empty. Rows of one doc_id are one document for the count, and each is cleaned on
    its own; a null doc_id is one document, smaller than any other. Lines that a document repeats count once, and go or stay together. An empty
    table gives an empty result.

    Only hashes, ids and places of lines are shuffled: first by line and document, so a line that a third of all rows hold is spread over
    all tasks and arrives at its count as a number a task; then lines meet the table of shared ones, which is written, so that
    Spark can split a hot line's partition. Text is shuffled once, to meet the places of its dropped lines.
    """
    tables = Scratch(docs.sparkSession)
    keys = line_keys(docs, min_chars)
    held = keys.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    shared = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    shared = tables.written(shared.select("h1", "h2", "keeper"), "shared-lines")
    lost = keys.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    lost = tables.written(lost.select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), "places"), "lost-lines")
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("row.doc_id").eqNullSafe(F.col("lost_id")) & (F.xxhash64("text") == F.col("lost_hash"))
    lines = F.split("text", "\n")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(_without(lines, F.col("places")), "\n"))
    out = rows.join(lost, same, "left").select(
        "row", text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped")
    )
    return out.select("row.*", "text", "n_lines", "n_dropped")


SQL = """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct coalesce(cast(doc_id as varchar), 'null')) >= 3),
g as (select r, k.doc_id, line, pos, f.key is not null and k.doc_id is distinct from keeper as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from g group by r, doc_id
"""
