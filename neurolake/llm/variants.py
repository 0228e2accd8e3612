"""Spelling variants of a corpus's words, found by asymmetric q-chunks, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolake.llm.common import Scratch, ascii_lowered, roots, written

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: Rows of a chunk and its grams from which on they meet by their other parts too.
BUSY = 64


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """``word, n``: runs of letters with A-Z in lower case, of enough code points and occurrences.

    ``typo_every``: plants typing errors, the same on every run: where it divides the crc32 h of ``<doc_id>:<run>``, the run loses its code
    point h modulo its length. Counts are summed in the tasks before a shuffle.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= min_chars)
    runs = runs.select("doc_id", ascii_lowered(F.col("run")).alias("word"))
    if typo_every:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "word")))
        at = F.pmod("h", F.char_length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("h") % typo_every == 0, short).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _cut(word: Column, begin: Column, length: Column) -> Column:
    return F.substring(word, begin + 1, length)


def _rest(word: Column, begin: Column, length: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), begin), F.substring(word, begin + length + 1, F.char_length(word)))


KEY = ["size", "part", "gram"]


def _chunks(words: DataFrame) -> DataFrame:
    """Two disjoint chunks of each word: its halves."""
    parts = words.withColumn("size", F.char_length("word")).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    q = F.floor(F.col("size") / 2).cast("int")
    begin = F.col("part") * q
    return parts.select("size", "part", _cut(F.col("word"), begin, q).alias("gram"), F.col("word").alias("a"), F.col("n").alias("a_n"), begin.alias("a_begin"))


def _grams(words: DataFrame) -> DataFrame:
    """The other word's grams that can meet a chunk of a word as long, or one longer: of all positional grams those within the shift of one that
    the lengths leave open, in front of the edit none, behind it the difference of lengths."""
    parts = words.withColumn("short", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    size = F.char_length("word") + F.col("short")
    q = F.floor(size / 2).cast("int")
    begin = F.col("part") * (q - F.col("short"))
    return parts.select(size.alias("size"), "part", _cut(F.col("word"), begin, q).alias("gram"), "short", F.col("word").alias("b"), F.col("n").alias("b_n"), begin.alias("b_begin"))


def _verified(met: DataFrame) -> DataFrame:
    """One row for each pair of words one edit apart. A pair that shares both chunks is taken by its first."""
    q = F.floor(F.col("size") / 2).cast("int")
    once = (F.col("part") == 0) | (F.substring("a", F.lit(1), q) != F.substring("b", F.lit(1), q))
    ordered = (F.col("short") == 1) | (F.col("a") < F.col("b"))
    return met.where(ordered & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, tables: Scratch) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words that one inserted, deleted or replaced code point tells apart, once.

    The longer word gives its halves, the other its grams of that length; one edit leaves a half as it was, moved by one at most. Where a half
    and its grams are more than BUSY rows, the remaining parts must meet too: with the same place cut out of both, or as
    they are with one code point cut out of the longer. So a busy half costs its words and their lengths, not its pairs. All are verified.
    """
    chunks, grams = _chunks(words), _grams(words)
    each = chunks.select(*KEY).unionByName(grams.select(*KEY)).groupBy(*KEY).agg(F.count("*").alias("rows"))
    busy = tables.written(each.where(F.col("rows") > BUSY).select(*KEY), "busy-chunks")
    quiet = chunks.join(busy, KEY, "left_anti").join(grams, KEY)
    q = F.floor(F.col("size") / 2).cast("int")
    long = chunks.join(busy, KEY, "left_semi").withColumn("rest", _rest(F.col("a"), F.col("a_begin"), q))
    short = grams.join(busy, KEY, "left_semi").withColumn("rest", _rest(F.col("b"), F.col("b_begin"), q))

    def cut_out(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.char_length("rest") - 1)))
        return rows.withColumn("left", F.concat(F.substring("rest", F.lit(1), F.col("at")), F.substring("rest", F.col("at") + 2, F.char_length("rest"))))

    cut = cut_out(long)
    # code points of a run leave the same when cut out, so one of them is enough
    first = (F.col("at") == 0) | (F.substring("rest", F.col("at"), F.lit(1)) != F.substring("rest", F.col("at") + 1, F.lit(1)))
    replaced = cut.drop("rest").join(cut_out(short.where("short = 0")).drop("rest"), [*KEY, "at", "left"])
    dropped = cut.where(first).drop("rest", "at").join(short.where("short = 1").withColumnRenamed("rest", "left"), [*KEY, "left"])
    columns = [*KEY, "short", "a", "a_n", "b", "b_n"]
    met = quiet.select(*columns).unionByName(replaced.select(*columns)).unionByName(dropped.select(*columns))
    return _verified(met)


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word with the form that it is a variant of, and with the root that forms lead to.

    ``words``: ``word, n``, distinct words. A word's form: of the words one edit apart the one with the largest ``n`` (ties: the
    smallest in code-point order), if that is at least ``ratio`` times the word's own; else null. ``root``: from the word, forms to the last. Returns
    ``word, form, root, n, n_near, form_n``; other columns are dropped. Null words are left out. An empty table gives an
    empty result. A word's near words are bounded by its length and the alphabet, so no row collects a group.
    """
    tables = Scratch(words.sparkSession)
    words = tables.written(words.where("word is not null").select("word", "n"), "words")
    pairs = tables.written(near_words(words, tables), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("near"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form")).alias("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    out = words.join(best, "word", "left").withColumn("form_n", -F.col("near.less"))
    known = F.col("form_n") >= ratio * F.col("n")
    out = tables.written(
        out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("near.form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n")),
        "forms",
    )
    # forms are ever more frequent, so there is no circle, and a way has as many steps as n has digits
    ends = roots(out.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent")))
    ends = ends.select(F.col("node").alias("word"), F.col("component").alias("root"))
    out = written(out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    tables.drop()
    return out


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, as DuckDB SQL: a step a bit."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: cast('0x' || substr(hex({text}), 2 * i + 1, 2) as bigint))"
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    octet = f"list_reduce(list_prepend(xor(c, o), range(8)), lambda c, b: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, o: {octet}), 4294967295)"


#: The query's parameters are the defaults above, with typing errors planted in one of 31.
SQL = f"""
with recursive runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
held as (select doc_id, w, count(*) as c from runs where length(w) >= 7 group by 1, 2),
hashed as (select w, c, {crc32_sql("coalesce(cast(doc_id as varchar), 'null') || ':' || w")} as h from held),
cut as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, c from hashed),
words as (select word, cast(sum(c) as bigint) as n from cut where length(word) >= 7 group by 1 having sum(c) >= 2),
v as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from words, unnest(range(length(word))) as t(i)),
rp as (select a.word, b.word as near, b.n as near_n from v a join v b on a.i = b.i and a.less = b.less and a.word != b.word),
dl as (select distinct a.word as long, a.n as long_n, b.word as short, b.n as short_n from v a join words b on a.less = b.word),
near as (select * from rp union all select long, short, short_n from dl union all select short, long, long_n from dl),
best as (select word, count(*) as n_near, max(near_n) as top_n from near group by 1),
form as (select word, min(near) as form from near join best using (word) where near_n = top_n group by 1),
al as (select w.word, case when top_n >= 10 * n then form end as form, n, coalesce(n_near, 0) as n_near, case when top_n >= 10 * n then top_n end as form_n from words w left join best using (word) left join form using (word)),
up as (select word, word as root from al union all select up.word, al.form as root from up join al on al.word = up.root where al.form is not null),
ends as (select up.word, up.root from up join al on al.word = up.root where al.form is null)
select word, form, root, n, n_near, form_n from al join ends using (word)
"""
