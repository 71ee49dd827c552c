"""Line dedup: keep each line only in the first document that holds it.

Lines are reduced to 128-bit hashes of their keys and positions; no text takes part in the exchange. The hashes are
range-partitioned with a secondary sort by document and position, and a running first() streams over each group:
what follows a group's first document is dropped. Hashes are counted by slot first; those in hot slots, where a hash that
very many documents hold must be, are split in the range partitioning by a salt, so that no task gets one whole. Of them
only, the lines of each salted group's first document are streamed once more, by the hash alone. The operator returns a compressed bitmap per document, not text: an array of
(word, bits) with those 64-line words that have a dropped line; `apply_bitmaps` cuts the lines out.

A line's key is the line without the white space (space, \\x09-\\x0D) at both ends, A-Z in lower case. Keys of fewer
than ``MIN_KEY`` code points are never dropped. Everything is built from DataFrame functions.

Defined results: a null or empty text is one empty line; a null doc_id counts as the greatest; rows with the same
doc_id are one document (none of them loses a line to the other), and equal rows get equal bitmaps; an empty table
gives an empty table; other columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import HOT_LEAST, SPACE, hot_slots, lower_ascii, written

MIN_KEY = 10
#: Parts into which the documents of one hot hash are dealt.
SALTS = 64
LAST_ID = 2**63 - 1

BITMAPS = "doc_key long, text_key long, dropped array<struct<word:int,bits:long>>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY, salts: int = SALTS, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_key, text_key, dropped) of each document that loses lines. hot_least: lines below which no slot is hot."""
    lines = (
        docs.select(doc_key().alias("doc_key"), text_key().alias("text_key"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_key)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_key)
        .select("doc_key", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # read three times, to count, to sample and to deal them: the small hashes, not the texts
    lines = written(lines)
    hot = hot_slots(lines, "h1", hot_least)
    salt = F.pmod(F.xxhash64("doc_key", F.lit(3)), F.lit(salts)).cast("int")
    lines = lines.withColumn("salt", F.lit(-1) if hot is None else F.when(hot, salt).otherwise(-1))
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_key", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ranged = lines.repartitionByRange("h1", "h2", "salt").withColumn("first_doc", F.first("doc_key").over(stream))
    later = ranged.where("doc_key > first_doc").select("doc_key", "text_key", "pos")
    heads = ranged.where("salt >= 0 and doc_key = first_doc")
    across = Window.partitionBy("h1", "h2").orderBy("doc_key", "pos").rowsBetween(Window.unboundedPreceding, 0)
    beaten = heads.withColumn("first_doc", F.first("doc_key").over(across)).where("doc_key > first_doc").select("doc_key", "text_key", "pos")
    words = later.unionByName(beaten).groupBy("doc_key", "text_key", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("doc_key", "text_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with `__ld_lines` (all), `__ld_kept` (those that stay, in order) and `__ld_n_dropped`."""
    keyed = docs.withColumns({"__ld_doc_key": doc_key(), "__ld_text_key": text_key()})
    marks = bitmaps.toDF("__ld_doc_key", "__ld_text_key", "__ld_dropped")
    joined = keyed.join(marks.hint("shuffle_hash"), ["__ld_doc_key", "__ld_text_key"], "left").withColumn("__ld_lines", lines_of(F.col("text")))
    # the sparse words laid out by number, so that each line finds its word at once
    dense = F.expr(
        "aggregate(__ld_dropped, array_repeat(0L, 0), (a, x) -> concat(a, array_repeat(0L, x.word - size(a)), array(x.bits)))"
    )
    kept = F.expr("filter(__ld_lines, (x, i) -> i div 64 >= size(__ld_dense) or shiftright(__ld_dense[cast(i div 64 as int)], i % 64) & 1L = 0L)")
    return (
        joined.withColumn("__ld_dense", dense)
        .withColumn("__ld_kept", F.when(F.col("__ld_dropped").isNull(), F.col("__ld_lines")).otherwise(kept))
        .withColumn("__ld_n_dropped", F.coalesce(F.expr("aggregate(__ld_dropped, 0L, (n, x) -> n + bit_count(x.bits))"), F.lit(0).cast("long")))
        .drop("__ld_doc_key", "__ld_text_key", "__ld_dropped", "__ld_dense")
    )


def line_dedup(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """docs with the repeated lines cut out of the text; all columns stay, and n_chars, where there is one, follows."""
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_key))
    text = F.when(F.col("__ld_n_dropped") == 0, F.col("text")).otherwise(F.array_join("__ld_kept", "\n"))
    out = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__ld_n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document."""
    docs = docs.select("doc_id", "text")
    done = apply_bitmaps(docs, keep_bitmaps(docs, min_key))
    return done.select("doc_id", F.size("__ld_lines").cast("long").alias("n_lines"), F.col("__ld_n_dropped").alias("n_dropped"), F.sha2(F.array_join("__ld_kept", "\n"), 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents
), k as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select doc_id, pos, line, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as gone from k
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from f group by doc_id
"""
