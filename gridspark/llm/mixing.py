"""Mixing sources to target weights by Poisson replication.

Each source has a target weight and hence a target repetition rate: how many times one of its documents should stand
in the mixture on average. A document's count is drawn from the Poisson distribution of that mean by inverting its
distribution function at a uniform number that is a hash of the document's id, so that a rerun, a retry or another
partitioning draws the same. Each document is exploded by its count, and the copies are shuffled globally: a range
partitioning and sort by another hash. There is no state and no quota to balance, so all sources are drawn at once.

Rates above ``PIECE`` are drawn as the sum of equal Poisson parts with hashes of their own, so that the table of the
distribution function stays short and exp() far from zero, whatever the rate.

Rates come from counts over all documents. Their table has one row for each source; up to ``BROADCAST_SOURCES`` rows
it is sent to every task, beyond that it is joined by the source.

Defined results: a null source is a source of its own; a null doc_id is drawn by the text's hash; rows with the same
doc_id get the same count, each; a source whose weight is not given or not above zero has rate zero and leaves the
mixture; an empty table gives an empty table; columns named copy_no or mix_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import let, written

SEED, TEMPERATURE, PIECE, TERMS, BROADCAST_SOURCES = 42, 0.5, 8.0, 64, 10_000


def identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def hash_text(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary"))


def uniform(digest: Column) -> Column:
    """A number above 0 and below 1 from the first 52 bits of a hexadecimal digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, ..., TERMS of a rate of at most PIECE."""
    first = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("cdf"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * rate / k
        return F.struct(term.alias("term"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + term)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, add, lambda a: a["cdf"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0) -> DataFrame:
    """(source, rate, pieces, cdf). weights: target share of each source, in any unit; none: the number of its documents
    to the power `temperature`. size: documents of the mixture, as a multiple of those there are."""
    counts = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")))  # one pass over the documents
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0] or [("", 0.0)], "source string, w double")
        weighed = counts.alias("c").join(given.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "n", "w")
    total = counts.agg(F.sum("n").alias("n")).collect()[0].n or 0
    weight = weighed.agg(F.sum("w").alias("w")).collect()[0].w or 1.0
    rate = F.col("w") / F.lit(weight) * F.lit(float(total) * size) / F.col("n")
    pieces = F.greatest(F.lit(1), F.ceil(rate / PIECE)).cast("int")
    return weighed.select("source", rate.alias("rate"), pieces.alias("pieces")).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("pieces")))


def mix(docs: DataFrame, rates: DataFrame, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """docs' columns, copy_no (from 1) and mix_key, in the order of mix_key."""
    table = rates.select(F.col("source").alias("__mx_source"), F.col("pieces").alias("__mx_pieces"), F.col("cdf").alias("__mx_cdf"))
    head = table.take(broadcast_sources + 1)
    if len(head) <= broadcast_sources:
        table = F.broadcast(docs.sparkSession.createDataFrame(head, table.schema))
    keep = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    joined = docs.join(table, docs["source"].eqNullSafe(table["__mx_source"]))

    def count(i: Column) -> Column:
        u = uniform(hash_text(identity(), str(seed), i.cast("string")))
        return let(u, lambda v: F.size(F.filter("__mx_cdf", lambda c: c <= v)))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("__mx_pieces")), F.lit(0), lambda a, i: a + count(i))
    copies = joined.withColumn("__mx_count", drawn).where("__mx_count > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__mx_count"))))
    keyed = copies.select(*[F.col(f"`{c}`") for c in keep], F.col("copy_no").cast("long").alias("copy_no"), hash_text("mix", identity(), str(seed), F.col("copy_no").cast("string")).alias("mix_key"))
    return keyed.orderBy("mix_key", "copy_no")


ORACLE = r"""
with recursive s as (
  select source, count(*)::double as n from documents group by source
), r as (
  select source, pow(n, 0.5) / (select sum(pow(n, 0.5)) from s) * (select sum(n) from s) / n as rate from s
), p(source, rate, k, term, cdf) as (
  select source, rate, 0, exp(-rate), exp(-rate) from r
  union all
  select source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) from p where k < 64
), d as (
  select *, (('0x' || substr(md5(doc_id::varchar || '|42|1'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents
), c as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) as copies from d join p on d.source = p.source and p.cdf <= d.u group by all
)
select doc_id, text, lang, source, n_chars, copy_no::bigint as copy_no, md5('mix|' || doc_id || '|42|' || copy_no) as mix_key
from (select *, unnest(range(1, copies + 1)) as copy_no from c)
"""
