"""Package parts: file types, content types and opaque parts, by joins and CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.contracts import WORKBOOK_TYPES
from gridspark.functions.text import location

#: Which part names are opaque, and what they hold; the first that fits counts.
OPAQUE = (
    ("vbaProject.bin", "macro project"),
    ("/pivot", "pivot table/cache"),
    ("/charts/", "chart"),
    ("/drawings/", "drawing"),
    ("/externalLinks/", "external link"),
    ("/connections", "connection"),
    ("/embeddings/", "embedded OLE object"),
    ("/media/", "media"),
)


def opaque_marker(name: Column) -> Column:
    """What an opaque part holds; null for other parts."""
    out = F.lit(None).cast("string")
    for token, says in reversed(OPAQUE):
        out = F.when(name.contains(token), says).otherwise(out)
    return out


def suffix(path: Column) -> Column:
    """The file name's suffix without its dot, as written; empty without one."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1)


def is_workbook(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*WORKBOOK_TYPES)


def with_content_types(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """parts with content_type: the override of the part's name, else the default of its suffix, else ''. All three
    have sha256; overrides (name, content_type), defaults (extension, content_type)."""
    o = overrides.select("sha256", F.ltrim("name", F.lit("/")).alias("name"), F.col("content_type").alias("o"))
    d = defaults.select("sha256", F.col("extension").alias("ext"), F.col("content_type").alias("d"))
    joined = parts.withColumn("ext", suffix(F.col("name"))).join(o, ["sha256", "name"], "left").join(d, ["sha256", "ext"], "left")
    return joined.withColumn("content_type", F.coalesce("o", "d", F.lit(""))).drop("o", "d", "ext")


def file_type_problems(workbooks: DataFrame) -> DataFrame:
    """A diagnostic for each file that is no workbook. workbooks: sha256, path."""
    says = F.concat(F.lit("Unsupported file type: "), F.when(suffix(F.col("path")) == "", "").otherwise(F.concat(F.lit("."), suffix(F.col("path")))))
    return workbooks.where(~is_workbook(F.col("path"))).select(
        "sha256", F.lit("inventory").alias("origin"), F.array(F.lit(-1).cast("long")).alias("seq"), F.lit("file_type").alias("feature_type"), says.alias("description"),
        F.lit("error").alias("severity"), F.lit(True).alias("opaque"), F.create_map().cast("map<string,string>").alias("metadata"), location(path=F.col("path"), object_type="workbook").alias("loc"),
    )


def opaque_problems(parts: DataFrame) -> DataFrame:
    """A diagnostic for each opaque part. parts: sha256, path, part_seq, name, size."""
    marked = parts.withColumn("marker", opaque_marker(F.col("name"))).where("marker is not null")
    return marked.select(
        "sha256", F.lit("inventory").alias("origin"), F.array(F.col("part_seq").cast("long")).alias("seq"), F.col("marker").alias("feature_type"),
        F.concat(F.lit("Opaque OOXML part recorded: "), F.col("name")).alias("description"), F.lit("warning").alias("severity"), F.lit(True).alias("opaque"),
        F.create_map(F.lit("part_name"), F.col("name"), F.lit("bytes"), F.col("size").cast("string")).alias("metadata"),
        location(path=F.col("path"), object_type="ooxml_part", object_id=F.col("name"), part=F.col("name")).alias("loc"),
    )
