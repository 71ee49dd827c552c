"""Artifacts read back in bulk: the JSON files of many runs as frames, parsed by tasks against the contracts' shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.contracts import ANY, ARTIFACT_SHAPES, NUMBER, TRUTH, WHOLE

CORRUPT = "corrupt"
_TYPES = {WHOLE: T.LongType(), NUMBER: T.DoubleType(), TRUTH: T.BooleanType(), ANY: T.VariantType()}


def spark_type(shape: object) -> T.DataType:
    """The Spark type of an artifact's shape; what may be anything is a variant."""
    if isinstance(shape, dict):
        return T.StructType([T.StructField(k, spark_type(s)) for k, s in shape.items()])
    if isinstance(shape, list):
        return T.ArrayType(spark_type(shape[0]))
    return _TYPES.get(shape, T.StringType())


def read_artifacts(spark: SparkSession, paths: str | list[str], artifact_type: str) -> DataFrame:
    """A row for each file: path, the artifact's fields, and `corrupt`, the text of a file that is no JSON of that shape
    (its fields are null then)."""
    schema = T.StructType([*spark_type(ARTIFACT_SHAPES[artifact_type]).fields, T.StructField(CORRUPT, T.StringType())])
    found = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    wrong = F.col("artifact_type").isNull() | (F.col("artifact_type") != artifact_type)
    told = F.coalesce(CORRUPT, F.when(wrong, F.concat(F.lit("artifact_type "), F.coalesce("artifact_type", F.lit("missing")))))
    return found.withColumns({CORRUPT: told, "path": F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")})


def cells_back(inventories: DataFrame) -> DataFrame:
    """The contract's cells frame (without its style's workbook) of read_artifacts(..., 'workbook_inventory')."""
    sheets = inventories.where(F.col(CORRUPT).isNull()).select("workbook_sha256", F.explode("sheets").alias("s"))
    cells = sheets.select("workbook_sha256", "s.name", "s.index", F.explode("s.cells").alias("c"))
    kind = "schema_of_variant(c.value)"
    text = "cast(c.value as string)"
    typed = f"case when c.value is null or is_variant_null(c.value) then null when {kind} = 'BIGINT' then 'long' when {kind} = 'BOOLEAN' then 'boolean' when {kind} = 'STRING' then 'string' else 'double' end"
    return cells.selectExpr(
        "workbook_sha256 as sha256", "name as sheet_name", "index as sheet_index", "c.row as row", "c.column as column", "c.address as address", "c.kind as kind",
        f"case when c.value is null or is_variant_null(c.value) then null else {text} end as value", f"{typed} as value_type", "c.data_type as data_type", "c.number_format as number_format", "c.formula as formula",
        "c.style_id as style_id", "c.source_location as loc",
    )
