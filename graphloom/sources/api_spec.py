"""API descriptions (OpenAPI / swagger 2.0 JSON) as rows.

``from_json`` into maps of strings keeps the key order of the file and leaves the
nested JSON as text, so the first-wins rules downstream see the original order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from graphloom.sources.corpus import whole_texts

SPEC_SCHEMA = "spec_file STRING, definitions MAP<STRING, STRING>, paths MAP<STRING, STRING>"


def read_api_spec(spark: SparkSession, path: str | None) -> DataFrame:
    """One row per spec file; no row at all when the file is missing."""
    empty = spark.createDataFrame([], SPEC_SCHEMA)
    if not path:
        return empty
    try:
        files = whole_texts(spark.read, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    parts = "definitions MAP<STRING, STRING>, paths MAP<STRING, STRING>"
    parsed = F.from_json("value", parts)
    return files.select(
        F.col("_metadata.file_name").alias("spec_file"), parsed.alias("s")
    ).select("spec_file", "s.definitions", "s.paths")


#: Ordinals of the next file begin that much higher.
FILE_STRIDE = 1 << 40


def _placed(spec: DataFrame) -> DataFrame:
    """Spec files, which are few, with the first ordinal of each by file name."""
    names = spec.select("spec_file").distinct()
    place = F.row_number().over(Window.orderBy("spec_file")).cast("bigint")
    first = names.select("spec_file", ((place - 1) * FILE_STRIDE).alias("_first"))
    return spec.join(first, "spec_file")


def spec_definitions(spec: DataFrame) -> DataFrame:
    """(spec_file, def_ord, name, definition JSON) in the order of files and places."""
    return _placed(spec).select(
        "spec_file", "_first", F.posexplode("definitions").alias("_pos", "name", "definition")
    ).select("spec_file", (F.col("_first") + F.col("_pos")).alias("def_ord"), "name", "definition")


def spec_operations(spec: DataFrame) -> DataFrame:
    """(spec_file, path_ord, op_ord, path, method, operation_id, description)."""
    paths = _placed(spec).select(
        "spec_file", "_first", F.posexplode("paths").alias("_pos", "path", "ops")
    ).select("spec_file", (F.col("_first") + F.col("_pos")).alias("path_ord"), "path", "ops")
    methods = paths.select(
        "spec_file", "path_ord", "path",
        F.posexplode(F.from_json("ops", "MAP<STRING, STRING>")).alias("op_ord", "method", "op"),
    )
    return methods.select(
        "spec_file", "path_ord", "op_ord", "path", "method",
        F.get_json_object("op", "$.operationId").alias("operation_id"),
        F.get_json_object("op", "$.description").alias("description"),
    )
