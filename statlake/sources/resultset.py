"""Provider result-set documents (S1, S2, S6) and raw landing.

A provider response is ``{"resultSets": [{"name", "headers": [...], "rowSet": [[...], ...]}]}``:
the schema travels in the data. It is read with a fixed document schema
(cells as text, so mixed numeric/string cells coerce), the wanted result set
is picked, rows are exploded, and each row is zipped with its headers into a
``map<string,string>``; transforms then select the named keys they need.

Each document is one file and one task (multi-line JSON cannot be split);
seasons are landed as many files (one per team and endpoint), so the read
is parallel over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlake.sources.files import exists
from pyspark.sql import types as T

RESULTSET_SCHEMA = T.StructType([
    T.StructField("resultSets", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("headers", T.ArrayType(T.StringType())),
        T.StructField("rowSet", T.ArrayType(T.ArrayType(T.StringType()))),
    ]))),
])

TEAM_RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("full_name", T.StringType()),
    T.StructField("abbreviation", T.StringType()), T.StructField("nickname", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("year_founded", T.IntegerType()),
])


class ExtractContractError(ValueError):
    pass


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Result-set documents with their source file (``_metadata.file_path``)."""
    return (spark.read.schema(RESULTSET_SCHEMA).option("multiLine", True).json(path)
            .select("resultSets", F.col("_metadata.file_path").alias("source_file")))


def resultset_rows(docs: DataFrame, index: int = 0) -> DataFrame:
    """Rows of result set ``index`` as (source_file, row_number, row map header -> text)."""
    rs = docs.select("source_file", F.get("resultSets", F.lit(index)).alias("rs"))
    return rs.select(
        "source_file", F.col("rs.headers").alias("headers"),
        F.posexplode(F.col("rs.rowSet")).alias("row_number", "cells"),
    ).select("source_file", "row_number", F.map_from_arrays("headers", "cells").alias("row"))


def read_resultset(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    return resultset_rows(read_documents(spark, path), index)


def columns(rows: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Project header names out of the row map (missing header -> null column)."""
    return rows.select(*keep, *[F.col("row")[n].alias(n) for n in names])


def read_team_records(spark: SparkSession, path: str) -> DataFrame:
    """The flat JSON list of team objects."""
    return spark.read.schema(TEAM_RECORD_SCHEMA).option("multiLine", True).json(path)


def combine_partitioned_extract(docs: DataFrame, team_of_file: DataFrame, index: int = 0) -> DataFrame:
    """Combine per-team responses after checking the extract contract.

    ``team_of_file`` maps ``source_file`` to the TEAM_ID that file was requested
    for. Every part needs the result set with headers and rows, all parts the
    same headers, and every row the requested TEAM_ID. Checks are aggregates
    over all parts (one job); a breach raises with the count of bad parts.
    """
    rs = docs.select("source_file", F.get("resultSets", F.lit(index)).alias("rs"))
    shape = rs.agg(
        F.count_if(F.col("rs").isNull() | (F.size(F.coalesce(F.col("rs.headers"), F.array())) == 0)
                   | (F.size(F.coalesce(F.col("rs.rowSet"), F.array())) == 0)).alias("empty_parts"),
        F.count_distinct(F.to_json(F.col("rs.headers"))).alias("header_variants"),
    ).first()
    if shape.empty_parts:
        raise ExtractContractError(f"{shape.empty_parts} extract parts have no result set, headers or rows")
    if shape.header_variants > 1:
        raise ExtractContractError("extract parts disagree on headers")
    rows = resultset_rows(docs, index).join(team_of_file, "source_file")
    foreign = rows.where(~F.col("row")["TEAM_ID"].eqNullSafe(F.col("requested_team_id").cast("string"))).limit(1).count()
    if foreign:
        raise ExtractContractError("extract part contains rows for another team")
    return rows.drop("requested_team_id")


def land_if_absent(df: DataFrame, path: str, force: bool = False) -> None:
    """Land raw data once; an existing landing is kept unless ``force``.
    Spark adds ``_SUCCESS`` when all files are complete: a folder without it is
    what a killed job left, and is landed again."""
    if force or not exists(df.sparkSession, f"{path.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").json(path)


def requested_team_by_file(docs: DataFrame, pattern: str = r"team-(\d+)\.json$") -> DataFrame:
    """(source_file, requested_team_id) from the landing file names (one part per team)."""
    return docs.select("source_file", F.regexp_extract("source_file", pattern, 1).cast("bigint").alias("requested_team_id"))
