"""S1/S6 for documents of any size: the rows of a result set, read by several tasks a document.

A multi-line JSON file is one task. Here the text source cuts the document at
every ``]`` (blocks of ``spark.sql.files.maxPartitionBytes``, a task each), and
running sums over the pieces of a file tell where a cut stands: inside a text
(quotes before it), at which depth of arrays (brackets), in which result set
(braces). A running sum is one window per block and one over the blocks' totals,
so no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statlake.sources.stored import stored

_BLOCK = ["source_file", "block"]


def _before(pieces: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """Adds, by name, the sum of each figure over all earlier pieces of the file."""
    named = pieces.withColumns({f"_{n}": c.cast("long") for n, c in figures.items()})
    inside = Window.partitionBy(*_BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = named.groupBy(*_BLOCK).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in figures])
    starts = totals.select(*_BLOCK, *[F.coalesce(F.sum(f"_{n}").over(blocks), F.lit(0)).alias(f"_start_{n}") for n in figures])
    run = named.withColumns({n: F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in figures}).join(starts, _BLOCK)
    return run.withColumns({n: F.col(n) + F.col(f"_start_{n}") for n in figures}).drop(
        *[f"_{n}" for n in figures], *[f"_start_{n}" for n in figures])


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The document between its ``]``, each piece with its place, the depth before it and its text outside strings."""
    read = spark.read.option("lineSep", "]").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    # an escape never spans a cut, as \] is none
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = _before(read, {"quotes": _count(plain, '"')})
    within = F.pmod(F.col("quotes"), F.lit(2))
    segments = F.split(plain, '"', -1)
    outside = F.array_join(F.filter(segments, lambda s, i: F.pmod(i, F.lit(2)) == within), "")
    cut = F.pmod(F.col("quotes") + _count(plain, '"'), F.lit(2)) == 0
    known = quoted.select(*_BLOCK, "at", "value", (within == 1).alias("in_text"), outside.alias("outside"), cut.alias("is_cut"))
    opens = _count(F.col("outside"), "[")
    placed = _before(known, {"depth": opens - F.col("is_cut").cast("int")})
    return placed.withColumn("depth_after", F.col("depth") + opens - F.col("is_cut").cast("int"))


def read_resultset_split(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    """Rows of result set ``index`` as (source_file, row_number, row map header -> text), as ``read_resultset`` gives them.

    Documents are UTF-8 and whole (a torn one gives the rows before the tear); a
    result set has no members that are objects, and headers are texts. A
    document without the set, or a set without rows, gives none. A nested cell
    comes as JSON text without the document's blanks. Intermediate:
    the pieces, once, in the shared folder.
    """
    pieces = stored(_pieces(spark, path), "resultset-pieces")
    # what starts with a set: braces where one array is open
    level = F.split("outside", r"\[", -1)
    sets = F.when(F.col("depth") <= 1, _count(F.coalesce(F.get(level, (F.lit(1) - F.col("depth")).cast("int")), F.lit("")), "{")).otherwise(0)
    closes = F.col("is_cut") & (F.col("depth_after") <= 2)
    is_row = F.col("is_cut") & (F.col("depth_after") == 2)
    placed = _before(pieces, {"sets_before": sets, "rows_before": is_row.cast("int"), "closed": closes.cast("int")}).select(
        "source_file", "block", "at", "value", "in_text", "depth", "depth_after", "rows_before", "closed", "is_cut",
        (F.col("sets_before") + sets - 1).alias("set"))
    # most pieces are a row, or the end of a list, by themselves; the others (a ] in a text or in a nested cell) are joined
    alone = closes & ~F.col("in_text") & (F.col("depth") <= 2)
    single = placed.where(alone).select("source_file", "set", "rows_before", "depth", "depth_after", F.concat("value", F.lit("]")).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value", "depth", "depth_after", "set", "is_cut")))
    whole = placed.where(~alone).groupBy("source_file", "closed").agg(parts.alias("p"), F.min("rows_before").alias("rows_before"))
    last = F.element_at("p", -1)
    joined = whole.where(last["is_cut"] & (last["depth_after"] <= 2)).select(
        "source_file", last["set"].alias("set"), "rows_before", F.col("p")[0]["depth"].alias("depth"), last["depth_after"].alias("depth_after"),
        F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "]"), F.lit("]")).alias("text"))
    texts = single.unionByName(joined).where(F.col("set") == index)

    row_text = F.when(F.col("depth") <= 1, F.regexp_extract("text", r'(?s)"rowSet"\s*:\s*\[\s*(\[.*)$', 1)).otherwise(
        F.regexp_extract("text", r"(?s)^[^\[]*(\[.*)$", 1))
    rows = texts.where((F.col("depth_after") == 2)).select("source_file", "rows_before", F.from_json(row_text, "array<string>").alias("cells"))
    header_text = F.regexp_extract("text", r'(?s)"headers"\s*:\s*(\[.*)$', 1)
    headers = texts.where((F.col("depth_after") == 1) & (header_text != "")).select(
        "source_file", F.from_json(header_text, "array<string>").alias("headers"))
    first = rows.groupBy("source_file").agg(F.min("rows_before").alias("first_row"))
    return rows.join(headers.join(first, "source_file"), "source_file").select(
        "source_file", (F.col("rows_before") - F.col("first_row")).cast("int").alias("row_number"),
        F.map_from_arrays("headers", "cells").alias("row"))
