"""Files of a dataset: clean CSV reads (S3, S5), digests (S8), and small atomic writes (K9).

Paths go through Hadoop ``FileSystem`` so the same code works on local disk,
HDFS or a cloud store configured in the session.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlake import schemas

CLEAN_FILES = {
    "teams": "shared/teams.csv",
    "players": "shared/players.csv",
    "games": "{season}/games.csv",
    "team_game_stats": "{season}/team_game_stats.csv",
    "player_game_stats": "{season}/player_game_stats.csv",
    "shot_attempts": "{season}/shot_attempts.csv",
}


class MissingFilesError(FileNotFoundError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def _local(spark: SparkSession, path: str) -> str | None:
    """The driver's own path of ``path``, if it lies on the local file system."""
    fs, p = _fs(spark, path)
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _write_beside(spark: SparkSession, path: str, text: str):
    """Write ``text`` under a temporary name in the folder of ``path``; the name (a local one as text, else a Hadoop path)."""
    local = _local(spark, path)
    if local is not None:
        folder, name = os.path.split(local)
        os.makedirs(folder, exist_ok=True)
        tmp = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.tmp")
        with open(tmp, "wb") as f:
            f.write(text.encode("utf-8"))
            f.flush()
            os.fsync(f.fileno())
        return tmp
    fs, p = _fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return tmp


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """K9: write under a temporary name, then put it in place with one atomic rename: readers see the old or the new file."""
    tmp = _write_beside(spark, path, text)
    if isinstance(tmp, str):
        local = _local(spark, path)
        crc = os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.crc")
        if os.path.exists(crc):  # of a file that Hadoop wrote
            os.remove(crc)
        os.replace(tmp, local)
        return
    fs, p = _fs(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(tmp, p, options)


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` whole; False if it is there already. Of several writers exactly one succeeds.

    Locally the file is linked to its name, elsewhere renamed without overwriting
    (atomic where the file system's rename is, as on HDFS).
    """
    tmp = _write_beside(spark, path, text)
    if isinstance(tmp, str):
        try:
            os.link(tmp, _local(spark, path))
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(tmp)
    fs, p = _fs(spark, path)
    if not fs.exists(p) and fs.rename(tmp, p):
        return True
    fs.delete(tmp, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def write_json_atomic(spark: SparkSession, path: str, doc: dict) -> None:
    """K9: a JSON report with sorted keys, published by rename."""
    write_text_atomic(spark, path, json.dumps(doc, sort_keys=True, indent=2) + "\n")


def read_clean_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S3: a clean CSV as text columns (ids keep leading zeros); header required.

    All columns are read as strings, so parsing is left to the contract rules
    (V5/V6 + ``try_cast``); extra columns are projected away, missing ones
    are reported by V3. A line with more or fewer fields than the header
    fails the read (whole lines are parsed whatever columns are used).
    """
    # the header alone, then the lines with its names as an all-text schema, so that malformed lines fail
    header = spark.read.option("header", True).csv(path).schema
    df = (spark.read.schema(header).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
          .option("columnPruning", False).csv(path))
    if columns is not None:
        keep = [c for c in columns if c in df.columns]
        df = df.select(*keep)
    return df


def dataset_paths(root: str, season: str) -> dict[str, str]:
    return {name: f"{root.rstrip('/')}/{rel.format(season=season)}" for name, rel in CLEAN_FILES.items()}


def load_dataset(spark: SparkSession, root: str, season: str) -> dict[str, DataFrame]:
    """The six clean files of a season as one unit; all missing files are reported together."""
    paths = dataset_paths(root, season)
    missing = [rel for name, rel in paths.items() if not exists(spark, rel)]
    if missing:
        raise MissingFilesError("Missing dataset files: " + ", ".join(missing))
    return {name: read_clean_csv(spark, p, schemas.TABLES[name].fieldNames()) for name, p in paths.items()}


#: File systems that Python tasks read by themselves, and the bytes that they read at once.
STREAMED, READ_BYTES = ("file", "hdfs", "s3", "gs"), 1 << 20


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of each file, hashed in the tasks as a stream of READ_BYTES, whatever its size.

    Spark lists the files (folders: their files; empty files are not listed);
    only names and lengths travel. On file systems outside ``STREAMED`` a file passes as one value
    (at most 2 GB).
    """
    files = spark.read.format("binaryFile").load(paths)
    if {_fs(spark, p)[0].getUri().getScheme() for p in paths} - set(STREAMED):
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                if uri.startswith("file:/") and not uri.startswith("file://"):
                    uri = "file://" + uri[len("file:"):]
                system, name = fs.FileSystem.from_uri(uri)
                sha = hashlib.sha256()
                with system.open_input_stream(name, compression=None) as stream:
                    while chunk := stream.read(READ_BYTES):
                        sha.update(chunk)
                found.append(sha.hexdigest())
            yield pa.record_batch([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])

    return files.select("path", "length").repartition("path").mapInArrow(digest, "path string, length long, sha256 string")


def combined_digest(digests: DataFrame, by: str) -> DataFrame:
    """(by, sha256): the only file's digest, or that of the files' digests in path order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda s: s["sha256"])
    ordered = digests.groupBy(by).agg(parts.alias("parts"))
    return ordered.select(by, F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(
        F.sha2(F.array_join("parts", "").cast("binary"), 256)).alias("sha256"))


def table_digests(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, sha256) of tables by path: of a file, or of a folder's part files in path order. One job for all."""
    named = F.lit(None).cast("string")
    for name, path in paths.items():
        fs, p = _fs(spark, path)
        whole = fs.makeQualified(p).toUri().getPath()
        inside = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
        named = F.when((inside == whole) | inside.startswith(whole.rstrip("/") + "/"), name).otherwise(named)
    return combined_digest(file_digests(spark, list(paths.values())).withColumn("name", named), "name")


def table_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one table path (see :func:`table_digests`)."""
    return table_digests(spark, {"table": path}).first().sha256


MANIFEST_FILE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("sha256", T.StringType()), T.StructField("rows", T.LongType()),
])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: CSV with a header and no index column (one folder of part files)."""
    df.write.mode(mode).option("header", True).csv(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """K3 helper: floating NaN becomes NULL before a bulk load (numeric columns stay typed)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def bulk_load(df: DataFrame, table_path: str, partition_by: tuple[str, ...] = ()) -> None:
    """K3: append validated rows to a table folder (columnar, one write per task)."""
    writer = nan_to_null(df).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(table_path)
