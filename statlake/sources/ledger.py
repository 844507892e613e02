"""Ledger of landed sources (S7): which source was landed by which commit, with its rows and a digest of them.

A landing is a folder of rows and a table of entries (one row per source) that
count only once their commit file exists. A run that dies leaves its finished
commits; the next one anti-joins the ledger and lands only what is missing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlake.sources.files import create_if_absent, list_names, read_text

ABSENT, CHANGED, ALL = "absent", "changed", "all"
ENTRIES = "source string, n_rows long, digest string, batch long"


class StaleLedgerError(RuntimeError):
    """Another landing was committed since this one read the ledger."""


def source_digests(rows: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_rows, digest) of each source's rows, whatever their order.

    Rows are digested one by one and the two halves of the digests added up, so
    that a source of any size is combined in the tasks before the shuffle. A
    repeated row counts as often as it comes.
    """
    row = F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns) if c != source]),
                          {"ignoreNullFields": "false"}).cast("binary"))

    def half(at: int):
        return F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")

    return (rows.select(F.col(source).alias("source"), row.alias("row")).groupBy("source")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", half(1), half(16)).alias("halves"))
            .select("source", "n_rows", F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), "halves").cast("binary")).alias("digest")))


class LandingLedger:
    """Landed rows and their ledger under ``root``, on storage that driver and executors share.

    A null source is a source like any other.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self) -> dict[int, str]:
        """Folder name by commit number: one small file per landing run."""
        folder = f"{self.root}/commits"
        return {int(n): read_text(self.spark, f"{folder}/{n}").strip() for n in list_names(self.spark, folder) if n.isdigit()}

    def entries(self) -> DataFrame:
        """Every committed entry: (source, n_rows, digest, batch)."""
        return self._entries(self._batches())

    def _entries(self, batches: dict[int, str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(*[f"{self.root}/entries/{b}" for b in batches.values()])

    def latest(self) -> DataFrame:
        """The entry of each source that counts: its newest."""
        return self._latest(self._batches())

    def _latest(self, batches: dict[int, str]) -> DataFrame:
        newest = F.max_by(F.struct("n_rows", "digest"), "batch")
        return (self._entries(batches).groupBy("source").agg(newest.alias("e"), F.max("batch").alias("batch"))
                .select("source", "e.n_rows", "e.digest", "batch"))

    def pending(self, sources: DataFrame) -> DataFrame:
        """The rows of ``sources`` (with a column ``source``) that were not landed yet: what an extract has left to do."""
        return _without(sources, self.latest())

    def rows(self) -> DataFrame:
        """The rows of every source as its newest landing has them."""
        batches = self._batches()
        if not batches:
            raise LookupError(f"nothing was landed under {self.root}")
        landed = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/data/{b}" for b in batches.values()])
        newest = self._latest(batches).select(F.col("source").alias("_source"), F.col("batch").alias("_newest"))
        return landed.join(newest, landed.source.eqNullSafe(newest._source) & (landed._batch == newest._newest), "left_semi").drop("_batch")

    def land(self, rows: DataFrame, take: str = ABSENT, slices: int = 1) -> None:
        """Land the sources of ``rows`` (a column ``source`` and any others but ``_batch``).

        ``take``: ``absent`` sources only (those landed already are kept),
        ``changed`` ones too (another digest than in the ledger), or ``all``.
        Sources are dealt to ``slices`` by hash, each with a commit of its own, so
        that a run that fails keeps the slices before. A slice without a
        source to land commits nothing.
        """
        if take not in (ABSENT, CHANGED, ALL):
            raise ValueError(f"unknown choice of sources: {take}")
        for i in range(slices):
            part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("source"), F.lit(slices)) == i)
            self._land(part, take)

    def _land(self, rows: DataFrame, take: str) -> None:
        batches = self._batches()
        if take == ABSENT:
            rows = _without(rows, self._latest(batches))
        elif take == CHANGED:
            now, known = source_digests(rows), self._latest(batches)
            same = now.join(known, now.source.eqNullSafe(known.source) & (now.digest == known.digest), "left_semi")
            rows = _without(rows, same)
        number = max(batches, default=0) + 1
        name = f"{number:08d}-{uuid.uuid4().hex}"
        data, entries = f"{self.root}/data/{name}", f"{self.root}/entries/{name}"
        rows.withColumn("_batch", F.lit(number).cast("long")).write.parquet(data)
        # the entries tell of what was written
        landed = self.spark.read.schema(rows.schema).parquet(data)
        source_digests(landed).withColumn("batch", F.lit(number).cast("long")).write.parquet(entries)
        if self.spark.read.schema(ENTRIES).parquet(entries).isEmpty():
            return
        if not create_if_absent(self.spark, f"{self.root}/commits/{number:08d}", name):
            raise StaleLedgerError(f"landing {number} was committed by another run")


def _without(rows: DataFrame, known: DataFrame) -> DataFrame:
    known = known.select(F.col("source").alias("_known"))
    return rows.join(known, rows.source.eqNullSafe(known._known), "left_anti")
