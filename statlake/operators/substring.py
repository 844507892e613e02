"""F6 over an index: posting lists of the texts' substrings of up to three characters.

A term's rarest gram names the candidates, and each candidate's text is checked,
so the rows are those of a scan with ``contains_ci`` (a term is literal: ``% _ \\``
mean themselves). Terms of up to three characters are grams themselves; the
empty one, a gram of every text, finds all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 64


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def text_grams(text: Column) -> Column:
    """The distinct substrings of at most GRAM characters of the lower-cased text."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    cuts = [_cuts(low, starts, n) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *cuts))


def _cuts(text: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))


def term_grams(term: Column) -> Column:
    """The grams that every text with the term has: the term itself if short, else its trigrams."""
    low = F.lower(term)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    return F.when(F.length(low) <= GRAM, F.array(low)).otherwise(
        F.array_distinct(_cuts(low, starts, GRAM)))


class SubstringIndex:
    """Postings (gram, id) by bucket of the gram, and each gram's count, under ``path``. Null texts have no postings."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, rows: DataFrame, text: str, key: str = "id") -> SubstringIndex:
        # a text has dozens of postings: the texts are dealt out before (a small file is one task's), the postings after,
        # by ranges, so that no task sorts more than its share, also of a gram of very many texts, and few tasks share a bucket
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        texts = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).repartition(parts, "id")
        postings = texts.select("id", F.explode(text_grams(F.col("text"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        order = ["bucket", "gram", "id"]
        (postings.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.path}/postings"))
        counts = self.postings().groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("n"))
        counts.write.partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def search(self, rows: DataFrame, text: str, term: str, key: str = "id") -> DataFrame:
        """The rows whose text has ``term``: one gram's postings are read, and the rows that they name are checked."""
        grams = self.spark.range(1).select(F.explode(term_grams(F.lit(term))).alias("gram")).withColumn(
            "bucket", _bucket(F.col("gram"), self.buckets)).collect()  # at most the term's length
        buckets = sorted({g.bucket for g in grams})
        counted = {r.gram: r.n for r in self.counts().where(F.col("bucket").isin(buckets) & F.col("gram").isin([g.gram for g in grams])).collect()}
        rarest = min(grams, key=lambda g: (counted.get(g.gram, 0), g.gram))
        found = self.postings().where((F.col("bucket") == rarest.bucket) & (F.col("gram") == rarest.gram)).select(F.col("id").alias(key))
        return rows.join(found, key, "left_semi").where(F.contains(F.lower(F.col(text)), F.lower(F.lit(term))))

    def search_all(self, rows: DataFrame, text: str, terms: DataFrame, key: str = "id") -> DataFrame:
        """(term, key) for every term of ``terms`` (a column ``term``) and every row with it, in one job.

        Repeated terms count once, null ones find nothing.
        """
        wanted = terms.select("term").where(F.col("term").isNotNull()).distinct()
        grams = wanted.select("term", F.explode(term_grams(F.col("term"))).alias("gram"))
        counted = grams.join(self.counts().drop("bucket"), "gram", "left")
        rarest = counted.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r")).select(
            "term", F.col("r.gram").alias("gram"))
        candidates = rarest.join(self.postings().drop("bucket"), "gram").select("term", F.col("id").alias(key))
        return candidates.join(rows.select(key, F.lower(F.col(text)).alias("_low")), key).where(
            F.contains("_low", F.lower("term"))).select("term", key)
