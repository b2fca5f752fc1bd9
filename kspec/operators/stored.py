"""Tables in files whose layout is used again: sorted ranges with an index, for seeks, and buckets, for joins without a shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kspec.functions.kmer import MAX_DOUBLE, MAX_PACKED, canonical, pack

from .table import KmerTable


@dataclass(frozen=True)
class SortedTable:
    """A table in files that hold a range of keys each, in order; the index has a row a file: its first and last key, its rows, and the rows before it.

    A seek reads the index and then only the files that hold what is asked for; nothing is sorted but within a file."""

    spark: SparkSession
    path: str
    k: int

    @staticmethod
    def write(table: KmerTable, path: str, files: int | None = None) -> SortedTable:
        """Dealt by ranges, into so many files or as many as the session's partition sizes make, and sorted within each; the index is counted from the files. An existing table at path is replaced."""
        spark = table.df.sparkSession
        rows = table.df.select("kmer", "cnt", F.lit(table.k).alias("k"))
        (rows.repartitionByRange(files, "kmer") if files else rows.repartitionByRange("kmer")).sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/rows")
        per = spark.read.schema(rows.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("kmer").alias("first"), F.max("kmer").alias("last"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
        per.withColumn("start", before.cast("long")).withColumn("k", F.lit(table.k)).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
        return SortedTable(spark, path, table.k)

    @staticmethod
    def open(spark: SparkSession, path: str, k: int | None = None) -> SortedTable:
        """The table at path; ValueError if it is of another k, or if it is empty and k isn't given."""
        row = spark.read.parquet(f"{path}/index").select("k").first()
        if row is None and k is None:
            raise ValueError(f"the table at {path} is empty, so its k has to be given")
        if row is not None and k is not None and row[0] != k:
            raise ValueError(f"the table at {path} has k = {row[0]}, not {k}")
        return SortedTable(spark, path, row[0] if row is not None else k)

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index").drop("k")

    def table(self, cut_off: int = 1) -> KmerTable:
        return KmerTable(self.spark.read.parquet(f"{self.path}/rows").where(F.col("cnt") >= cut_off).select("kmer", "cnt"), self.k)

    def _read(self, which: list) -> DataFrame:
        """kmer, cnt and ordinal of the rows of some files of the index."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if not which:
            return rows.select("kmer", "cnt", F.lit(0).cast("long").alias("ordinal")).where("false")
        starts = self.spark.createDataFrame([(r.file, r.start) for r in which], "file string, start long")
        read = self.spark.read.schema(rows.schema).parquet(*[r.file for r in which]).select("kmer", "cnt", F.col("_metadata.file_path").alias("file"))
        nth = F.row_number().over(Window.partitionBy("file").orderBy("kmer")) - 1
        return read.join(F.broadcast(starts), "file").select("kmer", "cnt", (F.col("start") + nth).alias("ordinal"))

    def count(self) -> int:
        return self.index().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def from_ordinal(self, ordinal: int, n: int) -> DataFrame:
        """kmer, cnt, ordinal of the n rows from the ordinal-th on in key order, counting from 0."""
        if ordinal < 0:
            raise ValueError(f"no row {ordinal}")
        held = self.index().where((F.col("start") < ordinal + n) & (F.col("start") + F.col("n") > ordinal)).collect()  # the files that are read
        return self._read(held).where((F.col("ordinal") >= ordinal) & (F.col("ordinal") < ordinal + n))

    def from_key(self, word: str, n: int) -> DataFrame:
        """kmer, cnt, ordinal of the n rows from this key on, in key order; the first of them has the key itself if the table does."""
        key = pack(F.lit(word.lower()), self.k)
        later = self.index().where(F.col("last") >= key)
        first = later.agg(F.min(F.struct("start", "n")).alias("f")).first().f
        if first is None:
            return self._read([])
        held = later.where(F.col("start") < first.start + first.n + n).collect()
        return self._read(held).where(F.col("kmer") >= key).orderBy("kmer").limit(n)

    def find(self, word: str) -> DataFrame:
        """kmer, cnt, ordinal of one k-mer, in either orientation."""
        if len(word) != self.k or set(word.lower()) - set("acgt"):
            raise ValueError(f"not a {self.k}-mer: {word}")
        key = pack(canonical(F.lit(word.lower())), self.k)
        return self._read(self.index().where((F.col("first") <= key) & (F.col("last") >= key)).collect()).where(F.col("kmer") == key)


def _keys(k: int) -> list[str]:
    return ["hi", "lo"] if MAX_PACKED < k <= MAX_DOUBLE else ["kmer"]


def _flat(df: DataFrame, k: int) -> DataFrame:
    return df.select("kmer.hi", "kmer.lo", "cnt") if len(_keys(k)) == 2 else df.select("kmer", "cnt")


def _whole(df: DataFrame, k: int) -> DataFrame:
    return df.select(F.struct("hi", "lo").alias("kmer"), "cnt") if len(_keys(k)) == 2 else df.select("kmer", "cnt")


def write_buckets(table: KmerTable, name: str, path: str, buckets: int) -> KmerTable:
    """The table in buckets by the hash of its keys, one file each, in the catalogue as `name`. Tables with as many buckets, or a multiple, are joined bucket by bucket, without a shuffle."""
    keys, spark = _keys(table.k), table.df.sparkSession
    _flat(table.df, table.k).repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return KmerTable(spark.table(name).transform(_whole, table.k) if len(keys) == 2 else spark.table(name), table.k)


def attach_buckets(spark: SparkSession, name: str, path: str, k: int, buckets: int) -> KmerTable:
    """A table that another session has written with write_buckets."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a table name: {name}")
    keys = _keys(k)
    kind = "string" if k > MAX_DOUBLE else "bigint"
    columns = ", ".join([f"{c} {kind}" for c in keys] + ["cnt bigint"])
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return KmerTable(_whole(spark.table(name), k), k)


def joined_buckets(t1: KmerTable, t2: KmerTable) -> DataFrame:
    """kmer, cnt1, cnt2 over the k-mers of either of two tables in buckets, 0 where one lacks it; no row is shuffled."""
    keys = _keys(t1.k)
    a, b = (_flat(t.df, t.k).withColumnRenamed("cnt", c) for t, c in ((t1, "cnt1"), (t2, "cnt2")))
    both = a.join(b.select(*keys, "cnt2"), keys, "full_outer")
    kmer = F.struct(*keys).alias("kmer") if len(keys) == 2 else F.col("kmer")
    return both.select(kmer, F.coalesce("cnt1", F.lit(0)).alias("cnt1"), F.coalesce("cnt2", F.lit(0)).alias("cnt2"))
