"""Two-dimensional histograms: joint counts of two tables, counts by GC content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kspec.functions.kmer import gc_content, unpack

from .table import KmerTable


def joined_counts(t1: KmerTable, t2: KmerTable) -> DataFrame:
    """kmer, cnt1, cnt2 over the k-mers of either table, 0 where one lacks it."""
    right = t1._with(t2).select("kmer", F.col("cnt").alias("cnt2"))
    both = t1.df.select("kmer", F.col("cnt").alias("cnt1")).join(right, "kmer", "full_outer")
    return both.select("kmer", F.coalesce("cnt1", F.lit(0)).alias("cnt1"), F.coalesce("cnt2", F.lit(0)).alias("cnt2"))


def joint_matrix(counts: DataFrame, c1: str, c2: str, max1: int = 1000, max2: int = 1000) -> DataFrame:
    """cnt1, cnt2, n: k-mers with these counts. Counts above the limits are left out."""
    inside = counts.where((F.col(c1) + F.col(c2) > 0) & (F.col(c1) <= max1) & (F.col(c2) <= max2))
    return inside.groupBy(F.col(c1).alias("cnt1"), F.col(c2).alias("cnt2")).agg(F.count("*").alias("n"))


def gc_matrix(table: KmerTable, max_count: int = 1000) -> DataFrame:
    """gc, cnt, n: k-mers with so many g and c and this count."""
    df = table.df.where(F.col("cnt") <= max_count)
    return df.groupBy(gc_content(unpack(F.col("kmer"), table.k)).alias("gc"), "cnt").agg(F.count("*").alias("n"))


def axis_peak(cells: DataFrame, line: str, along: str, max_line: int, max_along: int) -> DataFrame:
    """pos, height: of all lines past their first descent from 2 on the last greatest cell; of equal heights the first line's. No row if there is no peak inside.

    Lines are dense: absent cells are 0. A matrix is small whatever its tables are."""
    spark = cells.sparkSession
    grid = spark.range(max_line + 1).select(F.col("id").alias("line")).crossJoin(spark.range(1, max_along + 1).select(F.col("id").alias("at")))
    full = grid.join(cells.select(F.col(line).cast("long").alias("line"), F.col(along).cast("long").alias("at"), "n"), ["line", "at"], "left").select("line", "at", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("line")
    full = full.withColumn("prev", F.lag("n").over(w.orderBy("at")))
    full = full.withColumn("begin", F.coalesce(F.min(F.when(F.col("n") >= F.col("prev"), F.col("at"))).over(w), F.lit(max_along)))
    best = full.where(F.col("at") >= F.col("begin")).groupBy("line").agg(F.max(F.struct("n", "at")).alias("b"))
    top = best.agg(F.max(F.struct(F.col("b.n").alias("n"), (-F.col("line")).alias("o"), F.col("b.at").alias("at"))).alias("p"))
    return top.where((F.col("p.n") > 0) & (F.col("p.at") < max_along)).select(F.col("p.at").alias("pos"), F.col("p.n").alias("height"))


def require_peak(peak: DataFrame) -> tuple[int, int]:
    row = peak.first()
    if row is None:
        raise ValueError("no peak away from the origin inside the matrix")
    return row["pos"], row["height"]


def smoothed(cells: DataFrame, row: str, col: str, rows: int, cols: int, peak: DataFrame) -> DataFrame:
    """row, col, n on the grid rows x cols: the mean of a cell and its three neighbours ahead, in whole numbers, no higher than the peak (one row, height).

    A filled cell adds to the four that see it, so only filled cells are moved."""
    spark = cells.sparkSession
    back = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("d")
    spread = cells.select(F.col(row).alias("r"), F.col(col).alias("c"), "n", back).select((F.col("r") - F.col("d.a")).alias("r"), (F.col("c") - F.col("d.b")).alias("c"), "n")
    sums = spread.where((F.col("r") >= 0) & (F.col("c") >= 0)).groupBy("r", "c").agg(F.sum("n").alias("s"))
    grid = spark.range(rows).select(F.col("id").alias("r")).crossJoin(spark.range(cols).select(F.col("id").alias("c")))
    out = grid.join(sums, ["r", "c"], "left").crossJoin(F.broadcast(peak.select("height")))
    return out.select(F.col("r").alias(row), F.col("c").alias(col), F.least(F.expr("coalesce(s, 0) div 4"), F.col("height")).cast("long").alias("n"))
