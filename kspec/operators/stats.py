"""Completeness, sizes, N50 and N-curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .histogram import histogram, solid


def completeness(counts: DataFrame, reads: str, asms: list[str]) -> DataFrame:
    """assembly, found, total, pct: solid k-mers of the reads that each assembly holds, and with two assemblies that either does (`both`). One pass over the counts."""
    in_reads = counts.where(F.col(reads) > 0)
    limit = solid(histogram(in_reads.select(F.col(reads).alias("cnt"))))
    held = {a: F.col(a) > 0 for a in asms}
    if len(asms) > 1:
        held["both"] = held[asms[0]] | held[asms[1]]
    found = in_reads.crossJoin(F.broadcast(limit)).where(F.col(reads) >= F.col("thresh")).groupBy("solid_count").agg(*[F.count_if(on).alias(a) for a, on in held.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("assembly"), F.col(a).alias("found")) for a in held])).alias("r")
    return found.select("solid_count", rows).select("r.assembly", "r.found", F.col("solid_count").alias("total"), (100.0 * F.col("r.found") / F.col("solid_count")).alias("pct"))


def parent_completeness(counts: DataFrame, asms: list[str], parents: list[str]) -> DataFrame:
    """assembly, parent, found, total, pct: an assembly's distinct k-mers that each parent has. Other tables of a parent's markers may be given in place of the full ones."""
    per = counts.agg(*[F.count_if(F.col(a) > 0).alias(f"{a}|") for a in asms], *[F.count_if((F.col(a) > 0) & (F.col(p) > 0)).alias(f"{a}|{p}") for a in asms for p in parents])
    rows = [F.struct(F.lit(a).alias("assembly"), F.lit(p).alias("parent"), F.col(f"{a}|{p}").alias("found"), F.col(f"{a}|").alias("total")) for a in asms for p in parents]
    out = per.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("total > 0")
    return out.withColumn("pct", 100.0 * F.col("found") / F.col("total"))


def size_stats(sizes: DataFrame) -> DataFrame:
    """n, total, min, avg, n50, max of column size; avg and half of the total are whole numbers. No row for no sizes."""
    whole = sizes.agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("total"), F.min("size").alias("min"), F.max("size").alias("max")).where("n > 0")
    # equal sizes are one row, so only different ones are put in order
    by_size = sizes.groupBy("size").agg(F.sum("size").alias("s"))
    run = by_size.withColumn("run", F.sum("s").over(Window.orderBy(F.desc("size")))).crossJoin(F.broadcast(whole))
    n50 = run.where(F.expr("run >= total div 2")).agg(F.max("size").alias("n50"))
    return whole.crossJoin(F.broadcast(n50)).select("n", "total", "min", F.expr("total div n").alias("avg"), "n50", "max")


def n_curve(sizes: DataFrame, by: str, genome: int | None = None) -> DataFrame:
    """by, size, cum, n, n2: sizes from the greatest down with the share of the total (or of a genome's size) that they reach, and the share before; equal sizes in one step each.

    A last row of size 0 lets a step line end. Only different sizes are put in order; equal ones become steps afterwards."""
    by_size = sizes.groupBy(by, F.col("size").cast("long").alias("size")).agg(F.count("*").alias("c"))
    mass = F.col("size") * F.col("c")
    order, whole = Window.partitionBy(by).orderBy(F.desc("size")), Window.partitionBy(by)
    upto = by_size.select(by, "size", "c", (F.sum(mass).over(order) - mass).alias("before"), F.sum(mass).over(whole).alias("all"))
    each = upto.select(by, "size", "all", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("nth"))
    steps = each.select(by, "size", "all", (F.col("before") + F.col("nth") * F.col("size")).alias("cum"))
    total = F.lit(float(genome)) if genome else F.col("all")
    steps = steps.select(by, "size", "cum", (100.0 * F.col("cum") / total).alias("n"), (100.0 * (F.col("cum") - F.col("size")) / total).alias("n2"))
    end = by_size.groupBy(by).agg(F.sum(mass).alias("cum")).withColumn("n", 100.0 * F.col("cum") / (total if genome else F.col("cum")))
    return steps.unionByName(end.select(by, F.lit(0).cast("long").alias("size"), "cum", "n", F.col("n").alias("n2")))
