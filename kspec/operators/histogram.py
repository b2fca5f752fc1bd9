"""Histograms of counts, thresholds and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, cnt: str = "cnt", cap: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., multiplicity, n_unique, n_instances; from cap on all counts share the bin cap."""
    bin_no = F.least(F.col(cnt), F.lit(cap)) if cap else F.col(cnt)
    return df.groupBy(*by, bin_no.cast("long").alias("multiplicity")).agg(F.count("*").alias("n_unique"), F.sum(cnt).cast("long").alias("n_instances"))


def rerange(hist: DataFrame, low: int, high: int) -> DataFrame:
    """Bins below low and above high are folded into these two."""
    bin_no = F.greatest(F.lit(low), F.least(F.lit(high), F.col("multiplicity")))
    return hist.groupBy(bin_no.cast("long").alias("multiplicity")).agg(F.sum("n_unique").cast("long").alias("n_unique"), F.sum("n_instances").cast("long").alias("n_instances"))


def dense(hist: DataFrame, value: str = "n_unique", by: tuple[str, ...] = (), high: int | None = None) -> DataFrame:
    """by..., multiplicity from 1 to the greatest (or high), n: absent bins are 0. A histogram has one row a bin, so its bins are few."""
    top = hist.agg(F.max("multiplicity").alias("top")) if high is None else hist.sparkSession.range(1).select(F.lit(high).cast("long").alias("top"))
    bins = top.where("top >= 1").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("multiplicity"))
    if by:
        bins = bins.crossJoin(F.broadcast(hist.select(*by).distinct()))  # one row a curve
    return bins.join(hist, [*by, "multiplicity"], "left").select(*by, "multiplicity", F.coalesce(value, F.lit(0)).cast("long").alias("n"))


def first_rise(hist: DataFrame, strict: bool) -> DataFrame:
    """One row, thresh: the first bin above 1 that is not below the one before it (strict: above it), the last bin if there is none.

    Absent bins are 0, and none of them is made: of two neighbours in the histogram the later one rises above the bin before it, be that absent, and an absent bin rises, unless strict, if the one before is 0 too, which
    is so first two bins after a bin that isn't 0. So a histogram costs its own rows, whatever its greatest count is."""
    order = Window.orderBy("multiplicity")
    m, n = F.col("multiplicity"), F.col("n_unique")
    last_m, last_n = F.coalesce(F.lag("multiplicity").over(order), F.lit(0)), F.coalesce(F.lag("n_unique").over(order), F.lit(1))  # before bin 1 no bin is
    steps = hist.select(m, n, last_m.alias("m0"), last_n.alias("n0"))
    before = F.when(m - 1 == F.col("m0"), F.col("n0")).otherwise(F.lit(0))
    own = F.when((m > 1) & ((n > before) if strict else (n >= before)), m)
    empty = F.lit(None).cast("long") if strict else F.col("m0") + F.when((F.col("n0") == 0) & (F.col("m0") > 0), 1).otherwise(2)
    gap = F.when(empty < m, empty)
    return steps.agg(F.coalesce(F.min(F.least(own, gap)), F.max(m)).cast("long").alias("thresh")).where("thresh is not null")


def solid(hist: DataFrame) -> DataFrame:
    """thresh and solid_count, the number of distinct k-mers at or above it."""
    t = first_rise(hist, strict=False)
    return hist.crossJoin(F.broadcast(t)).where("multiplicity >= thresh").groupBy("thresh").agg(F.sum("n_unique").cast("long").alias("solid_count"))


def curve_peaks(hist: DataFrame, curve: str, order: str, high: int = 1000, value: str = "n_instances") -> DataFrame:
    """curve, xm, ym: past the first descent of each curve the last of its greatest bins below high."""
    bins = dense(hist, value, (curve, order), high).withColumn("prev", F.lag("n").over(Window.partitionBy(curve, order).orderBy("multiplicity")))
    whole = Window.partitionBy(curve, order)
    bins = bins.withColumn("from_k", F.coalesce(F.min(F.when(F.col("n") >= F.col("prev"), F.col("multiplicity"))).over(whole), F.lit(high)))
    past = bins.where(F.col("multiplicity") >= F.col("from_k")).where((F.col("multiplicity") < high) | (F.col("multiplicity") == F.col("from_k")))
    best = past.groupBy(curve, order).agg(F.max(F.struct("n", "multiplicity")).alias("b"))
    return best.select(curve, order, F.col("b.multiplicity").alias("xm"), F.col("b.n").alias("ym"))


def primary_peak(hist: DataFrame, curve: str, order: str, high: int = 1000) -> DataFrame:
    """xmax, ymax of the tallest curve; of equal ones the first."""
    peaks = curve_peaks(hist, curve, order, high)
    return peaks.agg(F.max(F.struct("ym", (-F.col(order)).alias("o"), "xm")).alias("p")).where("p is not null").select(F.col("p.xm").alias("xmax"), F.col("p.ym").alias("ymax"))


def stacked(hist: DataFrame) -> DataFrame:
    """The sum of all curves as one: curve `all`, class_ord 0."""
    sums = hist.groupBy("multiplicity").agg(F.sum("n_unique").cast("long").alias("n_unique"), F.sum("n_instances").cast("long").alias("n_instances"))
    return sums.select(F.lit("all").alias("curve"), F.lit(0).alias("class_ord"), "multiplicity", "n_unique", "n_instances")


def stacked_peak(hist: DataFrame, high: int = 1000) -> DataFrame:
    """xmax, ymax of stacked curves: past the first bin that is above the one before it the last of the greatest sums below high; without one high and the bin before it. No row for an empty histogram."""
    bins = dense(stacked(hist), "n_instances", ("curve", "class_ord"), high).withColumn("prev", F.lag("n").over(Window.partitionBy("curve").orderBy("multiplicity")))
    rise = F.min(F.when((F.col("n") > F.col("prev")) & (F.col("multiplicity") < high), F.col("multiplicity"))).over(Window.partitionBy("curve"))
    past = bins.withColumn("from_k", rise).where("multiplicity < %d and (from_k is null or multiplicity >= from_k)" % high)
    best = past.agg(F.max(F.struct("n", "multiplicity")).alias("b"), F.max("from_k").alias("k"), F.max(F.struct("multiplicity", "n")).alias("l")).where("l is not null")
    return best.select(F.when(F.col("k").isNull(), high).otherwise(F.col("b.multiplicity")).cast("long").alias("xmax"), F.when(F.col("k").isNull(), F.col("l.n")).otherwise(F.col("b.n")).alias("ymax"))


def spectrum_peaks(hist: DataFrame, curve: str, order: str, high: int = 1000, top: DataFrame | None = None) -> DataFrame:
    """xmax, ymax, xsec: xsec is the last local maximum right of xmax, of the last curve that has one, of at least a tenth of ymax; xmax if there is none.

    A local maximum ends a climb (not falling from the bin before) and the next bin falls, or high is reached."""
    top = primary_peak(hist, curve, order, high) if top is None else top
    order_by = Window.partitionBy(curve, order).orderBy("multiplicity")
    bins = dense(hist, "n_instances", (curve, order), high).withColumn("prev", F.lag("n").over(order_by)).withColumn("next", F.lead("n").over(order_by))
    joined = bins.crossJoin(F.broadcast(top))
    # A plateau climbs only if a rise led to it: the last change before decides.
    step = F.signum(F.col("n") - F.col("prev"))
    moved = joined.withColumn("trend", F.last(F.when(step != 0, step), True).over(order_by))
    maximum = (F.col("trend") > 0) & ((F.col("next") < F.col("n")) | (F.col("multiplicity") == high - 1)) & (F.col("multiplicity") > F.col("xmax")) & (F.col("multiplicity") < high) & (F.col("n") >= 0.1 * F.col("ymax"))
    sec = moved.where(maximum).agg(F.max(F.struct(order, "multiplicity")).alias("s"))
    return top.crossJoin(F.broadcast(sec)).select("xmax", "ymax", F.coalesce(F.col("s.multiplicity"), F.col("xmax")).alias("xsec"))


def stacked_limits(hist: DataFrame, high: int = 1000, xrel: float = 2.1, yrel: float = 1.1) -> DataFrame:
    """x_limit and y_limit of stacked curves, in proportion to the peaks of their sum."""
    peaks = spectrum_peaks(stacked(hist), "curve", "class_ord", high, stacked_peak(hist, high))
    return peaks.select(((F.col("xmax") + F.col("xsec")) * xrel / 2).cast("long").alias("x_limit"), (F.col("ymax") * yrel).cast("long").alias("y_limit"))


def fallback_limits(plot: DataFrame, zero: DataFrame | None = None, read_only: str = "read-only") -> DataFrame:
    """x_limit and y_limit for a plot (class, multiplicity, n) whose limits aren't given: 1.1 times the greatest count beyond multiplicity 3 of classes other than read-only, and 2.5 times
    its multiplicity; with zero lines (n_instances) y holds 1.1 times their sum at least."""
    top = plot.where((F.col("class") != read_only) & (F.col("multiplicity") > 3)).agg(F.max(F.struct("n", (-F.col("multiplicity")).alias("m"))).alias("p")).where("p is not null")
    out = top.select((F.col("p.m") * -2.5).alias("x_limit"), (F.col("p.n") * 1.1).alias("y_limit"))
    if zero is None:
        return out
    high = zero.agg((F.coalesce(F.sum("n_instances"), F.lit(0)) * 1.1).alias("z"))
    return out.crossJoin(F.broadcast(high)).select("x_limit", F.greatest("y_limit", "z").alias("y_limit"))


def save(hist: DataFrame, path: str, k: int) -> None:
    """A histogram as Parquet with its k."""
    hist.withColumn("k", F.lit(k)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """The histogram saved there; ValueError if it is of another k."""
    df = spark.read.parquet(path)
    row = df.select("k").first()
    if k is not None and row and row[0] != k:
        raise ValueError(f"the histogram at {path} has k = {row[0]}, not {k}")
    return df.drop("k")


def axis_limits(hist: DataFrame, curve: str, order: str, high: int = 1000, xrel: float = 2.1, yrel: float = 1.1, mass: float = 0.98) -> DataFrame:
    """x_limit and y_limit of a plot: in proportion to the peaks, x wide enough for 98 % of each curve whose peak is over 1 % of the y limit."""
    peaks = spectrum_peaks(hist, curve, order, high)
    base = peaks.select(((F.col("xmax") + F.col("xsec")) * xrel / 2).cast("long").alias("x0"), (F.col("ymax") * yrel).cast("long").alias("y_limit"))
    w = Window.partitionBy(curve, order)
    bins = dense(hist, "n_instances", (curve, order), high).where(F.col("multiplicity") < high)
    run = bins.select(curve, "multiplicity", F.sum("n").over(w.orderBy("multiplicity")).alias("upto"), F.floor(F.sum("n").over(w) * mass).alias("want"), F.max("n").over(w).alias("top"))
    wide = run.where("upto > want").groupBy(curve).agg(F.min("multiplicity").alias("x"), F.max("top").alias("top"))
    out = base.crossJoin(F.broadcast(wide)).where(F.col("top") > 0.01 * F.col("y_limit")).groupBy("x0", "y_limit").agg(F.max("x").alias("x"))
    return base.join(out, ["x0", "y_limit"], "left").select(F.greatest("x0", "x").alias("x_limit"), "y_limit")
