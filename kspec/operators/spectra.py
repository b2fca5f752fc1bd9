"""Copy-number and assembly spectra, over tables with a count column for each side (0: absent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .histogram import histogram

CN_CLASSES = ("read-only", "1", "2", "3", "4", ">4")
HIGH = 1000


def copy_class(asm: str) -> Column:
    a = F.col(asm)
    return F.when(a == 0, CN_CLASSES[0]).when(a > 4, CN_CLASSES[5]).otherwise(a.cast("string"))


def copy_order(asm: str) -> Column:
    return F.least(F.col(asm), F.lit(5)).cast("int")


def cn_spectrum(counts: DataFrame, reads: str, asm: str, cap: int = HIGH) -> DataFrame:
    """copies, class_ord, multiplicity, n_unique, n_instances: k-mers of the reads by copies in the assembly."""
    classed = counts.where(F.col(reads) > 0).select(copy_class(asm).alias("copies"), copy_order(asm).alias("class_ord"), F.col(reads).alias("cnt"))
    return histogram(classed, "cnt", cap, ("copies", "class_ord"))


def cn_zero(counts: DataFrame, reads: str, asm: str) -> DataFrame:
    """Instances in the assembly of k-mers that the reads lack, those of one copy apart."""
    only = counts.where((F.col(reads) == 0) & (F.col(asm) > 0))
    return only.groupBy(F.when(F.col(asm) == 1, "1").otherwise(">1").alias("copies")).agg(F.sum(asm).cast("long").alias("n_instances"))


def membership(a: str, b: str | None) -> Column:
    """Which assemblies hold the k-mer; the names are those of the columns."""
    if b is None:
        return F.when(F.col(a) > 0, a).otherwise("read-only")
    return F.when((F.col(a) > 0) & (F.col(b) > 0), "shared").when(F.col(a) > 0, f"{a}-only").when(F.col(b) > 0, f"{b}-only").otherwise("read-only")


def asm_spectrum(counts: DataFrame, reads: str, a: str, b: str | None = None, cap: int = HIGH) -> DataFrame:
    """class, multiplicity, n_unique, n_instances: k-mers of the reads by which assembly holds them, all classes in one pass."""
    classed = counts.where(F.col(reads) > 0).select(membership(a, b).alias("class"), F.col(reads).alias("cnt"))
    return histogram(classed, "cnt", cap, ("class",))


def asm_zero(counts: DataFrame, reads: str, a: str, b: str | None = None) -> DataFrame:
    """class, n_instances of assembly k-mers that the reads lack; a shared one counts in both."""
    both = F.col(a) + (F.col(b) if b else F.lit(0))
    only = counts.where((F.col(reads) == 0) & (both > 0))
    return only.groupBy(membership(a, b).alias("class")).agg(F.sum(both).cast("long").alias("n_instances"))


def plot_rows(spectrum: DataFrame, curve: str, order: str, x_limit: int) -> DataFrame:
    """curve, order, multiplicity, n: every bin up to the limit, zeros included, the top bin left out."""
    from .histogram import dense

    return dense(spectrum, "n_instances", (curve, order), HIGH).where((F.col("multiplicity") < HIGH) & (F.col("multiplicity") <= x_limit))
