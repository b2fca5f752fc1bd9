"""Marker k-mers of a trio: specific to one parent, inherited by the child, reliable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .histogram import first_rise, histogram


def specific(counts: DataFrame, own: str, other: str) -> DataFrame:
    """kmer, cnt, child of one parent's k-mers that the other lacks."""
    return counts.where((F.col(own) > 0) & (F.col(other) == 0)).select("kmer", F.col(own).alias("cnt"), F.col("child"))


def at_least_cutoff(table: DataFrame) -> DataFrame:
    """Rows at or above the first bin of the table's own histogram that is above the one before; the cutoff stays in the plan as one row."""
    cut = first_rise(histogram(table), strict=True)
    return table.crossJoin(F.broadcast(cut)).where("cnt >= thresh").drop("thresh")


def inherited(specific_table: DataFrame) -> DataFrame:
    """Reliable specific k-mers that the child has, with the child's counts."""
    return at_least_cutoff(specific_table).where("child > 0").select("kmer", F.col("child").alias("cnt"))


def hapmers(counts: DataFrame, own: str, other: str) -> DataFrame:
    """kmer and cnt (in the child) of one parent's markers. counts: kmer and the columns own, other and child."""
    return at_least_cutoff(inherited(specific(counts, own, other)))
