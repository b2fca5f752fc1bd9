"""K-mer counts of sequences that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kspec.functions.kmer import windows


def streaming_counts(sequences: DataFrame, k: int) -> DataFrame:
    """kmer and cnt of a streaming table with column seq; write it in `complete` or `update` mode. The state is a row for each distinct k-mer, spread by k-mer."""
    return windows(sequences, k, (), positions=False).groupBy("kmer").agg(F.count("*").alias("cnt"))
