"""The files that the programs write: column names, order and decimals of each, over the operators' results. Headers, labels and decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _decimals(value: Column, n: int) -> Column:
    """A number as text; what has no bound, such as the quality of an assembly without errors, is inf."""
    return F.when(value.isNull(), "inf").otherwise(F.format_string(f"%.{n}f", value))


def qv(df: DataFrame) -> DataFrame:
    """Assemblies, those of two together last."""
    rows = df.orderBy(F.col("assembly") == "both", "assembly")
    return rows.select(F.col("assembly").alias("Assembly"), F.col("miss").alias("No Support"), F.col("total").alias("Total"), _decimals(F.col("err_pct"), 4).alias("Error %"), _decimals(F.col("qv"), 1).alias("QV"))


def scaffold_qv(df: DataFrame) -> DataFrame:
    """Scaffolds in order, with their number in front, without which a row can't be told."""
    rows = df.orderBy("seq_id")
    return rows.select(F.col("seq_id").alias("Scaffold"), F.col("miss").alias("Assembly Only"), F.col("total").alias("Total"), _decimals(F.col("err_pct"), 4).alias("Error %"), _decimals(F.col("qv"), 1).alias("QV"))


def completeness(solid: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Region `all`: solid k-mers of the reads; region of a parent's name: the parent's markers."""
    rows = solid.select("assembly", F.lit("all").alias("region"), "found", "total", "pct", F.lit(0).alias("o"))
    if parents is not None:
        rows = rows.unionByName(parents.select("assembly", F.col("parent").alias("region"), "found", "total", "pct", F.lit(1).alias("o")))
    rows = rows.orderBy("o", F.col("assembly") == "both", "assembly", "region")
    return rows.select(F.col("assembly").alias("Assembly"), F.col("region").alias("Region"), F.col("found").alias("Found"), F.col("total").alias("Total"), _decimals(F.col("pct"), 2).alias("% Covered"))


def phased_blocks(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """Blocks in order, then a total."""
    rows = blocks.select(F.col("seq_id").cast("string").alias("Scaffold"), F.col("beg").cast("string").alias("Start"), F.col("end").cast("string").alias("End"), F.col("phase").alias("Phase"), "switch_pct", "switches", "markers", "seq_id", "contig", "block")
    none = [F.lit(None).cast("long").alias(c) for c in ("seq_id", "contig", "block")]
    total = totals.select(F.lit("total").alias("Scaffold"), F.lit("-t-").alias("Start"), F.lit("-").alias("End"), F.lit("").alias("Phase"), "switch_pct", "switches", "markers", *none)
    rows = rows.unionByName(total).orderBy(F.col("seq_id").isNull(), "seq_id", "contig", "block")
    return rows.select("Scaffold", "Start", "End", "Phase", _decimals(F.col("switch_pct"), 3).alias("Purity"), F.col("switches").alias("Switches"), F.col("markers").alias("Markers"))


def block_stats(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("n").alias("# Blocks"), F.col("total").alias("Sum"), F.col("min").alias("Min."), F.col("avg").alias("Avg."), F.col("n50").alias("N50"), F.col("max").alias("Max."))


def blob(df: DataFrame, mat: str, pat: str) -> DataFrame:
    """Contig blobs (assembly, contig) or block blobs (block, range); the columns of counts have the parents' names."""
    first = [F.col("assembly").alias("Assembly"), F.col("contig").alias("Contig")] if "assembly" in df.columns else [F.col("block").alias("Block"), F.col("range").alias("Range")]
    return df.select(*first, F.col("mat").alias(mat), F.col("pat").alias(pat), F.col("size").alias("Size"))


def plot(df: DataFrame, curve: str, order: str | None = None) -> DataFrame:
    """Curves (curve, multiplicity, n), each class together."""
    return df.orderBy(*([order] if order else []), curve, "multiplicity").select(F.col(curve).alias("Copies"), F.col("multiplicity").alias("kmer_multiplicity"), F.col("n").alias("Count"))


def sizes(contigs: DataFrame, assembly: str, blocks: DataFrame | None = None) -> DataFrame:
    """kind, group, size: valid positions of each scaffold, bases of each contig, bases of each phase block by its parent."""
    per = contigs.groupBy("seq_id").agg(F.sum("n_pos").cast("long").alias("size")).select(F.lit("scaffold").alias("kind"), F.lit(assembly).alias("grp"), "size")
    out = per.unionByName(contigs.select(F.lit("contig").alias("kind"), F.lit(assembly).alias("grp"), "size"))
    return out if blocks is None else out.unionByName(blocks.select(F.lit("block").alias("kind"), F.col("phase").alias("grp"), "size"))


def matrix(cells: DataFrame, row: str, col: str, names: tuple[str, str]) -> DataFrame:
    """Smoothed cells, named by their centres."""
    half = [F.concat(F.col(c).cast("string"), F.lit(".5")).alias(n) for c, n in zip((row, col), names, strict=True)]
    return cells.orderBy(row, col).select(*half, F.col("n").alias("Count"))
