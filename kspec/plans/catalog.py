"""The registered queries: the operators over the driver's tables, with documents as sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kspec.functions.kmer import part_count, unpack, windows
from kspec.operators import contour, hapmers, histogram, matrix, phasing, profile, spectra, stats
from kspec.operators.stored import SortedTable, joined_buckets, write_buckets
from kspec.operators.table import KmerTable, joint_counts
from kspec.plans import expressions
from kspec.sources import binary
from kspec.sources.sequences import chimeras, in_sequence, pseudo_dna, unbroken
from kspec.sources.shared import kept, shared_dir

K, LONG_K = 13, 40
#: Size of the genome of ng_curve.
GENOME = 5_000_000
#: Where the seek by key begins.
SEEK = "catcat" + "a" * 7
#: Which documents play which part where several tables are asked for; a query on one table takes all of them.
ROLES = {"mat": "seq_id % 8 in (0, 1, 2, 3)", "pat": "seq_id % 8 in (2, 3, 4, 5)", "child": "seq_id % 8 in (0, 1, 2, 3, 4, 5)", "asm1": "seq_id % 8 in (0, 1, 6)", "asm2": "seq_id % 8 in (4, 5, 7)"}
#: Limit of the smoothed matrices and of the peaks: the reference's, as of the plain matrices.
CELLS = 1000

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_dna(_docs(spark, sf_dir))


def _counts(spark: SparkSession, sf_dir: str, *roles: str) -> DataFrame:
    """kmer and a count for each of the roles, or for each role, and for all documents."""
    every = {**ROLES, "whole": "true"}
    return joint_counts(_seqs(spark, sf_dir), K, {r: every[r] for r in roles or every})


def _table(counts: DataFrame, role: str) -> KmerTable:
    return KmerTable.of(counts, F.col(role) > 0, F.col(role), K)


def _letters(df: DataFrame) -> DataFrame:
    return df.withColumn("kmer", unpack(F.col("kmer"), K))


def _decoded(df: DataFrame) -> DataFrame:
    return df.select(unpack(F.col("kmer"), K).alias("kmer"), "cnt")


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def _on_counts(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
    Q[name] = lambda spark, sf_dir: make(_counts(spark, sf_dir))


def _hist(c: DataFrame) -> DataFrame:
    return histogram.histogram(_table(c, "whole").df)


def _spectrum(c: DataFrame) -> DataFrame:
    """The copy-number spectrum, a row a bin and class, kept for what reads it again."""
    return kept(spectra.cn_spectrum(c, "child", "asm1"), "spectrum")


@query
def kmer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KmerTable.count(_seqs(spark, sf_dir), K).decoded()


@query
def kmer_table_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers of 40 bases, in two longs."""
    return KmerTable.count(_seqs(spark, sf_dir), LONG_K).decoded()


def _sorted(spark: SparkSession, sf_dir: str) -> SortedTable:
    return SortedTable.write(KmerTable.count(_seqs(spark, sf_dir), K), shared_dir(spark, "sorted"))


@query
def kmer_seek_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rows from the middle of the sorted table of all documents."""
    stored = _sorted(spark, sf_dir)
    return stored.from_ordinal(stored.count() // 2, 1000).select("ordinal", unpack(F.col("kmer"), K).alias("kmer"), "cnt")


@query
def kmer_seek_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rows of the sorted table of all documents from a key on, whether it has that key or not."""
    return _sorted(spark, sf_dir).from_key(SEEK, 1000).select("ordinal", unpack(F.col("kmer"), K).alias("kmer"), "cnt")


@query
def table_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two assemblies side by side, from tables in buckets."""
    seqs, n = _seqs(spark, sf_dir), part_count(_docs(spark, sf_dir))
    sides = []
    for role in ("asm1", "asm2"):
        path = shared_dir(spark, f"buckets-{role}")
        sides.append(write_buckets(KmerTable.count(seqs.where(ROLES[role]), K), path.rsplit("/", 1)[1].replace("-", "_"), path, n))
    return joined_buckets(*sides).select(unpack(F.col("kmer"), K).alias("kmer"), "cnt1", "cnt2")


@query
def kmer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers of the benchmark items that the documents have; there are few items, but their table is joined like any other."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    probes = windows(pseudo_dna(items), K).select("kmer").distinct()
    return _decoded(KmerTable.count(_seqs(spark, sf_dir), K).df.join(probes, "kmer", "left_semi"))


_on_counts("expression_copy_number", lambda c: expressions.histograms(c, expressions.COPY_NUMBER, ["asm1", "child"], 1000))
_on_counts("expression_one_assembly", lambda c: expressions.histograms(c, expressions.ONE_ASSEMBLY, ["asm1", "child"], 1000))
_on_counts("expression_two_assemblies", lambda c: expressions.histograms(c, expressions.TWO_ASSEMBLIES, ["asm1", "asm2", "child"], 1000))
_on_counts("expression_specific", lambda c: _letters(expressions.evaluate(c, expressions.SPECIFIC, ["mat", "pat"])))
_on_counts("expression_inherited", lambda c: _letters(expressions.evaluate(c, {"mat": "C&.(A-B)[2-]", "pat": "C&.(B-A)[3-]"}, ["mat", "pat", "child"])))
_on_counts("expression_solid", lambda c: expressions.histograms(c, expressions.solid(12), ["asm1", "asm2", "child"], 1))
_on_counts("kmer_hist", _hist)
_on_counts("kmer_hist_capped", lambda c: histogram.histogram(_table(c, "whole").df, cap=100))
_on_counts("kmer_hist_reranged", lambda c: histogram.rerange(_hist(c), 2, 50))
_on_counts("solid_threshold", lambda c: histogram.solid(kept(_hist(c), "hist")))
_on_counts("table_minus", lambda c: _table(c, "mat").minus(_table(c, "pat")).decoded())
_on_counts("table_semi", lambda c: _table(c, "child").intersect(_table(c, "asm1")).decoded())
_on_counts("table_semi_filtered", lambda c: _table(c, "child").intersect(_table(c, "asm1").between(2)).decoded())
_on_counts("table_inner_sum", lambda c: _table(c, "asm1").intersect(_table(c, "asm2"), "sum").decoded())
_on_counts("table_union_sum", lambda c: _table(c, "asm1").union(_table(c, "asm2")).decoded())
_on_counts("table_count_eq", lambda c: _table(c, "whole").between(3, 3).decoded())
_on_counts("table_count_ge", lambda c: _table(c, "whole").between(12).decoded())
_on_counts("cn_spectrum", lambda c: spectra.cn_spectrum(c, "child", "asm1"))
_on_counts("cn_zero", lambda c: spectra.cn_zero(c, "child", "asm1"))
_on_counts("asm_spectrum_1", lambda c: spectra.asm_spectrum(c, "child", "asm1"))
_on_counts("asm_spectrum_2", lambda c: spectra.asm_spectrum(c, "child", "asm1", "asm2"))
_on_counts("asm_zero", lambda c: spectra.asm_zero(c, "child", "asm1", "asm2"))
_on_counts("spectrum_plot", lambda c: spectra.plot_rows(_spectrum(c), "copies", "class_ord", spectra.HIGH))
_on_counts("primary_peak", lambda c: histogram.primary_peak(_spectrum(c), "copies", "class_ord"))
_on_counts("stacked_peak", lambda c: histogram.stacked_peak(_spectrum(c)))
_on_counts("stacked_limits", lambda c: histogram.stacked_limits(_spectrum(c)))
_on_counts("spectrum_peaks", lambda c: histogram.spectrum_peaks(_spectrum(c), "copies", "class_ord"))
_on_counts("axis_limits", lambda c: histogram.axis_limits(_spectrum(c), "copies", "class_ord"))
_on_counts("completeness", lambda c: stats.completeness(kept(c.select("child", "asm1", "asm2"), "counts"), "child", ["asm1", "asm2"]))
_on_counts("parent_completeness", lambda c: stats.parent_completeness(c, ["asm1", "asm2"], ["mat", "pat"]))
_on_counts("joint_matrix", lambda c: matrix.joint_matrix(c, "asm1", "asm2"))
_on_counts("gc_matrix", lambda c: matrix.gc_matrix(_table(c, "whole")))
_on_counts("gc_matrix_smoothed", lambda c: _smoothed_gc(c))
_on_counts("joint_matrix_smoothed", lambda c: _smoothed_joint(c))
_on_counts("matrix_peaks", lambda c: _peaks(kept(matrix.joint_matrix(c, "asm1", "asm2", CELLS, CELLS), "cells")))
for _parent, _other in (("mat", "pat"), ("pat", "mat")):
    _on_counts(f"specific_{_parent}", lambda c, p=_parent, o=_other: _decoded(hapmers.specific(c, p, o)))
    _on_counts(f"inherited_{_parent}", lambda c, p=_parent, o=_other: _decoded(hapmers.inherited(kept(hapmers.specific(c, p, o), "specific"))))
    _on_counts(f"hapmers_{_parent}", lambda c, p=_parent, o=_other: _decoded(hapmers.at_least_cutoff(hapmers.inherited(kept(hapmers.specific(c, p, o), "specific")))))


def _peaks(cells: DataFrame) -> DataFrame:
    x = matrix.axis_peak(cells, "cnt2", "cnt1", CELLS, CELLS).select(F.lit("cnt1").alias("axis"), "pos", "height")
    return x.unionByName(matrix.axis_peak(cells, "cnt1", "cnt2", CELLS, CELLS).select(F.lit("cnt2").alias("axis"), "pos", "height"))


def _smoothed_joint(c: DataFrame) -> DataFrame:
    cells = kept(matrix.joint_matrix(c, "asm1", "asm2", CELLS, CELLS), "cells")
    return matrix.smoothed(cells, "cnt1", "cnt2", CELLS, CELLS, _peaks(cells).agg(F.max("height").alias("height")).where("height is not null"))


_on_counts("contour_bands_6", lambda c: contour.bands(_smoothed_joint(c), "cnt1", "cnt2", 6))
_on_counts("contour_bands_12", lambda c: contour.bands(_smoothed_joint(c), "cnt1", "cnt2", 12))
_on_counts("contour_bands_gc", lambda c: contour.bands(_smoothed_gc(c), "gc", "cnt", 10))
_on_counts("contour_lines", lambda c: contour.lines(contour.segments(_smoothed_joint(c), "cnt1", "cnt2", 12)))


def _smoothed_gc(c: DataFrame) -> DataFrame:
    cells = kept(matrix.gc_matrix(_table(c, "whole"), CELLS), "cells")
    return matrix.smoothed(cells, "gc", "cnt", K, CELLS, matrix.axis_peak(cells, "gc", "cnt", K, CELLS))


@query
def relative_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.positions(_seqs(spark, sf_dir), _counts(spark, sf_dir, "whole", "child"), K, {"self_cnt": "whole", "read_cnt": "child"})


@query
def scaffold_qv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scaffold_quality(_seqs(spark, sf_dir), _counts(spark, sf_dir, "child"), K, "child")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assembly, seq_id, seq: a row for each of the two assemblies that a document is in."""
    sides = F.explode(F.array_compact(F.array(*[F.when(F.expr(ROLES[a]), F.lit(a)) for a in ("asm1", "asm2")])))
    return _seqs(spark, sf_dir).select(sides.alias("assembly"), "seq_id", "seq")


@query
def assembly_qv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.assembly_quality(_both(spark, sf_dir), _counts(spark, sf_dir, "child"), K, "child")


@query
def unsupported_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.unsupported(_seqs(spark, sf_dir), _counts(spark, sf_dir, "child"), K, "child")


@query
def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.contigs(_seqs(spark, sf_dir), K)


@query
def scaffold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, grp, size: valid positions of each scaffold, bases of each contig."""
    runs = contigs(spark, sf_dir)
    per = runs.groupBy("seq_id").agg(F.sum("n_pos").cast("long").alias("size")).select(F.lit("scaffold").alias("kind"), F.lit("all").alias("grp"), "size")
    return per.unionByName(runs.select(F.lit("contig").alias("kind"), F.lit("all").alias("grp"), "size"))


@query
def blob_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.blob_limit(hap_blob(spark, sf_dir))


_on_counts("max_bucket", lambda c: _table(c, "whole").max_bucket(6))


@query
def hap_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.blobs(_both(spark, sf_dir), _counts(spark, sf_dir, "mat", "pat"), K, "mat", "pat")


@query
def contig_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_stats(kept(contigs(spark, sf_dir).select("size"), "sizes"))


@query
def n_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = contigs(spark, sf_dir).select(F.lit("contig").alias("type"), "size")
    return stats.n_curve(sized, "type")


@query
def ng_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of contigs against a genome's size instead of their own sum."""
    sized = contigs(spark, sf_dir).select(F.lit("contig").alias("type"), "size")
    return stats.n_curve(sized, "type", GENOME)


@query
def plot_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis ends of a spectrum whose limits aren't given, with room for its zero lines."""
    counts = kept(_counts(spark, sf_dir).select("child", "asm1"), "counts")
    plot = spectra.plot_rows(_spectrum(counts), "copies", "class_ord", spectra.HIGH)
    return histogram.fallback_limits(plot.withColumnRenamed("copies", "class"), spectra.cn_zero(counts, "child", "asm1"))


@query
def binary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of all documents, written as a binary table of ranges and read back."""
    path = shared_dir(spark, "binary-table")
    table = KmerTable(kept(KmerTable.count(_seqs(spark, sf_dir), K).df, "counts"), K)  # dealing it by ranges reads it twice
    binary.write_table(table, path, parts=part_count(_docs(spark, sf_dir)))
    return binary.read_table(spark, path).decoded()


@query
def binary_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all documents up to 500, written as a binary file and read back."""
    path = shared_dir(spark, "binary-histogram")
    binary.write_histogram(_hist(_counts(spark, sf_dir)), path, K, 1, 500)
    return binary.read_histogram(spark, path, K)


@query
def binary_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the reads have the k-mer at each position of all documents, written as encoded profiles, sequences numbered in the order of their ids, and read back. Positions without a k-mer have 0."""
    docs, path = _docs(spark, sf_dir), shared_dir(spark, "binary-profiles")
    numbers = kept(in_sequence(docs.select(F.col("doc_id").alias("seq_id"))), "numbers")
    binary.write_sequences(pseudo_dna(docs), numbers, _counts(spark, sf_dir, "child"), path, K, "child", parts=part_count(docs))
    return binary.read_profiles(spark, path, "read_cnt", ids=numbers)


@query
def hap_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the chimeras, of one contig each; markers are one parent's k-mers that the other lacks."""
    docs = _docs(spark, sf_dir)
    counts = joint_counts(unbroken(docs).drop("doc_id"), K, {r: ROLES[r] for r in ("mat", "pat")})
    return phasing.sites_in(chimeras(docs).withColumn("contig", F.lit(0).cast("long")), counts.where("(mat > 0) != (pat > 0)"), K, ("seq_id", "contig"))


@query
def pure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.pure_blocks(hap_sites(spark, sf_dir))


@query
def phase_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a chimera has no breaks, so it is one contig from its first base to its last
    whole = unbroken(_docs(spark, sf_dir)).groupBy(F.expr("seq_id div 8").alias("seq_id")).agg(F.sum(F.length("seq")).cast("long").alias("size")).where(F.col("size") >= K)
    ends = whole.select("seq_id", F.lit(0).cast("long").alias("contig"), F.lit(0).cast("long").alias("beg"), "size")
    return phasing.phase_blocks(pure_blocks(spark, sf_dir), ends, K)


@query
def block_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.block_blob(kept(phase_blocks(spark, sf_dir), "blocks"))


@query
def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.phase_totals(phase_blocks(spark, sf_dir))


@query
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_stats(kept(phase_blocks(spark, sf_dir), "blocks"))
