"""The programs of the command line as functions over sequences or counted tables: each gives lazy tables by name.

A source is (name, sequences), sequences having seq_id and seq. Names must differ where two stand side by side. Where several tables come from one, such as counts or a profile, `once` is asked to hold it:
a function of the table and a name, which gives the table back, written if need be."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kspec.functions.kmer import gc_percent, windows
from kspec.operators import hapmers, histogram, matrix, phasing, profile, spectra, stats
from kspec.operators.table import KmerTable, joint_counts
from kspec.sources import tables

Source = tuple[str, DataFrame]
Once = Callable[[DataFrame, str], DataFrame]


def lazily(df: DataFrame, name: str) -> DataFrame:
    return df


def _distinct_names(*sources: Source) -> None:
    names = [n for n, _ in sources]
    if len(set(names)) < len(names):
        raise ValueError(f"two inputs have one name: {', '.join(names)}")


def counts_of(k: int, **sources: DataFrame | KmerTable) -> DataFrame:
    """kmer and a count for each source. Sequences are counted together, in one shuffle; counted tables, which must be of this k, join them by their keys."""
    if not k > 0:
        raise ValueError("k must be above 0")
    counted = {n: s for n, s in sources.items() if isinstance(s, KmerTable)}
    if wrong := [n for n, t in counted.items() if t.k != k]:
        raise ValueError(f"{', '.join(wrong)}: a table of another k than {k}")
    read = {n: s for n, s in sources.items() if n not in counted}
    rows = []
    if read:
        labelled = reduce(DataFrame.unionByName, [df.select("seq", F.lit(name).alias("role")) for name, df in read.items()])
        joint = joint_counts(labelled, k, {name: f"role = '{name}'" for name in read})
        if not counted:
            return joint
        rows.append(joint.select("kmer", *[(F.col(n) if n in read else F.lit(0).cast("long")).alias(n) for n in sources]))
    rows += [t.df.select("kmer", *[(F.col("cnt") if n == own else F.lit(0)).cast("long").alias(n) for n in sources]) for own, t in counted.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("kmer").agg(*[F.sum(n).alias(n) for n in sources])


def trio_hapmers(mat: DataFrame | KmerTable, pat: DataFrame | KmerTable, child: DataFrame | KmerTable, k: int, once: Once = lazily) -> dict[str, DataFrame]:
    counts = once(counts_of(k, mat=mat, pat=pat, child=child), "trio")
    return {"mat": hapmers.hapmers(counts, "mat", "pat"), "pat": hapmers.hapmers(counts, "pat", "mat")}


def copy_numbers(reads: DataFrame | KmerTable, asm: DataFrame | KmerTable, k: int, once: Once = lazily) -> dict[str, DataFrame]:
    counts = once(counts_of(k, reads=reads, asm=asm), "counts")
    return {"spectrum": spectra.cn_spectrum(counts, "reads", "asm"), "zero": spectra.cn_zero(counts, "reads", "asm")}


def assemblies(reads: DataFrame | KmerTable, asms: list[Source], k: int, once: Once = lazily) -> dict[str, DataFrame]:
    """Which of one or two assemblies holds the reads' k-mers; classes have the assemblies' names."""
    _distinct_names(*asms)
    counts = once(counts_of(k, reads=reads, **{f"asm{i + 1}": df for i, (_, df) in enumerate(asms)}), "counts")
    counts = counts.select("kmer", "reads", *[F.col(f"asm{i + 1}").alias(n) for i, (n, _) in enumerate(asms)])
    first, second = asms[0][0], asms[1][0] if len(asms) > 1 else None
    return {"spectrum": spectra.asm_spectrum(counts, "reads", first, second), "zero": spectra.asm_zero(counts, "reads", first, second)}


def plots(data: dict[str, DataFrame], curve: str, *, styles: list[str], zero: bool, xrel: float = 2.1, yrel: float = 1.1, xmax: int | None = None, ymax: int | None = None) -> dict[str, DataFrame]:
    """The data of a spectrum's plots, and for each style (ln, fl, st) its axis ends: line and filled plots by the tallest curve, stacked ones by the sum. With zero the zero lines too."""
    order = "class_ord" if curve == "copies" else "ord"
    spectrum = data["spectrum"] if curve == "copies" else data["spectrum"].withColumn(order, F.when(F.col("class") == "read-only", 0).when(F.col("class") == "shared", 3).otherwise(1))
    out = {"plot": tables.plot(spectra.plot_rows(spectrum, curve, order, spectra.HIGH), curve, order)}
    for style in styles:
        ends = histogram.stacked_limits(spectrum, spectra.HIGH, xrel, yrel) if style == "st" else histogram.axis_limits(spectrum, curve, order, spectra.HIGH, xrel, yrel)
        out[f"limits.{style}"] = ends.select((F.lit(xmax) if xmax else F.col("x_limit")).cast("long").alias("x_limit"), (F.lit(ymax) if ymax else F.col("y_limit")).cast("long").alias("y_limit"))
    if zero:
        out["zero"] = data["zero"].select(F.col(curve).alias("Copies"), F.lit(0).alias("kmer_multiplicity"), F.col("n_instances").alias("Count"))
    return out


def blob_plot(blobs: DataFrame, mat: str, pat: str) -> dict[str, DataFrame]:
    return {"blob": tables.blob(blobs, mat, pat), "limit": profile.blob_limit(blobs)}


def joint_plot(t1: DataFrame | KmerTable, t2: DataFrame | KmerTable, k: int, x: int = 1000, y: int = 1000, once: Once = lazily) -> dict[str, DataFrame]:
    """The joint matrix, and it smoothed, no higher than the greater peak of both axes; ValueError if either has none."""
    cells = once(matrix.joint_matrix(counts_of(k, a=t1, b=t2), "a", "b", x, y), "cells")
    peaks = [matrix.require_peak(matrix.axis_peak(cells, "cnt2", "cnt1", y, x)), matrix.require_peak(matrix.axis_peak(cells, "cnt1", "cnt2", x, y))]
    top = cells.sparkSession.range(1).select(F.lit(max(h for _, h in peaks)).alias("height"))
    return {"joint": cells, "smoothed": tables.matrix(matrix.smoothed(cells, "cnt1", "cnt2", x, y, top), "cnt1", "cnt2", ("KF1", "KF2"))}


def gc_plot(t: DataFrame | KmerTable, k: int, x: int = 1000, once: Once = lazily) -> dict[str, DataFrame]:
    """The GC matrix, and it smoothed; ValueError if it has no peak. label: the GC count in per cent of k."""
    cells = once(matrix.gc_matrix(t if isinstance(t, KmerTable) else KmerTable.count(t, k), x), "cells")
    _, height = matrix.require_peak(matrix.axis_peak(cells, "gc", "cnt", k, x))
    top = cells.sparkSession.range(1).select(F.lit(height).alias("height"))
    return {"gc": cells.withColumn("label", gc_percent(F.col("gc"), k)), "smoothed": tables.matrix(matrix.smoothed(cells, "gc", "cnt", k, x, top), "gc", "cnt", ("GCP", "KF"))}


def blob(mat_markers: DataFrame, pat_markers: DataFrame, asms: list[Source], k: int) -> DataFrame:
    """Contig blobs of one or two assemblies; markers: tables of kmer."""
    _distinct_names(*asms)
    return _blob(_marks(mat_markers, pat_markers), asms, k)


def _blob(marks: DataFrame, asms: list[Source], k: int) -> DataFrame:
    each = [profile.profile(windows(df, k, runs=True), marks, {"mat_cnt": "mat", "pat_cnt": "pat"}).withColumn("assembly", F.lit(n)) for n, df in asms]
    return profile.hap_blob(reduce(DataFrame.unionByName, each))


def _marks(mat_markers: DataFrame, pat_markers: DataFrame) -> DataFrame:
    """kmer, mat, pat (0 or 1)."""
    both = mat_markers.select("kmer", F.lit(1).alias("mat"), F.lit(0).alias("pat")).unionByName(pat_markers.select("kmer", F.lit(0).alias("mat"), F.lit(1).alias("pat")))
    return both.groupBy("kmer").agg(F.max("mat").alias("mat"), F.max("pat").alias("pat"))


def full(reads: DataFrame | KmerTable, asms: list[Source], k: int, markers: tuple[DataFrame, DataFrame] | None = None, once: Once = lazily) -> dict[str, DataFrame]:
    """Everything about one or two assemblies: QV, unsupported stretches, completeness, spectra, and with a trio's markers the parents' completeness, blobs and phase blocks."""
    if not 1 <= len(asms) <= 2:
        raise ValueError("one or two assemblies")
    _distinct_names(*asms)
    cols = [f"asm{i + 1}" for i in range(len(asms))]
    names = {c: n for c, (n, _) in zip(cols, asms, strict=True)}
    counts = once(counts_of(k, reads=reads, **{c: df for c, (_, df) in zip(cols, asms, strict=True)}), "counts")

    def own(df: DataFrame) -> DataFrame:
        """The assemblies' own names in place of asm1 and asm2."""
        return df.withColumn("assembly", F.coalesce(*[F.when(F.col("assembly") == c, n) for c, n in names.items()], F.col("assembly")))

    held = counts.select("kmer", "reads", *[F.col(c).alias(n) for c, n in names.items()])
    out = {"completeness": own(stats.completeness(counts, "reads", cols)), "assembly_spectrum": once(spectra.asm_spectrum(held, "reads", *names.values()), "assembly.spectrum"), "assembly_zero": spectra.asm_zero(held, "reads", *names.values())}
    profiles = []
    for c, (name, df) in zip(cols, asms, strict=True):
        p = once(profile.profile(windows(df, k), counts, {"read_cnt": "reads"}), f"{name}.profile")
        profiles.append(p.withColumn("assembly", F.lit(name)))
        out |= {f"{name}.spectrum": once(spectra.cn_spectrum(counts, "reads", c), f"{name}.spectrum"), f"{name}.zero": spectra.cn_zero(counts, "reads", c)}
        out |= {f"{name}.qv": profile.scaffold_qv(p, k), f"{name}.only_bed": profile.unsupported_bed(p, k)}
    out["qv"] = profile.assembly_qv(reduce(DataFrame.unionByName, profiles), k)
    if markers:
        marks = once(_marks(*markers), "markers")
        out["blob"] = once(_blob(marks, asms, k), "blob")
        marked = counts.join(marks, "kmer", "left").select(*cols, *[F.coalesce(m, F.lit(0)).alias(m) for m in ("mat", "pat")])
        out["parent_completeness"] = own(stats.parent_completeness(marked, cols, ["mat", "pat"]))
        for name, df in asms:
            positions = windows(df, k)
            p = profile.profile(positions, marks, {"mat_cnt": "mat", "pat_cnt": "pat"})
            contig_table = once(profile.contigs(df, k), f"{name}.contigs")
            sites = profile.located(phasing.sites_of(p, k, ("seq_id",)), contig_table)
            blocks = once(phasing.phase_blocks(phasing.pure_blocks(sites), contig_table, k), f"{name}.blocks")
            out |= {f"{name}.contigs": contig_table, f"{name}.phased_block": blocks, f"{name}.block_stats": stats.size_stats(blocks), f"{name}.block_totals": phasing.phase_totals(blocks)}
    return out


def files(found: dict[str, DataFrame], settings: dict, parents: tuple[str, str] = ("mat", "pat")) -> dict[str, DataFrame]:
    """The tables of full() as the files of a report: their columns, decimals and total rows, and the plots' data."""
    out: dict[str, DataFrame] = {}
    called = F.when(F.col("phase") == "mat", parents[0]).otherwise(parents[1])
    for name, df in found.items():
        root, _, kind = name.rpartition(".")
        if name == "qv":
            out[name] = tables.qv(df)
        elif kind == "qv":
            out[name] = tables.scaffold_qv(df)
        elif name == "completeness":
            own = found.get("parent_completeness")
            out["completeness.stats"] = tables.completeness(df, own if own is None else own.withColumn("parent", F.when(F.col("parent") == "mat", parents[0]).otherwise(parents[1])))
        elif name == "assembly_spectrum" or kind == "spectrum":
            zero = found["assembly_zero" if name == "assembly_spectrum" else f"{root}.zero"]
            out |= {f"{root or 'assembly'}.spectrum-{n}": t for n, t in plots({"spectrum": df, "zero": zero}, "class" if name == "assembly_spectrum" else "copies", **settings).items()}
        elif name == "blob":
            out |= {f"hapmers.{n}": t for n, t in blob_plot(df, *parents).items()}
        elif kind == "phased_block":
            out[name] = tables.phased_blocks(df.withColumn("phase", called), found[f"{root}.block_totals"])
            out[f"{root}.block_blob"] = tables.blob(phasing.block_blob(df.withColumn("phase", called)), *parents)
            out[f"{root}.sizes"] = tables.sizes(found[f"{root}.contigs"], root, df.withColumn("phase", called))
        elif kind == "block_stats":
            out[f"{root}.phased_block.stats"] = tables.block_stats(df)
        elif kind == "only_bed":
            out[name] = df.orderBy("seq_id", "beg")
    return out
