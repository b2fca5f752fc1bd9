"""python -m kspec.cli PROGRAM [flags] INPUTS... OUT: the programs over FASTA, FASTQ, SAM or BAM files and counted tables, each table a folder of TSV under OUT.

`count` writes a table of its input, OUT.ktab, and the table's histogram, OUT.hist; the other programs take such tables where they need counts only, so reads are counted once for all of them: every input of
hapmers, cn, asm, joint and gc, the reads and parents of report, and the markers (mat.ktab and pat.ktab, which hapmers writes under OUT) of blob. Within a run counts and profiles are written once, under OUT/work, for
all tables that come from them; the command line deletes them at its end.

Flags stand before or between the paths, with their values attached: -l -f -s line, filled and stacked plots (none: all three), -z zero lines, -k keep the plot's data, -v verbose, -pdf,
-w6.0 -h4.5 width and height, -x2.1 -y1.1 axis ends in proportion to the peaks, -X -Y axis ends as counts, -T threads, -P sort folder, -K21 length of k-mers (that of the tables, if there are any). Plots are not
drawn: their data, axis ends and settings are written. Threads and sort folders are Spark's matter; both flags are accepted and do nothing. `cn`, `asm` and `blob` with OUT alone plot again what an earlier run with -k
has kept under OUT; `report -k` keeps for them under OUT/ASSEMBLY.spectrum, OUT/assembly.spectrum and OUT/hapmers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import PurePath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kspec.operators import histogram
from kspec.operators.stored import SortedTable
from kspec.operators.table import KmerTable
from kspec.plans import report
from kspec.sources.alignments import read_bam, read_sam
from kspec.sources.sequences import keep, read_fasta, read_fastq, write_bed, write_tsv

#: Inputs of each program, least and most, and its flags.
PROGRAMS = {
    "count": (1, 1, "vTKP"),
    "hapmers": (3, 3, "vTK"), "cn": (2, 2, "vklfszwhxXyYpTPK"), "asm": (2, 3, "vklfszwhxXyYpTPK"), "blob": (3, 4, "vkwhpTPK"),
    "report": (2, 5, "vklfszwhxXyYpTPK"), "joint": (2, 2, "lfswhxXyYpTK"), "gc": (1, 1, "lfswhxXpTK"),
}
REPLOT = ("cn", "asm", "blob")
#: Inputs, by their places, that have to be sequences: those whose positions are looked at.
SEQUENCES = {"count": slice(0, 1), "blob": slice(2, None)}
TABLE = ".ktab"
REALS, POSITIVE, WHOLE = {"w": 6.0, "h": 4.5, "x": 2.1, "y": 1.1}, "xy", "XYTK"


@dataclass
class Flags:
    on: set[str] = field(default_factory=set)
    reals: dict[str, float] = field(default_factory=lambda: dict(REALS))
    whole: dict[str, int] = field(default_factory=dict)

    @property
    def styles(self) -> list[str]:
        return [n for n, f in (("ln", "l"), ("fl", "f"), ("st", "s")) if f in self.on] or ["ln", "fl", "st"]


def parse(argv: list[str]) -> tuple[str, Flags, list[str]]:
    """Program, flags and paths; ValueError for what the program doesn't know or a value that isn't one."""
    if not argv or argv[0] not in PROGRAMS:
        raise ValueError(f"the first argument is one of {', '.join(sorted(PROGRAMS))}")
    program, flags, paths = argv[0], Flags(), []
    known = PROGRAMS[program][2]
    for a in argv[1:]:
        letter, value = a[1:2], a[2:]
        if not a.startswith("-"):
            paths.append(a)
        elif letter in known and letter == "p":
            if value != "df":
                raise ValueError(f"{a}: -pdf is all that begins with -p")
            flags.on.add("pdf")
        elif letter in known and letter == "P":
            continue
        elif letter in known and letter in REALS:
            try:
                flags.reals[letter] = float(value)
            except ValueError:
                raise ValueError(f"{a}: a number has to follow -{letter}") from None
            if letter in POSITIVE and not flags.reals[letter] > 0:
                raise ValueError(f"{a}: the factor after -{letter} has to be above 0")
        elif letter in known and letter in WHOLE:
            if not re.fullmatch(r"[+-]?[0-9]+", value):
                raise ValueError(f"{a}: a whole number has to follow -{letter}")
            flags.whole[letter] = int(value)
            if flags.whole[letter] <= 0:
                raise ValueError(f"{a}: the number after -{letter} has to be above 0")
        else:
            for c in a[1:] or "-":
                if c not in known or c not in "vklfsz":
                    raise ValueError(f"{a}: {program} has no flag -{c}")
                flags.on.add(c)
    return program, flags, paths


def root_name(path: str) -> str:
    return re.sub(r"\.(ktab|bam|sam)$|\.(fa|fasta|fq|fastq)?(\.gz)?$", "", PurePath(path).name)


def _read(spark: SparkSession, path: str) -> DataFrame | SortedTable:
    if path.rstrip("/").endswith(TABLE):
        try:
            return SortedTable.open(spark, path)
        except AnalysisException as e:
            raise ValueError(f"no table at {path}") from e
    if m := re.search(r"\.(bam|sam)$", path):
        return (read_bam if m[1] == "bam" else read_sam)(spark, path)
    return read_fastq(spark, path) if re.search(r"\.(fq|fastq)(\.gz)?$", path) else read_fasta(spark, path)


def _kept(spark: SparkSession, program: str, out: str) -> dict[str, DataFrame]:
    names = {"cn": ("spectrum", "zero"), "asm": ("spectrum", "zero"), "blob": ("blob",)}[program]
    try:
        return {n: spark.read.parquet(f"{out}/kept/{n}") for n in names}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"nothing is kept under {out}") from e


def _keep(data: dict[str, DataFrame], folder: str) -> None:
    for name, df in data.items():
        df.write.mode("overwrite").parquet(f"{folder}/kept/{name}")


def _keep_report(found: dict[str, DataFrame], out: str) -> None:
    """A report's spectra and blobs, each where the program that plots it again looks."""
    for name, df in found.items():
        root = "assembly" if name == "assembly_spectrum" else name.removesuffix(".spectrum")
        if name == "blob":
            _keep({"blob": df}, f"{out}/hapmers")
        elif root != name:
            _keep({"spectrum": df, "zero": found["assembly_zero" if name == "assembly_spectrum" else f"{root}.zero"]}, f"{out}/{root}.spectrum")


def run(spark: SparkSession, argv: list[str]) -> dict[str, DataFrame]:
    """Writes a program's tables and returns them by name."""
    program, flags, paths = parse(argv)
    if not paths:
        raise ValueError("no output is named")
    *inputs, out = paths
    least, most, _ = PROGRAMS[program]
    again = not inputs and program in REPLOT
    if again and "k" in flags.on:
        raise ValueError("-k has no meaning for data that are kept already")
    if not again and not least <= len(inputs) <= most:
        raise ValueError(f"{program} takes {least} to {most} inputs")
    names = [root_name(p) for p in inputs]
    if len(set(names)) < len(names):
        raise ValueError(f"two inputs have one name: {', '.join(names)}")
    given = [_read(spark, p) for p in inputs]
    stored = [t for t in given if isinstance(t, SortedTable)]
    for path, t in list(zip(inputs, given, strict=True))[SEQUENCES.get(program, slice(1 if len(inputs) < 4 else 3, None) if program == "report" else slice(0, 0))]:
        if isinstance(t, SortedTable):
            raise ValueError(f"{path}: sequences are needed here, not a table")
    ks = {t.k for t in stored} | ({flags.whole["K"]} if "K" in flags.whole else set())
    if len(ks) > 1:
        raise ValueError(f"tables and -K of different k: {', '.join(map(str, sorted(ks)))}")
    k = ks.pop() if ks else 21
    seqs: list[DataFrame | KmerTable] = [t.table() if isinstance(t, SortedTable) else t for t in given]
    named = list(zip(names, seqs, strict=True))
    settings = {"styles": flags.styles, "zero": "z" in flags.on, "xrel": flags.reals["x"], "yrel": flags.reals["y"], "xmax": flags.whole.get("X"), "ymax": flags.whole.get("Y")}

    def once(df: DataFrame, name: str) -> DataFrame:
        return keep(df, f"{out}/work/{name}")

    if program == "count":
        table = SortedTable.write(KmerTable.count(seqs[0], k), out + TABLE).table()
        histogram.save(histogram.histogram(table.df), f"{out}.hist", k)
        return {"table": table.df, "hist": histogram.load(spark, f"{out}.hist", k)}
    if program == "hapmers":
        found = report.trio_hapmers(*seqs, k, once)
        tables = {n: SortedTable.write(KmerTable(df, k), f"{out}/{n}{TABLE}").table().decoded() for n, df in found.items()}
    elif program in ("cn", "asm"):
        if again:
            data = _kept(spark, program, out)
        else:
            data = report.copy_numbers(*seqs, k, once) if program == "cn" else report.assemblies(seqs[0], named[1:], k, once)
            data["spectrum"] = once(data["spectrum"], "spectrum")
        tables = report.plots(data, "copies" if program == "cn" else "class", **settings)
    elif program == "blob":
        if again:
            data = _kept(spark, program, out)
        else:
            marks = [s.df if isinstance(s, KmerTable) else None for s in seqs[:2]]
            if None in marks and any(m is not None for m in marks):
                raise ValueError("both parents are sequences, or both are tables of markers")
            if None in marks:
                m = once(report.counts_of(k, mat=seqs[0], pat=seqs[1]), "counts")
                marks = [m.where("mat > 0 and pat = 0"), m.where("pat > 0 and mat = 0")]
            data = {"blob": once(report.blob(*marks, named[2:], k), "blob")}
        tables = report.blob_plot(data["blob"], *(names[:2] if inputs else ("mat", "pat")))
    elif program == "report":
        if len(inputs) < 4:
            found = report.full(seqs[0], named[1:], k, once=once)
            tables = report.files(found, settings)
        else:  # reads, mother, father, one or two assemblies
            h = report.trio_hapmers(seqs[1], seqs[2], seqs[0], k, once)
            found = report.full(seqs[0], named[3:], k, (h["mat"], h["pat"]), once)
            tables = report.files(found, settings, (names[1], names[2]))
        if "k" in flags.on:
            _keep_report(found, out)
    elif program == "joint":
        tables = report.joint_plot(*seqs, k, flags.whole.get("X", 1000), flags.whole.get("Y", 1000), once)
    else:
        tables = report.gc_plot(seqs[0], k, flags.whole.get("X", 1000), once)
    if "k" in flags.on and program in REPLOT:
        _keep(data, out)
    drawn = {"width": flags.reals["w"], "height": flags.reals["h"], "pdf": "pdf" in flags.on, "k": k}
    tables["settings"] = spark.range(1).select(*[F.lit(v).alias(n) for n, v in drawn.items()])
    for name, df in tables.items():
        (write_bed if name.endswith("only_bed") else write_tsv)(df, f"{out}/{name}")
        if "v" in flags.on:
            print(f"wrote {out}/{name}")
    return tables


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("kspec").getOrCreate()
    try:
        run(spark, sys.argv[1:])
        _delete(spark, f"{sys.argv[-1]}/work")
    except ValueError as e:
        sys.exit(f"kspec: {e}")


if __name__ == "__main__":
    main()
