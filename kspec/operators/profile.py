"""Profiles: counts of each position's k-mer, and what is derived from runs of positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from kspec.functions.kmer import MAX_DOUBLE, valid_runs, windows
from kspec.functions.minimizer import meet

if TYPE_CHECKING:
    import pyarrow as pa

#: Positions that are put in order together.
BLOCK = 1_000_000


def profile(positions: DataFrame, counts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """positions (kmer and others, such as seq_id and pos) with a count for each of columns (new name: column of counts), 0 where the table lacks the k-mer.

    One join for all tables. Adaptive execution splits a k-mer that fills a partition."""
    right = counts.select("kmer", *[F.col(c).alias(n) for n, c in columns.items()])
    return positions.join(right, "kmer", "left").select(*[c for c in positions.columns if c != "kmer"], *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in columns])


def _named(counts: DataFrame, columns: dict[str, str]) -> DataFrame:
    return counts.select("kmer", *[F.col(c).cast("long").alias(n) for n, c in columns.items()])


def _fields(sequences: DataFrame, keep: tuple[str, ...]) -> list[StructField]:
    return [StructField(c, sequences.schema[c].dataType) for c in keep]


def positions(sequences: DataFrame, counts: DataFrame, k: int, columns: dict[str, str], keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keep..., pos and a count for each of columns at each valid position of column seq: profile() of all windows. Up to MAX_DOUBLE bases no window is shuffled or joined as a row."""
    if k > MAX_DOUBLE:
        return profile(windows(sequences, k, keep), counts, columns)
    names = [*keep, "pos", *columns]

    def shape(own: list[pa.Array], beg: np.ndarray, n: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        of = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(of)) + np.repeat(beg - (np.cumsum(n) - n), n)
        yield pa.RecordBatch.from_arrays([*[x.take(pa.array(of)) for x in own], pa.array(pos.astype(np.int32)), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(columns))]], names=names)

    schema = StructType([*_fields(sequences, keep), StructField("pos", IntegerType()), *[StructField(c, LongType()) for c in columns]])
    return meet(sequences, _named(counts, columns), k, keep, shape, schema)


def part_runs(sequences: DataFrame, counts: DataFrame, k: int, columns: dict[str, str], gap: int, sums: dict[str, Callable], where: Callable | None = None, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keep..., __beg, __last and the sums (__s_ and the name): parts of runs of the positions that where chooses, each at most gap after the one before. A part lies in one stretch of windows with the same minimizer.

    where and sums take arrays by the names of columns, of each position's counts, and give one."""
    def shape(own: list[pa.Array], beg: np.ndarray, n: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        of = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(of)) + np.repeat(beg - (np.cumsum(n) - n), n)
        named = {c: found[:, i] for i, c in enumerate(columns)}
        if where is not None:
            at = np.flatnonzero(where(named))
            of, pos, named = of[at], pos[at], {c: x[at] for c, x in named.items()}
        if len(of):
            first = np.concatenate(([0], np.flatnonzero((np.diff(of) != 0) | (np.diff(pos) > gap)) + 1))
            last = np.append(first[1:], len(of)) - 1
            each = [np.add.reduceat(np.broadcast_to(f(named), len(of)).astype(np.int64), first) for f in sums.values()]
            yield pa.RecordBatch.from_arrays([*[x.take(pa.array(of[first])) for x in own], *[pa.array(x) for x in (pos[first], pos[last], *each)]], names=names)

    names = [*keep, "__beg", "__last", *[f"__s_{n}" for n in sums]]
    return meet(sequences, _named(counts, columns), k, keep, shape, StructType([*_fields(sequences, keep), *[StructField(c, LongType()) for c in names[len(keep) :]]]))


def stretched(sequences: DataFrame, counts: DataFrame, k: int, column: str, top: int, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keep..., pos and values: a column's counts, top at most, at the positions from pos on, as 16-bit numbers, a row for each stretch of windows with the same minimizer."""
    def shape(own: list[pa.Array], beg: np.ndarray, n: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        ends = pa.py_buffer(np.concatenate(([0], 2 * np.cumsum(n))).astype(np.int32))
        values = pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(np.minimum(found[:, 0], top).astype(np.uint16))])
        yield pa.RecordBatch.from_arrays([*own, pa.array(beg), values], names=[*keep, "pos", "values"])

    return meet(sequences, _named(counts, {column: column}), k, keep, shape, StructType([*_fields(sequences, keep), StructField("pos", LongType()), StructField("values", BinaryType())]))


def save_profiles(prof: DataFrame, path: str, k: int) -> None:
    """Profiles (seq_id, pos and counts) as Parquet with their k, sorted so that one sequence is read from few row groups."""
    prof.withColumn("k", F.lit(k)).repartitionByRange("seq_id", "pos").sortWithinPartitions("seq_id", "pos").write.mode("overwrite").parquet(path)


def load_profiles(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The profiles saved there; ValueError if they are of another k than the table they are used with."""
    df = spark.read.parquet(path)
    row = df.select("k").first()
    if row and row[0] != k:
        raise ValueError(f"the profiles at {path} have k = {row[0]}, not {k}")
    return df.drop("k")


def fetch_profile(profiles: DataFrame, seq_id: int, n_sequences: int) -> DataFrame:
    """pos and counts of one sequence in order; ValueError for an id that no sequence has."""
    if not 0 <= seq_id < n_sequences:
        raise ValueError(f"no sequence {seq_id}: there are {n_sequences}")
    return profiles.where(F.col("seq_id") == seq_id).drop("seq_id").orderBy("pos")


def quality_value(miss: F.Column, total: F.Column, k: int) -> tuple[F.Column, F.Column]:
    """Error in percent and QV; QV is null where nothing is missing."""
    err = 1 - F.pow(1 - miss / total, F.lit(1.0 / k))
    return (100 * err), F.when(miss > 0, -10 * F.log10(F.when(miss > 0, err)))


def scaffold_qv(prof: DataFrame, k: int) -> DataFrame:
    """seq_id, miss, total, err_pct, qv: positions that the reads don't support, of all valid ones."""
    return scored(prof.groupBy("seq_id").agg(F.count_if(F.col("read_cnt") == 0).alias("miss"), F.count("*").alias("total")), k)


def scaffold_quality(sequences: DataFrame, counts: DataFrame, k: int, reads: str) -> DataFrame:
    """scaffold_qv() of sequences by a column of counts; stretches of windows are summed before they are rows."""
    parts = part_runs(sequences, counts, k, {"read_cnt": reads}, 1, {"miss": lambda c: c["read_cnt"] == 0, "total": lambda c: 1})
    return scored(parts.groupBy("seq_id").agg(F.sum("__s_miss").alias("miss"), F.sum("__s_total").alias("total")), k)


def scored(sums: DataFrame, k: int) -> DataFrame:
    """seq_id, miss, total with err_pct and qv."""
    err, qv = quality_value(F.col("miss"), F.col("total"), k)
    return sums.select("seq_id", "miss", "total", err.alias("err_pct"), qv.alias("qv"))


def assembly_qv(prof: DataFrame, k: int) -> DataFrame:
    """assembly, miss, total, err_pct, qv, with a row `both` for the assemblies together if there are two."""
    return _with_both(prof.groupBy("assembly").agg(F.count_if(F.col("read_cnt") == 0).alias("miss"), F.count("*").alias("total")), k)


def assembly_quality(sequences: DataFrame, counts: DataFrame, k: int, reads: str) -> DataFrame:
    """assembly_qv() of sequences by a column of counts; stretches of windows are summed before they are rows."""
    parts = part_runs(sequences, counts, k, {"read_cnt": reads}, 1, {"miss": lambda c: c["read_cnt"] == 0, "total": lambda c: 1}, keep=("assembly",))
    return _with_both(parts.groupBy("assembly").agg(F.sum("__s_miss").alias("miss"), F.sum("__s_total").alias("total")), k)


def _with_both(sums: DataFrame, k: int) -> DataFrame:
    both = sums.agg(F.count("*").alias("c"), F.sum("miss").alias("miss"), F.sum("total").alias("total")).where("c > 1").select(F.lit("both").alias("assembly"), "miss", "total")
    err, qv = quality_value(F.col("miss"), F.col("total"), k)
    return sums.unionByName(both).select("assembly", "miss", "total", err.alias("err_pct"), qv.alias("qv"))


def runs(df: DataFrame, gap: int, by: tuple[str, ...] = ("seq_id",), sums: dict[str, F.Column] | None = None, pos: str = "pos") -> DataFrame:
    """by..., island (from 0), beg, last and the sums: runs of rows of which each is at most gap after the one before.

    Rows are put in order within blocks of BLOCK positions, and become runs there; only the runs, a few a block, are put in order along a whole sequence. So no task sorts a chromosome's positions."""
    sums = sums or {}
    block = F.floor(F.col(pos) / BLOCK).alias("__block")
    inner = Window.partitionBy(*by, "__block").orderBy("__pos")
    each = df.select(*by, F.col(pos).cast("long").alias("__pos"), block, *[c.alias(f"__s_{n}") for n, c in sums.items()])
    each = each.withColumn("__new", F.when(F.col("__pos") - F.lag("__pos").over(inner) > gap, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(inner))
    parts = each.groupBy(*by, "__block", "__run").agg(F.min("__pos").alias("__beg"), F.max("__pos").alias("__last"), *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums])
    return joined_runs(parts, gap, by, tuple(sums))


def joined_runs(parts: DataFrame, gap: int, by: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Runs from parts of runs (by..., __beg, __last, __s_ and the name of each sum): parts that are at most gap apart are one."""
    outer = Window.partitionBy(*by).orderBy("__beg")
    parts = parts.withColumn("__new", F.when(F.col("__beg") - F.lag("__last").over(outer) > gap, 1).otherwise(0)).withColumn("island", F.sum("__new").over(outer).cast("long"))
    return parts.groupBy(*by, "island").agg(F.min("__beg").alias("beg"), F.max("__last").alias("last"), *[F.sum(f"__s_{n}").cast("long").alias(n) for n in sums])


def unsupported_bed(prof: DataFrame, k: int) -> DataFrame:
    """seq_id, beg, end (half open) of stretches covered by k-mers that the reads lack; touching ones are one."""
    return runs(prof.where("read_cnt = 0"), k).select("seq_id", "beg", (F.col("last") + k).alias("end"))


def unsupported(sequences: DataFrame, counts: DataFrame, k: int, reads: str) -> DataFrame:
    """unsupported_bed() of sequences by a column of counts; only runs of unsupported positions are rows."""
    parts = part_runs(sequences, counts, k, {"read_cnt": reads}, k, {}, lambda c: c["read_cnt"] == 0)
    return joined_runs(parts, k, ("seq_id",), ()).select("seq_id", "beg", (F.col("last") + k).alias("end"))


def contigs(sequences: DataFrame, k: int, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """by..., contig (from 0 in each sequence), beg, n_pos, size (n_pos + k - 1) of maximal runs of valid positions.

    Each piece of a sequence gives its runs; those that meet at the edges of pieces are joined. No position is a row, so a sequence costs a row for each piece or contig."""
    parts = valid_runs(sequences, k, by).select(*by, F.col("beg").alias("__beg"), F.col("last").alias("__last"), (F.col("last") - F.col("beg") + 1).alias("__s_n_pos"))
    return joined_runs(parts, 1, by, ("n_pos",)).select(*by, F.col("island").alias("contig"), "beg", "n_pos", (F.col("n_pos") + k - 1).alias("size"))


def hap_blob(prof: DataFrame, by: tuple[str, ...] = ("assembly", "seq_id")) -> DataFrame:
    """by..., contig, mat, pat, size: positions of each contig with a maternal and with a paternal marker (a position may count in both), and all of them.

    prof: by..., run (see windows), mat_cnt, pat_cnt. Positions are summed by run, in any order, and only runs, one or some for each piece of a sequence, are put in order."""
    sums = {"mat": F.count_if(F.col("mat_cnt") > 0), "pat": F.count_if(F.col("pat_cnt") > 0), "size": F.count("*")}
    parts = prof.groupBy(*by, F.col("run").cast("long").alias("__beg")).agg(*[c.alias(f"__s_{n}") for n, c in sums.items()])
    parts = parts.withColumn("__last", F.col("__beg") + F.col("__s_size") - 1)
    return joined_runs(parts, 1, by, tuple(sums)).select(*by, F.col("island").alias("contig"), "mat", "pat", "size")


def blobs(sequences: DataFrame, counts: DataFrame, k: int, mat: str, pat: str, by: tuple[str, ...] = ("assembly", "seq_id")) -> DataFrame:
    """hap_blob() of sequences by two columns of counts; stretches of windows are summed before they are rows."""
    sums = {"mat": lambda c: c["mat"] > 0, "pat": lambda c: c["pat"] > 0, "size": lambda c: 1}
    parts = part_runs(sequences, counts, k, {"mat": mat, "pat": pat}, 1, sums, keep=by)
    return joined_runs(parts, 1, by, tuple(sums)).select(*by, F.col("island").alias("contig"), "mat", "pat", "size")


def blob_limit(blob: DataFrame) -> DataFrame:
    """One row, limit: both axes of a blob plot end at 1.01 times the greatest marker count."""
    return blob.agg((F.greatest(F.max("mat"), F.max("pat")) * 1.01).alias("limit"))


def located(places: DataFrame, contig_table: DataFrame, pos: str = "beg") -> DataFrame:
    """places (seq_id, pos and others) with the contig in which each lies: the last one that begins there or before. contig_table: seq_id, contig, beg."""
    names = [c for c in places.columns if c not in ("seq_id", pos)]
    starts = contig_table.select("seq_id", F.col("beg").alias(pos), F.col("contig").alias("__contig"), *[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in names], F.lit(0).alias("__place"))
    both = starts.unionByName(places.select("seq_id", pos, F.lit(None).cast("long").alias("__contig"), *names, F.lit(1).alias("__place")))
    seen = F.last("__contig", True).over(Window.partitionBy("seq_id").orderBy(pos, "__place"))
    return both.withColumn("contig", seen).where("__place = 1").drop("__contig", "__place")
