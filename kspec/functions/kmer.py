"""K-mer expressions: canonical form, packing, GC content, and the windows of sequences.

Windows of packed k-mers are made in numpy, a few steps for a million at a time: as string expressions each window costs some microseconds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

if TYPE_CHECKING:
    import pyarrow as pa

#: Anything but these letters breaks a sequence.
BASES = "acgt"
BREAK = "-"
#: Bases of a chunk, of packed k-mers and of longer ones. A chunk overlaps the next by k - 1, so chunks are independent, and those of one long sequence go to many tasks.
CHUNK, LONG_K_CHUNK = 1 << 14, 512
#: Windows that are packed together, and in one step.
GROUP, SLICE = 1 << 20, 1 << 15
#: Rows of sequences, or pieces of them, that are taken out of a batch together.
BATCH = 512
#: Longest k-mer whose two bits a base fit a signed long, and longest that fits two: hi holds what is before the last MAX_PACKED bases, lo those.
MAX_PACKED, MAX_DOUBLE = 31, 62
#: Bytes of sequences for a task of the scan to be busy with.
TASK_BYTES = 64 << 20
#: Bytes of files, on an average, that Spark's scan doesn't put together to a few tasks.
FILE_BYTES = 16 << 20


def reverse_complement(w: Column) -> Column:
    return F.reverse(F.translate(w, "acgt", "tgca"))


def canonical(w: Column) -> Column:
    """A k-mer and its reverse complement are one; the lexicographically smaller stands for both."""
    return F.least(w, reverse_complement(w))


def _digits(w: Column) -> Column:
    return F.conv(F.translate(w, "acgt", "0123"), 4, 10).cast("long")


def _letters(key: Column, k: int) -> Column:
    return F.translate(F.lpad(F.lower(F.conv(key.cast("string"), 10, 4)), k, "0"), "0123", "acgt")


def pack(w: Column, k: int) -> Column:
    """Two bits a base, a = 0 to t = 3, first base highest, in a long, or in a struct of two; still longer k-mers stay strings. Order is that of the strings."""
    if k <= MAX_PACKED:
        return _digits(w)
    if k > MAX_DOUBLE:
        return w
    rest = k - MAX_PACKED
    return F.struct(_digits(F.substring(w, 1, rest)).alias("hi"), _digits(F.substring(w, rest + 1, MAX_PACKED)).alias("lo"))


def unpack(key: Column, k: int) -> Column:
    if k <= MAX_PACKED:
        return _letters(key, k)
    return key if k > MAX_DOUBLE else F.concat(_letters(key["hi"], k - MAX_PACKED), _letters(key["lo"], MAX_PACKED))


def gc_content(w: Column) -> Column:
    return F.length(F.translate(w, "at", "")).cast("int")


def gc_percent(gc: Column, k: int) -> Column:
    """The label of a GC count: per cent of k, cut off."""
    return F.floor(100 * gc / k).cast("int")


def cleaned(sequence: Column) -> Column:
    """Lower case; every letter that is no base becomes a break."""
    return F.regexp_replace(F.lower(sequence), "[^acgt]", BREAK)


def codes(bases: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two-bit codes of bases, any for other bytes; and, for each place, how many other bytes are before it."""
    lookup = np.full(256, 4, dtype=np.uint8)
    lookup[np.frombuffer(BASES.encode(), dtype=np.uint8)] = np.arange(4)
    code = lookup[np.frombuffer(bases, dtype=np.uint8)]
    return code & 3, np.concatenate(([0], np.cumsum(code == 4)))


def directed_keys(code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys of the windows of length <= MAX_PACKED bases at each place, and of their reverse complements.

    Keys of twice the length are put together from two keys, so a window takes a few steps for each doubling, for all windows at once."""
    forward, backward, size = code, 3 - code, 1
    whole_f = whole_b = np.zeros(len(code), dtype=code.dtype)
    done = 0
    while True:
        if length & size:  # this size's keys follow what has been put together
            m = len(code) - done - size + 1
            whole_b = whole_b[:m] | backward[done : done + m] << 2 * done
            whole_f = whole_f[:m] << 2 * size | forward[done : done + m]
            done += size
        if done == length:
            return whole_f, whole_b
        forward, backward = forward[:-size] << 2 * size | forward[size:], backward[:-size] | backward[size:] << 2 * size
        size *= 2


def by_slices(code: np.ndarray, k: int, make: Callable[[np.ndarray, int], tuple[np.ndarray, ...]], dtype: type = np.int64) -> tuple[np.ndarray, ...]:
    """make(code, k), which gives arrays of a number for each window of k bases, slice by slice, so that its steps stay in the processor's cache."""
    found = [make(code[at : at + SLICE + k - 1].astype(dtype), k) for at in range(0, max(len(code) - k + 1, 1), SLICE)]
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def canonical_keys(code: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Canonical keys of the windows at each place, as pack() writes them: one array, or those of hi and of lo."""
    return by_slices(code, k, _canonical_keys)


def _canonical_keys(code: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Windows of more than MAX_PACKED bases are two, and swap places when they are turned round."""
    if k <= MAX_PACKED:
        return (np.minimum(*directed_keys(code, k)),)
    rest, n = k - MAX_PACKED, len(code) - k + 1
    (short_f, short_b), (long_f, long_b) = directed_keys(code, rest), directed_keys(code, MAX_PACKED)
    hi_f, lo_f, hi_b, lo_b = short_f[:n], long_f[rest : rest + n], short_b[MAX_PACKED : MAX_PACKED + n], long_b[:n]
    as_is = (hi_f < hi_b) | (hi_f == hi_b) & (lo_f <= lo_b)
    return np.where(as_is, hi_f, hi_b), np.where(as_is, lo_f, lo_b)


def key_type(k: int) -> DataType:
    return LongType() if k <= MAX_PACKED else StructType([StructField("hi", LongType()), StructField("lo", LongType())])


def key_array(keys: tuple[np.ndarray, ...]) -> pa.Array:
    """Keys as a column of key_type."""
    import pyarrow as pa

    each = [pa.array(np.ascontiguousarray(x)) for x in keys]
    return each[0] if len(each) == 1 else pa.StructArray.from_arrays(each, names=["hi", "lo"])


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is read from, by Spark's own statistics; what has none, such as rows given by the driver or a stream, counts as nothing."""
    if df.isStreaming:
        return 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def part_count(df: DataFrame) -> int:
    """Partitions for what is shuffled of df: as many as the session sets, and more if one of them would get more than TASK_BYTES of the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // TASK_BYTES))


def file_count(df: DataFrame) -> int:
    """Files that df is read from: the scan has as many tasks with rows at least, in groups of small files."""
    return 0 if df.isStreaming else len(df.inputFiles())


def chunked(sequences: DataFrame, k: int, keep: tuple[str, ...], size: int, parts: int | None = None) -> DataFrame:
    """keep..., start, part: pieces of column seq of size windows each, in bytes.

    Pieces are dealt to all tasks (parts, if given), so neither few input files nor one long sequence keep the work in one place - unless there are so many bytes, or files of some size, that the scan has tasks for
    each core anyway: dealing writes every base to disk."""
    # bytes, not characters: the n-th byte is found without walking there, so a long sequence costs no square of its length
    raw = F.encode("seq", "UTF-8")
    chunk = F.explode(F.sequence(F.lit(0), ((F.octet_length("seq") - k) / F.lit(size)).cast("int")))
    chunks = sequences.where(F.octet_length("seq") >= k).select(*keep, raw.alias("raw"), chunk.alias("c"))
    chunks = chunks.select(*keep, (F.col("c") * size).alias("start"), F.substring("raw", F.col("c") * size + 1, F.lit(size + k - 1)).alias("part"))
    spark, every = sequences.sparkSession, part_count(sequences)
    cores = spark.sparkContext.defaultParallelism
    if every > 4 * max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))) or file_count(sequences) >= (least := 4 * cores) and input_bytes(sequences) >= least * FILE_BYTES:
        return chunks
    return chunks.repartition(parts or every)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, so few together that what is made of them is small beside the batch they came in."""
    return (batch.slice(at, BATCH) for batch in batches for at in range(0, len(batch), BATCH))


def grouped(parts: list[bytes], size: int = GROUP) -> Iterator[np.ndarray]:
    """Numbers of the pieces that are packed together, of size bytes or so."""
    ends = np.cumsum(np.array([len(x) + 1 for x in parts], dtype=np.int64))  # with a break behind each
    return (rows for rows in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(ends // size)) + 1) if len(rows))


def run_starts(at: np.ndarray) -> np.ndarray:
    """Numbers of the windows that don't follow the one before; pieces have a break between them."""
    return np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1)) if len(at) else np.zeros(0, dtype=np.int64)


def windows(sequences: DataFrame, k: int, keep: tuple[str, ...] = ("seq_id",), *, positions: bool = True, runs: bool = False) -> DataFrame:
    """keep..., pos (unless positions is false), kmer (packed if it fits) for each valid window of column seq. A sequence shorter than k, empty or null gives none.

    runs: run in place of pos, the position at which the windows begin that follow each other up to this one within its piece of the sequence."""
    chunks = chunked(sequences, k, keep, CHUNK if k <= MAX_DOUBLE else LONG_K_CHUNK)
    place = ("run",) if runs else ("pos",) if positions else ()
    if k > MAX_DOUBLE:
        each = chunks.withColumn("part", F.decode("part", "UTF-8"))
        each = each.select(*keep, "start", "part", F.explode(F.sequence(F.lit(0), F.length("part") - k)).alias("i"))
        each = each.select(*keep, (F.col("start") + F.col("i")).cast("int").alias("pos"), F.substring("part", F.col("i") + 1, F.lit(k)).alias("w"))
        if runs:
            row = Window.partitionBy(*keep, "start").orderBy("pos")
            first = F.when(F.col("pos") - F.lag("pos").over(row) == 1, None).otherwise(F.col("pos"))
            each = each.where(~F.col("w").contains(BREAK)).withColumn("first", first).withColumn("run", F.last("first", True).over(row))
        return each.where(~F.col("w").contains(BREAK)).select(*keep, *place, canonical(F.col("w")).alias("kmer"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            parts, starts = batch.column(len(keep) + 1).to_pylist(), batch.column(len(keep)).to_numpy()
            for rows in grouped(parts):
                joined = [parts[i] for i in rows]
                begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in joined])[:-1]))
                code, broken = codes(b"-".join(joined))
                at = np.flatnonzero(broken[k:] == broken[:-k])
                row = np.searchsorted(begin, at, side="right") - 1
                held = [batch.column(i).take(pa.array(rows[row])) for i in range(len(keep))]
                if place:
                    pos = (starts[rows[row]] + at - begin[row]).astype(np.int32)
                    if runs:
                        first = run_starts(at)
                        pos = np.repeat(pos[first], np.diff(np.append(first, len(at))))
                    held.append(pa.array(pos))
                yield pa.RecordBatch.from_arrays([*held, key_array(tuple(x[at] for x in canonical_keys(code, k)))], names=[*keep, *place, "kmer"])

    fields = [StructField(c, sequences.schema[c].dataType) for c in keep] + [StructField(c, IntegerType()) for c in place]
    return chunks.mapInArrow(emit, StructType([*fields, StructField("kmer", key_type(k))]))


def valid_runs(sequences: DataFrame, k: int, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keep..., beg, last: first and last position of the valid windows that follow each other within a piece of a sequence. What goes over the edges of pieces is still in parts: the last run of a piece and the
    first of the next."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            parts, starts = batch.column(len(keep) + 1).to_pylist(), batch.column(len(keep)).to_numpy()
            for rows in grouped(parts):
                joined = [parts[i] for i in rows]
                begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in joined])[:-1]))
                _, broken = codes(b"-".join(joined))
                at = np.flatnonzero(broken[k:] == broken[:-k])
                first = run_starts(at)
                beg, n = at[first], np.diff(np.append(first, len(at)))
                row = np.searchsorted(begin, beg, side="right") - 1
                pos = starts[rows[row]].astype(np.int64) + beg - begin[row]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(rows[row])) for i in range(len(keep))], pa.array(pos), pa.array(pos + n - 1)], names=[*keep, "beg", "last"])

    fields = [StructField(c, sequences.schema[c].dataType) for c in keep]
    return chunked(sequences, k, keep, CHUNK).mapInArrow(emit, StructType([*fields, StructField("beg", LongType()), StructField("last", LongType())]))
