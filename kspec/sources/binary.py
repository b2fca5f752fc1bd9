"""Binary tables, histograms and profiles, each a stub and hidden parts beside it, written and read by many tasks.

Numbers are little-endian. Fixed values of the formats:
  NAME.ktab          int k, int parts, int least count, int prefix bytes, then for each prefix (256 to the power of its bytes) a long: the rows up to its end
  .NAME.ktab.P       int k, long rows, then the rows in order: the key without its prefix bytes, four bases a byte, and the count in two bytes
  NAME.hist          int k, int low, int high, long instances in the low bin, long instances in the high bin, then a long for each bin: different k-mers, those beyond low and high in these two bins
  NAME.prof          int k, int parts
  .NAME.pidx.P       int k, long first sequence, long sequences, then for each a long: the bytes of the part up to its profile's end
  .NAME.prof.P       the profiles: see `encoded`"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from kspec.functions import minimizer
from kspec.functions import places as by_place
from kspec.functions.kmer import MAX_DOUBLE, MAX_PACKED, key_array, key_type, sliced
from kspec.operators import profile
from kspec.operators.histogram import rerange
from kspec.operators.table import KmerTable
from kspec.sources.shared import kept_at

if TYPE_CHECKING:
    import pandas as pd
    import pyarrow as pa

#: Greatest count of a row, and of a profile.
TOP = 0x7FFF
#: Rows that are read or written together; positions of a piece of a profile.
ROWS, PIECE = 1 << 18, 1 << 14
#: Bytes of neighbouring profiles that are read together.
READ = 1 << 22


def _place(path: str) -> tuple[str, str]:
    folder, _, name = path.rpartition("/")
    return folder or ".", name


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _put(uri: str, data: bytes | Iterator[bytes], attempt: int = 0) -> None:
    """Writes a file under another name first, so that a task that is repeated leaves no half of it. Its folder is made if it isn't there."""
    system, path = _fs(uri)
    system.create_dir(_place(path)[0], recursive=True)
    draft = f"{path}.{attempt}.draft"
    with system.open_output_stream(draft) as out:
        for piece in [data] if isinstance(data, bytes) else data:
            out.write(piece)
    system.move(draft, path)


def _get(uri: str, begin: int = 0, size: int | None = None) -> bytes:
    system, path = _fs(uri)
    with system.open_input_file(path) as f:
        f.seek(begin)
        return f.read() if size is None else f.read(size)


def key_bytes(keys: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """A row of bytes for each key of one or two longs, four bases a byte, the last one filled up with zeros."""
    width = -(-k // 4)
    out = np.zeros((len(keys[0]), width), dtype=np.uint8)
    for base in range(k):
        behind = k - 1 - base
        long, at = (keys[-1], behind) if behind < MAX_PACKED else (keys[0], behind - MAX_PACKED)
        out[:, base // 4] |= ((long >> (2 * at) & 3) << (6 - 2 * (base % 4))).astype(np.uint8)
    return out


def keys_of(data: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The reverse of key_bytes."""
    keys = [np.zeros(len(data), dtype=np.int64) for _ in range(1 if k <= MAX_PACKED else 2)]
    for base in range(k):
        behind = k - 1 - base
        long = keys[-1] if behind < MAX_PACKED else keys[0]
        long <<= 2
        long |= data[:, base // 4].astype(np.int64) >> (6 - 2 * (base % 4)) & 3
    return tuple(keys)


def _longs(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    column = batch.column(0)
    return (column.to_numpy(),) if k <= MAX_PACKED else (column.field("hi").to_numpy(), column.field("lo").to_numpy())


def write_table(table: KmerTable, path: str, parts: int = 4, prefix_bytes: int = 2) -> None:
    """A table as PATH.ktab. Counts above TOP become TOP. Parts are ranges of keys, each sorted and written by a task; the stub's index is summed from what the tasks have counted, a row for each prefix of a
    part, and is as long as prefix_bytes (1 to 3) says, whatever the table is."""
    k, (folder, name) = table.k, _place(path)
    width = -(-k // 4)
    if k > MAX_DOUBLE or not 1 <= prefix_bytes <= min(3, width):
        raise ValueError(f"k of {MAX_DOUBLE} at most, and 1 to {min(3, width)} prefix bytes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        rows, tally = 0, np.zeros(256**prefix_bytes, dtype=np.int64)

        def body() -> Iterator[bytes]:
            nonlocal rows
            for batch in batches:
                keys, count = key_bytes(_longs(batch, k), k), np.minimum(batch.column(1).to_numpy(), TOP).astype("<u2")
                prefix = np.zeros(len(keys), dtype=np.int64)
                for i in range(prefix_bytes):
                    prefix = prefix << 8 | keys[:, i]
                tally[:] += np.bincount(prefix, minlength=len(tally))
                rows += len(keys)
                yield np.concatenate([keys[:, prefix_bytes:], count.view(np.uint8).reshape(-1, 2)], axis=1).tobytes()

        # the head holds the rows, which are known at the end: the body goes to a file of its own first
        part, attempt = context.partitionId() + 1, context.taskAttemptId()
        target = f"{folder}/.{name}.ktab.{part}"
        _put(f"{target}.body.{attempt}", body(), attempt)
        system, draft = _fs(f"{target}.body.{attempt}")

        def whole() -> Iterator[bytes]:
            yield struct.pack("<iq", k, rows)
            with system.open_input_file(draft) as f:
                while data := f.read(1 << 22):
                    yield data

        _put(target, whole(), attempt)
        system.delete_file(draft)
        used = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(tally[used])], names=["prefix", "n"])

    system, at = _fs(folder)
    system.create_dir(at, recursive=True)
    for p in range(1, parts + 1):
        if system.get_file_info(f"{at}/.{name}.ktab.{p}").is_file:
            system.delete_file(f"{at}/.{name}.ktab.{p}")
    dealt = table.df.select("kmer", "cnt").repartitionByRange(parts, "kmer").sortWithinPartitions("kmer")
    index = np.zeros(256**prefix_bytes, dtype="<i8")
    counted = dealt.mapInArrow(write, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).collect()  # 256 ** prefix_bytes rows at most
    for r in counted:
        index[r.prefix] = r.n
    for p in range(1, parts + 1):
        if not system.get_file_info(f"{at}/.{name}.ktab.{p}").is_file:  # no task has run for a table without rows
            _put(f"{folder}/.{name}.ktab.{p}", struct.pack("<iq", k, 0))
    least = table.df.agg(F.coalesce(F.min("cnt"), F.lit(1))).first()[0]
    _put(f"{path}.ktab", struct.pack("<iiii", k, parts, min(least, TOP), prefix_bytes) + np.cumsum(index).astype("<i8").tobytes())


def read_table(spark: SparkSession, path: str, cut_off: int = 1) -> KmerTable:
    """The table PATH.ktab. Parts are read in pieces of ROWS rows by many tasks; a task finds the prefixes of its rows in the stub's index. ValueError if a part is of another k than the stub."""
    folder, name = _place(path)
    k, parts, _, prefix_bytes = struct.unpack("<iiii", _get(f"{path}.ktab", 0, 16))
    record = -(-k // 4) + 2 - prefix_bytes
    pieces, total = [], 0
    for p in range(1, parts + 1):
        own, n = struct.unpack("<iq", _get(f"{folder}/.{name}.ktab.{p}", 0, 12))
        if own != k:
            raise ValueError(f"part {p} of the table at {path} has k = {own}, its stub {k}")
        pieces.append((p, n, total))
        total += n
    ranges = spark.createDataFrame(pieces, "part int, n long, before long").where("n > 0").select("part", "before", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ROWS))).alias("begin"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        index = np.frombuffer(_get(f"{path}.ktab", 16), dtype="<i8")
        for batch in batches:
            for part, before, n, begin in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = min(ROWS, n - begin)
                data = np.frombuffer(_get(f"{folder}/.{name}.ktab.{part}", 12 + begin * record, rows * record), dtype=np.uint8).reshape(rows, record)
                prefix = np.searchsorted(index, before + begin + np.arange(rows), side="right")
                head = np.stack([prefix >> 8 * (prefix_bytes - 1 - i) & 255 for i in range(prefix_bytes)], axis=1).astype(np.uint8)
                keys = keys_of(np.concatenate([head, data[:, :-2]], axis=1), k)
                counts = np.ascontiguousarray(data[:, -2:]).view("<u2").reshape(-1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([key_array(keys), pa.array(counts)], names=["kmer", "cnt"])

    tasks = max(1, min(100_000, -(-total // ROWS)))
    df = ranges.repartition(tasks, "part", "begin").mapInArrow(read, StructType([StructField("kmer", key_type(k)), StructField("cnt", LongType())]))
    return KmerTable(df.where(F.col("cnt") >= cut_off) if cut_off > 1 else df, k)


def write_histogram(hist: DataFrame, path: str, k: int, low: int = 1, high: int = TOP) -> None:
    """A histogram (multiplicity, n_unique, n_instances) as PATH.hist; what lies beyond low and high goes to these bins. It has high - low + 1 numbers, whatever it counts."""
    if not 0 < low <= high:
        raise ValueError(f"bins from {low} to {high}")
    bins, ends = np.zeros(high - low + 1, dtype="<i8"), {low: 0, high: 0}
    for r in rerange(hist, low, high).collect():
        bins[r.multiplicity - low] = r.n_unique
        if r.multiplicity in ends:
            ends[r.multiplicity] = r.n_instances
    _put(f"{path}.hist", struct.pack("<iiiqq", k, low, high, ends[low], ends[high]) + bins.tobytes())


def read_histogram(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """multiplicity, n_unique, n_instances of the bins of PATH.hist that aren't empty."""
    data = _get(f"{path}.hist")
    own, low, high, at_low, at_high = struct.unpack_from("<iiiqq", data)
    if k is not None and own != k:
        raise ValueError(f"the histogram at {path} has k = {own}, not {k}")
    bins = np.frombuffer(data, dtype="<i8", count=high - low + 1, offset=28).tolist()
    rows = [(m, n, at_low if m == low else at_high if m == high else m * n) for m, n in enumerate(bins, low) if n]
    return spark.createDataFrame(rows, "multiplicity long, n_unique long, n_instances long")


def _first(value: int) -> bytes:
    return bytes([value]) if value < 0x80 else bytes([0x80 | value >> 8, value & 255])


def _change(before: int, value: int) -> bytes:
    """A step to the next value: a run of one, a small difference, or a difference of 15 bits."""
    d = value - before
    if d == 0:
        return b"\x01"
    if -32 <= d < 32:
        return bytes([0x40 | d & 0x3F])
    return bytes([0x80 | (d & TOP) >> 8, d & 255])


def changes(values: np.ndarray) -> bytes:
    """The steps of a stretch after its first value. Runs of equal values are 63 long at most."""
    d = np.diff(values)
    steps = np.flatnonzero(d) + 1
    d = d[steps - 1]
    run = np.diff(np.concatenate(([0], steps, [len(values)]))) - 1  # before each step, and after the last
    full, rest, small = run // 63, run % 63, (d >= -32) & (d < 32)
    ends = np.cumsum(full + (rest > 0) + np.append(np.where(small, 1, 2), 0))
    out = np.full(ends[-1], 0x3F, dtype=np.uint8)
    at = np.concatenate(([0], ends[:-1])) + full
    out[at[rest > 0]] = rest[rest > 0]
    at = (at + (rest > 0))[:-1]
    out[at[small]] = 0x40 | d[small] & 0x3F
    out[at[~small]] = 0x80 | (d[~small] & TOP) >> 8
    out[at[~small] + 1] = d[~small] & 255
    return out.tobytes()


def encoded(values: np.ndarray) -> bytes:
    """A profile as bytes. Its first value, in one byte, or in two if the first has its top bit; then 00xxxxxx: the value x times more; 01dddddd: one value, by a signed difference; 1ddddddd dddddddd: one value, by a
    difference modulo 2 to the 15th."""
    return _first(int(values[0])) + changes(values) if len(values) else b""


def decoded(data: bytes) -> np.ndarray:
    """The values of an encoded profile."""
    if not data:
        return np.zeros(0, dtype=np.int64)
    value, begin = (data[0], 1) if data[0] < 0x80 else ((data[0] & 0x7F) << 8 | data[1], 2)
    x = np.frombuffer(data, dtype=np.uint8)[begin:].astype(np.int64)
    # a byte without its top bit is followed by a step's first byte; of bytes that have it, every other one from there on is a first one
    i = np.arange(len(x))
    fresh = np.maximum.accumulate(np.concatenate(([0], np.where(x[:-1] < 0x80, i[1:], 0)))) if len(x) else i
    at = np.flatnonzero((i - fresh) % 2 == 0)
    first, second = x[at], x[np.minimum(at + 1, max(len(x) - 1, 0))]
    change = np.where(first >= 0x80, (first & 0x7F) << 8 | second, np.where(first >= 0x40, (first & 0x1F) - (first & 0x20), 0))
    values = np.concatenate(([value], value + np.cumsum(change))) & TOP
    return np.repeat(values, np.concatenate(([1], np.where(first >= 0x40, 1, first))))


def write_profiles(prof: DataFrame, lengths: DataFrame, path: str, k: int, column: str, parts: int = 4) -> None:
    """Profiles (seq_id, pos and a column of counts, absent positions 0) as PATH.prof. lengths: seq_id from 0 without gaps, and n_pos, the positions of each. Counts above TOP become TOP."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            ends, v = np.arange(len(batch) + 1, dtype=np.int32) * 2, np.minimum(batch.column(2).to_numpy(), TOP).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(v)])], names=["seq_id", "pos", "values"])

    rows = prof.select(F.col("seq_id").cast("long"), F.col("pos").cast("long").alias("pos"), F.col(column).cast("long"))
    write_stretches(rows.mapInArrow(single, "seq_id long, pos long, values binary"), lengths, path, k, parts)


def _encode(batches: Iterator[pa.RecordBatch], piece_size: int) -> Iterator[pa.RecordBatch]:
    """Rows by seq_id, piece and pos; each piece's first row has its length in n and pos -1, the others values of 16 bits from pos on -> each piece's first and last value and steps. One piece is held."""
    import pyarrow as pa

    fields = [("seq_id", pa.int64()), ("piece", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("steps", pa.binary())]
    of, v = None, np.zeros(0, dtype=np.int64)
    done: list[tuple] = []
    size = 0
    for batch in batches:
        seq, piece, pos, n = (batch.column(i).to_numpy() for i in range(4))
        offsets = np.frombuffer(batch.column(4).buffers()[1], dtype=np.int32)[batch.column(4).offset :][: len(batch) + 1]
        values = np.frombuffer(batch.column(4).buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view("<u2")
        begin = (offsets - offsets[0]).astype(np.int64) // 2
        # where each value goes in its piece
        place = np.arange(len(values)) + np.repeat(pos - piece * piece_size - begin[:-1], np.diff(begin))
        first = np.concatenate(([0], np.flatnonzero((np.diff(seq) != 0) | (np.diff(piece) != 0)) + 1)) if len(batch) else []
        for row, end in zip(first, [*first[1:], len(batch)], strict=True):
            if (seq[row], piece[row]) != of:
                if of is not None:
                    done.append((*of, int(v[0]), int(v[-1]), changes(v)))
                    size += len(done[-1][-1])
                of, v = (seq[row], piece[row]), np.zeros(n[row], dtype=np.int64)
            at, own = place[begin[row] : begin[end]], values[begin[row] : begin[end]]
            inside = (at >= 0) & (at < len(v))
            v[at[inside]] = own[inside]
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*done, strict=True), fields, strict=True)], names=[f for f, _ in fields])
            done, size = [], 0
    if of is not None:
        done.append((*of, int(v[0]), int(v[-1]), changes(v)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*done, strict=True), fields, strict=True)], names=[f for f, _ in fields])


class _Part:
    """A part of profiles that a task writes, sequence after sequence, under another name until it is whole."""

    def __init__(self, folder: str, name: str, k: int, part: int, first: int) -> None:
        from pyspark import TaskContext

        self.k, self.part, self.first, self.attempt = k, part, first, TaskContext.get().taskAttemptId()
        self.index, (self.system, self.target) = f"{folder}/.{name}.pidx.{part + 1}", _fs(f"{folder}/.{name}.prof.{part + 1}")
        self.out = self.system.open_output_stream(f"{self.target}.{self.attempt}.draft")
        self.last, self.ends, self.size = None, [], 0

    def sequence(self, seq_id: int) -> bool:
        """What is put from here on is this sequence's. Whether it is another than before."""
        if new := seq_id != self.last:
            self.last = seq_id
            self.ends.append(self.size)
        return new

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.ends[-1] = self.size

    def close(self) -> None:
        self.out.close()
        self.system.move(f"{self.target}.{self.attempt}.draft", self.target)
        _put(self.index, struct.pack("<iqq", self.k, self.first, len(self.ends)) + np.array(self.ends, dtype="<i8").tobytes(), self.attempt)


def write_stretches(values: DataFrame, lengths: DataFrame, path: str, k: int, parts: int = 4) -> None:
    """Profiles as PATH.prof. values: seq_id, pos and values, the 16-bit numbers (TOP at most) at the positions from pos on; absent positions are 0. lengths: seq_id from 0 without gaps, and n_pos, the positions of each.

    Profiles are encoded in pieces of PIECE positions, which a task takes one after another from sorted rows; a piece after another begins with the step from that one's last value, so a long sequence is no task's own
    work."""
    folder, name = _place(path)
    n_sequences, piece_size = lengths.count(), PIECE
    size = max(1, -(-n_sequences // parts))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n_pos") - 1) / PIECE).cast("long")))
    grid = lengths.where("n_pos > 0").select("seq_id", piece.alias("piece"), F.lit(-1).cast("long").alias("pos"), "n_pos")
    grid = grid.select("seq_id", "piece", "pos", F.least(F.lit(PIECE), F.col("n_pos") - F.col("piece") * PIECE).alias("n"), F.lit(b"").alias("values"))
    last = (F.octet_length("values") / 2).cast("long") + F.col("pos") - 1
    each = values.select("seq_id", F.explode(F.sequence(F.expr(f"pos div {PIECE}"), F.floor(last / PIECE))).alias("piece"), "pos", F.lit(0).cast("long").alias("n"), "values")
    done = grid.unionByName(each).repartition("seq_id", "piece").sortWithinPartitions("seq_id", "piece", "pos", F.desc("n"))
    done = done.mapInArrow(lambda batches: _encode(batches, piece_size), "seq_id long, piece long, first int, last int, steps binary")
    done = done.withColumn("before", F.lag("last").over(Window.partitionBy("seq_id").orderBy("piece")))
    rows = lengths.select("seq_id").join(done, "seq_id", "left").withColumn("part", F.expr(f"cast(seq_id div {size} as int)"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows by part, sequence and piece: each part is one file of profiles and one of their ends."""
        import pandas as pd

        out = None
        for batch in batches:
            for r in batch.itertuples():
                if out is None or r.part != out.part:
                    if out:
                        out.close()
                    out = _Part(folder, name, k, r.part, r.seq_id)
                out.sequence(r.seq_id)
                if r.steps is not None:
                    out.put((_first(int(r.first)) if r.before is None or r.before != r.before else _change(int(r.before), int(r.first))) + bytes(r.steps))
        if out:
            out.close()
            yield pd.DataFrame({"part": [out.part]})

    _fs(folder)[0].create_dir(_fs(folder)[1], recursive=True)
    n_parts = -(-n_sequences // size)
    if n_parts:
        rows.repartitionByRange(n_parts, "part").sortWithinPartitions("part", "seq_id", "piece").mapInPandas(write, "part int").count()
    _put(f"{path}.prof", struct.pack("<ii", k, n_parts))


def _packed_pieces(k: int, firsts: list[int]):
    """seq_id, piece and its bases as letters -> the part that the sequence goes to (the last whose first id isn't greater), seq_id, piece, how many bases, they in two bits each, and where others are between them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in sliced(batches):
            ids, texts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            part = (np.searchsorted(np.array(firsts), ids, side="right") - 1).astype(np.int32)
            for rows, begin, code, broken in by_place.joined(texts):
                n = np.diff(np.append(begin, len(code) + 1)) - 1
                data, n_bytes = minimizer.packed(code, begin, n)
                other = np.flatnonzero(np.diff(broken))
                of = np.searchsorted(begin, other, side="right") - 1
                own = other - begin[of] < n[of]  # the breaks that join() put between pieces are none of theirs
                breaks, of = (other - begin[of])[own].astype(np.uint16), of[own]
                ends = 2 * np.cumsum(np.bincount(of, minlength=len(rows)))
                arrays = [pa.array(part[rows]), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(n.astype(np.int32)), minimizer.binary_column(data, np.cumsum(n_bytes)), minimizer.binary_column(breaks.view(np.uint8), ends)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "seq_id", "piece", "n", "bases", "breaks"])

    return emit


def _values(batch: pa.RecordBatch, k: int, table: by_place.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number, of rows of _packed_pieces, and the counts at its positions, so many bases at a time."""
    n_bases = batch.column(3).to_numpy().astype(np.int64)
    data, at_data = minimizer.flat(batch.column(4), np.uint8)
    breaks, at_breaks = minimizer.flat(batch.column(5), np.uint16)
    for rows in np.split(np.arange(len(n_bases)), np.flatnonzero(np.diff(np.cumsum(n_bases) // by_place.LOOKED_UP)) + 1):
        if not len(rows):
            continue
        low, high = rows[0], rows[-1] + 1
        code = (data[at_data[low] : at_data[high], None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3).reshape(-1)
        begin = 4 * (at_data[low:high] - at_data[low])
        other = np.zeros(len(code) + 1, dtype=np.int64)
        other[breaks[at_breaks[low] : at_breaks[high]] + np.repeat(begin, np.diff(at_breaks[low : high + 1])) + 1] = 1
        broken = np.cumsum(other)
        n = np.maximum(n_bases[low:high] - (k - 1), 0)
        at = minimizer.ranges(begin, n)
        values = np.zeros(len(at), dtype=np.int64)
        valid = np.flatnonzero(broken[at + k] == broken[at]) if len(at) else at
        if len(valid):
            values[valid] = np.minimum(table.at(by_place.places_at(code, k)[at[valid]])[:, 0], TOP)
        yield from zip(rows.tolist(), np.split(values, np.cumsum(n)[:-1]), strict=True)


def write_sequences(sequences: DataFrame, numbers: DataFrame, counts: DataFrame, path: str, k: int, column: str, parts: int = 4) -> None:
    """Profiles of sequences (seq_id, seq) by a column of counts as PATH.prof, positions without a k-mer 0. numbers: the number, from 0 without gaps, of each seq_id, in the order of these; others are left out.

    For short k-mers bases travel once, two bits each, to the task that writes their part, which looks the counts up and encodes them a piece of PIECE positions at a time: no value is shuffled or sorted."""
    size = max(1, -(-numbers.count() // parts))
    if not by_place.fits(k, 1):
        numbered = sequences.join(numbers, "seq_id").select(F.col("number").alias("seq_id"), "seq")
        lengths = numbered.select("seq_id", F.greatest(F.length("seq") - (k - 1), F.lit(0)).cast("long").alias("n_pos"))
        write_stretches(profile.stretched(numbered, counts, k, column, TOP), lengths, path, k, parts)
        return
    folder, name = _place(path)
    firsts = sorted(r.seq_id for r in numbers.where(F.col("number") % size == 0).collect())  # a row a part
    uri = kept_at(counts.select("kmer", F.col(column).cast("long").alias(column)), "counts")
    seq, piece = F.coalesce("seq", F.lit("")), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.octet_length("seq") - k) / F.lit(PIECE)).cast("int"))))
    pieces = sequences.where("seq_id is not null").select("seq_id", F.encode(seq, "UTF-8").alias("raw"), piece.alias("piece"))
    pieces = pieces.select("seq_id", "piece", F.substring("raw", F.col("piece") * PIECE + 1, F.lit(PIECE + k - 1)).alias("text"))
    kind = sequences.schema["seq_id"].dataType
    schema = StructType([StructField("part", IntegerType()), StructField("seq_id", kind), StructField("piece", IntegerType()), StructField("n", IntegerType()), StructField("bases", BinaryType()), StructField("breaks", BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part, sequence and piece: each part is one file of profiles and one of their ends."""
        import pyarrow as pa

        out, before = None, 0
        for batch in batches:
            part, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for row, values in _values(batch, k, by_place.table_of(uri, k, [column])):
                if out is None or part[row] != out.part:
                    if out:
                        out.close()
                    out = _Part(folder, name, k, int(part[row]), int(part[row]) * size)
                new = out.sequence(ids[row])
                if len(values):
                    out.put((_first(int(values[0])) if new else _change(before, int(values[0]))) + changes(values))
                    before = int(values[-1])
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.part], pa.int32())], names=["part"])

    _fs(folder)[0].create_dir(_fs(folder)[1], recursive=True)
    if firsts:
        dealt = pieces.mapInArrow(_packed_pieces(k, firsts), schema).repartitionById(len(firsts), "part")
        dealt.sortWithinPartitions("part", "seq_id", "piece").mapInArrow(write, "part int").count()
    _put(f"{path}.prof", struct.pack("<ii", k, len(firsts)))


def _index(folder: str, name: str, part: int, k: int) -> tuple[int, int]:
    own, first, n = struct.unpack("<iqq", _get(f"{folder}/.{name}.pidx.{part}", 0, 20))
    if own != k:
        raise ValueError(f"part {part} of the profiles {name} has k = {own}, its stub {k}")
    return first, n


def fetch(path: str, seq_id: int, k: int | None = None) -> np.ndarray:
    """One sequence's profile, from its own bytes; ValueError for an id that no sequence has, or another k."""
    folder, name = _place(path)
    own, parts = struct.unpack("<ii", _get(f"{path}.prof", 0, 8))
    if k is not None and own != k:
        raise ValueError(f"the profiles at {path} have k = {own}, not {k}")
    for part in range(1, parts + 1):
        first, n = _index(folder, name, part, own)
        if first <= seq_id < first + n:
            i = seq_id - first
            edge = np.frombuffer(_get(f"{folder}/.{name}.pidx.{part}", 20 + 8 * max(0, i - 1), 8 * min(2, i + 1)), dtype="<i8").tolist()
            begin, end = edge if i else (0, edge[0])
            return decoded(_get(f"{folder}/.{name}.prof.{part}", begin, end - begin))
    raise ValueError(f"no sequence {seq_id} in the profiles at {path}")


def read_profiles(spark: SparkSession, path: str, column: str = "cnt", block: int = 1024, ids: DataFrame | None = None) -> DataFrame:
    """seq_id, pos and counts (zeros too) of all profiles, `block` sequences a task. With ids (seq_id, number) sequences go by these ids in place of their numbers, which the tasks get with their blocks."""
    folder, name = _place(path)
    k, parts = struct.unpack("<ii", _get(f"{path}.prof", 0, 8))
    found = [(p, *_index(folder, name, p, k)) for p in range(1, parts + 1)]
    kind = ids.schema["seq_id"].dataType if ids is not None else LongType()
    if ids is None:
        ranges = spark.createDataFrame(found, "part int, first long, n long").where("n > 0").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(block))).alias("begin"), (F.col("first") + F.col("n")).alias("end"))
        ranges = ranges.select("begin", F.least(F.col("begin") + block, F.col("end")).alias("end"), F.array().cast("array<long>").alias("ids"))
    else:
        each = ids.groupBy(F.expr(f"number div {block}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("number", "seq_id"))).alias("x"))
        ranges = each.select((F.col("b") * block).alias("begin"), (F.col("b") * block + F.size("x")).alias("end"), F.col("x.seq_id").alias("ids"))
    n_sequences = sum(n for _, _, n in found)

    def profiles(begin: int, end: int) -> Iterator[np.ndarray]:
        for part, first, n in found:
            low, high = max(begin, first) - first, min(end, first + n) - first
            if low < high:
                ends = np.frombuffer(_get(f"{folder}/.{name}.pidx.{part}", 20 + 8 * low, 8 * (high - low)), dtype="<i8").tolist()
                at = struct.unpack("<q", _get(f"{folder}/.{name}.pidx.{part}", 12 + 8 * low, 8))[0] if low else 0
                i = 0
                while i < len(ends):  # neighbours are read together, one profile at least
                    upto = max(bisect_right(ends, at + READ), i + 1)
                    data, begun = _get(f"{folder}/.{name}.prof.{part}", at, ends[upto - 1] - at), at
                    for stop in ends[i:upto]:
                        yield decoded(data[at - begun : stop - begun])
                        at = stop
                    i = upto

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def rows(of: list, held: list[np.ndarray], of_type: pa.DataType) -> pa.RecordBatch:
            n = np.array([len(x) for x in held])
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return pa.RecordBatch.from_arrays([pa.array(of, of_type).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(pos.astype(np.int32)), pa.array(np.concatenate(held))], names=["seq_id", "pos", column])

        for batch in batches:
            of_type = batch.column(2).type.value_type
            for begin, end, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                of, held, size = [], [], 0
                for number, values in enumerate(profiles(begin, end), begin):
                    of.append(own[number - begin] if own else number)
                    held.append(values)
                    if (size := size + len(values)) >= ROWS:
                        yield rows(of, held, of_type)
                        of, held, size = [], [], 0
                if held:
                    yield rows(of, held, of_type)

    tasks = max(1, min(10_000, -(-n_sequences // block) + parts))
    return ranges.repartition(tasks, "begin").mapInArrow(read, StructType([StructField("seq_id", kind), StructField("pos", IntegerType()), StructField(column, LongType())]))
