"""Reads of block-compressed alignments (BAM) and of their text form (SAM).

A BAM file is a row of gzip blocks of at most 64 KB, and the records in them don't care for the blocks' ends. A file is cut by bytes into splits; a task finds the first block that begins in its split by the
blocks' headers, and the first record by what a record must look like, as must all that follow it to the split's end. Each split says how far its last record reaches into the next, so a guess is checked by the
split before it; one that doesn't fit is surveyed again from where it has to begin. So all splits of a file are read at the same time, and the result is that of reading it from its beginning."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING, BinaryIO

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import in_order, numbered_files
from .shared import shared_dir

if TYPE_CHECKING:
    import pandas as pd

SPLIT_BYTES = 16 << 20
#: Fixed values of the format: a block's header up to its length, the greatest block, letters of four bits, and flags of records that repeat another record's bases or stand for its other strand.
BLOCK_HEAD, BLOCK_MAX = b"\x1f\x8b\x08\x04", 1 << 16
LETTERS = np.frombuffer(b"=ACMGRSVTWYHKDBN", dtype=np.uint8)
REPEATED, REVERSE, FLAGS_AT = 0x900, 0x10, 18
COMPLEMENT = bytes.maketrans(b"ACMGRSVTWYHKDBN", b"TGKCYSBAWRDMHVN")
#: A guessed record is believed if it and those after it, so many or to the end of what is there, look like records.
CHAIN = 50
#: Why a record, as far as it is there, can't be one: see `length_of`.
BROKEN, CUT = -1, -2


def block_size(head: bytes) -> int:
    """Bytes of the block with this beginning (18 bytes or more); 0 if none begins so."""
    if head[:4] != BLOCK_HEAD or len(head) < 18:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 6 <= min(end, len(head)):
        if head[at : at + 2] == b"BC" and struct.unpack_from("<H", head, at + 2)[0] == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", head, at + 2)[0]
    return 0


def inflated(block: bytes) -> bytes:
    """What a block holds; its checksum is verified."""
    data = zlib.decompress(block, wbits=31)
    if len(data) != struct.unpack_from("<I", block, len(block) - 4)[0]:
        raise ValueError("a block is of another length than it says")
    return data


def first_block(f: BinaryIO, begin: int, end: int, size: int) -> int:
    """Place of the first block that begins in [begin, end), end if none does."""
    if begin == 0:
        return 0
    f.seek(begin)
    data = f.read(min(end - begin, BLOCK_MAX) + 2 * BLOCK_MAX)
    at = data.find(BLOCK_HEAD)
    while at >= 0 and begin + at < end:
        n = block_size(data[at : at + 64])
        if n and (begin + at + n == size or block_size(data[at + n : at + n + 64])):
            try:
                inflated(data[at : at + n])
                return begin + at
            except (zlib.error, ValueError, struct.error):
                pass
        at = data.find(BLOCK_HEAD, at + 1)
    return end


def blocks(f: BinaryIO, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the blocks from here on."""
    f.seek(at)
    rest = b""
    while at < size:
        while len(rest) < 64 and (more := f.read(1 << 20)):
            rest += more
        n = block_size(rest[:64])
        if not n:
            raise ValueError(f"no block begins at byte {at}")
        while len(rest) < n:
            more = f.read(1 << 20)
            if not more:
                raise ValueError(f"the block at byte {at} is cut off")
            rest += more
        yield at, inflated(rest[:n])
        rest, at = rest[n:], at + n


def length_of(data: bytes, at: int) -> int:
    """Bytes of the record at this place; CUT if its head isn't all there, BROKEN if no record looks like this."""
    if at + 36 > len(data):
        return CUT
    n, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if n < 32 or ref < -1 or pos < -1 or next_ref < -1 or next_pos < -1 or not l_name or l_seq < 0 or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > n:
        return BROKEN
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return BROKEN
    return n + 4


def header_length(data: bytes) -> int | None:
    """Bytes before the first record; None if they aren't all there."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    if len(data) < 8:
        return None
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    if at + 4 > len(data):
        return None
    references, at = struct.unpack_from("<i", data, at)[0], at + 4
    for _ in range(references):
        if at + 4 > len(data):
            return None
        at += 8 + struct.unpack_from("<i", data, at)[0]
    return at if at <= len(data) else None


def guess(data: bytes) -> int:
    """Place of the first record; the length of data if none begins there."""
    for start in range(len(data)):
        at, seen = start, 0
        while seen < CHAIN and at < len(data):
            n = length_of(data, at)
            if n == BROKEN:
                break
            if n == CUT:
                at = len(data)
                break
            at, seen = at + n, seen + 1
        else:
            return start
        if at >= len(data) and seen:
            return start
    return len(data)


class Split:
    """The records that begin in the blocks that begin in [begin, end) of a file of size bytes."""

    def __init__(self, f: BinaryIO, begin: int, end: int, size: int):
        self.first = first_block(f, begin, end, size)
        self.stream = blocks(f, self.first, size) if self.first < end else iter(())
        inside, self.ahead = [], None
        for at, data in self.stream:
            if at >= end:
                self.ahead = data
                break
            inside.append(data)
        self.data = b"".join(inside)
        self.bytes, self.is_first = len(self.data), begin == 0

    def _fetch(self) -> bool:
        """Adds the next block, which is another split's."""
        data, self.ahead = self.ahead, None
        if data is None:
            _, data = next(self.stream, (0, None))
        if data is None:
            return False
        self.data += data
        return True

    def start(self) -> int:
        """Where the first record begins, by the header or by guess."""
        if not self.is_first:
            return guess(self.data)
        while (n := header_length(self.data)) is None:
            if not self._fetch():
                raise ValueError("the header is cut off")
        return n

    def records(self, start: int) -> Iterator[tuple[int, int]]:
        """Place and length of each record that begins in the split's bytes. At the end self.reach is the place after the last one."""
        at = start
        while at < self.bytes:
            while (n := length_of(self.data, at)) == CUT or n > 0 and at + n > len(self.data):
                if not self._fetch():
                    raise ValueError("the last record is cut off")
            if n == BROKEN:
                raise ValueError(f"no record at byte {at} after the split's beginning")
            yield at, n
            at += n
        self.reach = at


def read_of(data: bytes, at: int) -> tuple[int, str, bytes]:
    """Flags, name and bases of a record, turned to the strand that was read."""
    _, _, _, l_name, _, _, n_cigar, flags, l_seq, _, _, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    name = data[at + 36 : at + 35 + l_name].decode("ascii")
    begin = at + 36 + l_name + 4 * n_cigar
    packed = np.frombuffer(data, dtype=np.uint8, count=(l_seq + 1) // 2, offset=begin)
    bases = LETTERS[np.stack([packed >> 4, packed & 15], axis=1).reshape(-1)[:l_seq]].tobytes()
    return flags, name, bases[::-1].translate(COMPLEMENT) if flags & REVERSE else bases


def _open(uri: str) -> BinaryIO:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def listed(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """Files and their bytes, as Hadoop's file systems name them, in the order of their names."""
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = system.globStatus(where) or ()
        inner = [x for s in found for x in (system.listStatus(s.getPath()) if s.isDirectory() else [s])]
        out += [(re.sub("^file:/(?!/)", "file:///", x.getPath().toString()), x.getLen()) for x in inner if x.isFile()]
    if not out:
        raise ValueError(f"no file at {paths}")
    return sorted(out)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Splits (with start, or null to guess it) -> the bytes of their blocks, where their first record begins and their last one ends, both from the split's first block on, and their reads."""
    import pandas as pd

    for batch in batches:
        rows = []
        for s in batch.itertuples():
            with _open(s.file) as f:
                split = Split(f, s.begin, s.end, s.size)
                start = split.start() if s.start is None or s.start != s.start else int(s.start)
                try:
                    kept = sum(not struct.unpack_from("<H", split.data, at + FLAGS_AT)[0] & REPEATED for at, _ in split.records(start))
                    reach = split.reach
                except ValueError:
                    reach = kept = -1  # records don't begin there
            rows.append((s.file, s.n, s.begin, s.end, s.size, start, split.bytes, reach, kept))
        yield pd.DataFrame(rows, columns=["file", "n", "begin", "end", "size", "start", "bytes", "reach", "reads"])


SURVEY = "file string, n int, begin long, end long, size long, start long, bytes long, reach long, reads long"


def surveyed(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each split of the files, each beginning where the one before ends."""
    sized = spark.createDataFrame(files, "file string, size long").where("size > 0")
    splits = sized.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes))).alias("begin"))
    splits = splits.select("file", (F.col("begin") / split_bytes).cast("int").alias("n"), "begin", F.least(F.col("begin") + split_bytes, "size").alias("end"), "size", F.lit(None).cast("long").alias("start"))
    parts = max(1, min(sum(-(-size // split_bytes) for _, size in files), 100_000))

    def held(df: DataFrame) -> DataFrame:
        path = shared_dir(spark, "splits")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = held(splits.repartition(parts, "file", "n").mapInPandas(_survey, SURVEY))
    while True:
        # a split begins where the last record before it ends; one without a record of its own hands that on
        order = Window.partitionBy("file").orderBy("n")
        ahead = order.rowsBetween(Window.unboundedPreceding, -1)
        placed = found.withColumn("before", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)))
        ends = F.max(F.when(F.col("reach") >= 0, F.col("before") + F.col("reach"))).over(ahead)
        due = held(placed.withColumn("due", F.when(F.col("n") == 0, F.col("start")).otherwise(F.greatest(ends - F.col("before"), F.lit(0)))).drop("before"))
        wrong = (F.col("n") > 0) & ((F.col("due") < F.col("bytes")) & (F.col("start") != F.col("due")) | (F.col("due") >= F.col("bytes")) & (F.col("start") < F.col("bytes")))
        again = due.where(wrong)
        if again.isEmpty():
            break
        # the first of them is right after this round, and so are those that had followed a right one
        mended = again.select("file", "n", "begin", "end", "size", F.col("due").alias("start")).repartition(parts, "file", "n").mapInPandas(_survey, SURVEY)
        found = held(due.where(~wrong).drop("due").unionByName(mended))
    broken = due.where("reach < 0").first()
    if broken is not None:
        raise ValueError(f"no record where one has to begin, at the beginning of byte {broken.begin} to {broken.end} of {broken.file} or after it")
    return due.withColumn("start", F.when(F.col("n") == 0, F.col("start")).otherwise(F.greatest("start", "due"))).drop("due")


def read_bam(spark: SparkSession, paths: str | list[str], *, repeated: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """seq_id (0 first, in the order of the files' names and of records), name, seq of the reads in BAM files, as they came off the machine; letters that are no bases become breaks.

    Secondary and supplementary records say again what another record says; they are read only if repeated is true (then a read has several rows). A record without bases has an empty seq."""
    table = surveyed(spark, listed(spark, paths), split_bytes)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            for s in batch.itertuples():
                with _open(s.file) as f:
                    split, rows, n, size = Split(f, s.begin, s.end, s.size), [], 0, 0
                    for at, _ in split.records(int(s.start)):
                        flags, name, bases = read_of(split.data, at)
                        if repeated or not flags & REPEATED:
                            rows.append((s.file, s.n, n, name, bases.decode("ascii")))
                            n, size = n + 1, size + len(bases)
                        if size > 4 << 20 or len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["file", "split", "i", "name", "seq"])
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=["file", "split", "i", "name", "seq"])

    splits = table.select("file", "n", "begin", "end", "size", "start")
    each = splits.repartition(max(1, min(table.count(), 100_000)), "file", "n").mapInPandas(decode, "file string, split int, i long, name string, seq string")
    counts = table.select("file", F.col("n").alias("split"), "reads") if not repeated else each.groupBy("file", "split").agg(F.count("*").alias("reads"))
    before = F.coalesce(F.sum("reads").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.join(counts.select("file", "split", before.alias("before")), ["file", "split"])
    return numbered_files(placed.select("file", (F.col("before") + F.col("i")).alias("n"), "name", "seq"))


def _turned(seq: Column, flags: Column) -> Column:
    upper = F.upper(seq)
    return F.when(flags.bitwiseAND(REVERSE) != 0, F.reverse(F.translate(upper, "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN"))).otherwise(upper)


def read_sam(spark: SparkSession, paths: str | list[str], *, repeated: bool = False) -> DataFrame:
    """The same of SAM files, which Spark's text reader splits. A line that is neither a header nor a record is an error."""
    lines = spark.read.option("lineSep", "\n").text(paths).where("value not like '@%' and length(trim(value)) > 0")
    part = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    if not repeated:
        lines = lines.where(F.coalesce(F.get(part, F.lit(1)).try_cast("int"), F.lit(0)).bitwiseAND(REPEATED) == 0)
    checked = F.when(F.size(part) >= 11, part).otherwise(F.raise_error(F.concat(F.lit("no record in "), F.col("file"))))
    rows = in_order(lines).select("file", "n", checked.alias("p")).select("file", "n", F.col("p")[0].alias("name"), F.col("p")[1].cast("int").alias("flags"), F.col("p")[9].alias("seq"))
    seq = F.when(F.col("seq") == "*", "").otherwise(_turned(F.col("seq"), F.col("flags")))
    return numbered_files(rows.select("file", "n", "name", seq.alias("seq")))
