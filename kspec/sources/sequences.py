"""Sequence sources and table sinks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from kspec.functions.kmer import cleaned, sliced

if TYPE_CHECKING:
    import pyarrow as pa

#: The driver's tables hold no DNA: letters of a document stand for bases, by their place in the alphabet; full stops and line feeds break.
LETTERS, STAND_FOR = "abcdefghijklmnopqrstuvwxyz.\n", "acgt" * 6 + "ac--"


def _lettered(docs: DataFrame, letters: str, stand_for: str) -> DataFrame:
    """seq_id and seq: letters of either case, and what else is in letters, as what stands for them; all else is left out. A table of bytes does it, as a regular expression takes longer than counting does."""
    table = bytes.maketrans((letters + letters[:26].upper()).encode(), (stand_for + stand_for[:26]).encode())
    others = bytes(set(range(256)) - set((letters + letters[:26].upper()).encode()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary())
            seq = [None if x is None else x.translate(table, others) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary()).cast(pa.string())], names=["seq_id", "seq"])

    rows = docs.select(F.col("doc_id").alias("seq_id"), "text")
    return rows.mapInArrow(emit, StructType([rows.schema["seq_id"], StructField("seq", StringType())]))


def pseudo_dna(docs: DataFrame) -> DataFrame:
    """seq_id and seq of each document."""
    return _lettered(docs, LETTERS, STAND_FOR)


def chimeras(docs: DataFrame) -> DataFrame:
    """Unbroken sequences: the documents of each doc_id div 8, one after another, parents' turns mixed."""
    order = F.element_at(F.create_map(*[F.lit(x) for pair in zip((0, 4, 1, 5, 2, 6, 3, 7), range(8), strict=True) for x in pair]), (F.col("doc_id") % 8).cast("int"))
    one = unbroken(docs).select(F.expr("seq_id div 8").alias("scaffold"), order.alias("n"), "seq")
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "seq"))), lambda x: x["seq"]), "")
    return one.groupBy("scaffold").agg(together.alias("seq")).select(F.col("scaffold").alias("seq_id"), "seq")


def unbroken(docs: DataFrame) -> DataFrame:
    """seq_id, doc_id and seq without breaks."""
    return _lettered(docs, LETTERS[:26], STAND_FOR[:26]).select("seq_id", F.col("seq_id").alias("doc_id"), "seq")


def in_order(raw: DataFrame) -> DataFrame:
    """file, n (the row's place in its file, from 0), value of rows read by Spark's text reader, however it has split the files.

    Rows are counted in each split first; a split's rows follow those of the splits before it. The counts are a row a split."""
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("n"), "value")


def numbered_files(records: DataFrame) -> DataFrame:
    """seq_id, name, seq of records (file, n from 0 without gaps, name, seq): files in the order of their paths. The counts are a row a file."""
    files = records.groupBy("file").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = records.join(files.select("file", before.alias("before")), "file")
    return each.select((F.col("before") + F.col("n")).cast("long").alias("seq_id"), "name", cleaned(F.col("seq")).alias("seq"))


def in_sequence(ids: DataFrame, block: int = 1 << 16) -> DataFrame:
    """seq_id and number, from 0 without gaps in the order of the ids, each once. Ids are numbered within blocks of `block`; the counts are a row a block."""
    own = ids.where("seq_id is not null").select("seq_id", F.floor(F.col("seq_id") / block).alias("b")).distinct()
    counts = own.groupBy("b").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("b").orderBy("seq_id")) - 1
    return own.join(counts.select("b", before.alias("before")), "b").select("seq_id", (F.col("before") + nth).cast("long").alias("number"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq_id (0 first, in file order, files by their paths), name, seq of FASTA files, plain or .gz; letters that are no bases become breaks. A file that doesn't begin with a header is refused.

    Records are cut by Spark's line reader where a line begins with '>', so a file of many sequences is read by many tasks, and lines of a record are joined."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    rows = in_order(raw)
    text = F.regexp_replace("value", "\r", "")
    begun = F.when(F.col("n") > 0, text).when(text.startswith(">"), F.substring(text, F.lit(2), F.length(text)))
    text = F.coalesce(begun, F.when(F.trim(text) != "", F.raise_error(F.concat(F.lit("no FASTA header at the beginning of "), "file"))))
    parts = F.split("text", "\n", 2)
    records = rows.select("file", "n", text.alias("text")).where("text is not null")
    return numbered_files(records.select("file", "n", parts[0].alias("name"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq")))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq_id, name, seq of FASTQ files with four lines a read, plain or .gz. A read that doesn't begin with '@' is an error.

    Files are split as any text is; lines are numbered by their splits' counts, and the two lines of a read that are used meet by that number."""
    lines = in_order(spark.read.option("lineSep", "\n").text(path)).where("n % 4 < 2 and length(trim(value)) > 0 or n % 4 = 1")
    line = F.regexp_replace("value", "\r$", "")
    header = F.when(line.startswith("@"), F.substring(line, F.lit(2), F.length(line))).otherwise(F.raise_error(F.concat(F.lit("no FASTQ header where one is due in "), "file")))
    lines = lines.select("file", F.expr("n div 4").alias("n"), F.when(F.col("n") % 4 == 0, header).alias("name"), F.when(F.col("n") % 4 == 1, line).alias("seq"))
    return numbered_files(lines.groupBy("file", "n").agg(F.max("name").alias("name"), F.max("seq").alias("seq")).where("seq is not null and name is not null"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_bed(intervals: DataFrame, path: str) -> None:
    """scaffold, beg, end, no header."""
    write_tsv(intervals.select("seq_id", "beg", "end"), path, header=False)


def keep(df: DataFrame, path: str) -> DataFrame:
    """Keeps a plot's data as Parquet for another plot."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
