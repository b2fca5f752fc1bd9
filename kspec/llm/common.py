"""What the operators share: the cluster's shared folder, tables written there, bounded Arrow batches and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java regular expression and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: A table of at most this many narrow rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
BATCH_ROWS = 256


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="kspec-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path, with its file system, under the folder that spark.checkpoint.dir names, which all executors share. Where that is unset a local master takes a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    if "://" not in base and not base.startswith("file:"):
        system = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = system.rstrip("/") + "/" + base.lstrip("/") if not system.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/kspec/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as Parquet in the shared folder and read again, so a lost executor costs a read and no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing that is still to be computed reads them."""
    from pyarrow import fs

    for table in tables:
        system, path = fs.FileSystem.from_uri(table.written_at)
        system.delete_dir(path)


def modest_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch to Python: BATCH_ROWS, unless the session's user has set another number. Texts may be long, and a worker holds a batch in several forms."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def by_size(batches: Iterator[pd.DataFrame], column: str = "text", size: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """The batches in slices of about `size` characters of a column, so what a function makes of a slice stays small. Spark itself bounds the bytes of a batch."""
    for batch in batches:
        if len(batch):
            part = (batch[column].str.len().cumsum() // size).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                yield batch.iloc[a:b]


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that none of these is, in any case."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """What tells the rows of docs apart: the id, and a hash of the text for rows that share an id or have none. Rows equal in both are one document."""
    return F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less the rows whose key (row_key) is in gone (two columns). gone is broadcast if its counted rows are few; otherwise texts are shuffled."""
    names = [fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_text")]
    keys = written(gone.toDF(*names).distinct(), "gone")
    few = keys.count() <= BROADCAST_ROWS
    row_id, row_text = row_key(docs, doc_id, text)
    return docs.join(F.broadcast(keys) if few else keys, row_id.eqNullSafe(F.col(names[0])) & (row_text == F.col(names[1])), "left_anti")


def carried_id(doc_id: Column) -> tuple[Column, Column]:
    """An id as two columns without nulls, doc_id (0 for none) and no_id: pandas makes doubles of whole numbers among nulls, which changes those above 2^53."""
    return F.coalesce(doc_id.cast("long"), F.lit(0)).cast("long").alias("doc_id"), doc_id.isNull().alias("no_id")


def restored_id(df: DataFrame) -> DataFrame:
    """The table with the ids that carried_id has taken apart."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def text_of(text: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text, without building one string a word in Python."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_CLASS + "+"))).cast("long")


def small_join(big: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """big joined to small by null-safe equality of keys. small is broadcast if its measured rows are at most BROADCAST_ROWS; else adaptive execution splits skewed keys of the shuffle join."""
    renamed = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = None
    for k in keys:
        same = big[k].eqNullSafe(renamed[f"__k_{k}"])
        on = same if on is None else on & same
    return big.join(F.broadcast(renamed) if rows <= BROADCAST_ROWS else renamed, on, how).drop(*[f"__k_{k}" for k in keys])
