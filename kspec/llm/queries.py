"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a document in the mixture: entropy 0.95 of the greatest, no source more than twice as often as another, tokens counted by a vocabulary. See mixture() for nulls and empty tables."""
    import public_tokenizers

    from .mixing import mixture, realise
    from .records import encoder

    narrow, plan, _ = mixture(_table(spark, sf_dir, "documents"), target_entropy=0.95, max_repeats=2.0, encoder=partial(encoder, public_tokenizers.path("byte_bpe_50k.json")))
    return realise(narrow, plan).drop("t")


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents, read back from their files. See write_records() for nulls, repeated ids and empty tables."""
    import public_tokenizers

    from .records import read_records, write_records

    manifest = write_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document by the law `rows`. See hilbert_shards() for nulls, repeated rows and empty tables."""
    from .hilbert import hilbert_shards

    placed = hilbert_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of each document, as checksums. See encode_decode() for nulls, repeated rows and empty tables."""
    import public_tokenizers

    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of each document. See quality() for nulls, repeated rows and empty tables."""
    from .outliers import quality

    return quality(_table(spark, sf_dir, "documents"))


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document stored as lossless WebP and read back. See media() for nulls, repeated rows and empty tables."""
    from .webp import media

    return media(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line occurrence that goes, with the earliest one that is alike. See removed_lines() for nulls, repeated ids and empty tables."""
    from .linededup import removed_lines

    return removed_lines(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in each document. See find_personal_data() for nulls, repeated rows and empty tables."""
    from .pii import personal_data_digest

    return personal_data_digest(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document. See near_duplicates() for nulls, repeated rows and empty tables."""
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document. See fit() and scored() for nulls, repeated ids and empty tables."""
    from .toxicity import fit, scored

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest inner products of every hundredth vector with all others. See build() and search() for nulls, repeated ids, ties and empty tables."""
    from .pivots import build, search

    return search(build(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, k=10)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that a source uses more than its language. See audit() for nulls, repeated rows and empty tables."""
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"), least_docs=3, top=200)


def tiled(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's planted runs: of one document in ten a stretch of words is repeated to its end. A null id counts as no digits."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in each document and what is left without their repeats. See find_runs() for nulls, repeated ids and empty tables."""
    from .runs import digest, find_runs

    return digest(find_runs(_table(spark, sf_dir, "documents"), tiling=tiled))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages of corpus_pipeline.py make of documents; each stage says what it does with nulls, repeated ids and empty tables."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixture, op2_records, op3_hilbert, op4_bpe, op5_outliers, op6_webp, op7_line_dedup, op8_personal_data, op9_simhash, op10_toxicity, op11_top_k, op12_divergence, op13_runs, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
