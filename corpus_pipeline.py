"""From documents to token ids: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are mixed, texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kspec.llm import bpe, linededup, mixing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it is trained on these documents and the confirmed labels outside the held-out fold. Each row is judged by its own text: null and
    empty texts, and rows with a null or repeated id, stay or go for what they say. An empty table stays empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is like go; every row stays, null texts stay null. See linededup.dedup_lines for null and repeated ids."""
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those linked by a Jaccard similarity of 0.8 or more of their five-word shingles. op9's three bits of three-word fingerprints are that query's contract;
    here the tiled comparison has the reach for this similarity and its pairs are verified. Texts without words are alike: one stays. See simhash.deduplicated for null and repeated ids."""
    return simhash.deduplicated(docs, similarity=0.8, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, those with null or empty texts too; sources, null among them, that the target weights favour repeat, none more than twice as often as another."""
    return mixing.mix(docs, target_entropy=0.95, max_repeats=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs with its number of ids and the checksums of ids and decoded bytes; a null text is empty."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remembered=200_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: Learned scores, near-duplicate components and byte-pair encoding aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each to what the one before kept, written in the shared folder."""
    from kspec.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
