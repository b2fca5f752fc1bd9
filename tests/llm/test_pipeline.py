"""The pipeline's stages, each on what the one before kept, against brute-force versions."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from test_operators import brute_deduped
from test_similar import brute_roots

import corpus_pipeline
from kspec.llm import bpe, toxicity
from kspec.llm.common import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf_dir), "test-" + name.replace(" ", "-")))
    assert all(k.columns == columns for k in kept[:-1])
    given, clean, lines, single, mixed, encoded = (k.collect() for k in kept)

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert Counter(r.doc_id for r in clean) == Counter(r.doc_id for r in given if model.score(r.text or "") < 0.7)
    # line dedup keeps every row; a text only loses lines
    assert Counter((r.doc_id, r.text) for r in lines) == brute_deduped(clean)
    assert Counter(r.doc_id for r in single) == Counter(r.doc_id for r, c in zip(lines, brute_roots(lines), strict=True) if r.doc_id == c)
    # mixing drops no document and changes no text
    assert {(r.doc_id, r.text) for r in mixed} == {(r.doc_id, r.text) for r in single}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text or ""), dtype="<u4").tobytes()).hexdigest()) for r in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in encoded) == want


ODD = [
    (None, "one text without an id\nthe same long line in two texts", "en", None, 50), (None, "another text without an id\nthe same long line in two texts", None, "a", 50), (None, None, None, None, None),
    (7, "seven says this in a line of its own\nand this", "en", "a", 40), (7, "seven says something else altogether", "de", "a", 40), (7, "seven says something else altogether", "de", "a", 40),
    (8, "", "en", "b", 0), (9, "word " * 60_000, "en", "b", 300_000), (10, "seven says this in a line of its own\nand more", "en", "b", 40),
]


def test_stages_on_odd_rows(spark, sf_dir):
    """Null and repeated ids, null, empty and very long texts, clashing names, an empty table: every stage keeps what is not its own to drop."""
    columns = ("gone", "gone_id", "gone_text", "gone_lines", "cleaned", "shard", "k", "t", "__gone", "__gone_id", "__text")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in columns)
    docs = spark.createDataFrame([(*r, *columns) for r in ODD], schema)
    for given in (docs, docs.limit(0)):
        kept = written(corpus_pipeline.drop_toxic(spark, given, sf_dir), "odd-toxic")
        assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in given.collect())
        lines = written(corpus_pipeline.drop_repeated_lines(spark, kept, sf_dir), "odd-lines")
        assert lines.columns == docs.columns and Counter((r.doc_id, r.text) for r in lines.collect()) == brute_deduped(kept.collect())
        single = corpus_pipeline.drop_near_duplicates(spark, lines, sf_dir)
        # texts without words are alike; the rows equal in id and text are one document
        want = Counter((r.doc_id, r.text) for r in lines.collect())
        for r in lines.collect():
            if r.doc_id is None and not (r.text or "").strip():
                want.pop((r.doc_id, r.text), None)
        got = written(single, "odd-single")
        assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
        mixed = corpus_pipeline.mix_sources(spark, got, sf_dir)
        assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} == set(want)
        assert corpus_pipeline.encode(spark, mixed, sf_dir).count() == mixed.count()
