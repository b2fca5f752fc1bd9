"""The registered settings of the mixture, in tokens, and every join's shuffle branch."""

import math
from collections import Counter
from functools import partial

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kspec.llm import common, linededup, mixing, simhash
from kspec.llm.records import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def exponent_of(shares, entropy_part, ratio):
    """The least exponent, on a fine grid, at which the entropy and the ratio of repeats keep their bounds."""
    for step in range(100_001):
        a = step / 100_000
        w = [s**a for s in shares]
        w = [x / sum(w) for x in w]
        r = [x / s for x, s in zip(w, shares, strict=True)]
        if -sum(x * math.log(x) for x in w) <= entropy_part * math.log(len(shares)) and max(r) / min(r) <= ratio:
            return a
    return 1.0


@pytest.mark.parametrize(("entropy", "repeats"), [(0.95, 2.0), (0.7, 50.0), (0.95, 1.0)])
def test_settings_in_tokens(spark, sf_dir, entropy, repeats):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow, plan, a = mixing.mixture(docs, target_entropy=entropy, max_repeats=repeats, encoder=partial(encoder, PATH))
    t = Tokenizer.from_file(PATH)
    want = Counter((r.doc_id, max(1, len(t.encode(r.text or "", add_special_tokens=False).ids))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in narrow.collect()) == want
    tokens = Counter()
    for r in narrow.collect():
        tokens[r.source] += r.n_tokens
    shares = [n / sum(tokens.values()) for n in tokens.values()]
    assert a == pytest.approx(exponent_of(shares, entropy, repeats), abs=2e-5)
    out = mixing.realise(narrow, plan).collect()
    spent, biggest, times = Counter(), Counter(), Counter()
    for r in out:
        spent[r.source] += r.n_tokens
        biggest[r.source] = max(biggest[r.source], r.n_tokens)
        times[r.doc_id] += 1
    for r in plan.collect():
        assert r.budget <= spent[r.source] <= r.budget + biggest[r.source]
    assert min(times.values()) >= 1 and len(times) == len(want)


def test_shuffle_branches_give_the_same(spark, sf_dir, monkeypatch):
    """With no table small enough to be broadcast, and with source statistics in Spark, results stay the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")

    def everything():
        narrow, plan, a = mixing.mixture(docs, target_entropy=0.95)
        lines = linededup.dedup_lines(docs)
        return [
            round(a, 9), Counter((r.doc_id, r.mix_epoch, r.mix_block_key) for r in mixing.realise(narrow, plan).collect()), Counter((r.doc_id, r.text) for r in lines.collect()),
            Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), Counter(r.doc_id for r in simhash.deduplicated(docs, similarity=0.8).collect()),
        ]

    want = everything()
    for module in (common, linededup, mixing, simhash):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert everything() == want


def test_sources_alike_and_empty(spark):
    docs = spark.createDataFrame([(i, "a b c", s, "x") for i in range(30) for s in ("p", None)], "doc_id long, text string, source string, n_tokens string")
    mixed = mixing.mix(docs, target_entropy=0.95)
    assert mixed.columns == docs.columns and mixed.select(F.countDistinct("doc_id")).first()[0] == 30
    assert mixing.mix(docs.limit(0), target_entropy=0.95).count() == 0
