"""Ids pass as they are, budgets hold however rows are named, and secrets have no greatest length."""

import random
from functools import partial

import public_tokenizers
import pytest

from kspec.llm import bpe, mixing, pii, records, simhash, toxicity, webp

BIG = 9007199254740993  # a double can't hold it, nor its neighbour
IDS = [None, BIG, BIG + 2, 5, -BIG, None]


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(i, f"text number {n} of some words") for n, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_ids_stay(few):
    want = sorted(IDS, key=str)
    assert ids(bpe.encode_decode(few, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)) == want
    assert ids(webp.media(few)) == want
    assert ids(simhash.near_duplicates(few)) == want and ids(simhash.similar_documents(few)) == want
    assert ids(toxicity.scored(few, toxicity.Model({b"some": 0.5}, 0.0, 0.1))) == want
    back = records.read_records(records.write_records(few, public_tokenizers.path("byte_bpe_50k.json")))
    assert [r.doc_id for r in back.orderBy("start").collect()] == [None, None, -BIG, 5, BIG, BIG + 2]


def test_equal_documents_with_great_ids(spark):
    text = "the same words stand in both of these two documents here"
    docs = spark.createDataFrame([(BIG, text), (BIG + 2, text), (None, "something else that no other row says at all")], "doc_id long, text string").coalesce(1)
    for how in ({"similarity": 0.8}, {}):
        assert ids(simhash.deduplicated(docs, **how)) == sorted([BIG, None], key=str)
    assert {r.component_id for r in simhash.similar_documents(docs).collect()} == {BIG, None}


@pytest.mark.parametrize("same_id", [None, 7])
def test_budget_with_one_id(spark, same_id):
    """20,000 rows of one id: the end of the budget falls between them."""
    rng = random.Random(1)
    rows = [(same_id, f"{i} " + "w " * rng.randrange(4), "a") for i in range(20_000)] + [(i, f"x {i}", "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow, plan, _ = mixing.mixture(docs, target_entropy=0.95, max_repeats=2.0)
    spent = {r["source"]: (r["sum(n_tokens)"], r["max(n_tokens)"]) for r in mixing.realise(narrow, plan).groupBy("source").agg({"n_tokens": "sum"}).join(narrow.groupBy("source").agg({"n_tokens": "max"}), "source").collect()}
    for r in plan.collect():
        total, longest = spent[r.source]
        assert r.budget <= total <= r.budget + longest
    assert mixing.mix(docs, target_entropy=0.95, max_repeats=2.0).count() == mixing.realise(narrow, plan).count()


def test_long_secrets(spark):
    rng = random.Random(2)
    token = partial(lambda n: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789", k=n)))
    jwt = f"eyJ{token(40)}.eyJ{token(6000)}.{token(43)}"
    cases = [("secret", f"api secret token {{}} end", token(600)), ("key", "key {} end", "ghp_" + token(300)), ("key", "auth {} end", jwt)]
    docs = spark.createDataFrame([(i, t.format(s)) for i, (_, t, s) in enumerate(cases)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data_digest(docs).collect()}
    for i, (kind, t, s) in enumerate(cases):
        at = t.index("{}")
        assert f"{kind}:{at}:{at + len(s)}" in spans[i].split(","), spans[i]
