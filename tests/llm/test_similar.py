"""Near-duplicates of the pipeline's stage against all pairs' Jaccard similarity of five-word shingles."""

from collections import Counter

import corpus_pipeline
from kspec.llm import simhash
from kspec.llm.common import written
from kspec.llm.linededup import dedup_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode("utf-8", "replace").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_roots(rows):
    """The least id that links reach, for each row."""
    sets, root = [brute_shingles(r.text) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(i)] = min(least.get(top(i), r.doc_id), r.doc_id)
    return [least.get(top(i)) for i in range(len(rows))]


def check(docs):
    rows = docs.collect()
    got = Counter((r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect())
    assert got == Counter((r.doc_id, c) for r, c in zip(rows, brute_roots(rows), strict=True))


def edited(words, k, by):
    return " ".join(words[:k] + [by] + words[k + 1 :])


def test_stage_drops_edited_copies(spark, sf_dir):
    """One changed word in 60 leaves 51 of 61 shingles: similar, though the three-word fingerprints differ in more than three bits."""
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words)] + [edited(words, k, f"other{k}") for k in (20, 30, 40)] + ["", None, "a b", "A  b", " ".join(words[:30])]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 6, 8]


def test_edges_of_the_bound_and_ids(spark):
    """Sets of 40 shingles: pairs just at 0.8, just below, chains, nulls, repeated ids, many copies under one beginning."""
    base = [f"w{i}" for i in range(44)]
    rows = [(5, " ".join(base)), (5, " ".join(base[4:])), (None, " ".join(base)), (None, "no one else"), (9, " ".join(base[:36])), (10, " ".join(base[:35])), (3, " ".join(base[8:] + ["x", "y"]))]
    rows += [(100 + k, edited(base + [f"v{i}" for i in range(60)], 3 + k, "z")) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], SCHEMA)
    check(docs)
    check(docs.limit(0))


def test_on_the_stages_input(spark, sf_dir):
    lines = written(dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")), "test-jaccard-lines")
    check(lines)
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
