"""The audit of sources against plain counting."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from kspec.llm import common, divergence, queries, sql

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for of, source, terms in docs:
            if of == lang:
                held.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, n in held.items() if n >= least]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s)
            said = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", said[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat, the DOG; the-cat"), ("en", "a", "the dog"), ("en", "b", "a cat and the cat"), ("en", None, None), ("en", "c", ""), ("en", "c", "zzz"), (None, "a", "x y"), (None, None, "x y"), ("", "", "x Y"), ("", "d", "x y"),
    ("de", "a", "Äpfel äpfel ÄPFEL im\x00Haus　x"), ("de", "b", "Äpfel im Haus"), ("de", "b", "Äpfel im Haus"), ("fr", "only", "un deux"), ("en", "b", "word " * 5000 + "the"), ("en", "b", "x" * 100_000),
]


@pytest.mark.parametrize("rows_joined", [common.BROADCAST_ROWS, 0])
def test_odd_rows(spark, monkeypatch, rows_joined):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_joined)
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    monkeypatch.setattr(divergence, "PAIRS", 2)
    docs = spark.createDataFrame([(*r, 1, "term", 2) for r in ROWS], "lang string, source string, text string, n int, term string, s int")
    assert sorted(tuple(r) for r in divergence.audit(docs, top=2).collect()) == brute(ROWS, top=2)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 10**6), (0, 1, 1), (5 * 10**15, 5 * 10**15, 7)], "n long, total long, terms long")
    assert [r.p for r in df.select(divergence.share("n", "total", "terms").alias("p")).collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in [(10**13, 3 * 10**13, 10**6), (0, 1, 1), (5 * 10**15, 5 * 10**15, 7)]]


def test_query(spark, sf_dir):
    df = queries.op12_divergence(spark, sf_dir)
    docs = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(docs)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(duck.execute(f"SELECT lang, source, part, item, value, rank FROM ({sql.ORACLES['op12_divergence']})").fetchall()) == got
