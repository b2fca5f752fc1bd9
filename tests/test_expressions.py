"""Count expressions against dictionaries."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kspec.plans import expressions as E


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(2)
    rows = [(i, *(rng.choice([0, 0, 1, 2, 5, 9, 2000]) for _ in range(3))) for i in range(300)]
    return spark.createDataFrame(rows, "kmer long, a int, b long, c long"), [{r[0]: r[j] for r in rows if r[j]} for j in (1, 2, 3)]


def keep(x, on):
    return {m: n for m, n in x.items() if on(m, n)}


def test_outputs(counts):
    df, (a, b, c) = counts
    want = {
        "A-B": keep(a, lambda m, n: m not in b), "B &. A": keep(b, lambda m, n: m in a), "A&+B": {m: a[m] + b[m] for m in a if m in b}, "A|+B": dict(Counter(a) + Counter(b)), "A|.B": b | a,
        "B&.A[2]": keep(b, lambda m, n: a.get(m) == 2), "A[5-]": keep(a, lambda m, n: n >= 5), "A[-2]": keep(a, lambda m, n: n <= 2), "A[ 2 - 5 ]": keep(a, lambda m, n: 2 <= n <= 5),
        "C-#(A|B)": keep(c, lambda m, n: m not in a and m not in b), "C&.#(A&B)": keep(c, lambda m, n: m in a and m in b), "(A&+B)-C": {m: a[m] + b[m] for m in a if m in b and m not in c},
        "(A-B)-C": keep(a, lambda m, n: m not in b and m not in c), "A-B-C": keep(a, lambda m, n: m not in b and m not in c), "A-(B-C)": keep(a, lambda m, n: m not in b or m in c), "A|+B&.C": dict(Counter(a) + Counter(keep(b, lambda m, n: m in c))),
        "(A|+B)[3]": keep(dict(Counter(a) + Counter(b)), lambda m, n: n == 3), "#A": dict.fromkeys(a, 1), "(A[2-]&.B)[-5]": keep(a, lambda m, n: 2 <= n <= 5 and m in b), "C&.(A-B)": keep(c, lambda m, n: m in a and m not in b),
    }
    outputs = {f"o{i}": text for i, text in enumerate(want)}
    rows = E.evaluate(df, outputs, ["a", "b", "c"]).collect()
    for name, text in outputs.items():
        assert {r.kmer: r[name] for r in rows if r[name]} == want[text], text
    assert all(any(r[n] for n in outputs) for r in rows)
    bins = {(r.output, r.multiplicity): (r.n_unique, r.n_instances) for r in E.histograms(df, outputs, ["a", "b", "c"], 1000).collect()}
    expected = {}
    for name, text in outputs.items():
        for n in want[text].values():
            u, i = expected.get((name, min(n, 1000)), (0, 0))
            expected[name, min(n, 1000)] = u + 1, i + n
    assert bins == expected


def test_fixed_expressions(counts):
    df, (a, b, c) = counts
    rows = E.evaluate(df, {**E.solid(5), **{f"t{n}": t for n, t in E.TWO_ASSEMBLIES.items()}}, ["a", "b", "c"]).collect()
    assert {r.kmer for r in rows if r["0"]} == {m for m in a if c.get(m, 0) >= 5} and {r.kmer for r in rows if r["2"]} == {m for m in {*a, *b} if c.get(m, 0) >= 5}
    classes = Counter(n for r in rows for n in ("t0", "t1", "t2", "t3") if r[n])
    assert sum(classes.values()) == len(c) and classes["t3"] == len({*a} & {*b} & {*c})


@pytest.mark.parametrize("text", ["", "A&B", "A|B", "A-", "-A", "A&.", "(A", "A)", "A B", "A[]", "A[-]", "D", "A&.#(A[x])", "a", "A&*B", "#"])
def test_what_cannot_be_read(text):
    with pytest.raises(ValueError):
        E.compiled(text, ["a", "b", "c"])


def test_counts_that_are_not_used(spark):
    df = spark.createDataFrame([(1, 3, 4)], "kmer long, a long, b long")
    assert E.evaluate(df, {"x": "A&.#(B[4]|A[9])"}, ["a", "b"]).select(F.col("x")).first().x == 3
