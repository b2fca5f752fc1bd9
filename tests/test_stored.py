"""Stored tables: seeks read single files, buckets join without a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from kspec.functions.kmer import unpack
from kspec.operators.matrix import joined_counts
from kspec.operators.stored import SortedTable, attach_buckets, joined_buckets, write_buckets
from kspec.operators.table import KmerTable


def sequences(seed, n, length):
    rng = random.Random(seed)
    return [(i, "".join(rng.choices("acgt", k=length))) for i in range(n)]


@pytest.fixture(params=[7, 40])
def tables(spark, request):
    return [KmerTable.count(spark.createDataFrame(sequences(s, 6, 300), "seq_id long, seq string"), request.param) for s in (1, 2)]


def plain(table):
    return sorted((r.kmer, r.cnt) for r in table.decoded().collect())


def letters(df, k):
    return [tuple(r) for r in df.select(unpack(F.col("kmer"), k).alias("kmer"), "cnt", "ordinal").orderBy("ordinal").collect()]


def test_seek(spark, tmp_path, tables):
    table, k = tables[0], tables[0].k
    want = [(w, n, i) for i, (w, n) in enumerate(plain(table))]
    stored = SortedTable.write(table, str(tmp_path / "t"), files=5)
    files = stored.index().orderBy("start").collect()
    assert len(files) > 2 and stored.count() == len(want) and plain(stored.table()) == [(w, n) for w, n, _ in want]
    edge = files[1].start
    for at, n in ((0, 3), (edge - 2, 5), (edge, 1), (len(want) - 2, 9), (len(want), 4), (5, 0), (0, len(want))):
        assert letters(stored.from_ordinal(at, n), k) == want[at : at + n], (at, n)
    for word, n in (("a" * k, 4), ("t" * k, 4), (want[edge][0], 2), (want[edge - 1][0], 3), ("c" + "a" * (k - 1), 50)):
        assert letters(stored.from_key(word, n), k) == [r for r in want if r[0] >= word][:n], word
    turned = want[9][0][::-1].translate(str.maketrans("acgt", "tgca"))
    assert letters(stored.find(turned.upper()), k) == [want[9]]
    assert stored.find("a" * k).count() == sum(w == "a" * k for w, _, _ in want)
    one = stored.from_ordinal(edge, 1)._jdf.queryExecution().toString()
    assert one.count(files[1].file.split("/")[-1]) >= 1 or "InMemoryFileIndex(1 paths)" in one
    assert SortedTable.open(spark, str(tmp_path / "t")).k == k
    for bad in (lambda: SortedTable.open(spark, str(tmp_path / "t"), k + 1), lambda: stored.from_ordinal(-1, 3), lambda: stored.find("acgn")):
        with pytest.raises(ValueError):
            bad()
    empty = SortedTable.write(KmerTable(table.df.where("false"), k), str(tmp_path / "e"))
    assert empty.count() == 0 and empty.from_key("a" * k, 3).count() == 0 and empty.from_ordinal(0, 3).count() == 0
    with pytest.raises(ValueError):
        SortedTable.open(spark, str(tmp_path / "e"))


def test_buckets(spark, tmp_path, tables):
    k = tables[0].k
    want = sorted((r.kmer, r.cnt1, r.cnt2) for r in joined_counts(*tables).select(unpack(F.col("kmer"), k).alias("kmer"), "cnt1", "cnt2").collect())
    stored = [write_buckets(t, f"buckets_{k}_{i}", str(tmp_path / f"b{i}"), 4) for i, t in enumerate(tables)]
    again = [attach_buckets(spark, f"attached_{k}_{i}", str(tmp_path / f"b{i}"), k, 4) for i in range(2)]
    for pair in (stored, again):
        both = joined_buckets(*pair)
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.kmer, r.cnt1, r.cnt2) for r in both.select(unpack(F.col("kmer"), k).alias("kmer"), "cnt1", "cnt2").collect()) == want
    for i in range(2):
        spark.sql(f"DROP TABLE buckets_{k}_{i}")
        spark.sql(f"DROP TABLE attached_{k}_{i}")
