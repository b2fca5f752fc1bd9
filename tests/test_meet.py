"""Counting and profiles by buckets: what is held, that plans have no join of positions, and results against plain ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kspec.functions import minimizer
from kspec.functions.kmer import windows
from kspec.operators import phasing, profile
from kspec.operators.table import KmerTable, joint_counts
from kspec.plans.catalog import Q, ROLES, _counts, _table


def pieces(n, seed=1):
    rng = random.Random(seed)
    return [bytes(rng.choice(b"acgt") for _ in range(400)) for _ in range(n)]


def test_buckets_leave_when_complete(monkeypatch):
    """Of many buckets no more than GROUP windows and one bucket's k-mers are held; before, k-mers stayed until a bucket happened to end with a full group."""
    monkeypatch.setattr(minimizer, "GROUP", 500)
    k, parts = 13, pieces(60)
    batches = [pa.RecordBatch.from_arrays([pa.array([1] * 10, pa.int32()), pa.array([0] * 10, pa.int32()), pa.array(parts[i : i + 10], pa.binary())], names=["mask", "start", "part"]) for i in range(0, 60, 10)]
    rows = pa.Table.from_batches(list(minimizer._spread(k, 64)(iter(batches)))).sort_by("bucket").combine_chunks().to_batches()[0]
    taken = []
    out = []
    for batch in minimizer._counted(k, ["n"])(taken.append(i) or rows.slice(i, 5) for i in range(0, len(rows), 5)):
        out.append((len(taken), len(batch)))
    assert sum(n for _, n in out) == sum(len({w}) for w in {min(x[i : i + k], x[i : i + k].translate(bytes.maketrans(b"acgt", b"tgca"))[::-1]) for x in parts for i in range(388)})
    largest = max(np.unique(rows.column("bucket").to_numpy(), return_counts=True)[1])
    assert max(n for _, n in out) <= 500 + 2 * 24000 // 64 * 4 and out[0][0] < len(taken) / 4, (out, largest)


@pytest.mark.parametrize("k", [13, 31, 40, 62])
def test_profiles_of_sequences(spark, k):
    rng = random.Random(k)
    base = "".join(rng.choice("acgt") for _ in range(300))
    seqs = [base, base[50:200] + "-" + base[:90], base[::-1].translate(str.maketrans("acgt", "tgca")), "a" * 150, "acg", "", None, "".join(rng.choice("acgt") for _ in range(20000)) + base]
    df = spark.createDataFrame([*enumerate(seqs), (None, base)], "seq_id long, seq string")
    counts = joint_counts(df, k, {"x": "seq_id % 2 = 0", "y": "seq_id in (1, 7)"}).where("x != 1")
    columns = {"a": "x", "b": "y"}
    plain = profile.profile(windows(df, k), counts, columns)
    assert sorted(map(str, profile.positions(df, counts, k, columns).collect())) == sorted(map(str, plain.select("seq_id", "pos", "a", "b").collect()))
    reads = profile.profile(windows(df, k), counts, {"read_cnt": "y"}).where("seq_id is not null")
    own = df.where("seq_id is not null")
    assert sorted(profile.unsupported(own, counts, k, "y").collect()) == sorted(profile.unsupported_bed(reads, k).collect())
    assert sorted(map(str, profile.scaffold_quality(own, counts, k, "y").collect())) == sorted(map(str, profile.scaffold_qv(reads, k).collect()))
    runs = profile.profile(windows(own, k, runs=True), counts, {"mat_cnt": "x", "pat_cnt": "y"})
    assert sorted(profile.blobs(own, counts, k, "x", "y", ("seq_id",)).collect()) == sorted(profile.hap_blob(runs, ("seq_id",)).collect())
    marks = counts.where("(x > 0) != (y > 0)").select("kmer", F.col("x").alias("mat"), F.col("y").alias("pat"))
    sites = profile.profile(windows(own, k), marks, {"mat_cnt": "mat", "pat_cnt": "pat"})
    assert sorted(phasing.sites_in(own, marks, k, ("seq_id",)).collect()) == sorted(phasing.sites_of(sites, k, ("seq_id",)).collect())


@pytest.mark.parametrize("name", ["relative_profile", "scaffold_qv", "unsupported_bed", "hap_blob", "hap_sites", "assembly_qv", "blob_limit"])
def test_no_position_is_joined(spark, sf_dir, name):
    assert "Join" not in Q[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_sets_of_joint_counts_are_filters(spark, sf_dir):
    c = _counts(spark, sf_dir)
    joint = {r: _table(c, r) for r in ROLES}
    plain = {r: KmerTable(t.df, t.k) for r, t in joint.items()}
    for make in (lambda t: t["mat"].minus(t["pat"]), lambda t: t["child"].intersect(t["asm1"].between(2)), lambda t: t["asm1"].between(1, 3).intersect(t["asm2"], "sum"), lambda t: t["asm1"].between(2).union(t["asm2"])):
        got, want = make(joint).df, make(plain).df
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") < want._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


@pytest.mark.parametrize("name", ["stacked_peak", "axis_limits", "plot_limits", "inherited_pat", "hapmers_pat", "block_stats", "block_blob"])
def test_counts_are_made_once(spark, sf_dir, name):
    """What is read twice is kept: nothing but the kept files is in the plan."""
    assert "MapInArrow" not in Q[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_a_piece_is_encoded_by_itself(spark, tmp_path):
    """Positions of a piece come as sorted rows, not as one list: a row of a list for each of thousands of pieces in a batch took an executor's memory."""
    from kspec.sources import binary

    rows = [(s, 16384 * p + at, 1 + (at + s) % 7) for s in range(3) for p in range(2) for at in range(0, 16384, 4096)]
    prof, lengths = spark.createDataFrame(rows, "seq_id long, pos long, v long"), spark.createDataFrame([(s, 32000) for s in range(3)], "seq_id long, n_pos long")
    binary.write_profiles(prof, lengths, str(tmp_path / "p"), 5, "v", parts=2)
    ids = spark.createDataFrame([(10 * s, s) for s in range(3)], "seq_id long, number long")
    got = {(r.seq_id, r.pos): r.v for r in binary.read_profiles(spark, str(tmp_path / "p"), "v", block=2, ids=ids).where("v > 0").collect()}
    assert got == {(10 * s, pos): v for s, pos, v in rows if pos < 32000}
    held = []
    batches = (held.append(i) or pa.RecordBatch.from_arrays([pa.array([i] * 2), pa.array([0] * 2), pa.array([-1, 0]), pa.array([16384, 0]), pa.array([b"", b"\1\0" * 4])], names=["seq_id", "piece", "pos", "n", "values"]) for i in range(3))
    assert [b.to_pylist() for b in binary._encode(batches, 16384)][0][0]["first"] == 1
