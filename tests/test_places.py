"""Short k-mers by place: sums beyond a byte and two, few and many places a bucket, what travels, and results against plain ones."""

import random
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kspec.functions import minimizer, places
from kspec.operators import profile
from kspec.operators.table import joint_counts
from kspec.plans.catalog import K, Q, ROLES, _both, _counts
from kspec.sources import binary
from kspec.sources.sequences import in_sequence


def canonical(w):
    return min(w, w.translate(str.maketrans("acgt", "tgca"))[::-1])


def key(w):
    return int(w.translate(str.maketrans("acgt", "0123")), 4)


def words(seq, k):
    return [key(canonical(seq[i : i + k])) for i in range(len(seq) - k + 1) if "-" not in seq[i : i + k]]


def batches(seqs, masks, size):
    for at in range(0, len(seqs), size):
        part = [s.encode() for s in seqs[at : at + size]]
        yield pa.RecordBatch.from_arrays([pa.array(masks[at : at + size], pa.int32()), pa.array([0] * len(part), pa.int32()), pa.array(part, pa.binary())], names=["mask", "start", "part"])


@pytest.mark.parametrize("k", [1, 2, 5, 8, 9, 13])
def test_sums_of_any_size(k, monkeypatch):
    monkeypatch.setattr(places, "WAITING", 3)
    rng = random.Random(k)
    seqs = ["a" * 900, "".join(rng.choice("acgt") for _ in range(70_000)), *["".join(rng.choice("acgt-") for _ in range(rng.randint(k, 200))) for _ in range(60)], "ac" * 400, "a" * 900, "-" * 50]
    masks = [rng.choice([1, 2, 3]) for _ in seqs]
    want = [Counter(), Counter()]
    for s, m in zip(seqs, masks, strict=True):
        for label in range(2):
            if m >> label & 1:
                want[label].update(words(s, k))
    sent = [b for turn in range(2) for b in places._summed(k, 2)(batches(seqs[turn::2], masks[turn::2], 7))]
    rows = pa.Table.from_batches(sent).sort_by("bucket").to_batches(max_chunksize=3)
    got = [r for b in places._totals(k, ["x", "y"])(iter(rows)) for r in b.to_pylist()]
    assert len({r["kmer"] for r in got}) == len(got) == len(want[0] | want[1])
    assert {r["kmer"]: (r["x"], r["y"]) for r in got} == {w: (want[0][w], want[1][w]) for w in want[0] | want[1]}


@pytest.mark.parametrize("k", range(1, 14))
def test_places(k):
    """A place for a k-mer and its reverse complement, and a key for each place."""
    rng = random.Random(k)
    seq = "".join(rng.choice("acgt") for _ in range(3000))
    at = places.places_at(places.codes(seq.encode())[0], k)
    want = words(seq, k)
    assert places.key_of(at, k).tolist() == want and places.place_of(np.array(want), k).tolist() == at.tolist() and 0 <= at.min() and at.max() < places.n_places(k)
    assert len(set(at.tolist())) == len(set(want))


def test_counts_beyond_two_bytes(spark, tmp_path):
    rows = [(5, 65534, 1), (9, 65535, 70_000), (key(canonical("t" * 12 + "g")), 1 << 40, 0), (77, 0, 65536)]
    spark.createDataFrame(rows, "kmer long, x long, y long").repartition(3).write.parquet(str(tmp_path / "t"))
    table = places.table_of(f"file://{tmp_path}/t", 13, ["x", "y"])
    assert table.at(places.place_of(np.array([77, 9, 6, 5, 4**13 - 2, 9], dtype=np.int32), 13)).tolist() == [[0, 65536], [65535, 70_000], [0, 0], [65534, 1], [1 << 40, 0], [65535, 70_000]]
    assert places.table_of(f"file://{tmp_path}/t", 13, ["y"]).at(places.place_of(np.array([9]), 13)).tolist() == [[70_000]] and len(places._last) == 1


def test_only_runs_of_positions_travel(spark, sf_dir):
    """Parts of runs are those of valid windows within a piece; before, each few windows of one minimizer were a row that was shuffled twice."""
    both, counts = _both(spark, sf_dir).where("octet_length(seq) < 16000"), _counts(spark, sf_dir, "mat", "pat")
    parts = profile.part_runs(both, counts, K, {"mat": "mat", "pat": "pat"}, 1, {"size": lambda c: 1}, keep=("assembly", "seq_id"))
    assert parts.count() == profile.contigs(both, K, ("assembly", "seq_id")).count()


@pytest.mark.parametrize(("name", "shuffles"), [("relative_profile", 1), ("hap_blob", 2)])
def test_no_position_is_shuffled(spark, sf_dir, name, shuffles):
    """Pieces are dealt, and the runs of hap_blob meet; before, positions met their counts in a shuffle."""
    plan = Q[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == shuffles, plan


def test_many_files_are_not_dealt(spark, tmp_path, monkeypatch):
    """Where the scan has files for each core, texts don't go through a shuffle before they are read."""
    from kspec.functions import kmer

    df = spark.createDataFrame([(i, "acgtt" * 20) for i in range(32)], "seq_id long, seq string")
    df.repartition(16).write.parquet(str(tmp_path / "s"))
    seqs = spark.read.parquet(str(tmp_path / "s"))
    exchanges = lambda: kmer.chunked(seqs, 5, ("seq_id",), 64)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges() == 1
    monkeypatch.setattr(kmer, "FILE_BYTES", 100)
    assert exchanges() == 0 and kmer.chunked(seqs, 5, ("seq_id",), 64).count() == 64


def test_many_labels_go_by_minimizers(spark):
    df = spark.createDataFrame([(i, "acgttgcatgcatgcaa" * 3) for i in range(9)], "seq_id long, seq string")
    labels = {f"l{i}": f"seq_id % 3 = {i % 3}" for i in range(6)}
    assert not places.fits(13, 6) and places.fits(13, 2) and places.fits(9, 6) and not places.fits(14, 1)
    six = joint_counts(df, 13, labels).collect()
    two = {r.kmer: (r.a, r.b) for r in joint_counts(df, 13, {"a": "seq_id % 3 = 0", "b": "seq_id % 3 = 1"}).collect()}
    assert {r.kmer: (r.l0, r.l1) for r in six} == two and ROLES


@pytest.mark.parametrize("k", [5, 13])
def test_profiles_from_sequences(spark, tmp_path, monkeypatch, k):
    """Files from packed bases: empty, short and long sequences, breaks at the edges of pieces, counts above the greatest, ids with gaps, a null id left out; profiles read one by one and together."""
    monkeypatch.setattr(binary, "PIECE", 64)
    monkeypatch.setattr(places, "LOOKED_UP", 300)
    monkeypatch.setattr(binary, "READ", 50)
    rng = random.Random(k)
    texts = ["", None, "acg", "a" * 64 + "-" + "c" * 500, "-" * 90, *["".join(rng.choice("acgt" if rng.random() > 0.03 else "-") for _ in range(n)) for n in (k - 1, k, 63 + k, 64 + k, 1000, 64, 65, 300)]]
    ids = [-7, 5, 6, 9, 10, *range(100, 100 + 3 * (len(texts) - 5), 3)]
    rows = list(zip(ids, texts, strict=True))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, "acgt" * 9)], "seq_id long, seq string").repartition(3)
    every = Counter(w for s in texts if s for w in words(s, k))
    counts = spark.createDataFrame([(w, n * 400 if n < 80 else 1 << 33) for w, n in every.items() if w % 5], "kmer long, cnt long")
    numbers = in_sequence(df.select("seq_id"))
    binary.write_sequences(df, numbers, counts, str(tmp_path / "p"), k, "cnt", parts=4)
    value = {r.kmer: min(r.cnt, 32767) for r in counts.collect()}
    want = [[0 if "-" in s[i : i + k] else value.get(key(canonical(s[i : i + k])), 0) for i in range(len(s) - k + 1)] for s in (x or "" for x in texts)]
    assert max(map(max, filter(None, want))) == 32767 and struct.unpack("<ii", (tmp_path / "p.prof").read_bytes()) == (k, 4)
    assert [binary.fetch(str(tmp_path / "p"), n, k).tolist() for n in range(len(texts))] == want
    got = {(r.seq_id, r.pos): r.cnt for r in binary.read_profiles(spark, str(tmp_path / "p"), block=3, ids=numbers).collect()}
    assert got == {(i, pos): n for i, v in zip(ids, want, strict=True) for pos, n in enumerate(v)}
    assert not [p for p in tmp_path.iterdir() if "draft" in p.name]


def test_no_value_is_shuffled(spark, sf_dir, monkeypatch):
    """binary_profiles sorts no counts by position; before, the texts, their counts and the encoded pieces each went through shuffles."""
    monkeypatch.setattr(binary, "write_stretches", None)
    assert Q["binary_profiles"](spark, sf_dir).where("read_cnt > 0").count() > 1000


def test_no_profile_of_nothing(spark, tmp_path):
    none, counts = spark.createDataFrame([], "seq_id long, seq string"), spark.createDataFrame([(1, 1)], "kmer long, cnt long")
    binary.write_sequences(none, in_sequence(none.select("seq_id")), counts, str(tmp_path / "p"), 5, "cnt")
    assert (tmp_path / "p.prof").read_bytes() == struct.pack("<ii", 5, 0) and binary.read_profiles(spark, str(tmp_path / "p")).isEmpty()


def test_long_kmers_go_by_minimizers(spark, tmp_path):
    df = spark.createDataFrame([(4, "acgttgcaacgtacgtacgatcgatcgatcgactagc"), (2, "ac")], "seq_id long, seq string")
    binary.write_sequences(df, in_sequence(df.select("seq_id")), joint_counts(df, 21, {"cnt": "true"}), str(tmp_path / "p"), 21, "cnt", parts=2)
    assert binary.fetch(str(tmp_path / "p"), 0, 21).tolist() == [] and binary.fetch(str(tmp_path / "p"), 1, 21).tolist() == [1] * 17


@pytest.mark.parametrize("name", ["relative_profile", "hap_blob", "binary_profiles", "scaffold_qv", "assembly_qv", "unsupported_bed", "hap_sites"])
def test_queries_count_what_they_need(spark, sf_dir, monkeypatch, name):
    """By place, so that each k-mer is sent once a task; six roles at once went by minimizers, as stretches of all windows."""
    monkeypatch.setattr(minimizer, "_spread", None)
    monkeypatch.setattr(minimizer, "_placed", None)
    assert not Q[name](spark, sf_dir).isEmpty()
