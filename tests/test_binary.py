"""Binary tables, histograms and profiles: files written byte by byte by hand are read, and files written in parallel are what a plain writer makes."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kspec.functions.kmer import windows
from kspec.operators import histogram, profile
from kspec.operators.table import KmerTable
from kspec.sources import binary

CODE = {"a": 0, "c": 1, "g": 2, "t": 3}


def packed(word):
    word += "a" * (-len(word) % 4)
    return bytes(sum(CODE[c] << 6 - 2 * i for i, c in enumerate(word[at : at + 4])) for at in range(0, len(word), 4))


def by_hand(folder, name, k, parts, prefix_bytes, least=1):
    """parts: lists of (word, count) in order."""
    index = [0] * 256**prefix_bytes
    for p, rows in enumerate(parts, 1):
        data = struct.pack("<iq", k, len(rows))
        for word, n in rows:
            key = packed(word)
            index[int.from_bytes(key[:prefix_bytes], "big")] += 1
            data += key[prefix_bytes:] + struct.pack("<H", n)
        (folder / f".{name}.ktab.{p}").write_bytes(data)
    (folder / f"{name}.ktab").write_bytes(struct.pack("<iiii", k, len(parts), least, prefix_bytes) + np.cumsum(index).astype("<i8").tobytes())


def rows_of(table):
    return sorted((r.kmer, r.cnt) for r in table.decoded().collect())


@pytest.mark.parametrize(("k", "prefix"), [(5, 1), (13, 2), (21, 3), (31, 2), (40, 2), (62, 1)])
def test_tables(spark, tmp_path, monkeypatch, k, prefix):
    monkeypatch.setattr(binary, "ROWS", 100)
    rng = random.Random(k)
    words = sorted({"".join(rng.choices("acgt", k=k)) for _ in range(700)})
    rows = [(w, rng.choice([1, 2, 300, 32767])) for w in words]
    by_hand(tmp_path, "hand", k, [rows[:250], [], rows[250:]], prefix)
    table = binary.read_table(spark, str(tmp_path / "hand"))
    assert table.k == k and rows_of(table) == rows
    assert rows_of(binary.read_table(spark, str(tmp_path / "hand"), 300)) == [r for r in rows if r[1] >= 300]
    big = KmerTable(table.df.withColumn("cnt", F.col("cnt") * 3), k)
    binary.write_table(big, str(tmp_path / "made"), parts=3, prefix_bytes=prefix)
    stub = (tmp_path / "made.ktab").read_bytes()
    n_parts = struct.unpack_from("<i", stub, 4)[0]
    data = [(tmp_path / f".made.ktab.{p}").read_bytes() for p in range(1, n_parts + 1)]
    want = [(w, min(3 * n, 32767)) for w, n in rows]
    assert struct.unpack_from("<iii", stub)[::2] == (k, 3) and sum(struct.unpack_from("<q", d, 4)[0] for d in data) == len(rows)
    assert b"".join(d[12:] for d in data) == b"".join(packed(w)[prefix:] + struct.pack("<H", n) for w, n in want)
    assert rows_of(binary.read_table(spark, str(tmp_path / "made"))) == want
    assert not [p for p in tmp_path.iterdir() if "draft" in p.name or "body" in p.name]
    (tmp_path / ".hand.ktab.2").write_bytes(struct.pack("<iq", k + 1, 0))
    with pytest.raises(ValueError):
        binary.read_table(spark, str(tmp_path / "hand"))


def test_empty_table(spark, tmp_path):
    empty = KmerTable(spark.createDataFrame([], "kmer long, cnt long"), 9)
    binary.write_table(empty, str(tmp_path / "e"), parts=2)
    assert rows_of(binary.read_table(spark, str(tmp_path / "e"))) == []
    for bad in (0, 4):
        with pytest.raises(ValueError):
            binary.write_table(empty, str(tmp_path / "e"), prefix_bytes=bad)


def test_histograms(spark, tmp_path):
    rows = [(1, 5, 5), (2, 7, 14), (9, 2, 18), (40, 1, 40), (50, 3, 150)]
    h = spark.createDataFrame(rows, "multiplicity long, n_unique long, n_instances long")
    binary.write_histogram(h, str(tmp_path / "h"), 13, 2, 40)
    data = (tmp_path / "h.hist").read_bytes()
    assert data == struct.pack("<iiiqq", 13, 2, 40, 19, 190) + struct.pack("<39q", 12, *[0] * 6, 2, *[0] * 30, 4)
    assert sorted(map(tuple, binary.read_histogram(spark, str(tmp_path / "h"), 13).collect())) == [(2, 12, 19), (9, 2, 18), (40, 4, 190)]
    with pytest.raises(ValueError):
        binary.read_histogram(spark, str(tmp_path / "h"), 14)
    with pytest.raises(ValueError):
        binary.write_histogram(h, str(tmp_path / "h"), 13, 5, 4)
    words = KmerTable.count(spark.createDataFrame([(0, "acgtacgtacgttgca")], "seq_id long, seq string"), 4)
    binary.write_histogram(histogram.histogram(words.df), str(tmp_path / "w"), 4)
    assert sorted(map(tuple, binary.read_histogram(spark, str(tmp_path / "w")).collect())) == sorted(map(tuple, histogram.histogram(words.df).collect()))


@pytest.mark.parametrize(("data", "values"), [
    (b"", []), (b"\x05", [5]), (b"\x81\x02", [258]), (b"\x05\x03", [5] * 4), (b"\x05\x41\x02", [5, 6, 6, 6]), (b"\x28\x60\x5f", [40, 8, 39]), (b"\x05\x80\x40", [5, 69]), (b"\xff\xff\xff\xff", [32767, 32766]),
    (b"\x00\xff\xff", [0, 32767]), (b"\x81\x00\xff\x00\x80\x21", [256, 0, 33]), (b"\x07\x3f\x01", [7] * 65),
])
def test_codec_by_hand(data, values):
    assert binary.decoded(data).tolist() == values


def test_codec_round_trips():
    rng = random.Random(1)
    for n in (1, 2, 64, 65, 500):
        for top in (2, 40, 200, 32767):
            values = []
            while len(values) < n:
                values += [rng.randint(0, top)] * rng.choice([1, 1, 2, 63, 64, 130])
            values = np.array(values[:n])
            assert binary.decoded(binary.encoded(values)).tolist() == values.tolist()
    assert binary.encoded(np.array([5] * 4)) == b"\x05\x03" and binary.encoded(np.array([40, 8, 39])) == b"\x28\x60\x5f" and binary.encoded(np.array([256, 0, 33])) == b"\x81\x00\xff\x00\x80\x21"


def test_profiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "PIECE", 50)
    rng = random.Random(3)
    k = 5
    seqs = ["".join(rng.choice("acgt" if rng.random() > 0.02 else "-") for _ in range(n)) for n in (300, 4, 5, 0, 54, 1000, 49, 50, 104)] + ["-" * 120, "a" * 400]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    prof = profile.profile(windows(df, k), KmerTable.count(df, k).df.withColumn("cnt", F.col("cnt") * 90), {"own": "cnt"})
    lengths = df.select("seq_id", F.greatest(F.length("seq") - k + 1, F.lit(0)).cast("long").alias("n_pos"))
    want = {i: [0] * max(len(s) - k + 1, 0) for i, s in enumerate(seqs)}
    for r in prof.collect():
        want[r.seq_id][r.pos] = min(r.own, 32767)
    binary.write_profiles(prof, lengths, str(tmp_path / "p"), k, "own", parts=3)
    assert struct.unpack("<ii", (tmp_path / "p.prof").read_bytes()) == (k, 3)
    for i in want:
        assert binary.fetch(str(tmp_path / "p"), i, k).tolist() == want[i], i
    got = {i: {} for i in want}
    for r in binary.read_profiles(spark, str(tmp_path / "p"), "own", block=2).collect():
        got[r.seq_id][r.pos] = r.own
    assert {i: [v[p] for p in range(len(v))] for i, v in got.items()} == want
    for bad in ((len(seqs), k), (-1, k), (0, k + 1)):
        with pytest.raises(ValueError):
            binary.fetch(str(tmp_path / "p"), *bad)
    # by hand: two parts, the first of two sequences
    (tmp_path / "h.prof").write_bytes(struct.pack("<ii", 7, 2))
    for p, first, profiles in ((1, 0, [b"\x05\x03", b""]), (2, 2, [b"\x28\x60\x5f"])):
        (tmp_path / f".h.prof.{p}").write_bytes(b"".join(profiles))
        (tmp_path / f".h.pidx.{p}").write_bytes(struct.pack("<iqq", 7, first, len(profiles)) + np.cumsum([len(x) for x in profiles]).astype("<i8").tobytes())
    assert [binary.fetch(str(tmp_path / "h"), i).tolist() for i in range(3)] == [[5] * 4, [], [40, 8, 39]]
    assert sorted(map(tuple, binary.read_profiles(spark, str(tmp_path / "h")).collect())) == [(0, p, 5) for p in range(4)] + [(2, 0, 40), (2, 1, 8), (2, 2, 39)]


def test_histogram_in_a_new_folder(spark, tmp_path):
    hist = spark.createDataFrame([(1, 3, 3), (7, 2, 14)], "multiplicity long, n_unique long, n_instances long")
    path = f"file://{tmp_path}/of/no/other/hist"
    binary.write_histogram(hist, path, 13, 1, 5)
    assert sorted(tuple(r) for r in binary.read_histogram(spark, path, 13).collect()) == [(1, 3, 3), (5, 2, 14)]
