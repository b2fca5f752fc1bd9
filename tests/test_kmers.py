"""Tables, algebra, matrices and phasing on small cases by hand and against plain Python."""

import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kspec import cli
from kspec.functions import minimizer
from kspec.functions.kmer import CHUNK, codes, unpack, windows
from kspec.operators import histogram, matrix, profile, stats
from kspec.operators.phasing import Block, _best_split, merge_blocks
from kspec.operators.table import KmerTable, joint_counts
from kspec.plans import report
from kspec.sources.sequences import read_fasta, read_fastq
from kspec.streaming.counting import streaming_counts

COMPLEMENT = str.maketrans("acgt", "tgca")


def canon(w):
    return min(w, w[::-1].translate(COMPLEMENT))


def plain_counts(seqs, k):
    return Counter(canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1) if "-" not in s[i : i + k])


def sequences(seed, n, length):
    rng = random.Random(seed)
    return ["".join(rng.choice("acgt" if rng.random() > 0.01 else "-") for _ in range(length)) for _ in range(n)]


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


def as_dict(table):
    return {r.kmer: r.cnt for r in table.decoded().collect()}


@pytest.mark.parametrize("k", [1, 3, 4, 13, 21, 31, 32, 40, 62, 63])
def test_count(spark, k):
    seqs = [*sequences(k, 3, 3 * CHUNK + 17), "", "ac", "a" * CHUNK, "acgt" * 300, None]
    assert as_dict(KmerTable.count(frame(spark, seqs), k)) == dict(plain_counts([s for s in seqs if s], k))


def test_algebra(spark):
    a, b = (KmerTable.count(frame(spark, sequences(s, 4, 300)), 5) for s in (1, 2))
    x, y = as_dict(a), as_dict(b)
    assert as_dict(a.minus(b)) == {m: n for m, n in x.items() if m not in y}
    assert as_dict(a.intersect(b)) == {m: n for m, n in x.items() if m in y}
    assert as_dict(a.intersect(b, "sum")) == {m: n + y[m] for m, n in x.items() if m in y}
    assert as_dict(a.union(b)) == dict(Counter(x) + Counter(y))
    assert as_dict(a.between(2, 3)) == {m: n for m, n in x.items() if 2 <= n <= 3}
    cells = {(r.cnt1, r.cnt2): r.n for r in matrix.joint_matrix(matrix.joined_counts(a, b), "cnt1", "cnt2").collect()}
    assert cells == dict(Counter((x.get(m, 0), y.get(m, 0)) for m in {*x, *y}))
    word = next(iter(x))
    assert a.find(word[::-1].translate(COMPLEMENT).upper()).first().cnt == x[word]
    assert [r.cnt for r in a.from_key("aaaaa", 3).collect()] == [x[m] for m in sorted(x)[:3]]
    with pytest.raises(ValueError):
        a.minus(KmerTable.count(frame(spark, ["acgtacgt"]), 4))
    with pytest.raises(ValueError):
        a.find("acgnn")


def test_save_and_load(spark, tmp_path):
    t = KmerTable.count(frame(spark, sequences(3, 2, 200)), 6)
    t.save(str(tmp_path / "t"))
    assert as_dict(KmerTable.load(spark, str(tmp_path / "t"), 6, 2)) == as_dict(t.between(2))
    with pytest.raises(ValueError):
        KmerTable.load(spark, str(tmp_path / "t"), 7)


def hist(spark, counts):
    return spark.createDataFrame([(m, n, m * n) for m, n in counts.items()], "multiplicity long, n_unique long, n_instances long")


def test_thresholds(spark):
    h = hist(spark, {1: 90, 2: 40, 3: 40, 4: 30, 5: 50, 7: 3})
    assert histogram.first_rise(h, False).first().thresh == 3 and histogram.first_rise(h, True).first().thresh == 5
    assert tuple(histogram.solid(h).first()) == (3, 123)
    falling = hist(spark, {1: 9, 2: 5, 3: 1})
    assert histogram.first_rise(falling, True).first().thresh == 3
    folded = {r.multiplicity: (r.n_unique, r.n_instances) for r in histogram.rerange(h, 2, 5).collect()}
    assert folded == {2: (130, 170), 3: (40, 120), 4: (30, 120), 5: (53, 271)}


def test_qv_and_unsupported(spark):
    rows = [(1, p, 0 if p in (5, 6, 12, 40) else 2) for p in range(50)] + [(2, p, 1) for p in range(9)]
    prof = spark.createDataFrame(rows, "seq_id long, pos int, read_cnt long")
    bed = sorted(tuple(r) for r in profile.unsupported_bed(prof, 6).collect())
    assert bed == [(1, 5, 18), (1, 40, 46)]
    q = {r.seq_id: r for r in profile.scaffold_qv(prof, 6).collect()}
    assert q[1].miss == 4 and q[1].err_pct == pytest.approx(100 * (1 - (46 / 50) ** (1 / 6))) and q[2].qv is None


def test_no_peak(spark):
    cells = spark.createDataFrame([(0, 1, 9), (0, 2, 4)], "r long, c long, n long")
    with pytest.raises(ValueError):
        matrix.require_peak(matrix.axis_peak(cells, "r", "c", 3, 5))
    cells = spark.createDataFrame([(0, 1, 9), (0, 2, 4), (0, 3, 7), (1, 3, 7), (1, 4, 7)], "r long, c long, n long")
    assert matrix.require_peak(matrix.axis_peak(cells, "r", "c", 3, 9)) == (3, 7)


def test_sizes(spark):
    df = spark.createDataFrame([(s,) for s in (7, 3, 3, 2)], "size long")
    assert tuple(stats.size_stats(df).first()) == (4, 15, 2, 3, 7, 7)
    assert stats.size_stats(df.where("size > 9")).count() == 0


def merged(blocks, length=100, marks=50):
    return [(b.beg, b.end, b.mrk, b.opp) for b in merge_blocks([Block(*b) for b in blocks], length, marks)]


def test_merge_same_sign_anchors():
    assert merged([(0, 200, 90), (200, 210, -5), (210, 400, 80)]) == [(0, 400, 170, -5)]


def test_merge_splits_between_opposite_anchors():
    # costs: nothing left 30 + 2, two left 4 + 2, all left 4 + 20
    between = [(200, 210, -4), (210, 230, 30), (230, 240, -20), (240, 250, 2)]
    assert merged([(0, 200, 90), *between, (250, 500, -90)]) == [(0, 230, 120, -4), (230, 500, -110, 2)]


@pytest.mark.parametrize(("left", "right", "at"), [(60, -90, 200), (90, -60, 230)])
def test_merge_ties(left, right, at):
    got = merged([(0, 200, left), (200, 210, -7), (210, 230, 7), (230, 500, right)])
    assert [g[:2] for g in got] == [(0, at), (at, 500)]


def test_merge_without_anchor():
    assert merged([(0, 10, 5), (10, 20, -3)]) in ([(0, 20, 5, -3)], [(0, 10, 5, 0), (10, 20, -3, 0)])
    assert merged([(0, 10, 5)]) == [(0, 10, 5, 0)]


def test_merge_leading_and_trailing_blocks():
    assert merged([(0, 30, -20), (30, 300, 90)]) == [(0, 30, -20, 0), (30, 300, 90, 0)]
    assert merged([(0, 300, 90), (300, 330, -20)]) == [(0, 300, 90, 0), (300, 330, -20, 0)]


@given(st.lists(st.tuples(st.integers(1, 200), st.integers(1, 120)), max_size=12), st.booleans())
def test_merge_keeps_markers_and_order(parts, first):
    at, blocks = 0, []
    for n, (size, weight) in enumerate(parts):
        blocks.append((at, at + size, weight if (n % 2 == 0) == first else -weight))
        at += size + 3
    got = merged(blocks)
    assert sum(m + o for _, _, m, o in got) == sum(b[2] for b in blocks)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False)) and all(b < e for b, e, _, _ in got)
    if blocks:
        assert got[0][0] == blocks[0][0] and got[-1][1] == blocks[-1][1]


def test_readers_and_programs(spark, tmp_path):
    reads, asm = sequences(9, 6, 400), sequences(9, 3, 400)
    fasta = tmp_path / "asm.fa"
    fasta.write_text("".join(f">s{i} x\n{s[:150].upper()}\n{s[150:]}\n" for i, s in enumerate(asm)))
    fastq = tmp_path / "reads.fastq"
    fastq.write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    assert [(r.seq_id, r.name, r.seq) for r in read_fasta(spark, str(fasta)).orderBy("seq_id").collect()] == [(i, f"s{i} x", s) for i, s in enumerate(asm)]
    assert [r.seq for r in read_fastq(spark, str(fastq)).orderBy("seq_id").collect()] == reads
    tables = cli.run(spark, ["report", "-K7", "-lz", str(fastq), str(fasta), str(tmp_path / "out")])
    assert (tmp_path / "out" / "qv").is_dir() and tables["qv"].columns == ["Assembly", "No Support", "Total", "Error %", "QV"] and tables["qv"].count() == 1
    assert tables["completeness.stats"].columns == ["Assembly", "Region", "Found", "Total", "% Covered"] and "asm.spectrum-limits.ln" in tables and "asm.spectrum-limits.st" not in tables
    first = cli.run(spark, ["cn", "-K7", "-k", str(fastq), str(fasta), str(tmp_path / "cn")])
    again = cli.run(spark, ["cn", "-s", "-x1.5", "-Y77", str(tmp_path / "cn")])
    assert first["plot"].columns == ["Copies", "kmer_multiplicity", "Count"] and sorted(map(tuple, first["plot"].collect())) == sorted(map(tuple, again["plot"].collect()))
    assert [n for n in again if n.startswith("limits")] == ["limits.st"] and again["limits.st"].first().y_limit == 77
    for bad in (
        ["cn", str(fasta), str(tmp_path)], ["cn", "-K0", str(fastq), str(fasta), "o"], ["joint", str(fasta), str(fasta), "o"], ["cn", "-q", "a", "b", "c"], ["gc", "-z", "a", "o"], ["cn", "-xabc", "a", "b", "c"],
        ["cn", "-x-1", "a", "b", "c"], ["cn", "-T", "a", "b", "c"], ["cn", "-pdx", "a", "b", "c"], ["cn", "-k", str(tmp_path / "cn")], ["cn", str(tmp_path / "nothing")], ["plot"], [], ["cn"],
    ):
        with pytest.raises(ValueError):
            cli.run(spark, bad)


def test_trio_report(spark, tmp_path):
    """A trio whose child has a stretch of each parent: every file with its columns, blocks with a total row, completeness of the parents' markers."""
    rng = random.Random(12)
    mat, pat, extra = ("".join(rng.choice("acgt") for _ in range(3000)) for _ in range(3))
    asm = mat[:1200] + pat[1300:2600]

    def reads(*seqs):
        return frame(spark, [s[i : i + 300] for s in seqs for i in range(0, len(s) - 299, 30)])

    h = report.trio_hapmers(reads(mat, extra), reads(pat, extra), reads(mat, pat), 11)
    found = report.full(reads(mat, pat), [("asm", frame(spark, [asm, extra[:200]]))], 11, (h["mat"], h["pat"]))
    out = report.files(found, {"styles": ["ln", "st"], "zero": True}, ("ma", "pa"))
    blocks = out["asm.phased_block"].collect()
    assert out["asm.phased_block"].columns == ["Scaffold", "Start", "End", "Phase", "Purity", "Switches", "Markers"]
    assert [r.Phase for r in blocks] == ["ma", "pa", ""] and blocks[-1].Scaffold == "total" and blocks[-1].Markers == sum(r.Markers for r in blocks[:-1])
    assert blocks[0].Start == "0" and blocks[1].End == str(len(asm)) and all(r.Purity == "0.000" for r in blocks)
    region = {(r.Assembly, r.Region): r for r in out["completeness.stats"].collect()}
    assert set(region) == {("asm", "all"), ("asm", "ma"), ("asm", "pa")}
    distinct = len(plain_counts([asm, extra[:200]], 11))
    assert region["asm", "ma"].Total == distinct and 0 < region["asm", "ma"].Found < distinct and re.fullmatch(r"[0-9]+\.[0-9]{2}", region["asm", "ma"]["% Covered"])
    blob = sorted(map(tuple, out["asm.block_blob"].collect()))
    assert out["asm.block_blob"].columns == ["Block", "Range", "ma", "pa", "Size"] and [b[:2] for b in blob] == [("ma", 0), ("pa", 1)]
    kinds = Counter(r.kind for r in out["asm.sizes"].collect())
    assert kinds == {"scaffold": 2, "contig": 2, "block": 2}
    qv = {r.Assembly: r for r in out["qv"].collect()}
    assert int(qv["asm"]["No Support"]) > 0 and re.fullmatch(r"[0-9]+\.[0-9]{4}", qv["asm"]["Error %"]) and re.fullmatch(r"[0-9]+\.[0-9]", qv["asm"].QV)
    assert out["hapmers.blob"].columns == ["Assembly", "Contig", "ma", "pa", "Size"] and out["asm.phased_block.stats"].first()["# Blocks"] == 2
    perfect = report.files(report.full(frame(spark, [asm] * 3), [("x", frame(spark, [asm]))], 11), {"styles": ["fl"], "zero": False})
    assert perfect["qv"].first().QV == "inf" and perfect["x.qv"].columns[0] == "Scaffold"


def test_stacked_peak_and_limits(spark):
    def peak(curves, high=9):
        rows = [(c, o, m, n, n) for c, o, bins in curves for m, n in bins.items()]
        return histogram.stacked_peak(spark.createDataFrame(rows, "copies string, class_ord int, multiplicity long, n_unique long, n_instances long"), high).first()

    assert tuple(peak([("1", 1, {1: 9, 2: 4, 3: 5, 4: 1}), ("2", 2, {1: 1, 2: 3, 3: 4, 4: 8, 5: 8})])) == (4, 9)
    assert tuple(peak([("1", 1, {1: 9, 2: 4, 3: 1})])) == (9, 0)
    plot = spark.createDataFrame([("read-only", 4, 99), ("1", 2, 50), ("1", 6, 20), ("2", 8, 20)], "class string, multiplicity long, n long")
    assert tuple(histogram.fallback_limits(plot).first()) == (15.0, pytest.approx(22.0))
    zero = spark.createDataFrame([(30,), (10,)], "n_instances long")
    assert histogram.fallback_limits(plot, zero).first().y_limit == pytest.approx(44.0)


def test_saved_profiles_and_histograms(spark, tmp_path):
    prof = spark.createDataFrame([(s, p, s + p) for s in range(3) for p in range(9, -1, -1)], "seq_id long, pos int, read_cnt long")
    profile.save_profiles(prof, str(tmp_path / "p"), 7)
    back = profile.load_profiles(spark, str(tmp_path / "p"), 7)
    assert [tuple(r) for r in profile.fetch_profile(back, 2, 3).collect()] == [(p, 2 + p) for p in range(10)]
    for bad in (-1, 3):
        with pytest.raises(ValueError):
            profile.fetch_profile(back, bad, 3)
    with pytest.raises(ValueError):
        profile.load_profiles(spark, str(tmp_path / "p"), 8)
    h = hist(spark, {1: 4, 2: 9})
    histogram.save(h, str(tmp_path / "h"), 7)
    assert sorted(map(tuple, histogram.load(spark, str(tmp_path / "h"), 7).collect())) == sorted(map(tuple, h.collect()))
    with pytest.raises(ValueError):
        histogram.load(spark, str(tmp_path / "h"), 5)
    t = KmerTable.count(frame(spark, sequences(3, 2, 200)), 6)
    ordered = sorted(as_dict(t).items())
    assert [r.cnt for r in t.from_ordinal(5, 3).collect()] == [n for _, n in ordered[5:8]]
    assert t.max_bucket(2).first().n == max(Counter(m[:2] for m, _ in ordered).values())


def test_split_files(spark, tmp_path):
    """Many small splits of several files: numbers follow the files; headers hold '>', lines end in CR LF, quality lines begin with '@'."""
    rng = random.Random(3)
    seqs = ["".join(rng.choices("acgt", k=rng.randrange(1, 200))) for _ in range(120)]
    for f in range(3):
        end = "\r\n" if f == 1 else "\n"
        part = list(enumerate(seqs))[40 * f : 40 * f + 40]
        with open(tmp_path / f"{f}.fa", "w", newline="") as fa, open(tmp_path / f"{f}.fastq", "w", newline="") as fq:
            fa.write("".join(f">s{i} a>b >c{end}{s[:70].upper()}{end}{s[70:]}{end}" for i, s in part))
            fq.write("".join(f"@s{i}{end}{s}{end}+{end}{'@' * len(s)}{end}" for i, s in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        fa, fq = read_fasta(spark, [str(tmp_path / f"{f}.fa") for f in (2, 0, 1)]), read_fastq(spark, [str(tmp_path / f"{f}.fastq") for f in range(3)])
        assert [(r.seq_id, r.name, r.seq) for r in fa.orderBy("seq_id").collect()] == [(i, f"s{i} a>b >c", s) for i, s in enumerate(seqs)]
        assert [(r.seq_id, r.name, r.seq) for r in fq.orderBy("seq_id").collect()] == [(i, f"s{i}", s) for i, s in enumerate(seqs)]
        (tmp_path / "bad.fa").write_text("acgt\n>x\nacgt\n")
        (tmp_path / "bad.fastq").write_text("@x\nacgt\n+\nIIII\nx\nacgt\n+\nIIII\n")
        for read, name in ((read_fasta, "bad.fa"), (read_fastq, "bad.fastq")):
            with pytest.raises(Exception, match="header"):
                read(spark, str(tmp_path / name)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_runs_over_block_edges(spark, monkeypatch):
    """Runs that end before, at and after the edge of a block, and one over several blocks."""
    monkeypatch.setattr(profile, "BLOCK", 10)
    rng = random.Random(8)
    pos = sorted(rng.sample(range(400), 150)) + list(range(500, 560))
    rows = [(s, p, p % 3) for s in (1, 2) for p in pos if s == 1 or p % 7]
    df = spark.createDataFrame(rows, "seq_id long, pos int, w int")
    for gap in (1, 3, 12):
        want = {}
        for s in (1, 2):
            run, n = [], 0
            for _, p, w in [r for r in rows if r[0] == s] + [(s, 10**6, 0)]:
                if run and p - run[-1][0] > gap:
                    want[s, n] = (run[0][0], run[-1][0], sum(x for _, x in run))
                    run, n = [], n + 1
                run.append((p, w))
        got = profile.runs(df, gap, sums={"w": F.col("w")}).collect()
        assert {(r.seq_id, r.island): (r.beg, r.last, r.w) for r in got} == want


def test_sites_are_located_in_contigs(spark):
    contigs = spark.createDataFrame([(1, 0, 5), (1, 1, 50), (2, 0, 0)], "seq_id long, contig long, beg long")
    places = spark.createDataFrame([(1, 5, "a"), (1, 49, "b"), (1, 50, "c"), (1, 99, "d"), (2, 7, "e")], "seq_id long, beg long, x string")
    assert {r.x: r.contig for r in profile.located(places, contigs).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 0}


def test_streaming(spark, tmp_path):
    seqs = sequences(11, 5, 120)
    frame(spark, seqs).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, seq string").parquet(str(tmp_path / "in"))
    q = streaming_counts(stream, 5).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    try:
        q.processAllAvailable()
        assert as_dict(KmerTable(spark.table("kmers"), 5)) == dict(plain_counts(seqs, 5))
    finally:
        q.stop()


def dense_rise(counts, strict):
    top = max(counts)
    for m in range(2, top + 1):
        if counts.get(m, 0) > counts.get(m - 1, 0) or not strict and counts.get(m, 0) == counts.get(m - 1, 0):
            return m
    return top


def test_thresholds_over_gaps(spark):
    """The scan of present bins against one over all bins, zeros among the rows, and a greatest count that no array could reach."""
    rng = random.Random(4)
    cases = [{m: rng.choice([0, 1, 2, 5, 9]) for m in rng.sample(range(1, rng.choice([4, 8, 30])), rng.randint(1, 3))} for _ in range(40)] + [{1: 5}, {7: 3}, {2: 1}, {1: 9, 2: 0, 3: 0}, {1: 9, 2: 3, 4: 2}, {1: 9, 5: 0}]
    for i, counts in enumerate(cases):
        for strict in (False, True):
            assert histogram.first_rise(hist(spark, counts), strict).first().thresh == dense_rise(counts, strict), (i, counts, strict)
    far = {1: 90, 2: 40, 3: 30, 3_000_000_000: 7}
    assert histogram.first_rise(hist(spark, far), True).first().thresh == 3_000_000_000 and tuple(histogram.solid(hist(spark, far)).first()) == (5, 7)
    assert histogram.first_rise(hist(spark, {}), True).count() == 0


def test_contigs_over_pieces(spark):
    """Contigs within a piece, over an edge, over several pieces and of one position; runs that hap_blob joins."""
    k = 5
    seqs = [*sequences(21, 3, 2 * CHUNK + 33), "acgta" * (CHUNK // 2), "a" * (CHUNK - 1) + "-" + "c" * (CHUNK + 9), "acgt", "acgta", "", None, "-" * 40]
    want = {}
    for s, seq in enumerate(seqs):
        ends = [m.span() for m in re.finditer("[acgt]+", seq or "") if m.end() - m.start() >= k]
        want |= {(s, n): (a, b - a - k + 1, b - a) for n, (a, b) in enumerate(ends)}
    df = frame(spark, seqs)
    got = profile.contigs(df, k)
    assert {(r.seq_id, r.contig): (r.beg, r.n_pos, r.size) for r in got.collect()} == want
    assert "pos" not in got._jdf.queryExecution().toString().replace("n_pos", "")
    prof = windows(df, k, runs=True).select("seq_id", "run", F.lit(1).alias("mat_cnt"), F.lit(0).alias("pat_cnt"))
    assert {(r.seq_id, r.contig): (r.mat, r.pat, r.size) for r in profile.hap_blob(prof, ("seq_id",)).collect()} == {key: (n, 0, n) for key, (_, n, _) in want.items()}


def test_many_loose_blocks():
    rng = random.Random(6)

    def plain(between, late):
        costs = [(sum(abs(b.mrk) for b in between[:cut:2]) + sum(abs(b.mrk) for b in between[cut + 1 :: 2]), -cut if late else cut) for cut in range(0, len(between) + 1, 2)]
        return abs(min(costs)[1])

    for n in (0, 2, 4, 10, 40):
        for _ in range(40):
            between = [Block(i, i + 1, rng.choice([1, 2, 3]) * (-1) ** i) for i in range(n)]
            for late in (False, True):
                assert _best_split(between, late) == plain(between, late)
    began = time.time()
    loose = [Block(10 * i, 10 * i + 9, (i % 7 + 1) * (-1) ** i) for i in range(1_000_000)]
    assert merge_blocks([Block(-500, 0, 90), *loose, Block(10**8, 10**8 + 500, -90)], 100, 1000)
    assert time.time() - began < 30


@pytest.mark.parametrize("k", [5, 13, 40])
def test_minimizers(spark, k):
    """A word and its complement have one minimizer; heavy buckets, several labels and rows without one."""
    rng = random.Random(k)
    words = ["".join(rng.choices("acgt", k=k)) for _ in range(50)]
    for w in words:
        pair = [minimizer.window_minimizers(codes(x.encode())[0], k, minimizer.minimizer_length(k)).tolist() for x in (w, w[::-1].translate(COMPLEMENT))]
        assert pair[0] == pair[1]
    seqs = [*sequences(5, 4, 3000), *["acacacacacac" * 40] * 6, "a" * 9000, None]
    labelled = frame(spark, seqs)
    got = {r.kmer: (r.even, r.big) for r in joint_counts(labelled, k, {"even": "seq_id % 2 = 0 and seq_id < 100", "big": "seq_id >= 6"}).withColumn("kmer", unpack(F.col("kmer"), k)).collect()}
    even, big = plain_counts([s for s in seqs[::2] if s], k), plain_counts([s for s in seqs[6:] if s], k)
    assert got == {w: (even[w], big[w]) for w in {*even, *big}}
