"""BAM files of many small blocks and splits, written byte by byte, against the reads they were made of."""

import random
import struct
import zlib

import pytest

from kspec.sources import alignments
from kspec.sources.alignments import listed, read_bam, read_sam, surveyed
from kspec.sources.sequences import read_fastq

CODES = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
COMPLEMENT = str.maketrans("ACGTN", "TGCAN")
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return struct.pack("<4sIBBH2sHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flags, seq, pad=0):
    stored = seq[::-1].translate(COMPLEMENT) if flags & 16 else seq
    codes = [CODES[c] for c in stored] + [0] * (len(stored) % 2)
    bases = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    cigar = struct.pack("<I", len(seq) << 4) if seq and not flags & 4 else b""
    tags = b"XXZ" + b"\x00BAM\x01" * pad + b"\x00"
    body = struct.pack("<iiBBHHHiiii", -1 if flags & 4 else 0, -1 if flags & 4 else 99, len(name) + 1, 7, 4680, len(cigar) // 4, flags, len(seq), -1, -1, 0) + name.encode() + b"\x00" + cigar + bases + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def bam(records, rng, largest, header=200):
    text = b"@HD\tVN:1.6\n" + b"@CO\t" + bytes(rng.choices(b"abc \t", k=header)) + b"\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + b"chr%d\x00" % i + struct.pack("<i", 1000) for i in range(2)) + b"".join(record(*r) for r in records)
    out = b""
    while data:
        n = rng.randint(1, largest)
        out, data = out + block(data[:n]), data[n:]
    return out + END


def reads(seed, n, longest):
    rng = random.Random(seed)
    flags = [rng.choice([0, 4, 16, 77, 0x100, 0x810]) for _ in range(n)]
    return [(f"read{i}/{seed}", f, "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=rng.randrange(longest))), rng.randrange(3)) for i, f in enumerate(flags)]


def kept(records):
    return [(r[0], r[2].lower().replace("n", "-")) for r in records if not r[1] & 0x900]


def got(df):
    rows = df.orderBy("seq_id").collect()
    assert [r.seq_id for r in rows] == list(range(len(rows)))
    return [(r.name, r.seq) for r in rows]


@pytest.mark.parametrize(("n", "longest", "largest", "split", "header"), [(400, 300, 3000, 7000, 200), (20, 6000, 2000, 1500, 6000), (3, 10, 50, 1 << 20, 10), (0, 1, 50, 100, 10)])
def test_splits(spark, tmp_path, n, longest, largest, split, header):
    records = reads(n, n, longest) if n else []
    path = tmp_path / "x.bam"
    path.write_bytes(bam(records, random.Random(1), largest, header))
    assert got(read_bam(spark, str(path), split_bytes=split)) == kept(records)
    table = surveyed(spark, listed(spark, str(path)), split).collect()
    assert len(table) == -(-path.stat().st_size // split) and sum(r.reads for r in table) == len(kept(records))
    if n == 400:
        assert sum(r.reads > 0 for r in table) > 3
        assert [r[0] for r in got(read_bam(spark, str(path), split_bytes=split, repeated=True))] == [r[0] for r in records]
        fastq = tmp_path / "x.fastq"
        fastq.write_text("".join(f"@{r[0]}\n{r[2]}\n+\n{'I' * len(r[2])}\n" for r in records if not r[1] & 0x900))
        assert got(read_fastq(spark, str(fastq))) == kept(records)


def test_false_beginnings(spark, tmp_path, monkeypatch):
    """Guesses that are wrong are found out by the split before and made good."""
    records = reads(5, 200, 200)
    path = tmp_path / "x.bam"
    path.write_bytes(bam(records, random.Random(2), 1500))
    table = surveyed(spark, listed(spark, str(path)), 4000).orderBy("n").collect()
    real, seen = alignments.Split.start, []
    with open(path, "rb") as f:
        for r in table:
            assert alignments.Split(f, r.begin, r.end, r.size).bytes == r.bytes
            if 0 < r.n and r.start < r.bytes:
                seen.append(real(alignments.Split(f, r.begin, r.end, r.size)) == r.start)
    assert seen and all(seen)
    # a record whose tags hold records: a split that begins among them guesses those
    inner = b"".join(record(f"inner{i}", 4, "ACGT" * 9) for i in range(300))
    outer = record("outer", 4, "ACGTACGT")[4:] + b"YYB" + b"c" + struct.pack("<i", len(inner)) + inner
    data = b"BAM\x01" + struct.pack("<ii", 0, 0) + record("first", 4, "GGGG") + struct.pack("<i", len(outer)) + outer + record("last", 4, "TTTT")
    rng = random.Random(3)
    out = b""
    while data:
        k = rng.randint(200, 900)
        out, data = out + block(data[:k]), data[k:]
    (tmp_path / "y.bam").write_bytes(out + END)
    assert got(read_bam(spark, str(tmp_path / "y.bam"), split_bytes=700)) == [("first", "gggg"), ("outer", "acgtacgt"), ("last", "tttt")]


def test_files_and_faults(spark, tmp_path):
    a, b = reads(7, 20, 100), reads(8, 30, 100)
    for name, records in (("b.bam", b), ("a.bam", a)):
        (tmp_path / name).write_bytes(bam(records, random.Random(4), 500))
    assert got(read_bam(spark, str(tmp_path / "*.bam"), split_bytes=1000)) == kept(a) + kept(b)
    whole = (tmp_path / "a.bam").read_bytes()
    for name, data in (("cut.bam", whole[: len(whole) // 2]), ("text.bam", b"no alignment\n" * 50), ("broken.bam", whole[:200] + bytes([whole[200] ^ 255]) + whole[201:])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="block|BAM|cut off|zlib|incorrect|invalid|decompress|no record"):
            read_bam(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError):
        read_bam(spark, str(tmp_path / "none.bam"))


def test_text_form(spark, tmp_path):
    records = reads(9, 60, 80)
    lines = [f"{n}\t{f}\tchr1\t100\t7\t{len(s) or 1}M\t*\t0\t0\t{(s[::-1].translate(COMPLEMENT) if f & 16 else s) or '*'}\t*" for n, f, s, _ in records]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        assert got(read_sam(spark, str(tmp_path / "x.sam"))) == kept(records)
        assert len(got(read_sam(spark, str(tmp_path / "x.sam"), repeated=True))) == len(records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.sam").write_text("x\t0\n")
    with pytest.raises(Exception, match="no record"):
        read_sam(spark, str(tmp_path / "bad.sam")).collect()
