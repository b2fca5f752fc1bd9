"""Each operator against a brute-force version, on real documents and on awkward ones."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kspec.llm import bpe, hilbert, linededup, mixing, outliers, pii, records, simhash, toxicity, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_tokens int, key string"
LONG = "Abcdef ghij. " * 9000
ODD = [
    (1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, " \n\n \t", "en", None, 5), (1003, LONG, None, "src0", len(LONG)), (1004, "one", "en", "x", 3),
    (1005, "two words", "en", "x", 9), (1005, "two words", "en", "x", 9), (None, "no id  at all\n", "de", "x", 1), (1006, "a\n\n\nb \x1c c　d  e\r\nf <|endoftext|> g", "en", "x", 1),
    (1007, "the long line number one of this text\nshort\nthe long line number one of this text", "en", "x", 1), (1008, "The long line number  two of this text\nthe long line numbr one of this text", "en", "x", 1),
    (1009, "日本語のテキスト 😀 ok don't we'll", "ja", "x", 1), (1010, "x" * 5000, "en", "x", 5000),
    (1011, "mail a@b.c_d@e.fg, 4111 1111 1111 1111 and 4111 1111 1111 1112; +1 (555) 123-4567. 10.0.0.255 1.2.3.4.5.6.7.8 999.1.1.1 IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789 call 555-123-4567", "en", "x", 1),
    (1012, "1 " * 3000 + "+" * 500 + "a" * 4000 + "@" + "1.2." * 700, "en", "x", 1), (-5, "two words", "en", "x", 9),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(*r, "s", 1, "k") for r in ODD], SCHEMA)
    real = real.withColumn("shard", F.lit("s")).withColumn("n_tokens", F.lit(1)).withColumn("key", F.lit("k"))
    return real.unionByName(odd)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixture(docs, rows, empty):
    narrow, plan, a = mixing.mixture(docs, max_repeats=2.0, target_entropy=None)
    out = mixing.realise(narrow, plan).collect()
    tokens, n_docs = Counter(), Counter()
    for r in rows:
        tokens[r.source] += max(1, len(words_of(r.text)))
        n_docs[r.source] += 1
    total = sum(tokens.values())
    w = {s: (n / total) ** a for s, n in tokens.items()}
    ratios = {s: w[s] / tokens[s] for s in w}
    assert max(ratios.values()) / min(ratios.values()) == pytest.approx(2.0, rel=1e-6)
    # every row once at least, none over twice and one last epoch, each source within a document of its budget
    got = Counter((r.doc_id, r.source) for r in out)
    have = Counter((r.doc_id, r.source) for r in rows)
    assert set(got) == set(have) and all(have[k] <= got[k] <= 3 * have[k] for k in have)
    budget = {r.source: r.budget for r in plan.collect()}
    spent, biggest = Counter(), Counter()
    for r in out:
        spent[r.source] += r.n_tokens
        biggest[r.source] = max(biggest[r.source], r.n_tokens)
    for s, b in budget.items():
        assert b == pytest.approx(w[s] / min(ratios.values()), abs=1)
        assert b <= spent[s] <= b + biggest[s]
    # an epoch is a permutation: no row twice in it, but for repeated rows
    assert max(Counter((r.doc_id, r.source, r.mix_epoch) for r in out).values()) == 2
    assert {r.mix_block for r in out} and mixing.mix(empty).count() == 0
    same = mixing.mix(docs, max_repeats=2.0)
    assert same.columns == docs.columns and same.count() == len(out)


def test_bisect_exponent():
    shares = np.array([0.6, 0.3, 0.1])

    def entropy(a):
        w = shares**a / (shares**a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.bisect_exponent(entropy, 1.0)
    assert entropy(a) == pytest.approx(1.0) and mixing.bisect_exponent(entropy, 2.0) == 0.0 and mixing.bisect_exponent(entropy, 0.0) == 1.0


def test_crc32c():
    def plain(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert records.crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 511, 512, 513, 3000):
        data = rng.bytes(n)
        assert records.crc32c(data) == plain(data)


def test_records(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    manifest = records.write_records(docs, path)
    got = records.read_records(manifest).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, np.uint64(xxhash.xxh64_intdigest((r.text or "").encode(), 42)).view(np.int64), r.text or ""))
    start = 0
    assert len(got) == len(ordered)
    for g, r in zip(got, ordered, strict=True):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), crc)
        start += len(ids)
    first = manifest.orderBy("shard").first()
    back = list(records.read_at(first.path, [first.n_docs - 1, 0]))
    ids = [*t.encode(ordered[0].text or "", add_special_tokens=False).ids, 2]
    assert back[1][0] == ordered[0].doc_id and back[1][1].tolist() == ids
    assert records.read_records(records.write_records(empty, path)).count() == 0


def test_broken_record(tmp_path):
    import io

    data = records.frame(b"abc") + records.frame(b"defg")
    assert list(records.frames(io.BytesIO(data))) == [b"abc", b"defg"]
    for at in (2, 9, 13, len(data) - 1):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(ValueError):
            list(records.frames(io.BytesIO(broken)))
    with pytest.raises(ValueError):
        list(records.frames(io.BytesIO(data[:-1])))


def test_hilbert_curve(spark):
    bits = 3
    for dims in (2, 3):
        grid = spark.range(1)
        for i in range(dims):
            grid = grid.crossJoin(spark.range(1 << bits).select(F.col("id").alias(f"x{i}"))) if i else spark.range(1 << bits).select(F.col("id").alias("x0"))
        got = grid.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()
        assert [r.h for r in got] == list(range((1 << bits) ** dims))
        for a, b in zip(got, got[1:], strict=False):
            assert sum(abs(a[f"x{i}"] - b[f"x{i}"]) for i in range(dims)) == 1


def test_hilbert_shards(docs, rows, empty):
    placed = hilbert.hilbert_shards(docs, shards=7)
    got = placed.collect()
    assert Counter((g.doc_id, g["size"], g.text_crc32) for g in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    by = defaultdict(list)
    for g in got:
        by[g.shard].append(g)
    counts = [len(v) for v in by.values()]
    assert sorted(by) == list(range(7)) and max(counts) - min(counts) <= 1
    last = -1
    for s in range(7):
        run = sorted(by[s], key=lambda g: g.slot)
        assert [g.slot for g in run] == list(range(len(run)))
        for g in run:
            assert g.curve >= last
            last = g.curve
    assert hilbert.hilbert_shards(empty).count() == 0
    ranges = hilbert.shard_ranges(docs.where("doc_id >= 0 and doc_id != 1005"), placed, ["n_chars"])
    assert ranges.count() == 7


def test_written_shards(spark, tmp_path):
    """Each row once, in its shard and in slot order; null ids, repeated ids and equal rows, and a column that is called shard."""
    rows = [(None if i % 5 == 0 else i // 2, f"text {i % 40}", "en", "a", i, f"s{i}") for i in range(200)] + [(7, "same", None, None, k, "x") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    placed = hilbert.hilbert_shards(docs, shards=6)
    name = hilbert.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and back.columns == [*docs.columns, "shard_"]
    assert Counter(tuple(r)[:6] for r in back.collect()) == Counter(rows)
    sizes = Counter(r.shard for r in placed.collect())
    assert Counter(r.shard_ for r in back.collect()) == sizes
    ranges = {r.shard: r for r in hilbert.shard_ranges(docs, placed, ["n_chars"]).collect()}
    for s, n in sizes.items():
        held = [r.n_chars for r in back.collect() if r.shard_ == s]
        assert (ranges[s].n_rows, ranges[s].min_n_chars, ranges[s].max_n_chars) == (n, min(held), max(held))


def test_bpe(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(g) for g in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()) == want
    assert bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_transducer_on_small_vocabularies():
    """Random merges, where merges compete more than in a trained vocabulary."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(4)}
        while len(ranks) < 20:
            a, b = (list(ranks)[i] for i in rng.integers(0, len(ranks), 2))
            ranks.setdefault(a + b, len(ranks))
        t = bpe.Transducer(ranks, max_states=5)
        for _ in range(60):
            word = bytes(rng.integers(0, 4, rng.integers(1, 30)).tolist())
            parts = [bytes([x]) for x in word]
            while True:
                best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            want = [ranks[word]] if word in ranks else [ranks[p] for p in parts]
            if all(t.made(x) for x in want):
                assert t.encode_word(word) == want
                assert len(t._state) <= t.max_states + 2


def test_stream_decoder():
    token = {i: bytes([i]) for i in range(256)}
    for data in ("aé日😀z".encode(), b"\xff\xe6\x97", b"\xf0\x9f\x98", b"\xed\xa0\x80a", b"\xc0\xaf"):
        for cut in range(len(data) + 1):
            d = bpe.StreamDecoder(token)
            first = d.feed(data[:cut])
            assert first + d.feed(data[cut:]) + d.finish() == data.decode(errors="replace")


def brute_statistics(text):
    w = words_of(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    inside = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(docs, rows, empty):
    got = outliers.quality(docs).collect()
    want = Counter((r.doc_id, *brute_statistics(r.text)) for r in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words) and not (g.kept and g.base_failed)
    assert outliers.quality(empty).count() == 0


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_distinct long, base_failed boolean"


def statistics(rng, i, lang, source, junk=False):
    n = int(rng.integers(200, 400))
    if junk:
        return (i, lang, source, 300, 1800, 700, 0, 20, 0, 120, False)
    return (i, lang, source, n, int(n * rng.normal(6, 0.2)), int(rng.integers(0, 3)), 0, 20, int(rng.integers(0, 5)), int(n**0.85 * rng.normal(1, 0.05)), False)


def vectors(rows):
    x = np.array([[math.log(r[4] / r[3]), math.sqrt(r[5] / r[4]), math.sqrt(r[8] / r[3]), 0.0, math.log(r[9] / r[3] ** 0.85)] for r in rows])
    return np.round(x * outliers.SCALE)


def best_determinant(x, floors, rng, starts=60):
    """FAST-MCD as published: exact cores of three quarters, from random small subsets, to convergence; the least log determinant."""
    h, best = math.ceil(0.75 * len(x)), math.inf
    for _ in range(starts):
        part = x[rng.choice(len(x), min(len(x), 8), replace=False)]
        last = math.inf
        while True:
            mu, cov = part.mean(axis=0), np.cov(part.T, bias=True) + np.diag(floors**2)
            z = np.linalg.solve(np.linalg.cholesky(cov), (x - mu).T)
            part = x[np.argsort((z * z).sum(axis=0), kind="stable")[:h]]
            now = np.linalg.slogdet(np.cov(part.T, bias=True) + np.diag(floors**2))[1]
            if now >= last - 1e-9:
                break
            last = now
        best = min(best, last)
    return best


def test_outliers_against_published_method(spark):
    """Planted outliers go, the rest stays; determinants are those that random starts with exact cores reach, but for the width of a bin."""
    rng = np.random.default_rng(5)
    rows = [statistics(rng, i, "en", "a" if i % 3 else "b") for i in range(600)] + [statistics(rng, i, "en", "a", True) for i in range(600, 720)]
    df = spark.createDataFrame(rows, STATS)
    got = {r.doc_id: r for r in outliers.mcd_outliers(df).collect()}
    assert all(got[i].outlier for i in range(600, 720)) and not any(got[i].outlier for i in range(600))
    fit = spark.createDataFrame([(r[2], *map(int, v)) for r, v in zip(rows, vectors(rows), strict=True)], "grp string, v0 long, v1 long, v2 long, v3 long, v4 long")
    found = {r.grp: r.log_det for r in outliers.mcd_estimates(fit).collect()}
    floors = np.array([f for _, _, f in outliers.FEATURES]) * outliers.SCALE
    for source in "ab":
        want = best_determinant(vectors([r for r in rows if r[2] == source]), floors, rng)
        assert found[source] <= want + 0.1


def test_small_groups_are_judged_by_their_language(spark):
    """The same junk text is an outlier in groups of any size, however small; a group's own kind counts the more the larger it is."""
    rng = np.random.default_rng(6)
    rows = [statistics(rng, i, "en", "a") for i in range(300)]
    at = 300
    for source, n in (("x", 0), ("y", 1), ("z", 10), ("w", 49), ("v", 60)):
        rows += [statistics(rng, at + k, "en", source) for k in range(n)] + [statistics(rng, at + n, "en", source, True)]
        at += n + 1
    rows += [(at, None, None, 0, 0, 0, 0, 0, 0, 0, True), (at + 1, None, "a", 50, 250, 0, 0, 5, 0, 40, False), (at + 1, None, "a", 50, 250, 0, 0, 5, 0, 40, False)]
    got = outliers.mcd_outliers(spark.createDataFrame(rows, STATS)).collect()
    assert len(got) == len(rows)
    junk = {r[0] for r in rows if r[5] == 700}
    assert {g.doc_id for g in got if g.outlier and not g.base_failed} == junk


def test_webp_round_trips():
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).shape == (1, 1)
    assert len(webp.NEAR) == 120
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (17, 9)):
        for pixels in (rng.integers(0, 2**32, (h, w), dtype=np.uint32), rng.integers(0, 6, (h, w)).astype(np.uint32) * 0x01020305):
            blocks = (-(-h // 4), -(-w // 4))
            modes, elements = rng.integers(0, 14, blocks), rng.integers(0, 2**32, blocks, dtype=np.uint32)
            for transforms in ((), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 0, 1)):
                for options in ({}, {"cache_bits": 3}, {"group_bits": 2}, {"cache_bits": 5, "group_bits": 2}):
                    assert (webp.decode(webp.encode(pixels, transforms=transforms, modes=modes, elements=elements, **options)) == pixels).all()
    left = rng.integers(0, 2**32, (5, 70), dtype=np.uint32)
    assert (webp.decode(webp.encode(left, transforms=(0,), modes=np.ones((2, 18), dtype=int))) == left).all()
    flat = rng.integers(0, 2**32, 48, dtype=np.uint32)
    for i in range(10, 20):
        flat[i] = flat[i - 1]
    for i in range(30, 40):
        flat[i] = flat[i - 8]
    assert (webp.decode(webp.encode(flat.reshape(6, 8), copies=[(10, 10, 1), (30, 10, 8)], cache_bits=2)) == flat.reshape(6, 8)).all()


def test_store_chooses_by_size():
    """Samples that climb or repeat the row above but for a step go through a predictor; text doesn't. Whatever is chosen, the payload comes back."""
    rng = np.random.default_rng(9)
    climb = (np.arange(64 * 300) * 3 + rng.integers(0, 2, 64 * 300)).astype(np.uint8)
    rows = (rng.integers(0, 256, 64)[None, :] + np.arange(700)[:, None] * 5 + rng.integers(0, 2, (700, 64))).astype(np.uint8).reshape(-1)
    noise = rng.integers(0, 256, 64 * 20, dtype=np.uint8)
    prose = ("The quick brown fox jumps over the lazy dog. " * 3 + "Pack my box with five dozen jugs.").encode()
    text = np.frombuffer(prose + bytes(-len(prose) % 64), dtype=np.uint8)
    for samples, predicted in ((climb, True), (rows, True), (noise, False), (text, False), (np.zeros(64, dtype=np.uint8), False), (np.tile(climb, 10), True)):
        stored = webp.store(samples.tobytes())
        assert webp.load(stored) == samples.tobytes()
        assert (len(stored) < 0.7 * len(webp._plain(samples[: 64 * webp.MAX_ROWS]))) == predicted


def test_media(docs, rows, empty, spark):
    got = webp.media(docs, keep_media=True).collect()
    want = Counter()
    for r in rows:
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[(r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) for g in got) == want
    assert all(g.media_sha256 == hashlib.sha256(g.media).hexdigest() and g.media_bytes == len(g.media) for g in got)
    assert webp.media(empty).count() == 0
    files = spark.createDataFrame([(1, got[0].media[: len(got[0].media)]), (2, b"junk"), (3, None)], "k long, m binary")
    out = {r.key: r for r in webp.pixel_arrays(files, "m", "k").collect()}
    assert out[1].width == 64 and out[2].pixels is None and out[3].pixels is None


def normal(line):
    return re.sub(r"[\x20\x09-\x0D\xA0]+", " ", line).strip(" ").lower()


def near(a, b, edits_from=16):
    if a == b:
        return True
    if max(len(a), len(b)) < edits_from or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :]


def text_key(text):
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).view(np.int64))


def brute_removed(rows, edits_from=16):
    """(place, place of the one that is kept) of each line occurrence that goes; a place is (id, hash of the text, line number)."""
    first, at = {}, []
    for r in rows:
        for k, line in enumerate((r.text or "").split("\n")):
            if normal(line):
                key = (2**63 - 1 if r.doc_id is None else r.doc_id, text_key(r.text), k)
                at.append((key, normal(line)))
                first[normal(line)] = min(first.get(normal(line), key), key)
    by_size = defaultdict(list)
    for line in first:
        by_size[len(line)].append(line)
    keep = {x: min(first[y] for n in (len(x) - 1, len(x), len(x) + 1) for y in by_size[n] if near(x, y, edits_from)) for x in first}
    return Counter((k, keep[x]) for k, x in at if keep[x] < k)


def removed(docs, **options):
    big = 2**63 - 1
    got = linededup.removed_lines(docs, **options).collect()
    return Counter(((big if g.doc_id is None else g.doc_id, g.line_no), (big if g.kept_doc_id is None else g.kept_doc_id, g.kept_line_no)) for g in got)


def without_hashes(places):
    out = Counter()
    for (a, b), n in places.items():
        out[(a[0], a[2]), (b[0], b[2])] += n
    return out


def brute_deduped(rows):
    """Each row's text without the lines that go."""
    gone = {a for a, _ in brute_removed(rows)}
    out = Counter()
    for r in rows:
        d = 2**63 - 1 if r.doc_id is None else r.doc_id
        lines = (r.text or "").split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if (d, text_key(r.text), k) not in gone)
        out[r.doc_id, None if r.text is None else left] += 1
    return out


def test_line_dedup(docs, rows, empty, spark):
    assert removed(docs) == without_hashes(brute_removed(rows))
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_deduped(rows)
    texts = {r.doc_id: r for r in got}
    assert texts[1000].text is None and texts[1007].text == "the long line number one of this text\nshort" and texts[1008].text == "The long line number  two of this text"
    assert texts[1008].n_chars == len(texts[1008].text)
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_edits(spark):
    rng = np.random.default_rng(2)
    base = "some quite long line of text here"
    lines = [base, base[:-1], base[1:], base + "x", "y" + base, base.replace("q", "k"), base.replace("q", "kk"), base.replace("ong", "og"), base.replace("o", "u"), "aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaa", "b" * 15, "b" * 14, "c" * 15, "c" * 14 + "d"]
    for _ in range(120):
        s = list(base)
        for _ in range(rng.integers(1, 3)):
            k = int(rng.integers(0, len(s)))
            s[k : k + int(rng.integers(0, 2))] = "abé"[int(rng.integers(0, 3))] if rng.integers(0, 3) else ""
        lines.append("".join(s))
    order = rng.permutation(len(lines))
    df = spark.createDataFrame([(int(i), lines[i]) for i in order], "doc_id long, text string")
    assert removed(df) == without_hashes(brute_removed(df.collect()))
    short = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "ab", "b", "cde", "cdf", "xcde", "zzzzzzzz", "zzzzzzz", "q", *lines[:40]])], "doc_id long, text string")
    assert removed(short, edits_from=0) == without_hashes(brute_removed(short.collect(), 0))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    text = text or ""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data(docs, rows, empty):
    got = pii.personal_data_digest(docs).collect()
    want = Counter()
    for r in rows:
        s = brute_spans(r.text)
        n = Counter(k for k, _, _ in s)
        want[(r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    assert Counter(tuple(g)[:6] for g in got) == want
    by = {g.doc_id: g for g in got}
    text = next(r.text for r in rows if r.doc_id == 1011)
    added = [s.split(":") for s in by[1011].spans.split(",") if s.split(":")[0] in pii.ADDED_KINDS]
    assert [(k, text[int(a) : int(b)]) for k, a, b in added] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("tel", "555-123-4567")]
    assert pii.personal_data_digest(empty).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[1011].startswith("mail <email><email>, <card> and 4111 1111 1111 1112; +1 (555) 123-4567. <ip>")


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def test_simhash(docs, rows, empty):
    fps = [brute_fingerprint(r.text) for r in rows]
    want = Counter((r.doc_id, f, c) for r, f, c in zip(rows, fps, brute_components(fps, [r.doc_id for r in rows]), strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((g.doc_id, g.fp & (2**64 - 1), g.component_id) for g in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _, c in want.elements() if d == c)


def test_links_and_components(spark, monkeypatch):
    """Clustered fingerprints, chains longer than the radius, dense groups over several tiles."""
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(4)
    fps = {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    for centre in list(fps)[:4]:
        for _ in range(120):
            fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False)))
    chain = 12345
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.add(chain)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    star = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = [star.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
    want = brute_components(fps, list(range(len(fps))))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_toxicity(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(real, labels)
    out = toxicity.scored(real, model)
    judged = out.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in judged)
    hits = sum(1 for r in judged if r.predicted and r.toxic)
    assert hits >= 0.75 * sum(r.toxic for r in judged) and hits >= 0.9 * sum(r.predicted for r in judged)
    # labels of the held-out fold make no difference
    blind = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(real, blind) == model
    odd = toxicity.scored(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.fit(empty, spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"))
    assert toxicity.scored(docs, none).where("predicted = 1").count() == 0


def test_non_negative_risk_steps_back():
    """Texts that only noise sets apart: the estimate of the clean risk isn't driven far below zero."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(400, 30, replace=False)) for _ in range(120)]
    positive = np.arange(120) < 40
    w, b = toxicity.nnpu_train(rows, positive, 400, 0.3, steps=300)
    g = np.array([w[r].sum() for r in rows]) + b
    risk = np.logaddexp(0, g)[~positive].mean() - 0.3 * np.logaddexp(0, g)[positive].mean()
    assert risk > -0.2
