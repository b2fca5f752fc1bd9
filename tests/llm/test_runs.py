"""Runs of words against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kspec.llm import queries
from kspec.llm.runs import LEAST, WINDOW, find_runs, lyndon_array, repeating, runs_of


def brute_lyndon(s):
    """The next smaller suffix ends the longest Lyndon word; the end is smaller than anything."""
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(LEAST, 2 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def all_runs(words):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    out = []
    for begin, end, windows in repeating(ids, np.array([len(ids)])):
        out += [(s + begin, n, p) for s, n, p in runs_of(ids[begin:end], windows)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def tilings(rng, n):
    """Texts of repeated pieces in random text, some within others."""
    words = []
    while len(words) < n:
        piece = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        words += piece * rng.randint(1, 6) + piece[: rng.randint(0, len(piece))]
        words += [f"w{rng.randint(0, 200)}" for _ in range(rng.randint(0, 8))]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 1000])
def test_lyndon_arrays(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, 5, 17, 60, 200]:
        for _ in range(20):
            s = [rng.randint(-letters, letters) for _ in range(n)]
            assert lyndon_array(s) == brute_lyndon(s)
    s = [ord(c) for c in fibonacci(300)]
    assert lyndon_array(s) == brute_lyndon(s)


def test_runs_of_words():
    rng = random.Random(3)
    cases = [fibonacci(n) for n in (11, 12, 13, 40, 377)] + [["a"] * n for n in (0, 11, 12, 100)] + [tilings(rng, n) for n in (20, 50, 200, 400) for _ in range(30)]
    cases += [[rng.choice("ab") for _ in range(n)] for n in (12, 30, 100, 300) for _ in range(20)]
    cases += [list("abcdefghijkl" * 2), list("abcdefghijkl" * 2)[:-1], list("abcdef" * 2), list("abcdefabcde"), list("xabababababababy")]
    for words in cases:
        assert all_runs(words) == brute_runs(words), words


def test_window_is_the_least_repeat():
    assert min(max(LEAST - q, q) for q in range(1, 100)) == WINDOW


def contract(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32((str(doc_id) if doc_id is not None else "").encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {j for s, m, p in runs for j in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()
    return (doc_id, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(b" ".join(w for j, w in enumerate(words) if j not in gone)))


BIG = 9007199254740993  # a double can't hold it
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "again " * 40), (None, None), (BIG, "one two three " * 9 + "end"), (BIG, "one two three " * 9 + "end"), (BIG + 2, "a b " * 13), (4, "x\x1cy " * 12), (5, "word " * 20_000)]


def test_query(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000").limit(120)
    odd = spark.createDataFrame([(i, t, "runs", 1, "text") for i, t in ODD if t is None or len(t) < 50_000], "doc_id long, text string, runs string, n_words int, b string")
    docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_runs(spark, str(tmp_path)).collect()
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    want = [contract(r.doc_id, r.text) for r in rows]
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs for r in got) > 20


def test_texts_and_long_ones(spark):
    found = find_runs(spark.createDataFrame(ODD, "key long, body string"), "key", "body").collect()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == len(ODD) and [tuple(x) for x in by_id[5].runs] == [(0, 20_000, 1)] and by_id[5].text == "word"
    assert by_id[BIG].text == "one two three end" and by_id[BIG + 2].text == "a b" and by_id[1].text == "" and by_id[1].runs == []
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    half = " ".join(fibonacci(30_000))
    [row] = find_runs(spark.createDataFrame([(1, half)], "doc_id int, text string")).collect()
    assert len(row.runs) > 1000
