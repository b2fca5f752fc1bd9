"""Runs of words: stretches that repeat with a period.

The first phase of Baier's suffix sorter groups suffixes by their longest Lyndon prefix. Done for an order of the words and for its reverse it yields both Lyndon arrays directly, and each run has, in one of
them, a Lyndon word as long as its smallest period. Such roots are extended both ways to their runs. A word lies in no run unless it lies in a window that occurs again in the same stretch of such windows, so
all other words are left aside first; that loses nothing (see `repeating`)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

if TYPE_CHECKING:
    import pyarrow as pa

Run = tuple[int, int, int]  # start, length, period
#: A run has at least so many words, and two periods.
LEAST = 12
#: A run of period q repeats a stretch of max(LEAST - q, q) words or more, so of half of LEAST at least.
WINDOW = LEAST // 2
#: Words that are worked on together, but for texts with more.
WORDS = 1 << 19


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; the end is smaller than any symbol.

    Suffixes with a common prefix are a group, and groups are in order. The greatest group left is final: its prefix is the longest Lyndon word at each of its members. The nearest place before a member
    that isn't final yet has a prefix that this word follows, once or several times in a row: its prefix grows by these words, and it goes to a group right above its old one, the more words the higher."""
    n = len(symbols)
    rank = {x: g for g, x in enumerate(sorted(set(symbols)))}
    group, count = [rank[x] for x in symbols], len(rank)
    members: list[list[int]] = [[] for _ in range(count)]
    for i, g in enumerate(group):
        members[g].append(i)
    size, length = [len(m) for m in members], [1] * count  # size: members that are still in it, as lists keep those that went
    below, above = list(range(-1, count - 1)), list(range(1, count + 1))
    left, out = list(range(-1, n - 1)), [0] * n  # left: a place before, with none between them that isn't final

    def insert(under: int, one: list[int], own: int) -> int:
        new, over = len(size), above[under]
        for i in one:
            group[i] = new
        members.append(one)
        size.append(len(one))
        length.append(own)
        below.append(under)
        above.append(over)
        above[under] = below[over] = new
        return new

    g = count - 1
    while g >= 0:
        if size[g]:
            own = length[g]
            here = members[g] if size[g] == len(members[g]) else [i for i in members[g] if group[i] == g]
            for i in here:
                out[i] = own
                group[i] = -1
            times: dict[int, int] = {}
            for i in here:
                at = left[i]
                if at >= 0 and group[at] < 0:
                    end = left[at]
                    while end >= 0 and group[end] < 0:
                        end = left[end]
                    while at != end:
                        left[at], at = end, left[at]
                    left[i] = at
                if at >= 0:
                    times[at] = times.get(at, 0) + 1
            if len(times) == 1:
                (at, c), = times.items()
                old = group[at]
                if size[old] == 1:
                    length[old] += c * own
                else:
                    size[old] -= 1
                    insert(old, [at], length[old] + c * own)
            elif times:
                moves = defaultdict(list)
                for at, c in times.items():
                    moves[group[at], c].append(at)
                last = under = -1
                for (old, c), those in sorted(moves.items()):
                    if old != last:
                        last = under = old
                        if size[old] == len(those):
                            length[old] += c * own
                            continue
                    size[old] -= len(those)
                    under = insert(under, those, length[old] + c * own)
        members[g] = []
        g = below[g]
    return out


def _forward(a: np.ndarray, i: int, j: int) -> int:
    """Length of the longest common extension of the places i < j to the right."""
    done, step, n = 0, 32, len(a)
    while (m := min(step, n - j - done)) > 0:
        differ = a[i + done : i + done + m] != a[j + done : j + done + m]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + m, step * 2
    return done


def runs_of(a: np.ndarray, windows: np.ndarray) -> list[Run]:
    """All runs of a sequence, by start and period. windows: equal for places where equal windows of WINDOW symbols begin (others may be equal too).

    A root of length l at i belongs to a run only if the places around i repeat at a distance of l for l symbols and LEAST - l, so for a window that begins at i - WINDOW to i; those that pass are extended.
    A stretch that repeats at a distance is extended once, however many roots it has."""
    symbols, n = a.tolist(), len(a)
    roots = set()
    for line in (symbols, [-x for x in symbols]):
        length = np.array(lyndon_array(line), dtype=np.int64)
        passed = np.zeros(n, dtype=bool)
        for back in range(WINDOW + 1):
            at = np.arange(back, n)
            at = at[at - back + length[at] < len(windows)]
            passed[at] |= windows[at - back] == windows[at - back + length[at]]
        roots.update(zip(length[passed].tolist(), np.flatnonzero(passed).tolist(), strict=True))
    backwards, found, of, until = a[::-1], [], 0, -1
    for period, i in sorted(roots):
        if period == of and i <= until:
            continue
        right = _forward(a, i, i + period)
        before = _forward(backwards, n - i - period, n - i) if i else 0
        of, until = period, i + right
        if before + right >= max(period, LEAST - period):
            found.append((i - before, before + right + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """begin and end, in ids, of the stretches that can hold runs, and the keys of their windows. ids: the words of texts one after another, of lengths words each.

    Every word of a run lies in a window that occurs twice in the run. So a run lies within one stretch of words in windows that occur twice in the text; and again within that stretch, for which the
    windows are counted anew, until no stretch gets shorter. Windows are told apart by a hash: equal hashes of different windows only leave more words to look at."""
    stretches = np.stack([np.cumsum(lengths) - lengths, np.cumsum(lengths)], axis=1)
    if len(ids) < LEAST:
        return
    keys = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(keys)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(29)
    fixed: list[np.ndarray] = []
    while True:
        stretches = stretches[stretches[:, 1] - stretches[:, 0] >= LEAST]
        if not len(stretches):
            break
        n = stretches[:, 1] - stretches[:, 0] - WINDOW + 1  # windows of each
        label = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(stretches[:, 0], n)
        mixed = keys[at] + label.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(mixed)
        equal = np.diff(mixed[order]) == 0
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        at, label = at[again], label[again]
        if not len(at):
            break
        new = np.flatnonzero((np.diff(at) > WINDOW) | (np.diff(label) != 0))  # windows that touch are one stretch
        first, last = np.concatenate(([0], new + 1)), np.concatenate((new, [len(at) - 1]))
        shorter = np.stack([at[first], at[last] + WINDOW], axis=1)
        same = (shorter == stretches[label[first]]).all(axis=1)
        fixed.append(shorter[same])
        stretches = shorter[~same]
    for begin, end in np.concatenate(fixed).tolist() if fixed else ():
        yield begin, end, keys[begin : end - WINDOW + 1]


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tiling: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and text without what the runs repeat: a word that some run holds beyond its first period goes, the others are joined by single spaces.

    A run is a longest stretch of words with a smallest period, of LEAST words and two periods at least. Words are what ASCII white space separates. A null text is empty; an empty text has no words and no runs; an id
    may be null or repeated, each row is a text of its own and ids are handed through untouched; an empty table gives no rows. A text is worked on whole, by one task, in memory in proportion to its words.
    tiling: the words that take the text's place, as numbers of its words, for an id and a number of words; None leaves the text as it is."""

    def results(texts: list[list[bytes]], ids: list[np.ndarray]) -> tuple[list[list[Run]], list[bytes]]:
        whole, lengths = np.concatenate(ids), np.array([len(x) for x in ids])
        starts = np.cumsum(lengths) - lengths
        runs: dict[int, list[Run]] = defaultdict(list)
        for begin, end, windows in repeating(whole, lengths):
            of = int(np.searchsorted(starts, begin, side="right")) - 1
            shift = begin - int(starts[of])
            runs[of] += [(s + shift, n, p) for s, n, p in runs_of(whole[begin:end], windows)]
        kept = []
        for i, words in enumerate(texts):
            if i in runs:
                runs[i].sort(key=lambda r: (r[0], r[2]))
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s, n, p in runs[i]:
                    gone[s + p] += 1
                    gone[s + n] -= 1
                words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            kept.append(b" ".join(words))
        return [runs[i] if i in runs else [] for i in range(len(texts))], kept

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def done(rows: pa.Array, texts: list[list[bytes]], ids: list[np.ndarray]) -> pa.RecordBatch:
            runs, kept = results(texts, ids)
            flat = np.array([r for one in runs for r in one], dtype=np.int64).reshape(-1, 3)
            offsets = np.concatenate(([0], np.cumsum([len(one) for one in runs]))).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(offsets), parts).cast(kind)
            return pa.RecordBatch.from_arrays([rows, pa.array([len(x) for x in ids], pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "text"])

        for batch in batches:
            first, texts, ids, total = 0, [], [], 0
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            for i in range(len(batch)):
                words = batch.column(1)[i].as_py().split()
                if tiling is not None and (order := tiling(batch.column(0)[i].as_py(), len(words))) is not None:
                    words = [words[j] for j in order.tolist()]
                texts.append(words)
                ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                total += len(words)
                if total >= WORDS or i + 1 == len(batch):
                    yield done(batch.column(0).slice(first, len(texts)), texts, ids)
                    first, texts, ids, total = i + 1, [], [], 0
                    number.clear()

    kind = docs.select(F.col(f"`{doc_id}`")).dtypes[0][1]
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").cast("binary").alias("text"))
    return slim.mapInArrow(each, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")


def digest(found: DataFrame) -> DataFrame:
    """find_runs as numbers and checksums: doc_id, n_runs, the longest run (of equal ones the first, then the one of the smallest period) and how often it repeats, and hashes of all runs and of the text that stays."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    each = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    start, period = -F.col("b.start"), -F.col("b.period")
    return each.select("doc_id", "n_runs", start.alias("start"), F.col("b.length").alias("length"), period.alias("period"), F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
