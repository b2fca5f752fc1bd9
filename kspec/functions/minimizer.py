"""Counting by minimizers: neighbouring windows with the same minimizer travel as one stretch of bases.

A window's minimizer is the least of the hashes of its m-mers, each the same in both directions, so a k-mer and its reverse complement have one minimizer, and all windows of a k-mer meet where their minimizer
goes. About (k - m + 2) / 2 windows in a row share theirs; shuffled as bases of two bits they take a few bits a window, and become k-mers and counts only after the shuffle, which needs no second one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from kspec.functions import places as by_place
from kspec.functions.kmer import CHUNK, GROUP, MAX_PACKED, SLICE, by_slices, canonical_keys, chunked, directed_keys, key_array, key_type, part_count
from kspec.sources.shared import kept_at

if TYPE_CHECKING:
    import pyarrow as pa

#: Buckets of minimizers for each partition of the shuffle. A bucket is sorted and counted by itself.
BUCKETS = 32
#: A bucket that has more than this share of a group's windows is counted before the shuffle too.
HEAVY = 1 / 64


def minimizer_length(k: int) -> int:
    """Long enough for many minimizers, short enough for many windows to share one."""
    return min(k, max(k // 3, 7), 12)


def window_minimizers(code: np.ndarray, k: int, m: int) -> np.ndarray:
    """The minimizer of the window at each place."""
    return by_slices(code, k, lambda part, _: (_window_minimizers(part, k, m),))[0]


def _window_minimizers(code: np.ndarray, k: int, m: int) -> np.ndarray:
    key = np.minimum(*directed_keys(code, m)).astype(np.uint64)
    key = (key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # no value twice, in no order of the bases
    key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    width, reach = k - m + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    return key if reach == width else np.minimum(key[: len(key) - (width - reach)], key[width - reach :])


def stretches(code: np.ndarray, broken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of one minimizer in a row begin, how many they are, and the minimizer."""
    at = np.flatnonzero(broken[k:] == broken[:-k])
    if not len(at):
        return at, at, at.astype(np.uint64)
    least = window_minimizers(code, k, minimizer_length(k))[at]
    first = np.concatenate(([0], np.flatnonzero((np.diff(at) != 1) | (least[1:] != least[:-1])) + 1))
    return at[first], np.diff(np.append(first, len(at))), least[first]


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n places each, one after another."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of the bytes up to each end."""
    import pyarrow as pa

    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def reduced(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Each key once, in order, with the sums of its rows of counts."""
    if not len(counts):
        return keys, counts
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = tuple(x[order] for x in keys)
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return tuple(x[first] for x in keys), np.add.reduceat(counts[order], first, axis=0)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, dtype=np.int64)


def tallied(keys: tuple[np.ndarray, ...], mask: np.ndarray, labels: int, k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Each key once, in order, with how often it comes with each bit of the masks. Where a key leaves room for the mask both are sorted as one number, which is several times faster than by way of an order."""
    bits = np.arange(labels)
    if len(keys) > 1 or 2 * k + labels > 63:
        return reduced(keys, mask[:, None] >> bits & 1)
    both = np.sort(keys[0] << labels | mask)
    first = _starts(both)
    times, both = np.diff(np.append(first, len(both))), both[first]
    new = _starts(both >> labels)
    counts = (both[:, None] >> bits & 1) * times[:, None]
    return (both[new] >> labels,), np.add.reduceat(counts, new, axis=0) if len(new) else counts


def packed(code: np.ndarray, start: np.ndarray, n_bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of stretches, four a byte, each stretch from a byte of its own; and the bytes of each."""
    n_bytes = -(-n_bases // 4)
    at = np.minimum(ranges(start, 4 * n_bytes), len(code) - 1)
    return (code[at].reshape(-1, 4) @ np.array([64, 16, 4, 1])).astype(np.uint8), n_bytes


def unpacked(data: np.ndarray, n_bases: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The canonical keys of the windows of packed stretches, one stretch after another."""
    code = (data[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3).reshape(-1)
    n_bytes = -(-n_bases // 4)
    at = ranges(4 * (np.cumsum(n_bytes) - n_bytes), n_bases - k + 1)
    return tuple(x[at] for x in canonical_keys(code, k))


def flat(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of bytes, one row after another, and where each row's begin, with the end."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype), ((offsets - offsets[0]) // np.dtype(dtype).itemsize).astype(np.int64)


def _bucket(least: np.ndarray, buckets: int) -> np.ndarray:
    return ((least >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _spread(k: int, buckets: int):
    """Pieces of sequences with a mask each -> a row for each bucket: its stretches (masks as 32-bit numbers, n_bases as 16-bit numbers, bases), or, a row for each mask, keys and their counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        names = ["bucket", "masks", "n_bases", "bases", "counted"]
        for batch in batches:
            of_piece, parts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for rows, begin, code, broken in by_place.joined(parts):
                start, n, least = stretches(code, broken, k)
                if not len(start):
                    continue
                bucket, mask = _bucket(least, buckets), of_piece[rows[np.searchsorted(begin, start, side="right") - 1]]
                order = np.lexsort((mask, bucket))
                start, n, bucket, mask = start[order], n[order], bucket[order], mask[order]
                first = _starts(bucket)
                sizes = np.diff(np.append(first, len(bucket)))
                heavy = np.add.reduceat(n, first) > max(HEAVY * n.sum(), 256)
                light = ~np.repeat(heavy, sizes)
                if light.any():
                    data, n_bytes = packed(code, start[light], n[light] + k - 1)
                    ends = np.cumsum(sizes[~heavy])
                    arrays = [binary_column(mask[light].astype(np.int32), 4 * ends), binary_column((n[light] + k - 1).astype(np.uint16), 2 * ends), binary_column(data, np.cumsum(n_bytes)[ends - 1])]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[first[~heavy]]), *arrays, pa.nulls(len(ends), pa.binary())], names=names)
                if heavy.any():
                    every = canonical_keys(code, k)
                    for i in np.flatnonzero(heavy).tolist():
                        own = slice(first[i], first[i] + sizes[i])
                        at = ranges(start[own], n[own])
                        masks = np.repeat(mask[own], n[own])
                        for m in np.unique(masks):
                            of = at[masks == m]
                            keys, counts = reduced(tuple(x[of] for x in every), np.ones((len(of), 1), dtype=np.int64))
                            counted = np.concatenate([*keys, counts[:, 0]]).tobytes()
                            arrays = [pa.array([int(bucket[first[i]])], pa.int32()), pa.array([np.int32(m).tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([counted], pa.binary())]
                            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return emit


def _rows_upto(before: np.ndarray, row: int, end: int, room: int) -> int:
    """The row up to which rows from `row` on fit into room, one at least; before: windows before each row."""
    return int(min(max(np.searchsorted(before, before[row] + room, side="right") - 1, row + 1), end))


def _counted(k: int, labels: list[str]):
    """Rows of _spread in the order of their buckets -> each k-mer of a bucket with a count for each label, a bit of the masks each.

    Buckets go out as soon as they are complete, so what is held is GROUP windows and one bucket's different k-mers; within a bucket sums are put together when they have doubled, so each window is sorted a few times
    only."""
    words, bits = len(canonical_keys(np.zeros(k, dtype=np.int64), k)), np.arange(len(labels))

    def weights(mask: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (mask[:, None] >> bits & 1) * times[:, None]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held: list[tuple[tuple[np.ndarray, ...], np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def merge() -> None:
            nonlocal held
            if len(held) > 1:
                keys = tuple(np.concatenate([x[0][i] for x in held]) for i in range(words))
                held = [reduced(keys, np.concatenate([x[1] for x in held]))]

        def settle() -> None:
            """What waits becomes keys and counts."""
            nonlocal waiting, total
            if waiting:
                n_bases = np.concatenate([x[1] for x in waiting])
                keys = unpacked(np.concatenate([x[2] for x in waiting]), n_bases, k)
                held.append(tallied(keys, np.repeat(np.concatenate([x[0] for x in waiting]), n_bases - k + 1), len(labels), k))
            waiting, total = [], 0
            if sum(len(x[1]) for x in held[1:]) >= max(GROUP, len(held[0][1]) if held else 0):
                merge()

        def out() -> Iterator[pa.RecordBatch]:
            settle()
            merge()
            for keys, counts in held:
                yield pa.RecordBatch.from_arrays([key_array(keys), *[pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(labels))]], names=["kmer", *labels])
            held.clear()

        bucket = None
        for batch in batches:
            of, is_counted = batch.column(0).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            masks, at = flat(batch.column(1), np.int32)
            n_bases, at_n = flat(batch.column(2), np.uint16)
            data, at_data = flat(batch.column(3), np.uint8)
            n_bases = n_bases.astype(np.int64)
            before = np.concatenate(([0], np.cumsum(n_bases - k + 1)))[at_n]
            first = _starts(np.stack([of, is_counted], axis=1).astype(np.int64) @ np.array([2, 1]))
            for row, end in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
                if of[row] != bucket and total + sum(len(x[1]) for x in held) >= GROUP:
                    yield from out()
                bucket = of[row]
                while row < end:
                    if is_counted[row]:
                        numbers = np.frombuffer(batch.column(4)[row].as_py(), dtype=np.int64).reshape(words + 1, -1)
                        held.append((tuple(numbers[:words]), weights(np.full(numbers.shape[1], masks[at[row]]), numbers[words])))
                        settle()
                        row += 1
                        continue
                    upto = _rows_upto(before, row, end, GROUP - total)
                    waiting.append((masks[at[row] : at[upto]], n_bases[at_n[row] : at_n[upto]], data[at_data[row] : at_data[upto]]))
                    total += int(before[upto] - before[row])
                    row = upto
                    if total >= GROUP:
                        settle()
        yield from out()

    return emit


def counted(sequences: DataFrame, k: int, labels: dict[str, str]) -> DataFrame:
    """kmer and a count for each label of the k-mers, up to MAX_DOUBLE bases, of the rows that any label's condition holds for. Labels are 31 at most.

    Short k-mers with few labels are counted by place. For others, one shuffle by bucket; within a partition buckets are sorted and become k-mers one after another. A bucket that is frequent within a task is counted there, so a repeated stretch is sent once a task."""
    if by_place.fits(k, len(labels)):
        return by_place.counted(sequences, k, labels)
    mask = sum((F.coalesce(F.expr(on).cast("int"), F.lit(0)) * (1 << i) for i, on in enumerate(labels.values())), F.lit(0))
    marked = sequences.select("seq", mask.cast("int").alias("mask")).where("mask > 0")
    parts = part_count(sequences)
    spread = chunked(marked, k, ("mask",), CHUNK).mapInArrow(_spread(k, BUCKETS * parts), "bucket int, masks binary, n_bases binary, bases binary, counted binary")
    dealt = spread.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_counted(k, list(labels)), StructType([StructField("kmer", key_type(k)), *[StructField(n, LongType()) for n in labels]]))


def key_minimizers(keys: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """The minimizer of each key."""
    m, n = minimizer_length(k), len(keys[0])
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, step := max(1, SLICE // k)):
        own = [x[at : at + step] for x in keys]
        code = np.stack([own[-1] >> 2 * behind & 3 if behind < MAX_PACKED else own[0] >> 2 * (behind - MAX_PACKED) & 3 for behind in range(k - 1, -1, -1)], axis=1)
        out[at : at + step] = _window_minimizers(code.reshape(-1), k, m)[::k]
    return out


def found(table: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where each key is in a table of keys in order, each once; -1 if it isn't there."""
    n = len(table[0])
    if not n or len(table) == 1:
        at = np.minimum(np.searchsorted(table[0], keys[0]), max(n - 1, 0))
        return np.where(table[0][at] == keys[0], at, -1) if n else np.full(len(keys[0]), -1)
    both = [np.concatenate(x) for x in zip(table, keys, strict=True)]
    order = np.lexsort(both[::-1])  # equal keys stay in their order: the table's first
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for x in both:
        new[1:] |= np.diff(x[order]) != 0
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.where(first < n, first, -1)
    return out[n:]


def _tabled(k: int, buckets: int):
    """kmer and counts -> a row for each bucket of a batch: its keys and their counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0)
            keys = (key.to_numpy(),) if k <= MAX_PACKED else tuple(key.field(i).to_numpy() for i in range(2))
            bucket = _bucket(key_minimizers(keys, k), buckets)
            order = np.argsort(bucket, kind="stable")
            numbers = np.stack([*keys, *[batch.column(i).to_numpy() for i in range(1, batch.num_columns)]], axis=1)[order]
            first = _starts(bucket[order])
            ends = np.append(first[1:], len(order)) * numbers.shape[1] * 8
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), binary_column(numbers.reshape(-1).view(np.uint8), ends)], names=["bucket", "counted"])

    return emit


def _placed(k: int, buckets: int, keep: int):
    """Pieces of sequences (kept columns, start, part) -> a row for each bucket: its stretches, with what is kept and the first position of each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            starts, parts = batch.column(keep).to_numpy(), batch.column(keep + 1).to_pylist()
            for rows, begin, code, broken in by_place.joined(parts):
                start, n, least = stretches(code, broken, k)
                if not len(start):
                    continue
                bucket = _bucket(least, buckets)
                order = np.argsort(bucket, kind="stable")
                start, n, bucket = start[order], n[order], bucket[order]
                piece = np.searchsorted(begin, start, side="right") - 1
                pos = (starts[rows[piece]] + start - begin[piece]).astype(np.int32)
                first = _starts(bucket)
                ends = np.append(first[1:], len(bucket))
                data, n_bytes = packed(code, start, n + k - 1)
                lists = pa.array(np.append(first, len(bucket)).astype(np.int32))
                own = [pa.ListArray.from_arrays(lists, batch.column(i).take(pa.array(rows[piece]))) for i in range(keep)]
                binary = [binary_column(pos, 4 * ends), binary_column((n + k - 1).astype(np.uint16), 2 * ends), binary_column(data, np.cumsum(n_bytes)[ends - 1])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *binary, *own], names=["bucket", "places", "n_bases", "bases", *[f"own{i}" for i in range(keep)]])

    return emit


def _met(k: int, keep: int, columns: int, shape: Callable):
    """Rows of _tabled and of _placed in the order of their buckets, tables first -> what shape makes of the counts at the stretches' windows.

    Stretches are looked up GROUP windows at a time, and tables of buckets that are complete are let go, so what is held doesn't grow with how often a bucket occurs."""
    words = len(canonical_keys(np.zeros(k, dtype=np.int64), k))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        tables: list[np.ndarray] = []
        waiting: list[tuple] = []
        total, in_order = 0, False

        def table() -> np.ndarray:
            """The rows of all tables, by key."""
            nonlocal tables, in_order
            if not in_order:
                rows = np.concatenate([np.zeros((0, words + columns), dtype=np.int64), *tables])
                tables, in_order = [rows[np.lexsort([rows[:, i] for i in range(words - 1, -1, -1)])]], True
            return tables[0]

        def looked_up() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, total
            if waiting:
                rows = table()
                n_bases = np.concatenate([x[1] for x in waiting])
                at = found(tuple(np.ascontiguousarray(rows[:, i]) for i in range(words)), unpacked(np.concatenate([x[2] for x in waiting]), n_bases, k))
                counts = np.zeros((len(at), columns), dtype=np.int64)
                counts[at >= 0] = rows[at[at >= 0], words:]
                own = [pa.concat_arrays([x[3][i] for x in waiting]) for i in range(keep)]
                yield from shape(own, np.concatenate([x[0] for x in waiting]).astype(np.int64), n_bases - k + 1, counts)
            waiting, total = [], 0

        bucket = None
        for batch in batches:
            of, is_table = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 0
            counted, at_c = flat(batch.column(2), np.int64)
            places, at = flat(batch.column(3), np.int32)
            n_bases, _ = flat(batch.column(4), np.uint16)
            data, at_data = flat(batch.column(5), np.uint8)
            n_bases = n_bases.astype(np.int64)
            own = [batch.column(6 + i).flatten() for i in range(keep)]
            before = np.concatenate(([0], np.cumsum(n_bases - k + 1)))[at]
            first = _starts(of.astype(np.int64) * 2 + is_table)
            for row, end in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
                if of[row] != bucket and total + sum(len(x) for x in tables) >= GROUP:
                    yield from looked_up()
                    tables, in_order = [], False
                bucket = of[row]
                if is_table[row]:
                    in_order = False
                    tables.append(counted[at_c[row] : at_c[end]].reshape(-1, words + columns))
                    continue
                while row < end:
                    upto = _rows_upto(before, row, end, GROUP - total)
                    waiting.append((places[at[row] : at[upto]], n_bases[at[row] : at[upto]], data[at_data[row] : at_data[upto]], [x[at[row] : at[upto]] for x in own]))
                    total += int(before[upto] - before[row])
                    row = upto
                    if total >= GROUP:
                        yield from looked_up()
        yield from looked_up()

    return emit


def meet(sequences: DataFrame, counts: DataFrame, k: int, keep: tuple[str, ...], shape: Callable, schema: StructType) -> DataFrame:
    """What shape makes of the counts (kmer and columns of longs, no kmer twice) at the windows of column seq, 0 where a kmer has none.

    shape(kept columns of each stretch, first position of each, windows of each, counts of each window) gives record batches of the schema. Windows travel to their counts as stretches of bases, not as rows, and both
    are sorted by bucket within a partition. Those of short k-mers don't travel: counts are kept in files first, and looked up by place."""
    if by_place.fits(k, len(counts.columns) - 1):
        return by_place.meet(sequences, kept_at(counts, "counts"), counts.columns[1:], k, keep, shape, schema)
    parts = part_count(sequences)
    buckets, columns = BUCKETS * parts, len(counts.columns) - 1
    stored = chunked(sequences, k, keep, CHUNK)
    own = [StructField(f"own{i}", ArrayType(sequences.schema[c].dataType)) for i, c in enumerate(keep)]
    binary = [StructField(c, BinaryType()) for c in ("places", "n_bases", "bases")]
    placed = stored.mapInArrow(_placed(k, buckets, len(keep)), StructType([StructField("bucket", IntegerType()), *binary, *own]))
    tabled = counts.mapInArrow(_tabled(k, buckets), "bucket int, counted binary")
    empty = [F.array().cast(f.dataType).alias(f.name) for f in own]
    none = F.lit(b"")
    rows = tabled.select("bucket", F.lit(0).alias("kind"), "counted", *[none.alias(f.name) for f in binary], *empty)
    rows = rows.unionByName(placed.select("bucket", F.lit(1).alias("kind"), none.alias("counted"), *[f.name for f in binary], *[f.name for f in own]))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_met(k, len(keep), columns, shape), schema)
