"""Counts of short k-mers by place: a k-mer of up to SHORT bases is its own place among 4 to the power of k, so it is counted and looked up without sorting or meeting others.

A k-mer and its reverse complement share a place. Where k is odd their middle bases are different, so the one whose middle base is a or c gives the place, and there are half as many.

Both are bounded by the places, whatever the input is. Counting needs a byte a place and label in each task, and sends each different k-mer once a task; looking up needs two bytes a place and column in each
worker, and no position is shuffled at all."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kspec.functions.kmer import CHUNK, GROUP, TASK_BYTES, by_slices, chunked, codes, directed_keys, grouped, input_bytes, part_count, run_starts, sliced

if TYPE_CHECKING:
    import pyarrow as pa

#: Longest k-mer that has a place of its own, and most places for all labels that a task counts, a byte each.
SHORT, PLACES = 13, 1 << 27
#: Places of a bucket: all k-mers make 1,024 buckets at most, of at least so many places.
BUCKETS, LEAST = 1024, 4096
#: Greatest sum that is kept in a byte, and the two bytes that say that a count is among the great ones.
BYTE, GREAT = 255, 0xFFFF
#: Windows that are looked up together, so that what is made of them is small beside the table.
LOOKED_UP = 1 << 18
#: Sums beyond a byte that wait to be put together.
WAITING = 1 << 18


def fits(k: int, labels: int) -> bool:
    """Whether k-mers with so many labels are counted by place."""
    return k <= SHORT and labels * n_places(k) <= PLACES


def n_places(k: int) -> int:
    return 4**k >> k % 2


def bucket_size(k: int) -> int:
    return max(n_places(k) // BUCKETS, LEAST)


def _place(forward: np.ndarray, backward: np.ndarray, k: int) -> np.ndarray:
    """The place of keys and those of their reverse complements."""
    if k % 2 == 0:
        return np.minimum(forward, backward)
    own = np.where(forward >> k & 1, backward, forward)  # of the middle base's two bits the upper one is bit k: it is left out
    return own >> k + 1 << k | own & (1 << k) - 1


def _reversed(keys: np.ndarray, k: int) -> np.ndarray:
    """The keys of the reverse complements."""
    out = np.zeros_like(keys)
    for i in range(k):
        out = out << 2 | 3 - (keys >> 2 * i & 3)
    return out


def place_of(keys: np.ndarray, k: int) -> np.ndarray:
    return _place(keys, _reversed(keys, k), k)


def key_of(places: np.ndarray, k: int) -> np.ndarray:
    """The canonical key of each place."""
    if k % 2 == 0:
        return places
    own = places >> k << k + 1 | places & (1 << k) - 1
    return np.minimum(own, _reversed(own, k))


def places_at(code: np.ndarray, k: int) -> np.ndarray:
    """The places of the windows that begin at each base, in 32 bits."""
    return by_slices(code, k, lambda part, n: (_place(*directed_keys(part, n), n),), np.int32)[0]


def joined(parts: list[bytes], size: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of sequences, in groups: the numbers of a group's pieces, where each begins, and codes() of all of them with breaks between."""
    for rows in grouped(parts, size):
        own = [parts[i] for i in rows]
        begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in own])[:-1]))
        yield rows, begin, *codes(b"-".join(own))


class Sums:
    """Sums by place and label: a byte each, and those that are greater beside them."""

    def __init__(self, labels: int, k: int) -> None:
        self.small = np.zeros((labels, n_places(k)), dtype=np.uint8)
        self.great = [[] for _ in range(labels)]

    def add(self, label: int, places: np.ndarray, n: np.ndarray) -> None:
        """Adds to places, each given once."""
        total = self.small[label].take(places) + n.astype(np.int64)
        if len(over := np.flatnonzero(total > BYTE)):
            held = self.great[label]
            held.append((places[over].astype(np.int64), total[over]))
            total[over] = 0
            if len(held) > 1 and sum(len(x) for x, _ in held[1:]) > max(WAITING, len(held[0][0])):
                self.great[label] = [self.greats(label)]
        self.small[label][places] = total

    def greats(self, label: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order, and what is beyond their bytes."""
        held = self.great[label]
        if not held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        places, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        sums = np.zeros(len(places), dtype=np.int64)
        np.add.at(sums, at, np.concatenate([n for _, n in held]))
        return places, sums


def _summed(k: int, labels: int):
    """Pieces of sequences with a mask each -> a row for each bucket: which of its places occur (their numbers in 16 bits, or a bit for each place if that is shorter), a byte a label and place, and greater sums (place, label,
    sum)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        _last.clear()
        sums = Sums(labels, k)
        for batch in sliced(batches):
            of_piece, parts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for rows, begin, code, broken in joined(parts):
                valid = broken[k:] == broken[:-k]
                if not valid.any():
                    continue
                at, mask = places_at(code, k), np.repeat(of_piece[rows], np.diff(np.append(begin, len(code))))[: len(valid)]
                for m in np.unique(of_piece[rows]).tolist():
                    own = np.sort(at[valid & (mask == m)].astype(np.uint32))
                    if len(own):
                        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                        n = np.diff(np.append(first, len(own)))
                        for label in range(labels):
                            if m >> label & 1:
                                sums.add(label, own[first], n)
        size = bucket_size(k)
        greats = [sums.greats(i) for i in range(labels)]
        great = np.concatenate([np.stack([x, np.full(len(x), i), n], axis=1) for i, (x, n) in enumerate(greats)])
        great = great[np.argsort(great[:, 0], kind="stable")]
        edges = np.searchsorted(great[:, 0], np.arange(0, n_places(k) + size, size)).tolist()
        held: list[tuple] = []
        for bucket in range(-(-n_places(k) // size)):
            small = sums.small[:, bucket * size : (bucket + 1) * size]
            occurs = small.any(axis=0)
            at = np.flatnonzero(occurs)
            beyond = great[edges[bucket] : edges[bucket + 1]]
            if len(at) or len(beyond):
                places = at.astype(np.uint16) if 16 * len(at) < len(occurs) else np.packbits(occurs)
                held.append((bucket, places.tobytes(), small[:, at].tobytes(), beyond.tobytes()))
            if len(held) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types(), strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types(), strict=True)], names=names)

    names = ["bucket", "places", "small", "great"]

    def types() -> list:
        import pyarrow as pa

        return [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    return emit


def _totals(k: int, labels: list[str]):
    """Rows of _summed in the order of their buckets -> each k-mer with its counts. One bucket's sums are held."""
    size = min(bucket_size(k), n_places(k))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        sums = np.zeros((len(labels), size), dtype=np.int64)
        bucket = None

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(sums.any(axis=0))
            batch = pa.RecordBatch.from_arrays([pa.array(key_of(at + bucket * size, k)), *[pa.array(x[at]) for x in sums]], names=["kmer", *labels])
            sums[:] = 0
            return batch

        for batch in batches:
            for of, places, small, great in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != bucket:
                    if bucket is not None:
                        yield out()
                    bucket = of
                counts = np.frombuffer(small, dtype=np.uint8).reshape(len(labels), -1)
                as_numbers = 16 * counts.shape[1] < size
                at = np.frombuffer(places, dtype=np.uint16) if as_numbers else np.flatnonzero(np.unpackbits(np.frombuffer(places, dtype=np.uint8), count=size))
                for own, n in zip(sums, counts, strict=True):
                    own[at] += n
                place, label, n = np.frombuffer(great, dtype=np.int64).reshape(-1, 3).T
                np.add.at(sums, (label, place - bucket * size), n)
        if bucket is not None:
            yield out()

    return emit


def counted(sequences: DataFrame, k: int, labels: dict[str, str]) -> DataFrame:
    """minimizer.counted() of short k-mers. Each task sums by place and sends each k-mer once; k-mers of a bucket are added up by place again."""
    mask = sum((F.coalesce(F.expr(on).cast("int"), F.lit(0)) * (1 << i) for i, on in enumerate(labels.values())), F.lit(0))
    marked = sequences.select("seq", mask.cast("int").alias("mask")).where("mask > 0")
    # a task sends what is different in its share, so fewer tasks send less
    few = min(part_count(sequences), max(4 * sequences.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(sequences) // (4 * TASK_BYTES))))
    spread = chunked(marked, k, ("mask",), CHUNK, few).mapInArrow(_summed(k, len(labels)), "bucket int, places binary, small binary, great binary")
    dealt = spread.repartition(part_count(sequences), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_totals(k, list(labels)), StructType([StructField("kmer", LongType()), *[StructField(n, LongType()) for n in labels]]))


class Table:
    """Counts by place, in two bytes each; greater ones are GREAT there and lie beside them in the order of their places."""

    def __init__(self, k: int, columns: int) -> None:
        self.low = [np.zeros(n_places(k), dtype=np.uint16) for _ in range(columns)]
        self.great = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in range(columns)]

    @staticmethod
    def read(uri: str, k: int, columns: list[str]) -> Table:
        """The table of a folder of Parquet files of kmer and columns."""
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        table, great = Table(k, len(columns)), [[] for _ in columns]
        files = dataset.dataset(path, filesystem=system, format="parquet")
        for batch in files.to_batches(columns=["kmer", *columns], batch_size=1 << 17, batch_readahead=1, fragment_readahead=1, use_threads=False):
            places = place_of(batch.column(0).to_numpy(), k)
            for i, low in enumerate(table.low):
                n = batch.column(1 + i).to_numpy()
                low[places] = np.minimum(n, GREAT)
                at = np.flatnonzero(n >= GREAT)
                great[i].append((places[at], n[at]))
        for i, held in enumerate(great):
            if held:
                places, n = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(places)
                table.great[i] = places[order], n[order]
        return table

    def at(self, places: np.ndarray) -> np.ndarray:
        """A row of counts for each place."""
        out = np.empty((len(places), len(self.low)), dtype=np.int64)
        for i, (low, (of, n)) in enumerate(zip(self.low, self.great, strict=True)):
            own = low.take(places)
            out[:, i] = own
            if len(of) and len(rows := np.flatnonzero(own == GREAT)):
                out[rows, i] = n[np.searchsorted(of, places[rows])]
        return out


#: The table that a worker has read last, with what it was read from. It is let go when the worker counts again.
_last: dict[tuple, Table] = {}


def table_of(uri: str, k: int, columns: list[str]) -> Table:
    key = (uri, k, *columns)
    if key not in _last:
        _last.clear()  # before the next is read, so that one is held at most
        _last[key] = Table.read(uri, k, columns)
    return _last[key]


def _looked_up(uri: str, k: int, columns: list[str], keep: int, shape: Callable):
    """Pieces of sequences (kept columns, start, part) -> what shape makes of the counts at their runs of valid windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in sliced(batches):
            starts, parts = batch.column(keep).to_numpy(), batch.column(keep + 1).to_pylist()
            for rows, begin, code, broken in joined(parts, LOOKED_UP):
                at = np.flatnonzero(broken[k:] == broken[:-k])
                if not len(at):
                    continue
                first = run_starts(at)
                n = np.diff(np.append(first, len(at)))
                piece = np.searchsorted(begin, at[first], side="right") - 1
                own = [batch.column(i).take(pa.array(rows[piece])) for i in range(keep)]
                yield from shape(own, starts[rows[piece]].astype(np.int64) + at[first] - begin[piece], n, table_of(uri, k, columns).at(places_at(code, k)[at]))

    return emit


def meet(sequences: DataFrame, uri: str, columns: list[str], k: int, keep: tuple[str, ...], shape: Callable, schema: StructType) -> DataFrame:
    """minimizer.meet() of short k-mers with the counts kept at uri: pieces of sequences are looked up where they are read."""
    return chunked(sequences, k, keep, CHUNK).mapInArrow(_looked_up(uri, k, columns, len(keep), shape), schema)
