"""Exact search for the greatest inner products by distances from pivots.

A vector of norm n gets one more component, the root of M * M - n * n for the greatest norm M; then all vectors lie on a sphere, and with 0 as its own further component a query's squared distance from a vector is
|q|^2 + M^2 - 2 q.x, so the nearest vectors are those of the greatest product. Vectors are keyed by their nearest pivot and the distance from it, which cuts each pivot's cell into annuli. By the triangle
inequality, and by the plane between two pivots, an annulus bounds the distance of all its vectors from a query, so a query takes the annuli by their bounds and leaves those that can't reach its k-th best.

Every vector is in an annulus, and an annulus is left only for its bound: results are exact. Only the numbers of pivots and annuli, not those of vectors, are held in one place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

if TYPE_CHECKING:
    import pyarrow as pa

#: Vectors that pivots and the limits of annuli are fitted on; pivots and annuli a pivot, at most; vectors of an annulus, about, where these limits allow it.
SAMPLE, PIVOTS, RINGS, FILL = 2048, 64, 128, 128
#: Vectors and queries that meet at a time. An annulus of more vectors is dealt to several blocks.
BLOCK, CHUNK = 2048, 256
#: Vectors, about, that a query has met at the end of each round; the last round has no end.
ROUNDS = (64, 4096, None)


@dataclass
class Index:
    """points: row, vec_id, v, cell, ring, r of every vector. pivots have the further component; edges: limits of the rings. cell, ring, count, low, high: a row for each annulus, PIVOTS * RINGS at most."""

    points: DataFrame
    norm: float
    pivots: np.ndarray
    edges: np.ndarray
    rings: dict[str, np.ndarray]
    exact: bool  # whether products of floats are exact


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with their further component."""
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres at most: each is drawn with a chance in proportion to its squared distance from those before, then moved to the mean of its own, twice."""
    rng, chosen = np.random.default_rng(11), sample[:1]
    while len(chosen) < n:
        far = distances(sample, chosen).min(axis=1) ** 2
        if far.sum() <= 1e-9 * (1 + (sample**2).sum()):
            break
        chosen = np.vstack([chosen, sample[rng.choice(len(sample), p=far / far.sum())]])
    for _ in range(2):
        own = distances(sample, chosen).argmin(axis=1)
        chosen = np.stack([sample[own == i].mean(axis=0) if (own == i).any() else chosen[i] for i in range(len(chosen))])
    return chosen


def upper_bounds(queries: np.ndarray, norm: float, pivots: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and annulus a number that no product of the query with a vector of the annulus exceeds; room for rounding included."""
    q = np.column_stack([queries, np.zeros(len(queries))])
    d = distances(q, pivots)
    apart = distances(pivots, pivots)
    plane = np.zeros_like(d)  # a vector of cell j is on j's side of the plane between j and i
    for i in range(len(pivots)):
        with np.errstate(divide="ignore", invalid="ignore"):
            side = (d**2 - d[:, i : i + 1] ** 2) / (2 * apart[i][None, :])
        np.maximum(plane, np.where(apart[i][None, :] > 1e-6 * (1 + norm), side, 0), out=plane)
    own = d[:, cell]
    least = np.maximum(np.maximum(low[None, :] - own, own - high[None, :]), plane[:, cell]) - 1e-6 * (1 + norm)
    square = (q * q).sum(axis=1)[:, None] + norm * norm
    return (square - np.maximum(least, 0) ** 2) / 2 + 1e-6 * square + 1


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of dim numbers; what a list lacks is 0."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def build(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, pivots: int = PIVOTS) -> Index:
    """Keys every vector, its components times scale cut to whole numbers. Pivots and limits of annuli are fitted on SAMPLE vectors, those with the least hash.

    Vectors that are null, or hold a null or a component that isn't finite, take no part; a shorter vector counts as followed by zeros. Products must fit a long, or it is an error."""
    x = F.col(f"`{vector}`")
    whole = vectors.where(x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))))
    cut = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    rows = written(whole.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), cut.alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    n, greatest, dim = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    norm = float(np.sqrt(float(greatest)))
    sample = np.zeros((1, dim))
    if found := rows.orderBy(F.xxhash64("v", "row")).limit(SAMPLE).select("v").collect():
        sample = np.array([r.v + [0] * (dim - len(r.v)) for r in found], dtype=np.float64).reshape(len(found), dim)
    sample = lifted(sample, norm)
    centres = choose_pivots(sample, max(1, min(pivots, int(np.sqrt(n) / 4))))
    n_rings = max(1, min(RINGS, n // (len(centres) * FILL)))
    edges = np.quantile(distances(sample, centres).min(axis=1), np.arange(1, n_rings) / n_rings) if n_rings > 1 else np.zeros(0)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            d = distances(lifted(_matrix(batch.column(2), dim).astype(np.float64), norm), centres)
            cell = d.argmin(axis=1)
            r = d[np.arange(len(d)), cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.searchsorted(edges, r).astype(np.int32)), pa.array(r)], names=["row", "vec_id", "v", "cell", "ring", "r"])

    points = written(rows.mapInArrow(key, "row long, vec_id long, v array<long>, cell int, ring int, r double"), "pivot-index")
    table = points.groupBy("cell", "ring").agg(F.count("*").alias("count"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("cell", "ring").collect()
    rings = {c: np.array([t[c] for t in table], dtype=np.float64 if c in ("low", "high") else np.int64) for c in ("cell", "ring", "count", "low", "high")}
    return Index(points, norm, centres, edges, rings, float(greatest) < 2.0**53)


def _packed(points: DataFrame, keys: list[str], dim: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key: lists of row, vec_id (ascending, nulls last) and the extra columns, and the vectors as one binary of longs. A key has BLOCK rows or so."""
    kinds = {"row": "array<long>", "vec_id": "array<long>", "tau": "array<long>"}
    names = ["row", "vec_id", *extra]

    def pack(table: pa.Table) -> pa.Table:
        import pyarrow as pa

        table = table.combine_chunks().sort_by([("vec_id", "ascending"), ("row", "ascending")])
        held = [pa.array([table.column(n).to_pylist()], pa.list_(pa.int64())) for n in names]
        v = _matrix(table.column("v").combine_chunks(), dim).tobytes()
        return pa.table([*[table.column(k).slice(0, 1) for k in keys], *held, pa.array([v], pa.binary())], names=[*keys, *names, "v"])

    schema = ", ".join([*[f"{k} int" for k in keys], *[f"{n} {kinds[n]}" for n in names], "v binary"])
    return points.groupBy(*keys).applyInArrow(pack, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's row."""
    order = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def search(index: Index, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank from 1, vec_id, score of the k best vectors (all, if fewer) of each vector that is_query (over vec_id) names, without the query's own row. Ties go to the smaller vec_id, a null last.

    Rows with one vec_id are vectors of their own, and so are equal ones. A query takes the annuli by their bounds in rounds; after each round those that can't reach its k-th best are left. In a round, queries
    of a cell in chunks meet the blocks of the annuli that any of them wants; vectors of one annulus are dealt to blocks by a hash of their row, so equal ones spread too."""
    spark, dim = index.points.sparkSession, index.pivots.shape[1] - 1
    t = index.rings
    schema = "q_row long, query_id long, row long, vec_id long, score long"
    rings = spark.createDataFrame(list(zip(*[t[c].tolist() for c in ("cell", "ring", "count")], strict=True)), "cell int, ring int, count long")
    parts = F.ceil(F.col("count") / BLOCK)
    blocks = index.points.join(F.broadcast(rings), ["cell", "ring"]).withColumn("sub", F.pmod(F.xxhash64("row"), parts).cast("int"))
    blocks = written(_packed(blocks, ["cell", "ring", "sub"], dim), "pivot-blocks")
    asked = index.points.where(is_query).select("row", "vec_id", "v", "cell")
    per_cell = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))  # a row a pivot
    asked = written(asked.join(F.broadcast(per_cell), "cell").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int")).drop("chunks"), "pivot-queries")
    best, begun = spark.createDataFrame([], f"{schema}, rank int"), 0
    for end in ROUNDS:
        tau = best.where(F.col("rank") == k).select(F.col("q_row").alias("row"), F.col("score").alias("tau"))
        chunks = _packed(asked.join(tau, "row", "left"), ["cell", "chunk"], dim, ("tau",))
        wanted = chunks.mapInArrow(_wishes(index, begun, end), "cell int, ring int, q_row array<long>, query_id array<long>, tau array<long>, q binary")
        wanted = wanted.join(F.broadcast(rings), ["cell", "ring"]).select("*", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("sub"))
        met = wanted.join(blocks, ["cell", "ring", "sub"]).select("q_row", "query_id", "tau", "q", "row", "vec_id", "v").mapInArrow(_products(dim, k, index.exact), schema)
        best, begun = written(_best(best.drop("rank").unionByName(met), k), "pivot-best"), end
    return best.select("query_id", "rank", "vec_id", "score")


def _wishes(index: Index, begun: int, end: int | None):
    """For chunks of queries: the annuli, by their bounds, at which a query has met begun to end vectors, unless they can't reach its k-th best; each with the queries that want it."""
    norm, pivots, t = index.norm, index.pivots, index.rings

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for one in batch.to_pylist():
                whole = np.frombuffer(one["v"], dtype=np.int64).reshape(len(one["row"]), -1)
                bound = upper_bounds(whole.astype(np.float64), norm, pivots, t["cell"], t["low"], t["high"])
                order = np.argsort(-bound, axis=1, kind="stable")
                sizes = t["count"][order]
                before = np.empty_like(sizes)
                np.put_along_axis(before, order, np.cumsum(sizes, axis=1) - sizes, axis=1)
                least = np.array([-np.inf if x is None else x for x in one["tau"]])
                want = (before >= begun) & (bound >= least[:, None])
                if end is not None:
                    want &= before < end
                for ring in np.flatnonzero(want.any(axis=0)).tolist():
                    at = np.flatnonzero(want[:, ring])
                    held = [[[one[c][i] for i in at.tolist()]] for c in ("row", "vec_id", "tau")]
                    arrays = [pa.array([int(t[c][ring])], pa.int32()) for c in ("cell", "ring")]
                    arrays += [pa.array(h, pa.list_(pa.int64())) for h in held]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([whole[at].tobytes()], pa.binary())], names=["cell", "ring", "q_row", "query_id", "tau", "q"])

    return emit


def _products(dim: int, k: int, exact: bool):
    """For queries and a block: of each query the k best of the block that reach its k-th best so far. exact: floats hold the products; else longs do, by slower steps."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kind = np.float64 if exact else np.int64
        for batch in batches:
            for i in range(len(batch)):
                q_row, query_id, tau, q, row, vec_id, v = (batch.column(c)[i] for c in range(7))
                asked, held = np.array(q_row.as_py(), dtype=np.int64), np.array(row.as_py(), dtype=np.int64)
                a, b = (np.frombuffer(x.as_py(), dtype=np.int64).reshape(n, dim).astype(kind) for x, n in ((q, len(asked)), (v, len(held))))
                score = a @ b.T
                least = np.array([-np.inf if x is None else x for x in tau.as_py()])
                one, other = np.nonzero((score >= least[:, None]) & (asked[:, None] != held[None, :]))
                value = score[one, other]
                order = np.lexsort((other, -value, one))  # places in a block are in the order of ties
                one, other, value = one[order], other[order], value[order]
                first = np.searchsorted(one, np.arange(len(asked)))
                kept = np.arange(len(one)) - first[one] < k
                one, other = one[kept], other[kept]
                arrays = [pa.array(asked[one]), query_id.values.take(pa.array(one)), pa.array(held[other]), vec_id.values.take(pa.array(other)), pa.array(value[kept].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["q_row", "query_id", "row", "vec_id", "score"])

    return emit
