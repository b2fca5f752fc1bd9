"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared as they are: exclusive-or and bit counts in numpy, tile against tile. A pair of tiles gives all links if they are few, else a forest with the
same components, so a large group of near copies gives no square of links. Components come from alternating star operations on links.

near_duplicates: 64 bits, links within a few bits. A fingerprint's signature is the bit count of each of its quarters. Two fingerprints that differ in r bits have signatures
at most r apart (sum of differences), so only tiles whose signatures are that near are compared; no pair within the radius is missed. A tile holds the distinct
fingerprints of one signature, in parts of about TILE.

similar_documents: links by the Jaccard similarity of the sets of shingles. For a similarity of 0.8 a fingerprint's bits differ with a chance of about 0.15, at most 0.19 in the
shortest sets; of WIDE words of 64 bits a share of REACH is far beyond that, and far below the half in which unrelated ones differ. Links within that reach give groups; only pairs of one
group and within reach are verified, on their whole sets, next to each other in numpy, nearest first and unless links found before connect them. So no pair below the
similarity is linked, and a large group gives a forest, not its pairs. So wide a reach skips few tiles by their bit counts; tiles are cut by the sets' sizes too, which
can't be further apart than the similarity."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_size, carried_id, discard, modest_batches, restored_id, row_key, text_of, without, written

TILE, QUARTERS = 2048, 4
#: Members of sets, and sets, that are verified side by side: a large group is cut into tiles of so many.
TILE_MEMBERS, TILE_SETS = 1 << 18, 512
#: Words of a wide fingerprint, and the share of its bits in which two may differ to be verified.
WIDE, REACH = 4, 0.26
#: Hashes counted at a time.
CHUNK = 1 << 15
#: Stands for a null id: the last one.
LAST = 2**63 - 1
EPSILON = 1e-9


def shingle_hashes(text: str, n: int) -> Iterator[int]:
    """XXH64 (seed 42) of each shingle, repeats included. A-Z count as a-z; fewer words than n are one shingle; no words give none."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < n:
        shingles: Iterator[bytes] = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False))
    digest = xxhash.xxh64_intdigest
    return (digest(s, 42) for s in shingles)


def majority(hashes: Iterator[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    hashes, total, set_bits = iter(hashes), 0, np.zeros(64, dtype=np.int64)
    while part := list(itertools.islice(hashes, CHUNK)):
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str, n: int = 3) -> int:
    return majority(shingle_hashes(text, n))


def shingle_set(text: str, n: int) -> np.ndarray:
    """The distinct hashes, sorted as unsigned numbers; a text without words has the one member 0."""
    found = np.unique(np.fromiter(shingle_hashes(text, n), dtype=np.uint64))
    return found if len(found) else np.zeros(1, dtype=np.uint64)


def wide_fingerprint(members: np.ndarray) -> np.ndarray:
    """WIDE words of bits that are set in over half of the members' hashes, hashed anew for each word."""
    out = np.zeros(WIDE, dtype=np.uint64)
    for k in range(WIDE):
        set_bits = np.zeros(64, dtype=np.int64)
        for at in range(0, len(members), CHUNK):
            x = members[at : at + CHUNK] + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
            if k:  # the usual finishing steps of a 64-bit hash
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = x ^ (x >> np.uint64(31))
            set_bits += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * set_bits > len(members), bitorder="little").view("<u8")[0]
    return out


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    modest_batches(docs.sparkSession)
    row_id, row_text = row_key(docs, doc_id, text)
    return docs.select(row_id.alias("doc_id"), row_text.alias("t"), text_of(text).alias("text"))


def fingerprints(docs: DataFrame, *, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (see row_key) and fp (the fingerprint as a signed long) of each row; a null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "t": batch["t"], "fp": fp})

    slim = _slim(docs, doc_id, text).select(*carried_id(F.col("doc_id")), "t", "text")
    return restored_id(slim.mapInPandas(run, "doc_id long, no_id boolean, t long, fp long"))


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals in a and b of fingerprints that differ in at most radius bits, as linked() gives them."""
    near = np.empty((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 256):
        near[at : at + 256] = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
    return linked(near, same)


def linked(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The links of a matrix, columns counted on after the rows unless they are the same ones. If there are more than a few a row, a forest that connects the same ones (in it a row may be linked to a row)."""
    n, m = near.shape
    if same:
        np.fill_diagonal(near, False)
        count = int(np.count_nonzero(near)) // 2
    else:
        count = int(np.count_nonzero(near))
    if count <= 4 * (n + m):
        i, j = np.nonzero(np.triu(near) if same else near)
        return i, j + n
    # least label over neighbours until nothing changes; a label is the ordinal of a row
    label_a, far = np.arange(n), np.int64(1) << 40
    while True:
        label_b = np.where(near, label_a[:, None], far).min(axis=0)
        if same:
            label_b = np.minimum(label_b, label_a)
        after = np.minimum(label_a, np.where(near, label_b[None, :], far).min(axis=1))
        if same:
            after = np.minimum(after, label_b)
        if (after == label_a).all():
            break
        label_a = after
    i = np.flatnonzero(label_a != np.arange(n))
    links = [(label_a[i], i)]
    if not same:
        j = np.flatnonzero(label_b < far)
        links.append((label_b[j], j + n))
    return np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v), u < v: links between fingerprints (column fp, no value twice) at most radius bits apart, or forests of them in dense tiles."""
    spark = distinct.sparkSession
    width = 64 // QUARTERS
    quarter = [F.bit_count(F.shiftrightunsigned("fp", width * q).bitwiseAND(F.lit((1 << width) - 1))).cast("int").alias(f"q{q}") for q in range(QUARTERS)]
    names = [f"q{q}" for q in range(QUARTERS)]
    signed = distinct.select("fp", *quarter)
    sizes = signed.groupBy(*names).agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("parts"))
    parted = signed.join(sizes, names).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = written(parted.groupBy(*names, "part").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    # a step to itself or to a greater signature; the other tile takes the same step back
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])).alias("step")
    left = tiles.select(*[F.col(n).alias(f"a_{n}") for n in names], F.col("part").alias("a_part"), F.col("fps").alias("a"))
    near = tiles.select(*names).distinct()
    wanted = tiles.select(*[F.col(n).alias(f"a_{n}") for n in names]).distinct().select("*", step)
    wanted = wanted.select(*[f"a_{n}" for n in names], *[(F.col(f"a_{n}") + F.col("step")[q]).alias(n) for q, n in enumerate(names)]).join(near, names)
    pairs = left.join(wanted, [f"a_{n}" for n in names]).join(tiles, names)
    is_same = None
    for n in names:
        is_same = (F.col(f"a_{n}") == F.col(n)) if is_same is None else is_same & (F.col(f"a_{n}") == F.col(n))
    pairs = pairs.where(~is_same | (F.col("a_part") <= F.col("part"))).select("a", F.col("fps").alias("b"), (is_same & (F.col("a_part") == F.col("part"))).alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out_u, out_v = [], []
            for a, b, same in zip(batch["a"], batch["b"], batch["same"], strict=True):
                a, b = np.asarray(a, dtype=np.int64).view(np.uint64), np.asarray(b, dtype=np.int64).view(np.uint64)
                i, j = near_pairs(a, b, radius, bool(same))
                if len(i):
                    both = np.concatenate((a, b)).view(np.int64)
                    out_u.append(both[i])
                    out_v.append(both[j])
            if out_u:
                u, v = np.concatenate(out_u), np.concatenate(out_v)
                yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return pairs.mapInPandas(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have an edge and aren't it.

    Large-star and small-star steps by turns: each node links its greater neighbours, then its lesser ones, to the least node it knows. Minima are taken before rows
    meet, each step is a table in the shared folder, and the steps end when one changes nothing."""
    spark = edges.sparkSession
    edges = written(edges.where("u != v").distinct(), "star-0")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("u"), "v").where("u != v").distinct()
        large = written(large, "star-large")
        down = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), "m")
        small = large.join(down, F.col("v") == F.col("w")).select(F.col("m"), F.explode(F.array("u", "v")).alias("v")).where("m != v").select(F.col("m").alias("u"), "v").distinct()
        last, edges = edges, written(small, "star-small")
        discard(last, large)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


def _first() -> Column:
    """The place of a row in the order of ids, null last, and hashes of texts."""
    return F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("t"))


def _named(marked: DataFrame, distinct: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """marked with `keep`, the first place in the component of each row's node. distinct: a row a node, with `first`."""
    star = components(edges)
    rooted = distinct.join(star.select(F.col("node").alias("k"), "root"), F.col(node) == F.col("k"), "left").select(node, "first", F.coalesce("root", node).alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    named = written(rooted.select(node, "root").join(firsts, "root").select(F.col(node).alias("k"), "keep"), "simhash-names")
    return marked.join(named, marked[node] == named["k"]).drop("k")


def _component_id() -> Column:
    return F.when(F.col("keep.d") != LAST, F.col("keep.d")).alias("component_id")


def _near(docs: DataFrame, radius: int, shingle: int, doc_id: str, text: str) -> DataFrame:
    marked = written(fingerprints(docs, shingle=shingle, doc_id=doc_id, text=text), "simhash-docs")
    distinct = written(marked.groupBy("fp").agg(F.min(_first()).alias("first")), "simhash-distinct")
    return _named(marked, distinct, links(distinct, radius), "fp")


def near_duplicates(docs: DataFrame, *, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that is reached by links of at most radius bits) of each row of docs.

    Documents without words have fingerprint zero and are linked like others. Null ids are no least id: a component of null ids only has a null one. Rows
    that repeat get equal results. An empty table gives no row."""
    return _near(docs, radius, shingle, doc_id, text).select("doc_id", "fp", _component_id())


def distances(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which wide fingerprints (a row each) differ; 999 where the sets' sizes don't allow the similarity."""
    far = np.empty((len(a), len(b)), dtype=np.uint16)
    for at in range(0, len(a), 256):
        rows = slice(at, at + 256)
        total = np.zeros((len(a[rows]), len(b)), dtype=np.uint16)
        for k in range(WIDE):
            total += np.bitwise_count(a[rows, k, None] ^ b[None, :, k])
        total[similarity * np.maximum(sizes_a[rows, None], sizes_b[None, :]) > np.minimum(sizes_a[rows, None], sizes_b[None, :]) + EPSILON] = 999
        far[rows] = total
    return far


def _in_reach(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between nodes (node, n, f0...) within reach, tile against tile. Sizes of one class or the next can be similar enough."""
    step = math.log(1 / similarity) if similarity < 1 else 1.0
    classed = nodes.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / step + EPSILON).cast("int"))
    parts = classed.groupBy("c").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("parts"))
    columns = ["node", F.col("n").cast("long"), *[f"f{k}" for k in range(WIDE)]]
    bits = sum((F.bit_count(f"f{k}") for k in range(1, WIDE)), F.bit_count("f0"))
    # a row a size class, of which there are as many as doublings of a text's length, about
    placed = classed.join(F.broadcast(parts), "c").select("c", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.array(*columns).alias("row"), bits.alias("bits"))
    tiles = placed.groupBy("c", "part").agg(F.flatten(F.collect_list("row")).alias("rows"), F.min("bits").alias("low"), F.max("bits").alias("high"))
    tiles = written(tiles, "simhash-wide-tiles")
    left = tiles.select(F.col("c").alias("ac"), F.col("part").alias("ap"), F.col("rows").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    reach = int(REACH * 64 * WIDE)
    pairs = left.join(tiles, "c").where(f"(ac < c or ap <= part) and low - ah <= {reach} and al - high <= {reach}")
    pairs = pairs.select("a", F.col("rows").alias("b"), F.expr("ac = c and ap = part").alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, same in zip(batch["a"], batch["b"], batch["same"], strict=True):
                a, b = (np.asarray(x, dtype=np.int64).reshape(-1, 2 + WIDE) for x in (a, b))
                i, j = linked(distances(a[:, 2:].view(np.uint64), b[:, 2:].view(np.uint64), a[:, 1], b[:, 1], similarity) <= reach, bool(same))
                nodes = np.concatenate((a[:, 0], b[:, 0]))
                yield pd.DataFrame({"u": np.minimum(nodes[i], nodes[j]), "v": np.maximum(nodes[i], nodes[j])})

    return pairs.mapInPandas(compare, "u long, v long")


def similar_sets(a: list[np.ndarray], b: list[np.ndarray], same: bool, similarity: float) -> list[tuple[int, int]]:
    """Links (ordinals in a and b) of rows (node, words of the fingerprint, members) within reach whose sets are so similar; not those that earlier ones, nearer, connect."""
    print_a, print_b = (np.array([x[1 : 1 + WIDE] for x in rows]).view(np.uint64) for rows in (a, b))
    size_a, size_b = (np.array([len(x) - 1 - WIDE for x in rows]) for rows in (a, b))
    far = distances(print_a, print_b, size_a, size_b, similarity)
    if same:
        far[np.tril_indices(len(a))] = 999
    i, j = np.nonzero(far <= int(REACH * 64 * WIDE))
    order = np.argsort(far[i, j], kind="stable")
    parent, sets, out = list(range(len(a) + (0 if same else len(b)))), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def members(x: int) -> set[int]:
        if x not in sets:
            sets[x] = set((a[x] if x < len(a) else b[x - len(a)])[1 + WIDE :].tolist())
        return sets[x]

    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        z = y if same else len(a) + y
        u, v = root(x), root(z)
        if u != v:
            shared = len(members(x) & members(z))
            if shared >= similarity * (size_a[x] + size_b[y] - shared) - EPSILON:
                parent[u] = v
                out.append((x, y))
    return out


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of sufficient similarity among the sets (root, row: node, words, members) of each group; a group of several tiles is compared tile against tile."""
    size = F.greatest(F.ceil(F.sum(F.size("row")) / F.lit(TILE_MEMBERS)), F.ceil(F.count("*") / F.lit(TILE_SETS))).cast("int")
    parts = sets.groupBy("root").agg(size.alias("parts"))
    placed = sets.join(parts, "root").withColumn("part", F.pmod(F.xxhash64(F.col("row")[0]), F.col("parts")).cast("int"))
    tiles = written(placed.groupBy("root", "part", "parts").agg(F.collect_list("row").alias("rows")), "simhash-groups")
    alone = tiles.where("parts = 1").select(F.col("rows").alias("a"), F.array().cast("array<array<bigint>>").alias("b"), F.lit(True).alias("same"))
    many = tiles.where("parts > 1")
    left = many.select("root", F.col("part").alias("ap"), F.col("rows").alias("a"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"))
    pairs = left.join(many.select("root", "part", "rows"), ["root", "part"]).select("a", F.col("rows").alias("b"), F.expr("ap = part").alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u, v = [], []
            for a, b, same in zip(batch["a"], batch["b"], batch["same"], strict=True):
                b = a if same else b
                found = similar_sets(list(a), list(b), bool(same), similarity)
                u += [int(a[x][0]) for x, _ in found]
                v += [int(b[y][0]) for _, y in found]
            yield pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

    schema = "u long, v long"
    return alone.mapInPandas(compare, schema).unionByName(pairs.mapInPandas(compare, schema))


def _node_of(members: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), 42)).view(np.int64))


def _similar(docs: DataFrame, similarity: float, shingle: int, doc_id: str, text: str) -> DataFrame:
    slim = _slim(docs, doc_id, text)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                members = shingle_set(t, shingle)
                rows.append((_node_of(members), len(members), *wide_fingerprint(members).view(np.int64).tolist()))
            out = pd.DataFrame(rows, columns=["node", "n", *[f"f{k}" for k in range(WIDE)]])
            out.insert(0, "t", batch["t"].to_numpy())
            out.insert(0, "no_id", batch["no_id"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    words = [f"f{k}" for k in range(WIDE)]
    taken = slim.select(*carried_id(F.col("doc_id")), "t", "text")
    marked = written(restored_id(taken.mapInPandas(mark, "doc_id long, no_id boolean, t long, node long, n int, " + ", ".join(f"{w} long" for w in words))), "simhash-docs")
    nodes = written(marked.groupBy("node").agg(F.min(_first()).alias("first"), *[F.first(c).alias(c) for c in ("n", *words)]), "simhash-nodes")
    roots = components(_in_reach(nodes.select("node", "n", *words), similarity))
    # the groups' sets are made again from the first text of each node
    grouped = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    wanted = nodes.join(grouped, "node").select(F.col("node").alias("w"), "root", *words, F.col("first.d").alias("d"), F.col("first.t").alias("wt"))
    wanted = written(wanted, "simhash-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    found = slim.join(F.broadcast(wanted) if few else wanted, (F.coalesce("doc_id", F.lit(LAST)) == F.col("d")) & (F.col("t") == F.col("wt"))).select("w", "root", *words, "text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_size(batches):
            heads = batch[["w", *words]].to_numpy(dtype=np.int64)
            yield pd.DataFrame({"root": batch["root"].to_numpy(), "row": [np.concatenate((head, shingle_set(t, shingle).view(np.int64))) for head, t in zip(heads, batch["text"], strict=True)]})

    sets = found.mapInPandas(read, "root long, row array<long>")
    # rows that repeat a document give its set again: one is enough
    sets = written(sets.groupBy("root", F.col("row")[0].alias("w")).agg(F.first("row").alias("row")).select("root", "row"), "simhash-sets")
    return _named(marked, nodes, _verified(sets, similarity), "node")


def similar_documents(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id (the least doc_id that is reached by links of at least this Jaccard similarity of shingle sets) of each row of docs.

    Documents without words are alike. Null ids are no least id: a component of null ids only has a null one. Rows that repeat get equal results. Hashes of 64 bits that are equal count
    as equal shingles. An empty table gives no row."""
    return _similar(docs, similarity, shingle, doc_id, text).select("doc_id", _component_id())


def deduplicated(docs: DataFrame, *, similarity: float | None = None, radius: int = 3, shingle: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id, null last. Components are those of similar_documents if a similarity is given, else those of near_duplicates.

    Rows are told apart by id and text; rows equal in both are one document and stay together. Columns are those of docs."""
    found = _near(docs, radius, shingle or 3, doc_id, text) if similarity is None else _similar(docs, similarity, shingle or 5, doc_id, text)
    gone = found.where(_first() != F.col("keep")).select("doc_id", "t")
    return without(docs, gone, doc_id, text)
