"""Sharding along a Hilbert curve, by DataFrame functions only.

Several metadata columns are quantised to a few bits each; the cell they name has an index on the Hilbert curve, along which
neighbouring indexes are neighbouring cells. Rows in the order of the index are cut into runs of equal row counts. Each shard then
covers a small box in every dimension, so a reader prunes shards by the ranges in shard_ranges()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, small_join, text_of, written

#: Rows that one step of the ordering sorts together, at the mean.
RUN_ROWS = 64
#: Runs that are summed together, at the second level of the ordering.
FAN = 4096


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates, each from 0 to 2**bits - 1.

    Gray-code form: from the top bit down, each coordinate's bit either reflects the low bits of the first coordinate or swaps them with its
    own; the bits that come out, interleaved, are a Gray code of the index."""
    n = len(axes)
    start = F.struct(*[a.cast("long").alias(f"x{i}") for i, a in enumerate(axes)])

    def step(state: Column, level: Column) -> Column:
        xs = [state[f"x{i}"] for i in range(n)]
        low = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
        for i in range(n):
            # each coordinate needs the ones that earlier coordinates have changed, so this is a chain of structs
            held = F.struct(*[x.alias(f"x{j}") for j, x in enumerate(xs)])

            def turned(s: Column) -> Column:  # noqa: B023  called at once
                first, own = s["x0"], s[f"x{i}"]
                is_set = own.bitwiseAND(low + 1) != 0
                swap = first.bitwiseXOR(own).bitwiseAND(low)
                out = []
                for j in range(n):
                    if j == 0:
                        out.append(F.when(is_set, first.bitwiseXOR(low)).otherwise(first if i == 0 else first.bitwiseXOR(swap)))
                    elif j == i:
                        out.append(F.when(is_set, own).otherwise(own.bitwiseXOR(swap)))
                    else:
                        out.append(s[f"x{j}"])
                return F.struct(*[x.alias(f"x{j}") for j, x in enumerate(out)])

            held = F.element_at(F.transform(F.array(held), turned), 1)
            xs = [held[f"x{j}"] for j in range(n)]
        return F.struct(*[x.alias(f"x{j}") for j, x in enumerate(xs)])

    turned = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), start, step) if bits > 1 else start

    def finished(s: Column) -> Column:
        gray = [s["x0"]]
        for i in range(1, n):
            gray.append(s[f"x{i}"].bitwiseXOR(gray[-1]))
        flip = F.aggregate(
            F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>"), F.lit(0).cast("long"),
            lambda t, level: F.when(gray[-1].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level)) != 0, t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1)).otherwise(t),
        )
        return F.struct(*[g.alias(f"g{i}") for i, g in enumerate(gray)], flip.alias("t"))

    def index(s: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(s[f"g{i}"].bitwiseXOR(s["t"]), b).bitwiseAND(F.lit(1).cast("long"))
                out = out.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
        return out

    return F.element_at(F.transform(F.transform(F.array(turned), finished), index), 1)


def quantised(column: Column, kind: str, bits: int) -> Column:
    """A coordinate of a cell. `size`: steps of a quarter of a power of two; `name`: a hash of the value, so any number of names fits. Null is the cell 0."""
    top = (1 << bits) - 1
    if kind == "size":
        return F.coalesce(F.least(F.lit(top), F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double")) * (top / 30.0))), F.lit(0)).cast("long")
    return F.coalesce(F.pmod(F.xxhash64(F.lit("cell"), column), F.lit(top)) + 1, F.lit(0)).cast("long") * column.isNotNull().cast("long")


def hilbert_shards(docs: DataFrame, *, shards: int = 24, bits: int = 5, doc_id: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and curve of every row: rows in Hilbert order of (names..., size), cut into shards whose row counts differ by one at most.

    size is the text's UTF-8 bytes plus 8, a null text has none. Rows of one cell, which may be a third of all, are put in order by a hash of doc_id, size and checksum:
    first in runs of about RUN_ROWS rows, whose counts are summed on two levels, then within a run. Equal ids are ordered by size and checksum; rows
    equal in all of that are alike, so which comes first makes no difference. Null ids, names and texts are kept. An empty table gives no row."""
    t = F.col(text).cast("string")
    meta = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(text_of(text), "UTF-8")).alias("text_crc32"),
        *[quantised(F.col(c).cast("string"), "name", bits).alias(f"c{i}") for i, c in enumerate(names)],
    ).withColumn(f"c{len(names)}", quantised(F.col("size"), "size", bits))
    cell = [f"c{i}" for i in range(len(names) + 1)]
    meta = written(meta, "shard-meta")
    cells = meta.groupBy(*cell).agg(F.count("*").alias("n"))
    curve = hilbert_index([F.col(c) for c in cell], bits)
    cells = written(cells.select(*cell, "n", curve.alias("curve"), F.ceil(F.col("n") / F.lit(RUN_ROWS)).cast("long").alias("runs")), "shard-cells")
    # At most 2**(bits * dimensions) cells whatever the rows, so their running count is a small table's.
    n_cells, total = cells.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(*cell, "curve", "runs", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_base"))
    placed = small_join(meta, bases, cell, n_cells).withColumn("run", F.pmod(F.xxhash64(F.lit("run"), F.col("doc_id"), F.col("size"), F.col("text_crc32")), F.col("runs"))).drop(*cell, "runs")

    by_run = placed.groupBy("curve", "cell_base", "run").agg(F.count("*").alias("n")).withColumn("fan", F.expr(f"run div {FAN}"))
    fans = by_run.groupBy("curve", "fan").agg(F.sum("n").alias("fan_n"))
    fans = fans.select("curve", "fan", F.coalesce(F.sum("fan_n").over(Window.partitionBy("curve").orderBy("fan").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("fan_base"))
    within = Window.partitionBy("curve", "fan").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    run_base = by_run.withColumn("in_fan", F.coalesce(F.sum("n").over(within), F.lit(0))).join(fans, ["curve", "fan"])
    run_base = run_base.select("curve", "run", (F.col("cell_base") + F.col("fan_base") + F.col("in_fan")).alias("base"))
    order = Window.partitionBy("curve", "run").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.drop("cell_base").withColumn("nth", F.row_number().over(order)).join(run_base, ["curve", "run"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.ceil(shard * F.lit(total).cast("decimal(30,0)") / F.lit(shards)).cast("long")
    return ranked.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"), "curve")


def _matched(docs: DataFrame, placed: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """docs with two more columns, shard and slot, and their names. Rows meet by id, size and checksum; of rows equal in all three each gets one of their places."""
    taken: list[str] = list(docs.columns)

    def name(n: str) -> str:
        taken.append(fresh(taken, n))
        return taken[-1]

    key, nth, shard, slot = [name(n) for n in ("placed_id", "placed_size", "placed_crc")], name("nth"), name("shard"), name("slot")
    t = F.col(f"`{text}`").cast("string")
    own = [F.col(f"`{doc_id}`"), (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long"), F.crc32(F.encode(F.coalesce(t, F.lit("")), "UTF-8"))]
    mine = docs.select("*", *[c.alias(n) for c, n in zip(own, key, strict=True)])
    mine = mine.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(key[0])))
    theirs = placed.select("doc_id", "size", "text_crc32", F.col("shard").alias(shard), F.col("slot").alias(slot), F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("shard", "slot")).alias("n_"))
    on = mine[key[0]].eqNullSafe(theirs["doc_id"]) & (mine[key[1]] == theirs["size"]) & (mine[key[2]] == theirs["text_crc32"]) & (mine[nth] == theirs["n_"])
    return mine.join(theirs, on).select(*[mine[c] for c in docs.columns], theirs[shard], theirs[slot]), shard, slot


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes docs as Parquet under path/shard=N, each shard in slot order, and returns the name of that column: shard, or shard_ and so on where docs has one of that name already.

    Every row is written once with all its columns. Null and repeated ids are told apart by size and checksum; rows equal in these are spread over their places."""
    out, shard, slot = _matched(docs, placed, doc_id, text)
    out = out.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shard, slot).sortWithinPartitions(shard, slot)
    out.drop(slot).write.partitionBy(shard).parquet(path)
    return shard


def shard_ranges(docs: DataFrame, placed: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each shard its rows and the least and greatest value of each column: what a reader needs to skip shards. Null values count in neither; an empty table gives no row."""
    out, shard, _ = _matched(docs, placed, doc_id, text)
    aggs = [f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return out.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("n_rows"), *aggs)
