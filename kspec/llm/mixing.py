"""Temperature mixing of sources.

Source shares p are raised to an exponent a in [0, 1] and normalised: w ~ p**a. a = 1 keeps the corpus as it is, a = 0 gives
every source the same weight. a is found by bisection as the least exponent at which neither the entropy of w exceeds
`target_entropy` nor any source is repeated more than `max_repeats` times. The weights become token budgets per source, and
each budget is spent in whole epochs, each epoch an own permutation of the source's blocks of documents and of the documents in
a block; the last epoch ends where the budget does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, modest_batches, small_join, text_of, word_count, written

#: Bins of the permuted block key; the bin in which a budget ends is the only one ordered row by row.
BINS = 4096


def bisect_exponent(measure: Callable[[float], float], limit: float, steps: int = 60) -> float:
    """The least exponent in [0, 1] at which the measure, which falls as the exponent grows, is at most the limit; 1 if none is."""
    if measure(0.0) <= limit:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        if measure(middle) <= limit:
            high = middle
        else:
            low = middle
    return high


def _summary(stats: DataFrame, rows: int) -> Callable[[float], tuple[float, float, float]]:
    """exponent -> (normaliser, entropy, repeats of the most repeated source when the least repeated one is read once)."""
    total = stats.agg(F.sum("n_tokens")).first()[0] or 0
    if rows <= BROADCAST_ROWS:
        shares = np.array([r[0] for r in stats.select("n_tokens").collect()], dtype=float) / max(total, 1)
        shares.sort()

        def measured(a: float) -> tuple[float, float, float]:
            if not len(shares):
                return 1.0, 0.0, 1.0
            raw = shares**a
            w = raw / raw.sum()
            ratio = w / shares
            return float(raw.sum()), float(-(w * np.log(w)).sum()), float(ratio.max() / ratio.min())

        return measured

    share = F.col("n_tokens") / F.lit(float(total))

    def measured_by_spark(a: float) -> tuple[float, float, float]:
        raw = F.pow(share, F.lit(a))
        z, s, top, low = stats.agg(F.sum(raw), F.sum(raw * F.log(raw)), F.max(raw / share), F.min(raw / share)).first()
        return z, math.log(z) - s / z, top / low

    return measured_by_spark


def _encoded(slim: DataFrame, encoder: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """slim (doc_id, source, text, t) with n_tokens in place of text."""
    modest_batches(slim.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            counts = pa.array([len(encode(t)) // 4 for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), counts], names=["doc_id", "source", "t", "n_tokens"])

    return slim.mapInArrow(run, StructType([*slim.schema.fields[:2], slim.schema["t"], StructField("n_tokens", LongType())]))


def mixture(
    docs: DataFrame, *, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, block_docs: int = 64,
    encoder: Callable[[], Callable[[str], bytes]] | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> tuple[DataFrame, DataFrame, float]:
    """(documents as id, source, t (see text_key) and tokens, a row of budgets for each source, the exponent).

    target_entropy is a part (0 to 1) of the greatest entropy, log of the number of sources. budget is in tokens; left out, it is
    the least budget at which every source is read once at least, so no document is lost. encoder gives, in a task, the function from a text to its ids of four bytes each; tokens
    are those ids, without an encoder they are words. A document counts one at least, so empty and null texts keep a place. A null source is a source of its own.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_of(text).alias("text"), text_key(text).alias("t"))
    counted = slim.withColumn("n_tokens", word_count(F.col("text"))).drop("text") if encoder is None else _encoded(slim, encoder)
    narrow = written(counted.withColumn("n_tokens", F.greatest("n_tokens", F.lit(1)).cast("long")), "mix-docs")
    stats = written(narrow.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "mix-sources")
    rows, total = stats.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    summary = _summary(stats, rows)
    exponent = 0.0 if target_entropy is not None or max_repeats is not None else 1.0
    if target_entropy is not None and rows > 1:
        exponent = max(exponent, bisect_exponent(lambda a: summary(a)[1], target_entropy * math.log(rows)))
    if max_repeats is not None and rows:
        exponent = max(exponent, bisect_exponent(lambda a: summary(a)[2], max(1.0, max_repeats)))
    share = F.col("n_tokens") / F.lit(float(max(total, 1)))
    weight = F.pow(share, F.lit(exponent)) / F.lit(summary(exponent)[0])
    weighted = stats.withColumn("weight", weight)
    if budget is None:
        budget = weighted.agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0] or 0.0
    budgets = weighted.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long")).select(
        "source", "n_docs", "n_tokens", "weight", "budget", F.floor(F.col("budget") / F.col("n_tokens")).cast("int").alias("epochs"),
        F.pmod(F.col("budget"), F.col("n_tokens")).alias("rest"), F.ceil(F.col("n_docs") / F.lit(block_docs)).cast("long").alias("n_blocks"),
    )
    return narrow, _with_cut(narrow, written(budgets, "mix-budgets"), rows, seed), exponent


def text_key(text: str = "text") -> F.Column:
    """What tells rows of one id, or without one, apart. Rows equal in id and text are one document: the end of a budget takes or leaves them together."""
    return F.xxhash64(text_of(text))


def _keys(df: DataFrame, epoch: F.Column, seed: int) -> DataFrame:
    """The permutation of an epoch: a key for the block and one for the document (doc_id and t), both from hashes of seed and epoch."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col("doc_id"), F.col("t")), F.col("n_blocks"))
    high = F.xxhash64(F.lit(seed), F.lit("order"), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), epoch, block)
    return df.select(
        "*", epoch.alias("epoch"), block.alias("block"), F.shiftrightunsigned(high, 1).alias("block_key"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("within"), epoch, F.col("doc_id"), F.col("t")), 1).alias("doc_key"),
    )


def _with_cut(narrow: DataFrame, budgets: DataFrame, rows: int, seed: int) -> DataFrame:
    """budgets with the last (block_key, doc_key, doc_id, t) that the unfinished epoch of each source still takes.

    Tokens are summed in BINS bins of the block key, so only the rows of the bin where the budget ends are put in order."""
    partial = _keys(small_join(narrow, budgets.where("rest > 0").select("source", "epochs", "rest", "n_blocks"), ["source"], rows), F.col("epochs"), seed)
    bin_no = F.shiftright(F.col("block_key"), 51).alias("bin")
    sums = partial.groupBy("source", "rest", bin_no).agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).where("before < rest and before + t >= rest")
    ends = written(ends.select("source", F.col("bin").alias("end_bin"), "before"), "mix-ends")
    last = small_join(partial.withColumn("bin", bin_no), ends, ["source"], rows).where("bin = end_bin")
    place = ["block_key", "doc_key", "doc_id", "t"]
    last = last.groupBy("source", "rest", "before", *place).agg(F.sum("n_tokens").alias("n_tokens"))  # equal rows are one in the order
    order = Window.partitionBy("source").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    taken = last.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("ahead < rest")
    cut = written(taken.groupBy("source").agg(F.max(F.struct(*place)).alias("cut")), "mix-cuts")
    return written(small_join(budgets, cut, ["source"], rows, "left"), "mix-plan")


def realise(docs: DataFrame, plan: DataFrame, seed: int = 7, key: F.Column | None = None) -> DataFrame:
    """A row of docs (columns doc_id and source, any others, and t, unless key gives it) for each time that the plan takes it, with epoch, block, block_key, doc_key and mix_key.

    Rows in the order of mix_key, block_key, doc_key are the mixture: each source is spread over it evenly, so any long run of rows has
    the target weights. Repeated rows are taken as often as they stand in docs. Only the plan, a row a source, is joined to them."""
    held = [f"__h{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held, strict=True)], F.col("doc_id"), F.col("source"), (F.col("t") if key is None else key).alias("t"))
    each = small_join(inner, plan.select("source", "budget", "n_tokens", "epochs", "rest", "n_blocks", "cut"), ["source"], plan.count())
    each = each.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - F.when(F.col("cut").isNull(), 1).otherwise(0)))).where("__epoch <= epochs and epochs + rest > 0")
    keyed = _keys(each, F.col("__epoch"), seed)
    whole = F.col("__epoch") < F.col("epochs")
    keyed = keyed.where(whole | (F.col("cut").isNotNull() & (F.struct("block_key", "doc_key", "doc_id", "t") <= F.col("cut"))))
    mix_key = (F.col("__epoch") + F.col("block_key") / F.lit(2.0**63)) * F.col("n_tokens") / F.col("budget")
    return keyed.select(*[F.col(h).alias(c) for c, h in zip(docs.columns, held, strict=True)], F.col("epoch").cast("int").alias("mix_epoch"), F.col("block").alias("mix_block"), F.col("block_key").alias("mix_block_key"), F.col("doc_key").alias("mix_doc_key"), mix_key.alias("mix_key"))


def mix(docs: DataFrame, *, seed: int = 7, **options) -> DataFrame:
    """docs, each row as often as the mixture takes it, and nothing else: its columns are those of docs.

    An empty table gives an empty one. See mixture() for nulls and options, realise() for ties and repeated rows."""
    _, plan, _ = mixture(docs, seed=seed, **options)
    return realise(docs, plan, seed, text_key(options.get("text", "text"))).select(*[f"`{c}`" for c in docs.columns])
