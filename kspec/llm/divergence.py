"""Audit of sources: which sources of a language write how differently, and by which terms.

A document becomes terms by one bytes.translate, which lowers letters and blanks whatever separates, and one bytes.split; a Counter a document gives frequencies and document counts.
Everything after that is sparse: only what occurs is shuffled, and a term that two sources lack adds the same to each pair, so it is counted and not listed."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_join, text_of, written

if TYPE_CHECKING:
    import pyarrow as pa

#: Letters are lowered, bytes of characters beyond ASCII stay, all else separates.
TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: A task hands its counts on at so many entries, and works on so many pairs at a time.
ENTRIES, PAIRS = 600_000, 1 << 21
#: A task's entry is its documents times this, plus its occurrences: one dictionary holds both.
DOCUMENT = 1 << 40
#: Shares are whole numbers of this many parts.
SCALE = 1_000_000_000


def terms_of(text: bytes) -> Counter[bytes]:
    """The terms of a text in UTF-8 and how often each occurs."""
    return Counter(text.translate(TABLE).split())


def frequencies(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n, n_docs: occurrences of each term in a group, and documents (rows) that hold it. Nulls count as the empty text, language and source.

    A task sums its documents' Counters before it hands them on, so a frequent term is a row for each group and handful of batches, however often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        counts: dict[tuple[str, str], dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang_, source_), own in counts.items():
                documents, occurrences = np.divmod(np.fromiter(own.values(), np.int64, len(own)), DOCUMENT)
                arrays = [pa.array([lang_] * len(own), pa.string()), pa.array([source_] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array(occurrences), pa.array(documents)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "n_docs"])
            counts.clear()

        entries = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(len(batch)):
                own = counts[langs[i], sources[i]]
                before = len(own)
                for t, c in terms_of(batch.column(2)[i].as_py()).items():
                    own[t] += c + DOCUMENT
                entries += len(own) - before
                if entries > ENTRIES:
                    yield from handed_on()
                    entries = 0
        yield from handed_on()

    slim = docs.select(text_of(f"`{lang}`").alias("lang"), text_of(f"`{source}`").alias("source"), text_of(f"`{text}`").cast("binary").alias("text"))
    parts = slim.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    # one shuffle: what is grouped by language and term is grouped by language, source and term too
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: str, total: str, terms: str) -> Column:
    """One more than the share of n + 1 occurrences in total + terms, in parts of SCALE; exact for any long."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * {SCALE}BD) div cast({total} + {terms} as decimal(20, 0))")


def distance(p: str, q: str) -> Column:
    """Squared difference of two shares over the second, cut off. Shares are SCALE + 1 at most, so nothing overflows a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For terms with the sources that have them (lang, list of s, p, b): what a pair of sources that both have the term adds beyond what each adds by itself, summed for the pairs of a slice."""
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(1)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        s, p, b = (flat.field(n).to_numpy() for n in ("s", "p", "b"))
        langs = batch.column(0).dictionary_encode()
        code = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
        k, start = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)  # of each element its list's
        for piece in np.split(np.arange(len(s)), np.flatnonzero(np.diff(np.cumsum(k) // PAIRS)) + 1):
            if not len(piece):
                continue
            one = np.repeat(piece, k[piece])
            inner = np.arange(len(one)) - np.repeat(np.cumsum(k[piece]) - k[piece], k[piece])
            other = start[one] + inner
            one, other = one[one != other], other[one != other]
            if not len(one):
                continue
            added = _apart(p[one], p[other]) - _apart(p[one], b[other]) - _apart(b[one], p[other]) + _apart(b[one], b[other])
            width = int(s.max()) + 1
            key, span = (code[one] * width + s[one]) * width + s[other], len(langs.dictionary) * width * width
            if span <= 4 * PAIRS:
                sums = np.zeros(span, dtype=np.int64)
                np.add.at(sums, key, added)
                keys = np.flatnonzero(sums)
                sums = sums[keys]
            else:
                keys, inverse = np.unique(key, return_inverse=True)
                sums = np.zeros(len(keys), dtype=np.int64)
                np.add.at(sums, inverse, added)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // (width * width))), pa.array(keys // width % width), pa.array(keys % width), pa.array(sums)], names=["lang", "s", "t", "v"])


def audit(docs: DataFrame, *, least_docs: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the other sources of the language by their distance, all of them; part `term`: the terms that a source uses more than its language, `top` of them.

    A language's terms are those in least_docs of its documents. Each source of a language, with terms or without, has a smoothed share of each; distances of shares are summed over all terms. Nulls count as the
    empty text, language and source; equal rows are documents of their own; an empty table gives no row; a language without terms has distances of 0. Ties go by the item's bytes.

    With S sources in a language the result has S * (S - 1) pairs, so lists of a language's sources, or of a term's, are no longer than one source's result. A row for each term and source that has it is what is shuffled."""
    counts = frequencies(docs, lang, source, text)
    term = Window.partitionBy("lang", "term")
    nth = F.row_number().over(term.orderBy("source"))
    held = counts.select("*", F.sum("n_docs").over(term).alias("in_docs"), F.sum("n").over(term).alias("lang_n"), (nth == 1).cast("long").alias("first"))
    kept = written(held.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(text_of(f"`{lang}`").alias("lang"), text_of(f"`{source}`").alias("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"]).withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups = written(groups.withColumn("b", F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(1))), "divergence-groups")
    n_groups = groups.count()

    rows = small_join(kept, groups, ["lang", "source"], n_groups)
    rows = rows.select("lang", "source", "term", "s", "b", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    said = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))

    one = groups.select("lang", "s", "source", "terms", F.col("b").alias("bs"))
    two = groups.select("lang", F.col("s").alias("t"), F.col("source").alias("item"), F.col("b").alias("bt"))
    alone = small_join(rows.groupBy("lang", "s", "b", "p").agg(F.count("*").alias("m")), two.drop("item"), ["lang"], n_groups).where("s != t")
    forth = F.struct("s", "t", (F.col("m") * (distance("p", "bt") - distance("b", "bt"))).alias("v"))
    back = F.struct(F.col("t").alias("s"), F.col("s").alias("t"), (F.col("m") * (distance("bt", "p") - distance("bt", "b"))).alias("v"))
    alone = alone.select("lang", F.explode(F.array(forth, back)).alias("x")).select("lang", "x.*")
    lists = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p", "b")).alias("l")).where("size(l) > 1").select("lang", "l")
    both = lists.mapInArrow(_met, "lang string, s long, t long, v long")
    sums = alone.unionByName(both).groupBy("lang", "s", "t").agg(F.sum("v").alias("v"))
    pairs = small_join(one, two, ["lang"], n_groups).where("s != t").join(sums, ["lang", "s", "t"], "left")
    value = F.when(F.col("terms") > 0, F.col("terms") * distance("bs", "bt") + F.coalesce("v", F.lit(0))).otherwise(F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", order).unionByName(said.select("*", order).where(F.col("rank") <= top))
