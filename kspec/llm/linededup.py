"""Line dedup by a deletion-neighbourhood join.

Two lines are alike if, in lower case and with white space folded, they are equal or - from `edits_from` characters on - one edit apart: one
character inserted, deleted or replaced. An occurrence of a line goes if an earlier one is alike; so the earliest stays. Occurrences are in the order of doc_id
(null last), a hash of the text, line number.

Distinct lines are found first, with their earliest occurrence. Each emits the hashes of all its variants with one character deleted. Lines of which one is a variant of
the other share the variant's key; lines that differ by a replacement share a variant at the same place, so (variant, place) is their key. In either case all
lines under a key are within the bound of the one it stands for, so the least occurrence under a key is enough: no pairs are built, however many lines share a key. The
edit distance of each line and the earlier one found for it is then verified on their texts.

Variants are emitted only for lines that can have a partner. If two lines are one edit apart and one of them is cut into S segments, the edit lies in one of these, and
what stands before it and after it is equal. So a line whose rest without a segment no other line has, for any segment, is set aside; that loses no pair. All lines are
tried with two segments and those left with SEGMENTS; of these, variants are emitted without a character of a segment for which there was another line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, discard, fresh, row_key, text_of, written

#: Characters from which on a line may differ by one edit; shorter ones are alike if equal.
EDITS_FROM = 16
#: Segments of the second trial.
SEGMENTS = 16
#: Two primes below 2**31 and bases for them: a key has about 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D\xA0]+", " ")))


_KEPT = [np.ones(1, dtype=np.uint64) for _ in PRIMES]


def _powers(n: int, k: int) -> np.ndarray:
    """BASES[k]**i modulo PRIMES[k], for i below n; those of the longest line so far are kept."""
    p, out = np.uint64(PRIMES[k]), _KEPT[k]
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(BASES[k], len(out), PRIMES[k])) % p))
    _KEPT[k] = out
    return out[:n]


def variant_keys(line: str) -> tuple[int, np.ndarray]:
    """The key of the line and those of its variants without the i-th character, each the key that the variant itself would have as a line. Sums of powers: linear in the line."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    own, keys = n, np.full(n, n - 1, dtype=np.uint64)
    for k, prime in enumerate(PRIMES):
        p = np.uint64(prime)
        power = _powers(n + 1, k)
        # Characters count from the line's beginning; what follows a deleted one moves up by one place.
        down = np.cumsum(c * power[:n] % p)
        up = np.cumsum(np.concatenate(([0], c[1:] * power[: n - 1] % p)).astype(np.uint64))
        total = int(down[-1]) % prime
        before = np.concatenate(([0], down[:-1])).astype(np.uint64)
        each = (before + (up[-1] - up)) % p
        own = own * (1 << 31) + total
        keys = keys * np.uint64(1 << 31) + each
    return own & (2**63 - 1), keys & np.uint64(2**63 - 1)


def _split(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    row_id, row_text = row_key(docs, doc_id, text)
    return docs.select(row_id.alias("doc_id"), row_text.alias("t"), F.posexplode(F.split(text_of(text), "\n")).alias("line_no", "raw"))


def _named(split: DataFrame) -> DataFrame:
    """split with the normal line and two hashes of it, 128 bits together; without blank lines."""
    filled = split.where(F.btrim("raw", F.lit(SPACES + "\xa0")) != "")  # cheaper than the normal line, which would be made twice
    return filled.withColumn("line", normal(F.col("raw"))).drop("raw").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _halves() -> Column:
    """Keys of which an equal one is shared by any two lines one edit apart: the beginning or the end, cut at the middle of the greater length n, which a line takes to be its own or one more.

    Of an even length the middle stays where it is in the line one longer, of an odd one the end does; so three keys are enough."""
    n = F.length("line")
    low, high = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")

    def before(middle: Column) -> Column:
        return F.xxhash64(F.lit("before"), F.substring("line", F.lit(1), middle))

    def after(size: Column) -> Column:
        return F.xxhash64(F.lit("after"), F.substring("line", n - size + 1, size))

    return F.when(n % 2 == 0, F.array(before(low), after(n - low), after(n + 1 - low))).otherwise(F.array(before(low), before(high), after(n + 1 - high)))


def _segments() -> Column:
    """The same for SEGMENTS parts: for each the hash of what stands before and after it."""
    n = F.length("line")

    def key(p: Column) -> Column:
        whole, s = n + F.floor(p / SEGMENTS).cast("int"), p % SEGMENTS
        begin, rest = F.floor(whole * s / SEGMENTS).cast("int"), (whole - F.floor(whole * (s + 1) / SEGMENTS)).cast("int")
        return F.xxhash64(s, whole, F.substring("line", F.lit(1), begin), F.substring("line", n - rest + 1, rest))

    # a key names its segment and the greater length; the first SEGMENTS of them take the line to be the longer one
    return F.transform(F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 1)), key)


def _meeting(keyed: DataFrame, name: str) -> DataFrame:
    """(h1, at) of the rows (h1, keys) of which a key is also another line's, and which ones are. A key's least and greatest line tell whether it has several, so no group of lines meets."""
    each = keyed.select("h1", F.posexplode("keys").alias("pos", "key"))
    shared = each.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
    shared = written(shared, f"{name}-shared")
    few = shared.count() <= BROADCAST_ROWS
    meeting = each.join(F.broadcast(shared) if few else shared, "key", "left_semi").groupBy("h1").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    meeting = written(meeting, name)
    discard(shared)
    return meeting


LAST = 2**63 - 1


def _removed(docs: DataFrame, edits_from: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, t, line_no of each line occurrence that goes, and keep: the place (d, t, l) of the earliest one that is alike."""
    split = _split(docs, doc_id, text)
    long_enough = F.length("line") >= edits_from - 1
    # narrow: texts are normalised once
    lines = written(_named(split).select("doc_id", "t", "line_no", "h1", "h2", F.when(long_enough, _halves()).otherwise(F.array().cast("array<bigint>")).alias("keys")), "lines-all")
    at = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("t"), F.col("line_no").alias("l"))
    distinct = written(lines.select("h1", "h2", at.alias("at")).groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")), "lines-distinct")

    possible = _meeting(lines.select("h1", "keys"), "lines-possible")
    few = possible.count() <= BROADCAST_ROWS
    wanted = distinct.join(F.broadcast(possible) if few else possible, "h1", "left_semi")
    wanted = written(wanted.select(F.col("first.d").alias("d"), F.col("first.t").alias("wt"), F.col("first.l").alias("l"), F.col("h1").alias("p1"), F.col("h2").alias("p2")), "lines-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    # written before they are normalised: else the hashes would be taken of all lines, as keys of this join
    here = (F.coalesce("doc_id", F.lit(LAST)) == F.col("d")) & (F.col("t") == F.col("wt")) & (F.col("line_no") == F.col("l"))
    placed = written(split.join(F.broadcast(wanted) if few else wanted, here), "lines-placed")
    spelled = _named(placed).where("h1 = p1 and h2 = p2").select("h1", "h2", "d", "t", "l", "line").dropDuplicates(["h1", "h2"])
    spelled = written(spelled, "lines-text")
    discard(possible, wanted, placed)

    near = _meeting(spelled.select("h1", _segments().alias("keys")), "lines-near")
    few = near.count() <= BROADCAST_ROWS
    closer = written(spelled.join(F.broadcast(near) if few else near, "h1"), "lines-near-text")
    discard(near, spelled)
    found = _earlier(closer, edits_from)
    discard(closer)
    marked = distinct.join(found, ["h1", "h2"], "left").select("h1", "h2", "n", F.coalesce(F.least("first", "earlier"), F.col("first")).alias("keep"), F.col("earlier").isNotNull().alias("alike"))
    marked = marked.where("n > 1 or alike").select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), "keep")
    placed = lines.select("doc_id", "t", "line_no", "h1", "h2", at.alias("at"))
    return placed.join(marked, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2"))).where("at > keep").select("doc_id", "t", "line_no", "keep")


def removed_lines(docs: DataFrame, *, edits_from: int = EDITS_FROM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, kept_doc_id, kept_line_no of each line occurrence that goes and the earliest one that is alike.

    Rows are told apart by id and text: those without an id, or with another's, are documents of their own, and only rows equal in both count as one. Null ids come last. Blank lines
    never go; null and empty texts have none. An empty table gives no row. Other columns are not read. edits_from: least length for an edit; 0 allows one in any line."""
    gone = _removed(docs, edits_from, doc_id, text)
    kept_id = F.when(F.col("keep.d") == LAST, F.lit(None).cast("long")).otherwise(F.col("keep.d"))
    return gone.select("doc_id", "line_no", kept_id.alias("kept_doc_id"), F.col("keep.l").alias("kept_line_no"))


def _earlier(spelled: DataFrame, edits_from: int) -> DataFrame:
    """(h1, h2, earlier): for lines (h1, h2, d, t, l, line) that have an earlier one within one edit, the earliest such. at: the line's keys of _segments() that another line has; the character to delete is in one of their segments."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int]] = []
            size = 0
            for k, (line, shared) in enumerate(zip(batch["line"], batch["at"], strict=True)):
                own, keys = variant_keys(line)
                n = len(keys)
                # role 0: the line itself, 1: a shorter line that it becomes, 2: a replacement at this place
                if n < edits_from - 1:
                    continue
                here = np.zeros(n, dtype=bool)
                for s in shared[shared < SEGMENTS].tolist():  # the others are those of a line that is one shorter
                    here[n * s // SEGMENTS : n * (s + 1) // SEGMENTS] = n >= edits_from
                where = np.flatnonzero(here)
                # deleting any of equal characters side by side gives the same shorter line once
                once = where[np.concatenate(([True], (keys[where[1:]] != keys[where[:-1]]) | (np.diff(where) > 1)))[: len(where)]]
                places = np.concatenate(([-1], np.full(len(once), -1), where))
                every = np.concatenate(([own], keys[once].view(np.int64), keys[where].view(np.int64)))
                roles = np.concatenate(([0], np.ones(len(once), dtype=np.int64), np.full(len(where), 2)))
                out.append((np.full(len(places), k), every, places, roles))
                size += len(out[-1][0])
                if size > 100_000:
                    yield _emitted(batch, out)
                    out, size = [], 0
            if out:
                yield _emitted(batch, out)

    keyed = written(spelled.mapInPandas(emit, "h1 long, h2 long, d long, t long, l int, key long, place int, role int"), "lines-variants")
    me = F.struct("d", "t", "l", "h1", "h2")
    # Under (key, -1) stand the line with this key, if any, and the longer lines that become it; under (key, place) lines that differ there only. Least ones are found before rows meet.
    least = keyed.groupBy("key", "place").agg(F.count("*").alias("c"), F.min(F.when(F.col("role") == 0, me)).alias("short"), F.min(F.when(F.col("role") != 0, me)).alias("other")).where("c > 1")
    # A longer line looks to the shorter one only; two longer lines under it may be two edits apart.
    partner = F.when(F.col("role") == 1, F.col("short")).otherwise(F.col("other"))
    pairs = keyed.join(least, ["key", "place"]).select("h1", "h2", me.alias("me"), partner.alias("p")).where("p < me")
    pairs = pairs.select("h1", "h2", F.col("p.d").alias("d"), F.col("p.t").alias("t"), F.col("p.l").alias("l"), F.col("p.h1").alias("p1"), F.col("p.h2").alias("p2")).distinct()
    own = spelled.select("h1", "h2", "line")
    theirs = spelled.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("other"))
    verified = pairs.join(own, ["h1", "h2"]).join(theirs, ["p1", "p2"]).where(F.levenshtein("line", "other", 1).between(0, 1))
    found = written(verified.groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "l")).alias("earlier")), "lines-alike")
    discard(keyed)
    return found


def _emitted(batch: pd.DataFrame, out: list[tuple]) -> pd.DataFrame:
    k = np.concatenate([x[0] for x in out])
    rows = {c: batch[c].to_numpy()[k] for c in ("h1", "h2", "d", "t", "l")}
    return pd.DataFrame(rows | {"key": np.concatenate([x[1] for x in out]), "place": np.concatenate([x[2] for x in out]).astype(np.int32), "role": np.concatenate([x[3] for x in out]).astype(np.int32)})


def dedup_lines(docs: DataFrame, *, edits_from: int = EDITS_FROM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines that go taken out of their texts, n_chars (where docs has it) counted anew for texts that changed; every row stays, also one that has no line left.

    Rows are told apart as removed_lines says. Blank lines never go. A null text stays null. Columns are those of docs, whatever their names. Texts are shuffled once, by id
    and hash; what goes from each is the hashed side of that join, a few numbers a text."""
    taken: list[str] = list(docs.columns)

    def name(n: str) -> str:
        taken.append(fresh(taken, n))
        return taken[-1]

    gone_id, gone_text, gone_lines, cleaned = map(name, ("gone_id", "gone_text", "gone_lines", "cleaned"))
    gone = _removed(docs, edits_from, doc_id, text)
    per_doc = written(gone.groupBy(F.col("doc_id").alias(gone_id), F.col("t").alias(gone_text)).agg(F.collect_set("line_no").alias(gone_lines)), "lines-gone")
    row_id, row_text = row_key(docs, doc_id, text)
    joined = docs.join(per_doc.hint("shuffle_hash"), row_id.eqNullSafe(F.col(gone_id)) & (row_text == F.col(gone_text)), "left")
    own = F.col(f"`{text}`")
    lines = F.split(own, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_lines))
    same = F.col(gone_lines).isNull() | own.isNull()
    joined = joined.withColumn(cleaned, F.when(same, own).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")))

    def column(c: str) -> Column:
        if c == text:
            return F.col(cleaned).alias(c)
        if c == "n_chars":
            return F.when(same, F.col(c)).otherwise(F.length(cleaned)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return joined.select(*map(column, docs.columns))
