"""Phase blocks. Sites and pure blocks are windows; only the merge of a contig's few blocks runs in Python, a contig a group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profile import joined_runs, part_runs, runs

#: A block as long as this is an anchor, and so is one with this many marked bases for each base of k.
ANCHOR_LENGTH, ANCHOR_MARKS_PER_K = 20_000, 5


def hap_sites(prof: DataFrame, k: int) -> DataFrame:
    """seq_id, contig, beg, end, mrk, n, kept: chains of overlapping markers. mrk: maternal less paternal ones; maternal where both. Sites of mixed markers (|mrk| below a quarter) aren't kept.

    prof: seq_id, contig, pos, mat_cnt, pat_cnt."""
    return sites_of(prof, k, ("seq_id", "contig"))


def sites_of(prof: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """The same for any grouping. Contigs are k positions apart at least, so sites never reach over two, with or without contig among the columns."""
    sign = F.when(F.col("mat_cnt") > 0, 1).when(F.col("pat_cnt") > 0, -1)
    marks = prof.select(*by, "pos", sign.alias("sign")).where("sign is not null")
    return _weighed(runs(marks, k - 1, by, {"mrk": F.col("sign"), "n": F.lit(1)}), k, by)


def sites_in(sequences: DataFrame, marks: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """sites_of() of sequences by markers (kmer, mat, pat); only runs of marked positions are rows."""
    sums = {"mrk": lambda c: np.where(c["mat"] > 0, 1, -1), "n": lambda c: 1}
    parts = part_runs(sequences, marks, k, {"mat": "mat", "pat": "pat"}, k - 1, sums, lambda c: (c["mat"] > 0) | (c["pat"] > 0), by)
    return _weighed(joined_runs(parts, k - 1, by, tuple(sums)), k, by)


def _weighed(sites: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    return sites.select(*by, "beg", (F.col("last") + k).alias("end"), "mrk", "n", (F.abs("mrk") >= F.expr("(n + 3) div 4")).alias("kept"))


def pure_blocks(sites: DataFrame) -> DataFrame:
    """seq_id, contig, beg, end, mrk: neighbouring kept sites of one parent as one block. mrk is in bases: the span less the minority's markers, negative for the father."""
    minority = F.when(F.col("mrk") > 0, F.expr("(n - mrk) div 2")).otherwise(F.expr("(n + mrk) div 2"))
    weight = F.when(F.col("mrk") > 0, 1).otherwise(-1) * (F.col("end") - F.col("beg") - minority)
    kept = sites.where("kept").select("seq_id", "contig", "beg", "end", (F.col("mrk") > 0).alias("maternal"), weight.cast("long").alias("w"))
    order = Window.partitionBy("seq_id", "contig").orderBy("beg")
    turned = F.when(F.lag("maternal").over(order) != F.col("maternal"), 1).otherwise(0)
    run = kept.withColumn("t", turned).withColumn("run", F.sum("t").over(order))
    return run.groupBy("seq_id", "contig", "run").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.sum("w").cast("long").alias("mrk")).drop("run")


@dataclass
class Block:
    beg: int
    end: int
    mrk: int
    opp: int = 0

    def take(self, own: list[Block], other: list[Block]) -> None:
        self.mrk += sum(b.mrk for b in own)
        self.opp += sum(b.mrk for b in other)


def _best_split(between: list[Block], prefer_late: bool) -> int:
    """between: blocks of alternating sign, an even number. How many go left, by twos, so that the weight on the wrong side is least: the 1st, 3rd, ... are wrong on the left, the 2nd, 4th, ... on the right."""
    wrong = sum(abs(b.mrk) for b in between[1::2])
    best, at = wrong, 0
    for cut in range(2, len(between) + 1, 2):  # two more go left: one of them is wrong there, the other was wrong on the right
        wrong += abs(between[cut - 2].mrk) - abs(between[cut - 1].mrk)
        if wrong < best or prefer_late and wrong == best:
            best, at = wrong, cut
    return at


def merge_blocks(blocks: list[Block], anchor_length: int, anchor_marks: int) -> list[Block]:
    """Alternating pure blocks -> phase blocks.

    Anchors of one sign with no anchor of the other between them become one, with all between them. Then the small blocks between two anchors are dealt to both, and those before the first and after the
    last anchor to it and to a block of their own. On equal costs the left side gets the fewer, unless the left anchor weighs more."""
    groups: list[Block] = []
    loose: list[list[Block]] = [[]]
    for b in blocks:
        if b.end - b.beg < anchor_length and abs(b.mrk) < anchor_marks:
            loose[-1].append(b)
        elif groups and (groups[-1].mrk < 0) == (b.mrk < 0):
            last = groups[-1]
            last.take([*loose[-1][1::2], b], loose[-1][::2])
            last.end, loose[-1] = b.end, []
        else:
            groups.append(Block(b.beg, b.end, b.mrk, b.opp))
            loose.append([])
    out: list[Block] = []
    for n in range(len(groups) + 1):
        right = groups[n] if n < len(groups) else None
        left = groups[n - 1] if n else None
        small = list(loose[n])
        if len(small) % 2:  # only at the ends: an empty block keeps the turns
            edge = small[-1].end if right is None else small[0].beg
            empty = Block(edge, edge, 0)
            small = [*small, empty] if right is None else [empty, *small]
        cut = _best_split(small, left is not None and abs(left.mrk) > (abs(right.mrk) if right else 0))
        head, tail = small[:cut], small[cut:]
        if left is not None:
            left.take(head[1::2], head[::2])
            if head:
                left.end = head[-1].end
        elif head:
            first = Block(blocks[0].beg, head[-1].end, 0)
            first.take(head[1::2], head[::2])
            out.append(first)
        if right is None:
            right = Block(tail[0].beg, tail[-1].end, 0) if tail else None
            if right is not None:
                right.take(tail[::2], tail[1::2])
                if right.mrk:
                    out.append(right)
        else:
            right.take(tail[::2], tail[1::2])
            if tail:
                right.beg = tail[0].beg
            out.append(right)
    return out


def phase_blocks(pure: DataFrame, contig_table: DataFrame, k: int, anchor_length: int = ANCHOR_LENGTH) -> DataFrame:
    """seq_id, contig, block, beg, end, phase, switch_pct, switches, markers, mat, pat, size. The outer blocks reach to the contig's ends.

    contig_table: seq_id, contig, beg, size. Contigs without a pure block have no row."""
    ends = contig_table.select("seq_id", "contig", F.col("beg").alias("c_beg"), (F.col("beg") + F.col("size")).alias("c_end"))
    joined = pure.join(ends, ["seq_id", "contig"])
    schema = "seq_id long, contig long, block long, beg long, end long, phase string, switch_pct double, switches long, markers long, mat long, pat long, size long"

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("beg")
        blocks = merge_blocks([Block(int(b), int(e), int(m)) for b, e, m in zip(pdf["beg"], pdf["end"], pdf["mrk"], strict=True)], anchor_length, ANCHOR_MARKS_PER_K * k)
        rows = []
        for n, b in enumerate(blocks):
            beg = int(pdf["c_beg"].iloc[0]) if n == 0 else b.beg
            end = int(pdf["c_end"].iloc[0]) if n == len(blocks) - 1 else b.end
            switches, own = abs(b.opp), abs(b.mrk)
            mat, pat = (own, switches) if b.mrk > 0 else (switches, own)
            rows.append((pdf["seq_id"].iloc[0], pdf["contig"].iloc[0], n, beg, end, "mat" if b.mrk > 0 else "pat", 100.0 * switches / (switches + own), switches, switches + own, mat, pat, end - beg))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return joined.groupBy("seq_id", "contig").applyInPandas(merged, schema)


def phase_totals(blocks: DataFrame) -> DataFrame:
    """n, switch_pct, switches, markers over all blocks; no row if there are none."""
    sums = blocks.agg(F.count("*").alias("n"), F.sum("switches").alias("switches"), F.sum("markers").alias("markers")).where("n > 0")
    return sums.select("n", (100.0 * F.col("switches") / F.col("markers")).alias("switch_pct"), "switches", "markers")


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with `number`, from 0 through all sequences and contigs. Blocks are counted a sequence first, so only one sequence's are put in order together."""
    counts = blocks.groupBy("seq_id").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("seq_id").orderBy("contig", "block")) - 1
    return blocks.join(counts.select("seq_id", before.alias("before")), "seq_id").withColumn("number", (F.col("before") + nth).cast("long")).drop("before")


def block_blob(blocks: DataFrame) -> DataFrame:
    """block (its parent), range (its number), mat, pat, size: a point for each block."""
    return numbered(blocks).select(F.col("phase").alias("block"), F.col("number").alias("range"), "mat", "pat", "size")
