"""Count expressions: k-mers and counts in terms of tables A, B, C, ..., as columns over their joint counts, so any number of them is one pass.

  A - B      those of A that B lacks, with A's counts
  A &. B     those of both, with the left side's counts; A &+ B with the counts' sum
  A |. B     those of either, with the left side's counts where it has them; A |+ B with the counts' sum
  A[n] A[n-] A[n-m] A[-m]   those with a count of n, of n or more, from n to m, of m at most
  #(A | B)   whether it is there, for a side whose counts aren't used: within it & and | need no . or +; its count is 1

Brackets bind closest, then &, then | and -, these from left to right; parentheses group."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Value = tuple[Column, Column]  # whether it is there, and how often

_TOKEN = re.compile(r"\s*(?:(?P<range>\[\s*(?P<low>\d*)\s*(?P<dash>-?)\s*(?P<high>\d*)\s*\])|(?P<op>[&|][.+]?|[-#()])|(?P<table>[A-Z]))")


def _tokens(text: str) -> list[re.Match]:
    found, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"{text!r} can't be read from {text[at:]!r} on")
        found.append(m)
        at = m.end()
    return found


def compiled(text: str, tables: list[str]) -> Value:
    """The expression over columns of counts (0: not in the table), tables[0] for A and so on; ValueError for what can't be read or isn't there."""
    rest = _tokens(text)

    def take(*ops: str) -> str | None:
        return rest.pop(0)["op"] if rest and rest[0]["op"] in ops else None

    def counts(op: str, a: Value, b: Value, bare: bool) -> Column:
        if op[1:] == "+":
            return F.when(a[0], a[1]).otherwise(0) + F.when(b[0], b[1]).otherwise(0)
        if op[1:] == "." or bare:
            return F.when(a[0], a[1]).otherwise(b[1])
        raise ValueError(f"{text!r}: {op} has to say whose counts it takes, by . or +")

    def either(bare: bool) -> Value:
        value = both(bare)
        while op := take("|", "|.", "|+", "-"):
            other = both(bare)
            value = (value[0] & ~other[0], value[1]) if op == "-" else (value[0] | other[0], counts(op, value, other, bare))
        return value

    def both(bare: bool) -> Value:
        value = one(bare)
        while op := take("&", "&.", "&+"):
            other = one(bare)
            value = value[0] & other[0], counts(op, value, other, bare)
        return value

    def one(bare: bool) -> Value:
        if take("#"):
            there, _ = one(True)
            return there, F.lit(1).cast("long")
        if take("("):
            value = either(bare)
            if not take(")"):
                raise ValueError(f"{text!r} lacks a )")
        elif rest and (letter := rest[0]["table"]):
            rest.pop(0)
            if ord(letter) - 65 >= len(tables):
                raise ValueError(f"{text!r}: there is no table {letter}, only {len(tables)}")
            column = F.col(tables[ord(letter) - 65]).cast("long")
            value = column > 0, column
        else:
            raise ValueError(f"{text!r} lacks a table" + (f" before {rest[0][0].strip()!r}" if rest else " at its end"))
        while rest and rest[0]["range"]:
            m = rest.pop(0)
            low, high = m["low"], m["high"]
            if not low and not high:
                raise ValueError(f"{text!r}: {m[0].strip()} names no count")
            there = value[0]
            if low:
                there &= value[1] >= int(low) if m["dash"] else value[1] == int(low)
            if high:
                there &= value[1] <= int(high)
            value = there, value[1]
        return value

    value = either(False)
    if rest:
        raise ValueError(f"{text!r} goes on after its end with {rest[0][0].strip()!r}")
    return value


def _counts(outputs: dict[str, str], tables: list[str]) -> dict[str, Column]:
    """Each output's count, 0 where it lacks the k-mer."""
    each = {name: compiled(text, tables) for name, text in outputs.items()}
    return {name: F.when(there, count).otherwise(0).cast("long") for name, (there, count) in each.items()}


def evaluate(counts: DataFrame, outputs: dict[str, str], tables: list[str]) -> DataFrame:
    """kmer and a count for each output (name: expression), of the k-mers that any output has."""
    columns = _counts(outputs, tables)
    some = reduce(lambda a, b: a | b, [F.col(f"`{n}`") > 0 for n in columns])
    return counts.select("kmer", *[c.alias(n) for n, c in columns.items()]).where(some)


def histograms(counts: DataFrame, outputs: dict[str, str], tables: list[str], cap: int) -> DataFrame:
    """output, multiplicity, n_unique, n_instances of each output, counts from cap on in the bin cap; one pass, summed before the shuffle, which has a row for each output's bin."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("output"), c.alias("cnt")) for n, c in _counts(outputs, tables).items()])).alias("r")
    each = counts.select(rows).select("r.output", "r.cnt").where("cnt > 0")
    return each.groupBy("output", F.least("cnt", F.lit(cap)).cast("long").alias("multiplicity")).agg(F.count("*").alias("n_unique"), F.sum("cnt").alias("n_instances"))


#: The expressions of the copy-number and the assembly spectra, of their zero lines, and of markers and completeness with cutoffs in brackets.
COPY_NUMBER = {"0": "B-A", "1": "B&.A[1]", "2": "B&.A[2]", "3": "B&.A[3]", "4": "B&.A[4]", "5": "B&.A[5-]", "6": "A-B"}
ONE_ASSEMBLY = {"0": "B-A", "1": "B&.A", "2": "A-B"}
TWO_ASSEMBLIES = {"0": "C-#(A|B)", "1": "C&.(A-B)", "2": "C&.(B-A)", "3": "C&.#(A&B)", "4": "(A&+B)-C", "5": "(A-B)-C", "6": "(B-A)-C"}
SPECIFIC = {"mat": "A-B", "pat": "B-A"}
EITHER = {"both": "A|+B"}


def inherited(mat_cutoff: int, pat_cutoff: int) -> dict[str, str]:
    """Over specific k-mers of both parents and the child."""
    return {"mat": f"C&.A[{mat_cutoff}-]", "pat": f"C&.B[{pat_cutoff}-]"}


def solid(cutoff: int) -> dict[str, str]:
    """Over two assemblies and the reads: k-mers of each, and of either, that are frequent in the reads."""
    return {"0": f"A&.C[{cutoff}-]", "1": f"B&.C[{cutoff}-]", "2": f"(A|+B)&.C[{cutoff}-]"}
