"""Programs over counted tables: counts are made once, and what a report keeps is plotted again."""

import random

import pytest
from pyspark.sql import functions as F

from kspec import cli
from kspec.functions.kmer import unpack
from kspec.plans import report


def write(path, seqs):
    path.write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(seqs)))
    return str(path)


@pytest.fixture(scope="module")
def trio(tmp_path_factory):
    rng = random.Random(31)
    folder = tmp_path_factory.mktemp("trio")
    mat, pat = ("".join(rng.choices("acgt", k=1500)) for _ in range(2))
    cut = lambda *seqs: [s[i : i + 200] for s in seqs for i in range(0, len(s) - 199, 20)]
    files = {n: write(folder / f"{n}.fa", s) for n, s in (("mat", cut(mat)), ("pat", cut(pat)), ("reads", cut(mat, pat)), ("asm", [mat[:700] + pat[700:1400]]))}
    return folder, files


def rows(df):
    return sorted(map(str, df.collect()))


def test_tables_in_place_of_sequences(spark, trio):
    folder, files = trio
    for name in ("mat", "pat", "reads"):
        made = cli.run(spark, ["count", "-K11", files[name], str(folder / name)])
        assert made["hist"].agg(F.sum("n_unique")).first()[0] == made["table"].count()
    t = {n: str(folder / f"{n}.ktab") for n in ("mat", "pat", "reads")}
    for argv in (["hapmers", "mat", "pat", "reads"], ["cn", "-l", "reads", "asm"], ["joint", "mat", "pat"], ["blob", "mat", "pat", "asm"]):
        program, names = argv[0], [a for a in argv[1:] if a in files]
        flags = [a for a in argv[1:] if a.startswith("-")]
        tables = [t.get(n, files[n]) for n in names]
        if program == "blob":  # its tables are of markers
            tables = [str(folder / "out-hapmers-ktab" / f"{n}.ktab") for n in ("mat", "pat")] + [files["asm"]]
        try:
            plain = cli.run(spark, [program, "-K11", *flags, *[files[n] for n in names], str(folder / f"out-{program}-fa")])
        except ValueError as e:
            assert program == "joint" and "peak" in str(e)
            continue
        counted = cli.run(spark, [program, *flags, *tables, str(folder / f"out-{program}-ktab")])
        assert set(plain) == set(counted)
        for name in plain:
            if program != "blob":
                assert rows(plain[name]) == rows(counted[name]), (program, name)
        if program == "blob":
            [one] = counted["blob"].collect()
            assert one.mat > 300 and one.pat > 300 and one.Size == 1400 - 10
    for bad in (["cn", "-K12", t["reads"], files["asm"], "o"], ["report", t["reads"], t["mat"], "o"], ["count", t["mat"], "o"], ["blob", t["mat"], files["pat"], files["asm"], "o"], ["cn", str(folder / "none.ktab"), files["asm"], "o"]):
        with pytest.raises(ValueError):
            cli.run(spark, bad)


def test_report_counts_once_and_keeps(spark, trio, monkeypatch):
    folder, files = trio
    calls = []
    original = report.joint_counts
    monkeypatch.setattr(report, "joint_counts", lambda *a: calls.append(a) or original(*a))
    out = str(folder / "kept-report")
    cli.run(spark, ["report", "-K11", "-kz", files["reads"], files["mat"], files["pat"], files["asm"], out])
    assert len(calls) == 2  # the trio, and reads with the assembly
    plans = spark.read.parquet(f"{out}/work/counts")
    assert plans.columns == ["kmer", "reads", "asm1"] and plans.select(unpack(F.col("kmer"), 11)).count() > 1000
    for program, where, file in (("cn", "asm.spectrum", "asm.spectrum-plot"), ("asm", "assembly.spectrum", "assembly.spectrum-plot")):
        again = cli.run(spark, [program, f"{out}/{where}"])
        written = spark.read.csv(f"{out}/{file}", sep="\t", header=True)
        assert rows(again["plot"].select([F.col(c).cast("string") for c in again["plot"].columns])) == rows(written)
    assert cli.run(spark, ["blob", f"{out}/hapmers"])["blob"].count() == 1


def test_a_report_reads_its_counts(spark, trio):
    """No table of a report counts k-mers by itself: every plan reads what has been written."""
    folder, files = trio
    tables = cli.run(spark, ["report", "-K11", "-l", files["reads"], files["asm"], str(folder / "plans")])
    for name, df in tables.items():
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString(), name
