"""Peaks and smoothed matrices of k-mers with counts above 60."""

import random

from kspec.plans.catalog import K, Q

COPIES = 70


def test_peak_above_60(spark, tmp_path):
    rng = random.Random(7)
    text = "".join(rng.choices("acgt", k=400)).translate(str.maketrans("acgt", "abcd"))
    rows = [(8 * i + r, text) for i in range(COPIES) for r in (0, 4)]  # r 0: asm1, 4: asm2; both of the child
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    height = 400 - K + 1
    assert {tuple(r) for r in Q["matrix_peaks"](spark, str(tmp_path)).select("axis", "pos", "height").collect()} == {("cnt1", COPIES, height), ("cnt2", COPIES, height)}
    cells = {(r.cnt1, r.cnt2): r.n for r in Q["joint_matrix_smoothed"](spark, str(tmp_path)).where("n > 0").collect()}
    assert cells == {(COPIES - a, COPIES - b): height // 4 for a in (0, 1) for b in (0, 1)}
    by_count = {r.cnt for r in Q["gc_matrix_smoothed"](spark, str(tmp_path)).where("n > 0").collect()}
    assert by_count == {2 * COPIES - 1, 2 * COPIES}
