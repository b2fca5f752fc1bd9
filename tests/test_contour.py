"""Bands and contour lines of small grids."""

import math
import random
from collections import defaultdict

import pytest

from kspec.operators import contour


def grid(spark, rows):
    return spark.createDataFrame([(r, c, n) for r, line in enumerate(rows) for c, n in enumerate(line)], "r long, c long, n long")


def test_bands(spark):
    rng = random.Random(1)
    rows = [[rng.choice([0, 0, 3, 7, 12, 24]) for _ in range(30)] for _ in range(9)]
    low, high = min(map(min, rows)), max(map(max, rows))
    for bins in (6, 12):
        want = set()
        for r, line in enumerate(rows):
            each = [min((n - low) * bins // (high - low), bins - 1) for n in line]
            beg = 0
            for c in range(1, 31):
                if c == 30 or each[c] != each[beg]:
                    want.add((r, beg, c, each[beg]))
                    beg = c
        assert {tuple(x) for x in contour.bands(grid(spark, rows), "r", "c", bins).collect()} == want
    assert [tuple(x) for x in contour.bands(grid(spark, [[5, 5]]), "r", "c", 6).collect()] == [(0, 0, 2, 0)]
    assert contour.bands(grid(spark, []), "r", "c", 6).count() == 0


def lines_of(df):
    out = defaultdict(list)
    for p in df.orderBy("level", "line", "nth").collect():
        out[p.level, p.line].append((p.x, p.y))
    return out


def test_one_hill(spark):
    """A hill gives closed lines, one within the other; one at the edge gives open ones."""
    n = 21
    rows = [[max(0, 1000 - 10 * ((r - 10) ** 2 + (c - 10) ** 2)) for c in range(n)] for r in range(n)]
    got = lines_of(contour.lines(contour.segments(grid(spark, rows), "r", "c", 12)))
    assert sorted(level for level, _ in got) == list(range(1, 12))
    for (level, _), points in got.items():
        assert points[0] == points[-1] and len(points) > 4
        height = 1000 * level / 12
        radius = math.sqrt((1000 - height) / 10)
        assert all(abs(math.hypot(x - 10.5, y - 10.5) - radius) < 0.35 for x, y in points)
    half = lines_of(contour.lines(contour.segments(grid(spark, [line[10:] for line in rows]), "r", "c", 6)))
    assert all(p[0] != p[-1] and {p[0][0], p[-1][0]} == {0.5} for p in half.values()) and len(half) == 5


def test_pieces_follow_the_heights(spark):
    """Every piece's ends have the level's height, and each corner above it is on the other side of a piece from one below."""
    rng = random.Random(5)
    rows = [[rng.randint(0, 50) for _ in range(12)] for _ in range(11)]
    bins = 6
    low, high = min(map(min, rows)), max(map(max, rows))
    pieces = contour.segments(grid(spark, rows), "r", "c", bins).collect()
    crossed = defaultdict(int)
    for p in pieces:
        assert p.height == pytest.approx(low + (high - low) * p.level / bins)
        for edge, x, y in ((p.from_edge, p.x1, p.y1), (p.to_edge, p.x2, p.y2)):
            r, c = map(int, edge[1:].split(","))
            t = x - c - 0.5 if edge[0] == "h" else y - r - 0.5
            a, b = rows[r][c], rows[r][c + 1] if edge[0] == "h" else rows[r + 1][c]
            assert 0 <= t <= 1 and a + t * (b - a) == pytest.approx(p.height)
            crossed[p.level, edge] += 1
    for level in range(1, bins):
        h = low + (high - low) * level / bins
        for r in range(11):
            for c in range(12):
                for kind, on, outer in (("h", rows[r][c + 1] if c < 11 else None, r in (0, 10)), ("v", rows[r + 1][c] if r < 10 else None, c in (0, 11))):
                    if on is not None:
                        assert crossed[level, f"{kind}{r},{c}"] == ((rows[r][c] >= h) != (on >= h)) * (1 if outer else 2)
    joined = lines_of(contour.lines(contour.segments(grid(spark, rows), "r", "c", bins)))
    assert sum(len(p) - 1 for p in joined.values()) == len(pieces)
    assert contour.segments(grid(spark, [[3, 3], [3, 3]]), "r", "c", 6).count() == 0
