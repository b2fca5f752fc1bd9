"""Level bands and contour lines of a matrix's smoothed cells. A grid has as many cells as its limits say, whatever its tables are."""

from __future__ import annotations

from collections import defaultdict
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:
    import pandas as pd


def _range(grid: DataFrame) -> DataFrame:
    """One row, low and high."""
    return grid.agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low is not null")


def bands(grid: DataFrame, row: str, col: str, bins: int) -> DataFrame:
    """row, beg, end (half open), band: neighbouring cells of a row that lie in one of `bins` bands of equal height between the least and the greatest cell; the greatest is in the last band, and all of a level grid in
    the first."""
    height = F.greatest(F.col("high") - F.col("low"), F.lit(1))
    band = F.least((F.col("n") - F.col("low")) * bins / height, F.lit(bins - 1)).cast("int")
    cells = grid.crossJoin(F.broadcast(_range(grid))).select(row, col, band.alias("band"))
    order = Window.partitionBy(row).orderBy(col)
    begun = cells.withColumn("new", F.when(F.lag("band").over(order) == F.col("band"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return begun.groupBy(row, "run", "band").agg(F.min(col).alias("beg"), (F.max(col) + 1).alias("end")).select(row, "beg", "end", "band")


def segments(grid: DataFrame, row: str, col: str, bins: int) -> DataFrame:
    """level (1 to bins - 1), height, and from_edge, x1, y1, to_edge, x2, y2 of the pieces of the lines on which the grid, straight between the centres of neighbouring cells, has a band's lower height.

    An edge is named by the cell at its beginning, and `h` along a row or `v` along a column, so that pieces of neighbouring squares meet in one. Where a square's corners are high and low in turns, the mean of the
    four says which of them belong together."""
    along, across = Window.partitionBy(row).orderBy(col), Window.partitionBy(col).orderBy(row)
    square = grid.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col("n").cast("double").alias("a"), F.lead("n").over(along).cast("double").alias("b"))
    across = Window.partitionBy("c").orderBy("r")
    square = square.select("*", F.lead("a").over(across).alias("d"), F.lead("b").over(across).alias("e")).where("b is not null and d is not null and e is not null")
    square = square.crossJoin(F.broadcast(_range(grid))).where("high > low")
    step = (F.col("high") - F.col("low")) / bins
    low, high = F.least("a", "b", "d", "e"), F.greatest("a", "b", "d", "e")
    # the levels above the lowest corner and not above the highest
    first, last = F.greatest(F.floor((low - F.col("low")) / step) + 1, F.lit(1)), F.least(F.floor((high - F.col("low")) / step), F.lit(bins - 1))
    each = square.where(first <= last).select("*", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("level"))
    each = each.withColumn("height", F.col("low") + F.col("level") * step)

    def met(name: str, p: str, q: str, r: F.Column, c: F.Column) -> F.Column:
        """Where the edge from corner p to q crosses the height; null if it doesn't."""
        t = (F.col("height") - F.col(p)) / (F.col(q) - F.col(p))
        edge = F.concat(F.lit(name), r.cast("string"), F.lit(","), c.cast("string"))
        x, y = c + 0.5 + (t if name == "h" else 0), r + 0.5 + (t if name == "v" else 0)
        return F.when((F.col(p) >= F.col("height")) != (F.col(q) >= F.col("height")), F.struct(edge.alias("edge"), x.cast("double").alias("x"), y.cast("double").alias("y")))

    r, c = F.col("r"), F.col("c")
    edges = each.select("level", "height", "a", "b", "d", "e", met("h", "a", "b", r, c).alias("top"), met("v", "b", "e", r, c + 1).alias("right"), met("h", "d", "e", r + 1, c).alias("bottom"), met("v", "a", "d", r, c).alias("left"))
    all_met = F.col("top").isNotNull() & F.col("right").isNotNull() & F.col("bottom").isNotNull() & F.col("left").isNotNull()
    inside = (F.col("a") + F.col("b") + F.col("d") + F.col("e")) / 4 >= F.col("height")
    pair = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    around = F.when(inside == (F.col("a") >= F.col("height")), F.array(pair("top", "right"), pair("bottom", "left"))).otherwise(F.array(pair("left", "top"), pair("right", "bottom")))
    crossed = F.filter(F.array("top", "right", "bottom", "left"), lambda x: x.isNotNull())
    pieces = F.when(all_met, around).when(F.size(crossed) == 2, F.array(F.struct(crossed[0].alias("p"), crossed[1].alias("q"))))
    out = edges.select("level", "height", F.explode(pieces).alias("s"))
    return out.select("level", "height", F.col("s.p.edge").alias("from_edge"), F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.edge").alias("to_edge"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def lines(found: DataFrame) -> DataFrame:
    """level, height, line (from 0 in each level), nth, x, y: the pieces of segments() joined to lines; a closed line ends at its first point. A level is a group, of no more pieces than the grid has cells, twice."""

    def joined(pieces: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        at, next_to = {}, defaultdict(list)
        for p in pieces.itertuples():
            at[p.from_edge], at[p.to_edge] = (p.x1, p.y1), (p.x2, p.y2)
            next_to[p.from_edge].append(p.to_edge)
            next_to[p.to_edge].append(p.from_edge)
        rows, line, seen = [], 0, set()
        # open lines first, from their ends; what is left is closed
        for start in [*sorted(e for e, n in next_to.items() if len(n) == 1), *sorted(next_to)]:
            if start in seen:
                continue
            path, here = [start], start
            seen.add(start)
            while (on := next((e for e in next_to[here] if e not in seen), None)) is not None:
                path.append(on)
                seen.add(on)
                here = on
            if len(path) > 2 and start in next_to[here]:
                path.append(start)
            rows += [(int(pieces["level"].iloc[0]), float(pieces["height"].iloc[0]), line, i, *at[e]) for i, e in enumerate(path)]
            line += 1
        return pd.DataFrame(rows, columns=["level", "height", "line", "nth", "x", "y"])

    return found.groupBy("level").applyInPandas(joined, "level int, height double, line int, nth int, x double, y double")
