"""How many points lie within reach of each probe, and which come first and last, without making a pair.

Probes are intervals, points are instants, both under the same keys.  Time is
cut into cells; a probe leaves one mark where its interval ends in each cell it
touches and one where it starts.  Points and marks of a (key, cell) are sorted
once and counted as they pass, so the work is that of a sort, however many
points lie in however many intervals.  What a probe saw in its cells adds up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.times import whole_division

#: A task sorts the rows of one key in this many seconds; a key is spread over its cells.
CELL_SECONDS = 120

_START, _POINT, _END = 0, 1, 2


def within_reach(probes: DataFrame, points: DataFrame | None, by: list[str], cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """``probe, told, n, first_us, first, last_us`` of every probe that reaches a point.

    ``probes`` has ``*by, probe, told, low, high`` (microseconds, both ends
    belong to the interval), ``points`` has ``*by, us, n, told``; ``n`` counts
    what happened at that instant.  ``told`` is carried along: ``first`` is that
    of the first point, the smallest of those of one instant.  Rows of one
    ``probe`` add up, under several keys too.  Rows with a null key or time reach
    nothing.  A probe is copied once for each cell that it touches, without
    what it tells: intervals should not be much longer than a few cells.
    """
    width = cell_seconds * 1_000_000

    def mark(us: Column | str, rank: int, sign: int, bound: str, **told: Column) -> Column:
        return F.struct(
            F.col(us).alias("us") if isinstance(us, str) else us.alias("us"), F.lit(rank).alias("rank"),
            F.lit(sign).cast("bigint").alias("sign"), F.col(bound).alias("bound"), told.get("own", nothing).alias("own"),
            told.get("n", F.lit(0).cast("bigint")).alias("n"), told.get("tells", none_told).alias("tells"))

    nothing = F.lit(None).cast(probes.schema["told"].dataType)
    none_told = F.lit(None).cast((probes if points is None else points).schema["told"].dataType)
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    start, last_cell = whole_division(F.col("low"), width), whole_division(F.col("high"), width)
    copies = probes.where((F.col("low") <= F.col("high")) & known).select(
        "*", start.alias("start"), last_cell.alias("stop"), F.explode(F.sequence(start, last_cell)).alias("cell"))
    found = [F.lit(True), mark(F.least("high", (F.col("cell") + 1) * width - 1), _END, 1, "low")], [
        F.col("cell") == F.col("start"), mark("low", _START, -1, "high", own=F.col("told"))]
    if points is None:
        found += ([F.col("cell") == F.col("stop"), mark("high", _POINT, 0, "high", n=F.col("n"), tells=F.col("told"))],)
    marks = copies.select(*by, "probe", "cell", F.explode(F.array_compact(F.array(*[F.when(*f) for f in found]))).alias("m"))
    seen = marks.select(*by, "cell", "probe", "m.*")
    if points is not None:
        placed = points.where(F.col("us").isNotNull() & known).select(
            *by, whole_division(F.col("us"), width).alias("cell"), "us", F.lit(_POINT).alias("rank"), "n", F.col("told").alias("tells"))
        looked_at = copies.select(*by, "cell").distinct()
        seen = seen.unionByName(placed.join(looked_at, [*by, "cell"], "left_semi"), allowMissingColumns=True)

    seen = seen.withColumn("point", F.when(F.col("rank") == _POINT, F.struct("us", "tells")))
    passed = Window.partitionBy(*by, "cell").orderBy("us", "rank", "tells").rowsBetween(Window.unboundedPreceding, 0)
    # In the same order, so that a cell is sorted once; the next point is asked of Spark by name, F.lead cannot skip nulls.
    ahead = f"lead(point) IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)}, cell ORDER BY us, rank, tells)"
    counted = seen.withColumns({
        "head": F.first("point", ignorenulls=True).over(passed), "tail": F.max("point.us").over(passed), "passed": F.sum("n").over(passed),
        "next": F.expr(ahead),
    }).where(F.col("rank") != _POINT)
    at_start = F.col("rank") == _START
    first = F.when(at_start & (F.col("next.us") <= F.col("bound")), F.col("next")).when(
        ~at_start & (F.col("head.us") >= F.col("bound")), F.col("head"))
    return counted.groupBy("probe").agg(
        F.min("own").alias("told"), F.sum(F.col("sign") * F.col("passed")).alias("n"), F.min(first).alias("first"),
        F.max(F.when(~at_start & (F.col("tail") >= F.col("bound")), F.col("tail"))).alias("last_us"),
    ).where(F.col("n") > 0).select("probe", "told", "n", F.col("first.us").alias("first_us"), F.col("first.tells").alias("first"), "last_us")
