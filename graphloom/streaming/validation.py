"""Value checks over a stream of triples.

The engine is a batch one; this only lets the checks that need no more than the
value itself (``shapes.ALONE``: datatype, ranges, lengths, pattern, in, node kind) run as triples
arrive, with a table of counts per window. They are the batch validator's own checks; what needs
whole graphs (counts, classes, inverse paths) belongs to it and is refused here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.shapes import ALONE, Constraint, broken_value


def bad_values(triples: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Rows of a (streaming) table of triples whose value breaks a constraint; its other columns stay.

    The target class of a shape is not looked at. Raises ValueError for a constraint that needs more than the value.
    """
    more = [c for c in constraints if c.component not in ALONE or c.inverse]
    if more:
        raise ValueError("not checkable by the value alone: " + ", ".join(sorted({f"{c.shape} {'inverse ' * c.inverse}{c.component}" for c in more})))
    if not constraints:
        return triples.withColumn("component", F.lit("")).where("false")
    bad = lambda c: broken_value(F.lit(c.component), F.lit(c.arg), F.col("o"), F.col("o_kind"), F.col("o_dt"))
    hits = [F.when((F.col("p") == c.path) & bad(c), F.lit(f"{c.shape}|{c.component}")) for c in constraints]
    return triples.withColumn("component", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def counts(bad: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Broken values per window and component; events later than ``late`` are dropped by the watermark."""
    return bad.withWatermark(time_col, late).groupBy(F.window(time_col, window), "component").agg(F.count("*").alias("n"))
