"""Envelope joins as equi-joins on grid cells of several sizes.

A plain envelope predicate plans as a nested loop. Here both sides are exploded to the cells that their envelopes touch and joined
on the cell. Every envelope has a level by its own longer side, and the cells of a level are four times as wide as those of the one
below, so that it touches at most `ACROSS` + 1 of them each way. A pair meets on the coarser of its two levels: each row goes to its
own level and to the coarser ones that the other side uses, marked by which side is the larger, so that two small rows never meet in
a coarse cell. A pair that shares several cells is kept only in the one that holds the larger of the two lower left corners, so no
distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.operators.scratch import spread
from plotlink.params import DEFAULTS

BOX = ("x0", "y0", "x1", "y1")
#: Cells that an envelope's longer side may span on its own level, by length.
ACROSS = 4
#: Width of a cell against that of the level below.
STEP = 4
#: Larger sides and farther corners are beyond any coordinates; a level's number stays below 30.
FARTHEST = 1e15
_KEY = ("cell_kind", "cell_level", "cell_x", "cell_y")
_SAME, _LEFT_LARGER, _RIGHT_LARGER = 0, 1, 2


def _cell(value: Column, width: Column) -> Column:
    return F.floor(value / width).cast("long")


def _width(level: Column, size: float) -> Column:
    return F.lit(size) * F.pow(F.lit(float(STEP)), level)


def _levelled(df: DataFrame, size: float, grow: float) -> DataFrame:
    """Rows with a finite, upright envelope and their own_level."""
    ok = F.col("x0") <= F.col("x1")
    for c in ("y0 <= y1", *(f"abs({c}) <= {FARTHEST}" for c in BOX)):
        ok = ok & F.expr(c)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * grow
    steps = F.ceil(F.log2(side / (ACROSS * size)) / F.log2(F.lit(float(STEP))))
    return df.where(ok).withColumn("own_level", F.greatest(F.lit(0), steps).cast("int"))


def _levels(df: DataFrame) -> Column:
    """The levels in use, under thirty numbers, as a scalar subquery."""
    return df.agg(F.collect_set("own_level")).scalar()


def _with_cells(df: DataFrame, others: Column, size: float, grow: float, larger: int, smaller: int) -> DataFrame:
    """A row for each cell in which the row may meet one of the other side's levels."""
    place = lambda level, kind: F.struct(level.alias("level"), kind.cast("int").alias("kind"))
    shared = F.transform(F.filter("other_levels", lambda v: v >= F.col("own_level")), lambda v: place(v, F.when(v == F.col("own_level"), _SAME).otherwise(smaller)))
    finer = F.when(F.exists("other_levels", lambda v: v < F.col("own_level")), F.array(place(F.col("own_level"), F.lit(larger)))).otherwise(F.array().cast("array<struct<level:int,kind:int>>"))
    out = df.withColumn("other_levels", others).withColumn("cell_place", F.explode(F.concat(shared, finer)))
    out = out.withColumn("cell_level", F.col("cell_place.level")).withColumn("cell_kind", F.col("cell_place.kind"))
    for axis in "xy":
        width = _width(F.col("cell_level"), size)
        out = out.withColumn(f"cell_{axis}", F.explode(F.sequence(_cell(F.col(f"{axis}0") - grow, width), _cell(F.col(f"{axis}1") + grow, width))))
    return out.drop("cell_place", "other_levels", "own_level")


def envelope_join(left: DataFrame, right: DataFrame, *, prefix: str = "o_", grow: float = 0.0, size: float = DEFAULTS.cell, few: bool = False) -> DataFrame:
    """All pairs whose envelopes, the left one grown, meet (touching counts). The right side's columns get the prefix.

    Rows with a null, NaN, infinite or inverted envelope meet nothing. `size` is the finest cell.
    few: the right side is a handful of large envelopes, which may be sent to all tasks, as dealing out by cell would leave few with work.
    """
    a, b = _levelled(left, size, grow), _levelled(right, size, 0.0)
    in_a, in_b = _levels(a), _levels(b)
    a = _with_cells(a, in_b, size, grow, _LEFT_LARGER, _RIGHT_LARGER)
    b = _with_cells(b, in_a, size, 0.0, _RIGHT_LARGER, _LEFT_LARGER)
    b = b.select(*[F.col(c).alias(c if c in _KEY else prefix + c) for c in b.columns])
    g = F.lit(grow)
    meets = (F.col("x0") - g <= F.col(f"{prefix}x1")) & (F.col("x1") + g >= F.col(f"{prefix}x0")) & (F.col("y0") - g <= F.col(f"{prefix}y1")) & (F.col("y1") + g >= F.col(f"{prefix}y0"))
    here = F.lit(True)
    for axis in "xy":
        here = here & (F.col(f"cell_{axis}") == _cell(F.greatest(F.col(f"{axis}0") - g, F.col(f"{prefix}{axis}0")), _width(F.col("cell_level"), size)))
    return a.join(b if few else spread(b), list(_KEY)).where(meets & here).drop(*_KEY)


def self_envelope_join(df: DataFrame, key: str, *, prefix: str = "o_", grow: float = 0.0, size: float = DEFAULTS.cell) -> DataFrame:
    """Ordered pairs of different rows of one table whose envelopes meet."""
    return envelope_join(df, df, prefix=prefix, grow=grow, size=size).where(F.col(key) != F.col(prefix + key))
