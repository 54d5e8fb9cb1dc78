"""Range joins as equi joins on genome tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_join(
    centres: DataFrame,
    points: DataFrame,
    on: Sequence[str],
    centre: str,
    point: str,
    width: int,
    inclusive: bool = True,
) -> DataFrame:
    """Pairs with |point - centre| <= width (or < width) and equal ``on`` columns.

    Each centre is copied to the two or three tiles its window touches and each point has one
    tile, so no pair appears twice and a tile is the join key.
    """
    tile = max(int(width), 1)
    left = centres.withColumn("__tile", F.explode(F.sequence(
        F.floor((F.col(centre) - width) / tile), F.floor((F.col(centre) + width) / tile))))
    right = points.withColumn("__tile", F.floor(F.col(point) / tile))
    gap = F.abs(F.col(point) - F.col(centre))
    near = gap <= width if inclusive else gap < width
    return left.join(right, [*on, "__tile"]).filter(near).drop("__tile")


def window_exists(
    centres: DataFrame, points: DataFrame, on: Sequence[str], centre: str, point: str, width: int,
    per: Sequence[str] = (),
) -> DataFrame:
    """Centres with at least one point strictly within ``width``, once per ``per`` value.

    Points shrink to a minimum and maximum per tile first. With tiles as wide as the window the
    centre's own tile always matches and the neighbours are decided by their nearest extreme.
    """
    extremes = points.groupBy(*per, *on, F.floor(F.col(point) / width).alias("__tile")).agg(
        F.min(point).alias("__lo"), F.max(point).alias("__hi"))
    own = F.floor(F.col(centre) / width)
    left = centres.withColumn("__tile", F.explode(F.sequence(own - 1, own + 1)))
    hit = (F.col("__lo") < F.col(centre) + width) & (F.col("__hi") > F.col(centre) - width)
    return left.join(extremes, [*on, "__tile"]).filter(hit).select(*centres.columns, *per).distinct()


def point_in_interval(
    points: DataFrame, intervals: DataFrame, on: Sequence[str], point: str, start: str, end: str, tile: int = 100_000
) -> DataFrame:
    """Pairs with start < point < end (strict)."""
    left = points.withColumn("__tile", F.floor(F.col(point) / tile))
    right = intervals.withColumn("__tile", F.explode(F.sequence(
        F.floor(F.col(start) / tile), F.floor(F.col(end) / tile))))
    inside = (F.col(start) < F.col(point)) & (F.col(point) < F.col(end))
    return left.join(right, [*on, "__tile"]).filter(inside).drop("__tile")


def span_in_interval(
    spans: DataFrame, intervals: DataFrame, on: Sequence[str], lo: str, hi: str, start: str, end: str,
    tile: int = 100_000, point_only: bool = False,
) -> DataFrame:
    """Spans inside an interval: start < lo and hi < end. ``point_only`` checks ``lo`` alone."""
    far = lo if point_only else hi
    pairs = point_in_interval(spans, intervals, on, lo, start, end, tile)
    return pairs.filter(F.col(far) < F.col(end))
