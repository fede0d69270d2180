"""Column expressions over image sizes and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def closest_aspect(width: Column, height: Column) -> Column:
    """The supported ratio nearest in logarithm; the earlier of equally near ones.  Null without a size."""
    ratio = width.cast("double") / height.cast("double")
    far = [F.struct(F.abs(F.log(ratio / F.lit(r))).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, r) in enumerate(fixed.ASPECTS)]
    return F.when(has_size(width, height), F.array_min(F.array(*far))["name"])


def has_size(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0), F.lit(False))


def scaled(width: Column, height: Column, longest: int = fixed.MAX_SIDE) -> tuple[Column, Column]:
    """Sides scaled down to ``longest``, halves rounded up."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return tuple(F.floor(side * scale + 0.5).cast("long") for side in (width, height))


def large_enough(width: Column, height: Column, least: int = fixed.MIN_DIMENSION) -> Column:
    return F.least(width, height) >= least


def expanded_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = fixed.FACE_MARGIN) -> Column:
    """A box grown by ``margin`` of its size on every side, within the image; null if nothing is left."""
    mx, my = (w * F.lit(margin)).cast("long"), (h * F.lit(margin)).cast("long")
    box = F.struct(F.greatest(F.lit(0), x - mx).cast("long").alias("x0"), F.greatest(F.lit(0), y - my).cast("long").alias("y0"), F.least(width, x + w + mx).cast("long").alias("x1"), F.least(height, y + h + my).cast("long").alias("y1"))
    return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def cropped_rows(height: Column, fraction: float) -> tuple[Column, Column]:
    """First kept row and number of kept rows when a share of the top goes."""
    if not 0 <= fraction < 1:
        raise ValueError("the share to crop must be at least 0 and less than 1")
    first = (height * F.lit(fraction)).cast("long")
    return first, height - first
