"""Colour transforms as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hues up to this with at least this saturation look red (the low end of the circle alone).
RED_HUE, RED_SATURATION = 0.125, 0.25


def normalised(rows: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """All channels over 255 if any value of the table is above 1; more than 255, and negative values, are errors."""
    most = rows.agg(F.max(F.greatest(*channels)).alias("__most"), F.min(F.least(*channels)).alias("__least"))
    divisor = F.when((F.col("__most") > 255) | (F.col("__least") < 0), F.raise_error(F.lit("colours lie outside [0, 255]")).cast("double")).when(F.col("__most") > 1, 255.0).otherwise(1.0)
    return rows.join(F.broadcast(most)).withColumns({c: F.col(c) / divisor for c in channels}).drop("__most", "__least")


def to_byte(c: Column) -> Column:
    """Half to even, clipped to a byte."""
    return F.least(F.greatest(F.rint(c * 255), F.lit(0.0)), F.lit(255.0)).cast("long")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation, value in [0, 1]; where channels tie for the most, blue goes before green before red."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = high - low
    some = F.nullif(delta, F.lit(0.0))
    sixth = F.when(b == high, 4 + (r - g) / some).when(g == high, 2 + (b - r) / some).otherwise((g - b) / some)
    turn = sixth / 6
    hue = F.when(delta == 0, 0.0).otherwise(turn - F.floor(turn))
    return hue, F.when(high == 0, 0.0).otherwise(delta / F.nullif(high, F.lit(0.0))), high


def red_like(hue: Column, saturation: Column) -> Column:
    """P16."""
    return (hue <= RED_HUE) & (saturation >= RED_SATURATION)


#: Names of colour columns by which they are found, the first that is there.
COLOUR_NAMES = ("Colors", "colors", "RGB", "rgb", "RGBA", "rgba")


def find(rows: DataFrame) -> str | None:
    """the array column that holds colours: one of COLOUR_NAMES with three or four values a row, else the first numeric one with finite values in [0, 255] only whose name has no *normal*. One pass over the table."""
    arrays = [n for n, t in rows.dtypes if t in {f"array<{x}>" for x in ("tinyint", "smallint", "int", "bigint", "float", "double")}]
    named = [n for n in COLOUR_NAMES if n in arrays]
    others = [n for n in arrays if n not in named and "normal" not in n.lower()]
    if not named + others:
        return None
    sized = lambda n: F.coalesce(F.min(F.size(f"`{n}`")) == F.max(F.size(f"`{n}`")), F.lit(False)) & F.coalesce(F.min(F.size(f"`{n}`")).isin(3, 4), F.lit(False))
    within = lambda n: F.coalesce(F.every(F.forall(f"`{n}`", lambda x: x.isNotNull() & (x >= 0) & (x <= 255) & ~F.isnan(x.cast("double")))), F.lit(False))
    fits = rows.agg(*(sized(n).alias(f"s{i}") for i, n in enumerate(named + others)), *(within(n).alias(f"w{i}") for i, n in enumerate(named + others))).first()
    for i, n in enumerate(named + others):
        if fits[f"s{i}"] and (n in named or fits[f"w{i}"]):
            return n
    return None


def grey(weight: Column) -> dict[str, Column]:
    """A weight as grey r, g, b with full alpha, in single precision."""
    level = F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)).cast("float")
    return {"r": level, "g": level, "b": level, "alpha": F.lit(1.0).cast("float")}
