"""Point-cloud position and colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_SCALE = 65535.0
HEIGHT_PERIOD = 50.0


def depth(node_key: Column) -> Column:
    """Octree depth of a ``depth-x-y-z`` node key."""
    return F.split_part(node_key, F.lit("-"), F.lit(1)).cast("int")


def scene_position(x: Column, y: Column, z: Column, corner: dict[str, Column]) -> dict[str, Column]:
    """Offset from the minimum corner with the vertical axis second."""
    return {"px": x - corner["x"], "py": z - corner["z"], "pz": -(y - corner["y"])}


def colour(red: Column, green: Column, blue: Column, intensity: Column, height: Column) -> dict[str, Column]:
    """Own colour, else grey by intensity, else a ramp by height above the corner."""
    has_rgb = red.isNotNull() & green.isNotNull() & blue.isNotNull()
    ramp = F.pmod(height, F.lit(HEIGHT_PERIOD)) / HEIGHT_PERIOD

    def channel(own: Column, by_height: Column) -> Column:
        return (
            F.when(has_rgb, own / FULL_SCALE)
            .when(intensity.isNotNull(), intensity / FULL_SCALE)
            .otherwise(by_height)
        )

    return {
        "r": channel(red, ramp),
        "g": channel(green, F.lit(0.5)),
        "b": channel(blue, 1.0 - ramp),
    }
