"""Masks of tissue and the dark-field effect that keeps intensities, over pixels (image_id, r, c, v).

Morphology is relational: a mask grows by offsets exploded beside its pixels, and shrinks where the pixels outside it grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import images, raster

PLACE = ("image_id", "r", "c")


def _reached(mask: DataFrame, radius: int, shape: tuple[int, int], keys: Sequence[str]) -> DataFrame:
    """(keys, r, c, d): each pixel within ``radius`` of a mask's pixel, with the distance to the nearest one."""
    span = range(-radius, radius + 1)
    disk = [(a, b, float(a * a + b * b) ** 0.5) for a in span for b in span if a * a + b * b <= radius * radius]
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d")) for a, b, d in disk))).alias("o")
    near = mask.select(*keys, "r", "c", offsets).select(
        *keys, (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), F.col("o.d").alias("d")
    )
    near = near.where((F.col("r") >= 0) & (F.col("r") < shape[0]) & (F.col("c") >= 0) & (F.col("c") < shape[1]))
    return near.groupBy(*keys, "r", "c").agg(F.min("d").alias("d"))


def spread(mask: DataFrame, radius: int, shape: tuple[int, int], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Masks grown by a disk, each of ``keys`` by itself: a label among the keys grows every bundle alone."""
    return _reached(mask, radius, shape, keys).drop("d")


def shrink(mask: DataFrame, pixels: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """Masks without what lies within a disk of a pixel outside them; beyond the edge of an image nothing is outside."""
    every = pixels.select(*PLACE)
    outside = every.join(mask.select(*PLACE), list(PLACE), "left_anti")
    return every.join(spread(outside, radius, shape), list(PLACE), "left_anti")


def close(mask: DataFrame, pixels: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """Grown, then shrunk."""
    return shrink(spread(mask, radius, shape), pixels, radius, shape)


def tissue_region(pixels: DataFrame, shape: tuple[int, int], threshold: float = 0.015, least: int = 100, radius: int = 2) -> DataFrame:
    """(image_id, r, c): pixels over ``threshold``, gaps closed, without regions (by edges) of fewer than ``least`` pixels."""
    closed = close(pixels.where(F.col("v") > threshold).select(*PLACE), pixels, radius, shape)
    return raster.large(raster.components(closed, diagonal=False), least).select(*PLACE)


def blockface_dark_field(
    pixels: DataFrame, shape: tuple[int, int], power: float = 1.8, cut: float = 0.04, threshold: float = 0.015, least: int = 100
) -> DataFrame:
    """Values from 0 to 1 darkened but in their order: v^power / 2, smoothed, low ones black, and so is what is no tissue.

    Tissue within two pixels of the background fades with its distance from it.
    """
    region = tissue_region(pixels, shape, threshold, least)
    outside = pixels.select(*PLACE).join(region, list(PLACE), "left_anti")
    fade = region.join(_reached(outside, 2, shape, ("image_id",)), list(PLACE), "left")
    fade = fade.select(*PLACE, F.least(F.coalesce("d", F.lit(2.0)) / 2.0, F.lit(1.0)).alias("share"))
    dark = images.gaussian(pixels.withColumn("v", F.pow("v", F.lit(power)) * 0.5), 0.4)
    dark = dark.withColumn("v", F.when(F.col("v") < cut, F.lit(0.0)).otherwise(F.col("v"))).join(fade, list(PLACE), "left")
    return images.gaussian(dark.select(*PLACE, (F.col("v") * F.coalesce("share", F.lit(0.0))).alias("v")), 0.2)
