"""What a picture of a slice needs, as tables: projected streamlines, colours, resized and turned images, histograms.

No picture is encoded here; rows carry coordinates, colours and opacities, which any plotting tool can draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.maths import hashed_uniform

from . import images, streamlines

#: Stops of the colour maps: place, grey level, and how much of the tint the blue channel takes.
# fixed values
STOPS = ((0.0, 0.0, 0.0), (0.3, 0.08, 0.08), (0.6, 0.18, 0.12), (0.85, 0.35, 0.15), (1.0, 0.55, 0.18))
LEVELS = 256
# fixed values: ranges that red, green and blue of a tract's colour are kept in
TRACT_RANGES = ((0.7, 1.0), (0.7, 1.0), (0.0, 0.3))
# fixed values: presets and their weights; the weights are normalised
PRESETS = (
    ("clean_optical", 0.01), ("gamma_speckle", 0.08), ("optical_with_debris", 0.12), ("subtle_debris", 0.04), ("clinical_simulation", 0.02),
    ("heavy_speckle", 0.12), ("extreme_noise", 0.08), ("ultra_heavy_speckle", 0.08), ("gaussian_mixture_aggressive", 0.08),
    ("noncentral_chi_aggressive", 0.08), ("aggressive_smoothing", 0.04), ("comprehensive_aggressive", 0.08),
    ("random_shapes_background", 0.08), ("shapes_with_noise", 0.08), ("aggressive_shapes", 0.05),
)


def slice_projection(points: DataFrame, slice_idx: float, step: float, depth: float, reach: float = 2.0, share: float = 0.4) -> DataFrame:
    """Densified streamlines that come within ``reach`` of a slice, seen from the front, with their opacity."""
    dense = streamlines.densify(points, step, "linear", "floor")
    near = dense.withColumn("distance", F.min(F.abs(F.col("y") - slice_idx)).over(streamlines.whole())).where(F.col("distance") <= reach)
    opacity = F.greatest(F.lit(0.0), (1.0 - F.col("distance") / reach) * share)
    return near.select("streamline_id", "pos", "x", (depth - F.col("z") - 1.0).alias("z"), opacity.alias("opacity"))


def overlay(points: DataFrame, slice_idx: float, reach: float = 2.0) -> DataFrame:
    """Streamlines with a point nearer to the slice than ``reach``."""
    return points.groupBy("streamline_id").agg(F.bool_or(F.abs(F.col("y") - slice_idx) < reach).alias("hit")).where("hit").select("streamline_id")


def _ramp(t: Column, values: Sequence[float]) -> Column:
    """Linear between the stops."""
    out = F.lit(values[-1])
    for k in range(len(STOPS) - 2, -1, -1):
        a, b = STOPS[k][0], STOPS[k + 1][0]
        out = F.when(t < b, values[k] + (t - a) / (b - a) * (values[k + 1] - values[k])).otherwise(out)
    return out


def colour_map(pixels: DataFrame, tint: float = 0.0) -> DataFrame:
    """(image_id, r, c, red, green, blue): one of ``LEVELS`` dark greys for each value from 0 to 1; ``tint``: share of blue."""
    level = F.least(F.floor(F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(1.0)) * LEVELS), F.lit(LEVELS - 1)) / (LEVELS - 1)
    grey = _ramp(level, [g for _, g, _ in STOPS])
    return pixels.select("image_id", "r", "c", grey.alias("red"), grey.alias("green"), _ramp(level, [g + tint * b for _, g, b in STOPS]).alias("blue"))


def tract_colours(ids: DataFrame, base: Sequence[float] = (1.0, 0.8, 0.1), spread: float = 0.2, seed: int = 42) -> DataFrame:
    """A colour per streamline: ``base`` moved by hashed uniforms, kept in ``TRACT_RANGES``."""
    channel = lambda name, b, lo, hi: F.least(F.greatest(b + (2.0 * hashed_uniform(F.lit(seed), F.lit(name), "streamline_id") - 1.0) * spread, F.lit(lo)), F.lit(hi))
    return ids.select("streamline_id", *(channel(n, b, lo, hi).alias(n) for n, b, (lo, hi) in zip(("red", "green", "blue"), base, TRACT_RANGES)))


def centroids(labels: DataFrame) -> DataFrame:
    """Where the number of each labelled bundle (image_id, r, c, label) is written: its mean place, and its size."""
    return labels.groupBy("image_id", "label").agg(F.avg("r").alias("r"), F.avg("c").alias("c"), F.count("*").alias("n"))


def resize_nearest(pixels: DataFrame, shape: tuple[int, int], target: tuple[int, int], threshold: float | None = None) -> DataFrame:
    """Images (rows, columns) of ``shape`` at ``target`` size; with ``threshold``, as a mask of 0 and 255.

    Each source pixel makes the target pixels whose centre it holds: a projection and an explode, no join.
    """
    out = pixels
    for axis, n, m in zip("rc", shape, target):
        # target t reads floor((t + 0.5) n / m), so source s makes t from ceil(s m / n - 0.5) on
        lo, hi = (F.ceil((F.col(axis) + k) * (m / n) - 0.5).cast("int") for k in (0, 1))
        out = out.where(lo < hi).withColumn(axis, F.explode(F.sequence(lo, hi - 1)))
    return out if threshold is None else out.withColumn("v", F.when(F.col("v") > threshold, F.lit(255.0)).otherwise(F.lit(0.0)))


def turn(pixels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """A quarter turn against the clock: the last column becomes the first row."""
    return pixels.withColumns({"r": (shape[1] - 1 - F.col("c")).cast("int"), "c": F.col("r")})


def flip(pixels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Upside down."""
    return pixels.withColumn("r", (shape[0] - 1 - F.col("r")).cast("int"))


def histogram(pixels: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(image_id, bin, n): values in equal bins; the last bin holds its upper edge, values outside count nowhere."""
    found = F.least(F.width_bucket(F.col("v"), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    return pixels.where(F.col("v").between(low, high)).groupBy("image_id", found.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fullest_first(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Patches by falling count, ties in the order of their keys, with their rank; one row a patch, however many the points."""
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), *keys)))


def choose_preset(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A preset per id: cumulative weights against a hashed uniform."""
    total, upto = sum(w for _, w in PRESETS), 0.0
    u, out = hashed_uniform(F.lit(seed), F.lit("preset"), "id"), None
    for name, w in PRESETS[:-1]:
        upto += w / total
        out = (F.when if out is None else out.when)(u < upto, F.lit(name))
    return ids.select("id", out.otherwise(F.lit(PRESETS[-1][0])).alias("preset"))


def scale_parameters(sizes: DataFrame, thickness: int = 1, density: float = 0.15, sigma: float = 2.0, bundle: int = 20) -> DataFrame:
    """Mask parameters by the larger side of the picture (w, h), relative to 256, and the noise factor by its area."""
    scale = F.greatest("w", "h") / 256.0
    factor = F.least(F.lit(1.0), F.col("w") * F.col("h") / 40000.0)
    return sizes.withColumns({
        "thickness": F.greatest(F.lit(1), F.floor(thickness * scale).cast("int")),
        "density": F.greatest(F.lit(0.02), density / F.greatest(F.lit(1.0), scale * 1.5)), "sigma": sigma * scale,
        "bundle": F.greatest(F.lit(1), F.floor(bundle * scale * 0.001).cast("int")), "noise": F.when(factor < 0.8, factor).otherwise(F.lit(1.0)),
    })


def speckle(pixels: DataFrame, strength: float, seed: int = 42) -> DataFrame:
    """Times gamma noise of shape one, which is exponential: minus the logarithm of a hashed uniform."""
    u = hashed_uniform(F.lit(seed), F.lit("speckle"), "image_id", "r", "c")
    return images.normalize(pixels).withColumn("v", F.col("v") * (-strength * F.log(1.0 - u)))


def chi_noise(pixels: DataFrame, degrees: int, centre: float, share: float = 0.5) -> DataFrame:
    """Times one plus noncentral chi-square noise: squares of ``degrees`` normals, one of them moved, scaled to ``share`` at most."""
    normals = [images._normal(42, f"chi{k}x") for k in range(degrees)]
    chi = (normals[0] + centre**0.5) * (normals[0] + centre**0.5)
    for z in normals[1:]:
        chi = chi + z * z
    out = images.normalize(pixels).withColumn("chi", chi)
    return out.select("image_id", "r", "c", (F.col("v") * (1.0 + F.col("chi") / F.max("chi").over(images.image()) * share)).alias("v"))
