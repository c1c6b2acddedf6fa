"""Intensity operators over pixels (image_id, r, c, v): point operations, stencils, noise, artefacts.

Stencils that need a few neighbours read them with windows along rows and columns of an image; wider kernels are
separable and run twice. Both keep the work in one shuffle by image and row, or image and column.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomspan.functions.maths import hashed_uniform



def image() -> WindowSpec:
    """All pixels of an image."""
    return Window.partitionBy("image_id")


def normalize(pixels: DataFrame) -> DataFrame:
    """To [0, 1] per image; a constant image is unchanged."""
    lo, hi = F.min("v").over(image()), F.max("v").over(image())
    return pixels.withColumn("v", F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(F.col("v")))


def tissue(pixels: DataFrame, threshold: float = 0.01) -> DataFrame:
    return normalize(pixels).withColumn("v", F.when(F.col("v") > threshold, F.col("v")).otherwise(F.lit(0.0)))


def gamma(pixels: DataFrame, power: float) -> DataFrame:
    return normalize(pixels).withColumn("v", F.pow("v", F.lit(power)))


def _unit(axis: str, size: int) -> Column:
    """A pixel's place from -1 to 1."""
    return F.col(axis) * (2.0 / max(1, size - 1)) - 1.0


def bias_field(pixels: DataFrame, shape: tuple[int, int], strength: float) -> DataFrame:
    """Times a cubic polynomial field around one."""
    x, y = _unit("c", shape[1]), _unit("r", shape[0])
    field = 1.0 + strength * (x + y + x * y + x * x - y * y + x * x * x - y * y * y)
    return normalize(pixels).withColumn("v", F.col("v") * field)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _along(pixels: DataFrame, across: str, along: str, weights: list[float]) -> DataFrame:
    """One pass of a separable kernel; beyond the edge the nearest pixel counts."""
    radius = len(weights) // 2
    own = Window.partitionBy("image_id", across).orderBy(along)
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("v").over(every), F.last("v").over(every)
    out = F.lit(0.0)
    for k, w in zip(range(-radius, radius + 1), weights):
        near = F.col("v") if k == 0 else F.coalesce(F.lag("v", -k).over(own), first) if k < 0 else F.coalesce(F.lead("v", k).over(own), last)
        out = out + near * w
    return pixels.withColumn("v", out)


def gaussian(pixels: DataFrame, sigma: float) -> DataFrame:
    weights = gaussian_weights(sigma)
    return _along(_along(pixels, "c", "r", weights), "r", "c", weights)


def unsharp(pixels: DataFrame, sigma: float, amount: float) -> DataFrame:
    """v + amount (v - blurred), within the range of the image."""
    both = pixels.withColumn("keep", F.col("v"))
    lo, hi = F.min("keep").over(image()), F.max("keep").over(image())
    out = gaussian(both, sigma)
    return out.select("image_id", "r", "c", F.least(F.greatest(F.col("keep") + amount * (F.col("keep") - F.col("v")), lo), hi).alias("v"))


def four_neighbours(pixels: DataFrame) -> DataFrame:
    """Adds up, down, left, right; at an edge the pixel itself."""
    column, row = Window.partitionBy("image_id", "c").orderBy("r"), Window.partitionBy("image_id", "r").orderBy("c")
    return pixels.withColumns({"up": F.lag("v").over(column), "down": F.lead("v").over(column)}).withColumns(
        {"left": F.lag("v").over(row), "right": F.lead("v").over(row)}
    ).withColumns({n: F.coalesce(n, "v") for n in ("up", "down", "left", "right")})


def laplacian(pixels: DataFrame, strength: float) -> DataFrame:
    """v - strength * Laplacian, within the range of the image."""
    lo, hi = F.min("v").over(image()), F.max("v").over(image())
    lap = F.col("up") + F.col("down") + F.col("left") + F.col("right") - 4.0 * F.col("v")
    return four_neighbours(pixels).select("image_id", "r", "c", F.least(F.greatest(F.col("v") - strength * lap, lo), hi).alias("v"))


def diffusion(pixels: DataFrame, kappa: float, rate: float) -> DataFrame:
    """One step of edge-keeping diffusion: differences weigh exp(-(d / kappa)^2)."""
    flow = F.lit(0.0)
    for n in ("up", "down", "left", "right"):
        d = F.col(n) - F.col("v")
        flow = flow + d * F.exp(-((d / kappa) * (d / kappa)))
    return four_neighbours(pixels).select("image_id", "r", "c", (F.col("v") + rate * flow).alias("v"))


def adaptive(pixels: DataFrame, sigma: float) -> DataFrame:
    """Blurred where the local difference is small: weight exp(-4 |v - blurred|)."""
    out = gaussian(pixels.withColumn("keep", F.col("v")), sigma)
    w = F.exp(-4.0 * F.abs(F.col("keep") - F.col("v")))
    return out.select("image_id", "r", "c", (w * F.col("v") + (1.0 - w) * F.col("keep")).alias("v"))


def dark_field(pixels: DataFrame, power: float, low: float, high: float, cut: float) -> DataFrame:
    """Normalised, inverted, gamma, stretched between two exact percentiles, values under ``cut`` to zero."""
    out = normalize(pixels).withColumn("v", F.pow(1.0 - F.col("v"), F.lit(power)))
    a, b = F.percentile("v", F.lit(low)).over(image()), F.percentile("v", F.lit(high)).over(image())
    out = out.withColumn("v", F.when(b > a, F.least(F.greatest((F.col("v") - a) / (b - a), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("v")))
    return out.withColumn("v", F.when(F.col("v") < cut, F.lit(0.0)).otherwise(F.col("v")))


def _normal(seed: int, tag: str) -> Column:
    """A standard normal number by the Box-Muller transform of two hashed uniforms."""
    u = [hashed_uniform(F.lit(seed), F.lit(f"{tag}{k}"), "image_id", "r", "c") for k in (1, 2)]
    return F.sqrt(-2.0 * F.log(1.0 - u[0])) * F.cos(2.0 * math.pi * u[1])


def noise_multiplicative(pixels: DataFrame, shape: tuple[int, int], strength: float) -> DataFrame:
    """v (1 + s (X + Y + X^2 - Y^2))."""
    x, y = _unit("c", shape[1]), _unit("r", shape[0])
    return normalize(pixels).withColumn("v", F.col("v") * (1.0 + strength * (x + y + x * x - y * y)))


def noise_mixture(pixels: DataFrame, sigma: float, seed: int = 42) -> DataFrame:
    """Plus a mixture of normals: shares 0.4, 0.3, 0.3 at sigma, sigma / 2, 1.5 sigma; never below zero."""
    u = hashed_uniform(F.lit(seed), F.lit("mix"), "image_id", "r", "c")
    scale = F.when(u < 0.4, F.lit(sigma)).when(u < 0.7, F.lit(sigma / 2)).otherwise(F.lit(1.5 * sigma))
    return normalize(pixels).withColumn("v", F.greatest(F.col("v") + scale * _normal(seed, "n"), F.lit(0.0)))


def ellipses(pixels: DataFrame, shape: tuple[int, int], n: int, seed: int = 42) -> DataFrame:
    """(image_id, r, c): pixels of the union of ``n`` hashed ellipses per image."""
    hit = F.lit(False)
    for k in range(n):
        cy, cx, ry, rx = (hashed_uniform(F.lit(seed), F.lit(f"e{k}{name}"), "image_id") for name in ("cy", "cx", "ry", "rx"))
        dy = (F.col("r") - cy * shape[0]) / (0.5 + ry * shape[0] / 4)
        dx = (F.col("c") - cx * shape[1]) / (0.5 + rx * shape[1] / 4)
        hit = hit | (dx * dx + dy * dy <= 1.0)
    return pixels.where(hit).select("image_id", "r", "c")


def blend(pixels: DataFrame, color: float, opacity: float, shape: tuple[int, int], n: int, seed: int = 42) -> DataFrame:
    """The five blends of a colour into the ellipses, one row each: mode and v."""
    mask = ellipses(pixels, shape, n, seed).withColumn("on", F.lit(True))
    out = normalize(pixels).join(mask, ["image_id", "r", "c"], "left")
    v = F.col("v")
    modes = {
        "overlay": F.when(v < 0.5, 2 * v * color).otherwise(1 - 2 * (1 - v) * (1 - color)),
        "multiply": v * color,
        "screen": 1 - (1 - v) * (1 - color),
        "normal": F.lit(color),
        "add": F.least(v + color, F.lit(1.0)),
    }
    made = F.explode(F.array(*(
        F.struct(F.lit(m).alias("mode"), F.when(F.col("on"), v * (1 - opacity) + opacity * e).otherwise(v).alias("b")) for m, e in modes.items()
    ))).alias("e")
    return out.select("image_id", "r", "c", made).select("image_id", "r", "c", "e.mode", F.col("e.b").alias("v"))


def equalize(pixels: DataFrame) -> DataFrame:
    """Histogram equalisation of each image: the share of pixels at or below the value."""
    return pixels.withColumn("v", F.cume_dist().over(image().orderBy("v")))


def clahe(pixels: DataFrame, shape: tuple[int, int], tile: int = 4, clip: float = 0.03, bins: int = 32) -> DataFrame:
    """Contrast-limited equalisation: clipped histograms per tile, blended between tile centres."""

    def run(table: pa.Table) -> pa.Table:
        r, c, v = (table.column(n).to_numpy() for n in ("r", "c", "v"))
        low, span = v.min(), np.ptp(v)
        level = np.minimum(((v - low) / (span or 1.0) * bins).astype(int), bins - 1)
        ny, nx = -(-shape[0] // tile), -(-shape[1] // tile)
        hist = np.zeros((ny, nx, bins))
        np.add.at(hist, (r // tile, c // tile, level), 1)
        limit = np.maximum(1.0, clip * hist.sum(2, keepdims=True))
        excess = np.maximum(hist - limit, 0).sum(2, keepdims=True)
        cdf = np.cumsum(np.minimum(hist, limit) + excess / bins, axis=2)
        cdf /= np.maximum(cdf[:, :, -1:], 1e-12)
        fy, fx = np.clip((r + 0.5) / tile - 0.5, 0, ny - 1), np.clip((c + 0.5) / tile - 0.5, 0, nx - 1)
        y0, x0 = fy.astype(int), fx.astype(int)
        y1, x1, wy, wx = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1), fy - y0, fx - x0
        out = (1 - wy) * ((1 - wx) * cdf[y0, x0, level] + wx * cdf[y0, x1, level]) + wy * ((1 - wx) * cdf[y1, x0, level] + wx * cdf[y1, x1, level])
        return table.set_column(table.schema.get_field_index("v"), "v", pa.array(out))

    return pixels.groupBy("image_id").applyInArrow(run, pixels.schema)


def lpsvd(pixels: DataFrame, rank: int = 3) -> DataFrame:
    """Each row denoised by a low-rank Hankel matrix: singular values beyond ``rank`` dropped, diagonals averaged."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("r", "ascending"), ("c", "ascending")])
        r, v = table.column("r").to_numpy(), table.column("v").to_numpy()
        out = v.astype(float).copy()
        for row in np.unique(r):
            at = np.flatnonzero(r == row)
            n = len(at)
            if n < 3:
                continue
            m = n // 2 + 1
            place = np.arange(m)[:, None] + np.arange(n - m + 1)
            u, s, w = np.linalg.svd(v[at][place], full_matrices=False)
            low = (u[:, :rank] * s[:rank]) @ w[:rank]
            out[at] = np.bincount(place.ravel(), low.ravel(), n) / np.bincount(place.ravel(), minlength=n)
        return table.set_column(table.schema.get_field_index("v"), "v", pa.array(out))

    return pixels.groupBy("image_id").applyInArrow(run, pixels.schema)


def elastic(pixels: DataFrame, shape: tuple[int, int], spacing: int, strength: float, seed: int = 42) -> DataFrame:
    """Each pixel takes the bilinear value at its place moved by a smooth hashed field.

    The coarse field's corner values are hashes of the corner's place, so the field needs no join; the four source pixels
    are one equi-join.
    """
    def field(axis: str) -> Column:
        y0, x0 = F.floor(F.col("r") / spacing), F.floor(F.col("c") / spacing)
        wy, wx = F.col("r") / spacing - y0, F.col("c") / spacing - x0
        corner = lambda a, b: 2.0 * hashed_uniform(F.lit(seed), F.lit(axis), "image_id", y0 + a, x0 + b) - 1.0
        return strength * ((1 - wy) * ((1 - wx) * corner(0, 0) + wx * corner(0, 1)) + wy * ((1 - wx) * corner(1, 0) + wx * corner(1, 1)))

    clamp = lambda e, n: F.least(F.greatest(e, F.lit(0.0)), F.lit(n - 1.0))
    moved = pixels.select("image_id", "r", "c", clamp(F.col("r") + field("y"), shape[0]).alias("sy"), clamp(F.col("c") + field("x"), shape[1]).alias("sx"))
    for a, n in (("y", shape[0]), ("x", shape[1])):
        moved = moved.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(1))))
        moved = moved.withColumn(f"q{a}", F.least(F.floor(f"s{a}") + F.col("o"), F.lit(n - 1)).cast("int"))
        share = F.col(f"s{a}") - F.floor(f"s{a}")
        moved = moved.withColumn(f"w{a}", F.when(F.col("o") == 1, share).otherwise(1.0 - share)).drop("o")
    source = pixels.select("image_id", F.col("r").alias("qy"), F.col("c").alias("qx"), "v")
    return moved.join(source, ["image_id", "qy", "qx"]).groupBy("image_id", "r", "c").agg(F.sum(F.col("wy") * F.col("wx") * F.col("v")).alias("v"))


def random_walks(spark, walks: int, steps: int, center: tuple[float, float], radius: float, bend: float = 0.4, seed: int = 42) -> DataFrame:
    """(walk, step, r, c): short walks that radiate from a disc; headings turn by hashed angles, summed by windows."""
    u = lambda *tags: hashed_uniform(F.lit(seed), *(F.lit(t) if isinstance(t, str) and t.startswith("#") else t for t in tags))
    order = Window.partitionBy("walk").orderBy("step")
    out = spark.range(walks).select(F.col("id").alias("walk"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    turn = F.when(F.col("step") == 0, u("#heading", "walk") * (2 * math.pi)).otherwise((u("#turn", "walk", "step") - 0.5) * (2 * bend))
    out = out.withColumn("heading", F.sum(turn).over(order))
    start = radius * F.sqrt(u("#start", "walk"))
    along = u("#around", "walk") * (2 * math.pi)
    moved = F.when(F.col("step") == 0, F.lit(0.0))
    return out.select(
        "walk", "step",
        (center[0] + start * F.sin(along) + F.sum(moved.otherwise(F.sin("heading"))).over(order)).alias("r"),
        (center[1] + start * F.cos(along) + F.sum(moved.otherwise(F.cos("heading"))).over(order)).alias("c"),
    )


def otsu_mask(pixels: DataFrame, bins: int = 50) -> DataFrame:
    """(image_id, r, c) of pixels above the threshold that parts the histogram of each image best."""
    def run(table: pa.Table) -> pa.Table:
        v = table.column("v").to_numpy()
        hist, edges = np.histogram(v, bins)
        mid = (edges[1:] + edges[:-1]) / 2
        low, total = np.cumsum(hist), np.cumsum(hist * mid)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.nan_to_num(total / low - (total[-1] - total) / (low[-1] - low))
        cut = edges[1:][(low * (low[-1] - low) * gap**2).argmax()]
        return table.filter(pa.array(v > cut)).select(["image_id", "r", "c"])

    return pixels.select("image_id", "r", "c", "v").groupBy("image_id").applyInArrow(run, "image_id long, r int, c int")
