"""Voxel-grid operators over rows (i, j, k, v): profile, crop, resample, reduce, mask.

Resampling generates the target grid with ``range`` and joins source voxels on integer coordinates; the offsets of a
kernel are exploded beside each target voxel, so every method is one equi-join and one aggregation by target voxel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.maths import cubic_kernel

IDX = ("i", "j", "k")


def target_affine(affine: Sequence, old_shape: Sequence[int], zooms: Sequence[float], new_shape: Sequence[int], center=None) -> np.ndarray:
    """The affine of a grid with new voxel sizes whose middle (or ``center``) stays where the old middle is."""
    a = np.asarray(affine, float)
    scale = np.linalg.norm(a[:3, :3], axis=0)
    if (scale < 1e-10).any():
        raise ValueError("a voxel size is zero")
    out = np.eye(4)
    out[:3, :3] = a[:3, :3] * (np.asarray(zooms, float) / scale)
    middle = np.asarray(center, float) if center is not None else a[:3, :3] @ ((np.asarray(old_shape) - 1) / 2) + a[:3, 3]
    out[:3, 3] = middle - out[:3, :3] @ ((np.asarray(new_shape) - 1) / 2)
    return out


def target_shape(shape: Sequence[int], zooms: Sequence[float], target: float, high: int | None = 4000) -> tuple[int, ...]:
    """Dimensions for a target voxel size, rounded half to even, at least 32 and at most ``high``."""
    found = (max(32, round(n * z / target)) for n, z in zip(shape, zooms))
    return tuple(min(n, high) if high else n for n in found)


def profile(voxels: DataFrame) -> DataFrame:
    v = F.col("v")
    return voxels.agg(
        F.count("*").alias("n_voxels"), F.min("v").alias("min_v"), F.max("v").alias("max_v"),
        F.count_if(v != 0).alias("n_nonzero"), F.coalesce(F.bool_or(F.isnan("v")), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("has_inf"),
    )


def crop(voxels: DataFrame, origin: Sequence[int], size: Sequence[int]) -> DataFrame:
    """Half-open box, indices shifted to its origin."""
    for c, o, n in zip(IDX, origin, size):
        voxels = voxels.where((F.col(c) >= o) & (F.col(c) < o + n))
    return voxels.select(*((F.col(c) - o).alias(c) for c, o in zip(IDX, origin)), "v")


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All (i, j, k) of a shape, from one range."""
    _, nj, nk = shape
    cell = spark.range(int(np.prod(shape)))
    return cell.select(
        F.expr(f"cast(id div {nj * nk} as int)").alias("i"),
        F.expr(f"cast((id div {nk}) % {nj} as int)").alias("j"),
        F.expr(f"cast(id % {nk} as int)").alias("k"),
    )


def _source(target: DataFrame, scale: Sequence[float], shift: Sequence[float]) -> DataFrame:
    return target.withColumns({f"s{c}": F.col(c) * float(m) + float(t) for c, m, t in zip(IDX, scale, shift)})


def resample(voxels: DataFrame, shape: Sequence[int], scale: Sequence[float], shift: Sequence[float], method: str) -> DataFrame:
    """Values on a grid of ``shape``; a target index maps to scale * index + shift.

    nearest: truncation toward zero, outside 0. trilinear: eight corners, absent ones count as 0 and weights are not made
    up. cubic: 64 samples around the rounded place, divided by the weights of those that exist.
    """
    target = _source(grid(voxels.sparkSession, shape), scale, shift)
    source = voxels.select(*(F.col(c).alias(f"q{c}") for c in IDX), "v")
    keys = [f"q{c}" for c in IDX]
    if method == "nearest":
        placed = target.withColumns({f"q{c}": F.col(f"s{c}").cast("int") for c in IDX})
        return placed.join(source, keys, "left").select(*IDX, F.coalesce("v", F.lit(0.0)).alias("v"))
    low, high, base = (0, 1, F.floor) if method == "trilinear" else (-1, 2, F.round)
    steps = F.sequence(F.lit(low), F.lit(high))
    # an offset is exploded with its weight as soon as it is known, axis by axis
    for c in IDX:
        target = target.withColumn("o", F.explode(steps)).withColumn(f"q{c}", (base(F.col(f"s{c}")) + F.col("o")).cast("int"))
        gap = F.abs(F.col(f"s{c}") - F.col(f"q{c}"))
        target = target.withColumn(f"w{c}", (1.0 - gap) if method == "trilinear" else cubic_kernel(gap)).drop("o")
    weight = F.col("wi") * F.col("wj") * F.col("wk")
    joined = target.withColumn("w", weight).join(source, keys, "left")
    total = F.sum(F.col("w") * F.coalesce("v", F.lit(0.0)))
    if method == "cubic":
        mass = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
        total = F.when(F.abs(mass) > 1e-10, total / mass).otherwise(F.lit(0.0))
    return joined.groupBy(*IDX).agg(total.alias("v"))


def reduce_axis(voxels: DataFrame, axis: str, how: str) -> DataFrame:
    """Maximum or mean along an axis."""
    f = F.max if how == "mip" else F.avg
    return voxels.groupBy(*(c for c in IDX if c != axis)).agg(f("v").alias("v"))


def mip_views(voxels: DataFrame) -> DataFrame:
    """(axis, a, b, v): the three maximum projections, from one pass with grouping sets."""
    out = voxels.groupingSets([["i", "j"], ["i", "k"], ["j", "k"]], "i", "j", "k").agg(
        F.max("v").alias("v"), F.grouping("i").alias("gi"), F.grouping("j").alias("gj")
    )
    axis = F.when(F.col("gi") == 1, "i").when(F.col("gj") == 1, "j").otherwise("k")
    return out.select(
        axis.alias("axis"),
        F.when(F.col("gi") == 1, F.col("j")).otherwise(F.col("i")).alias("a"),
        F.when((F.col("gi") == 1) | (F.col("gj") == 1), F.col("k")).otherwise(F.col("j")).alias("b"),
        "v",
    )


def upscale_mask(voxels: DataFrame, factor: int, threshold: float) -> DataFrame:
    """(i, j, k) of the voxels above ``threshold`` on a grid finer by ``factor``; each voxel splits into its children."""
    kept = voxels.where(F.col("v") > threshold)
    for c in IDX:
        kept = kept.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(c, F.col(c) * factor + F.col("o")).drop("o")
    return kept.select(*IDX)


def trilinear_at(points: DataFrame, voxels: DataFrame, names: Sequence[Column | str], out: str) -> DataFrame:
    """Adds the trilinear value of a volume at each point (streamline_id, point_idx, ...)."""
    corner = points
    for c, n in zip(IDX, names):
        corner = corner.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(1))))
        corner = corner.withColumn(f"q{c}", (F.floor(F.col(n)) + F.col("o")).cast("int")).drop("o")
        corner = corner.withColumn(f"w{c}", 1.0 - F.abs(F.col(n) - F.col(f"q{c}")))
    source = voxels.select(*(F.col(c).alias(f"q{c}") for c in IDX), "v")
    value = F.sum(F.col("wi") * F.col("wj") * F.col("wk") * F.coalesce("v", F.lit(0.0)))
    joined = corner.join(source, [f"q{c}" for c in IDX], "left")
    return joined.groupBy(*points.columns).agg(value.alias(out))
