"""Registration: affine transforms and displacement fields applied to streamlines and volumes, and patches of a volume.

Registration tools store both in LPS; here everything is RAS, so x and y change sign. Fields are rows (i, j, k, dx, dy,
dz) in millimetres and are sampled trilinearly: a point meets its eight corners by one equi-join on voxel indices, whatever
the number of components, and a point outside the field is not moved.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import volumes

AXES, SHIFT, PLACE = ("x", "y", "z"), ("dx", "dy", "dz"), ("wx", "wy", "wz")
# fixed values: names of matrices in a transform file
MATRICES, CENTRE = ("AffineTransform_double_3_3", "AffineTransform_float_3_3"), "fixed"


def affine_ras(values: Sequence[float], fixed: Sequence[float]) -> np.ndarray:
    """The RAS matrix of an LPS transform: nine matrix values by rows, three of translation, about the centre ``fixed``."""
    values, lps, turn = np.asarray(values, float), np.eye(4), np.diag([-1.0, -1.0, 1.0, 1.0])
    lps[:3, :3] = values[:9].reshape(3, 3)
    lps[:3, 3] = values[9:12] + np.asarray(fixed, float) - lps[:3, :3] @ np.asarray(fixed, float)
    return turn @ lps @ turn


def read_affine(data: bytes) -> np.ndarray:
    """``affine_ras`` of a level 4 MAT file's bytes; without a known matrix or a centre this raises a KeyError."""
    found, at = {}, 0
    while at < len(data):
        kind, rows, columns, imaginary, n = struct.unpack_from("<5i", data, at)
        name, size = data[at + 20 : at + 19 + n].decode(), 4 if kind // 10 % 10 else 8
        at += 20 + n
        found[name] = np.frombuffer(data, f"<f{size}", rows * columns, at).astype(float)
        at += rows * columns * size * (1 + imaginary)
    named = [m for m in MATRICES if m in found]
    if not named or CENTRE not in found:
        raise KeyError(f"no affine matrix with a centre among {sorted(found)}")
    return affine_ras(found[named[0]], found[CENTRE])


def ras_field(field: DataFrame) -> DataFrame:
    """A field in LPS as one in RAS."""
    return field.withColumns({"dx": -F.col("dx"), "dy": -F.col("dy")})


def flips(affine: Sequence[Sequence[float]]) -> tuple[bool, ...]:
    """Whether each voxel axis runs against the world axis that it follows most."""
    turn = np.asarray(affine, float)[:3, :3]
    return tuple(bool(turn[b, a] < 0) for a, b in enumerate(np.abs(turn).argmax(axis=0)))


def linear(matrix: Sequence[Sequence[float]], names: Sequence[str] = AXES, out: Sequence[str] = AXES) -> list[Column]:
    """``names`` through a 4 x 4 matrix, as columns called ``out``."""
    rows = np.asarray(matrix, float).tolist()
    return [(F.col(names[0]) * r[0] + F.col(names[1]) * r[1] + F.col(names[2]) * r[2] + r[3]).alias(o) for r, o in zip(rows, out)]


def _within(shape: Sequence[int]) -> Column:
    """Whether a place lies between the first and the last voxel of every axis."""
    wx, wy, wz = (F.col(w).between(0.0, float(n - 1)) for w, n in zip(PLACE, shape))
    return wx & wy & wz


def warp_streamlines(
    points: DataFrame, field: DataFrame, fixed_to_moving: Sequence[Sequence[float]], voxel_to_fixed: Sequence[Sequence[float]],
    shape: Sequence[int], mirror: Sequence[str] = (),
) -> DataFrame:
    """Points of the moving space in the fixed one: inverse affine, then the displacement at that place.

    ``mirror`` names axes that are then mirrored about the middle of the field (where ``flips`` of both spaces differ).
    """
    back, grid = np.linalg.inv(fixed_to_moving), np.linalg.inv(voxel_to_fixed)
    keys = ("streamline_id", "point_idx")
    corner = points.select(*keys, *linear(back), *linear(grid @ back, out=PLACE))
    corner = corner.withColumn("w", F.when(_within(shape), F.lit(1.0)).otherwise(F.lit(0.0)))
    for w, c in zip(PLACE, volumes.IDX):
        corner = corner.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn(c, (F.floor(w) + F.col("o")).cast("int")).drop("o")
        corner = corner.withColumn("w", F.col("w") * (1.0 - F.abs(F.col(w) - F.col(c))))
    joined = corner.join(field.select(*volumes.IDX, *SHIFT), list(volumes.IDX), "left")
    moved = joined.groupBy(*keys, *AXES).agg(*(F.sum(F.col("w") * F.coalesce(d, F.lit(0.0))).alias(d) for d in SHIFT))
    middle = (np.asarray(voxel_to_fixed, float) @ [*((n - 1) / 2 for n in shape), 1.0]).tolist()
    out = []
    for a, d, m in zip(AXES, SHIFT, middle):
        place = F.col(a) + F.col(d)
        out.append((2.0 * m - place if a in mirror else place).alias(a))
    return moved.select(*keys, *out)


def into_volume(points: DataFrame, voxel_to_fixed: Sequence[Sequence[float]], shape: Sequence[int], edge: float = 1e-3) -> DataFrame:
    """Voxel coordinates of streamlines of two points or more that enter the volume, kept inside it by ``edge``."""
    placed = points.select("streamline_id", "point_idx", *linear(np.linalg.inv(voxel_to_fixed)))
    x, y, z = ((F.col(a) >= 0) & (F.col(a) < n) for a, n in zip(AXES, shape))
    # one aggregation beside the points; adaptive execution broadcasts or splits the join
    kept = placed.groupBy("streamline_id").agg(F.count("*").alias("n"), F.bool_or(x & y & z).alias("hit")).where("n >= 2 and hit")
    clamped = (F.least(F.greatest(F.col(a), F.lit(0.0)), F.lit(n - edge)).alias(a) for a, n in zip(AXES, shape))
    return placed.join(kept.select("streamline_id"), "streamline_id", "left_semi").select("streamline_id", "point_idx", *clamped)


def warp_volume(
    moving: DataFrame, field: DataFrame, fixed_to_moving: Sequence[Sequence[float]], voxel_to_fixed: Sequence[Sequence[float]],
    voxel_to_moving: Sequence[Sequence[float]], shape: Sequence[int],
) -> DataFrame:
    """(i, j, k, v) on the field's grid: each voxel's place plus its displacement, looked up in ``moving`` of ``shape``."""
    fixed = field.select(*volumes.IDX, *SHIFT, *linear(voxel_to_fixed, volumes.IDX))
    fixed = fixed.select(*volumes.IDX, *((F.col(a) + F.col(d)).alias(a) for a, d in zip(AXES, SHIFT)))
    placed = fixed.select(*volumes.IDX, *linear(np.linalg.inv(voxel_to_moving) @ np.asarray(fixed_to_moving, float), out=PLACE))
    found = volumes.trilinear_at(placed, moving, PLACE, "v")
    return found.select(*volumes.IDX, F.when(_within(shape), F.col("v")).otherwise(F.lit(0.0)).alias("v"))


def patch_affine(affine: Sequence[Sequence[float]], low: Sequence[int], zoom: float) -> np.ndarray:
    """The affine of a synthesized patch: the corner of its box, and voxels along the world's axes."""
    corner = np.asarray(affine, float) @ [*(max(0, n) for n in low), 1.0]
    out = np.diag([zoom, zoom, zoom, 1.0])
    out[:3, 3] = corner[:3]
    return out


def synthesize_patch(
    spark: SparkSession, voxels: DataFrame, affine: Sequence[Sequence[float]], shape: Sequence[int], low: Sequence[int],
    high: Sequence[int], zoom: float, size: Sequence[int],
) -> DataFrame:
    """(i, j, k, v): the box ``low`` to ``high`` of a volume of ``shape``, at voxels of ``zoom`` millimetres.

    The box is cut to the volume. Its rotation is replaced by the world's axes (``patch_affine``), so a target voxel maps
    to the box by a full matrix; corners outside the box count as 0.
    """
    low, high = [max(0, n) for n in low], [min(n, m) for n, m in zip(high, shape)]
    matrix = np.eye(4)
    matrix[:3, :3] = np.linalg.inv(np.asarray(affine, float)[:3, :3]) * zoom
    box = volumes.crop(voxels, low, [b - a for a, b in zip(low, high)])
    target = volumes.grid(spark, size)
    placed = target.select(*volumes.IDX, *linear(matrix, volumes.IDX, PLACE))
    return volumes.trilinear_at(placed, box, PLACE, "v").select(*volumes.IDX, "v")
