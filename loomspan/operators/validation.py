"""Checks of requests, inputs and outputs, as columns: a table of requests is checked in one pass, without a shuffle.

A check never drops a row. It adds ``valid`` and flags for what a user should look at; callers filter or raise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .streamlines import AXES, to_voxel

# fixed values: limits of sizes in voxels and mm, of memory in GB, and of shares of a volume
LARGE_DIM, LARGE_TOTAL, COARSE, FINE, LARGE_GB = 2000, 100_000_000, 10.0, 0.01, 16.0
PATCH_SHARE, SMALL_PATCH, OVERLAP, SPARSE, DENSE = 0.8, 32, 10, 0.01, 0.3
SMALL_DIM, FEW_LINES, AGREE = 10, 100, 1e-3


def _product(columns: Sequence[Column]) -> Column:
    out = F.lit(1).cast("long")
    for c in columns:
        out = out * c
    return out


def memory_gb(voxels: Column, bytes_each: int = 4) -> Column:
    """Size of a dense volume."""
    return voxels * float(bytes_each) / float(1 << 30)


def check_targets(requests: DataFrame, most_gb: float = 64.0) -> DataFrame:
    """Requests (nx, ny, nz, voxel_mm, n_slices or null) with their checks, memory, and the shape that fits ``most_gb``.

    Slices are cut to the second dimension; a shape that needs too much memory shrinks by the cube root of the excess.
    """
    dims = [F.col(f"n{a}") for a in AXES]
    valid = (F.least(*dims) > 0) & (F.col("voxel_mm") > 0) & (F.col("n_slices").isNull() | (F.col("n_slices") > 0))
    total = _product(dims)
    gb = memory_gb(total)
    scale = F.when(gb > most_gb, F.pow(F.lit(most_gb) / F.greatest(gb, F.lit(0.1)), F.lit(1.0 / 3.0))).otherwise(F.lit(1.0))
    out = requests.withColumns({
        "valid": valid, "n_voxels": total, "gb": gb, "slices": F.least("n_slices", "ny"), "large_dim": F.greatest(*dims) > LARGE_DIM,
        "large_total": total > LARGE_TOTAL, "coarse": F.col("voxel_mm") > COARSE, "fine": F.col("voxel_mm") < FINE,
        "slices_cut": F.coalesce(F.col("n_slices") > F.col("ny"), F.lit(False)), "large_memory": gb > LARGE_GB,
    })
    return out.withColumns({f"fit_{a}": F.floor(F.col(f"n{a}") * scale + 1e-9).cast("int") for a in AXES})


def check_patches(requests: DataFrame) -> DataFrame:
    """Requests (vx, vy, vz, px, py, pz, n_patches): whether patches fit, their share of the volume, and how many fit apart."""
    pairs = [(F.col(f"v{a}"), F.col(f"p{a}")) for a in AXES]
    larger = sum(((p > v).cast("int") for v, p in pairs), F.lit(0))
    large = sum((((p <= v) & (p > v * PATCH_SHARE)).cast("int") for v, p in pairs), F.lit(0))
    apart = _product([F.floor(v / p).cast("long") for v, p in pairs])
    share = _product([p for _, p in pairs]) / _product([v for v, _ in pairs])
    return requests.withColumns({
        "valid": larger == 0, "axes_too_large": larger, "axes_large": large, "small": F.least(*(p for _, p in pairs)) < SMALL_PATCH,
        "n_apart": F.when(larger == 0, apart), "many": F.coalesce((larger == 0) & (F.col("n_patches") > apart * OVERLAP), F.lit(False)),
        "share": share, "advice": F.when(larger == 0, F.when(share < SPARSE, F.lit("larger")).when(share > DENSE, F.lit("smaller"))),
    })


def check_inputs(points: DataFrame, shape: Sequence[int], header: Sequence[int], matrix: Sequence[Sequence[float]]) -> DataFrame:
    """One row: whether volume and tractogram agree in size, and whether all points lie in the volume, by axis."""
    voxel = to_voxel(points, matrix)
    inside = {f"{a}_inside": F.coalesce(F.bool_and((F.col(a) >= 0) & (F.col(a) < n)), F.lit(True)) for a, n in zip(AXES, shape)}
    # distinct ids are few beside the points; they are counted by a second, small aggregation
    per = voxel.groupBy("streamline_id").agg(*(c.alias(k) for k, c in inside.items()))
    return per.agg(
        F.count("*").alias("n_streamlines"), *(F.coalesce(F.bool_and(k), F.lit(True)).alias(k) for k in inside)
    ).withColumns({
        "same_size": F.lit(list(shape) == list(header)), "few": F.col("n_streamlines") < FEW_LINES,
        "small_dim": F.lit(min(shape) < SMALL_DIM), "large_dim": F.lit(max(shape) > LARGE_DIM),
    })


def check_output(
    voxels: DataFrame, origin: Sequence[int], size: Sequence[int], header: Sequence[int],
    source: Sequence[Sequence[float]], matrix: Sequence[Sequence[float]], n_streamlines: int,
) -> DataFrame:
    """One row: whether a cropped patch (i, j, k, v) has its size, its place in the world, and something in it."""
    centre = np.append(np.asarray(size, float) / 2, 1.0)
    there = np.asarray(source, float) @ (centre + np.append(np.asarray(origin, float), 0.0))
    here = np.asarray(matrix, float) @ centre
    inside = F.coalesce(*(F.bool_and((F.col(c) >= 0) & (F.col(c) < n)) for c, n in zip("i", size[:1])), F.lit(True))
    for c, n in zip("jk", size[1:]):
        inside = inside & F.coalesce(F.bool_and((F.col(c) >= 0) & (F.col(c) < n)), F.lit(True))
    value = ~F.isnan("v") & F.col("v").isNotNull()
    return voxels.agg(
        inside.alias("inside"), F.lit(list(size) == list(header)).alias("same_size"),
        F.lit(bool(np.abs(there - here).max() <= AGREE)).alias("same_place"),
        (F.coalesce(F.bool_or(value & (F.col("v") != 0)), F.lit(False)) | F.lit(n_streamlines == 0)).alias("filled"),
    )


def require_paths(spark: SparkSession, *paths: str) -> None:
    """Raise for the first path that is missing, in any store that Spark reaches."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(conf).exists(place):
            raise FileNotFoundError(path)
