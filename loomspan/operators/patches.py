"""Patch and slice selection: boxes, counts, hashed sampling, grids, filters.

Points meet boxes through grid cells: a box lists the cells that it overlaps, a point has one cell, so the range join is
an equi-join on the cell with the exact test behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.maths import hashed_uniform
from loomspan.operators.streamlines import ordered, whole

AXES = ("x", "y", "z")


def boxes(spark: SparkSession, n: int, low: Sequence[float], high: Sequence[float], half: Sequence[float], seed: int = 42) -> DataFrame:
    """(patch_id, c*, lo*, hi*): boxes around ``n`` hashed centres, uniform where the whole box fits."""
    out = spark.range(n).select(F.col("id").alias("patch_id"))
    for a, lo, hi, h in zip(AXES, low, high, half):
        u = hashed_uniform(F.lit(seed), F.col("patch_id"), F.lit(a))
        out = out.withColumn(f"c{a}", F.lit(lo + h) + u * F.lit(hi - lo - 2 * h))
        out = out.withColumns({f"lo{a}": F.col(f"c{a}") - h, f"hi{a}": F.col(f"c{a}") + h})
    return out


def voxel_boxes(found: DataFrame, zoom: float) -> DataFrame:
    """Adds the voxel bounds of boxes: floor below, ceiling above."""
    return found.withColumns(
        {f"v{e}{a}": f(F.col(f"{e}{a}") / zoom).cast("int") for a in AXES for e, f in (("lo", F.floor), ("hi", F.ceil))}
    )


def in_box(points: DataFrame, found: DataFrame, cell: Sequence[float]) -> DataFrame:
    """(patch_id, streamline_id, point_idx) of points in boxes, bounds included."""
    gridded, placed = found, points
    for a, size in zip(AXES, cell):
        cells = F.sequence(F.floor(F.col(f"lo{a}") / size), F.floor(F.col(f"hi{a}") / size))
        gridded = gridded.withColumn(f"g{a}", F.explode(cells))
        placed = placed.withColumn(f"g{a}", F.floor(F.col(a) / size))
    joined = placed.join(gridded, [f"g{a}" for a in AXES])
    for a in AXES:
        joined = joined.where(F.col(a).between(F.col(f"lo{a}"), F.col(f"hi{a}")))
    return joined.select("patch_id", "streamline_id", "point_idx")


def counts(points: DataFrame, found: DataFrame, cell: Sequence[float]) -> DataFrame:
    """Streamlines with a point in each box."""
    hits = in_box(points, found, cell).groupBy("patch_id").agg(F.count_distinct("streamline_id").alias("n"))
    return found.select("patch_id").join(hits, "patch_id", "left").select("patch_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sample(points: DataFrame, attempts: DataFrame, wanted: int, least: int, cell: Sequence[float]) -> DataFrame:
    """The first ``wanted`` attempts, in order, with at least ``least`` streamlines; fewer if too few qualify."""
    return counts(points, attempts, cell).where(F.col("n") >= least).orderBy("patch_id").limit(wanted)


def best_trial(points: DataFrame, attempts: DataFrame, trials: int, least: int, cell: Sequence[float]) -> DataFrame:
    """Of every ``trials`` attempts one: the first that reaches ``least``, else the fullest, ties to the earliest."""
    found = counts(points, attempts, cell).withColumn("group_id", F.expr(f"patch_id div {trials}"))
    hit = F.col("n") >= least
    order = Window.partitionBy("group_id").orderBy(hit.desc(), F.when(hit, 0).otherwise(-F.col("n")), "patch_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("group_id", "patch_id", "n", hit.alias("reached"))


def grid_counts(points: DataFrame, size: Sequence[float], shape: Sequence[float]) -> DataFrame:
    """(gx, gy, gz, n), n > 0: streamlines per cell of a grid, each axis tested by itself; ``drawing.fullest_first`` ranks them.

    A streamline counts for the product of the cells it touches on each axis, which are its own distinct cells, so the
    cells are collected per streamline (a bounded number) and exploded, without a join.
    """
    sets = points
    for a, s, n in zip(AXES, size, shape):
        fits = (F.col(a) >= 0) & (F.col(a) < int(n // s) * s)
        sets = sets.withColumn(f"g{a}", F.when(fits, F.floor(F.col(a) / s).cast("int")))
    sets = sets.groupBy("streamline_id").agg(*(F.collect_set(f"g{a}").alias(f"g{a}") for a in AXES))
    for a in AXES:
        sets = sets.withColumn(f"g{a}", F.explode(f"g{a}"))
    return sets.groupBy("gx", "gy", "gz").agg(F.count("*").alias("n"))


def filter_patch(points: DataFrame, low: Sequence[float], high: Sequence[float], margin: float = 0.01, around: int = 1) -> DataFrame:
    """Streamlines that touch the shrunk box: points from ``around`` before the first hit to ``around`` after the last,
    shifted to the box and clamped to [0, size - 0.001]; two or more points."""
    hit = F.lit(True)
    for a, lo, hi in zip(AXES, low, high):
        hit = hit & F.col(a).between(lo + margin, hi - margin)
    idx = F.when(hit, F.col("point_idx"))
    out = points.withColumns({"first": F.min(idx).over(whole()), "last": F.max(idx).over(whole())})
    out = out.where((F.col("point_idx") >= F.col("first") - around) & (F.col("point_idx") <= F.col("last") + around))
    out = out.withColumn("n", F.count("*").over(whole())).where("n >= 2")
    moved = [F.least(F.greatest(F.col(a) - lo, F.lit(0.0)), F.lit(hi - lo - 0.001)).alias(a) for a, lo, hi in zip(AXES, low, high)]
    return out.select("streamline_id", "point_idx", *moved)


def filter_patch_legacy(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Two or more inside points; points from five before to five after; clamped to the box less 0.01; five or more."""
    hit = F.lit(True)
    for a, lo, hi in zip(AXES, low, high):
        hit = hit & (F.col(a) >= lo) & (F.col(a) < hi)
    idx = F.when(hit, F.col("point_idx"))
    out = points.withColumns({"first": F.min(idx).over(whole()), "last": F.max(idx).over(whole()), "hits": F.count(idx).over(whole())})
    out = out.where("hits >= 2 and point_idx between first - 5 and last + 5").withColumn("n", F.count("*").over(whole())).where("n >= 5")
    moved = [F.least(F.greatest(F.col(a) - lo, F.lit(0.0)), F.lit(hi - lo - 0.01)).alias(a) for a, lo, hi in zip(AXES, low, high)]
    return out.select("streamline_id", "point_idx", *moved)


def alignment(points: DataFrame, shape: Sequence[float]) -> DataFrame:
    """Share of points outside [0, shape), and whether it passes (at most 0.1 %) or warns."""
    outside = F.lit(False)
    for a, n in zip(AXES, shape):
        outside = outside | (F.col(a) < 0) | (F.col(a) >= n)
    got = points.agg(
        F.count("*").alias("n_points"), F.count_if(outside).alias("n_outside"), F.count_distinct("streamline_id").alias("n_streamlines")
    )
    share = F.col("n_outside") / F.col("n_points") * 100.0
    return got.withColumns({
        "percent_outside": share, "passes": share <= 0.1, "warns": (share > 0) | (F.col("n_streamlines") < 5),
    })


def slice_indices(points: DataFrame, axis: str, wanted: int, size: int) -> DataFrame:
    """(slice_idx): evenly spaced, cut to integers, distinct, within a padded range of the coordinate."""
    lo, hi = F.col("lo"), F.col("hi")
    ends = points.agg(F.min(axis).cast("int").alias("lo"), F.max(axis).cast("int").alias("hi"))
    pad = F.greatest(F.lit(5), ((hi - lo) * 0.2).cast("int"))
    ends = ends.select(F.greatest(F.lit(0), lo - pad).alias("a"), F.least(F.lit(size - 1), hi + pad).alias("b"))
    at = F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))).alias("m")
    spaced = (F.col("a") + F.col("m") * ((F.col("b") - F.col("a")) / F.lit(float(max(1, wanted - 1))))).cast("int")
    return ends.select("a", "b", at).select(F.least(spaced, F.lit(size - 1)).alias("slice_idx")).distinct()


def subdivisions(spark: SparkSession, n: int, shape: Sequence[int]) -> DataFrame:
    """(region, origin and size per axis): ceil(cube root of n) cells a side, fewer while g^3 > 2 n, cut to n."""
    g = 1
    while g**3 < n:
        g += 1
    while g > 1 and g**3 > 2 * n:
        g -= 1
    size = [max(1, s // g) for s in shape]
    cells = spark.range(min(n, g**3)).select(F.col("id").alias("region"))
    digits = (f"region div {g * g}", f"(region div {g}) % {g}", f"region % {g}")
    return cells.select(
        "region",
        *(F.expr(f"cast(({d}) * {s} as int)").alias(f"o{a}") for a, d, s in zip(AXES, digits, size)),
        *(F.lit(s).alias(f"s{a}") for a, s in zip(AXES, size)),
    )


def region_filter(points: DataFrame, origin: Sequence[float], size: Sequence[float], most: int = 50_000) -> DataFrame:
    """Whole streamlines with a point in the region, shifted to it; the first ``most`` by id."""
    hit = F.lit(True)
    for a, o, s in zip(AXES, origin, size):
        hit = hit & (F.col(a) >= o) & (F.col(a) < o + s)
    ids = points.where(hit).select("streamline_id").distinct().orderBy("streamline_id").limit(most)
    kept = points.join(ids, "streamline_id", "left_semi")
    return kept.select("streamline_id", "point_idx", *((F.col(a) - o).alias(a) for a, o in zip(AXES, origin)))


def quota(files: DataFrame, wanted: int) -> DataFrame:
    """(file_id, quota): ``wanted`` patches dealt evenly, the remainder to the first files."""
    ids = files.select("file_id").distinct()
    share, rest = divmod(wanted, max(1, ids.count()))
    first = ids.orderBy("file_id").limit(rest).withColumn("extra", F.lit(1))
    given = F.lit(share) + F.coalesce("extra", F.lit(0))
    return ids.join(first, "file_id", "left").select("file_id", given.cast("int").alias("quota"))


def isolated(points: DataFrame, axis: str, at: float, radius: float, least: int, near: float = 0.5) -> DataFrame:
    """Streamlines that touch the slice and whose median point there has at least ``least`` others within ``radius``.

    If none touches the slice all are returned. Neighbours are found through cells of the radius' size.
    """
    touch = points.where(F.abs(F.col(axis) - at) <= near)
    if touch.isEmpty():
        return points.select("streamline_id").distinct()
    mid = touch.groupBy("streamline_id").agg(*(F.median(a).alias(a) for a in AXES))
    own = mid.select("streamline_id", *AXES, *(F.floor(F.col(a) / radius).alias(f"g{a}") for a in AXES))
    around = own.select(F.col("streamline_id").alias("other"), *(F.col(a).alias(f"o{a}") for a in AXES), *(f"g{a}" for a in AXES))
    for a in AXES:
        around = around.withColumn(f"g{a}", F.explode(F.sequence(F.col(f"g{a}") - 1, F.col(f"g{a}") + 1)))
    gap = sum(((F.col(a) - F.col(f"o{a}")) ** 2 for a in AXES), F.lit(0.0))
    pairs = own.join(around, [f"g{a}" for a in AXES]).where((gap <= radius * radius) & (F.col("streamline_id") != F.col("other")))
    kept = pairs.groupBy("streamline_id").agg(F.count("*").alias("n_near")).where(F.col("n_near") >= least).select("streamline_id")
    return kept


def in_mask(points: DataFrame, mask: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Adds whether the truncated (x, z) of a point, clamped to the shape, is in ``mask`` (i, k)."""
    cell = lambda a, n: F.least(F.greatest(F.col(a).cast("int"), F.lit(0)), F.lit(n - 1))
    keyed = points.withColumns({"mi": cell("x", shape[0]), "mk": cell("z", shape[2])})
    marked = mask.select(F.col("i").alias("mi"), F.col("k").alias("mk"), F.lit(True).alias("marked")).distinct()
    return keyed.join(marked, ["mi", "mk"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def mask_streamlines(points: DataFrame, mask: DataFrame, shape: Sequence[int], at: float, near: float = 0.5) -> DataFrame:
    """Streamlines with a point near the slice that falls in the mask."""
    hits = in_mask(points.where(F.abs(F.col("y") - at) <= near), mask, shape)
    return hits.where("marked").select("streamline_id").distinct()


def mask_segments(points: DataFrame, mask: DataFrame, shape: Sequence[int]) -> DataFrame:
    """(streamline_id, point_idx) of segments with either end in the mask."""
    order = ordered()
    out = in_mask(points, mask, shape).withColumn("next", F.lead("marked").over(order))
    return out.where("next is not null and (marked or next)").select("streamline_id", "point_idx")


def density_ladder(spark: SparkSession, n: int, low: float, high: float) -> DataFrame:
    """(step, percent): n values from low to high; the middle if there is one."""
    value = F.lit((low + high) / 2) if n == 1 else F.lit(low) + F.col("id") * F.lit((high - low) / (n - 1))
    return spark.range(n).select(F.col("id").cast("int").alias("step"), value.alias("percent"))

