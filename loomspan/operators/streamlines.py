"""Streamline operators: affine maps, differential metrics, clipping, densification, filters.

Points are rows (streamline_id, point_idx, x, y, z). Everything runs over windows of one streamline, so one shuffle by
streamline_id serves a whole chain of operators.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomspan.functions.maths import norm

AXES = ("x", "y", "z")


def whole() -> WindowSpec:
    """A streamline."""
    return Window.partitionBy("streamline_id")


def ordered() -> WindowSpec:
    """A streamline in the order of its points."""
    return whole().orderBy("point_idx")


def affine(points: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Homogeneous product with a 4 x 4 matrix; its entries become literals."""
    rows = [[float(v) for v in row] for row in matrix]
    mapped = {a: sum((F.col(b) * m for b, m in zip(AXES, row[:3])), F.lit(0.0)) + row[3] for a, row in zip(AXES, rows)}
    return points.withColumns(mapped)


def to_voxel(points: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """World to voxel coordinates: the product with the inverse."""
    return affine(points, np.linalg.inv(np.asarray(matrix, float)).tolist())


def segments(points: DataFrame) -> DataFrame:
    """Adds the next point (nx, ny, nz), the segment's length d, and the arc length s where it starts."""
    out = points.withColumns({f"n{a}": F.lead(a).over(ordered()) for a in AXES})
    out = out.withColumn("d", F.coalesce(norm(*(F.col(f"n{a}") - F.col(a) for a in AXES)), F.lit(0.0)))
    return out.withColumn("s", F.sum("d").over(ordered().rowsBetween(Window.unboundedPreceding, -1))).fillna({"s": 0.0})


def lengths(points: DataFrame) -> DataFrame:
    return segments(points).groupBy("streamline_id").agg(F.count("*").alias("n_points"), F.sum("d").alias("length"))


def _gradient(df: DataFrame, names: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Central differences, one-sided at both ends."""
    def at(c: str) -> Column:
        back, ahead = F.lag(c).over(ordered()), F.lead(c).over(ordered())
        return F.when(back.isNull(), ahead - F.col(c)).when(ahead.isNull(), F.col(c) - back).otherwise((ahead - back) / 2.0)

    return df.withColumns({o: at(c) for c, o in zip(names, out)})


def frames(points: DataFrame, eps: float = 1e-10, floor: float = 1e-10) -> DataFrame:
    """Adds unit tangents t*, their derivative b* and curvature; streamlines under three points are left out."""
    out = points.withColumn("n_points", F.count("*").over(whole())).where("n_points >= 3")
    out = _gradient(out, AXES, ("gx", "gy", "gz"))
    size = norm(F.col("gx"), F.col("gy"), F.col("gz"))
    out = out.withColumn("g", F.when(size > eps, size).otherwise(F.lit(floor)))
    out = out.withColumns({f"t{a}": F.col(f"g{a}") / F.col("g") for a in AXES})
    out = _gradient(out, ("tx", "ty", "tz"), ("bx", "by", "bz"))
    return out.withColumn("curvature", norm(F.col("bx"), F.col("by"), F.col("bz")))


def curvature(points: DataFrame) -> DataFrame:
    """Mean and maximum curvature of each streamline."""
    return frames(points).groupBy("streamline_id").agg(
        F.avg("curvature").alias("mean_curvature"), F.max("curvature").alias("max_curvature")
    )


def torsion(points: DataFrame) -> DataFrame:
    """Mean absolute torsion over all points; ends and straight places count as zero; more than three points needed."""
    out = frames(points, 1e-12, 1.0).where("n_points > 3")
    out = _gradient(out, ("bx", "by", "bz"), ("ux", "uy", "uz"))
    cross = (
        F.col("ty") * F.col("bz") - F.col("tz") * F.col("by"),
        F.col("tz") * F.col("bx") - F.col("tx") * F.col("bz"),
        F.col("tx") * F.col("by") - F.col("ty") * F.col("bx"),
    )
    out = out.withColumns(dict(zip(("cx", "cy", "cz"), cross)))
    size = norm(F.col("cx"), F.col("cy"), F.col("cz"))
    inner = (F.col("point_idx") > F.min("point_idx").over(whole())) & (F.col("point_idx") < F.max("point_idx").over(whole()))
    dot = F.col("cx") * F.col("ux") + F.col("cy") * F.col("uy") + F.col("cz") * F.col("uz")
    out = out.withColumn("torsion", F.when(inner & (size > 1e-12), dot / (size * size)).otherwise(F.lit(0.0)))
    return out.groupBy("streamline_id").agg(F.avg(F.abs("torsion")).alias("mean_torsion"))


def metrics(points: DataFrame) -> DataFrame:
    """Point count, length, mean and maximum curvature per streamline."""
    return lengths(points).join(curvature(points), "streamline_id", "left")


def adaptive_step(points: DataFrame, step: float, low: float = 0.15, high: float = 0.35, bend: float = 0.05) -> DataFrame:
    """The step that densification uses: the median segment within bounds, where mean curvature is above ``bend``."""
    own = segments(points).groupBy("streamline_id").agg(F.median(F.when(F.col("nx").isNotNull(), F.col("d"))).alias("median_d"))
    # a single point has no segment: the middle of the bounds
    best = F.when(F.col("median_d").isNull(), F.lit((low + high) / 2)).otherwise(F.least(F.greatest(F.col("median_d"), F.lit(low)), F.lit(high)))
    joined = own.join(curvature(points), "streamline_id", "left")
    return joined.select(
        "streamline_id",
        F.when(F.coalesce("mean_curvature", F.lit(0.0)) > bend, F.greatest(F.lit(step), best)).otherwise(F.lit(step)).alias("step"),
    )


def inside(shape: Sequence[float]) -> Column:
    out = F.lit(True)
    for a, n in zip(AXES, shape):
        out = out & (F.col(a) >= 0) & (F.col(a) < n)
    return out


def boundary_point(here: Sequence[Column], there: Sequence[Column], shape: Sequence[float]) -> list[Column]:
    """Where the segment from ``here`` (inside) to ``there`` (outside) leaves the box, clamped to [0, shape - 1]."""
    steps = []
    for p, q, n in zip(here, there, shape):
        move = q - p
        t = F.when(q < 0, (F.lit(0.0) - p) / move).when(q >= n, (F.lit(n - 1.0) - p) / move)
        steps.append(F.when((F.abs(move) > 1e-10) & (t >= 0) & (t <= 1), t))
    t = F.coalesce(F.least(*steps), F.lit(0.0))
    return [F.greatest(F.lit(0.0), F.least(p + t * (q - p), F.lit(n - 1.0))) for p, q, n in zip(here, there, shape)]


def clip_segments(points: DataFrame, shape: Sequence[float]) -> DataFrame:
    """(streamline_id, seg_start, kind, pos, x, y, z): runs inside the box, and pieces from or to its boundary.

    kind 0: a run of two or more inside points; 1: last inside point and boundary; 2: boundary and first inside point.
    A single outside point between inside points gives its exit piece only.
    """
    out = points.withColumn("inside", inside(shape))
    out = out.withColumn("run", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(ordered()))
    out = out.withColumns({f"p{a}": F.lag(a).over(ordered()) for a in AXES} | {f"n{a}": F.lead(a).over(ordered()) for a in AXES})
    out = out.withColumns({"was": F.lag("inside").over(ordered()), "will": F.lead("inside").over(ordered())})
    own = Window.partitionBy("streamline_id", "run", "inside")
    runs = (
        out.where("inside")
        .withColumns({"n": F.count("*").over(own), "seg_start": F.min("point_idx").over(own)})
        .where("n >= 2")
        .select("streamline_id", "seg_start", F.lit(0).alias("kind"), (F.col("point_idx") - F.col("seg_start")).alias("pos"), *AXES)
    )
    outside = out.where("not inside")
    here, past, ahead = ([F.col(p + a) for a in AXES] for p in ("", "p", "n"))
    named = lambda pos, cols: F.struct(F.lit(pos).alias("pos"), *(c.alias(a) for c, a in zip(cols, AXES)))
    leave = F.array(named(0, past), named(1, boundary_point(past, here, shape)))
    enter = F.array(named(0, boundary_point(ahead, here, shape)), named(1, ahead))
    kind = F.when(F.col("was"), F.lit(1)).when(F.col("will"), F.lit(2))
    pieces = (
        outside.select("streamline_id", F.col("point_idx").alias("seg_start"), kind.alias("kind"),
                       F.when(F.col("was"), leave).when(F.col("will"), enter).alias("both"))
        .where("kind is not null")
        .select("streamline_id", "seg_start", "kind", F.explode("both").alias("e"))
        .select("streamline_id", "seg_start", "kind", "e.*")
    )
    return runs.unionByName(pieces)


def clip_joined(points: DataFrame, shape: Sequence[float]) -> DataFrame:
    """Outside points dropped, the rest joined to one polyline of two or more points, renumbered."""
    kept = points.where(inside(shape)).withColumns(
        {"pos": F.row_number().over(ordered()) - 1, "n": F.count("*").over(whole())}
    )
    return kept.where("n >= 2").select("streamline_id", "pos", *AXES)


def slab_clip(points: DataFrame, center: float, half: float) -> DataFrame:
    """(streamline_id, seg_start, pos, x, y, z): runs within the slab along y, each with the point where it leaves."""
    low, high = center - half, center + half
    out = points.withColumn("inside", F.col("y").between(low, high))
    out = out.withColumn("run", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(ordered()))
    out = out.withColumns({f"p{a}": F.lag(a).over(ordered()) for a in AXES} | {"was": F.lag("inside").over(ordered())})
    t = (F.when(F.col("y") < low, F.lit(low)).otherwise(F.lit(high)) - F.col("py")) / (F.col("y") - F.col("py"))
    leaving = [(F.col(f"p{a}") + t * (F.col(a) - F.col(f"p{a}"))).alias(a) for a in AXES]
    kept = out.where("inside").select("streamline_id", "point_idx", "run", *AXES).unionByName(
        out.where("not inside and was").select("streamline_id", "point_idx", (F.col("run") - 1).alias("run"), *leaving)
    )
    own = Window.partitionBy("streamline_id", "run")
    kept = kept.withColumns({
        "n": F.count("*").over(own), "seg_start": F.min("point_idx").over(own),
        "pos": F.row_number().over(own.orderBy("point_idx")) - 1,
    })
    return kept.where("n >= 2").select("streamline_id", "seg_start", "pos", *AXES)


def slab_rule(points: DataFrame, center: float, half: float, short: int = 5) -> DataFrame:
    """Streamlines of up to ``short`` points whole if any point is in the slab, longer ones clipped."""
    counted = points.withColumn("n", F.count("*").over(whole()))
    hit = F.max(F.abs(F.col("y") - center) <= half).over(whole())
    kept = counted.where(F.col("n") <= short).withColumn("hit", hit).where("hit").select(
        "streamline_id", F.lit(0).alias("seg_start"), F.col("point_idx").alias("pos"), *AXES
    )
    return kept.unionByName(slab_clip(counted.where(F.col("n") > short).drop("n"), center, half))


def bounds_keep(points: DataFrame, low: Sequence[float], high: Sequence[float], inclusive: bool = False) -> DataFrame:
    """Streamlines with, on each axis by itself, a point at or above ``low`` and one below (``inclusive``: or at) ``high``."""
    tests = [F.max(F.col(a) >= lo) & F.max(F.col(a) <= hi if inclusive else F.col(a) < hi) for a, lo, hi in zip(AXES, low, high)]
    return points.groupBy("streamline_id").agg((tests[0] & tests[1] & tests[2]).alias("keep")).where("keep").select("streamline_id")


def transform_and_densify(points: DataFrame, matrix: Sequence[Sequence[float]], shape: Sequence[float], step: float, method: str = "linear") -> DataFrame:
    """World points to voxels, without points that are not finite or lie outside, joined to lines of two or more, densified."""
    voxel = to_voxel(points, matrix)
    for a in AXES:
        voxel = voxel.where(F.col(a).isNotNull() & (F.abs(a) < float("inf")))  # NaN compares above infinity
    return densify(clip_joined(voxel, shape).withColumnRenamed("pos", "point_idx"), step, method)


def densify(points: DataFrame, step: float, method: str = "linear", count: str = "ceil") -> DataFrame:
    """Points at equal arc lengths; methods linear, hermite, catmull. A streamline shorter than ``step`` is unchanged.

    ``count``: "ceil" gives ceil(L / step) + 1 points, "floor" max(int(L / step), 2). The new points of each segment are
    generated from the segment itself, so no join is needed to find the bracketing pair.
    """
    out = segments(points).withColumns({"total": F.max(F.col("s") + F.col("d")).over(whole()), "n_points": F.count("*").over(whole())})
    out = out.withColumn("last", F.col("point_idx") == F.max("point_idx").over(whole()))
    unchanged = out.where((F.col("total") < step) | (F.col("n_points") < 2)).select(
        "streamline_id", F.col("point_idx").alias("pos"), *AXES
    )
    n = F.ceil(F.col("total") / step) + 1 if count == "ceil" else F.greatest(F.floor(F.col("total") / step), F.lit(2))
    out = out.where((F.col("total") >= step) & (F.col("n_points") >= 2)).withColumn("n", n.cast("long"))
    if method != "linear":
        out = _tangents(out, step, method)
    gap = F.col("total") / (F.col("n") - 1)
    # positions q = gap * m from s to before the next point's s; the last position belongs to the last segment with a length
    out = out.withColumns({"ns": F.lead("s").over(ordered()), "last_long": F.max(F.when(F.col("d") > 0, F.col("point_idx"))).over(whole())})
    final = F.col("point_idx") == F.col("last_long")
    out = out.where("not last and d > 0").withColumns({
        "lo": F.ceil(F.col("s") / gap), "hi": F.when(final, F.col("n") - 1).otherwise(F.ceil(F.col("ns") / gap) - 1),
    })
    out = out.where("lo <= hi").withColumn("pos", F.explode(F.sequence("lo", "hi")))
    u = F.least(F.greatest((F.col("pos") * gap - F.col("s")) / F.col("d"), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("u", u)
    if method == "linear":
        found = [(F.col(a) + F.col("u") * (F.col(f"n{a}") - F.col(a))).alias(a) for a in AXES]
    else:
        u, h = F.col("u"), F.col("d") / F.col("total")
        found = [
            ((2 * u**3 - 3 * u**2 + 1) * F.col(a) + (u**3 - 2 * u**2 + u) * h * F.col(f"m{a}")
             + (-2 * u**3 + 3 * u**2) * F.col(f"n{a}") + (u**3 - u**2) * h * F.col(f"nm{a}")).alias(a)
            for a in AXES
        ]
    return out.select("streamline_id", F.col("pos").cast("int").alias("pos"), *found).unionByName(unchanged)


def _tangents(out: DataFrame, step: float, method: str) -> DataFrame:
    """Adds tangents m* at each point and nm* at the next one, scaled as for a curve over normalised arc length."""
    ends = F.lag("x").over(ordered()).isNull(), F.col("last")
    raw = {}
    for a in AXES:
        back, ahead = F.lag(a).over(ordered()), F.lead(a).over(ordered())
        centre = (ahead - back) * (0.5 if method == "catmull" else 1.0)
        raw[f"r{a}"] = F.when(ends[0], ahead - F.col(a)).when(ends[1], F.col(a) - back).otherwise(centre)
    out = out.withColumns(raw).withColumn("r", norm(F.col("rx"), F.col("ry"), F.col("rz")))
    if method == "catmull":
        scale = F.lit(3.0 * step)
    else:
        before = F.lag("d").over(ordered())
        mean = F.avg("d").over(ordered().rowsBetween(-2, 0))
        scale = 2.0 * F.when(ends[0], F.col("d")).when(ends[1], before).otherwise(mean)
    out = out.withColumn("k", F.when(F.col("r") > 1e-10, scale / F.col("r")).otherwise(F.lit(1.0)))
    out = out.withColumns({f"m{a}": F.col(f"r{a}") * F.col("k") for a in AXES})
    return out.withColumns({f"nm{a}": F.lead(f"m{a}").over(ordered()) for a in AXES})


def compare_methods(points: DataFrame, step: float) -> DataFrame:
    """Totals and means of length and curvature for the points as they are and densified by each method."""
    named = {"original": points.withColumnRenamed("point_idx", "pos")}
    named |= {m: densify(points, step, m) for m in ("linear", "hermite")}
    out = None
    for name, df in named.items():
        own = metrics(df.withColumnRenamed("pos", "point_idx")).agg(
            F.count("*").alias("n_streamlines"), F.sum("n_points").alias("n_points"), F.avg("length").alias("mean_length"),
            F.avg("mean_curvature").alias("mean_curvature"), F.max("max_curvature").alias("max_curvature"),
        ).select(F.lit(name).alias("method"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def top_outliers(a: DataFrame, b: DataFrame, top: int = 5) -> DataFrame:
    """The streamlines whose points differ most, on average over their common prefix."""
    other = b.select("streamline_id", "pos", *(F.col(c).alias(f"o{c}") for c in AXES))
    gap = norm(*(F.col(c) - F.col(f"o{c}") for c in AXES))
    return (
        a.join(other, ["streamline_id", "pos"]).groupBy("streamline_id").agg(F.round(F.avg(gap), 6).alias("mean_distance"))
        .orderBy(F.desc("mean_distance"), "streamline_id").limit(top)
    )


def mirror(points: DataFrame, axis: str, center: float) -> DataFrame:
    return points.withColumn(axis, 2 * F.lit(center) - F.col(axis))


def sample_percent(points: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """max(1, int(n p / 100)) streamlines, those with the least md5 of seed and id; 100 % or more keeps all."""
    ids = points.select("streamline_id").distinct()
    if percent >= 100:
        return ids
    n = F.greatest(F.lit(1), F.floor(ids.count() * F.lit(percent) / 100)).cast("int")
    take = ids.sparkSession.range(1).select(n.alias("n")).first()["n"]
    return ids.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "streamline_id")), "streamline_id").limit(take)


def prefix_percent(points: DataFrame, percent: float) -> DataFrame:
    ids = points.select("streamline_id").distinct()
    return ids.orderBy("streamline_id").limit(int(ids.count() * percent / 100))


def profile(points: DataFrame) -> DataFrame:
    """Counts, points a streamline, coordinate ranges, and whether coordinates look like world coordinates."""
    per = points.groupBy("streamline_id").agg(
        F.count("*").alias("n"), *(f(a).alias(f"{f.__name__}_{a}") for a in AXES for f in (F.min, F.max))
    )
    ranges = [f(f"{f.__name__}_{a}").alias(f"{f.__name__}_{a}") for a in AXES for f in (F.min, F.max)]
    out = per.agg(
        F.count("*").alias("n_streamlines"), F.sum("n").alias("n_points"), F.avg("n").alias("avg_points"),
        F.min("n").alias("min_points"), F.max("n").alias("max_points"), *ranges,
    )
    most = F.greatest(*(F.abs(F.col(f"{m}_{a}")) for a in AXES for m in ("min", "max")))
    return out.withColumn("is_world", most > 1000)


def densify_rbf(points: DataFrame, step: float, smoothing: float = 1e-6) -> DataFrame:
    """Thin-plate spline over arc length per streamline, scaled about its mean to keep the length.

    Under four points, or shorter than ``step``: unchanged. A dense solve per streamline, so it runs in Arrow batches of
    one streamline.
    """
    import pyarrow as pa

    def solve(s: np.ndarray, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        # arc length is brought to [0, 1]; kernel r^2 log r with a linear trend, smoothing on the diagonal
        s, at = s / s[-1], at / s[-1]
        kernel = lambda r: np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1.0)), 0.0)
        n = len(s)
        system = np.zeros((n + 2, n + 2))
        system[:n, :n] = kernel(np.abs(s[:, None] - s)) + smoothing * np.eye(n)
        system[:n, n:] = np.stack([np.ones(n), s], 1)
        system[n:, :n] = system[:n, n:].T
        weight = np.linalg.solve(system, np.vstack([p, np.zeros((2, 3))]))
        return kernel(np.abs(at[:, None] - s)) @ weight[:n] + np.stack([np.ones(len(at)), at], 1) @ weight[n:]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_idx")
        p = np.stack([table.column(a).to_numpy() for a in AXES], 1)
        d = np.linalg.norm(np.diff(p, axis=0), axis=1)
        total = d.sum()
        if len(p) >= 4 and total >= step:
            keep = np.concatenate(([True], d > 0))
            s = np.concatenate(([0.0], np.cumsum(d)))
            p = solve(s[keep], p[keep], np.linspace(0, total, max(int(np.ceil(total / step)), 2)))
            size = np.linalg.norm(np.diff(p, axis=0), axis=1).sum()
            if size > 0:
                p = p.mean(0) + (p - p.mean(0)) * (total / size)
        first = table.column("streamline_id")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array([first] * len(p), pa.int64()), pa.array(np.arange(len(p)), pa.int32()), *(pa.array(c) for c in p.T)],
            ["streamline_id", "pos", *AXES],
        )

    doubles = points.select("streamline_id", "point_idx", *(F.col(a).cast("double").alias(a) for a in AXES))
    return doubles.groupBy("streamline_id").applyInArrow(run, "streamline_id long, pos int, x double, y double, z double")
