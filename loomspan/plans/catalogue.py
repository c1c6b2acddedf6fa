"""Every registered query of the engine, by name, with its SQL counterpart where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import images, patches, raster, streamlines, volumes
from loomspan.plans.model import FOV, PIXELS_SQL, POINTS_SQL, SHAPE, VOXELS_SQL, pixels, points, rounded, uniform_sql, voxels

QUERIES = {}
ORACLE = {}

AFFINE = [[2.0, 0.1, 0.0, -5.0], [0.0, 1.5, 0.2, 3.0], [0.1, 0.0, 1.2, 1.0], [0.0, 0.0, 0.0, 1.0]]
STEP, VIEW_STEP = 50.0, 120.0
LOW, HIGH = (20.0, 10.0, 4.0), (180.0, 60.0, 16.0)
CELL = (40.0, 20.0, 6.0)
BOX = {"low": (0.0, 0.0, 0.0), "high": (200.0, 100.0, 24.0), "half": (15.0, 15.0, 4.0)}
IMG = (8, 8)


def query(source, sql: str | None = None):
    """Register a function of the source table's DataFrame under its own name."""

    def keep(build):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(build(source(spark, sf_dir)))
        if sql:
            ORACLE[name] = sql
        return build

    return keep


# SQL pieces


#: Added before rounding where exact ties occur, so that both engines round them up.
NUDGE = 1e-9


def nudged(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n) + NUDGE for n in names})


def nudged_sql(*names: str) -> str:
    return ", ".join(f"round({n} + {NUDGE}, 6) + 0.0 as {n}" for n in names)


def rnd(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n.split('.')[-1]}" for n in names)


W = "(partition by streamline_id order by point_idx)"
SEGS = f"""segs as (select *, coalesce(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)), 0.0) as d from (
  select *, lead(x) over {W} as nx, lead(y) over {W} as ny, lead(z) over {W} as nz from points))"""
ARC = """arc0 as (select *, coalesce(sum(d) over (partition by streamline_id order by point_idx rows between unbounded preceding and 1 preceding), 0.0) as s,
  count(*) over (partition by streamline_id) as n_points, max(point_idx) over (partition by streamline_id) as last_idx from segs),
arc as (select *, max(s + d) over (partition by streamline_id) as total from arc0)"""


def grad(src: str, dst: str, cols: str, outs: str) -> str:
    parts = [
        f"case when lag({c}) over {W} is null then lead({c}) over {W} - {c} when lead({c}) over {W} is null then {c} - lag({c}) over {W} "
        f"else (lead({c}) over {W} - lag({c}) over {W}) / 2.0 end as {o}"
        for c, o in zip(cols.split(), outs.split())
    ]
    return f"{dst} as (select *, {', '.join(parts)} from {src})"


def frames_sql(eps: str, floor: str) -> str:
    return ",\n".join([
        "f0 as (select * from (select *, count(*) over (partition by streamline_id) as np from points) where np >= 3)",
        grad("f0", "f1", "x y z", "gx gy gz"),
        f"f2 as (select *, case when sqrt(gx * gx + gy * gy + gz * gz) > {eps} then sqrt(gx * gx + gy * gy + gz * gz) else {floor} end as g from f1)",
        "f3 as (select *, gx / g as tx, gy / g as ty, gz / g as tz from f2)",
        grad("f3", "f4", "tx ty tz", "bx by_ bz"),
        "frames as (select *, sqrt(bx * bx + by_ * by_ + bz * bz) as curvature from f4)",
    ])


CURV = frames_sql("1e-10", "1e-10")
CURVES = "curves as (select streamline_id, avg(curvature) as mean_curvature, max(curvature) as max_curvature from frames group by 1)"
LENGTHS = "lengths as (select streamline_id, count(*) as n_points, sum(d) as length from segs group by 1)"


def with_points(*ctes: str) -> str:
    return "with " + ",\n".join([POINTS_SQL, *ctes]) + "\n"


# streamlines


def _linear(m, names=("x", "y", "z")) -> str:
    return ", ".join(
        f"round(0.0 + x * {row[0]!r} + y * {row[1]!r} + z * {row[2]!r} + {row[3]!r}, 6) + 0.0 as {n}" for n, row in zip(names, m)
    )


_INVERSE = np.linalg.inv(np.asarray(AFFINE)).tolist()
_AFF = [[float(v) for v in r] for r in AFFINE]


@query(points, with_points() + f"select streamline_id, point_idx, {_linear(_INVERSE)} from points")
def affine_to_voxel(p: DataFrame) -> DataFrame:
    return streamlines.to_voxel(p, AFFINE)


@query(points, with_points() + f"select streamline_id, point_idx, {_linear(_AFF)} from points")
def voxel_to_ras(p: DataFrame) -> DataFrame:
    return streamlines.affine(p, AFFINE)


@query(points, with_points(SEGS, LENGTHS) + f"select streamline_id, n_points, {rnd('length')} from lengths")
def streamline_length(p: DataFrame) -> DataFrame:
    return streamlines.lengths(p)


@query(points, with_points(CURV, CURVES) + f"select streamline_id, {rnd('mean_curvature', 'max_curvature')} from curves")
def streamline_curvature(p: DataFrame) -> DataFrame:
    return streamlines.curvature(p)


@query(points, with_points(frames_sql("1e-12", "1.0"), grad("frames", "t1", "bx by_ bz", "ux uy uz"), """t2 as (select *, ty * bz - tz * by_ as cx, tz * bx - tx * bz as cy, tx * by_ - ty * bx as cz,
  min(point_idx) over (partition by streamline_id) as lo, max(point_idx) over (partition by streamline_id) as hi from t1 where np > 3),
t3 as (select *, sqrt(cx * cx + cy * cy + cz * cz) as size from t2)""") + """select streamline_id, round(avg(abs(case when point_idx > lo and point_idx < hi and size > 1e-12
  then (cx * ux + cy * uy + cz * uz) / (size * size) else 0.0 end)), 6) + 0.0 as mean_torsion from t3 group by 1""")  # fmt: skip
def streamline_torsion(p: DataFrame) -> DataFrame:
    return streamlines.torsion(p)


@query(points, with_points(SEGS, LENGTHS, CURV, CURVES) + f"""select l.streamline_id, l.n_points, {rnd('l.length', 'c.mean_curvature', 'c.max_curvature')}
from lengths l left join curves c using (streamline_id)""")
def tract_metrics(p: DataFrame) -> DataFrame:
    return streamlines.metrics(p)


@query(points, with_points(SEGS, CURV, CURVES) + """select s.streamline_id, round(case when coalesce(max(mean_curvature), 0.0) > 0.05
  then greatest(0.2, least(greatest(median(d), 0.15), 0.35)) else 0.2 end, 6) as step
from segs s left join curves c using (streamline_id) where nx is not null group by 1""")
def adaptive_step(p: DataFrame) -> DataFrame:
    return streamlines.adaptive_step(p, 0.2)


@query(points, with_points() + """select count(distinct streamline_id) as n_streamlines, count(*) as n_points,
  round(count(*) / count(distinct streamline_id), 6) as avg_points, (select min(n) from (select count(*) as n from points group by streamline_id)) as min_points,
  (select max(n) from (select count(*) as n from points group by streamline_id)) as max_points,
  round(min(x), 6) as min_x, round(max(x), 6) as max_x, round(min(y), 6) as min_y, round(max(y), 6) as max_y, round(min(z), 6) as min_z, round(max(z), 6) as max_z,
  greatest(max(abs(x)), max(abs(y)), max(abs(z))) > 1000 as is_world from points""")
def tractogram_profile(p: DataFrame) -> DataFrame:
    return streamlines.profile(p).withColumn("n_points", F.col("n_points").cast("long"))


_INSIDE = " and ".join(f"{a} >= 0 and {a} < {n!r}" for a, n in zip("xyz", FOV))


def _leave(p: str, q: str) -> list[str]:
    """SQL of the boundary point from columns p* (inside) to q* (outside)."""
    ts = []
    for a, n in zip("xyz", FOV):
        u, v = f"{p}{a}", f"{q}{a}"
        t = f"case when {v} < 0 then (0.0 - {u}) / ({v} - {u}) when {v} >= {n!r} then ({n - 1.0!r} - {u}) / ({v} - {u}) end"
        ts.append(f"case when abs({v} - {u}) > 1e-10 and ({t}) >= 0 and ({t}) <= 1 then {t} end")
    t = f"coalesce(least({', '.join(ts)}), 0.0)"
    return [f"greatest(0.0, least({p}{a} + {t} * ({q}{a} - {p}{a}), {n - 1.0!r}))" for a, n in zip("xyz", FOV)]


_PAST, _AHEAD = _leave("p", ""), _leave("n", "")
_CLIP = f"""c0 as (select *, {_INSIDE} as inside from points),
c1 as (select *, sum(case when inside then 0 else 1 end) over {W} as run, {', '.join(f'lag({a}) over {W} as p{a}, lead({a}) over {W} as n{a}' for a in 'xyz')},
  lag(inside) over {W} as was, lead(inside) over {W} as will from c0),
runs as (select *, count(*) over (partition by streamline_id, run) as n, min(point_idx) over (partition by streamline_id, run) as seg_start from c1 where inside),
o as (select *, case when was then 1 when will then 2 end as kind from c1 where not inside),
clip as (
  select streamline_id, seg_start, 0 as kind, point_idx - seg_start as pos, x, y, z from runs where n >= 2
  union all select streamline_id, point_idx, 1, 0, px, py, pz from o where kind = 1
  union all select streamline_id, point_idx, 1, 1, {', '.join(_PAST)} from o where kind = 1
  union all select streamline_id, point_idx, 2, 0, {', '.join(_AHEAD)} from o where kind = 2
  union all select streamline_id, point_idx, 2, 1, nx, ny, nz from o where kind = 2)"""


@query(points, with_points(_CLIP) + f"select streamline_id, seg_start, cast(kind as integer) as kind, cast(pos as integer) as pos, {nudged_sql('x', 'y', 'z')} from clip")
def fov_clip_segments(p: DataFrame) -> DataFrame:
    return nudged(streamlines.clip_segments(p, FOV), "x", "y", "z")


@query(points, with_points() + f"""select streamline_id, cast(pos as integer) as pos, {rnd('x', 'y', 'z')} from (select *, row_number() over {W} - 1 as pos,
  count(*) over (partition by streamline_id) as n from points where {_INSIDE}) where n >= 2""")
def fov_clip_filtered(p: DataFrame) -> DataFrame:
    return streamlines.clip_joined(p, FOV)


def _slab(src: str) -> str:
    t = "((case when y < 25.0 then 25.0 else 55.0 end) - py) / (y - py)"
    return f"""s0 as (select *, y between 25.0 and 55.0 as inside from {src}),
s1 as (select *, sum(case when inside then 0 else 1 end) over {W} as run, lag(x) over {W} as px, lag(y) over {W} as py, lag(z) over {W} as pz, lag(inside) over {W} as was from s0),
s2 as (select streamline_id, point_idx, run, x, y, z from s1 where inside union all
  select streamline_id, point_idx, run - 1, px + {t} * (x - px), py + {t} * (y - py), pz + {t} * (z - pz) from s1 where not inside and was),
slab as (select streamline_id, min(point_idx) over (partition by streamline_id, run) as seg_start,
  cast(row_number() over (partition by streamline_id, run order by point_idx) - 1 as integer) as pos, count(*) over (partition by streamline_id, run) as n, x, y, z from s2)"""


@query(points, with_points(_slab("points")) + f"select streamline_id, seg_start, pos, {rnd('x', 'y', 'z')} from slab where n >= 2")
def slab_clip(p: DataFrame) -> DataFrame:
    return streamlines.slab_clip(p, 40.0, 15.0)


@query(points, with_points("cut as (select *, count(*) over (partition by streamline_id) as size from points where point_idx < 3 + streamline_id % 9)", _slab("(select * from cut where size > 5)")) + f"""select streamline_id, seg_start, pos, {rnd('x', 'y', 'z')} from slab where n >= 2
union all select streamline_id, 0, point_idx, {rnd('x', 'y', 'z')} from cut where size <= 5 and streamline_id in (select streamline_id from cut where abs(y - 40.0) <= 15.0)""")
def slab_rule_short_long(p: DataFrame) -> DataFrame:
    return streamlines.slab_rule(p.where("point_idx < 3 + streamline_id % 9"), 40.0, 15.0)


@query(points, with_points("sized as (select *, count(*) over (partition by streamline_id) as size from points)", _slab("(select * from sized where size > 5)")) + f"""select streamline_id, seg_start, pos, {rnd('x', 'y', 'z')} from slab where n >= 2
union all select streamline_id, 0, point_idx, {rnd('x', 'y', 'z')} from sized where size <= 5 and streamline_id in (select streamline_id from sized where abs(y - 40.0) <= 15.0)""")
def slab_rule(p: DataFrame) -> DataFrame:
    return streamlines.slab_rule(p, 40.0, 15.0)


@query(points, with_points() + f"""select streamline_id from points group by 1 having {' and '.join(f'bool_or({a} >= {lo!r}) and bool_or({a} < {hi!r})' for a, lo, hi in zip('xyz', LOW, HIGH))}""")
def bounds_keep(p: DataFrame) -> DataFrame:
    return streamlines.bounds_keep(p, LOW, HIGH)


def densify_sql(step: float, method: str = "linear", count: str = "ceil", src: str = "arc", dst: str = "dense") -> str:
    n = f"cast(ceil(total / {step!r}) as bigint) + 1" if count == "ceil" else f"greatest(cast(floor(total / {step!r}) as bigint), 2)"
    own = f"lag(d) over {W}"
    first, last = f"lag(x) over {W} is null", "point_idx = last_idx"
    half = "0.5" if method == "catmull" else "1.0"
    raw = ", ".join(
        f"case when {first} then lead({a}) over {W} - {a} when {last} then {a} - lag({a}) over {W} else (lead({a}) over {W} - lag({a}) over {W}) * {half} end as r{a}"
        for a in "xyz"
    )
    scale = f"{3.0 * step!r}" if method == "catmull" else (
        f"2.0 * (case when {first} then d when {last} then {own} else avg(d) over (partition by streamline_id order by point_idx rows between 2 preceding and current row) end)"
    )
    size = "sqrt(rx * rx + ry * ry + rz * rz)"
    moved = {
        "linear": lambda a: f"{a} + u * (n{a} - {a})",
    }.get(method, lambda a: f"(2 * u * u * u - 3 * u * u + 1) * {a} + (u * u * u - 2 * u * u + u) * h * m{a} + (-2 * u * u * u + 3 * u * u) * n{a} + (u * u * u - u * u) * h * nm{a}")
    k = dst
    return f"""{k}0 as (select *, {n} as n, {raw}, {scale} as sc from {src} where total >= {step!r} and n_points >= 2),
{k}1 as (select *, lead(s) over {W} as ns, max(case when d > 0 then point_idx end) over (partition by streamline_id) as last_long, case when {size} > 1e-10 then sc / {size} else 1.0 end as kk, total / (n - 1) as gap from {k}0),
{k}2 as (select *, rx * kk as mx, ry * kk as my, rz * kk as mz, d / total as h from {k}1),
{k}3 as (select *, lead(mx) over {W} as nmx, lead(my) over {W} as nmy, lead(mz) over {W} as nmz, cast(ceil(s / gap) as bigint) as lo,
  case when point_idx = last_long then n - 1 else cast(ceil(ns / gap) as bigint) - 1 end as hi from {k}2),
{k}4 as (select *, unnest(range(lo, hi + 1)) as pos from {k}3 where point_idx <> last_idx and d > 0 and lo <= hi),
{k}5 as (select *, least(greatest((pos * gap - s) / d, 0.0), 1.0) as u from {k}4),
{k} as (select streamline_id, cast(pos as integer) as pos, {', '.join(f'{moved(a)} as {a}' for a in 'xyz')} from {k}5
  union all select streamline_id, point_idx, x, y, z from {src} where total < {step!r} or n_points < 2)"""


for _name, _step, _method, _count in (
    ("densify_linear", STEP, "linear", "ceil"), ("densify_viewer", VIEW_STEP, "linear", "floor"),
    ("densify_hermite", STEP, "hermite", "ceil"), ("densify_catmull", STEP, "catmull", "ceil"),
):
    QUERIES[_name] = lambda spark, d, s=_step, m=_method, c=_count: rounded(streamlines.densify(points(spark, d), s, m, c))
    ORACLE[_name] = with_points(SEGS, ARC, densify_sql(_step, _method, _count)) + f"select streamline_id, pos, {rnd('x', 'y', 'z')} from dense"


@query(points)
def compare_methods_metrics(p: DataFrame) -> DataFrame:
    return streamlines.compare_methods(p, STEP)


@query(points, with_points(SEGS, ARC, densify_sql(STEP, "linear", dst="a"), densify_sql(STEP, "hermite", dst="b")) + """select a.streamline_id,
  round(avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 6) as mean_distance
from a join b using (streamline_id, pos) group by 1 order by mean_distance desc, streamline_id limit 5""")
def compare_top_outliers(p: DataFrame) -> DataFrame:
    return streamlines.top_outliers(streamlines.densify(p, STEP), streamlines.densify(p, STEP, "hermite"))


@query(points, with_points() + f"select streamline_id, point_idx, round(200.0 - x, 6) + 0.0 as x, {rnd('y', 'z')} from points")
def orientation_mirror(p: DataFrame) -> DataFrame:
    return streamlines.mirror(p, "x", 100.0)


@query(points, with_points("ids as (select distinct streamline_id from points)") + """select streamline_id from ids
order by md5('42:' || streamline_id), streamline_id limit (select greatest(1, cast(floor(count(*) * 30.0 / 100) as integer)) from ids)""")
def sample_percent(p: DataFrame) -> DataFrame:
    return streamlines.sample_percent(p, 30.0)


@query(points, with_points("ids as (select distinct streamline_id from points)") + """select streamline_id from ids
order by streamline_id limit (select cast(floor(count(*) * 25.0 / 100) as integer) from ids)""")
def prefix_percent(p: DataFrame) -> DataFrame:
    return streamlines.prefix_percent(p, 25.0)


# patches


def boxes_sql(n: int) -> str:
    parts = []
    for a, lo, hi, h in zip("xyz", BOX["low"], BOX["high"], BOX["half"]):
        parts.append(f"{lo + h!r} + {uniform_sql(chr(39) + '42' + chr(39), 'patch_id', chr(39) + a + chr(39))} * {hi - lo - 2 * h!r} as c{a}")
    edges = ", ".join(f"c{a} - {h!r} as lo{a}, c{a} + {h!r} as hi{a}" for a, h in zip("xyz", BOX["half"]))
    return f"""b0 as (select range as patch_id from range({n})), b1 as (select *, {', '.join(parts)} from b0), boxes as (select *, {edges} from b1),
counts as (select b.patch_id, count(distinct p.streamline_id) as n from boxes b left join points p
  on {' and '.join(f'p.{a} between b.lo{a} and b.hi{a}' for a in 'xyz')} group by 1)"""


def _boxes(df: DataFrame, n: int) -> DataFrame:
    return patches.boxes(df.sparkSession, n, **BOX)


_BOXCOLS = [f"{e}{a}" for e in ("c", "lo", "hi") for a in "xyz"]


@query(points, with_points(boxes_sql(60)) + f"select patch_id, {rnd(*_BOXCOLS)}, {', '.join(f'cast({f}({e}{a} / 2.0) as integer) as v{e}{a}' for a in 'xyz' for e, f in (('lo', 'floor'), ('hi', 'ceil')))} from boxes")
def patch_bbox(p: DataFrame) -> DataFrame:
    return patches.voxel_boxes(_boxes(p, 60), 2.0)


@query(points, with_points(boxes_sql(60)) + "select patch_id, n from counts")
def patch_counts(p: DataFrame) -> DataFrame:
    return patches.counts(p, _boxes(p, 60), CELL)


@query(points, with_points(boxes_sql(250)) + "select patch_id, n from counts where n >= 10 order by patch_id limit 5")
def patch_sample(p: DataFrame) -> DataFrame:
    return patches.sample(p, _boxes(p, 250), 5, 10, CELL)


@query(points, with_points(boxes_sql(100)) + """select patch_id // 20 as group_id, patch_id, n, n >= 12 as reached from counts
qualify row_number() over (partition by patch_id // 20 order by n >= 12 desc, case when n >= 12 then 0 else -n end, patch_id) = 1""")
def patch_best_trial(p: DataFrame) -> DataFrame:
    return patches.best_trial(p, _boxes(p, 100), 20, 12, CELL)


_GRID = [f"g{a} as (select distinct streamline_id, cast(floor({a} / {s!r}) as integer) as g{a} from points where {a} >= 0 and {a} < {int(n // s) * s!r})" for a, s, n in zip("xyz", CELL, FOV)]


@query(points, with_points(*_GRID) + "select gx, gy, gz, count(*) as n from gx join gy using (streamline_id) join gz using (streamline_id) group by 1, 2, 3")
def patch_grid_counts(p: DataFrame) -> DataFrame:
    return patches.grid_counts(p, CELL, FOV)


def _box_filter(test: str, around: int, keep: str, least: int, edge: float) -> str:
    moved = ", ".join(f"round(least(greatest({a} - {lo!r}, 0.0), {hi - lo - edge!r}), 6) + 0.0 as {a}" for a, lo, hi in zip("xyz", LOW, HIGH))
    return with_points(f"""h as (select *, min(i) over w as first, max(i) over w as last, count(i) over w as hits from
  (select *, case when {test} then point_idx end as i from points) window w as (partition by streamline_id)),
k as (select *, count(*) over (partition by streamline_id) as n from h where {keep} and point_idx between first - {around} and last + {around})""") + (
        f"select streamline_id, point_idx, {moved} from k where n >= {least}"
    )


@query(points, _box_filter(" and ".join(f"{a} between {lo + 0.01!r} and {hi - 0.01!r}" for a, lo, hi in zip("xyz", LOW, HIGH)), 1, "true", 2, 0.001))
def patch_filter(p: DataFrame) -> DataFrame:
    return patches.filter_patch(p, LOW, HIGH)


@query(points, _box_filter(" and ".join(f"{a} >= {lo!r} and {a} < {hi!r}" for a, lo, hi in zip("xyz", LOW, HIGH)), 5, "hits >= 2", 5, 0.01))
def patch_filter_legacy(p: DataFrame) -> DataFrame:
    return patches.filter_patch_legacy(p, LOW, HIGH)


@query(points, with_points() + f"""select *, round(100.0 * n_outside / n_points, 6) as percent_outside, 100.0 * n_outside / n_points <= 0.1 as passes,
  n_outside > 0 or n_streamlines < 5 as warns from (select count(*) as n_points, cast(count_if(not ({_INSIDE})) as bigint) as n_outside, count(distinct streamline_id) as n_streamlines from points)""")
def patch_alignment(p: DataFrame) -> DataFrame:
    return patches.alignment(p, FOV)


_SLICES = """e as (select cast(trunc(min(y)) as integer) as lo, cast(trunc(max(y)) as integer) as hi from points),
f as (select greatest(0, lo - greatest(5, cast(trunc((hi - lo) * 0.2) as integer))) as a, least(59, hi + greatest(5, cast(trunc((hi - lo) * 0.2) as integer))) as b from e),
slices as (select distinct cast(least(cast(trunc(a + m * ((b - a) / 6.0)) as integer), 59) as integer) as slice_idx from f, (select unnest(range(7)) as m))"""


@query(points, with_points(_SLICES) + "select slice_idx from slices")
def slice_indices(p: DataFrame) -> DataFrame:
    return patches.slice_indices(p, "y", 7, 60)


@query(points, with_points(_SLICES) + "select slice_idx, streamline_id, count(*) as n_points from slices join points on y >= slice_idx - 0.5 and y < slice_idx + 0.5 group by 1, 2")
def slice_extract(p: DataFrame) -> DataFrame:
    placed = p.withColumn("slice_idx", F.floor(F.col("y") + 0.5).cast("int"))  # each point has one nearest slice: an equi-join
    return placed.join(patches.slice_indices(p, "y", 7, 60), "slice_idx").groupBy("slice_idx", "streamline_id").agg(F.count("*").alias("n_points"))


@query(points, """select range as region, cast((range // 9) * 16 as integer) as ox, cast(((range // 3) % 3) * 3 as integer) as oy, cast((range % 3) * 3 as integer) as oz,
  16 as sx, 3 as sy, 3 as sz from range(20)""")
def grid_subdivisions(p: DataFrame) -> DataFrame:
    return patches.subdivisions(p.sparkSession, 20, SHAPE)


@query(points, with_points() + """select streamline_id, point_idx, round(x - 20.0, 6) + 0.0 as x, round(y - 10.0, 6) + 0.0 as y, round(z - 4.0, 6) + 0.0 as z from points
where streamline_id in (select distinct streamline_id from points where x >= 20 and x < 60 and y >= 10 and y < 30 and z >= 4 and z < 10 order by 1 limit 40)""")
def region_filter(p: DataFrame) -> DataFrame:
    return patches.region_filter(p, (20.0, 10.0, 4.0), (40.0, 20.0, 6.0), 40)


@query(points, with_points() + """select streamline_id, point_idx, round(x - 20.0, 6) + 0.0 as x, round(y - 10.0, 6) + 0.0 as y, round(z - 4.0, 6) + 0.0 as z from points
where streamline_id in (select distinct streamline_id from points where x >= 20 and x < 60 and y >= 10 and y < 30 and z >= 4 and z < 10 order by 1 limit 50000)""")
def region_filter_default(p: DataFrame) -> DataFrame:
    return patches.region_filter(p, (20.0, 10.0, 4.0), (40.0, 20.0, 6.0))


@query(points, with_points("ids as (select distinct streamline_id as file_id from points)") + """select file_id,
  cast(1000 // (select count(*) from ids) + case when row_number() over (order by file_id) <= 1000 % (select count(*) from ids) then 1 else 0 end as integer) as quota from ids""")
def patch_quota(p: DataFrame) -> DataFrame:
    return patches.quota(p.select(F.col("streamline_id").alias("file_id")), 1000)


@query(points, with_points("""m as (select streamline_id, median(x) as x, median(y) as y, median(z) as z from points where abs(y - 40.0) <= 3.0 group by 1)""") + """select a.streamline_id from m a join m b
on a.streamline_id <> b.streamline_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 144.0 group by 1 having count(*) >= 2""")
def isolated_filter(p: DataFrame) -> DataFrame:
    return patches.isolated(p, "y", 40.0, 12.0, 2, 3.0)


@query(points, "select cast(range as integer) as step, round(5.0 + range * 11.875, 6) as percent from range(9)")
def density_ladder(p: DataFrame) -> DataFrame:
    return patches.density_ladder(p.sparkSession, 9, 5.0, 100.0)


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).where("j = 4 and v > 38").select("i", "k")


_MASK = VOXELS_SQL + ",\nmask as (select distinct i, k from voxels where j = 4 and v > 38)"
_CELL = "least(greatest(cast(trunc(x) as integer), 0), 49) as i, least(greatest(cast(trunc(z) as integer), 0), 8) as k"

QUERIES["wm_streamlines"] = lambda s, d: patches.mask_streamlines(points(s, d), _mask(s, d), SHAPE, 40.0, 2.0)
ORACLE["wm_streamlines"] = with_points(_MASK) + f"select distinct streamline_id from (select *, {_CELL} from points where abs(y - 40.0) <= 2.0) join mask using (i, k)"
QUERIES["wm_segments"] = lambda s, d: patches.mask_segments(points(s, d), _mask(s, d), SHAPE)
ORACLE["wm_segments"] = with_points(_MASK, f"""mm as (select p.*, m.i is not null as hit from (select *, {_CELL} from points) p left join mask m using (i, k)),
nn as (select *, lead(hit) over {W} as nxt from mm)""") + "select streamline_id, point_idx from nn where nxt is not null and (hit or nxt)"  # fmt: skip


# volumes

VOX = "with " + VOXELS_SQL + "\n"


@query(voxels, VOX + """select count(*) as n_voxels, round(min(v), 6) as min_v, round(max(v), 6) as max_v, cast(count_if(v <> 0) as bigint) as n_nonzero,
  bool_or(isnan(v)) as has_nan, bool_or(isinf(v)) as has_inf from voxels""")
def volume_profile(v: DataFrame) -> DataFrame:
    return volumes.profile(v)


@query(voxels, VOX + f"select i - 5 as i, j - 2 as j, k - 1 as k, {rnd('v')} from voxels where i between 5 and 24 and j between 2 and 7 and k between 1 and 5")
def crop_volume(v: DataFrame) -> DataFrame:
    return volumes.crop(v, (5, 2, 1), (20, 6, 5))


_SHAPE, _SCALE, _SHIFT = (25, 6, 5), (1.9, 1.7, 1.6), (0.4, -0.3, 0.25)
_TARGET = "t as (select cast(a.range as integer) as i, cast(b.range as integer) as j, cast(c.range as integer) as k, a.range * 1.9e0 + 0.4e0 as si, b.range * 1.7e0 - 0.3e0 as sj, c.range * 1.6e0 + 0.25e0 as sk from range(25) a, range(6) b, range(5) c)"


def _kernel(lo: int, hi: int, base: str, weight: str, total: str) -> str:
    offs = [f"o{c} as (select unnest(range({lo}, {hi + 1})) as d{c})" for c in "ijk"]
    place = ", ".join(f"cast({base}(s{c}) + d{c} as integer) as q{c}" for c in "ijk")
    ws = " * ".join(weight.format(f"abs(s{c} - q{c})") for c in "ijk")
    return "with " + ",\n".join([VOXELS_SQL, _TARGET, *offs, f"p as (select *, {place} from t, oi, oj, ok)", f"g as (select p.i, p.j, p.k, {ws} as w, x.v from p left join voxels x on x.i = qi and x.j = qj and x.k = qk)"]) + f"\nselect i, j, k, round({total}, 6) + 0.0 as v from g group by 1, 2, 3"


@query(voxels, "with " + VOXELS_SQL + ",\n" + _TARGET + """ select t.i, t.j, t.k, round(coalesce(x.v, 0.0), 6) + 0.0 as v from t
left join voxels x on x.i = cast(trunc(si) as integer) and x.j = cast(trunc(sj) as integer) and x.k = cast(trunc(sk) as integer)""")
def resample_nearest(v: DataFrame) -> DataFrame:
    return volumes.resample(v, _SHAPE, _SCALE, _SHIFT, "nearest")


@query(voxels, _kernel(0, 1, "floor", "(1.0 - {})", f"sum(w * coalesce(v, 0.0)) + {NUDGE}"))
def resample_trilinear(v: DataFrame) -> DataFrame:
    return nudged(volumes.resample(v, _SHAPE, _SCALE, _SHIFT, "trilinear"), "v")


_CUBIC = "(case when {0} < 1 then (21 * {0} * {0} * {0} - 36 * {0} * {0} + 16) / 18 when {0} < 2 then (-7 * {0} * {0} * {0} + 36 * {0} * {0} - 60 * {0} + 32) / 18 else 0.0 end)"


@query(voxels, _kernel(-1, 2, "round", _CUBIC, "case when abs(sum(case when v is not null then w end)) > 1e-10 then sum(w * coalesce(v, 0.0)) / sum(case when v is not null then w end) else 0.0 end"))
def resample_cubic(v: DataFrame) -> DataFrame:
    return volumes.resample(v, _SHAPE, _SCALE, _SHIFT, "cubic")


@query(voxels, VOX + "select i, k, round(max(v), 6) + 0.0 as v from voxels group by 1, 2")
def reduce_mip(v: DataFrame) -> DataFrame:
    return volumes.reduce_axis(v, "j", "mip")


@query(voxels, VOX + "select i, k, round(avg(v), 6) + 0.0 as v from voxels group by 1, 2")
def reduce_mean(v: DataFrame) -> DataFrame:
    return volumes.reduce_axis(v, "j", "mean")


@query(voxels, VOX + """select 'i' as axis, j as a, k as b, round(max(v), 6) as v from voxels group by 2, 3 union all
select 'j', i, k, round(max(v), 6) from voxels group by 2, 3 union all select 'k', i, j, round(max(v), 6) from voxels group by 2, 3""")
def mip_views(v: DataFrame) -> DataFrame:
    return volumes.mip_views(v)


@query(voxels, VOX + """select cast(i * 2 + a.range as integer) as i, cast(j * 2 + b.range as integer) as j, cast(k * 2 + c.range as integer) as k
from voxels, range(2) a, range(2) b, range(2) c where v > 38""")
def mask_upscale(v: DataFrame) -> DataFrame:
    return volumes.upscale_mask(v, 2, 38.0)


def warp_streamlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points mapped into the warp's voxels, moved along x by the trilinear displacement there."""
    p = points(spark, sf_dir).withColumns({"wx": F.col("x") / 4.0, "wy": F.col("y") / 10.0, "wz": F.col("z") / 3.0})
    out = volumes.trilinear_at(p, voxels(spark, sf_dir), ("wx", "wy", "wz"), "dx")
    return rounded(out.select("streamline_id", "point_idx", (F.col("x") + F.col("dx") + NUDGE).alias("x"), "y", "z"))


QUERIES["warp_streamlines"] = warp_streamlines
ORACLE["warp_streamlines"] = with_points(VOXELS_SQL, """p as (select *, x / 4.0 as wx, y / 10.0 as wy, z / 3.0 as wz from points),
q as (select *, cast(floor(wx) + a.range as integer) as i, cast(floor(wy) + b.range as integer) as j, cast(floor(wz) + c.range as integer) as k from p, range(2) a, range(2) b, range(2) c)""") + f"""select streamline_id, point_idx,
  round(x + sum((1.0 - abs(wx - i)) * (1.0 - abs(wy - j)) * (1.0 - abs(wz - k)) * coalesce(v, 0.0)) + {NUDGE}, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z
from q left join voxels using (i, j, k) group by streamline_id, point_idx, x, y, z"""  # fmt: skip


# raster

_DIMS = (200, 60, 24)
_DENSITY = f"""k as (select streamline_id, point_idx, cast(trunc(x) as integer) as c, 24 - cast(trunc(z) as integer) - 1 as r from points where abs(y - 40.0) <= 16.0),
k2 as (select * from k where c >= 0 and c < 200 and r >= 0 and r < 24),
l as (select *, lead(c) over {W} - c as dc, lead(r) over {W} - r as dr from k2),
l2 as (select *, greatest(abs(dc), abs(dr)) as n from l where dc is not null),
l3 as (select *, unnest(range(0, n + 1)) as m from l2),
dens as (select cast(r + case when n = 0 then 0 else floor((2 * dr * m + n) / (2.0 * greatest(n, 1))) end as integer) as r,
  cast(c + case when n = 0 then 0 else floor((2 * dc * m + n) / (2.0 * greatest(n, 1))) end as integer) as c, count(*) as n from l3 group by 1, 2)"""


@query(points, with_points(_DENSITY) + "select r, c, n from dens")
def fiber_density(p: DataFrame) -> DataFrame:
    return raster.density(p, 40.0, 8.0, _DIMS)


@query(points, with_points(_DENSITY) + "select r, c from dens where n >= 3")
def fiber_mask(p: DataFrame) -> DataFrame:
    return raster.density(p, 40.0, 8.0, _DIMS).where("n >= 3").select("r", "c")


@query(points, with_points(_DENSITY) + """select distinct cast(r + a.range as integer) as r, cast(c + b.range as integer) as c from dens, range(-2, 3) a, range(-2, 3) b
where n >= 3 and a.range * a.range + b.range * b.range <= 4 and r + a.range between 0 and 23 and c + b.range between 0 and 199""")
def mask_dilate(p: DataFrame) -> DataFrame:
    return raster.dilate(raster.density(p, 40.0, 8.0, _DIMS).where("n >= 3").select("r", "c"), 2, (24, 200))


_COMP = f"""with recursive {PIXELS_SQL},
on_ as (select image_id, r, c from pixels where v > 0.05),
walk(image_id, root, r, c) as (select image_id, r * 8 + c, r, c from on_ union
  select w.image_id, w.root, o.r, o.c from walk w join on_ o on o.image_id = w.image_id and abs(o.r - w.r) <= 1 and abs(o.c - w.c) <= 1),
roots as (select image_id, r, c, min(root) as root from walk group by 1, 2, 3),
labels as (select image_id, r, c, cast(dense_rank() over (partition by image_id order by root) as integer) as label from roots),
areas as (select image_id, label, count(*) as area from labels group by 1, 2)
"""


def _labels(x: DataFrame) -> DataFrame:
    return raster.components(x.where("v > 0.05"))


@query(pixels, _COMP + "select image_id, r, c, label from labels")
def bundle_components(x: DataFrame) -> DataFrame:
    return _labels(x)


@query(pixels, _COMP + "select image_id, r, c, label from labels join areas using (image_id, label) where area >= 5")
def bundle_min_size(x: DataFrame) -> DataFrame:
    return raster.large(_labels(x), 5)


@query(pixels, _COMP + "select image_id, label, area, cast(row_number() over (partition by image_id order by area desc, label) as integer) as rank from areas qualify rank <= 4")
def bundle_top4(x: DataFrame) -> DataFrame:
    return raster.top_components(_labels(x))


@query(pixels)
def gap_closing(x: DataFrame) -> DataFrame:
    return raster.close_gaps(x.where("v > 0.05"), 1, IMG)


# images

PIX = "with " + PIXELS_SQL
_NORM = """,
norm as (select image_id, r, c, case when hi > lo then (v - lo) / (hi - lo) else v end as v from
  (select *, min(v) over (partition by image_id) as lo, max(v) over (partition by image_id) as hi from pixels))"""
_XY = "(c * 0.2857142857142857e0 - 1.0e0)", "(r * 0.2857142857142857e0 - 1.0e0)"


def image_sql(value: str, src: str = "norm", more: str = "") -> str:
    return PIX + _NORM + more + f"\nselect image_id, r, c, round({value}, 6) + 0.0 as v from {src}"


@query(pixels, image_sql("v"))
def normalize_slice(x: DataFrame) -> DataFrame:
    return images.normalize(x)


@query(pixels, image_sql("case when v > 0.3 then v else 0.0 end"))
def tissue_mask(x: DataFrame) -> DataFrame:
    return images.tissue(x, 0.3)


@query(pixels, image_sql("pow(v, 1.4)"))
def gamma_field(x: DataFrame) -> DataFrame:
    return images.gamma(x, 1.4)


_X, _Y = _XY


@query(pixels, image_sql(f"v * (1.0 + 0.2 * ({_X} + {_Y} + {_X} * {_Y} + {_X} * {_X} - {_Y} * {_Y} + {_X} * {_X} * {_X} - {_Y} * {_Y} * {_Y}))"))
def bias_field(x: DataFrame) -> DataFrame:
    return images.bias_field(x, IMG, 0.2)


@query(pixels, image_sql(f"v * (1.0 + 0.2 * ({_X} + {_Y} + {_X} * {_X} - {_Y} * {_Y}))"))
def noise_multiplicative(x: DataFrame) -> DataFrame:
    return images.noise_multiplicative(x, IMG, 0.2)


def _blur_sql(sigma: float, across: str, along: str) -> str:
    own = f"over (partition by image_id, {across} order by {along})"
    every = f"over (partition by image_id, {across} order by {along} rows between unbounded preceding and unbounded following)"
    w = images.gaussian_weights(sigma)
    near = lambda k: "v" if k == 0 else f"coalesce(lag(v, {-k}) {own}, first_value(v) {every})" if k < 0 else f"coalesce(lead(v, {k}) {own}, last_value(v) {every})"
    return "0.0 + " + " + ".join(f"{near(k - len(w) // 2)} * {x!r}" for k, x in enumerate(w))


def gauss_sql(sigma: float, src: str = "pixels") -> str:
    return f""",
g1 as (select image_id, r, c, {_blur_sql(sigma, 'c', 'r')} as v from {src}),
g2 as (select image_id, r, c, {_blur_sql(sigma, 'r', 'c')} as b from g1),
g as (select *, min(v) over (partition by image_id) as lo, max(v) over (partition by image_id) as hi from {src} join g2 using (image_id, r, c))"""


@query(pixels, image_sql("b", "g", gauss_sql(0.8)))
def gaussian_smooth(x: DataFrame) -> DataFrame:
    return images.gaussian(x, 0.8)


@query(pixels, image_sql("least(greatest(v + 0.7 * (v - b), lo), hi)", "g", gauss_sql(0.8)))
def unsharp(x: DataFrame) -> DataFrame:
    return images.unsharp(x, 0.8, 0.7)


@query(pixels, image_sql("exp(-4.0 * abs(v - b)) * b + (1.0 - exp(-4.0 * abs(v - b))) * v", "g", gauss_sql(0.8)))
def adaptive_smooth(x: DataFrame) -> DataFrame:
    return images.adaptive(x, 0.8)


_FOUR = """,
n as (select *, min(v) over (partition by image_id) as lo, max(v) over (partition by image_id) as hi,
  coalesce(lag(v) over (partition by image_id, c order by r), v) as u, coalesce(lead(v) over (partition by image_id, c order by r), v) as d,
  coalesce(lag(v) over (partition by image_id, r order by c), v) as l, coalesce(lead(v) over (partition by image_id, r order by c), v) as e from pixels)"""


@query(pixels, image_sql("least(greatest(v - 0.5 * (u + d + l + e - 4.0 * v), lo), hi)", "n", _FOUR))
def laplacian(x: DataFrame) -> DataFrame:
    return images.laplacian(x, 0.5)


@query(pixels, image_sql("v + 0.2 * (" + " + ".join(f"({a} - v) * exp(-((({a} - v) / 0.1) * (({a} - v) / 0.1)))" for a in "udle") + ")", "n", _FOUR))
def diffusion_step(x: DataFrame) -> DataFrame:
    return images.diffusion(x, 0.1, 0.2)


_DARK = """,
d0 as (select image_id, r, c, pow(1.0 - v, 1.3) as v from norm),
d1 as (select *, quantile_cont(v, 0.02) over (partition by image_id) as a, quantile_cont(v, 0.98) over (partition by image_id) as b from d0),
d2 as (select image_id, r, c, case when b > a then least(greatest((v - a) / (b - a), 0.0), 1.0) else v end as v from d1)"""


@query(pixels, image_sql("case when v < 0.15 then 0.0 else v end", "d2", _DARK))
def darkfield_points(x: DataFrame) -> DataFrame:
    return images.dark_field(x, 1.3, 0.02, 0.98, 0.15)


def _u(*tags: str) -> str:
    return uniform_sql("'42'", *tags)


_NOISE = f"""greatest(v + (case when {_u("'mix'", 'image_id', 'r', 'c')} < 0.4 then 0.1 when {_u("'mix'", 'image_id', 'r', 'c')} < 0.7 then 0.05 else 0.15000000000000002 end)
  * sqrt(-2.0 * ln(1.0 - {_u("'n1'", 'image_id', 'r', 'c')})) * cos(6.283185307179586 * {_u("'n2'", 'image_id', 'r', 'c')}), 0.0)"""


@query(pixels, image_sql(_NOISE))
def noise_mixture(x: DataFrame) -> DataFrame:
    return images.noise_mixture(x, 0.1)


def _ellipse(k: int) -> str:
    u = {n: _u(f"'e{k}{n}'", "image_id") for n in ("cy", "cx", "ry", "rx")}
    dy, dx = f"((r - {u['cy']} * 8) / (0.5 + {u['ry']} * 8 / 4))", f"((c - {u['cx']} * 8) / (0.5 + {u['rx']} * 8 / 4))"
    return f"{dx} * {dx} + {dy} * {dy} <= 1.0"


_HIT = " or ".join(_ellipse(k) for k in range(2))


@query(pixels, PIX + f"\nselect image_id, r, c from pixels where {_HIT}")
def artifact_ellipse(x: DataFrame) -> DataFrame:
    return images.ellipses(x, IMG, 2)


_MODES = {
    "overlay": "case when v < 0.5 then 2 * v * 0.8 else 1 - 2 * (1 - v) * (1 - 0.8) end", "multiply": "v * 0.8",
    "screen": "1 - (1 - v) * (1 - 0.8)", "normal": "0.8", "add": "least(v + 0.8, 1.0)",
}


@query(pixels, PIX + _NORM + f", m as (select *, {_HIT} as hit from norm)\n" + "\nunion all ".join(
    f"select image_id, r, c, '{k}' as mode, round(case when hit then v * 0.4 + 0.6 * ({e}) else v end, 6) + 0.0 as v from m" for k, e in _MODES.items()))
def artifact_blend(x: DataFrame) -> DataFrame:
    return images.blend(x, 0.8, 0.6, IMG, 2)


@query(pixels, image_sql("cume_dist() over (partition by image_id order by v)", "pixels"))
def equalize_histogram(x: DataFrame) -> DataFrame:
    return images.equalize(x)


@query(pixels)
def clahe(x: DataFrame) -> DataFrame:
    return images.clahe(x, IMG)


@query(pixels)
def lpsvd(x: DataFrame) -> DataFrame:
    return images.lpsvd(x)


@query(points)
def densify_rbf(p: DataFrame) -> DataFrame:
    return streamlines.densify_rbf(p, STEP)


_EL = {a: [_u(f"'{a}'", "image_id", f"(r // 4 + {i})", f"(c // 4 + {j})") for i in (0, 1) for j in (0, 1)] for a in "yx"}


def _field(a: str) -> str:
    y, x = "(r / 4.0e0 - r // 4)", "(c / 4.0e0 - c // 4)"
    w = [f"(1 - {y}) * (1 - {x})", f"(1 - {y}) * {x}", f"{y} * (1 - {x})", f"{y} * {x}"]
    return "1.5e0 * (" + " + ".join(f"{p} * (2.0e0 * {u} - 1.0e0)" for p, u in zip(w, _EL[a])) + ")"


@query(pixels, PIX + f""",
m as (select image_id, r, c, least(greatest(r + {_field('y')}, 0.0), 7.0) as sy, least(greatest(c + {_field('x')}, 0.0), 7.0) as sx from pixels),
q as (select m.*, a.range as a, b.range as b, least(cast(floor(sy) as integer) + a.range, 7) as qy, least(cast(floor(sx) as integer) + b.range, 7) as qx from m, range(2) a, range(2) b)
select q.image_id, q.r, q.c, round(sum((case when a = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case when b = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) * p.v), 6) + 0.0 as v
from q join pixels p on p.image_id = q.image_id and p.r = qy and p.c = qx group by 1, 2, 3""")
def elastic_deformation(x: DataFrame) -> DataFrame:
    return images.elastic(x, IMG, 4, 1.5)


@query(pixels)
def injection_walks(x: DataFrame) -> DataFrame:
    return images.random_walks(x.sparkSession, 400, 30, (100.0, 100.0), 6.0)


@query(pixels)
def brain_mask(x: DataFrame) -> DataFrame:
    return images.otsu_mask(x)


# queries in modules of their own, which register themselves here
from loomspan.plans import further, registered  # noqa: E402, F401
