"""Queries of checks, drawing tables, noise and the transform driver, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import drawing, images, raster, streamlines, validation
from loomspan.plans import catalogue as base
from loomspan.plans.catalogue import AFFINE, ARC, FOV, HIGH, IMG, LOW, PIX, SEGS, STEP, VIEW_STEP, VOX, W, image_sql, query, rnd, with_points
from loomspan.plans.model import PIXELS_SQL, POINTS_SQL, pixels, points, uniform_sql, voxels


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for volumes and patches from part: sizes that are sometimes not positive, too large, or null."""
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("request_id"), (F.col("p_size") * 50).alias("nx"), ((k % 45) * 40 - 40).cast("int").alias("ny"), ((k % 60) * 40).cast("int").alias("nz"),
        ((k % 1100) / 100.0 - 0.005).alias("voxel_mm"), F.when(k % 7 > 0, F.col("p_size") * 20 - 40).cast("int").alias("n_slices"),
        (F.col("p_size") * 4 + 10).alias("px"), (k % 90 + 20).cast("int").alias("py"), (k % 40 + 5).cast("int").alias("pz"), (k % 300).cast("int").alias("n_patches"),
    )


REQUESTS_SQL = """with requests as (select p_partkey as request_id, p_size * 50 as nx, cast(p_partkey % 45 * 40 - 40 as integer) as ny, cast(p_partkey % 60 * 40 as integer) as nz,
  cast(p_partkey % 1100 as double) / 100.0e0 - 0.005e0 as voxel_mm, cast(case when p_partkey % 7 > 0 then p_size * 20 - 40 end as integer) as n_slices,
  p_size * 4 + 10 as px, cast(p_partkey % 90 + 20 as integer) as py, cast(p_partkey % 40 + 5 as integer) as pz, cast(p_partkey % 300 as integer) as n_patches from part)
"""


@query(requests, REQUESTS_SQL + """, sized as (select *, cast(nx as bigint) * ny * nz as n_voxels, cast(nx as bigint) * ny * nz * 4.0e0 / 1073741824.0e0 as g from requests),
scaled as (select *, case when g > 1.0 then pow(1.0e0 / greatest(g, 0.1e0), 0.3333333333333333e0) else 1.0e0 end as s from sized)
select request_id, least(nx, ny, nz) > 0 and voxel_mm > 0 and (n_slices is null or n_slices > 0) as valid, n_voxels, round(g, 6) + 0.0 as gb,
  case when n_slices is null then ny else least(n_slices, ny) end as slices, greatest(nx, ny, nz) > 2000 as large_dim, n_voxels > 100000000 as large_total, voxel_mm > 10 as coarse,
  voxel_mm < 0.01 as fine, coalesce(n_slices > ny, false) as slices_cut, g > 16 as large_memory,
  cast(floor(nx * s + 1e-9) as integer) as fit_x, cast(floor(ny * s + 1e-9) as integer) as fit_y, cast(floor(nz * s + 1e-9) as integer) as fit_z from scaled""")
def target_checks(r: DataFrame) -> DataFrame:
    kept = "request_id valid n_voxels gb slices large_dim large_total coarse fine slices_cut large_memory fit_x fit_y fit_z".split()
    return validation.check_targets(r, 1.0).select(*kept)


@query(requests, REQUESTS_SQL + """, v as (select *, 200 as vx, 100 as vy, 40 as vz from requests),
w as (select *, cast(px > vx as integer) + cast(py > vy as integer) + cast(pz > vz as integer) as too, cast(vx // px as bigint) * (vy // py) * (vz // pz) as apart,
  (cast(px as bigint) * py * pz) / (vx * vy * vz) as sh from v)
select request_id, too = 0 as valid, too as axes_too_large, cast(px <= vx and px > vx * 0.8 as integer) + cast(py <= vy and py > vy * 0.8 as integer) + cast(pz <= vz and pz > vz * 0.8 as integer) as axes_large,
  least(px, py, pz) < 32 as small, case when too = 0 then apart end as n_apart, too = 0 and n_patches > apart * 10 as many, round(sh, 6) + 0.0 as share,
  case when too = 0 then case when sh < 0.01 then 'larger' when sh > 0.3 then 'smaller' end end as advice from w""")
def patch_checks(r: DataFrame) -> DataFrame:
    found = validation.check_patches(r.withColumns({f"v{a}": F.lit(n) for a, n in zip("xyz", (200, 100, 40))}))
    return found.select("request_id", "valid", "axes_too_large", "axes_large", "small", "n_apart", "many", "share", "advice")


_UNROUNDED = ", ".join(f"0.0 + x * {r[0]!r} + y * {r[1]!r} + z * {r[2]!r} + {r[3]!r} as {n}" for n, r in zip("xyz", base._INVERSE))


@query(points, with_points(f"vox as (select streamline_id, {_UNROUNDED} from points)") + f"""select count(distinct streamline_id) as n_streamlines,
  {', '.join(f'bool_and({a} >= 0 and {a} < {int(n)}) as {a}_inside' for a, n in zip('xyz', FOV))}, true as same_size, count(distinct streamline_id) < 100 as few, false as small_dim, false as large_dim from vox""")
def input_checks(p: DataFrame) -> DataFrame:
    shape = [int(n) for n in FOV]
    return validation.check_inputs(p, shape, shape, AFFINE)


@query(voxels, VOX + """select bool_and(i - 5 between 0 and 19 and j - 2 between 0 and 5 and k - 1 between 0 and 4) as inside, true as same_size, true as same_place,
  coalesce(bool_or(v <> 0), false) as filled from voxels where i between 5 and 24 and j between 2 and 7 and k between 1 and 5""")
def output_checks(v: DataFrame) -> DataFrame:
    from loomspan.operators.volumes import crop

    origin, size = (5, 2, 1), (20, 6, 5)
    moved = [[float(x) for x in row] for row in AFFINE]
    for row in moved[:3]:
        row[3] += sum(a * o for a, o in zip(row[:3], origin))
    return validation.check_output(crop(v, origin, size), origin, size, size, AFFINE, moved, 1)


_TO_VOXEL = POINTS_SQL.replace("points as (", "raw as (", 1) + f""",
vox as (select streamline_id, point_idx, {_UNROUNDED} from raw),
inner_ as (select streamline_id, cast(row_number() over {W} - 1 as integer) as point_idx, count(*) over (partition by streamline_id) as n_in, x, y, z from vox
  where {' and '.join(f'{a} >= 0 and {a} < {n!r}' for a, n in zip('xyz', FOV))}),
points as (select streamline_id, point_idx, x, y, z from inner_ where n_in >= 2)"""


@query(points, "with " + ",\n".join([_TO_VOXEL, SEGS, ARC, base.densify_sql(20.0)]) + f"\nselect streamline_id, pos, {rnd('x', 'y', 'z')} from dense")
def transform_densify(p: DataFrame) -> DataFrame:
    return streamlines.transform_and_densify(p, AFFINE, FOV, 20.0)


@query(points, with_points() + f"""select streamline_id from points group by 1 having {' and '.join(f'bool_or({a} >= {lo!r}) and bool_or({a} <= {hi!r})' for a, lo, hi in zip('xyz', LOW, HIGH))}""")
def bounds_keep_world(p: DataFrame) -> DataFrame:
    return streamlines.bounds_keep(p, LOW, HIGH, inclusive=True)


@query(points, with_points(SEGS, ARC, base.densify_sql(VIEW_STEP, count="floor"), "near_ as (select *, min(abs(y - 40.0)) over (partition by streamline_id) as distance from dense)") + """select streamline_id, pos,
  round(x, 6) + 0.0 as x, round(24.0 - z - 1.0, 6) + 0.0 as z, round(greatest(0.0, (1.0 - distance / 2.0) * 0.4), 6) + 0.0 as opacity from near_ where distance <= 2.0""")
def slice_projection(p: DataFrame) -> DataFrame:
    return drawing.slice_projection(p, 40.0, VIEW_STEP, 24.0)


@query(points, with_points() + "select streamline_id from points group by 1 having bool_or(abs(y - 40.0) < 2.0)")
def slice_overlay(p: DataFrame) -> DataFrame:
    return drawing.overlay(p, 40.0)


def _ramp_sql(tint: float) -> str:
    stops = [(a, g + tint * b) for a, g, b in drawing.STOPS]
    return "case " + " ".join(f"when t < {b!r} then {x!r} + (t - {a!r}) / ({b!r} - {a!r}) * ({y!r} - {x!r})" for (a, x), (b, y) in zip(stops, stops[1:])) + f" else {stops[-1][1]!r} end"


@query(pixels, PIX + base._NORM + f""", l as (select image_id, r, c, least(floor(least(greatest(v, 0.0), 1.0) * 256), 255) / 255.0e0 as t from norm)
select image_id, r, c, round({_ramp_sql(0.0)}, 6) + 0.0 as red, round({_ramp_sql(0.0)}, 6) + 0.0 as green, round({_ramp_sql(0.1)}, 6) + 0.0 as blue from l""")
def colour_map(x: DataFrame) -> DataFrame:
    return drawing.colour_map(images.normalize(x), 0.1)


@query(points, with_points() + "select streamline_id, " + ", ".join(
    f"round(least(greatest({b!r} + (2.0 * {uniform_sql(chr(39) + '42' + chr(39), chr(39) + n + chr(39), 'streamline_id')} - 1.0) * 0.2, {lo!r}), {hi!r}), 6) + 0.0 as {n}"
    for n, b, (lo, hi) in zip(("red", "green", "blue"), (1.0, 0.8, 0.1), drawing.TRACT_RANGES)) + " from (select distinct streamline_id from points)")
def tract_colours(p: DataFrame) -> DataFrame:
    return drawing.tract_colours(p.select("streamline_id").distinct())


@query(pixels, base._COMP + "select image_id, label, round(avg(r), 6) + 0.0 as r, round(avg(c), 6) + 0.0 as c, count(*) as n from labels group by 1, 2")
def bundle_centroids(x: DataFrame) -> DataFrame:
    return drawing.centroids(raster.components(x.where("v > 0.05")))


@query(pixels, base._COMP + "select image_id, label, area from areas qualify row_number() over (partition by image_id order by area desc, label) = 1")
def largest_component(x: DataFrame) -> DataFrame:
    return raster.components(x.where("v > 0.05")).groupBy("image_id", "label").agg(F.count("*").alias("area")).groupBy("image_id").agg(
        F.max(F.struct("area", (-F.col("label")).alias("l"))).alias("m")
    ).select("image_id", (-F.col("m.l")).cast("int").alias("label"), "m.area")


@query(pixels, PIX + """, t as (select a.range as r, b.range as c from range(12) a, range(5) b)
select image_id, cast(t.r as integer) as r, cast(t.c as integer) as c, round(v, 6) + 0.0 as v from t join pixels p on p.r = floor((t.r + 0.5) * 8 / 12) and p.c = floor((t.c + 0.5) * 8 / 5)""")
def resize_nearest(x: DataFrame) -> DataFrame:
    return drawing.resize_nearest(x, IMG, (12, 5))


@query(pixels, PIX + """, t as (select a.range as r, b.range as c from range(20) a, range(20) b)
select image_id, cast(t.r as integer) as r, cast(t.c as integer) as c, case when v > 0.1 then 255.0 else 0.0 end as v from t join pixels p on p.r = floor((t.r + 0.5) * 8 / 20) and p.c = floor((t.c + 0.5) * 8 / 20)""")
def resize_mask(x: DataFrame) -> DataFrame:
    return drawing.resize_nearest(x, IMG, (20, 20), 0.1)


@query(pixels, PIX + " select image_id, cast(7 - c as integer) as r, r as c, round(v, 6) + 0.0 as v from pixels")
def turn_slice(x: DataFrame) -> DataFrame:
    return drawing.turn(x, IMG)


@query(pixels, PIX + " select image_id, cast(7 - r as integer) as r, c, round(v, 6) + 0.0 as v from pixels")
def flip_slice(x: DataFrame) -> DataFrame:
    return drawing.flip(x, IMG)


@query(pixels, PIX + base._NORM + " select image_id, cast(least(floor(v * 50), 49) as integer) as bin, count(*) as n from norm group by 1, 2")
def slice_histogram(x: DataFrame) -> DataFrame:
    return drawing.histogram(images.normalize(x), 50, 0.0, 1.0)


@query(points, with_points(*base._GRID) + """, counts as (select gx, gy, gz, count(*) as n from gx join gy using (streamline_id) join gz using (streamline_id) group by 1, 2, 3)
select *, cast(row_number() over (order by n desc, gx, gy, gz) as integer) as rank from counts""")
def patch_grid_ranked(p: DataFrame) -> DataFrame:
    return drawing.fullest_first(base.patch_grid_counts(p), ("gx", "gy", "gz"))


def _preset_sql() -> str:
    total, upto, parts = sum(w for _, w in drawing.PRESETS), 0.0, []
    for name, w in drawing.PRESETS[:-1]:
        upto += w / total
        parts.append(f"when u < {upto!r} then '{name}'")
    return f"case {' '.join(parts)} else '{drawing.PRESETS[-1][0]}' end"


@query(pixels, PIX + f", u as (select image_id as id, {uniform_sql(chr(39) + '42' + chr(39), chr(39) + 'preset' + chr(39), 'image_id')} as u from (select distinct image_id from pixels)) select id, {_preset_sql()} as preset from u")
def preset_choice(x: DataFrame) -> DataFrame:
    return drawing.choose_preset(x.select(F.col("image_id").alias("id")).distinct())


@query(requests, REQUESTS_SQL + """, s as (select request_id, px as w, py as h, greatest(px, py) / 256.0e0 as k, px * py / 40000.0e0 as f from requests)
select request_id, w, h, greatest(1, cast(floor(2 * k) as integer)) as thickness, round(greatest(0.02e0, 0.15e0 / greatest(1.0e0, k * 1.5e0)), 6) + 0.0 as density, round(2.0e0 * k, 6) + 0.0 as sigma,
  greatest(1, cast(floor(20 * k * 0.001e0) as integer)) as bundle, round(case when least(1.0e0, f) < 0.8 then f else 1.0 end, 6) + 0.0 as noise from s""")
def size_parameters(r: DataFrame) -> DataFrame:
    return drawing.scale_parameters(r.select("request_id", F.col("px").alias("w"), F.col("py").alias("h")), thickness=2)


def _uniform(tag: str) -> str:
    return uniform_sql("'42'", f"'{tag}'", "image_id", "r", "c")


def _normal_sql(tag: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {_uniform(tag + '1')})) * cos(6.283185307179586 * {_uniform(tag + '2')}))"


@query(pixels, image_sql(f"v * (-0.4 * ln(1.0 - {_uniform('speckle')}))"))
def noise_speckle(x: DataFrame) -> DataFrame:
    return drawing.speckle(x, 0.4)


@query(pixels, PIX + base._NORM + f""", z as (select *, {', '.join(f"{_normal_sql(f'chi{k}x')} as z{k}" for k in range(3))} from norm),
h as (select *, (z0 + 1.5) * (z0 + 1.5) + z1 * z1 + z2 * z2 as chi from z)
select image_id, r, c, round(v * (1.0 + chi / max(chi) over (partition by image_id) * 0.5), 6) + 0.0 as v from h""")
def noise_chi(x: DataFrame) -> DataFrame:
    return drawing.chi_noise(x, 3, 2.25)


@query(pixels, PIX + base._NORM + base.gauss_sql(0.6, "norm") + " select image_id, r, c, round(b, 6) + 0.0 as v from g where b >= 0.4")
def smoothed_threshold(x: DataFrame) -> DataFrame:
    return images.gaussian(images.normalize(x), 0.6).where("v >= 0.4")
