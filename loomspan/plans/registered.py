"""Queries of registration, patch synthesis and tissue masks, with their SQL counterparts."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import effects, images, raster, registration
from loomspan.plans import catalogue as base
from loomspan.plans.catalogue import AFFINE, IMG, ORACLE, QUERIES, VOX, nudged, nudged_sql, query, with_points
from loomspan.plans.model import PIXELS_SQL, SHAPE, VOXELS_SQL, pixels, points, rounded, voxels

FIXED_TO_MOVING = [[1.0, 0.05, 0.0, -2.0], [0.0, 0.9, 0.02, 1.0], [0.03, 0.0, 1.1, 0.5], [0.0, 0.0, 0.0, 1.0]]
VOXEL_TO_FIXED = [[4.0, 0.0, 0.0, -3.0], [0.0, 5.5, 0.0, 1.0], [0.0, 0.0, 2.6, 0.5], [0.0, 0.0, 0.0, 1.0]]
VOXEL_TO_MOVING = [[4.4, 0.0, 0.0, -1.0], [0.0, 5.0, 0.0, 0.0], [0.0, 0.0, 2.4, 0.25], [0.0, 0.0, 0.0, 1.0]]
#: Each component of the field, as a share of the voxel's value.
SHARES = (0.1, -0.05, 0.025)


def field(v: DataFrame) -> DataFrame:
    """A displacement field made from the volume."""
    return v.select("i", "j", "k", *((F.col("v") * s).alias(d) for d, s in zip(registration.SHIFT, SHARES)))


def linear_sql(matrix, out: str, names: str = "x y z") -> str:
    a, b, c = names.split()
    return ", ".join(f"{a} * {r[0]!r} + {b} * {r[1]!r} + {c} * {r[2]!r} + {r[3]!r} as {o}" for r, o in zip(np.asarray(matrix).tolist(), out.split()))


_INSIDE = " and ".join(f"{w} between 0 and {n - 1}" for w, n in zip(registration.PLACE, SHAPE))
_CORNERS = "select *, " + ", ".join(f"cast(floor({w}) + {o}.range as integer) as {c}" for w, o, c in zip(registration.PLACE, "abc", ("qi", "qj", "qk")))
_WEIGHT = " * ".join(f"(1.0 - abs({w} - {c}))" for w, c in zip(registration.PLACE, ("qi", "qj", "qk")))
_OFFSETS = "range(2) a, range(2) b, range(2) c"
_LOOKUP = "left join voxels m on m.i = qi and m.j = qj and m.k = qk"

_BACK = np.linalg.inv(FIXED_TO_MOVING)
_GRID = np.linalg.inv(VOXEL_TO_FIXED)
_MIDDLE = (np.asarray(VOXEL_TO_FIXED) @ [*((n - 1) / 2 for n in SHAPE), 1.0]).tolist()
_WARPED = [
    VOXELS_SQL,
    f"placed as (select streamline_id, point_idx, {linear_sql(_BACK, 'x y z')}, {linear_sql(_GRID @ _BACK, 'wx wy wz')} from points)",
    f"corners as ({_CORNERS} from placed, {_OFFSETS})",
    f"summed as (select streamline_id, point_idx, x, y, z, sum(case when {_INSIDE} then {_WEIGHT} * coalesce(m.v, 0.0) else 0.0 end) as d from corners {_LOOKUP} group by 1, 2, 3, 4, 5)",
    f"warped as (select streamline_id, point_idx, x + d * {SHARES[0]!r} as x, {2 * _MIDDLE[1]!r} - (y + d * {SHARES[1]!r}) as y, z + d * {SHARES[2]!r} as z from summed)",
]


def _warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.warp_streamlines(points(spark, sf_dir), field(voxels(spark, sf_dir)), FIXED_TO_MOVING, VOXEL_TO_FIXED, SHAPE, ("y",))


def register_streamlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse affine, displacement, and a mirror along y."""
    return rounded(nudged(_warped(spark, sf_dir), "x", "y", "z"))


def register_to_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same points as voxel coordinates, without streamlines that miss the volume."""
    return rounded(nudged(registration.into_volume(_warped(spark, sf_dir), VOXEL_TO_FIXED, SHAPE), "x", "y", "z"))


def register_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume, moved onto the field's grid."""
    v = voxels(spark, sf_dir)
    return rounded(nudged(registration.warp_volume(v, field(v), FIXED_TO_MOVING, VOXEL_TO_FIXED, VOXEL_TO_MOVING, SHAPE), "v"))


QUERIES |= {"register_streamlines": register_streamlines, "register_to_voxels": register_to_voxels, "register_volume": register_volume}
ORACLE["register_streamlines"] = with_points(*_WARPED) + f"select streamline_id, point_idx, {nudged_sql('x', 'y', 'z')} from warped"
ORACLE["register_to_voxels"] = with_points(*_WARPED, f"vox as (select streamline_id, point_idx, {linear_sql(_GRID, 'x y z')} from warped)") + f"""select streamline_id, point_idx,
  {', '.join(f'round(least(greatest({a}, 0.0), {n - 1e-3!r}) + {base.NUDGE}, 6) + 0.0 as {a}' for a, n in zip('xyz', SHAPE))} from vox
  where streamline_id in (select streamline_id from vox group by 1 having count(*) >= 2 and bool_or({' and '.join(f'{a} >= 0 and {a} < {n}' for a, n in zip('xyz', SHAPE))}))"""
ORACLE["register_volume"] = VOX.rstrip() + f""", f0 as (select i, j, k, v, cast(i as double) as x, cast(j as double) as y, cast(k as double) as z from voxels),
f1 as (select i, j, k, v, {linear_sql(VOXEL_TO_FIXED, 'x y z')} from f0),
f2 as (select i, j, k, x + v * {SHARES[0]!r} as x, y + v * {SHARES[1]!r} as y, z + v * {SHARES[2]!r} as z from f1),
f3 as (select i, j, k, {linear_sql(np.linalg.inv(VOXEL_TO_MOVING) @ np.asarray(FIXED_TO_MOVING), 'wx wy wz')} from f2),
corners as ({_CORNERS} from f3, {_OFFSETS})
select c.i, c.j, c.k, round(sum(case when {_INSIDE} then {_WEIGHT} * coalesce(m.v, 0.0) else 0.0 end) + {base.NUDGE}, 6) + 0.0 as v from corners c {_LOOKUP} group by 1, 2, 3"""

_LOW, _HIGH, _SIZE, _ZOOM = (-3, 2, 1), (24, 20, 7), (20, 10, 8), 1.75
_MATRIX = np.eye(4)
_MATRIX[:3, :3] = np.linalg.inv(np.asarray(AFFINE)[:3, :3]) * _ZOOM


@query(voxels, VOX.rstrip() + f""", t as (select cast(a.range as integer) as i, cast(b.range as integer) as j, cast(c.range as integer) as k, cast(a.range as double) as x, cast(b.range as double) as y, cast(c.range as double) as z
  from range({_SIZE[0]}) a, range({_SIZE[1]}) b, range({_SIZE[2]}) c),
p as (select i, j, k, {linear_sql(_MATRIX, 'wx wy wz')} from t),
corners as ({_CORNERS} from p, {_OFFSETS}),
box as (select i - 0 as bi, j - 2 as bj, k - 1 as bk, v from voxels where i between 0 and 23 and j between 2 and {SHAPE[1] - 1} and k between 1 and 6)
select i, j, k, round(sum({_WEIGHT} * coalesce(v, 0.0)) + {base.NUDGE}, 6) + 0.0 as v from corners left join box on bi = qi and bj = qj and bk = qk group by 1, 2, 3""")
def patch_synthesis(v: DataFrame) -> DataFrame:
    return nudged(registration.synthesize_patch(v.sparkSession, v, AFFINE, SHAPE, _LOW, _HIGH, _ZOOM, _SIZE), "v")


_CUT, _LEAST = 0.4, 6
_REGION = f"""with recursive {PIXELS_SQL}{base._NORM},
disk as (select a.range as a, b.range as b, sqrt(a.range * a.range + b.range * b.range) as d from range(-2, 3) a, range(-2, 3) b where a.range * a.range + b.range * b.range <= 4),
grown as (select distinct image_id, r + a as r, c + b as c from norm, disk where v > {_CUT}),
missed as (select image_id, r, c from norm anti join grown using (image_id, r, c)),
eaten as (select distinct image_id, r + a as r, c + b as c from missed, disk),
closed as (select image_id, r, c from norm anti join eaten using (image_id, r, c)),
walk(image_id, root, r, c) as (select image_id, r * 8 + c, r, c from closed union
  select w.image_id, w.root, o.r, o.c from walk w join closed o on o.image_id = w.image_id and abs(o.r - w.r) + abs(o.c - w.c) <= 1),
roots as (select image_id, r, c, min(root) as root from walk group by 1, 2, 3),
region as (select image_id, r, c from (select *, count(*) over (partition by image_id, root) as n from roots) where n >= {_LEAST})"""


@query(pixels, _REGION + " select image_id, r, c from region")
def tissue_region(x: DataFrame) -> DataFrame:
    return effects.tissue_region(images.normalize(x), IMG, _CUT, _LEAST)


_FADED = f""",
outside as (select image_id, r, c from norm anti join region using (image_id, r, c)),
near_ as (select image_id, r + a as r, c + b as c, min(d) as d from outside, disk group by 1, 2, 3),
dark as (select image_id, r, c, pow(v, 1.8) * 0.5 as v from norm){base.gauss_sql(0.4, 'dark')},
faded as (select g.image_id, g.r, g.c, case when b < 0.04 or e.r is null then 0.0 else b * least(coalesce(n.d, 2.0) / 2.0, 1.0) end as v
  from g left join region e on e.image_id = g.image_id and e.r = g.r and e.c = g.c left join near_ n on n.image_id = g.image_id and n.r = g.r and n.c = g.c)"""


@query(pixels, _REGION + _FADED + re.sub(r"\bg([12]?)\b", r"h\1", base.gauss_sql(0.2, "faded")) + " select image_id, r, c, round(b, 6) + 0.0 as v from h")
def blockface_dark_field(x: DataFrame) -> DataFrame:
    return effects.blockface_dark_field(images.normalize(x), IMG, 1.8, 0.04, _CUT, _LEAST)


@query(pixels, base._COMP + """select distinct image_id, label, cast(r + a.range as integer) as r, cast(c + b.range as integer) as c from labels, range(-1, 2) a, range(-1, 2) b
where abs(a.range) + abs(b.range) <= 1 and r + a.range between 0 and 7 and c + b.range between 0 and 7""")
def bundle_dilate(x: DataFrame) -> DataFrame:
    return effects.spread(raster.components(x.where("v > 0.05")), 1, IMG, ("image_id", "label"))
