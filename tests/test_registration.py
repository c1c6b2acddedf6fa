"""Hand-computed cases of registration, patch synthesis and tissue masks."""

import struct

import numpy as np
import pytest

from loomspan.operators import effects, registration

EYE = np.eye(4).tolist()


def matrix(name, values, kind=0):
    data = np.asarray(values, "<f8" if kind == 0 else "<f4")
    return struct.pack("<5i", kind, len(data), 1, 0, len(name) + 1) + name.encode() + b"\0" + data.tobytes()


@pytest.mark.parametrize("name, kind", [("AffineTransform_double_3_3", 0), ("AffineTransform_float_3_3", 10)])
def test_affine_file(name, kind):
    data = matrix(name, [2, 0, 0, 0, 1, 0, 0, 0, 1, 5, 6, 7], kind) + matrix("fixed", [10, 0, 0])
    # LPS: x -> 2 x + 5 - 10, y -> y + 6; in RAS the shifts of x and y change sign
    assert np.allclose(registration.read_affine(data), [[2, 0, 0, 5], [0, 1, 0, -6], [0, 0, 1, 7], [0, 0, 0, 1]])


def test_affine_file_without_matrix_or_centre():
    for data in (matrix("fixed", [0, 0, 0]), matrix("AffineTransform_double_3_3", range(12)), b""):
        with pytest.raises(KeyError):
            registration.read_affine(data)


def test_flips():
    assert registration.flips(np.diag([-1.0, 2, 3, 1])) == (True, False, False)


def constant_field(spark, n, shift):
    rows = [(i, j, k, *shift) for i in range(n) for j in range(n) for k in range(n)]
    return spark.createDataFrame(rows, "i int, j int, k int, dx double, dy double, dz double")


def test_constant_field_moves_points_inside_only(spark):
    p = spark.createDataFrame([(1, 0, 1.5, 1.0, 0.25), (1, 1, 9.0, 0.0, 0.0)], "streamline_id long, point_idx int, x double, y double, z double")
    got = registration.warp_streamlines(p, constant_field(spark, 4, (1.0, 2.0, -0.5)), EYE, EYE, (4, 4, 4)).orderBy("point_idx").collect()
    assert np.allclose([r[2:] for r in got], [[2.5, 3.0, -0.25], [9.0, 0.0, 0.0]])
    turned = registration.warp_streamlines(p, constant_field(spark, 4, (0.0, 0.0, 0.0)), EYE, EYE, (4, 4, 4), ("x",)).orderBy("point_idx").collect()
    assert [r["x"] for r in turned] == [1.5, -6.0]


def test_into_volume(spark):
    rows = [(1, 0, 1.0, 1.0, 1.0), (1, 1, 9.0, -1.0, 1.0), (2, 0, 1.0, 1.0, 1.0), (3, 0, 9.0, 9.0, 9.0), (3, 1, 8.0, 8.0, 8.0)]
    p = spark.createDataFrame(rows, "streamline_id long, point_idx int, x double, y double, z double")
    got = registration.into_volume(p, EYE, (4, 4, 4)).orderBy("point_idx").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1.0, 1.0, 1.0), (1, 1, 3.999, 0.0, 1.0)]
    assert registration.into_volume(p.limit(0), EYE, (4, 4, 4)).count() == 0


def volume(spark, n):
    rows = [(i, j, k, float(i + 10 * j + 100 * k)) for i in range(n) for j in range(n) for k in range(n)]
    return spark.createDataFrame(rows, "i int, j int, k int, v double")


def test_constant_field_moves_a_volume(spark):
    got = registration.warp_volume(volume(spark, 3), constant_field(spark, 3, (1.0, 0.0, 0.0)), EYE, EYE, EYE, (3, 3, 3))
    assert {(r["i"], r["j"], r["k"]): r["v"] for r in got.collect() if r["j"] == r["k"] == 0} == {(0, 0, 0): 1.0, (1, 0, 0): 2.0, (2, 0, 0): 0.0}


def test_patch_of_half_voxels(spark):
    got = registration.synthesize_patch(spark, volume(spark, 4), EYE, (4, 4, 4), (-2, 1, 1), (4, 9, 4), 0.5, (3, 1, 1))
    assert {r["i"]: r["v"] for r in got.collect()} == {0: 110.0, 1: 110.5, 2: 111.0}
    assert np.allclose(registration.patch_affine(EYE, (-2, 1, 1), 0.5), [[0.5, 0, 0, 0], [0, 0.5, 0, 1], [0, 0, 0.5, 1], [0, 0, 0, 1]])


def pixels(spark, image):
    rows = [(0, r, c, float(v)) for (r, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image_id long, r int, c int, v double")


def test_tissue_region_closes_a_gap_and_drops_specks(spark):
    image = np.zeros((12, 12))
    image[:, :4] = 1.0
    image[5, 1] = 0.0
    image[10, 10] = 1.0
    got = {(r["r"], r["c"]) for r in effects.tissue_region(pixels(spark, image), (12, 12), 0.5, 10).collect()}
    assert got == {(r, c) for r in range(12) for c in range(4)}


def test_dark_field_without_background_keeps_a_constant(spark):
    got = effects.blockface_dark_field(pixels(spark, np.full((6, 6), 0.8)), (6, 6), least=4).collect()
    assert len(got) == 36 and all(abs(r["v"] - 0.5 * 0.8**1.8) < 1e-12 for r in got)
    assert all(r["v"] == 0.0 for r in effects.blockface_dark_field(pixels(spark, np.zeros((6, 6))), (6, 6)).collect())
