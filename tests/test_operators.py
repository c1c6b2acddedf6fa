"""Hand-computed cases of the geometry and volume operators, and the file sources' round trips."""

import math

import numpy as np
import pytest

from loomspan.operators import patches, streamlines, volumes
from loomspan.sources import nifti, trk


def lines(spark, *all_points):
    rows = [(i, k, *map(float, p)) for i, line in enumerate(all_points) for k, p in enumerate(line)]
    return spark.createDataFrame(rows, "streamline_id long, point_idx int, x double, y double, z double")


def test_straight_line(spark):
    p = lines(spark, [(k, 0, 0) for k in range(4)])
    row = streamlines.metrics(p).first()
    assert (row["n_points"], row["length"], row["mean_curvature"]) == (4, 3.0, 0.0)
    assert streamlines.torsion(p).first()["mean_torsion"] == 0.0


def test_densify(spark):
    p = lines(spark, [(0, 0, 0), (1, 0, 0)], [(5, 5, 5)], [(0, 0, 0), (0.1, 0, 0)])
    got = streamlines.densify(p, 0.2).orderBy("streamline_id", "pos").collect()
    assert [round(r["x"], 9) for r in got if r["streamline_id"] == 0] == [0, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert [r["x"] for r in got if r["streamline_id"] == 1] == [5.0]
    assert [r["x"] for r in got if r["streamline_id"] == 2] == [0.0, 0.1]


@pytest.mark.parametrize("method", ["linear", "hermite", "catmull"])
def test_densify_keeps_ends_and_repeated_points(spark, method):
    t = np.linspace(0, 6, 20)
    helix = np.stack([np.cos(t), np.sin(t), 0.1 * t], 1).tolist()
    p = lines(spark, helix + [helix[-1]], [helix[0]] + helix)
    for i in (0, 1):
        got = streamlines.densify(p, 0.1, method).where(f"streamline_id = {i}").orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(len(got)))
        for r, want in ((got[0], helix[0]), (got[-1], helix[-1])):
            assert max(abs(r[a] - w) for a, w in zip("xyz", want)) < 1e-9


def test_clip_single_inside_point(spark):
    p = lines(spark, [(-5, -5, -5), (10, 10, 10), (25, 25, 25)])
    got = streamlines.clip_segments(p, (20, 20, 20)).orderBy("kind", "pos").collect()
    assert [(r["kind"], r["x"]) for r in got] == [(1, 10.0), (1, 19.0), (2, 0.0), (2, 10.0)]


def test_clip_inside_is_unchanged(spark):
    p = lines(spark, [(k, k, k) for k in range(5)])
    assert streamlines.clip_segments(p, (20, 20, 20)).count() == 5
    assert streamlines.clip_joined(lines(spark, [(-1, 0, 0), (1, 1, 1)]), (8, 8, 8)).count() == 0


def test_target_affine_and_shape():
    a = volumes.target_affine(np.eye(4), (100,) * 3, (2,) * 3, (50,) * 3)
    assert np.allclose(np.diag(a)[:3], 2) and np.allclose(a[:3, 3], 0.5)
    assert volumes.target_shape((400, 50, 400), (0.05,) * 3, 0.1) == (200, 32, 200)


def test_resample_edges(spark):
    v = spark.createDataFrame([(0, 0, 0, 8.0)], "i int, j int, k int, v double")
    half = lambda m: volumes.resample(v, (1, 1, 1), (1, 1, 1), (-0.5, 0, 0), m).first()["v"]
    assert half("nearest") == 8.0 and half("trilinear") == 4.0


def test_subdivisions_and_sample(spark):
    assert patches.subdivisions(spark, 8, (10, 10, 10)).agg({"oz": "max"}).first()[0] == 5
    assert streamlines.sample_percent(lines(spark, *[[(0, 0, 0)]] * 3), 0.0).count() == 1
    assert streamlines.sample_percent(lines(spark, *[[(0, 0, 0)]] * 3), 100.0).count() == 3


def test_isolated_returns_all_without_touch(spark):
    p = lines(spark, [(0, 0, 0)], [(1, 0, 0)])
    assert patches.isolated(p, "y", 50.0, 1.0, 1).count() == 2
    assert patches.isolated(p, "y", 0.0, 1.5, 1).count() == 2
    assert patches.isolated(p, "y", 0.0, 0.5, 1).count() == 0


def test_nifti_round_trip(spark, tmp_path):
    volume = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    affine = np.array([[-2.0, 0, 0, 5], [0, 3, 0, 1], [0, 0, 4, 2], [0, 0, 0, 1]])
    (tmp_path / "a.nii").write_bytes(nifti.write_bytes(volume, affine))
    got = {(r["i"], r["j"], r["k"]): r["v"] for r in nifti.read_voxels(spark, str(tmp_path)).collect()}
    assert len(got) == 24 and all(got[i] == volume[i] for i in np.ndindex(2, 3, 4))
    head = nifti.read_headers(spark, str(tmp_path)).first()
    assert head["shape"] == [2, 3, 4] and np.allclose(head["affine"], affine) and head["axcodes"] == ["L", "A", "S"]
    turned, moved = nifti.canonical(volume, affine)
    assert turned[0, 0, 0] == volume[1, 0, 0] and np.allclose(moved @ [0, 0, 0, 1], affine @ [1, 0, 0, 1])


def test_trk_round_trip(spark, tmp_path):
    wanted = [np.array([[1, 2, 3], [4, 5, 6.5]]), np.array([[0, 0, 0], [1, 1, 1], [2, 2, 2.25]])]
    affine = np.diag([2.0, 2.0, 2.0, 1.0])
    (tmp_path / "a.trk").write_bytes(trk.write_bytes(wanted, affine, (10, 10, 10)))
    assert trk.list_files(spark, str(tmp_path)).count() == 1
    got = trk.read_points(spark, str(tmp_path)).orderBy("streamline_id", "point_idx").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], np.concatenate(wanted), atol=1e-5)
    assert math.isclose(streamlines.lengths(trk.read_points(spark, str(tmp_path))).where("streamline_id = 0").first()["length"], np.linalg.norm([3, 3, 3.5]), rel_tol=1e-6)


def test_stream_counts(spark, tmp_path):
    from loomspan.streaming.tracts import stream_counts

    (tmp_path / "a.trk").write_bytes(trk.write_bytes([np.zeros((3, 3)), np.ones((2, 3))], np.eye(4), (5, 5, 5)))
    query = stream_counts(spark, str(tmp_path)).writeStream.format("memory").queryName("tract_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["n_points"], r["n_streamlines"]) for r in spark.table("tract_counts").collect()] == [(5, 2)]
