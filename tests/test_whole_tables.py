"""Registered queries read whole streamlines; branches that the tables do not reach have small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from loomspan.operators import patches, streamlines
from loomspan.plans import catalogue, model
from tests.test_operators import lines

DATA = "/root/testdata/sf0.001"


def test_slab_rule_short_and_long(spark):
    short, far = [(0, 40, 0), (1, 90, 0)], [(0, 90, 0), (1, 95, 0)]
    long = [(k, 40 if k in (0, 1, 7, 8) else 90, 0) for k in range(9)]
    got = streamlines.slab_rule(lines(spark, short, far, long), 40.0, 15.0).collect()
    assert [r["y"] for r in sorted(got, key=lambda r: r["pos"]) if r["streamline_id"] == 0] == [40.0, 90.0]
    assert not [r for r in got if r["streamline_id"] == 1]
    assert len({r["seg_start"] for r in got if r["streamline_id"] == 2}) == 2


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_slab_rule_query_reads_whole_streamlines(spark):
    points = model.points(spark, DATA)
    inside = points.where(F.abs(F.col("y") - 40.0) <= 15.0).where("point_idx >= 11").count()
    got = catalogue.QUERIES["slab_rule"](spark, DATA)
    assert inside > 0 and got.where("seg_start >= 11").count() > 0
    assert got.count() > catalogue.QUERIES["slab_rule_short_long"](spark, DATA).count()


def test_region_limit(spark):
    p = lines(spark, *([(1, 1, 1), (9, 9, 9)] for _ in range(60)))
    ids = lambda *most: {r["streamline_id"] for r in patches.region_filter(p, (0, 0, 0), (2, 2, 2), *most).collect()}
    assert ids() == set(range(60)) and ids(7) == set(range(7))


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_region_query_has_the_default_limit(spark):
    p = model.points(spark, DATA)
    hit = p.where("x >= 20 and x < 60 and y >= 10 and y < 30 and z >= 4 and z < 10").select("streamline_id").distinct()
    assert catalogue.QUERIES["region_filter_default"](spark, DATA).select("streamline_id").distinct().count() == hit.count()
