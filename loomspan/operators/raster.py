"""Raster operators: density maps by line drawing, thresholds, dilation, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def density(points: DataFrame, at: float, thickness: float, dims: tuple[int, int, int]) -> DataFrame:
    """(r, c, n): lines drawn between successive kept points of each streamline, in the (x, z) plane, z upside down.

    A point is kept within 2 x ``thickness`` of the slice along y and inside the image. A line steps along its longer
    axis, one pixel each, the other coordinate rounded half up; it adds one to each of its pixels.
    """
    order = Window.partitionBy("streamline_id").orderBy("point_idx")
    kept = points.where(F.abs(F.col("y") - at) <= 2 * thickness).select(
        "streamline_id", "point_idx", F.col("x").cast("int").alias("c"), (dims[2] - F.col("z").cast("int") - 1).alias("r")
    )
    kept = kept.where((F.col("c") >= 0) & (F.col("c") < dims[0]) & (F.col("r") >= 0) & (F.col("r") < dims[2]))
    lines = kept.withColumns({"c1": F.lead("c").over(order), "r1": F.lead("r").over(order)}).where("c1 is not null")
    dc, dr = F.col("c1") - F.col("c"), F.col("r1") - F.col("r")
    n = F.greatest(F.abs(dc), F.abs(dr))
    lines = lines.withColumns({"n": n, "dc": dc, "dr": dr}).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = lambda d: F.when(F.col("n") == 0, F.lit(0)).otherwise(F.floor((2 * F.col(d) * F.col("m") + F.col("n")) / (2 * F.greatest("n", F.lit(1))))).cast("int")
    return lines.select((F.col("r") + part("dr")).alias("r"), (F.col("c") + part("dc")).alias("c")).groupBy("r", "c").agg(F.count("*").alias("n"))


def dilate(mask: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """A mask (r, c) grown by a disk: offsets are exploded beside each pixel."""
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disk))).alias("o")
    out = mask.select("r", "c", offsets).select((F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"))
    return out.where((F.col("r") >= 0) & (F.col("r") < shape[0]) & (F.col("c") >= 0) & (F.col("c") < shape[1])).distinct()


def components(pixels: DataFrame, diagonal: bool = True) -> DataFrame:
    """(image_id, r, c, label): components of the pixels of each image, numbered from 1 in row order.

    Pixels that touch at an edge are neighbours, and with ``diagonal`` those that touch at a corner.

    An image is one array; images are independent, so each is labelled by itself in one pass of unions.
    """

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        at = {p: i for i, p in enumerate(zip(r.tolist(), c.tolist()))}
        root = list(range(len(r)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (y, x), i in at.items():
            for near in ((y - 1, x), (y, x - 1), (y - 1, x - 1), (y - 1, x + 1))[: 4 if diagonal else 2]:
                if (j := at.get(near)) is not None:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        names: dict[int, int] = {}
        label = [names.setdefault(find(i), len(names) + 1) for i in range(len(r))]
        ids = table.column("image_id").take(pa.array(order))
        return pa.Table.from_arrays(
            [ids, pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(label, pa.int32())], ["image_id", "r", "c", "label"]
        )

    return pixels.select("image_id", "r", "c").groupBy("image_id").applyInArrow(run, "image_id long, r int, c int, label int")


def areas(labels: DataFrame) -> DataFrame:
    """Area and centre of each component."""
    return labels.groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.avg("r").alias("center_r"), F.avg("c").alias("center_c")
    )


def large(labels: DataFrame, least: int) -> DataFrame:
    """Pixels of components of at least ``least`` pixels."""
    kept = areas(labels).where(F.col("area") >= least).select("image_id", "label")
    return labels.join(kept, ["image_id", "label"], "left_semi").select("image_id", "r", "c", "label")


def top_components(labels: DataFrame, top: int = 4) -> DataFrame:
    """The largest components of each image; ties keep label order."""
    order = Window.partitionBy("image_id").orderBy(F.desc("area"), "label")
    return areas(labels).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("image_id", "label", "area", "rank")


def close_gaps(pixels: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """Morphological closing of each image's mask (r, c): dilation by a disk, then erosion by it."""
    span = range(-radius, radius + 1)
    disk = [(a, b) for a in span for b in span if a * a + b * b <= radius * radius]

    def one(table: pa.Table) -> pa.Table:
        pad = 2 * radius
        grid = np.zeros((shape[0] + 2 * pad, shape[1] + 2 * pad), bool)
        grid[table.column("r").to_numpy() + pad, table.column("c").to_numpy() + pad] = True
        grown = np.zeros_like(grid)
        for a, b in disk:
            grown |= np.roll(grid, (a, b), (0, 1))
        kept = np.ones_like(grid)
        for a, b in disk:
            kept &= np.roll(grown, (a, b), (0, 1))
        r, c = np.nonzero(kept[pad : pad + shape[0], pad : pad + shape[1]])
        ids = pa.array([table.column("image_id")[0].as_py()] * len(r), pa.int64())
        return pa.Table.from_arrays([ids, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32))], ["image_id", "r", "c"])

    return pixels.select("image_id", "r", "c").groupBy("image_id").applyInArrow(one, "image_id long, r int, c int")
