"""Projections of the driver's tables into streamline points, voxels and pixels, and shared expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Volume shape of ``voxels`` and field of view for the points.
SHAPE = (50, 11, 9)
FOV = (200.0, 60.0, 20.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(streamline_id, point_idx, x, y, z) from events, one streamline per user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("streamline_id"),
        (F.row_number().over(order) - 1).alias("point_idx"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.hour("ts").cast("double").alias("z"),
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, k, v) from lineitem; v is a rounded mean price."""
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(
            (F.col("l_quantity") - 1).cast("int").alias("i"),
            F.round(F.col("l_discount") * 100).cast("int").alias("j"),
            F.round(F.col("l_tax") * 100).cast("int").alias("k"),
        )
        # an exact decimal sum, and rounding by floor: the same number in any engine and order of rows
        .agg((F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*") + 0.5) / 1000.0).alias("v"))
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, r, c, v): embeddings as 8 x 8 images."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e")
    ).select(
        "image_id",
        F.expr("cast(p div 8 as int)").alias("r"),
        (F.col("p") % 8).cast("int").alias("c"),
        F.col("e").cast("double").alias("v"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, negative zero as zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# the same projections for the SQL counterparts
POINTS_SQL = """points as (
  select user_id as streamline_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as point_idx,
         value as x, cast(props->>'$.k' as double) as y, cast(hour(ts) as double) as z from events)"""
VOXELS_SQL = """voxels as (
  select cast(l_quantity - 1 as integer) as i, cast(round(l_discount * 100) as integer) as j,
         cast(round(l_tax * 100) as integer) as k, floor(cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) + 0.5) / 1000.0e0 as v
  from lineitem group by 1, 2, 3)"""
PIXELS_SQL = """pixels as (
  select vec_id as image_id, cast(p // 8 as integer) as r, cast(p % 8 as integer) as c, cast(embedding[p + 1] as double) as v
  from embeddings, (select unnest(range(64)) as p))"""


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(f'cast({p} as varchar)' for p in parts)}), 1, 8))::bigint / 4294967296.0)"
