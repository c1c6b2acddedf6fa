"""Tractograms as a stream: new files of a folder are read once each, with the batch decoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources import trk

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of TRK files as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.trk").load(path)
    return trk.decode(files)


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """Points and largest streamline number per file, kept up to date; state is one row a file."""
    return stream_points(spark, path).groupBy("tract_id").agg(
        F.count("*").alias("n_points"), (F.max("streamline_id") + 1).alias("n_streamlines")
    )
