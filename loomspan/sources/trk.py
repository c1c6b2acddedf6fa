"""TRK streamline files as rows (tract_id, streamline_id, point_idx, x, y, z) in world coordinates, and their writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_SCHEMA = "tract_id string, streamline_id long, point_idx int, x float, y float, z float"
HEADER = 1000


def parse_header(data: bytes) -> dict:
    """Dimensions, voxel sizes, voxel-to-world matrix, numbers of scalars and properties, number of streamlines."""
    if data[:5] != b"TRACK":
        raise ValueError("not a TRK file")
    order = "<" if struct.unpack_from("<i", data, 996)[0] == HEADER else ">"
    matrix = np.array(struct.unpack_from(order + "16f", data, 440)).reshape(4, 4)
    sizes = struct.unpack_from(order + "3f", data, 12)
    return {
        "order": order,
        "dimensions": struct.unpack_from(order + "3h", data, 6),
        "voxel_sizes": sizes,
        "voxel_to_rasmm": matrix if matrix[3, 3] else np.diag([*sizes, 1.0]),
        "n_scalars": struct.unpack_from(order + "h", data, 36)[0],
        "n_properties": struct.unpack_from(order + "h", data, 238)[0],
        "n_count": struct.unpack_from(order + "i", data, 988)[0],
    }


def streamlines(data: bytes) -> Iterator[np.ndarray]:
    """World coordinates of each streamline; stored points are in voxel millimetres, measured from a voxel's corner."""
    head = parse_header(data)
    matrix, sizes, width = head["voxel_to_rasmm"], np.asarray(head["voxel_sizes"]), 3 + head["n_scalars"]
    at = HEADER
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(head["order"] + "i", data, at)
        stored = np.frombuffer(data, head["order"] + "f4", n * width, at + 4).reshape(n, width)[:, :3]
        at += 4 + 4 * (n * width + head["n_properties"])
        voxel = stored.astype(float) / sizes - 0.5
        yield (voxel @ matrix[:3, :3].T + matrix[:3, 3]).astype(np.float32)


def write_bytes(lines: list[np.ndarray], matrix: np.ndarray, dimensions: tuple[int, int, int]) -> bytes:
    """A TRK file of streamlines in world coordinates."""
    matrix = np.asarray(matrix, float)
    sizes, inverse = np.linalg.norm(matrix[:3, :3], axis=0), np.linalg.inv(matrix)
    head = bytearray(HEADER)
    head[:5] = b"TRACK"
    struct.pack_into("<3h", head, 6, *dimensions)
    struct.pack_into("<3f", head, 12, *sizes)
    struct.pack_into("<16f", head, 440, *matrix.ravel())
    head[948:951] = b"RAS"
    struct.pack_into("<3i", head, 988, len(lines), 2, HEADER)
    out = [bytes(head)]
    for line in lines:
        voxel = np.asarray(line, float) @ inverse[:3, :3].T + inverse[:3, 3]
        out += [struct.pack("<i", len(line)), ((voxel + 0.5) * sizes).astype("<f4").tobytes()]
    return b"".join(out)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the TRK files directly in a folder, sorted by path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.trk").load(path).select("path", "length").orderBy("path")


def decode(files: DataFrame) -> DataFrame:
    """Points of files given as (path, content), a bounded number of streamlines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tract_id", "streamline_id", "point_idx", "x", "y", "z"]
        for batch in batches:
            for row in batch.to_pylist():
                held, first, size = [], 0, 0
                for number, line in enumerate(streamlines(row["content"])):
                    held.append(line)
                    size += len(line)
                    if size > 50_000:
                        yield _rows(row["path"], first, held, names)
                        held, first, size = [], number + 1, 0
                if held:
                    yield _rows(row["path"], first, held, names)

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, POINT_SCHEMA)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """All points of all TRK files of a folder."""
    return decode(spark.read.format("binaryFile").option("pathGlobFilter", "*.trk").load(path))


def _rows(path: str, first: int, lines: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    n = np.array([len(x) for x in lines])
    every = np.concatenate(lines)
    ids = np.repeat(np.arange(first, first + len(lines)), n)
    place = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.float32(), pa.float32(), pa.float32())
    columns = ([path] * len(every), ids, place, *every.T)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
