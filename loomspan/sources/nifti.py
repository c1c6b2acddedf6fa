"""NIfTI-1 volumes as rows: reader over any store that Spark reads, header parsing, canonical orientation, writer.

Files come in through Spark's ``binaryFile`` source, so globbing, object stores and task placement are Spark's. Voxels
leave as (volume_id, i, j, k, v), one row per voxel of the first volume.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# NIfTI-1 data type codes.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
VOXEL_SCHEMA = "volume_id string, i int, j int, k int, v float"
HEADER_SCHEMA = "volume_id string, shape array<int>, zooms array<double>, kind string, affine array<array<double>>, axcodes array<string>"


@dataclass
class Header:
    shape: tuple[int, ...]
    zooms: tuple[float, ...]
    kind: np.dtype
    offset: int
    slope: float
    intercept: float
    affine: np.ndarray

    @property
    def axcodes(self) -> list[str]:
        """The anatomical direction of each voxel axis."""
        best = np.abs(self.affine[:3, :3]).argmax(axis=0)
        return [("LR", "PA", "IS")[b][int(self.affine[b, a] > 0)] for a, b in enumerate(best)]


def _bytes(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse_header(data: bytes) -> Header:
    """The 348-byte header, in either byte order; sform before qform before plain voxel sizes."""
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", data, 40)
    (code,) = struct.unpack_from(order + "h", data, 70)
    pixdim = struct.unpack_from(order + "8f", data, 76)
    offset, slope, intercept = struct.unpack_from(order + "3f", data, 108)
    qform, sform = struct.unpack_from(order + "2h", data, 252)
    affine = np.diag([*pixdim[1:4], 1.0])
    if sform > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", data, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *shift = struct.unpack_from(order + "6f", data, 256)
        a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        affine[:3, :3] = turn * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1.0 if pixdim[0] < 0 else 1.0)])
        affine[:3, 3] = shift
    return Header(tuple(dim[1 : dim[0] + 1]), tuple(pixdim[1 : dim[0] + 1]), np.dtype(order + KINDS[code]), int(offset), slope, intercept, affine)


def read_array(content: bytes) -> tuple[np.ndarray, Header]:
    """The first volume as float32, scaled by slope and intercept where the header gives them."""
    data = _bytes(content)
    head = parse_header(data)
    if len(head.shape) < 3:
        raise ValueError("a volume needs three dimensions")
    n = int(np.prod(head.shape[:3]))
    flat = np.frombuffer(data, head.kind, n, head.offset).astype(np.float32)
    if head.slope not in (0.0, 1.0) or head.intercept:
        flat = flat * np.float32(head.slope or 1.0) + np.float32(head.intercept)
    return flat.reshape(head.shape[:3], order="F"), head


def canonical(volume: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes permuted and flipped so that voxel axes run along +x, +y, +z."""
    best = np.abs(affine[:3, :3]).argmax(axis=0)
    perm = np.argsort(best)
    out, change = volume.transpose(perm), np.zeros((4, 4))
    change[3, 3] = 1.0
    for new, old in enumerate(perm):
        flip = affine[best[old], old] < 0
        change[old, new] = -1.0 if flip else 1.0
        if flip:
            change[old, 3] = volume.shape[old] - 1
            out = np.flip(out, new)
    return out, affine @ change


def write_bytes(volume: np.ndarray, affine: np.ndarray) -> bytes:
    """A single-file NIfTI-1 image of float32 voxels."""
    zooms = np.linalg.norm(np.asarray(affine)[:3, :3], axis=0)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *volume.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *zooms, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(affine, float)[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(volume, "<f4").tobytes(order="F")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.nii*").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: shape, voxel sizes, type, affine, axis codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = parse_header(_bytes(row["content"]))
                yield pa.RecordBatch.from_pylist([{
                    "volume_id": row["path"], "shape": list(h.shape), "zooms": [float(z) for z in h.zooms],
                    "kind": h.kind.name, "affine": h.affine.tolist(), "axcodes": h.axcodes,
                }], schema=pa.schema([
                    ("volume_id", pa.string()), ("shape", pa.list_(pa.int32())), ("zooms", pa.list_(pa.float64())),
                    ("kind", pa.string()), ("affine", pa.list_(pa.list_(pa.float64()))), ("axcodes", pa.list_(pa.string())),
                ]))

    return _files(spark, path).mapInArrow(run, HEADER_SCHEMA)


def read_voxels(spark: SparkSession, path: str, ras: bool = False) -> DataFrame:
    """(volume_id, i, j, k, v): all voxels, one slab of k at a time; ``ras`` brings axes into canonical order first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                volume, head = read_array(row["content"])
                if ras:
                    volume, _ = canonical(volume, head.affine)
                ni, nj, nk = volume.shape
                i, j = np.repeat(np.arange(ni), nj), np.tile(np.arange(nj), ni)
                for k in range(nk):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["path"]] * len(i)), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                         pa.array(np.full(len(i), k), pa.int32()), pa.array(np.ascontiguousarray(volume[:, :, k]).ravel(), pa.float32())],
                        ["volume_id", "i", "j", "k", "v"],
                    )

    return _files(spark, path).mapInArrow(run, VOXEL_SCHEMA)
