"""MRC volumes: header, data source by Z slabs, writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MODES = {0: np.int8, 1: np.int16, 2: np.float32, 6: np.uint16, 12: np.float16}
SLAB = 16


@dataclass
class Header:
    shape: tuple[int, int, int]  # z, y, x
    mode: int
    voxel: float
    origin: tuple[float, float, float]
    start: int  # of the data


def read_header(raw: bytes) -> Header:
    nx, ny, nz, mode = struct.unpack_from("<4i", raw, 0)
    mx = struct.unpack_from("<i", raw, 28)[0]
    cell = struct.unpack_from("<f", raw, 40)[0]
    extra = struct.unpack_from("<i", raw, 92)[0]
    return Header((nz, ny, nx), mode, cell / mx if mx else 0.0, struct.unpack_from("<3f", raw, 196), 1024 + extra)


def read_mrc(path: str) -> tuple[np.ndarray, Header]:
    with open(path, "rb") as f:
        return parse(f.read())


def header_of(spark: SparkSession, path: str) -> Header:
    """The header of a volume on any store Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        return read_header(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, 1024)))
    finally:
        stream.close()


def parse(raw: bytes) -> tuple[np.ndarray, Header]:
    """(array, header) of a file's bytes."""
    h = read_header(raw)
    return np.frombuffer(raw, MODES[h.mode], int(np.prod(h.shape)), h.start).reshape(h.shape), h


def write_mrc(path: str, data: np.ndarray, voxel: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """float32, float16, int8, int16 or uint16 as they are; bool and uint8 as int8, or uint16 beyond 127; others as float32."""
    kind = np.dtype(data.dtype)
    if kind in (np.dtype(bool), np.dtype(np.uint8)):
        kind = np.dtype(np.uint16 if data.size and data.max() > 127 else np.int8)
    mode = next((m for m, k in MODES.items() if np.dtype(k) == kind), 2)
    data = np.ascontiguousarray(data, MODES[mode])
    nz, ny, nx = data.shape
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, nx, ny, nz, mode)
    struct.pack_into("<3i", head, 28, nx, ny, nz)
    struct.pack_into("<6f", head, 40, nx * voxel, ny * voxel, nz * voxel, 90, 90, 90)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    f = data.astype(np.float64)
    struct.pack_into("<3f", head, 76, f.min() if f.size else 0, f.max() if f.size else 0, f.mean() if f.size else 0)
    struct.pack_into("<3f", head, 196, *origin)
    head[208:212], head[212:216] = b"MAP ", bytes([0x44, 0x44, 0, 0])
    with open(path, "wb") as out:
        out.write(bytes(head) + data.tobytes())


class MrcSource(DataSource):
    """``spark.read.format("mrc").load(path)``: (z, data) with each Z section's float32 bytes, one partition a slab."""

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        return "z int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return MrcReader(self.options["path"])


class MrcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _header(self) -> Header:
        with open(self.path, "rb") as f:
            return read_header(f.read(1024))

    def partitions(self):
        return [InputPartition(z) for z in range(0, self._header().shape[0], SLAB)]

    def read(self, partition) -> Iterator[tuple]:
        h = self._header()
        nz, ny, nx = h.shape
        size = np.dtype(MODES[h.mode]).itemsize * ny * nx
        with open(self.path, "rb") as f:
            for z in range(partition.value, min(partition.value + SLAB, nz)):
                f.seek(h.start + z * size)
                yield z, np.frombuffer(f.read(size), MODES[h.mode]).astype(np.float32).tobytes()


def sections(spark: SparkSession, volume: np.ndarray, name: str = "v") -> DataFrame:
    """(vol, z, data) of an array."""
    return spark.createDataFrame([(name, z, volume[z].astype(np.float32).tobytes()) for z in range(len(volume))], "vol string, z int, data binary")


def register(spark: SparkSession) -> None:
    from .star import StarSource

    spark.dataSource.register(MrcSource)
    spark.dataSource.register(StarSource)


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey PNG of a 2-D array: mean -+ three deviations of its central half to black and white."""
    import zlib

    h, w = image.shape
    middle = image[h // 4 : h - h // 4, w // 4 : w - w // 4].astype(float)
    low, high = middle.mean() - 3 * middle.std(), middle.mean() + 3 * middle.std()
    grey = np.clip((image - low) / (high - low if high > low else 1.0) * 255, 0, 255).astype(np.uint8)
    raw = np.c_[np.zeros(h, np.uint8), grey].tobytes()  # a filter byte before each line

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_preview(path: str, volume: np.ndarray) -> None:
    """The central section of a volume as PNG."""
    with open(path, "wb") as f:
        f.write(png(volume[volume.shape[0] // 2]))
