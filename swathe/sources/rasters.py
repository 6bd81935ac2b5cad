"""Surfaces, GeoTIFF rasters and LAS point clouds.

Files are read through Spark's binary source, so they may lie in any store that Spark reads, and
are decoded where they are read; rows of a raster leave the worker in batches.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .georef import GeoTransform

SURFACE_KEYS = ("geotransform", "crs", "nrows", "ncols")


def save_surface(surface: DataFrame, path: str, gt: GeoTransform, crs: str, nrows: int, ncols: int, notes: str = "") -> None:
    """(row, col, z) as Parquet, with its metadata beside it as JSON."""
    from ..operators.kde import validate_range

    validate_range(surface).select("row", "col", "z").write.mode("overwrite").parquet(f"{path}/grid")
    meta = {"geotransform": list(gt), "crs": crs, "nrows": nrows, "ncols": ncols, "notes": notes}
    surface.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_surface(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    from ..operators.kde import validate_range

    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    missing = [k for k in SURFACE_KEYS if k not in meta]
    if missing:
        raise ValueError(f"the surface's metadata lacks {missing}")
    return validate_range(spark.read.schema("row int, col int, z double").parquet(f"{path}/grid")), meta


def surface_csv_lines(surface: DataFrame, gt: GeoTransform, crs: str, notes: str = "") -> DataFrame:
    """(line number, text): header lines with #, then one line per row of the grid, nine digits."""
    spark = surface.sparkSession
    head = [(-3, f"# Geotransform: {list(gt)}"), (-2, f"# CRS: {crs}"), (-1, f"# Notes: {notes}")]
    cells = F.array_sort(F.collect_list(F.struct("col", F.round("z", 9).alias("z"))))  # one line of the file
    rows = surface.groupBy("row").agg(F.concat_ws(",", F.transform(cells, lambda s: s["z"].cast("string"))).alias("text"))
    return spark.createDataFrame(head, "n int, text string").union(rows.select(F.col("row").alias("n"), "text"))


def save_surface_csv(surface: DataFrame, path: str, gt: GeoTransform, crs: str, notes: str = "") -> None:
    surface_csv_lines(surface, gt, crs, notes).orderBy("n").coalesce(1).select("text").write.mode("overwrite").text(path)


def load_surface_csv(spark: SparkSession, path: str, default: GeoTransform | None = None, default_crs: str = "") -> tuple[DataFrame, dict]:
    """(row, col, z) and the header's keys: any key that holds "geotransform"; crs, epsg or
    coordinate_system; note or notes. A preview-sized text file: the header is read first, the
    rows are split where they are."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("o"), F.col("value"))
    meta: dict = {"geotransform": list(default) if default else None, "crs": default_crs, "notes": ""}
    for r in lines.where(F.col("value").startswith("#")).collect():  # a handful of header lines
        key, _, value = r.value.lstrip("# ").partition(":")
        key = key.strip().lower().replace(" ", "_")
        if "geotransform" in key:
            meta["geotransform"] = [float(v) for v in re.findall(r"[-+0-9.eE]+", value)]
        elif key.split("_(")[0] in ("crs", "epsg", "coordinate_system"):
            meta["crs"] = value.strip() if not value.strip().isdigit() else f"EPSG:{value.strip()}"
        elif key in ("note", "notes"):
            meta["notes"] = value.strip()
    if meta["geotransform"] is None:
        raise ValueError("the file names no geotransform and there is no default")
    meta["geotransform"] = GeoTransform.of(meta["geotransform"])
    from pyspark.sql import Window

    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    body = body.withColumn("row", F.row_number().over(Window.orderBy("o")) - 1)
    cells = body.select("row", F.posexplode(F.split("value", ",")).alias("col", "_z")).select("row", "col", F.col("_z").cast("double").alias("z"))
    return cells, meta


# --- GeoTIFF --------------------------------------------------------------------------------

_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def decode_tiff(raw: bytes) -> tuple[np.ndarray, GeoTransform, dict]:
    """(bands, rows, columns) of an uncompressed strip TIFF, its geotransform and tags."""
    if raw[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    e = "<" if raw[:2] == b"II" else ">"
    if struct.unpack(e + "H", raw[2:4])[0] != 42:
        raise ValueError("only classic TIFF files are read")
    at = struct.unpack(e + "I", raw[4:8])[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack(e + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        place = at + 10 + 12 * i
        if size * n > 4:
            place = struct.unpack(e + "I", raw[place : place + 4])[0]
        tags[tag] = struct.unpack(e + code * n if kind != 2 else f"{n}s", raw[place : place + size * n])
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF files are not read")
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(e + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    strips = b"".join(raw[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    flat = np.frombuffer(strips, dtype)
    planar = tags.get(284, (1,))[0] == 2
    image = flat.reshape(bands, h, w) if planar else np.moveaxis(flat.reshape(h, w, bands), 2, 0)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    gt = GeoTransform(tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])
    return image, gt, {"nodata": (tags[42113][0].rstrip(b"\0 ").decode() if 42113 in tags else None), "tags": sorted(tags)}


def encode_tiff(band: np.ndarray, gt: GeoTransform, nodata: float | None = None) -> bytes:
    """A one-band Float64 TIFF with its geotransform, uncompressed."""
    h, w = band.shape
    data = np.ascontiguousarray(band, "<f8").tobytes()
    extra, entries = b"", []
    base = 8 + len(data)

    def put(tag: int, kind: int, values: tuple) -> None:
        entries.append((tag, kind, values))

    put(256, 4, (w,)), put(257, 4, (h,)), put(258, 3, (64,)), put(259, 3, (1,)), put(262, 3, (1,)), put(273, 4, (8,)), put(277, 3, (1,)), put(278, 4, (h,)), put(279, 4, (len(data),)), put(339, 3, (3,))
    put(33550, 12, (gt.dx, -gt.dy, 0.0)), put(33922, 12, (0.0, 0.0, 0.0, gt.x0, gt.y0, 0.0))
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        put(42113, 2, (text,))
    head = 2 + 12 * len(entries) + 4
    table = struct.pack("<H", len(entries))
    for tag, kind, values in entries:
        code, size = _TYPES[kind]
        raw = values[0] if kind == 2 else struct.pack("<" + code * len(values), *values)
        n = len(raw) // size
        if len(raw) > 4:
            table += struct.pack("<HHII", tag, kind, n, base + head + len(extra))
            extra += raw
        else:
            table += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, base) + data + table + struct.pack("<I", 0) + extra


def read_tiff(spark: SparkSession, path: str, bands: tuple[int, ...] | None = None) -> DataFrame:
    """(path, row, col, band values b1, b2, ...) of uncompressed rasters."""
    want = bands or (1,)
    names = [f"b{b}" for b in want]

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                image, _, _ = decode_tiff(c.as_py())
                if max(want) > len(image):
                    raise ValueError(f"{p} has {len(image)} bands")
                _, h, w = image.shape
                step = max(1, (1 << 16) // w)
                for r in range(0, h, step):
                    part = image[:, r : r + step]
                    n = part.shape[1]
                    cols = {"path": [p] * (n * w), "row": np.repeat(np.arange(r, r + n, dtype=np.int32), w), "col": np.tile(np.arange(w, dtype=np.int32), n)}
                    yield pa.RecordBatch.from_pydict(cols | {k: part[b - 1].ravel().astype(float) for k, b in zip(names, want, strict=True)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, row int, col int, " + ", ".join(f"{n} double" for n in names))


def read_rgb(spark: SparkSession, path: str) -> DataFrame:
    return read_tiff(spark, path, (1, 2, 3)).select("row", "col", *[F.col(f"b{i}").cast("smallint").alias(n) for i, n in ((1, "r"), (2, "g"), (3, "b"))])


def read_classes(spark: SparkSession, path: str, codes: dict[int, str], band: int = 1) -> DataFrame:
    """(row, col, cover) of an integer class raster."""
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return read_tiff(spark, path, (band,)).select("row", "col", F.try_element_at(table, F.col(f"b{band}").cast("int")).alias("cover")).where("cover is not null")


def tiff_metadata(spark: SparkSession, path: str) -> list[dict]:
    """Shape, geotransform and extents of each file."""

    def look(batches):
        for batch in batches:
            out = []
            for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                image, gt, more = decode_tiff(c.as_py())
                out.append(json.dumps({"path": p, "bands": image.shape[0], "nrows": image.shape[1], "ncols": image.shape[2], "geotransform": list(gt), "extents": gt.extents(*image.shape[1:]), "nodata": more["nodata"]}))
            yield pa.RecordBatch.from_pydict({"meta": out})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(look, "meta string")
    return [json.loads(r.meta) for r in rows.collect()]  # one row per file


# --- LAS ------------------------------------------------------------------------------------


def decode_las(raw: bytes, box: tuple[float, float, float, float] | None = None, batch: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, z and classification of a LAS 1.x file, in batches; ``box`` is inclusive."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, kind, size = struct.unpack("<I", raw[96:100])[0], raw[104], struct.unpack("<H", raw[105:107])[0]
    n = struct.unpack("<I", raw[107:111])[0]
    if raw[25] >= 4 and n == 0:
        n = struct.unpack("<Q", raw[247:255])[0]
    scale, offset = struct.unpack("<3d", raw[131:155]), struct.unpack("<3d", raw[155:179])
    at = 15 if kind < 6 else 16
    form = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, at], "itemsize": size})
    for i in range(0, n, batch):
        p = np.frombuffer(raw, form, min(batch, n - i), start + i * size)
        x, y, z = (p[k] * s + o for k, s, o in zip("xyz", scale, offset, strict=True))
        c = p["c"] & 31 if kind < 6 else p["c"]
        if box is not None:
            keep = (x >= box[0]) & (x <= box[1]) & (y >= box[2]) & (y <= box[3])
            x, y, z, c = x[keep], y[keep], z[keep], c[keep]
        yield x, y, z, c


def encode_las(x: np.ndarray, y: np.ndarray, z: np.ndarray, cls: np.ndarray, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of point format 0 (for tests and small exports)."""
    n = len(x)
    off = [float(np.floor(v.min())) if n else 0.0 for v in (x, y, z)]
    form = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, 15], "itemsize": 20})
    p = np.zeros(n, form)
    for k, v, o in zip("xyz", (x, y, z), off, strict=True):
        p[k] = np.rint((v - o) / scale)
    p["c"] = cls
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *off)
    return bytes(head) + p.tobytes()


def read_las(spark: SparkSession, path: str, mission: str, kernel: str = "NA", box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(mission, kernel, x, y, z, cls); points outside the inclusive box never leave the reader."""

    def decode(batches):
        for batch in batches:
            for c in batch.column("content"):
                for x, y, z, cls in decode_las(c.as_py(), box):
                    yield pa.RecordBatch.from_pydict({"x": x, "y": y, "z": z, "cls": cls.astype(np.int8)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "x double, y double, z double, cls tinyint")
    return rows.select(F.lit(mission).alias("mission"), F.lit(kernel).alias("kernel"), "x", "y", "z", "cls")
