"""Rasters in GeoTIFF files as tables of cells, and tables of cells as GeoTIFF files.

``spark.read.format("geotiff")`` (after ``register``) has a partition for each run of tiles or strips of each file, reads just their bytes, and gives a row for each cell. Files are opened through
Arrow's file systems, so they can be on a shared disk or in an object store. Tiles that a box rules out are not read.

Writing cuts a raster into sheets, each a file of its own with its own georeference, so no file passes through one machine. A task encodes the tiles of its sheets into
files that carry its attempt's name; the driver only renames those of tasks that ended well.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed values of the format: tags of a directory, bytes of a type, compressions and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
KINDS = {1: "u", 2: "i", 3: "f"}
GEOGRAPHIC, PROJECTED = 2048, 3072

#: Bytes of tiles that a partition reads, as they are in the file, and cells that a batch holds.
RUN_BYTES = 8 << 20
BATCH_CELLS = 1 << 18
SCHEMA = "path string, band int, tile long, col long, row_ long, x double, y double, value double"
NO_VALUE = -9999.0


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The TIFF files of a comma-separated list of files and folders, sorted; what begins with _ or . isn't one."""
    found = []
    for p in path.split(","):
        system, at = opened(p.strip())
        head = p.strip()[: len(p.strip()) - len(at)] if p.strip().endswith(at) else ""
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no raster at {p.strip()}")
        if info.type == fs.FileType.File:
            found.append(p.strip())
            continue
        for i in system.get_file_info(fs.FileSelector(at, recursive=True)):
            hidden = any(part.startswith(("_", ".")) for part in i.path[len(at) :].split("/"))
            if i.type == fs.FileType.File and not hidden and i.path.lower().endswith((".tif", ".tiff")):
                found.append(head + i.path)
    return sorted(found)


@dataclass
class Raster:
    """What the first directory of a file says of its layout, and where each tile or strip is."""

    path: str
    order: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    samples: int
    planar: bool
    tiled: bool
    dtype: str
    compression: int
    predictor: int
    offsets: list[int]
    sizes: list[int]
    affine: tuple[float, float, float, float, float, float]
    no_data: float | None
    epsg: int | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def place(self, col: float, row: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.affine
        return a * col + b * row + c, d * col + e * row + f

    def cell(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fractional column and row of places."""
        a, b, c, d, e, f = self.affine
        det = a * e - b * d
        return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det

    def window(self, tile: int) -> tuple[int, int, int, int]:
        """First column and row, and columns and rows of a tile that are in the raster."""
        c, r = tile % self.across * self.tile_width, tile // self.across * self.tile_height
        return c, r, min(self.tile_width, self.width - c), min(self.tile_height, self.height - r)

    def box(self, tile: int) -> tuple[float, float, float, float]:
        """Least x and y, most x and y."""
        c, r, w, h = self.window(tile)
        xs, ys = zip(*(self.place(i, j) for i in (c, c + w) for j in (r, r + h)), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def piece(self, band: int, tile: int) -> int:
        """The index of a band's tile among all."""
        return tile + band * self.across * self.down if self.planar else tile


def header(path: str) -> Raster:
    """Reads the first directory of a classic or big TIFF file, of either byte order, by ranges."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        start = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        magic = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
        if magic not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big = magic == 43
        place = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
        count_size, entry_size, inline, word = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
        n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read_at(count_size, place))[0]
        raw = f.read_at(n * entry_size, place + count_size)
        tags: dict[int, tuple] = {}
        for i in range(n):
            entry = raw[i * entry_size : (i + 1) * entry_size]
            tag, kind = struct.unpack(f"{order}HH", entry[:4])
            count = struct.unpack(f"{order}{word}", entry[4 : 4 + struct.calcsize(word)])[0]
            if kind not in TYPES:
                continue
            size = struct.calcsize(f"={TYPES[kind]}") * count
            data = entry[-inline:][:size] if size <= inline else f.read_at(size, struct.unpack(f"{order}{word}", entry[-inline:])[0])
            tags[tag] = (data,) if TYPES[kind] == "s" else struct.unpack(f"{order}{count * len(TYPES[kind])}{TYPES[kind][0]}", data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, kind = one(BITS, 1), KINDS.get(one(SAMPLE_FORMAT, 1))
    if bits not in (8, 16, 32, 64) or kind is None or (kind == "f" and bits < 16):
        raise ValueError(f"{path}: samples of {bits} bits in format {one(SAMPLE_FORMAT, 1)} are not read")
    if one(COMPRESSION, PLAIN) not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"{path}: compression {one(COMPRESSION, PLAIN)} is not read")
    tiled = TILE_OFFSETS in tags
    text = tags.get(NO_DATA, (b"",))[0].split(b"\0")[0].decode("ascii", "replace").strip()
    try:
        no_data = float(text) if text else None
    except ValueError:
        no_data = None
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        affine = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = tags.get(GEO_KEYS, ())
    named = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    return Raster(
        path, order, width, height, one(TILE_WIDTH, width) if tiled else width, one(TILE_HEIGHT, height) if tiled else min(height, one(ROWS_PER_STRIP, height)), samples, one(PLANAR, 1) == 2 and samples > 1, tiled,
        f"{order}{kind}{bits // 8}", one(COMPRESSION, PLAIN), one(PREDICTOR, 1), list(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]), list(tags[TILE_SIZES if tiled else STRIP_SIZES]),
        affine, no_data, named.get(PROJECTED) or named.get(GEOGRAPHIC),
    )


def unpacked(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bits on, of 9 to 12 bits, one bit more as soon as the next code but one needs it; 256 clears the table, 257 ends."""
    out, table = bytearray(), []
    width, bits, have, last = 9, 0, 0, b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("an LZW stream doesn't begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("an LZW stream has a code that is not in its table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def decoded(r: Raster, data: bytes, rows: int) -> np.ndarray:
    """[row, column, sample] of a tile or strip of so many rows."""
    if r.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif r.compression == LZW:
        data = unpacked(data)
    samples, kind = 1 if r.planar else r.samples, np.dtype(r.dtype)
    shape = (rows, r.tile_width, samples)
    size = math.prod(shape) * kind.itemsize
    if len(data) < size:
        raise ValueError(f"{r.path}: a tile has {len(data)} bytes instead of {size}")
    if r.predictor == 3:
        # Rows of differences between neighbouring bytes, most significant bytes of all samples first.
        planes = np.frombuffer(data, "u1", size).reshape(rows, -1, samples)
        planes = np.cumsum(planes, axis=1, dtype="u1").reshape(rows, kind.itemsize, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
    out = np.frombuffer(data, kind, math.prod(shape)).reshape(shape)
    if r.predictor == 2:
        out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
    return out


def tile_values(r: Raster, f: pa.NativeFile, band: int, tile: int, no_data: float | None) -> np.ndarray:
    """[row, column] of the part of a tile that is in the raster, NaN where it has no data."""
    _, _, w, h = r.window(tile)
    at = r.piece(band, tile)
    if not r.sizes[at]:
        return np.full((h, w), np.nan)
    # The last strip ends with the raster, tiles don't.
    raw = decoded(r, f.read_at(r.sizes[at], r.offsets[at]), r.tile_height if r.tiled else h)
    v = raw[:h, :w, 0 if r.planar else band].astype("f8")
    v[~np.isfinite(v)] = np.nan
    if no_data is not None:
        v[np.abs(v - no_data) <= 1e-6] = np.nan
    return v


@dataclass
class Run(InputPartition):
    """Tiles of a file that a task reads."""

    raster: Raster
    tiles: list[int]


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options.get("path", "")
        self.band = int(options.get("band", "1")) - 1
        self.no_data = float(options["nodata"]) if "nodata" in options else None
        self.box = [float(v) for v in options["bbox"].split(",")] if "bbox" in options else [-math.inf, -math.inf, math.inf, math.inf]
        self.run_bytes = int(options.get("runbytes", RUN_BYTES))

    def wanted(self, r: Raster, tile: int) -> bool:
        x0, y0, x1, y1 = r.box(tile)
        return x1 >= self.box[0] and y1 >= self.box[1] and x0 <= self.box[2] and y0 <= self.box[3]

    def partitions(self) -> list[Run]:
        runs = []
        for r in headers(self.paths):
            if not 0 <= self.band < r.samples:
                raise ValueError(f"{r.path} has {r.samples} band(s); band {self.band + 1} was asked for")
            now, size = [], 0
            for tile in range(r.across * r.down):
                if not self.wanted(r, tile):
                    continue
                own = r.sizes[r.piece(self.band, tile)] + 1
                if now and size + own > self.run_bytes:
                    runs.append(self._run(r, now))
                    now, size = [], 0
                now.append(tile)
                size += own
            if now:
                runs.append(self._run(r, now))
        return runs or [Run(None, [])]

    def _run(self, r: Raster, tiles: list[int]) -> Run:
        """With the offsets of its own tiles only."""
        kept = {r.piece(self.band, t) for t in tiles}
        some = lambda a: {i: a[i] for i in kept}
        return Run(Raster(**{**r.__dict__, "offsets": some(r.offsets), "sizes": some(r.sizes)}), tiles)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.tiles:
            return
        r = partition.raster
        no_data = r.no_data if self.no_data is None else self.no_data
        system, at = opened(r.path)
        with system.open_input_file(at) as f:
            for tile in partition.tiles:
                c0, r0, w, h = r.window(tile)
                values = tile_values(r, f, self.band, tile, no_data)
                step = max(1, BATCH_CELLS // w)
                for top in range(0, h, step):
                    v = values[top : top + step]
                    row, col = (a.ravel() for a in np.indices(v.shape))
                    row, col = row + r0 + top, col + c0
                    x, y = r.place(col + 0.5, row + 0.5)
                    n = v.size
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r.path] * n), pa.array(np.full(n, self.band + 1, "i4")), pa.array(np.full(n, tile, "i8")), pa.array(col.astype("i8")), pa.array(row.astype("i8")),
                        pa.array(x), pa.array(y), pa.array(v.ravel(), from_pandas=True),
                    ], ["path", "band", "tile", "col", "row_", "x", "y", "value"])


class PushingReader(TileReader):
    """Takes bounds of x and y over from filters: tiles outside are not read; Spark still applies the filters to cells."""

    def pushFilters(self, filters):
        for f in filters:
            axis = {("x",): 0, ("y",): 1}.get(getattr(f, "attribute", None))
            if axis is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.box[axis] = max(self.box[axis], float(f.value))
            if axis is not None and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.box[axis + 2] = min(self.box[axis + 2], float(f.value))
            yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SheetWriter(DataSourceArrowWriter):
    """Rows (sheet_col, sheet_row, col, row_, value), the cells of a sheet together and in the order of its tiles, become a file for each sheet."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.sheet, self.tile = int(options["sheet"]), int(options["tile"])
        self.origin = [float(v) for v in options["origin"].split(",")]
        self.step = [float(v) for v in options["step"].split(",")]
        self.extent = [int(v) for v in options["extent"].split(",")]
        self.dtype = np.dtype(options.get("dtype", "float32")).newbyteorder("<")
        self.no_data, self.epsg = float(options.get("nodata", NO_VALUE)), int(options.get("epsg", "4326"))
        self.job = options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = opened(self.path)
        attempt = f"{at}/_{self.job}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        names, sheet, tiles, tile = [], None, {}, None
        cells: list[np.ndarray] = []

        def close_tile() -> None:
            if tile is not None:
                tiles[tile] = self._encoded(tile, cells)
            cells.clear()

        def close_sheet() -> None:
            if sheet is not None:
                names.append(f"{attempt}/sheet-{sheet[1]}-{sheet[0]}.tif")
                with system.open_output_stream(names[-1]) as out:
                    out.write(self._file(sheet, tiles))
            tiles.clear()

        for batch in iterator:
            sc, sr, col, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            value = batch.column(4).cast(pa.float64()).to_numpy(zero_copy_only=False)
            c, r = col - sc * self.sheet, row - sr * self.sheet
            across = -(-self.sheet // self.tile)
            t = r // self.tile * across + c // self.tile
            cut = np.flatnonzero((np.diff(sc) != 0) | (np.diff(sr) != 0) | (np.diff(t) != 0)) + 1
            for a, z in zip([0, *cut], [*cut, len(t)], strict=True):
                if a == z:
                    continue
                if (sc[a], sr[a]) != sheet:
                    close_tile()
                    close_sheet()
                    sheet, tile = (sc[a], sr[a]), None
                if t[a] != tile:
                    close_tile()
                    tile = int(t[a])
                cells.append(np.stack([r[a:z] % self.tile, c[a:z] % self.tile, value[a:z]]))
        close_tile()
        close_sheet()
        return Written(names)

    def _encoded(self, tile: int, cells: list[np.ndarray]) -> bytes:
        """Of cells that come twice the greatest value counts."""
        rows, cols, values = np.concatenate(cells, axis=1)
        out = np.full((self.tile, self.tile), self.no_data)
        order = np.argsort(values, kind="stable")
        order = order[np.isfinite(values[order])]
        out[rows[order].astype(int), cols[order].astype(int)] = values[order]
        return zlib.compress(out.astype(self.dtype).tobytes(), 6)

    def _file(self, sheet: tuple[int, int], tiles: dict[int, bytes]) -> bytes:
        """A file of one directory, its values, then the tiles; a tile without cells has no bytes."""
        width, height = (min(self.sheet, self.extent[i] - int(sheet[i]) * self.sheet) for i in (0, 1))
        across, down = -(-width // self.tile), -(-height // self.tile)
        full = -(-self.sheet // self.tile)
        data = [tiles.get(i // across * full + i % across, b"") for i in range(across * down)]
        x, y = (self.origin[i] + int(sheet[i]) * self.sheet * self.step[i] for i in (0, 1))
        kind = {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        key = (GEOGRAPHIC, 2) if 4000 <= self.epsg < 5000 else (PROJECTED, 1)
        keys = [1, 1, 0, 3, 1024, 0, 1, key[1], 1025, 0, 1, 1, key[0], 0, 1, self.epsg]
        if self.step[1] < 0:
            where = [(PIXEL_SCALE, "d", [self.step[0], -self.step[1], 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, x, y, 0.0])]
        else:  # rows go up: only the matrix can say so
            where = [(TRANSFORMATION, "d", [self.step[0], 0.0, 0.0, x, 0.0, self.step[1], 0.0, y, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
        fields = [
            (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [self.dtype.itemsize * 8]), (COMPRESSION, "H", [DEFLATE]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [1]), (PLANAR, "H", [1]), (PREDICTOR, "H", [1]),
            (TILE_WIDTH, "I", [self.tile]), (TILE_HEIGHT, "I", [self.tile]), (TILE_OFFSETS, "I", [0] * len(data)), (TILE_SIZES, "I", list(map(len, data))), (SAMPLE_FORMAT, "H", [kind]),
            *where, (GEO_KEYS, "H", keys), (NO_DATA, "s", f"{self.no_data:.17g}".encode() + b"\0"),
        ]
        fields.sort(key=lambda f: f[0])
        codes = {"I": 4, "H": 3, "d": 12, "s": 2}
        start = 8 + 2 + 12 * len(fields) + 4
        size = lambda f: len(f[2]) * struct.calcsize(f[1])
        at = start + sum(size(f) + size(f) % 2 for f in fields if size(f) > 4)
        offsets = []
        for d in data:
            offsets.append(at if d else 0)
            at += len(d)
        if at >= 1 << 32:
            raise ValueError("a sheet has over 4 GB; make sheets smaller")
        head, more, place = [struct.pack("<2sHIH", b"II", 42, 8, len(fields))], [], start
        for tag, code, values in fields:
            values = offsets if tag == TILE_OFFSETS else values
            raw = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
            here = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", place)
            if len(raw) > 4:
                more.append(raw + b"\0" * (len(raw) % 2))
                place += len(more[-1])
            head.append(struct.pack("<HHI", tag, codes[code], len(values)) + here)
        return b"".join([*head, struct.pack("<I", 0), *more, *data])

    def commit(self, messages: list[Written | None]) -> None:
        """Only names are handled here: what tasks report is renamed, what attempts left goes."""
        system, at = opened(self.path)
        done = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if i.type == fs.FileType.File and i.base_name.endswith(".tif"):
                    system.delete_file(i.path)
        for f in done:
            system.move(f, f"{at}/{f.rpartition('/')[2]}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_{self.job}")


class GeoTiff(DataSource):
    """Options of reading: path (files and folders, by comma), band (from 1), nodata (else the file's), bbox (x0,y0,x1,y1 in the raster's own coordinates), pushdown, runbytes."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return (PushingReader if self.options.get("pushdown", "") == "true" else TileReader)(self.options)

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options, overwrite)


def headers(path: str) -> list[Raster]:
    """Of all files; so many at a time are read."""
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(header, files_of(path)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def read_cells(spark: SparkSession, path: str, band: int = 1, **options: object) -> DataFrame:
    """(path, band, tile, col, row_, x, y, value) of every cell of the files: x and y are its centre in the raster's coordinates, the value is null where there is no data.

    Filters on x and y keep tiles from being read where the session has spark.sql.python.filterPushdown.enabled; ``bbox`` does always.
    """
    register(spark)
    pushes = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format("geotiff").options(path=path, band=band, pushdown=pushes, **options).load()


def write_cells(
    cells: DataFrame, path: str, x0: float, y0: float, dx: float, dy: float, sheet: int = 4096, tile: int = 256, dtype: str = "float32", no_data: float = NO_VALUE, epsg: int = 4326, mode: str = "overwrite"
) -> None:
    """Writes cells (col, row_, value) as GeoTIFF sheets of ``sheet`` x ``sheet`` cells into the folder: x0, y0 is the outer corner of cell (0, 0), dx and dy its steps (dy under 0: rows go down).

    Sheets without a cell have no file. Cells that are missing, null or not finite have no data; of cells that come twice the greatest value counts. Negative columns and rows are an error. The shuffle is by sheet, which a
    row of cells can't make larger than its size.
    """
    if sheet % tile or tile % 16:
        raise ValueError("tiles have sides divisible by 16, and sheets are whole tiles across")
    low, high = cells.agg(F.min(F.least("col", "row_")), F.struct(F.max("col"), F.max("row_"))).first()
    if low is not None and low < 0:
        raise ValueError("columns and rows are counted from 0")
    c, r = F.col("col").cast("long"), F.col("row_").cast("long")
    sheets = cells.select(F.floor(c / sheet).alias("sheet_col"), F.floor(r / sheet).alias("sheet_row"), c.alias("col"), r.alias("row_"), F.col("value").cast("double").alias("value")).where("col is not null and row_ is not null")
    placed = sheets.repartition("sheet_col", "sheet_row").sortWithinPartitions("sheet_row", "sheet_col", F.floor(F.col("row_") / tile), F.floor(F.col("col") / tile))
    register(cells.sparkSession)
    extent = (0, 0) if low is None else (high[0] + 1, high[1] + 1)
    placed.write.format("geotiff").mode(mode).options(
        path=path, sheet=sheet, tile=tile, origin=f"{x0!r},{y0!r}", step=f"{dx!r},{dy!r}", extent=f"{extent[0]},{extent[1]}", dtype=dtype, nodata=no_data, epsg=epsg, job=uuid.uuid4().hex
    ).save()


def sample(points: DataFrame, path: str, *key: str, band: int = 1, no_data: float | None = None, salts: int = 32) -> DataFrame:
    """(key..., value) of points (key..., x, y) in the raster's coordinates: the value of the cell that each is in, null outside, where a coordinate isn't finite, and where there is no data.

    Headers are read once on the driver; points meet files by cells as large as the largest file. Points are then grouped by the file and tile that they are in, so just the tiles with points are read, whatever
    the raster's size; points of one tile are up to ``salts`` groups. Of files that overlap the first by name with a value counts. ``key`` tells points apart.
    """
    spark = points.sparkSession
    heads = headers(path)
    for r in heads:
        if not 1 <= band <= r.samples:
            raise ValueError(f"{r.path} has {r.samples} band(s); band {band} was asked for")
    boxes = [[sorted(r.place(i, j)[k] for i in (0, r.width) for j in (0, r.height)) for k in (0, 1)] for r in heads]
    wide, tall = (max((b[k][-1] - b[k][0] for b in boxes), default=0.0) or 1.0 for k in (0, 1))
    rows = [
        (gx, gy, i, *r.affine, r.width, r.height, r.tile_width, r.tile_height, r.across)
        for i, (r, (xs, ys)) in enumerate(zip(heads, boxes, strict=True)) for gx in range(math.floor(xs[0] / wide), math.floor(xs[-1] / wide) + 1) for gy in range(math.floor(ys[0] / tall), math.floor(ys[-1] / tall) + 1)
    ]
    files = spark.createDataFrame(rows, "_gx long, _gy long, _file int, a double, b double, c double, d double, e double, f double, _w int, _h int, _tw int, _th int, _across int")
    asked = points.select(F.struct(*key).alias("_key"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    asked = asked.where("not isnan(_x) and not isnan(_y) and abs(_x) < 1e300 and abs(_y) < 1e300").withColumns(
        {"_salt": F.pmod(F.xxhash64("_key", "_x"), F.lit(salts)), "_gx": F.floor(F.col("_x") / wide).cast("long"), "_gy": F.floor(F.col("_y") / tall).cast("long")}
    )
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    col = (F.col("e") * (F.col("_x") - F.col("c")) - F.col("b") * (F.col("_y") - F.col("f"))) / det
    row = (F.col("a") * (F.col("_y") - F.col("f")) - F.col("d") * (F.col("_x") - F.col("c"))) / det
    inside = (col >= 0) & (row >= 0) & (col < F.col("_w")) & (row < F.col("_h"))
    met = asked.join(files, ["_gx", "_gy"]).where(inside)
    tile = F.floor(row / F.col("_th")) * F.col("_across") + F.floor(col / F.col("_tw"))
    met = met.select("_key", "_salt", "_file", tile.alias("_tile"), F.floor(col).alias("_col"), F.floor(row).alias("_row"))
    shared = spark.sparkContext.broadcast([r.path for r in heads])
    kind = points.select(F.struct(*key).alias("_key")).schema["_key"].dataType.simpleString()

    def look_up(group: pa.Table) -> pa.Table:
        at = shared.value[group["_file"][0].as_py()]
        r, t = header(at), group["_tile"][0].as_py()
        system, place = opened(at)
        with system.open_input_file(place) as f:
            v = tile_values(r, f, band - 1, t, r.no_data if no_data is None else no_data)
        c0, r0, _, _ = r.window(t)
        found = v[group["_row"].to_numpy() - r0, group["_col"].to_numpy() - c0]
        return pa.table([group["_key"], group["_file"], pa.array(found, from_pandas=True)], ["_key", "_file", "value"])

    found = met.groupBy("_file", "_tile", "_salt").applyInArrow(look_up, f"_key {kind}, _file int, value double").where("value is not null")
    best = found.groupBy("_key").agg(F.min(F.struct("_file", "value"))["value"].alias("value"))
    out = points.select(F.struct(*key).alias("_key")).join(best, "_key", "left")
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in key], "value")
