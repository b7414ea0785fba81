"""GeoTIFF files that the test itself puts together from bytes, read back cell by cell; and sheets written and read."""

import struct
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.sources import geotiff

CODES = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}


def lzw(data):
    """By the format's own account of the encoder: codes of 9 to 12 bits, high bits first, early change."""
    out, bits, have, width = bytearray(), 0, 0, 9
    table = {bytes([i]): i for i in range(256)}

    def put(code):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    put(256)
    word, n = b"", 258
    for b in data:
        b = bytes([b])
        if word + b in table:
            word += b
            continue
        put(table[word])
        table[word + b] = n
        n += 1
        word = b
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4095:
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
    if word:
        put(table[word])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    put(0)
    return bytes(out)


def packed(a, order, compression, predictor):
    """A block [row, column, sample]."""
    kind = a.dtype.newbyteorder(order)
    if predictor == 2:
        a = np.concatenate([a[:, :1], np.diff(a, axis=1)], axis=1)
    raw = a.astype(kind).tobytes()
    if predictor == 3:
        rows = []
        for row in a:
            planes = np.frombuffer(row.astype(a.dtype.newbyteorder(">")).tobytes(), "u1").reshape(-1, a.dtype.itemsize).T.ravel()
            s = a.shape[2]
            rows.append(np.concatenate([planes[:s], planes[s:] - planes[:-s]]).tobytes())
        raw = b"".join(rows)
    return {1: lambda d: d, 5: lzw, 8: zlib.compress, 32946: zlib.compress}[compression](raw)


def tiff(a, order="<", compression=1, predictor=1, tile=None, strip=None, planar=False, big=False, no_data=None, epsg=4326, where=None):
    """A file of [row, column, sample]."""
    h, w, s = a.shape
    th, tw = (tile, tile) if tile else (strip or h, w)
    blocks = []
    for part in [a[:, :, i : i + 1] for i in range(s)] if planar else [a]:
        for r, c in product(range(0, h, th), range(0, w, tw)):
            b = part[r : r + th, c : c + tw]
            if tile:
                b = np.pad(b, ((0, th - b.shape[0]), (0, tw - b.shape[1]), (0, 0)))
            blocks.append(packed(b, order, compression, predictor))
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [a.dtype.itemsize * 8] * s), 259: ("H", [compression]), 262: ("H", [1]), 277: ("H", [s]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor])}
    tags[339] = ("H", [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * s)
    tags |= {322: ("I", [tw]), 323: ("I", [th]), 324: ("I", [0] * len(blocks)), 325: ("I", [len(b) for b in blocks])} if tile else {278: ("I", [th]), 273: ("I", [0] * len(blocks)), 279: ("I", [len(b) for b in blocks])}
    tags |= where or {33550: ("d", [0.5, 0.25, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0])}
    tags[34735] = ("H", [1, 1, 0, 1, 2048, 0, 1, epsg])
    if no_data is not None:
        tags[42113] = ("s", str(no_data).encode() + b"\0")
    head, entry, inline, word = (16, 20, 8, "Q") if big else (8, 12, 4, "I")
    start = head + (8 if big else 2) + entry * len(tags) + inline
    raws = {t: v if c == "s" else struct.pack(f"{order}{len(v)}{c}", *v) for t, (c, v) in tags.items()}
    place = start + sum(len(r) for r in raws.values() if len(r) > inline)
    offsets = [place + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    t = 324 if tile else 273
    raws[t] = struct.pack(f"{order}{len(offsets)}I", *offsets)
    mark = b"II" if order == "<" else b"MM"
    out = [mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16) if big else struct.pack(f"{order}HI", 42, 8)), struct.pack(f"{order}{'Q' if big else 'H'}", len(tags))]
    more, at = [], start
    for t in sorted(tags):
        raw = raws[t]
        out.append(struct.pack(f"{order}HH{word}", t, CODES[tags[t][0]], len(tags[t][1])) + (raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(f"{order}{word}", at)))
        if len(raw) > inline:
            more.append(raw)
            at += len(raw)
    return b"".join([*out, b"\0" * inline, *more, *blocks])


KINDS = [
    ("float32", {"tile": 16, "compression": 8, "predictor": 3}), ("float32", {"tile": 16, "compression": 5, "predictor": 3, "order": ">", "samples": 3}), ("float64", {"strip": 7, "compression": 8}),
    ("int16", {"tile": 32, "compression": 5, "predictor": 2, "samples": 2}), ("uint8", {"strip": 5, "compression": 5, "predictor": 2, "samples": 3}), ("int32", {"order": ">", "compression": 32946, "predictor": 2}),
    ("uint16", {"big": True, "tile": 16}), ("int16", {"big": True, "order": ">", "strip": 9, "planar": True, "samples": 2, "compression": 5}), ("uint32", {"tile": 16, "planar": True, "samples": 3, "compression": 8}),
]


@pytest.mark.parametrize("kind", range(len(KINDS)))
def test_files_of_many_kinds(spark, tmp_path, kind):
    dtype, how = KINDS[kind][0], dict(KINDS[kind][1])
    samples = how.pop("samples", 1)
    rng = np.random.default_rng(kind)
    base = rng.integers(0, 90, (41, 53, samples)).cumsum(axis=1) % 120
    a = (base + (rng.random(base.shape) if dtype.startswith("f") else 0)).astype(dtype)
    a[3, 4] = 77
    if dtype.startswith("f"):
        a[5, 6] = np.nan
    (tmp_path / "a.tif").write_bytes(tiff(a, no_data=77, **how))
    df = geotiff.read_cells(spark, str(tmp_path / "a.tif"), band=samples, runbytes=1200)
    rows = df.collect()
    assert len(rows) == 41 * 53 and {r["band"] for r in rows} == {samples}
    if "tile" in how:
        assert df.rdd.getNumPartitions() > 1
    for r in rows:
        v = a[r["row_"], r["col"], samples - 1]
        assert r["value"] == (None if v == 77 or v != v else float(v))
        assert (r["x"], r["y"]) == (10.0 + 0.5 * (r["col"] + 0.5), 50.0 - 0.25 * (r["row_"] + 0.5))
    # The sampler sees the same cells.
    p = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(9, 38, 300), rng.uniform(39, 51, 300), strict=True))] + [(900, 10.0, 50.0), (901, None, 45.0), (902, float("nan"), 45.0), (903, 36.5, 45.0)]
    got = {r["id"]: r["value"] for r in geotiff.sample(spark.createDataFrame(p, "id long, x double, y double"), str(tmp_path), "id", band=samples, salts=2).collect()}
    by = {(r["col"], r["row_"]): r["value"] for r in rows}
    assert len(got) == len(p)
    for i, x, y in p:
        at = (int(np.floor((x - 10.0) / 0.5)), int(np.floor((50.0 - y) / 0.25))) if x is not None and x == x else None
        assert got[i] == by.get(at)


def test_long_lzw_streams_clear_their_table():
    data = np.random.default_rng(1).integers(0, 256, 40_000).astype("u1").tobytes() + b"abcabcabc" * 3000
    assert geotiff.unpacked(lzw(data)) == data


def test_tiles_outside_are_not_read(spark, tmp_path):
    a = np.arange(64 * 64, dtype="float32").reshape(64, 64, 1)
    raw = bytearray(tiff(a, tile=16))
    r_at = len(raw) - 4 * 64 * 64
    raw[r_at + 1024 :] = b"\xff" * (len(raw) - r_at - 1024)  # all tiles but the first are no numbers
    (tmp_path / "a.tif").write_bytes(bytes(raw))
    some = geotiff.read_cells(spark, str(tmp_path), bbox="10.1,46.1,17.9,49.9")
    assert some.count() == 256 and some.where("value is null").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = geotiff.read_cells(spark, str(tmp_path)).where("x > 10.3 and x < 17.8 and y >= 46.2 and y <= 49.8")
        assert pushed.count() == 15 * 14 and pushed.agg(F.max("tile")).first()[0] == 0
        assert sum(1 for _ in geotiff.PushingReader({"path": str(tmp_path)}).pushFilters([geotiff.GreaterThan(("x",), 30.0), geotiff.LessThan(("y",), 40.0)])) == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bad_files_are_told(spark, tmp_path):
    (tmp_path / "no.tif").write_bytes(b"PK not a raster at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.header(str(tmp_path / "no.tif"))
    (tmp_path / "a.tif").write_bytes(tiff(np.zeros((4, 4, 2), "uint8")))
    with pytest.raises(ValueError, match="2 band"):
        geotiff.sample(spark.createDataFrame([(1, 1.0, 1.0)], "id int, x double, y double"), str(tmp_path / "a.tif"), "id", band=3)
    with pytest.raises(FileNotFoundError):
        geotiff.files_of(str(tmp_path / "gone"))
    turned = {34264: ("d", [0.0, 2.0, 0.0, 5.0, 3.0, 0.0, 0.0, 7.0, *[0.0] * 7, 1.0])}
    (tmp_path / "a.tif").write_bytes(tiff(np.arange(6, dtype="uint8").reshape(2, 3, 1), where=turned, epsg=32635))
    r = geotiff.header(str(tmp_path / "a.tif"))
    assert r.place(1, 0) == (5.0, 10.0) and r.epsg == 32635


@pytest.mark.parametrize("dy", [-0.25, 0.25])
def test_sheets_come_back(spark, tmp_path, dy):
    at = f"file://{tmp_path}/sheets"
    n = 70
    cells = spark.range(n * n).select((F.col("id") % n).alias("col"), F.floor(F.col("id") / n).alias("row_"), (F.col("id") * 0.37).cast("float").cast("double").alias("value"))
    cells = cells.where("not (col between 32 and 63 and row_ < 32)").withColumn("value", F.when(F.col("col") != 5, F.col("value")))
    twice = cells.where("col = 6").withColumn("value", F.lit(-1.0))
    for _ in range(2):  # the second time over the first one's files
        geotiff.write_cells(cells.union(twice).union(twice.limit(1).withColumn("value", F.lit(float("nan")))).repartition(5), at, 20.0, 40.0, 0.5, dy, sheet=32, tile=16)
    files = geotiff.files_of(at)
    assert len(files) == 8 and not any("_" in p.name for p in (tmp_path / "sheets").iterdir())
    back = geotiff.read_cells(spark, at).where("value is not null").select(F.floor((F.col("x") - 20.0) / 0.5).alias("col"), F.floor((F.col("y") - 40.0) / dy).alias("row_"), "value")
    want = cells.where("value is not null")
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    p = spark.createDataFrame([(1, 20.1, 40.0 + dy * 0.5), (2, 20.0 + 0.5 * 69.5, 40.0 + dy * 69.5), (3, 20.0 + 0.5 * 40, 40.0 + dy * 3), (4, 20.0 + 0.5 * 5.5, 40.0 + dy * 1.5)], "id int, x double, y double")
    got = {r["id"]: r["value"] for r in geotiff.sample(p, at, "id").collect()}
    assert got[1] == 0.0 and got[2] == float(np.float32(0.37 * (n * n - 1))) and got[3] is None and got[4] is None


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    cells = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("double").alias("value")).select(F.col("id").alias("col"), F.lit(0).alias("row_"), "value")
    with pytest.raises(Exception, match="lost"):
        geotiff.write_cells(cells, str(tmp_path / "s"), 0.0, 0.0, 1.0, -1.0, sheet=16, tile=16)
    assert not (tmp_path / "s").exists() or not any((tmp_path / "s").rglob("*.tif"))
    none = cells.limit(0)
    geotiff.write_cells(none, str(tmp_path / "e"), 0.0, 0.0, 1.0, -1.0)
    assert geotiff.files_of(str(tmp_path / "e")) == [] and geotiff.read_cells(spark, str(tmp_path / "e")).collect() == []
