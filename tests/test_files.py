"""Files we write are read back."""

import numpy as np
from pyspark.sql import functions as F

from swathline import sinks
from swathline.sources import cubes, text


def cube(spark):
    rows = [(7, line, s, [line * 100 + s * 10 + b for b in range(5)]) for line in range(9) for s in range(4)]
    return spark.createDataFrame(rows, "seq bigint, line bigint, sample bigint, dns array<bigint>")


def test_cube_round_trip(spark, tmp_path):
    written = sinks.write_cube(cube(spark), "dns", str(tmp_path), block=4).collect()
    assert sorted(r.lines for r in written) == [1, 4, 4]
    back = cubes.read_sequence(spark, str(tmp_path), block=2)
    want = {(r.line, r.sample): [float(v) for v in r.dns] for r in cube(spark).collect()}
    assert {(r.line, r.sample): r.spectrum for r in back.collect()} == want


def test_cube_bands_and_range(spark, tmp_path):
    sinks.write_cube(cube(spark), "dns", str(tmp_path), block=4).collect()
    part = cubes.read_sequence(spark, str(tmp_path), 3, 6, bands=[4, 1]).collect()
    assert {r.line for r in part} == {3, 4, 5}
    assert all(r.spectrum == [r.line * 100 + r.sample * 10 + b for b in (4.0, 1.0)] for r in part)


def test_other_interleaves(spark, tmp_path):
    data = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype("<f4")  # line, sample, band
    for name, order in (("bip", (0, 1, 2)), ("bsq", (2, 0, 1))):
        folder = tmp_path / name / f"{name}-1"
        folder.mkdir(parents=True)
        (folder / "a.bil").write_bytes(np.ascontiguousarray(data.transpose(order)).tobytes())
        (folder / "a.hdr").write_text(f"ENVI\nlines = 2\nsamples = 3\nbands = 4\ndata type = 4\ninterleave = {name}\n")
        got = {(r.line, r.sample): r.spectrum for r in cubes.read_sequence(spark, str(tmp_path / name)).collect()}
        assert got == {(i, j): data[i, j].tolist() for i in range(2) for j in range(3)}


def test_raw_frame_lines(spark, tmp_path):
    lines = []
    for k in range(3):
        header = bytearray(cubes.FRAME_HEADER_BYTES)
        header[0:4] = (1000 + k).to_bytes(4, "little")
        header[80:82] = (0xBABE if k == 1 else 0).to_bytes(2, "little")
        header[116:120] = (5000 + k).to_bytes(4, "big")
        lines.append(bytes(header) + np.full(cubes.FRAME_SAMPLES * cubes.FRAME_BANDS, k, "<u2").tobytes())
    (tmp_path / "f.bin").write_bytes(b"".join(lines))
    frames = cubes.list_frames(spark, f"{tmp_path}/f.bin")
    assert frames.first().lines == 3
    clock, flag, tow, _ = text.frame_clock(F.col("header"))
    heads = cubes.read_frames(frames, headers_only=True).select("line", clock.alias("c"), flag.alias("f"), tow.alias("t"))
    assert sorted(map(tuple, heads.collect())) == [(0, 1000, False, 5000), (1, 1001, True, 5001), (2, 1002, False, 5002)]
    sizes = cubes.read_frames(frames, block=2).select("line", F.size("data").alias("n"), F.element_at("data", -1).alias("v")).collect()
    assert {(r.line, r.n, r.v) for r in sizes} == {(k, 1280 * 327, k) for k in range(3)}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.lcf").write_text("1.5 0.1 0.2 0.3 6 46 400\n2.5 0.1 0.2 0.3 6 46 401\n")
    rows = text.parse_lcf(text.text_lines(spark, f"{tmp_path}/a.lcf")).collect()
    assert [(r.n, r.t, r.height) for r in rows] == [(0, 1.5, 400.0), (1, 2.5, 401.0)]


def test_csv_and_tiles(spark, tmp_path):
    table = spark.createDataFrame([(0, 0, 1, 2, 3.0), (0, 1, 4, 5, 6.0)], "tile_i int, tile_j int, i int, j int, v double")
    sinks.write_tiles(table, f"{tmp_path}/tiles")
    assert spark.read.parquet(f"{tmp_path}/tiles").where("tile_j = 1").first().v == 6.0
    sinks.write_csv(table, f"{tmp_path}/csv", ["v"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == 2
