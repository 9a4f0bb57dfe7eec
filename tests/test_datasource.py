"""Data source of cubes and frames: what is planned, which bytes are read, and that only whole cubes appear."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringContains

from swathline import sinks
from swathline.sources import codec, cubes, datasource


def cube(spark, lines=30, samples=4, bands=5):
    rows = [(0, line, s, [line * 100 + s * 10 + b for b in range(bands)]) for line in range(lines) for s in range(samples)]
    return spark.createDataFrame(rows, "seq bigint, line bigint, sample bigint, dns array<bigint>")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cubes"))
    sinks.write_cube(cube(spark), "dns", path, block=10)
    return path


def reader(folder, **options):
    return datasource.CubeReader({"path": folder, **{k: str(v) for k, v in options.items()}})


def test_plan_holds_the_wanted_blocks_only(folder):
    assert [(b.line0, b.start, b.count) for b in reader(folder, block=4).partitions()][:4] == [(0, 0, 4), (0, 4, 4), (0, 8, 2), (10, 0, 4)]
    r = reader(folder)
    left = list(r.pushFilters([GreaterThanOrEqual(("line",), 12), LessThan(("line",), 18), StringContains(("path",), "x"), GreaterThan(("sample",), 1)]))
    assert len(left) == 2 and [(b.line0, b.start, b.count) for b in r.partitions()] == [(10, 2, 6)]
    r = reader(folder)
    assert not list(r.pushFilters([GreaterThan(("line",), 19), LessThanOrEqual(("line",), 20)]))
    assert [(b.line0, b.start, b.count) for b in r.partitions()] == [(20, 0, 1)]
    path = r.partitions()[0].path
    r = reader(folder)
    assert not list(r.pushFilters([EqualTo(("path",), path)])) and {b.path for b in r.partitions()} == {path}
    r = reader(folder)
    assert not list(r.pushFilters([EqualTo(("line",), 99)])) and r.partitions() == []


def test_unwanted_bytes_are_not_read(folder, monkeypatch):
    read = []
    whole = codec.take

    def counted(f, offset, n):
        read.append(n)
        return whole(f, offset, n)

    monkeypatch.setattr(codec, "take", counted)
    r = reader(folder, bands="[3]")
    list(r.pushFilters([GreaterThanOrEqual(("line",), 12), LessThan(("line",), 15)]))
    rows = pa.Table.from_batches([b for p in r.partitions() for b in r.read(p)])
    assert rows.num_rows == 3 * 4 and sum(read) == 3 * 4 * 2  # lines x samples x bytes of one band
    assert rows.column("spectrum").to_pylist()[0] == [1200 + 3]


def test_filters_of_a_query_reach_the_reader(spark, folder):
    datasource.register(spark)
    df = spark.read.format(datasource.CUBE).option("block", 5).load(folder)
    assert df.rdd.getNumPartitions() == 6
    part = df.where("line >= 12 and line < 14")
    assert part.rdd.getNumPartitions() == 1
    assert {(r.line, r.sample): r.spectrum for r in part.collect()} == {(n, s): [float(n * 100 + s * 10 + b) for b in range(5)] for n in (12, 13) for s in range(4)}
    assert df.where("sample = 2 and line = 29").select(F.col("spectrum")[4]).first()[0] == 2924.0


def lines(rows):
    columns = list(zip(*rows, strict=True))
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.map_(pa.string(), pa.string())]
    names = ["folder", "line", "samples", "bands", "data", "peak", "side"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def all_files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def test_a_failed_attempt_leaves_nothing(tmp_path):
    good = [("a", k, 2, 1, np.full(2, k, "<u2").tobytes(), float(k), {"notes": f"{k}\n"}) for k in range(3)]
    writer = datasource.CubeWriter({"path": str(tmp_path)}, overwrite=False)

    def broken():
        yield lines(good[:2])
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(broken())
    assert all_files(tmp_path) and not [f for f in all_files(tmp_path) if not f.startswith("_attempts")]
    first, second = writer.write(iter([lines(good)])), writer.write(iter([lines(good[:1]), lines(good[1:])]))
    writer.commit([first, None])  # the second is of a speculative copy, whose message Spark drops
    assert second.moves and all_files(tmp_path) == ["a/frame.bil", "a/frame.bil.hdr", "a/notes"]
    assert (tmp_path / "a/notes").read_text() == "0\n1\n2\n"
    assert codec.cube_header(str(tmp_path / "a/frame.bil"))["lines"] == 3
    assert "ceiling = 2\n" in (tmp_path / "a/frame.bil.hdr").read_text()

    again = datasource.CubeWriter({"path": str(tmp_path)}, overwrite=False)
    message = again.write(iter([lines(good)]))
    with pytest.raises(ValueError, match="exists"):
        again.commit([message])
    over = datasource.CubeWriter({"path": str(tmp_path)}, overwrite=True)
    over.commit([over.write(iter([lines(good[:2])]))])
    assert codec.cube_header(str(tmp_path / "a/frame.bil"))["lines"] == 2
    gone = datasource.CubeWriter({"path": str(tmp_path)}, overwrite=True)
    gone.abort([gone.write(iter([lines([("b", *good[0][1:])])]))])
    assert all_files(tmp_path) == ["a/frame.bil", "a/frame.bil.hdr", "a/notes"]


def test_a_folder_in_two_tasks_is_refused(tmp_path):
    row = ("a", 0, 1, 1, b"\0\0", 0.0, None)
    writer = datasource.CubeWriter({"path": str(tmp_path)}, overwrite=False)
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([writer.write(iter([lines([row])])), writer.write(iter([lines([row])]))])
    assert not all_files(tmp_path)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    px = cube(spark).where("not (line = 17 and sample = 2)")
    with pytest.raises(Exception, match="missing or repeated"):
        sinks.write_cube(px, "dns", str(tmp_path), block=10)
    assert not all_files(tmp_path)


def test_long_and_wide_lines(spark, tmp_path):
    """Lines longer than an Arrow batch are put together again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sinks.write_cube(cube(spark, 6, 20, 3), "dns", str(tmp_path), block=4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = cubes.read_sequence(spark, str(tmp_path), bands=[2]).collect()
    assert {(r.line, r.sample): r.spectrum for r in back} == {(n, s): [float(n * 100 + s * 10 + 2)] for n in range(6) for s in range(20)}


def test_frames_are_converted(spark, tmp_path):
    samples, bands = 6, 3
    frame = np.arange(7 * (bands + 1) * samples, dtype="<u2").reshape(7, bands + 1, samples)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/f.bin").write_bytes(frame.tobytes() + b"\1\2\3")
    datasource.register(spark)
    source = spark.read.format(datasource.FRAME).options(samples=samples, bands=bands, block=2)
    frames = source.load(str(tmp_path / "raw"))
    assert frames.rdd.getNumPartitions() == 4 and frames.count() == 7
    heads = source.option("headersOnly", True).load(str(tmp_path / "raw")).where("line > 4").collect()
    assert [bytes(r.header) for r in sorted(heads)] == [frame[k, 0].tobytes() for k in (5, 6)] and heads[0].data is None
    times = frames.select("path", "line", (F.col("line") / 4).alias("t"))
    sinks.convert_frames(frames, str(tmp_path / "out"), samples, bands, F.lit(12), height=3, times=times)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0012_0001", "0012_0002", "0012_0003"]
    assert (tmp_path / "out/0012_0002/frame.bil.timing").read_text() == "0.75\n1.0\n1.25\n"
    head = (tmp_path / "out/0012_0003/frame.bil.hdr").read_text()
    assert "lines = 1\n" in head and "field of view = 39.5\n" in head and "ceiling = 65535\n" in head and "wavelength = {380,1435,2490}\n" in head
    for k in range(3):
        assert (tmp_path / f"out/0012_{k + 1:04d}/frame.bil").read_bytes() == frame[3 * k : 3 * k + 3, 1:].tobytes()


def test_tiles_have_world_files_and_holes(spark, tmp_path):
    mosaic = spark.createDataFrame([(0, 1, 0, 1, [1.5, 2.5]), (0, 1, 1, 0, [3.0, 4.0])], "tile_i bigint, tile_j bigint, i bigint, j bigint, v array<double>")
    tiles = spark.createDataFrame([(0, 1, 2, 3, 10.0, 20.0)], "tile_i bigint, tile_j bigint, height bigint, width bigint, i0 double, j0 double")
    world = sinks.world_files(tiles, [0.5, 0.0, 6.0, 0.0, -0.5, 46.0], 2.0)
    sinks.save_tiles(mosaic, tiles, world, str(tmp_path), "v", 2)
    assert [float(x) for x in (tmp_path / "tile_0_1/frame.wld").read_text().split("\n")] == [0.25, 0.0, 0.0, -0.25, 16.0, 41.0]
    data = np.frombuffer((tmp_path / "tile_0_1/frame.bil").read_bytes(), "<f4").reshape(2, 2, 3)
    assert data[0, 0, 1] == 1.5 and data[1, 1, 0] == 4.0 and np.isnan(data[0, 0, 0]) and np.isnan(data).sum() == 8


def cut_off(spark, samples=4, bands=5, lines=21):
    """21 lines in cubes of ten: the last line has its first two samples only, and a cube of its own."""
    return cube(spark, lines, samples, bands).where(f"line < {lines - 1} or sample < 2")


def test_a_recording_may_end_within_a_line(spark, tmp_path):
    px = cut_off(spark)
    written = {r.path.split("/")[-2]: (r.lines, r.ceiling) for r in sinks.write_cube(px, "dns", str(tmp_path), block=10).collect()}
    assert written == {"0000-0": (10, 934), "0000-1": (10, 1934), "0000-2": (1, 2014)}
    assert (tmp_path / "0000-2/frame.bil").stat().st_size == 4 * 5 * 2  # a whole line of bytes
    want = {(r.line, r.sample): [float(v) for v in r.dns] for r in px.collect()}
    assert {(r.line, r.sample): r.spectrum for r in cubes.read_sequence(spark, str(tmp_path), block=4).collect()} == want and len(want) == 82
    part = cubes.read_sequence(spark, str(tmp_path), bands=[3, 0]).where("line >= 19").collect()
    assert {(r.line, r.sample): r.spectrum for r in part} == {k: [v[3], v[0]] for k, v in want.items() if k[0] >= 19}


@pytest.mark.parametrize("missing", ["line = 9 and sample = 3", "line = 19 and sample >= 2", "line = 20 and sample = 0"])
def test_no_other_line_may_be_cut_off(spark, tmp_path, missing):
    with pytest.raises(Exception, match="missing or repeated"):
        sinks.write_cube(cube(spark, 21).where(f"not ({missing})"), "dns", str(tmp_path), block=10)
    assert not all_files(tmp_path)


@pytest.mark.parametrize("interleave", ["bil", "bip", "bsq"])
def test_cut_off_lines_of_all_interleaves(tmp_path, interleave):
    values = np.arange(3 * 4 * 2, dtype="<u2").reshape(3, 4, 2)  # lines, samples, bands
    order = {"bil": (0, 2, 1), "bip": (0, 1, 2), "bsq": (2, 0, 1)}[interleave]
    (tmp_path / "x.bil").write_bytes(np.ascontiguousarray(values.transpose(order)).tobytes())
    (tmp_path / "x.bil.hdr").write_text(f"ENVI\nlines = 3\nsamples = 4\nbands = 2\ndata type = 12\ninterleave = {interleave}\n{codec.LAST_SAMPLES} = 3\n")
    path = str(tmp_path / "x.bil")
    for bands in (None, [1]):
        got = dict(codec.read_lines(path, codec.cube_header(path), 0, 3, bands))
        for line, n in ((0, 4), (1, 4), (2, 3)):
            assert np.array_equal(got[line], values[line, :n] if bands is None else values[line, :n, bands].T.reshape(n, 1))


def test_frames_that_end_within_a_line_are_converted(spark, tmp_path):
    px = cut_off(spark, samples=6, bands=3, lines=8).withColumn("dns", F.concat(F.array(F.lit(7).cast("bigint")), "dns"))
    rows = px.withColumn("width", sinks.width_of_cut_line(px, []))
    sinks.save_lines(sinks.cube_lines(rows, "dns", F.lit("raw"), 12, width=F.col("width")), str(tmp_path / "in"))
    datasource.register(spark)
    frames = spark.read.format(datasource.FRAME).options(samples=6, bands=3, block=2, ending=".bil").load(str(tmp_path / "in"))
    sizes = {r.line: (len(r.header), len(r.data)) for r in frames.collect()}
    assert sizes == {n: (12, 36 if n < 7 else 12) for n in range(8)}
    sinks.convert_frames(frames, str(tmp_path / "out"), 6, 3, F.lit(1), height=3)
    back = spark.read.format(datasource.CUBE).load(str(tmp_path / "out")).collect()
    assert {(r.line, r.sample): r.spectrum for r in back} == {(r.line, r.sample): [float(v) for v in r.dns[1:]] for r in px.collect()} and len(back) == 7 * 6 + 2
