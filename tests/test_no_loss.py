"""Nothing is dropped, clipped or moved without a word."""

import pytest
from pyspark.sql import functions as F

from swathline import sinks
from swathline.operators import projection
from swathline.plans import ordered
from swathline.sources import cubes

PX = "seq bigint, line bigint, sample bigint, dns array<bigint>"


def test_unequal_spectra_are_an_error(spark):
    rows = [(0, 0, 0, [1]), (0, 0, 1, [1, 2, 3])]
    px = spark.createDataFrame(rows, PX)
    with pytest.raises(ValueError, match="1 to 3 bands"):
        projection.band_count(px, "dns")
    with pytest.raises(Exception, match="2 bands"):
        projection.weighted_means(px, ["line", "sample"], "dns", F.lit(1.0), 2).collect()
    assert projection.band_count(px.where("sample = 5"), "dns") == 0
    same = projection.weighted_means(px.where("sample = 1"), ["line"], "dns", F.lit(2.0), 3).first()
    assert same["dns"] == [1.0, 2.0, 3.0] and same["w"] == 2.0


def folder_of(path, count, broken=None):
    for k in range(count):
        folder = path / f"run-{k}"
        folder.mkdir(parents=True)
        (folder / "a.bil").write_bytes(bytes(2 * 3 * 4))
        head = {"lines": 2, "samples": 3, "bands": 4, "data type": 1, "interleave": "bil"}
        if k == 1 and broken:
            head |= broken
        (folder / "a.bil.hdr").write_text("ENVI\n" + "".join(f"{n} = {v}\n" for n, v in head.items() if v is not None))


@pytest.mark.parametrize("broken", [{"lines": None}, {"samples": 4}, {"interleave": "bip"}, {"data type": 12}])
def test_a_bad_header_fails_the_sequence(spark, tmp_path, broken):
    folder_of(tmp_path / "s", 3, broken)
    with pytest.raises(ValueError):
        cubes.read_sequence(spark, str(tmp_path / "s"))


def test_missing_header_and_wrong_size(spark, tmp_path):
    folder_of(tmp_path / "s", 3)
    assert cubes.read_sequence(spark, str(tmp_path / "s")).count() == 18
    (tmp_path / "s/run-1/a.bil").write_bytes(bytes(30))
    with pytest.raises(Exception, match="30 bytes"):
        cubes.read_sequence(spark, str(tmp_path / "s")).collect()
    (tmp_path / "s/run-1/a.bil.hdr").unlink()
    with pytest.raises(ValueError, match="no usable header"):
        cubes.read_sequence(spark, str(tmp_path / "s"))


def test_writer_places_values_or_refuses(spark, tmp_path):
    def write(rows, name, **kw):
        return sinks.write_cube(spark.createDataFrame(rows, PX), "dns", str(tmp_path / name), **kw).collect()

    with pytest.raises(Exception, match="missing or repeated"):
        write([(0, 0, 0, [1]), (0, 1, 0, [1]), (0, 1, 1, [2]), (0, 1, 2, [3])], "gap")
    with pytest.raises(Exception, match="missing or repeated"):
        write([(0, 0, 0, [1]), (0, 0, 0, [2])], "twice")
    with pytest.raises(Exception, match="don't fit"):
        write([(0, 0, 0, [-500])], "range")
    write([(0, 1, 1, [4]), (0, 0, 1, [2]), (0, 1, 0, [3]), (0, 0, 0, [1])], "with a blank")
    back = cubes.read_sequence(spark, str(tmp_path / "with a blank")).collect()
    assert {(r.line, r.sample): r.spectrum for r in back} == {(0, 0): [1.0], (0, 1): [2.0], (1, 0): [3.0], (1, 1): [4.0]}


def test_paths():
    assert cubes.store_uri("s3a://bucket/key") == "s3://bucket/key"
    assert cubes.file_system("file:/tmp/a%20b")[1] == "/tmp/a b"


def test_level_and_rising_rays_meet_a_slope(spark):
    slope = spark.createDataFrame([(i, j, 2.0 * i) for i in range(12) for j in range(6)], "i bigint, j bigint, z double")
    rays = [
        (0, 0, 1.0, 2.5, 8.0, 1.0, 0.0, 0.0),  # level: meets z = 8 at row 4
        (0, 1, 1.0, 2.5, 4.0, 1.0, 0.0, 1.0),  # rising by 1 per row: 4 + s = 2 (1 + s) at s = 2
        (0, 2, 1.0, 2.5, 8.0, -1.0, 0.0, 0.0),  # level, away from the slope
        (0, 3, 1.0, 2.5, 50.0, 1.0, 0.0, 1.0),  # rising above the top
        (0, 4, 5.0, 2.5, 30.0, 0.0, 0.0, -1.0),  # straight down
        (0, 5, 5.0, 2.5, -3.0, 0.0, 0.0, 1.0),  # straight up from below
    ]
    table = spark.createDataFrame(rays, "line bigint, sample bigint, o_0 double, o_1 double, o_2 double, d_0 double, d_1 double, d_2 double")
    hits = {r["sample"]: (r["pi"], r["z"]) for r in projection.project_to_terrain(table, slope, ["line", "sample"], tile=4).collect()}
    want = {0: (4.0, 8.0), 1: (3.0, 6.0), 2: None, 3: None, 4: (5.0, 10.0), 5: None}
    for k, hit in want.items():
        assert (hits[k] == (None, None)) if hit is None else hits[k] == pytest.approx(hit, abs=1e-6), k


def test_carry_over_many_slots_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", 4)
    n = 400
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).cast("double").alias("t"), F.col("id").alias("v"))
    before = ordered.with_previous(df, ["k"], "t", ["v"], width=1.0)
    assert before.where("v > 0 and prev.v <> v - 1 or v = 0 and prev is not null").count() == 0
    after = ordered.with_previous(df, ["k"], "t", ["v"], width=1.0, following=True)
    assert after.where(f"v < {n - 1} and prev.v <> v + 1 or v = {n - 1} and prev is not null").count() == 0
    sums = ordered.with_running_sum(df, ["k"], "t", F.col("v"), "s", width=1.0)
    assert sums.where("s <> v * (v + 1) / 2").count() == 0
    index = ordered.with_row_index(df, ["k"], "t", "x", width=1.0)
    assert index.where("x <> v").count() == 0
    asked = spark.createDataFrame([(1, 5.0), (1, 2000.0), (1, 3995.0)], "k int, t double")
    got = {r["t"]: (r["lower"] and r["lower"]["v"], r["upper"] and r["upper"]["v"]) for r in ordered.asof_bracket(df, asked, ["k"], "t", ["v"], width=1.0).collect()}
    assert got == {5.0: (0, 1), 2000.0: (200, 200), 3995.0: (399, None)}


def test_no_task_gets_a_whole_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", 16)
    df = spark.range(4096).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("_s"), F.col("id").alias("v"))
    widest = df.groupBy("k", F.floor(F.col("_s") / 16)).count().agg(F.max("count")).first()[0]
    assert widest == 16  # and 4096 / 16 ** 2 = 16 rows at the last level
    carried = ordered._carried(df, ["k"], [("v", "sum", "s")])
    assert carried.where("coalesce(s, 0) <> _s * (_s - 1) / 2").count() == 0
