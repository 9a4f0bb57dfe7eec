"""Catalog queries against DuckDB. SWATHLINE_ALL=1 runs all of them, otherwise a selection of every family."""

import os

import pytest

from check import compare, duck
from swathline.catalog import load

SF = os.environ.get("SWATHLINE_SF", "/root/testdata/sf0.001")
SOME = [
    "F4_pick_rgb_bands", "R2_subtract_dark_frame", "R3_percentile_levels", "R10_band_covariance", "M1_line_change_signal_big",
    "M6_select_lines_by_inflexion", "G5_poses_to_ecef", "T1_time_at_line", "T5_pose_components", "T9_pps_clock_fix", "P2_rays",
    "P4_project_to_terrain_flat", "O6_splat", "O8_inpaint_nearest", "O13_terrain_faces", "H1_shift_ncc", "H9_rectify_horizontal",
    "L4_nearest_observation", "L6_triangulate", "S2_read_headers", "S10_read_trajectory_text", "K10_trajectory_debug",
]
CATALOG = load()
NAMES = sorted(CATALOG.oracles) if os.environ.get("SWATHLINE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, con, name):
    assert compare(CATALOG.queries[name](spark, SF), con, CATALOG.oracles[name]).startswith("ok")
