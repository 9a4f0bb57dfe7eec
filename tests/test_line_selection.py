import random

import pytest
from pyspark.sql import functions as F

from swathline.operators import motion

THRESHOLD, INTERVAL = 0.5, 6


def signal_of(lines, rng):
    return [rng.choice([0.0, 0.1, 0.2, 0.9, 1.0, 1.1]) for _ in range(lines)]


def kept_one_by_one(values):
    """The walk over the peaks of lines 1..n, one peak after the other."""
    n = len(values)
    peaks = [i + 1 for i in range(1, n - 1) if values[i] > THRESHOLD and values[i] > values[i - 1] and values[i] > values[i + 1]]
    dropped, at = set(), 0
    while at < len(peaks):
        if at + 2 < len(peaks) and all(2 <= peaks[at + d + 1] - peaks[at + d] <= INTERVAL for d in (0, 1)):
            dropped |= set(range(peaks[at] + 1, peaks[at + 2] + 1))
            at += 2
        at += 1
    return [line for line in range(n + 2) if line not in dropped]


@pytest.mark.parametrize(("slot", "fan", "levels"), [(1024, 64, 2), (2, 3, 4), (5, 2, 1), (3, 4, 0)])
def test_selection_equals_the_walk(spark, slot, fan, levels):
    rng = random.Random(slot)
    values = {0: signal_of(3000, rng), 1: signal_of(40, rng), 2: [0.0] * 20, 3: signal_of(1, rng)}
    rows = [(s, i + 1, v) for s, vs in values.items() for i, v in enumerate(vs)]
    signal = spark.createDataFrame(rows, "seq bigint, line bigint, intensity double")
    got = motion.select_lines_by_inflexion(signal, "seq", THRESHOLD, INTERVAL, slot=slot, fan=fan, levels=levels).collect()
    for s, vs in values.items():
        assert sorted(r["line"] for r in got if r["seq"] == s) == kept_one_by_one(vs)


def test_no_row_longer_than_the_fan(spark):
    """A long sequence: groups of slots, and groups of those, hold at most the fan's number of maps; entries are those of a plain chain."""
    rng = random.Random(5)
    exits = [[rng.randrange(3) for _ in range(3)] for _ in range(20_000)]
    maps = spark.createDataFrame([(7, k, e) for k, e in enumerate(exits)], "seq bigint, slot bigint, exit array<int>")
    assert motion._gathered(maps, "seq", 64).agg(F.max(F.size("_maps"))).first()[0] == 64
    state, want = 0, []
    for e in exits:
        want.append(state)
        state = e[state]
    got = {r["slot"]: r["entry"] for r in motion._entry_states(maps, "seq", 64, 2).collect()}
    assert [got[k] for k in range(len(exits))] == want


def test_empty_signal(spark):
    signal = spark.createDataFrame([], "seq bigint, line bigint, intensity double")
    assert motion.select_lines_by_inflexion(signal, "seq", THRESHOLD, INTERVAL).count() == 0
