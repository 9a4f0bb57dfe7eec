"""Signals of motion along a sequence: change between lines, platform speed, inflexions, and line selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import spectral
from swathline.operators.radiometry import percentile_levels
from swathline.plans.lines import sum_over, with_line_neighbours
from swathline.plans.ordered import SLOT_LINES, with_previous, with_row_index
from swathline.session import cut_lineage

EARTH_RADIUS = 6.3781e6  # fixed value: mean radius used for degree steps


def line_change_signal(px: DataFrame, array: str, seq: list[str] | None = None) -> DataFrame:
    """Mean absolute difference of a line to the line before, over samples and bands; 0 for a line without one."""
    seq = seq or []
    pairs = with_line_neighbours(px.select(*seq, "line", "sample", array), [array], seq)
    step = sum_over(F.zip_with(array, F.col(f"prev.{array}"), lambda a, b: F.abs(a - b).cast("double")))
    return pairs.groupBy(*seq, "line").agg(
        F.coalesce(F.try_divide(F.sum(step), F.sum(F.when(F.col("prev").isNotNull(), F.size(array)))), F.lit(0.0)).alias("change")
    )


def signal_difference(signal: DataFrame, seq: list[str] | None = None, value: str = "change") -> DataFrame:
    """Drop the first line and add the step to the line before: a line table joined to itself on line + 1."""
    seq = seq or []
    before = signal.select(*seq, (F.col("line") + 1).alias("line"), F.col(value).alias("_b"), F.lit(True).alias("_has"))
    first = before.select(*seq, F.col("line"))
    steps = signal.join(before, [*seq, "line"])
    has_two = steps.join(first.select(*seq, (F.col("line") + 1).alias("line"), F.lit(True).alias("_two")), [*seq, "line"], "left")
    return has_two.select(*seq, "line", value, F.when(F.col("_two"), F.col(value) - F.col("_b")).alias("step"))


def ins_motion(poses: DataFrame, key: str = "flight", compat: bool = False) -> DataFrame:
    """Rotation and translation amount between consecutive poses; ``compat`` divides the longitude step by cos(lat)."""
    cols = ["roll", "pitch", "yaw", "lat", "lon", "height"]
    pairs = with_previous(poses, [key], "t", cols).where("prev is not null")
    angle = F.sqrt(sum(F.pow(spectral.angle_delta(F.col(c), F.col(f"prev.{c}")), 2) for c in cols[:3]))
    step = lambda c: F.col(c) - F.col(f"prev.{c}")
    per_degree = EARTH_RADIUS / 180 * math.pi
    cosine = F.cos(F.radians("lat"))
    d_lon = step("lon") / cosine if compat else step("lon") * cosine
    dist = F.sqrt(F.pow(step("lat") * per_degree, 2) + F.pow(d_lon * per_degree, 2) + F.pow(step("height"), 2))
    return pairs.select(key, "t", angle.alias("angle"), dist.alias("distance"))


def _shifted(rows: DataFrame, keys: list[str], index: str, offsets: list[tuple[int, float]], cols: list[str]) -> DataFrame:
    """Weighted sum of rows at ``index`` + offset, the ends repeated: an equi-join per tap, never a centred window.

    Taps are exploded on a narrow line table; (number of taps) x (lines) rows, each joined on (keys, index).
    """
    last = rows.groupBy(*keys).agg(F.max(index).alias("_last"))
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(w)).alias("w")) for o, w in offsets])
    asked = rows.select(*keys, index).join(last, keys).withColumn("_tap", F.explode(taps))
    source = F.least(F.greatest(F.col(index) + F.col("_tap.o"), F.lit(0)), F.col("_last"))
    asked = asked.select(*keys, F.col(index).alias("_to"), source.alias(index), F.col("_tap.w").alias("_w"))
    return asked.join(rows.select(*keys, index, *cols), [*keys, index]).groupBy(*keys, "_to").agg(
        *[F.sum(F.col(c) * F.col("_w")).alias(f"d{c}") for c in cols]
    ).withColumnRenamed("_to", index)


def derivative_taps(radius: int, std_dev: float) -> list[tuple[int, float]]:
    """Derivative-of-Gaussian weights, divided by the sum of the Gaussian."""
    gauss = {k: math.exp(-(k * k) / (std_dev * std_dev)) for k in range(-radius, radius + 1)}
    total = sum(gauss.values())
    return [(k, -2 * k * g / total) for k, g in gauss.items()]


def clean_line_mask(
    track: DataFrame, keys: list[str], radius: int = 3, std_dev: float = 1.5, speed_thresh: float = 0.5,
    turn_thresh: float = 0.5, expand: int = 2,
) -> DataFrame:
    """Lines flown at a steady speed and direction: keys, line, speed, turn, clean.

    Smoothed velocity; speed within (1-speed_thresh)*median of the median speed; direction change between the two
    neighbours below median + (1-turn_thresh)*median; a line counts when any line within ``expand`` does.
    ``track`` has line 0..n-1 and x, y, z.
    """
    velocity = _shifted(track, keys, "line", derivative_taps(radius, std_dev), ["x", "y", "z"])
    speed = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    velocity = cut_lineage(velocity.withColumn("speed", speed))
    unit = velocity.select(*keys, "line", *[F.coalesce(F.try_divide(f"d{c}", "speed"), F.lit(0.0)).alias(f"u{c}") for c in "xyz"])
    turn = _shifted(unit, keys, "line", [(-1, -1.0), (1, 1.0)], ["ux", "uy", "uz"])
    turn = turn.select(*keys, "line", F.sqrt(F.col("dux") ** 2 + F.col("duy") ** 2 + F.col("duz") ** 2).alias("turn"))
    # one narrow row per line, read many times by the medians: keep it instead of recomputing it each time
    rated = cut_lineage(velocity.select(*keys, "line", "speed").join(turn, [*keys, "line"]))
    ms = percentile_levels(rated, keys, "speed", 0.5, 0.5).select(*keys, F.col("black").alias("_ms"))
    mt = percentile_levels(rated, keys, "turn", 0.5, 0.5).select(*keys, F.col("black").alias("_mt"))
    steady = (F.abs(F.col("speed") - F.col("_ms")) < (1 - speed_thresh) * F.col("_ms")) & (
        F.col("turn") <= F.col("_mt") + (1 - turn_thresh) * F.col("_mt")
    )
    rated = rated.join(ms, keys).join(mt, keys).withColumn("_ok", steady)
    near = rated.where("_ok").select(*keys, F.explode(F.sequence(F.col("line") - expand, F.col("line") + expand)).alias("line")).distinct()
    return rated.join(near.withColumn("_near", F.lit(True)), [*keys, "line"], "left").select(
        *keys, "line", "speed", "turn", F.coalesce("_near", F.lit(False)).alias("clean")
    )


def _extremum(center: Column, a: Column, b: Column, count_weight: float, magnitude_weight: float) -> Column:
    size = F.least(F.abs(center - a), F.abs(center - b)).cast("double")
    peak = ((center < a) & (center < b)) | ((center > a) & (center > b))
    return F.when(peak & (size > 0), count_weight + magnitude_weight * size).otherwise(F.lit(0.0))


def _extrema_sum(array: str, left: Column, right: Column, count_weight: float, magnitude_weight: float) -> Column:
    # F.transform with the index keeps the three arrays apart; NULL neighbours give NULL, which sum() skips
    return sum_over(F.transform(
        F.col(array), lambda c, k: _extremum(c, F.get(left, k), F.get(right, k), count_weight, magnitude_weight)
    ))


def inflexion_intensity(
    px: DataFrame, array: str, seq: list[str] | None = None, mask: str | None = None, count_weight: float = 1.0,
    magnitude_weight: float = 0.0, relative: bool = True,
) -> DataFrame:
    """Extrema along the track per line (first and last line excluded), relative to the extrema across the track.

    A pixel counts only if ``mask`` holds in its own line and both neighbours.
    """
    seq = seq or []
    base = px.select(*seq, "line", "sample", array, (F.col(mask) if mask else F.lit(True)).alias("_m"))
    triple = with_line_neighbours(base, [array, "_m"], seq, True, True).where("prev is not null and next is not null")
    triple = triple.where("_m and prev._m and next._m")
    args = (count_weight, magnitude_weight)
    vertical = _extrema_sum(array, F.col(f"prev.{array}"), F.col(f"next.{array}"), *args)
    lines = with_line_bounds(px, seq)
    found = triple.groupBy(*seq, "line").agg(F.sum(vertical).alias("v"))
    if relative:
        side = base.select(*seq, "line", "sample", F.col(array).alias("_side"))
        left = side.withColumn("sample", F.col("sample") + 1).withColumnRenamed("_side", "_left")
        right = side.withColumn("sample", F.col("sample") - 1).withColumnRenamed("_side", "_right")
        on = [*seq, "line", "sample"]
        across = triple.select(*on, array).join(left, on).join(right, on)
        h = across.groupBy(*seq, "line").agg(F.sum(_extrema_sum(array, F.col("_left"), F.col("_right"), *args)).alias("h"))
        found = found.join(h, [*seq, "line"], "left").withColumn(
            "v", F.col("v") / F.greatest(F.lit(1.0), F.coalesce("h", F.lit(0.0)))
        )
    return lines.join(found, [*seq, "line"], "left").select(*seq, "line", F.coalesce("v", F.lit(0.0)).alias("intensity"))


def with_line_bounds(px: DataFrame, seq: list[str]) -> DataFrame:
    """Lines that have both neighbours in the sequence."""
    lines = px.select(*seq, "line").distinct()
    up = lines.withColumn("line", F.col("line") + 1)
    down = lines.withColumn("line", F.col("line") - 1)
    return lines.join(up, [*seq, "line"], "left_semi").join(down, [*seq, "line"], "left_semi")


def inflexion_peaks(signal: DataFrame, seq: list[str], threshold: float, value: str = "intensity") -> DataFrame:
    """Lines above the threshold and above both neighbours (an end compares with itself, so it is no peak)."""
    at = lambda d, n: signal.select(*seq, (F.col("line") + d).alias("line"), F.col(value).alias(n))
    strong = signal.where(F.col(value) > threshold)
    joined = strong.join(at(1, "_p"), [*seq, "line"]).join(at(-1, "_n"), [*seq, "line"])
    return joined.where((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n"))).select(*seq, "line", value)


def _gathered(maps: DataFrame, seq: str, fan: int | None) -> DataFrame:
    """Maps of neighbouring slots in one row, in order: seq, group, _maps. ``fan`` slots make a group, or all of the sequence."""
    group = F.floor(F.col("slot") / fan) if fan else F.lit(0).cast("bigint")
    return maps.groupBy(seq, group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("slot", "exit"))).alias("_maps"))


def _entry_states(maps: DataFrame, seq: str, fan: int, levels: int) -> DataFrame:
    """State in which the walk enters each slot: seq, slot, entry. ``maps`` has seq, slot, exit (the exit state by entry state).

    Maps compose associatively, so a group of ``fan`` slots has a map of its own; the groups are entered as their own table
    tells, one level up, and hand their state on within. Above the last level a sequence has one row.
    """
    groups = _gathered(maps, seq, fan if levels else None)
    if levels:
        whole = F.aggregate("_maps", F.array(*[F.lit(s) for s in range(3)]), lambda states, m: F.transform(states, lambda s: F.get(m["exit"], s)))
        upper = _entry_states(groups.select(seq, F.col("group").alias("slot"), whole.alias("exit")), seq, fan, levels - 1)
        groups = groups.join(upper.withColumnRenamed("slot", "group"), [seq, "group"])
    else:
        groups = groups.withColumn("entry", F.lit(0))
    states = F.aggregate("_maps", F.array("entry"), lambda known, m: F.concat(known, F.array(F.get(m["exit"], F.element_at(known, -1)))))
    slots = F.explode(F.arrays_zip(F.col("_maps.slot").alias("slot"), F.slice(states, 1, F.size("_maps")).alias("entry")))
    return groups.select(seq, slots.alias("_e")).select(seq, "_e.slot", "_e.entry")


def select_lines_by_inflexion(
    signal: DataFrame, seq: str, threshold: float, max_interval: int, value: str = "intensity", slot: int = 1024,
    fan: int = 64, levels: int = 2,
) -> DataFrame:
    """Lines to keep. At a visited peak whose next and second next peak follow within ``max_interval`` each, the lines
    after it up to the second next peak are dropped, and the walk goes on behind that peak.

    The walk is a three-state automaton over peaks (0, 1 or 2 peaks still to skip). Each slot of peaks is reduced to
    the map from entry to exit state, the maps are composed in a tree (``fan`` slots, ``fan`` of those, ``levels`` times)
    and the slots are replayed with the entry that comes down the tree: no task sees more than ``slot`` peaks and no row
    more than ``fan`` maps, but for the top row with one map per ``slot * fan ** levels`` peaks (4.2 million).
    ``signal`` covers lines 1..L-2; lines before and after are always kept.
    """
    peaks = inflexion_peaks(signal, [seq], threshold, value).select(seq, "line")
    peaks = with_row_index(peaks, [seq], "line", "k", SLOT_LINES)
    nxt = lambda d: peaks.select(seq, (F.col("k") - d).alias("k"), F.col("line").alias(f"l{d}"))
    walk = peaks.join(nxt(1), [seq, "k"], "left").join(nxt(2), [seq, "k"], "left")
    gap1, gap2 = F.col("l1") - F.col("line"), F.col("l2") - F.col("l1")
    jump = F.coalesce((gap1 >= 2) & (gap1 <= max_interval) & (gap2 >= 2) & (gap2 <= max_interval), F.lit(False))
    walk = cut_lineage(walk.select(seq, "k", "line", "l2", jump.alias("jump"), F.floor(F.col("k") / slot).alias("slot")))

    steps = F.array_sort(F.collect_list(F.struct("k", "jump")))
    start = F.array(*[F.lit(s) for s in range(3)])
    advance = lambda states, p: F.transform(
        states, lambda s: F.when(s > 0, s - 1).otherwise(F.when(p["jump"], F.lit(2)).otherwise(F.lit(0)))
    )
    maps = walk.groupBy(seq, "slot").agg(steps.alias("_steps")).select(
        seq, "slot", F.aggregate("_steps", start, advance).alias("exit")
    )
    entry = _entry_states(maps, seq, fan, levels)

    def replay(pdf):
        pdf = pdf.sort_values("k")
        state, visited = int(pdf["entry"].iloc[0]), []
        for jumped in pdf["jump"]:
            visited.append(state == 0)
            state = state - 1 if state > 0 else (2 if jumped else 0)
        return pdf.assign(visited=visited)[[seq, "line", "l2", "jump", "visited"]]

    replayed = walk.join(entry, [seq, "slot"]).groupBy(seq, "slot").applyInPandas(
        replay, f"{seq} bigint, line bigint, l2 double, jump boolean, visited boolean"
    )
    dropped = replayed.where("visited and jump").select(
        seq, F.explode(F.sequence(F.col("line") + 1, F.col("l2").cast("bigint"))).alias("line")
    )
    ends = signal.groupBy(seq).agg(F.min("line").alias("_a"), F.max("line").alias("_b"))
    ends = ends.select(seq, F.explode(F.array(F.col("_a") - 1, F.col("_b") + 1)).alias("line"))
    return signal.select(seq, "line").unionByName(ends).join(dropped, [seq, "line"], "left_anti")


def drop_lines(px: DataFrame, selected: DataFrame, seq: list[str]) -> DataFrame:
    """Keep the selected lines and number them from 0. The numbering happens on the line table."""
    numbered = with_row_index(selected.select(*seq, "line"), seq, "line", "new_line", SLOT_LINES)
    joined = px.join(numbered, [*seq, "line"])
    return joined.withColumn("line", F.col("new_line")).drop("new_line")
