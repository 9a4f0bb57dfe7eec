"""Times of lines, poses at times and comparisons between trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import geo, spectral, vec
from swathline.operators.geodesy import mean_frame
from swathline.plans.ordered import SLOT_LINES, asof_bracket, with_previous, with_row_index, with_running_sum

POSE = ["r_0", "r_1", "r_2", "p_0", "p_1", "p_2"]


def time_at_line(lines: DataFrame, asked: DataFrame, y: str = "y", scale: float = 1.0, delta: float = 0.0) -> DataFrame:
    """Add ``t``: blend of the times of lines floor(y) and floor(y)+1, NULL outside. Keys: seq, line."""
    here = lines.select("seq", "line", spectral.rescale_time(F.col("t"), scale, delta).alias("_t0"))
    after = lines.select("seq", (F.col("line") - 1).alias("line"), spectral.rescale_time(F.col("t"), scale, delta).alias("_t1"))
    pairs = here.join(after, ["seq", "line"])
    joined = asked.withColumn("line", F.floor(y)).join(pairs, ["seq", "line"], "left")
    t = (F.col("line") + 1 - F.col(y)) * F.col("_t0") + (F.col(y) - F.col("line")) * F.col("_t1")
    return joined.withColumn("t", t).drop("line", "_t0", "_t1")


def time_at_line_linear(y: Column, initial: Column, per_line: Column) -> Column:
    return initial + y * per_line


def line_breakpoints(files: DataFrame) -> DataFrame:
    """Cumulative (image lines, trajectory rows) at the start of each file: seq, file_no, line0, row0 and counts."""
    out = with_running_sum(files, ["seq"], "file_no", F.col("lines"), "line0", SLOT_LINES, inclusive=False)
    return with_running_sum(out, ["seq"], "file_no", F.col("rows"), "row0", SLOT_LINES, inclusive=False)


def image_line_to_row(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Fractional trajectory row of an image line, linear between the file breakpoints around it.

    Breakpoints are the cumulative counts at file starts and at the end; beyond the end the last one holds.
    """
    starts = line_breakpoints(files)
    ends = starts.select("seq", (F.col("line0") + F.col("lines")).alias("line"), (F.col("row0") + F.col("rows")).alias("row0"))
    cuts = starts.select("seq", F.col("line0").alias("line"), "row0").unionByName(ends)
    found = asof_bracket(cuts, asked, ["seq"], "line", ["row0"], SLOT_LINES)
    lo, up = F.col("lower"), F.col("upper")
    share = F.try_divide((F.col("line") - lo["line"]).cast("double"), up["line"] - lo["line"])
    inside = lo["row0"] + F.coalesce(share, F.lit(0.0)) * (up["row0"] - lo["row0"])
    return found.select("seq", "line", F.when(lo.isNull(), F.lit(0.0)).when(up.isNull(), lo["row0"]).otherwise(inside).alias("row"))


def first_after(track: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Index of the first row of ``track`` with time > t, n when there is none: keys, t, first_after, n."""
    ordered = with_row_index(track.select(*keys, "t").distinct(), keys, "t", "idx")
    n = ordered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = asof_bracket(ordered, asked, keys, "t", ["idx"])
    return found.join(n, keys).select(
        *keys, "t", F.coalesce(F.col("lower.idx") + 1, F.lit(0)).alias("first_after"), "n"
    )


def ref_track_align(track: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Index range of the comparison track for a segment (t0, t1): start one before, end at the first later row."""
    asked = segments.select(*keys, F.explode(F.array("t0", "t1")).alias("t"))
    found = first_after(track, asked, keys)
    start = found.select(*keys, F.col("t").alias("t0"),
                         F.when(F.col("first_after") == F.col("n"), F.col("n")).otherwise(F.col("first_after") - 1).alias("start"))
    end = found.select(*keys, F.col("t").alias("t1"), F.col("first_after").alias("end"))
    return segments.join(start, [*keys, "t0"]).join(end, [*keys, "t1"])


def bracket_poses(poses: DataFrame, asked: DataFrame, key: str = "flight", t: str = "t", cols: list[str] = POSE) -> DataFrame:
    """key, t, lower, upper and the upper weight ``w`` (0 on an exact hit); NULL poses outside the trajectory."""
    found = asof_bracket(poses, asked, [key], t, cols)
    span = F.col(f"upper.{t}") - F.col(f"lower.{t}")
    w = F.when(span > 0, (F.col(t) - F.col(f"lower.{t}")) / span).when(span == 0, F.lit(0.0))
    return found.withColumn("w", w)


def _fields(name: str, prefix: str) -> list[Column]:
    return [F.col(f"{name}.{prefix}_{k}") for k in range(3)]


def blend(found: DataFrame, mode: str = "manifold") -> DataFrame:
    """Replace lower/upper/w by one pose r_*, p_*.

    'components' mixes axis-angle entries (wrong near half turns), 'manifold' follows the shortest rotation and mixes
    positions linearly, 'relative' scales the relative motion lower^-1*upper; the last two agree.
    """
    w = F.col("w")
    known = w.isNotNull()
    out = vec.keep(found, a=_fields("lower", "r"), b=_fields("upper", "r"), s=_fields("lower", "p"), e=_fields("upper", "p"))
    mix = lambda x, y: vec.add(vec.scale(x, 1 - w), vec.scale(y, w))
    if mode == "components":
        out = vec.keep(out, r=mix(vec.ref("a"), vec.ref("b")), p=mix(vec.ref("s"), vec.ref("e")))
    else:
        out = vec.with_rodrigues(vec.with_rodrigues(out, "m", vec.ref("a")), "q", vec.ref("b"))
        out = vec.keep(out, z=vec.matmul(vec.transpose(vec.ref("m", 9)), vec.ref("q", 9)))
        out = vec.with_log(out, "d", "z")
        out = vec.with_rodrigues(out, "q", vec.scale(vec.ref("d"), w))
        if mode == "manifold":
            p = mix(vec.ref("s"), vec.ref("e"))
        elif mode == "relative":
            step = vec.matvec(vec.transpose(vec.ref("m", 9)), vec.sub(vec.ref("e"), vec.ref("s")))
            p = vec.add(vec.ref("s"), vec.matvec(vec.ref("m", 9), vec.scale(step, w)))
        else:
            raise ValueError(f"unknown blend {mode!r}")
        out = vec.keep(out, z=vec.matmul(vec.ref("m", 9), vec.ref("q", 9)), p=p)
        out = vec.with_log(out, "r", "z")
    out = out.withColumns({c: F.when(known, F.col(c)) for c in POSE})
    return vec.drop(out, "a", "b", "s", "e", "m", "q", "d", "z").drop("lower", "upper", "w")


def pose_at_time(
    poses: DataFrame, asked: DataFrame, mode: str = "manifold", key: str = "flight", inside_only: bool = False,
) -> DataFrame:
    """Pose r_*, p_* for each distinct (key, t) asked; NULL outside the trajectory, or no row with ``inside_only``.

    Filter with ``inside_only`` rather than on the pose columns: a predicate on them would be pushed down through the
    rotation steps as one expression that repeats all of them.
    """
    found = bracket_poses(poses, asked, key)
    return blend(found.where("w is not null") if inside_only else found, mode)


def scanline_poses(headers: DataFrame, poses: DataFrame, flip_yz: bool = True) -> DataFrame:
    """Pose of every line of a file clocked by its frame rate from the first trajectory row.

    Latitude, longitude, height and angles are blended in geodetic terms; positions come out in an ENU frame at the
    mean position of all lines. ``headers`` has flight, lines, framerate. Lines outside the trajectory are dropped.
    """
    first = poses.groupBy("flight").agg(F.min("t").alias("_t0"))
    clock = headers.where("lines is not null and framerate > 0").join(first, "flight").select(
        "flight", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lines") - 1)).alias("line"), "_t0", "framerate"
    ).withColumn("t", F.col("_t0") + F.col("line") / F.col("framerate"))
    cols = ["lat", "lon", "height", "roll", "pitch", "yaw"]
    found = bracket_poses(poses, clock, cols=cols).where("w is not null")
    w = F.col("w")
    lerp = lambda c: (1 - w) * F.col(f"lower.{c}") + w * F.col(f"upper.{c}")
    angle = lambda c: spectral.angle_lerp(F.col(f"lower.{c}"), F.col(f"upper.{c}"), w)
    at = found.select("flight", "t", *[lerp(c).alias(c) for c in cols[:3]], *[angle(c).alias(c) for c in cols[3:]])
    at = clock.select("flight", "line", "t").join(at, ["flight", "t"])
    rot = geo.body_to_ecef(F.col("lat"), F.col("lon"), F.col("roll"), F.col("pitch"), F.col("yaw"), roll_sign=1,
                           flip_yz=flip_yz, to_ned=False)
    m, t = mean_frame(at)
    at = vec.keep(at, m=rot, e=geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("height")))
    at = vec.with_log(vec.keep(at, p=geo.apply_affine(m, t, vec.ref("e"))), "r", "m")
    return at.select("flight", "line", "t", *POSE)


def compose_mounting(poses: DataFrame, mounting: DataFrame, key: str = "flight") -> DataFrame:
    """Sensor-to-ECEF pose: body pose after the mounting (key, mr_*, mt_*); a missing mounting is the identity."""
    joined = poses.join(mounting, key, "left").fillna(0.0, [f"m{n}_{k}" for n in "rt" for k in range(3)])
    joined = vec.with_rodrigues(vec.with_rodrigues(joined, "a", vec.ref("r")), "b", vec.ref("mr"))
    rot, t = vec.compose(vec.ref("a", 9), vec.ref("p"), vec.ref("b", 9), vec.ref("mt"))
    joined = vec.keep(joined, c=rot, s=t)
    joined = vec.with_log(vec.keep(joined, p=vec.ref("s")), "r", "c")
    return vec.drop(joined, "a", "b", "c", "s", "mr", "mt")


def nearest_node(nodes: DataFrame, asked: DataFrame, key: str = "flight") -> DataFrame:
    """Pose node nearest in time (the later one on a tie) and the motion from measurement to node.

    key, t, status ('ok' or 'outside'), node_t, d_0..2 (rotation), s_0..2 (translation) of node^-1 * pose(t).
    """
    found = bracket_poses(nodes, asked, key)
    prev = (F.col("t") - F.col("lower.t")) < (F.col("upper.t") - F.col("t"))
    node = F.when(F.col("w").isNotNull(), F.when(prev, F.col("lower")).otherwise(F.col("upper")))
    out = found.withColumn("node", node).withColumn("status", F.when(F.col("w").isNotNull(), "ok").otherwise("outside"))
    out = blend(out)
    out = vec.with_rodrigues(vec.with_rodrigues(out, "a", _fields("node", "r")), "b", vec.ref("r"))
    inv_r, inv_t = vec.inverse(vec.ref("a", 9), _fields("node", "p"))
    out = vec.keep(out, c=inv_r, e=inv_t)
    rot, t = vec.compose(vec.ref("c", 9), vec.ref("e"), vec.ref("b", 9), vec.ref("p"))
    out = vec.keep(out, m=rot, s=t)
    out = vec.with_log(out, "d", "m")
    return out.select(key, "t", "status", F.col("node.t").alias("node_t"), *[f"d_{k}" for k in range(3)], *[f"s_{k}" for k in range(3)])


def pps_clock_fix(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Line time from the GPS time and clock of the nearest flagged line (the earlier only if strictly nearer)."""
    flagged = lines.where("flag")
    found = asof_bracket(flagged, lines, [key], "line", ["tow", "pps"], SLOT_LINES)
    lo, up, line = F.col("lower"), F.col("upper"), F.col("line")
    earlier = up.isNull() | ((line - lo["line"]) < (up["line"] - line))
    pick = F.when(lo.isNotNull() & earlier, lo).otherwise(up)
    fix = found.select(key, "line", pick.alias("fix")).where(F.col("fix").isNotNull())
    return lines.join(fix, [key, "line"]).select(
        key, "line", (F.col("fix.tow") * 10 + F.col("clock") - F.col("fix.pps")).alias("time")
    )


def orientation_rate_residual(poses: DataFrame, key: str = "flight") -> DataFrame:
    """log(R1 * exp(w*dt)) - r2 for consecutive poses; ``poses`` has r_*, w_* (rate)."""
    pairs = with_previous(poses, [key], "t", ["t", "r_0", "r_1", "r_2"], "next", following=True).where("next is not null")
    dt = F.col("next.t") - F.col("t")
    pairs = vec.with_rodrigues(vec.with_rodrigues(pairs, "a", vec.ref("r")), "b", vec.scale(vec.ref("w"), dt))
    pairs = vec.keep(pairs, c=vec.matmul(vec.ref("a", 9), vec.ref("b", 9)))
    pairs = vec.with_log(pairs, "l", "c")
    pairs = vec.keep(pairs, d=vec.sub(vec.ref("l"), _fields("next", "r")))
    return pairs.select(key, "t", "d_0", "d_1", "d_2")
