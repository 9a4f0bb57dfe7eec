"""Motion signals (M*)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.operators import motion as op
from swathline.operators.geodesy import local_track
from swathline.plans import inputs as inp

CHANGE = """SELECT line, coalesce((SELECT sum(abs(a.dn - b.dn))::DOUBLE / count(*) FROM {t} a JOIN {t} b ON a.sample = b.sample AND a.band = b.band
       AND b.line = a.line - 1 WHERE a.line = l.line), 0) AS change FROM (SELECT DISTINCT line FROM {t}) l"""
CHANGE_JOIN = """SELECT l.line, coalesce(c.change, 0) AS change FROM (SELECT DISTINCT line FROM {t}) l LEFT JOIN
       (SELECT a.line, sum(abs(a.dn - b.dn))::DOUBLE / count(*) AS change FROM {t} a JOIN {t} b ON a.sample = b.sample AND a.band = b.band
       AND b.line = a.line - 1 GROUP BY 1) c USING (line)"""


@query("M1_line_change_signal", sql(f"SELECT line, {s6('change')} FROM c", c=CHANGE_JOIN.format(t="px")))
def _(spark, sf):
    return op.line_change_signal(inp.pixels(spark, sf), "dns").select("line", r6("change"))


@query("M1_line_change_signal_big", sql(f"SELECT line, {s6('change')} FROM c", c=CHANGE_JOIN.format(t="big")))
def _(spark, sf):
    return op.line_change_signal(inp.pixels_big(spark, sf), "dns").select("line", r6("change"))


@query("M2_signal_difference", sql(f"SELECT line, {s6('change')}, {s6('CASE WHEN line > 1 THEN change - b END', 'step')} FROM (SELECT *, lag(change) OVER (ORDER BY line) AS b FROM c) WHERE line > 0", c=CHANGE_JOIN.format(t="px")))
def _(spark, sf):
    out = op.signal_difference(op.line_change_signal(inp.pixels(spark, sf), "dns"))
    return out.select("line", r6("change"), r6("step"))


def _ins(cosine):
    d = lambda c: f"pow((CASE WHEN {c} < 0 THEN {c} + 2 * pi() ELSE {c} END) - (CASE WHEN lag({c}) OVER w < 0 THEN lag({c}) OVER w + 2 * pi() ELSE lag({c}) OVER w END), 2)"
    k = "(6.3781e6 / 180 * pi())"
    return sql(f"""SELECT flight, t, {s6('angle')}, {s6('distance', 'distance', 4)} FROM (SELECT flight, t, lag(t) OVER w AS pt,
        sqrt({d('roll')} + {d('pitch')} + {d('yaw')}) AS angle,
        sqrt(pow((lat - lag(lat) OVER w) * {k}, 2) + pow((lon - lag(lon) OVER w) {cosine} cos(radians(lat)) * {k}, 2) + pow(height - lag(height) OVER w, 2)) AS distance
        FROM poses WINDOW w AS (PARTITION BY flight ORDER BY t)) WHERE pt IS NOT NULL""")


@query("M3_ins_motion", _ins("*"))
def _(spark, sf):
    return op.ins_motion(inp.poses_raw(spark, sf)).select("flight", "t", r6("angle"), r6("distance", digits=4))


@query("M3_ins_motion_compat", _ins("/"))
def _(spark, sf):
    return op.ins_motion(inp.poses_raw(spark, sf), compat=True).select("flight", "t", r6("angle"), r6("distance", digits=4))


def _taps():
    return ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in op.derivative_taps(3, 1.5))


@query("M4_clean_line_mask", sql(f"SELECT flight, line, {s6('speed', 'speed', 4)}, {s6('turn')}, clean FROM res",
       tr="SELECT user_id AS flight, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS line, (event_id % 1000) * 10 + value AS x, (event_id % 777) * 10 + 0.0::DOUBLE AS y, value AS z FROM events",
       ln="SELECT flight, max(line) AS last FROM tr GROUP BY 1",
       vel=f"SELECT a.flight, a.line, sum(b.x * w) AS x, sum(b.y * w) AS y, sum(b.z * w) AS z FROM tr a JOIN ln USING (flight), (VALUES {_taps()}) k(o, w) JOIN tr b ON b.flight = a.flight AND b.line = least(greatest(a.line + o, 0), last) GROUP BY 1, 2",
       sp="SELECT *, sqrt(x * x + y * y + z * z) AS speed FROM vel",
       un="SELECT flight, line, speed, CASE WHEN speed > 0 THEN x / speed ELSE 0 END AS x, CASE WHEN speed > 0 THEN y / speed ELSE 0 END AS y, CASE WHEN speed > 0 THEN z / speed ELSE 0 END AS z FROM sp",
       rt="SELECT a.flight, a.line, a.speed, sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2) + pow(b.z - c.z, 2)) AS turn FROM un a JOIN ln USING (flight) JOIN un b ON b.flight = a.flight AND b.line = least(a.line + 1, last) JOIN un c ON c.flight = a.flight AND c.line = greatest(a.line - 1, 0)",
       rk="SELECT *, row_number() OVER (PARTITION BY flight ORDER BY speed) - 1 AS rs, row_number() OVER (PARTITION BY flight ORDER BY turn) - 1 AS rt, count(*) OVER (PARTITION BY flight) AS n FROM rt",
       md="SELECT flight, max(CASE WHEN rs = floor(0.5::DOUBLE * n) THEN speed END) AS ms, max(CASE WHEN rt = floor(0.5::DOUBLE * n) THEN turn END) AS mt FROM rk GROUP BY 1",
       ok="SELECT rt.*, abs(speed - ms) < 0.5 * ms AND turn <= mt + 0.5 * mt AS good FROM rt JOIN md USING (flight)",
       res="SELECT flight, line, speed, turn, bool_or(good) OVER (PARTITION BY flight ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS clean FROM ok"))
def _(spark, sf):
    from swathline.plans.ordered import with_row_index

    e = inp.table(spark, sf, "events").select(
        F.col("user_id").alias("flight"), inp._seconds("ts").alias("t"), ((F.col("event_id") % 1000) * 10 + F.col("value")).alias("x"),
        ((F.col("event_id") % 777) * 10).cast("double").alias("y"), F.col("value").alias("z"))
    track = with_row_index(e, ["flight"], "t", "line").drop("t")
    out = op.clean_line_mask(track, ["flight"])
    return out.select("flight", "line", r6("speed", digits=4), r6("turn"), "clean")


def _inflexion(relative, mask):
    m = "AND (a.line * 7 + a.sample) % 11 <> 0 AND (p.line * 7 + p.sample) % 11 <> 0 AND (n.line * 7 + n.sample) % 11 <> 0" if mask else ""
    ext = lambda c, a, b: f"CASE WHEN ({c} < {a} AND {c} < {b}) OR ({c} > {a} AND {c} > {b}) THEN 1 + 0.001 * least(abs({c} - {a}), abs({c} - {b})) ELSE 0 END"
    return dict(
        tri=f"SELECT a.line, a.sample, a.band, a.dn, p.dn AS pdn, n.dn AS ndn FROM px a JOIN px p ON p.line = a.line - 1 AND p.sample = a.sample AND p.band = a.band JOIN px n ON n.line = a.line + 1 AND n.sample = a.sample AND n.band = a.band {m}",
        ver=f"SELECT line, sum({ext('dn', 'pdn', 'ndn')}::DOUBLE) AS v FROM tri GROUP BY 1",
        hor=f"SELECT a.line, sum({ext('a.dn', 'l.dn', 'r.dn')}::DOUBLE) AS h FROM tri a JOIN px l ON l.line = a.line AND l.band = a.band AND l.sample = a.sample - 1 JOIN px r ON r.line = a.line AND r.band = a.band AND r.sample = a.sample + 1 GROUP BY 1",
        inf="SELECT line, v / greatest(1, coalesce(h, 0)) AS intensity FROM ver LEFT JOIN hor USING (line)" if relative else "SELECT line, v AS intensity FROM ver",
    )


@query("M5_inflexion_intensity", sql(f"SELECT line, {s6('intensity')} FROM inf", **_inflexion(True, True)))
def _(spark, sf):
    px = inp.pixels(spark, sf).withColumn("ok", (F.col("line") * 7 + F.col("sample")) % 11 != 0)
    return op.inflexion_intensity(px, "dns", mask="ok", magnitude_weight=0.001).select("line", r6("intensity"))


@query("M5_inflexion_absolute", sql(f"SELECT line, {s6('intensity', 'intensity', 5)} FROM inf", **_inflexion(False, False)))
def _(spark, sf):
    return op.inflexion_intensity(inp.pixels(spark, sf), "dns", magnitude_weight=0.001, relative=False).select("line", r6("intensity", digits=5))


def _event_signal(spark, sf):
    """Event values as a line signal per user."""
    from swathline.plans.ordered import with_row_index

    e = inp.table(spark, sf, "events").select(F.col("user_id").alias("seq"), inp._seconds("ts").alias("t"), F.col("value").alias("intensity"))
    return with_row_index(e, ["seq"], "t", "k").select("seq", (F.col("k") + 1).alias("line"), "intensity")


SIGNAL = "SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS line, value AS intensity FROM events"
PEAKS = "SELECT seq, line, intensity FROM (SELECT *, lag(intensity) OVER w AS p, lead(intensity) OVER w AS n FROM sig WINDOW w AS (PARTITION BY seq ORDER BY line)) WHERE intensity > 60 AND intensity > p AND intensity > n"


@query("M6_inflexion_peaks", sql(f"SELECT seq, line, {s6('intensity')} FROM pk", sig=SIGNAL, pk=PEAKS))
def _(spark, sf):
    return op.inflexion_peaks(_event_signal(spark, sf), ["seq"], 60.0).select("seq", "line", r6("intensity"))


@query("M6_select_lines_by_inflexion", "WITH RECURSIVE " + sql("SELECT * FROM allk a WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.seq = a.seq AND w.jump AND a.line > w.line AND a.line <= w.l2)",
       sig=SIGNAL, pk=PEAKS,
       nx="SELECT seq, line, row_number() OVER w AS k, lead(line) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM pk WINDOW w AS (PARTITION BY seq ORDER BY line)",
       jm="SELECT *, coalesce(l1 - line <= 9 AND l2 - l1 <= 9, false) AS jump FROM nx",
       walk="SELECT * FROM jm WHERE k = 1 UNION ALL SELECT j.* FROM walk w JOIN jm j ON j.seq = w.seq AND j.k = w.k + CASE WHEN w.jump THEN 3 ELSE 1 END",
       allk="SELECT seq, line FROM sig UNION ALL SELECT seq, unnest([0, max(line) + 1]) FROM sig GROUP BY seq")[5:])
def _(spark, sf):
    return op.select_lines_by_inflexion(_event_signal(spark, sf), "seq", 60.0, 9, slot=8)


@query("M7_drop_lines", sql("SELECT dense_rank() OVER (ORDER BY line) - 1 AS line, sample, band, dn FROM px WHERE line IN (SELECT line FROM c WHERE change < 4100)", c=CHANGE_JOIN.format(t="px")))
def _(spark, sf):
    px = inp.pixels(spark, sf).withColumn("seq", F.lit(0))
    selected = op.line_change_signal(px, "dns", ["seq"]).where("change < 4100").select("seq", "line")
    return inp.to_long(op.drop_lines(px, selected, ["seq"]), "dns", "dn").select("line", "sample", "band", "dn")
