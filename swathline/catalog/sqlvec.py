"""Rotation algebra as SQL text for the DuckDB side."""

from __future__ import annotations

A, F_, = "6378137.0::DOUBLE", "(1 / 298.257223563::DOUBLE)"
E2 = f"({F_} * (2 - {F_}))"


def n(name: str, k: int = 3) -> list[str]:
    return [f"{name}{i}" for i in range(k)]


def cols(name: str, exprs: list[str]) -> str:
    return ", ".join(f"{e} AS {name}{i}" for i, e in enumerate(exprs))


def rnd(name: str, out: str, digits: int = 6, k: int = 3) -> str:
    return ", ".join(f"round({name}{i}, {digits}) + 0.0::DOUBLE AS {out}_{i}" for i in range(k))


def rod(r: list[str]) -> list[str]:
    x, y, z = r
    th = f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
    a = f"(CASE WHEN {th} < 1e-8 THEN 1 ELSE sin({th}) / {th} END)"
    b = f"(CASE WHEN {th} < 1e-8 THEN 0.5::DOUBLE ELSE (1 - cos({th})) / ({th} * {th}) END)"
    return [
        f"1 - {b} * ({y} * {y} + {z} * {z})", f"{b} * {x} * {y} - {a} * {z}", f"{b} * {x} * {z} + {a} * {y}",
        f"{b} * {x} * {y} + {a} * {z}", f"1 - {b} * ({x} * {x} + {z} * {z})", f"{b} * {y} * {z} - {a} * {x}",
        f"{b} * {x} * {z} - {a} * {y}", f"{b} * {y} * {z} + {a} * {x}", f"1 - {b} * ({x} * {x} + {y} * {y})",
    ]


def quat(m: list[str]) -> list[str]:
    g = lambda a, b, c, d: f"CASE WHEN {m[0]} + {m[4]} + {m[8]} > 0 THEN {a} WHEN {m[0]} >= {m[4]} AND {m[0]} >= {m[8]} THEN {b} WHEN {m[4]} >= {m[8]} THEN {c} ELSE {d} END"
    return [
        g(f"1 + {m[0]} + {m[4]} + {m[8]}", f"{m[7]} - {m[5]}", f"{m[2]} - {m[6]}", f"{m[3]} - {m[1]}"),
        g(f"{m[7]} - {m[5]}", f"1 + {m[0]} - {m[4]} - {m[8]}", f"{m[1]} + {m[3]}", f"{m[2]} + {m[6]}"),
        g(f"{m[2]} - {m[6]}", f"{m[1]} + {m[3]}", f"1 - {m[0]} + {m[4]} - {m[8]}", f"{m[5]} + {m[7]}"),
        g(f"{m[3]} - {m[1]}", f"{m[2]} + {m[6]}", f"{m[5]} + {m[7]}", f"1 - {m[0]} - {m[4]} + {m[8]}"),
    ]


def axis(q: list[str]) -> list[str]:
    s = f"(CASE WHEN {q[0]} < 0 THEN -1 ELSE 1 END)"
    length = f"sqrt({q[1]} * {q[1]} + {q[2]} * {q[2]} + {q[3]} * {q[3]})"
    w = f"({q[0]} * {s})"
    f = f"(CASE WHEN {length} < 1e-8 * {w} THEN 2 / {w} ELSE 2 * atan2({length}, {w}) / {length} END)"
    return [f"{q[k]} * {s} * {f}" for k in (1, 2, 3)]


def tr(m: list[str]) -> list[str]:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def mm(a: list[str], b: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{a[3 * r + k]} * {b[3 * k + c]}" for k in range(3)) + ")" for r in range(3) for c in range(3)]


def mv(m: list[str], v: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{m[3 * r + k]} * {v[k]}" for k in range(3)) + ")" for r in range(3)]


def cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def rx(a): return ["1", "0", "0", "0", f"cos({a})", f"(-sin({a}))", "0", f"sin({a})", f"cos({a})"]
def ry(a): return [f"cos({a})", "0", f"sin({a})", "0", "1", "0", f"(-sin({a}))", "0", f"cos({a})"]
def rz(a): return [f"cos({a})", f"(-sin({a}))", "0", f"sin({a})", f"cos({a})", "0", "0", "0", "1"]


def ecef(lat: str, lon: str, h: str) -> list[str]:
    nn = f"({A} / sqrt(1 - {E2} * pow(sin(radians({lat})), 2)))"
    return [f"(({nn} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({nn} + {h}) * cos(radians({lat})) * sin(radians({lon})))",
            f"(({nn} * (1 - {E2}) + {h}) * sin(radians({lat})))"]


def frame(kind: str, lat: str, lon: str) -> list[str]:
    """ECEF-to-local rotation written out for each convention."""
    sp, cp, sl, cl = f"sin(radians({lat}))", f"cos(radians({lat}))", f"sin(radians({lon}))", f"cos(radians({lon}))"
    e = [f"(-{sl})", cl, "0"]
    nn = [f"(-{sp} * {cl})", f"(-{sp} * {sl})", cp]
    u = [f"({cp} * {cl})", f"({cp} * {sl})", sp]
    neg = lambda v: [f"(-{x})" for x in v]
    return {"enu": [*e, *nn, *u], "nwu": [*nn, *neg(e), *u], "ned": [*nn, *e, *neg(u)]}[kind]


def ecef_poses(source: str = "poses") -> dict[str, str]:
    """CTEs ending in ``ep``: flight, t, r0..2, p0..2."""
    rot = mm(tr(frame("ned", "lat", "lon")), n("a", 9))
    return {
        "ea": f"SELECT *, {cols('a', mm(mm(rz('yaw'), ry('pitch')), rx('(-roll)')))} FROM {source}",
        "em": f"SELECT flight, t, {cols('p', ecef('lat', 'lon', 'height'))}, {cols('m', rot)} FROM ea",
        "eq": f"SELECT *, {cols('q', quat(n('m', 9)))} FROM em",
        "ep": f"SELECT flight, t, {cols('r', axis(n('q', 4)))}, p0, p1, p2 FROM eq",
    }


def bracket(queries: str, poses: str = "ep", keys: str = "flight", t: str = "t") -> str:
    """Two as-of joins: q.*, lower a0.., s0.., upper b0.., e0.., weight w."""
    fields = lambda x, r, p: ", ".join(f"{x}.r{k} AS {r}{k}, {x}.p{k} AS {p}{k}" for k in range(3))
    return f"""SELECT q.{keys}, q.{t}, {fields('l', 'a', 's')}, {fields('u', 'b', 'e')}, l.{t} AS lt, u.{t} AS ut,
        CASE WHEN u.{t} > l.{t} THEN (q.{t} - l.{t}) / (u.{t} - l.{t}) WHEN u.{t} = l.{t} THEN 0 END AS w
        FROM (SELECT DISTINCT {keys}, {t} FROM {queries}) q
        ASOF LEFT JOIN {poses} l ON q.{keys} = l.{keys} AND q.{t} >= l.{t}
        ASOF LEFT JOIN {poses} u ON q.{keys} = u.{keys} AND q.{t} <= u.{t}"""


def manifold(source: str = "br", extra: str = "") -> dict[str, str]:
    """CTEs ending in ``pt``: flight, t, r0.., p0.. blended on the rotation group."""
    return {
        "c1": f"SELECT *, {cols('m', rod(n('a')))}, {cols('o', rod(n('b')))} FROM {source}",
        "c2": f"SELECT *, {cols('x', mm(tr(n('m', 9)), n('o', 9)))} FROM c1",
        "c3": f"SELECT *, {cols('q', quat(n('x', 9)))} FROM c2",
        "c4": f"SELECT *, {cols('d', [f'w * ({c})' for c in axis(n('q', 4))])} FROM c3",
        "c5": f"SELECT *, {cols('y', rod(n('d')))} FROM c4",
        "c6": f"SELECT *, {cols('z', mm(n('m', 9), n('y', 9)))} FROM c5",
        "c7": f"SELECT *, {cols('g', quat(n('z', 9)))} FROM c6",
        "pt": f"SELECT flight, t, w, lt, ut {extra}, {cols('r', [f'CASE WHEN w IS NOT NULL THEN {c} END' for c in axis(n('g', 4))])}, "
              f"{cols('p', [f'(1 - w) * s{k} + w * e{k}' for k in range(3)])}, {cols('k', n('z', 9))} FROM c7",
    }
