"""DuckDB text of the derived input tables, independent of the Spark code in ``plans.inputs``."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "emb": "SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS band FROM embeddings",
    "px": """SELECT (vec_id // 200)::BIGINT AS file_id, (vec_id // 20)::BIGINT AS line, (vec_id % 20)::BIGINT AS sample,
             band::BIGINT AS band, v, floor((v + 1) * 20000)::BIGINT AS dn FROM emb""",
    "big": """SELECT line, sample, unnest([0, 1, 2, 3])::BIGINT AS band, unnest([b0, b1, b2, b3])::BIGINT AS dn FROM (
             SELECT l_orderkey AS line, (l_linenumber - 1)::BIGINT AS sample, max(l_quantity::BIGINT) AS b0,
             max(round(l_extendedprice * 100)::BIGINT) AS b1, max(round(l_discount * 100)::BIGINT) AS b2,
             max(round(l_tax * 100)::BIGINT) AS b3 FROM lineitem GROUP BY 1, 2)""",
    "dark": """SELECT sample, band, greatest(0, trunc(sum(dn - 15000)::DOUBLE / count(*)))::BIGINT AS d
             FROM px WHERE file_id = 0 GROUP BY 1, 2""",
    "poses": """SELECT user_id AS flight, event_id AS n, epoch_us(ts) / 1e6 AS t, (event_id % 41 - 20) / 100 AS roll,
             (event_id % 37 - 18) / 100 AS pitch, (event_id % 629 - 314) / 100 AS yaw,
             6 + (event_id % 777) / 1e4 AS lon, 46 + (event_id % 1000) / 1e4 AS lat, 400 + value AS height
             FROM events WHERE event_type <> 'view'""",
    "scan": """SELECT user_id AS flight, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS line,
             epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'view'""",
    "headers": """SELECT 'run/seq-' || n_nationkey || '/frame.bil' AS path, n_regionkey::BIGINT AS seq,
             n_nationkey::BIGINT AS file_no, CASE WHEN n_nationkey <> 13 THEN 100 + 7 * n_nationkey END::BIGINT AS lines,
             20::BIGINT AS samples, 64::BIGINT AS bands, (10 + n_nationkey % 5)::DOUBLE AS framerate,
             CASE WHEN n_nationkey % 3 <> 0 THEN 40000 END::BIGINT AS ceiling FROM nation""",
    "dtm": """SELECT p_partkey // 50 AS i, p_partkey % 50 AS j,
             CASE WHEN p_partkey % 97 <> 0 THEN p_retailprice END AS z FROM part""",
    "grid": "SELECT DISTINCT file_id, line, sample FROM px",
    "proj": """SELECT file_id, line, sample,
             CASE WHEN (line * 20 + sample) % 53 <> 0 THEN line * 0.73::DOUBLE + sample * 0.11::DOUBLE END AS pi,
             CASE WHEN (line * 20 + sample) % 53 <> 0 THEN sample * 0.87::DOUBLE + line * 0.05::DOUBLE END AS pj FROM grid""",
    "obs": """SELECT o_orderkey % 8 AS seq, o_orderkey AS obs_id, o_custkey AS lm_id,
             ((o_orderkey * 7919) % 2000) / 100 AS x, ((o_orderkey * 104729) % 2400) / 100 AS y,
             o_orderstatus <> 'P' AS enabled FROM orders""",
    "lms": """SELECT c_custkey AS lm_id, (c_custkey % 97) / 10 AS x, (c_custkey % 89) / 10 AS y,
             (10 + c_nationkey)::DOUBLE AS z, c_acctbal > 0 AS is_set FROM customer""",
    "bils": "SELECT r_regionkey::BIGINT AS bil_id FROM region",
    "chunks": "SELECT s_suppkey AS chunk_id, (s_nationkey % 5)::BIGINT AS bil_id FROM supplier",
    "matches": """SELECT l_suppkey AS c1, l_partkey % (SELECT count(*) FROM supplier) AS c2,
             l_quantity::BIGINT % 20 AS x1, l_linenumber::BIGINT AS y1, l_partkey % 20 AS x2, l_orderkey % 24 AS y2,
             l_returnflag = 'N' AS ok FROM lineitem""",
    "shifts": """SELECT line, ((line * 37) % 7 - 3) / 2 AS dx FROM (SELECT DISTINCT line FROM px)
             WHERE line < (SELECT max(line) FROM px)""",
    "lp": """SELECT DISTINCT file_id, line, (line % 7 - 3) / 100 AS r0, (line % 5 - 2) / 100 AS r1, (line % 3 - 1) / 100 AS r2,
             5 + line * 0.4::DOUBLE AS p0, 25 + line % 4 * 0.1::DOUBLE AS p1, 160::DOUBLE AS p2 FROM px""",
    "clock": """SELECT event_id AS line, event_id * 465 AS clock, event_type = 'error' AS flag, event_id * 1000 AS tow,
             event_id * 465 - event_id % 200 AS pps FROM events""",
    "wl": """SELECT band, 380 + 2110 * band::DOUBLE / (n - 1) AS wl FROM (SELECT DISTINCT band FROM px),
             (SELECT max(band) + 1 AS n FROM px)""",
}


def sql(body: str, **extra: str) -> str:
    """Prefix ``body`` (a SELECT) with the fixture CTEs it needs; ``extra`` adds named CTEs in order."""
    order = list(CTES)
    needed: set[str] = set()

    def visit(text: str, names: list[str]) -> None:
        for name in names:
            if name not in extra and name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name], order[: order.index(name)])  # a table uses only tables listed before it

    for text in [*extra.values(), body]:
        visit(text, order)
    parts = [f"{n} AS ({CTES[n]})" for n in order if n in needed] + [f"{n} AS ({t})" for n, t in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r6(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name or expr}"
