"""Ordered operations (previous row, running sum, as-of lookup) that never put a whole key into one task.

A plain ``Window.partitionBy(flight).orderBy(t)`` sends every row of a flight to one task. Here a key is cut
into *slots* of fixed width on the order column (some minutes of time, some thousand lines). Windows run per slot,
one summary row per slot carries state across slot borders, and the summary is joined back on the slot key, which is
also the window key, so the big side is not shuffled again. A slot is a function of the row alone: no statistics pass,
and a recomputed task gets the same slots.

The summary may be as long as the data, if the unit of the order column makes slots narrow. So it is treated in the same
way: slots are gathered in wider ones, ``FAN`` at a time, and those again, before a window takes what is left of a key.

Sensors bound the rows per slot (a rate in Hz times the width), and copies of one order value are reduced before the
window where an operator allows copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 600.0
SLOT_LINES = 4096
SLOT = ["_s"]
GROUP = "_g"


def _group(keys: list[str], slot: str) -> Column:
    """Key and slot as one value that is never NULL: windows and joins on it share one partitioning, and null keys meet."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(slot).alias("s"))


def with_slots(df: DataFrame, keys: list[str], order: str, width: float) -> DataFrame:
    slotted = df.withColumn("_s", F.floor(F.col(order) / width))
    return slotted.withColumn(GROUP, _group(keys, "_s"))


def _slot_window(*order: Column | str) -> Window:
    return Window.partitionBy(GROUP).orderBy(*order)


FAN = 1 << 14
LEVELS = 1
"""One level holds 16,384 slots in a window and leaves a key one row per 16,384 slots for the last: with slots of ten minutes a row
per 113 days, with slots of 4096 lines a row per 67 million lines. Narrower slots may ask for more."""


def _combined(kind: str, near: Column, far: Column) -> Column:
    if kind == "sum":
        return F.when(near.isNull(), far).when(far.isNull(), near).otherwise(near + far)
    return F.coalesce(near, far)


def _carried(summary: DataFrame, keys: list[str], specs: list[tuple[str, str, str]], levels: int = LEVELS) -> DataFrame:
    """Slot table with what comes from other slots of the key: keys, slot and a column per spec (value, kind, name).

    ``sum`` adds the values of all earlier slots, ``last`` takes the nearest earlier one that is not NULL, ``next`` the
    nearest later one. A window holds ``FAN`` slots at most, but for the last level: the rows of a key there are its
    slots divided by ``FAN ** levels``.
    """
    df = summary.select(*keys, "_s", *dict.fromkeys(v for v, _, _ in specs))
    if levels:
        df = df.withColumn("_w", F.floor(F.col("_s") / FAN))
        df = df.withColumn("_h", _group(keys, "_w"))
    group = ["_h"] if levels else keys

    def over(value: str, kind: str) -> Column:
        order = F.col("_s").desc() if kind == "next" else F.col("_s").asc()
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return (F.sum(value) if kind == "sum" else F.last(value, ignorenulls=True)).over(w)

    local = df.select(*keys, "_s", *(["_h"] if levels else []), *[over(v, k).alias(n) for v, k, n in specs])
    if levels == 0:
        return local

    def whole(value: str, kind: str) -> Column:
        if kind == "sum":
            return F.sum(value)
        at = F.when(F.col(value).isNotNull(), F.col("_s"))
        return F.max_by(value, at) if kind == "last" else F.min_by(value, at)

    up = df.groupBy(*keys, F.col("_w").alias("_g")).agg(*[whole(v, k).alias(f"_u{levels}_{i}") for i, (v, k, _) in enumerate(specs)])
    up = _carried(up.withColumnRenamed("_g", "_s"), keys, [(f"_u{levels}_{i}", k, f"_f{levels}_{i}") for i, (_, k, _) in enumerate(specs)], levels - 1)
    up = up.select(_group(keys, "_s").alias("_r_h"), *[f"_f{levels}_{i}" for i in range(len(specs))])
    both = local.join(up, F.col("_h") == F.col("_r_h"), "left")
    return both.select(*keys, "_s", *[_combined(k, F.col(n), F.col(f"_f{levels}_{i}")).alias(n) for i, (_, k, n) in enumerate(specs)])


def _join_slots(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    renamed = summary.select(_group(keys, "_s").alias("_r_g"), *[c for c in summary.columns if c not in (*keys, *SLOT)])
    return df.join(renamed, F.col(GROUP) == F.col("_r_g"), "left").drop("_r_g", GROUP)


def with_previous(
    df: DataFrame, keys: list[str], order: str, cols: list[str], name: str = "prev", width: float = SLOT_SECONDS,
    following: bool = False,
) -> DataFrame:
    """Add struct ``name`` holding ``cols`` of the previous (or following) row of the same key."""
    slotted = with_slots(df, keys, order, width)
    here = F.struct(*cols)
    edge = F.min_by(here, order) if following else F.max_by(here, order)
    summary = slotted.groupBy(*keys, *SLOT).agg(edge.alias("_edge"))
    summary = _carried(summary, keys, [("_edge", "next" if following else "last", "_carry")])
    step = F.lead if following else F.lag
    local = slotted.withColumn("_near", step(here).over(_slot_window(order)))
    out = _join_slots(local, summary, keys)
    return out.withColumn(name, F.coalesce("_near", "_carry")).drop("_near", "_carry", *SLOT)


def with_running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: float = SLOT_SECONDS,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over all rows of the key up to this row (or before it)."""
    slotted = with_slots(df.withColumn("_v", value), keys, order, width)
    summary = slotted.groupBy(*keys, *SLOT).agg(F.sum("_v").alias("_sum"))
    summary = _carried(summary, keys, [("_sum", "sum", "_before")])
    frame = _slot_window(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = slotted.withColumn("_run", F.sum("_v").over(frame))
    zero = F.lit(0).cast(slotted.schema["_v"].dataType)
    out = _join_slots(local, summary, keys)
    total = F.coalesce("_run", zero) + F.coalesce("_before", zero)
    return out.withColumn(name, total).drop("_v", "_run", "_before", *SLOT)


def with_row_index(df: DataFrame, keys: list[str], order: str, name: str, width: float = SLOT_SECONDS) -> DataFrame:
    """Add ``name`` = 0-based position of the row in the key by ``order`` (order values distinct)."""
    slotted = with_slots(df, keys, order, width)
    summary = slotted.groupBy(*keys, *SLOT).agg(F.count(F.lit(1)).alias("_n"))
    summary = _carried(summary, keys, [("_n", "sum", "_before")])
    local = slotted.withColumn("_rn", F.row_number().over(_slot_window(order)))
    out = _join_slots(local, summary, keys)
    return out.withColumn(name, F.col("_rn") - 1 + F.coalesce("_before", F.lit(0))).drop("_rn", "_before", *SLOT)


def asof_bracket(
    poses: DataFrame, queries: DataFrame, keys: list[str], order: str, cols: list[str], width: float = SLOT_SECONDS,
) -> DataFrame:
    """For each distinct (key, order) of ``queries``: structs ``lower`` (last pose at or before) and ``upper``
    (first pose at or after), NULL where there is none; both hold ``order`` and ``cols``.

    Copies are reduced first (partial aggregation), so a timestamp repeated many times costs one row.
    """
    known = poses.groupBy(*keys, order).agg(F.min(F.struct(*cols)).alias("_p"))
    known = known.select(*keys, order, F.struct(F.col(order), *[F.col(f"_p.{c}").alias(c) for c in cols]).alias("_p"))
    asked = queries.where(F.col(order).isNotNull()).select(*keys, order).distinct()
    both = known.withColumn("_ask", F.lit(False)).unionByName(
        asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True
    )
    slotted = with_slots(both, keys, order, width)
    summary = slotted.groupBy(*keys, *SLOT).agg(
        F.max_by("_p", F.when(~F.col("_ask"), F.col(order))).alias("_last"),
        F.min_by("_p", F.when(~F.col("_ask"), F.col(order))).alias("_first"),
    )
    summary = _carried(summary, keys, [("_last", "last", "_below"), ("_first", "next", "_above")])
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = _slot_window(F.col(order).asc(), F.col("_ask").asc()).rowsBetween(*so_far)
    down = _slot_window(F.col(order).desc(), F.col("_ask").asc()).rowsBetween(*so_far)
    local = slotted.select(
        *keys, *SLOT, GROUP, order, "_ask",
        F.last("_p", ignorenulls=True).over(up).alias("_lo"),
        F.last("_p", ignorenulls=True).over(down).alias("_up"),
    ).where("_ask")
    out = _join_slots(local, summary, keys)
    return out.select(
        *keys, order, F.coalesce("_lo", "_below").alias("lower"), F.coalesce("_up", "_above").alias("upper")
    )
