"""Operators along the time of a target: as-of alignment, sessions, periods.

Histories of targets differ widely in length, so every window here is partitioned by target and time
slice. A slice also gets the rows that its edges may need where a tolerance or gap bounds them; otherwise
what a row needs of earlier slices (`previous`, `running`, `carried`) comes from one pre-aggregated row a
slice. No frame slides: each grows from the start of its slice, so that a slice costs its rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalar import local_offset, position_at_offset


def _slices(df: DataFrame, t: str, width: int, before: int, after: int) -> DataFrame:
    """A copy of each row for every slice from that of t - before to that of t + after."""
    slot = lambda c: F.floor(c / width)
    return df.withColumn("slice", F.explode(F.sequence(slot(F.col(t) - before), slot(F.col(t) + after))))


def _sliced(df: DataFrame, key: list[str], t: str, width: int, tie: list[str]):
    """With the slice of each row; one that a step before left there is kept, so that rows stay where they are."""
    rows = df if "_s" in df.columns else df.withColumn("_s", F.floor(F.col(t) / width))
    return rows, Window.partitionBy(*key, "_s").orderBy(t, *tie)


def _with_edges(rows: DataFrame, key: list[str], t: str, tie: list[str], edge: Column, carry) -> DataFrame:
    """Adds _carry: carry(column, window over the slices of a key before) of one aggregated value a slice."""
    edges = rows.groupBy(*key, "_s").agg(edge.alias("_e"))
    earlier = Window.partitionBy(*key).orderBy("_s")
    edges = edges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_s").alias("_es"), carry(F.col("_e"), earlier).alias("_carry"))
    on = F.col("_s") == F.col("_es")
    for i, k in enumerate(key):
        on &= F.col(k) == F.col(f"_k{i}")
    return rows.join(edges, on, "left").drop("_es", *(f"_k{i}" for i in range(len(key))))


def previous(df: DataFrame, key: list[str], t: str, columns: list[str], width: int, tie: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Adds prev, a struct of the columns of the row before in the order of t and tie; null for the first of a key.

    With keep, the slice stays as column _s for a next step along the same key, t and width.
    """
    tie = tie or []
    rows, w = _sliced(df, key, t, width, tie)
    own = F.struct(*columns)
    rows = rows.withColumn("prev", F.lag(own).over(w))
    rows = _with_edges(rows, key, t, tie, F.max_by(own, F.struct(t, *tie)), lambda e, before: F.lag(e).over(before))
    return rows.withColumn("prev", F.coalesce("prev", "_carry")).drop("_carry", *([] if keep else ["_s"]))


def running(df: DataFrame, key: list[str], t: str, value: str, name: str, width: int, tie: list[str] | None = None) -> DataFrame:
    """Adds the sum of value from the first row of a key up to this one and those of equal t and tie."""
    rows, w = _sliced(df, key, t, width, tie or [])
    rows = rows.withColumn("_in", F.sum(value).over(w))
    rows = _with_edges(rows, key, t, tie or [], F.sum(value), lambda e, before: F.sum(e).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn(name, F.coalesce("_in", F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_in", "_carry", "_s")


def previous_and_running(df: DataFrame, key: list[str], t: str, columns: list[str], value: str, name: str, width: int, tie: list[str]) -> DataFrame:
    """What previous and running add, in one pass: prev and the sum of value up to this row."""
    rows, w = _sliced(df, key, t, width, tie)
    own = F.struct(*columns)
    rows = rows.withColumn("prev", F.lag(own).over(w)).withColumn("_in", F.sum(value).over(w))
    edge = F.struct(F.max_by(own, F.struct(t, *tie)).alias("last"), F.sum(value).alias("sum"))
    rows = _with_edges(rows, key, t, tie, edge, lambda e, before: F.struct(F.lag(e["last"]).over(before).alias("last"), F.sum(e["sum"]).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("sum")))
    return rows.withColumn("prev", F.coalesce("prev", "_carry.last")).withColumn(name, F.coalesce("_in", F.lit(0)) + F.coalesce("_carry.sum", F.lit(0))).drop("_in", "_carry", "_s")


def carried(df: DataFrame, key: list[str], t: str, value: str, width: int, tie: list[str] | None = None) -> DataFrame:
    """Replaces value by the last one that isn't null, up to this row."""
    tie = tie or []
    rows, w = _sliced(df, key, t, width, tie)
    some = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(t, *tie)))
    rows = rows.withColumn("_last", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _with_edges(rows, key, t, tie, some, lambda e, before: F.last(e, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn(value, F.coalesce("_last", "_carry")).drop("_last", "_carry", "_s")


#: Width of a slice in units of t where none is given: eight days in microseconds, 700,000 rows of a report a second.
WIDTH = 192 * 3_600_000_000


def asof_neighbours(tst: DataFrame, ref: DataFrame, key: str, t: str, carry: list[str], reach: int, width: int | None = None) -> DataFrame:
    """Each test row with its reference neighbours at most `reach` away.

    Adds lo and hi, structs of t and the carried columns: on an exact hit both are the row hit, otherwise
    the last before and the first after. matched: an exact hit, or both sides there; nothing is
    extrapolated. Of reference rows with one time the smallest counts.
    """
    width = width or max(8 * reach, 1)
    point = F.struct(F.col(t).alias("t"), *(F.col(c) for c in carry))
    left = tst.withColumn("slice", F.floor(F.col(t) / width)).withColumn("_r", F.lit(None).cast(ref.select(point.alias("p")).schema["p"].dataType))
    right = _slices(ref.groupBy(key, t).agg(F.min(point).alias("_r")), t, width, reach, reach)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_ref", F.col("_r").isNotNull())
    # two growing frames, one along time and one against it; what lies beyond the reach is dropped after
    w = Window.partitionBy(key, "slice")
    past, future = (w.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col(t).asc(), F.col(t).desc()))
    both = both.withColumn("lo", F.last("_r", ignorenulls=True).over(past)).withColumn("hi", F.last("_r", ignorenulls=True).over(future))
    out = both.where("not _ref").drop("_ref", "_r", "slice")
    out = out.withColumn("lo", F.when(F.col(t) - F.col("lo.t") <= reach, F.col("lo"))).withColumn("hi", F.when(F.col("hi.t") - F.col(t) <= reach, F.col("hi")))
    return out.withColumn("exact", F.coalesce(F.col("lo.t") == F.col(t), F.lit(False))).withColumn("matched", F.col("lo").isNotNull() & F.col("hi").isNotNull())


def neighbour_flag(column: str) -> Column:
    """A flag such as the ground bit: the row before's only if it is set, else the row after's."""
    return F.when(F.coalesce(F.col(f"lo.{column}"), F.lit(False)), True).otherwise(F.col(f"hi.{column}"))


def nearest_at(points: DataFrame, times: DataFrame, key: str, t: str, columns: list[str], reach: int) -> DataFrame:
    """The index among a key's points and the columns of the last point at or before each time, within reach."""
    rows = running(points.withColumn("_one", F.lit(1)), [key], t, "_one", "index", WIDTH).drop("_one")
    near = asof_neighbours(times, rows, key, t, [*columns, "index"], reach)
    return near.select(*times.columns, F.col("lo.index").alias("index"), *(F.col(f"lo.{c}").alias(c) for c in columns))


def positions_between(points: DataFrame, spans: DataFrame, key: str, t: str, width: int = WIDTH) -> DataFrame:
    """The points of each span (key, begin, end) of their key, its bounds included; one row for each span and point."""
    s = _over_slices(spans.select(F.col(key).alias("_k"), "begin", "end"), "begin", "end", width)
    rows = points.withColumn("_slot", F.floor(F.col(t) / width))
    found = rows.join(s, (F.col(key) == F.col("_k")) & (rows["_slot"] == s["_slice"]) & F.col(t).between(F.col("begin"), F.col("end")))
    return found.select(*points.columns, "begin", "end")


def _over_slices(spans: DataFrame, begin: str, end: str, width: int) -> DataFrame:
    """A copy of each span for every slice that it touches, so that it meets rows by an equi-join."""
    return spans.withColumn("_slice", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))


def mark_periods(df: DataFrame, found: DataFrame, key: str, t: str, width: int = WIDTH) -> DataFrame:
    """Adds period, a struct of the begin and end of the period of its key in which each row lies, else null.

    Periods of a key don't overlap, so that the last one to begin is the only candidate.
    """
    p = F.struct(F.col("period_begin").alias("begin"), F.col("period_end").alias("end"))
    starts = found.select(key, F.col("period_begin").alias(t), p.alias("period"), F.lit(0).alias("_kind"))
    both = df.withColumn("_kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    rows = carried(both, [key], t, "period", width, ["_kind"]).where("_kind = 1").drop("_kind")
    return rows.withColumn("period", F.when(F.col(t) <= F.col("period.end"), F.col("period")))


def interpolate(column: str, t: str) -> Column:
    """Linear between lo and hi; the value of lo on an exact hit; the one that is known if one is null."""
    share = (F.col(t) - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))
    between = F.col(f"lo.{column}") + (F.col(f"hi.{column}") - F.col(f"lo.{column}")) * share
    value = F.when(F.col("exact"), F.col(f"lo.{column}")).otherwise(F.coalesce(between, f"lo.{column}", f"hi.{column}"))
    return F.when(F.col("matched"), value)


def interpolate_angle(column: str, t: str) -> Column:
    """Along the smaller turn from lo to hi, in degrees (decision Q11)."""
    share = (F.col(t) - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))
    half = F.col(f"hi.{column}") - F.col(f"lo.{column}") + 180.0
    # not pmod: it takes what is a rounding error below zero to 0 instead of 360, which is the turn to the other side
    turn = half - 360.0 * F.floor(half / 360.0) - 180.0
    return F.when(F.col("matched"), F.when(F.col("exact"), F.col(f"lo.{column}")).otherwise(F.pmod(F.col(f"lo.{column}") + turn * share, F.lit(360.0))))


def interpolated_position(df: DataFrame, t: str, lat: str, lon: str, height: str, speed: str | None = None) -> DataFrame:
    """Adds ref, a struct of lat, lon, height and, if asked for, speed, to rows with lo and hi (`asof_neighbours`).

    The way from lo to hi is gone evenly in the tangent plane at lo. A height that only one side has holds
    for both. If both sides are at the same position, lo is taken as it is, and it has no speed; on an
    exact hit the report hit is, with its speed. Null without a position on either side.
    """
    part = lambda side, c: F.col(f"{side}.{c}")
    share = F.when(F.col("exact"), 0.0).otherwise((F.col(t) - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t")))
    same = (part("lo", lat) == part("hi", lat)) & (part("lo", lon) == part("hi", lon))
    moved = position_at_offset(part("lo", lat), part("lo", lon), *(x * share for x in local_offset(*(part(side, c) for side in ("lo", "hi") for c in (lat, lon)))))
    at = [F.when(same, part("lo", c)).otherwise(m).alias(c) for c, m in zip((lat, lon), moved, strict=True)]
    up = F.coalesce(part("lo", height) + (part("hi", height) - part("lo", height)) * share, part("lo", height), part("hi", height))
    out = [*at, F.when(same, part("lo", height)).otherwise(up).alias(height)]
    if speed:
        both = part("lo", speed) + (part("hi", speed) - part("lo", speed)) * share
        out.append(F.when(F.col("exact"), part("lo", speed)).when(~same, both).alias(speed))
    there = F.col("matched") & same.isNotNull()
    return df.withColumn("ref", F.when(there, F.struct(*out)))


def compare_status(value: str, reference: str, tolerance: float = 0.0, found: Column | None = None) -> Column:
    """The outcomes of a value against the lower, then the upper neighbour.

    no_ref_pos: the reference itself isn't there (not `found`); no_ref_val: it is, without this value on
    either side; then no_tst, same or different.
    """
    lo, hi = F.col(f"lo.{reference}"), F.col(f"hi.{reference}")
    near = lambda r: F.coalesce(F.abs(F.col(value) - r) <= tolerance, F.lit(False)) if tolerance else F.coalesce(F.col(value) == r, F.lit(False))
    status = F.when(lo.isNull() & hi.isNull(), "no_ref_val").when(F.col(value).isNull(), "no_tst").when(near(lo) | near(hi), "same").otherwise("different")
    return status if found is None else F.when(~found, "no_ref_pos").otherwise(status)


def fill_nearest(df: DataFrame, key: str, t: str, column: str, within: int, trusted: str | None = None) -> DataFrame:
    """Nulls from known values less than `within` before and after: linear, or the one that is there.

    A trusted value of a report, where it has one, goes before its own for filling others and itself.
    """
    known = F.col(column) if trusted is None else F.coalesce(trusted, column)
    known = df.select(key, t, known.alias("_v")).where("_v is not null")
    near = asof_neighbours(df, known, key, t, ["_v"], within - 1)
    share = (F.col(t) - F.col("lo.t")) / F.when(F.col("hi.t") > F.col("lo.t"), F.col("hi.t") - F.col("lo.t")).otherwise(1)
    linear = F.col("lo._v") + (F.col("hi._v") - F.col("lo._v")) * share
    return near.withColumn(column, F.coalesce(column, linear, "lo._v", "hi._v")).drop("lo", "hi", "exact", "matched")


def gap_sessions(df: DataFrame, key: str, t: str, gap: int, width: int | None = None) -> DataFrame:
    """Adds session, counted from 1 for each key: a new one starts after a gap longer than `gap`."""
    width = width or max(8 * gap, 1)
    rows = previous(df, [key], t, [t], width, keep=True)
    rows = rows.withColumn("_new", F.when(F.col(f"prev.{t}").isNull() | (F.col(t) - F.col(f"prev.{t}") > gap), 1).otherwise(0))
    return running(rows, [key], t, "_new", "session", width).withColumn("session", F.col("session").cast("long")).select(*df.columns, "session")


def periods(df: DataFrame, key: str, t: str, inside: Column, gap: int, least: int = 0, width: int | None = None) -> DataFrame:
    """Stretches of consecutive inside rows without a gap above `gap`: key, period_begin, period_end.

    Periods shorter than `least` are left out. A row outside ends a period. Of rows with one time, those
    inside come first.
    """
    width = width or max(8 * gap, 1)
    rows = df.withColumn("_ok", F.coalesce(inside, F.lit(False))).withColumn("_out", ~F.col("_ok"))
    rows = previous(rows, [key], t, [t, "_ok"], width, ["_out"], keep=True)
    starts = F.col("_ok") & (~F.coalesce(F.col("prev._ok"), F.lit(False)) | (F.col(t) - F.col(f"prev.{t}") > gap))
    rows = running(rows.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int")), [key], t, "_start", "_p", width, ["_out"]).where("_ok")
    out = rows.groupBy(key, "_p").agg(F.min(t).alias("period_begin"), F.max(t).alias("period_end"))
    return out.where(F.col("period_end") - F.col("period_begin") >= least).drop("_p")


def update_intervals(found: DataFrame, key: str, interval: int) -> DataFrame:
    """Sum of the whole update intervals of the periods of each key."""
    return found.groupBy(key).agg(F.sum(F.floor((F.col("period_end") - F.col("period_begin")) / interval)).cast("long").alias("sum_uis"), F.count("*").alias("n_periods"))


def outside_periods(found: DataFrame, spans: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """What the periods leave of each key's span (key, first, last): key, gap_begin, gap_end.

    A gap lies between a period and the one before it, which `previous` finds slice by slice; those at the
    ends of a span come from the first and the last period of a key.
    """
    rows = previous(found.select(key, "period_begin", "period_end"), [key], "period_begin", ["period_end"], width)
    between = rows.where("prev is not null").select(key, F.col("prev.period_end").alias("gap_begin"), F.col("period_begin").alias("gap_end"))
    ends = spans.join(found.groupBy(key).agg(F.min("period_begin").alias("_b"), F.max("period_end").alias("_e")), key, "left")
    head = F.struct(F.col("first").alias("gap_begin"), F.coalesce("_b", "last").alias("gap_end"))
    tail = F.struct(F.col("_e").alias("gap_begin"), F.col("last").alias("gap_end"))
    outer = ends.select(key, F.explode(F.array(head, tail)).alias("g")).select(key, "g.*")
    return between.unionByName(outer).where("gap_end > gap_begin")


def overlap_share(begin1: Column, end1: Column, begin2: Column, end2: Column) -> Column:
    """Overlap by the shorter duration; 0 without overlap or with an empty interval."""
    common = F.least(end1, end2) - F.greatest(begin1, begin2)
    shorter = F.least(end1 - begin1, end2 - begin2)
    return F.when((common > 0) & (shorter > 0), common / shorter).otherwise(0.0)


def seconds_grid(df: DataFrame, key: str, second: str, value: str, confidence: str, reach: int) -> DataFrame:
    """A value for each second within `reach` of a report: the surest, then the nearest, then the smallest."""
    rows = df.withColumn("slot", F.explode(F.sequence(F.col(second) - reach, F.col(second) + reach)))
    order = F.struct(-F.col(confidence), F.abs(F.col("slot") - F.col(second)), F.col(value))
    return rows.groupBy(key, "slot").agg(F.min_by(value, order).alias(value))


def day_rollover(df: DataFrame, source: str, order: str, tod: str, near: float = 300.0, width: int = WIDTH) -> DataFrame:
    """Time of day to seconds since the first day: a fall from just before midnight to just after is a new day."""
    rows = previous(df, [source], order, [tod], width, keep=True)
    before = F.col(f"prev.{tod}")
    step = F.when((before > 86400 - near) & (F.col(tod) < near), 1).when((before < near) & (F.col(tod) > 86400 - near), -1).otherwise(0)
    rows = running(rows.withColumn("_step", step), [source], order, "_step", "day", width).withColumn("day", F.col("day").cast("long"))
    return rows.withColumn("seconds", F.col("day") * 86400.0 + F.col(tod)).drop("_step", "prev")


def day_rollover_reset(df: DataFrame, source: str, order: str, tod: str, near: float = 300.0, far: float = 600.0, width: int = WIDTH) -> DataFrame:
    """X10 with the reset rule: adds day and seconds since the first day, both null for a null or impossible time of day.

    The day goes up at the first time within `near` after midnight that follows one within `near` before
    it; both are forgotten, so that the next midnight can count, at a time at least `far` from midnight. A
    time just before midnight belongs to the day before, once a day has gone up. What is remembered of a
    stretch between two resets is the last known of a few flags, so that it is carried over slices.
    """
    day = 86400.0
    rows = df.withColumn("_tod", F.when(F.col(tod).between(0, day), F.col(tod)))
    early, late = F.col("_tod") <= near, F.col("_tod") >= day - near
    reset = (F.col("_tod") >= far) & (F.col("_tod") <= day - far)
    rows = carried(rows.withColumn("_late", F.when(reset, 0).when(late, 1)), [source], order, "_late", width)
    turn = early & (F.coalesce("_late", F.lit(0)) == 1)
    rows = rows.withColumn("_turn", turn).withColumn("_done", F.when(reset, 0).when(turn, 1))
    rows = previous(carried(rows, [source], order, "_done", width), [source], order, ["_done"], width)
    rows = rows.withColumn("_step", (F.col("_turn") & (F.coalesce("prev._done", F.lit(0)) == 0)).cast("int"))
    rows = running(rows.withColumn("_step", F.coalesce("_step", F.lit(0))), [source], order, "_step", "_days", width)
    own = F.col("_days") - (late & (F.col("_days") > 0)).cast("int")
    return rows.withColumn("day", F.when(F.col("_tod").isNotNull(), own).cast("long")).withColumn("seconds", F.col("day") * day + F.col("_tod")).select(*df.columns, "day", "seconds")


def override_tod(df: DataFrame, tod: str, offset: float, low: float = 0.0, high: float = 86400.0) -> DataFrame:
    """X11: times of day in [low, high] moved by an offset, kept within the day."""
    return df.withColumn(tod, F.when(F.col(tod).between(low, high), F.pmod(F.col(tod) + offset, F.lit(86400.0))).otherwise(F.col(tod)))


def not_in_future(df: DataFrame, t: str, now: Column, skew: int) -> DataFrame:
    """X11: reports later than now by more than the skew go."""
    return df.where(F.col(t) <= now + skew)
