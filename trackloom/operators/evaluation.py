"""Quality requirements of test reports against a reference, and their roll-up.

A requirement is a set of counters for each target, added up by Spark in two steps; a sector's result
is the same formula over the sums, not a mean of ratios (U1).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.scalar import local_offset, min_angle_diff
from trackloom.operators.staging import stage
from trackloom.operators.timeline import WIDTH, _over_slices, gap_sessions, mark_periods, previous, previous_and_running


def ratio(passed: Column, total: Column) -> Column:
    return F.when(total > 0, passed.cast("double") / total)


def missed_updates(times: DataFrame, periods: DataFrame, key: str, t: str, interval: int, tolerance: int = 0, least_gap: int | None = None, most_gap: int | None = None, width: int = WIDTH) -> DataFrame:
    """For each key sum_uis, missed and pd from the gaps between reports, period begins and period ends.

    The tolerance is taken off each gap first. What is left counts if it is longer than the interval and
    neither below least_gap nor above most_gap; floor(what is left / interval) updates are missed in it.
    """
    periods = stage(periods)  # few rows, which are asked three times
    # a period is open from its begin to its end, which come before and after the reports of their time
    point = lambda df, c, kind, step: df.select(key, F.col(c).alias("at"), F.lit(kind).alias("kind"), F.lit(step).alias("step"))
    points = point(times, t, 1, 0).unionByName(point(periods, "period_begin", 0, 1)).unionByName(point(periods, "period_end", 2, -1))
    rows = previous_and_running(points, [key], "at", ["at"], "step", "open", width, ["kind"])
    gaps = rows.where("kind = 2 or kind = 1 and open > 0").withColumn("gap", F.col("at") - F.col("prev.at"))
    left = F.col("gap") - tolerance
    counted = (left > interval) & (F.lit(True) if least_gap is None else left >= least_gap) & (F.lit(True) if most_gap is None else left <= most_gap)
    missed = gaps.groupBy(key).agg(F.sum(F.when(counted, F.floor(left / interval)).otherwise(0)).cast("long").alias("missed"))
    uis = periods.groupBy(key).agg(F.sum(F.floor((F.col("period_end") - F.col("period_begin")) / interval)).cast("long").alias("sum_uis"))
    return uis.join(missed, key).withColumn("pd", detection_probability(F.col("missed"), F.col("sum_uis")))


def missed_intervals(times: DataFrame, periods: DataFrame, key: str, t: str, valid: Column, interval: int, least_period: int = 0, tolerance: int = 0, least_gap: int | None = None, most_gap: int | None = None) -> DataFrame:
    """As R1 on the valid updates of the periods that are long enough; invalid updates are skipped."""
    long = periods.where(F.col("period_end") - F.col("period_begin") >= least_period)
    return missed_updates(times.where(F.coalesce(valid, F.lit(False))), long, key, t, interval, tolerance, least_gap, most_gap)


def detection_probability(missed: Column, sum_uis: Column) -> Column:
    return F.when(sum_uis > 0, 1.0 - missed / sum_uis)


STATUSES = ("same", "different", "no_ref_val", "no_tst")


def status_counts(df: DataFrame, key: list[str], status: str, inside: Column | None = None) -> DataFrame:
    """Counters of a compared value for each key (2.6): without a reference position, else outside, else by status.

    n_updates - n_no_ref_pos = n_inside + n_outside, and n_inside is the sum of the statuses. inside is
    asked of the reference's position, which is there then.
    """
    inside = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    there = F.col(status) != "no_ref_pos"
    of = lambda s: F.count_if(inside & (F.col(status) == s)).alias(f"n_{s}")
    counts = [F.count("*").alias("n_updates"), F.count_if(~there).alias("n_no_ref_pos"), F.count_if(there & ~inside).alias("n_outside"), F.count_if(there & inside).alias("n_inside")]
    return df.groupBy(*key).agg(*counts, *(of(s) for s in STATUSES))


def correct_rate(counts: DataFrame) -> DataFrame:
    """A missing test value isn't correct."""
    return counts.withColumn("p_correct", ratio(F.col("n_same"), F.col("n_same") + F.col("n_different") + F.col("n_no_tst")))


def false_rate(counts: DataFrame) -> DataFrame:
    """Only different values are false."""
    return counts.withColumn("p_false", ratio(F.col("n_different"), F.col("n_same") + F.col("n_different")))


def present_rate(counts: DataFrame) -> DataFrame:
    """Present values, and updates whose reference has no value, of all inside; those without a reference position don't count."""
    there = F.col("n_same") + F.col("n_different") + F.col("n_no_ref_val")
    return counts.withColumn("p_present", ratio(there, there + F.col("n_no_tst")))


def identification_correct(statuses: list[str], all_needed: bool = False) -> Column:
    """One outcome of several compared identity columns: no_ref_val, correct or not_correct.

    Without a reference value in any of them no_ref_val. A missing test value isn't correct; one column
    without a reference value hasn't failed.
    """
    fine = [F.col(s).isin("same", "no_ref_val") for s in statuses]
    every, some = (reduce(op, fine) for op in (and_, or_))
    without = reduce(and_, [F.col(s) == "no_ref_val" for s in statuses])
    return F.when(without, "no_ref_val").when(every if all_needed else some, "correct").otherwise("not_correct")


def identification_false(statuses: list[str], all_needed: bool = True) -> Column:
    """False where all (or any) of the columns in use are different, else not_false.

    A column without a test or a reference value isn't different, so that with all needed it makes the
    report right. With no column in use no report is false.
    """
    different = [F.coalesce(F.col(s) == "different", F.lit(False)) for s in statuses]
    if not different:
        return F.lit("not_false")
    return F.when(reduce(and_ if all_needed else or_, different), "false").otherwise("not_false")


def any_comparable(statuses: list[str]) -> Column:
    """Whether any of the columns in use has a test and a reference value; without one, R4 still counts the report as correct."""
    return reduce(or_, [F.coalesce(F.col(s).isin("same", "different"), F.lit(False)) for s in statuses], F.lit(False))


def roll_up(counts: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Sums of counters over targets; by may hold split columns."""
    sums = [F.sum(c).alias(c) for c in counters]
    return counts.groupBy(*by).agg(F.count("*").alias("n_targets"), *sums) if by else counts.agg(F.count("*").alias("n_targets"), *sums)


def split_key(primary_only: Column, mode_s: Column) -> Column:
    """U2."""
    return F.when(primary_only, "Primary").when(mode_s, "Mode S").otherwise("Mode A/C")


def interest(df: DataFrame, factor: str, levels: tuple[float, float] = (0.1, 0.05)) -> DataFrame:
    """Level 2 and 1 of a target's summed contributions."""
    return df.withColumn("interest", F.when(F.col(factor) >= levels[0], 2).when(F.col(factor) >= levels[1], 1).otherwise(0))


def interest_contributions(counts: DataFrame, key: str, by: list[str], failed: str, total: str) -> tuple[DataFrame, DataFrame]:
    """What each target adds to the failures of each requirement, and of all its requirements together.

    counts has a row for each target and requirement (by). A target's factor is its failed updates by the
    total of all targets, so that the factors of a requirement add up to its joined failure rate; levels
    are 0.05 and 0.01. The second table sums a target's factors over its requirements; levels are 0.1 and
    0.05.
    """
    sums = counts.groupBy(*by).agg(F.sum(total).alias("_all"))
    each = counts.join(sums, by).withColumn("factor", F.coalesce(ratio(F.col(failed), F.col("_all")), F.lit(0.0))).select(key, *by, "factor")
    return interest(each, "factor", (0.05, 0.01)), interest(each.groupBy(key).agg(F.sum("factor").alias("factor")), "factor")


def holds_for_every_target(failed: Column) -> list[Column]:
    """U4: passes without failed targets; the value shown is their number."""
    return [F.count_if(failed).alias("n_failed"), (F.count_if(failed) == 0).alias("passed")]


def accumulate(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A10: number, extremes, mean, root mean square and population deviation."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.stddev_pop(v).alias("stddev")
    )


def position_errors(df: DataFrame, lat: str, lon: str, ref_lat: str, ref_lon: str, ref_angle: str, ref_speed: str) -> DataFrame:
    """D, d_along, d_across in metres and latency in seconds of each report (decisions Q12, Q13)."""
    east, north = local_offset(F.col(ref_lat), F.col(ref_lon), F.col(lat), F.col(lon))
    df = df.withColumn("d", F.hypot(east, north)).withColumn("_turn", F.radians(90.0 - F.col(ref_angle)) - F.atan2(north, east))
    df = df.withColumn("d_along", F.col("d") * F.cos("_turn")).withColumn("d_across", F.col("d") * F.sin("_turn"))
    usable = (F.col("d") > 0) & ~F.isnan("d") & (F.col(ref_speed) > 0) & ~F.isnan(F.col(ref_speed))
    return df.withColumn("latency", F.when(usable, -F.col("d_along") / F.col(ref_speed))).drop("_turn")


def speed_passes(value: Column, reference: Column, threshold: float, percent: float | None = None) -> Column:
    """Within the threshold, or within the percentage of the test value if that is more."""
    limit = F.lit(threshold) if percent is None else F.greatest(F.lit(threshold), value * percent / 100.0)
    return F.abs(reference - value) <= limit


def angle_passes(value: Column, reference: Column, threshold: float, speed: Column | None = None, least_speed: float = 0.0) -> Column:
    """The smaller turn is within the threshold; null for slow reports."""
    within = F.abs(min_angle_diff(reference, value)) <= threshold
    return within if speed is None else F.when(speed >= least_speed, within)


def azimuth_difference(a: Column, b: Column) -> Column:
    """Of radians, wrapped, in degrees (decision Q14)."""
    return F.degrees(F.pmod(b - a + F.pi(), 2 * F.pi()) - F.pi())


def linear_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares y = gain * x + bias."""
    fit = [F.regr_slope(F.col(y), F.col(x)).alias("gain"), F.regr_intercept(F.col(y), F.col(x)).alias("bias"), F.avg(F.col(x) - F.col(y)).alias("mean_diff")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *fit)


def extra_data(times: DataFrame, periods: DataFrame, key: str, t: str, ignored: DataFrame | None = None, inside: Column | None = None) -> DataFrame:
    """For each key the reports in no reference period and their share; targets in `ignored` are left out.

    With inside, a condition on the report's own position, only reports in the sector count.
    """
    times = times if inside is None else times.where(F.coalesce(inside, F.lit(False)))
    rows = times if ignored is None else times.join(ignored.select(key), key, "left_anti")
    rows = mark_periods(rows, stage(periods), key, t)
    out = rows.groupBy(key).agg(F.count_if(F.col("period").isNull()).alias("n_extra"), F.count_if(F.col("period").isNotNull()).alias("n_ok"))
    return out.withColumn("p_extra", ratio(F.col("n_extra"), F.col("n_extra") + F.col("n_ok")))


def ignored_targets(reports: DataFrame, key: str, t: str, primary: Column, least_updates: int = 10, least_duration: int = 60_000_000) -> DataFrame:
    """Targets with too few updates, too short a life, or primary reports only."""
    per = reports.groupBy(key).agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("duration"), F.min(F.coalesce(primary, F.lit(False)).cast("int")).alias("primary"))
    return per.where((F.col("n") < least_updates) | (F.col("duration") < least_duration) | (F.col("primary") == 1)).select(key)


def extra_tracks(reports: DataFrame, tracks: DataFrame, key: str, t: str, track: str, width: int = WIDTH) -> DataFrame:
    """Reports inside the period of another track of the same target; periods meet reports by time slice."""
    o = _over_slices(tracks.select(F.col(key).alias("_k"), F.col(track).alias("_n"), "period_begin", "period_end"), "period_begin", "period_end", width)
    rows = reports.withColumn("_slot", F.floor(F.col(t) / width))
    inside = (F.col(track) != F.col("_n")) & F.col(t).between(F.col("period_begin"), F.col("period_end"))
    return rows.join(o, (F.col(key) == F.col("_k")) & (F.col("_slot") == F.col("_slice")) & inside, "left_semi").drop("_slot")


def extra_track_rate(reports: DataFrame, extra: DataFrame, key: str, row: str) -> DataFrame:
    """For each key extra and other reports, and the share of the extra ones."""
    flags = reports.join(extra.select(F.col(row).alias("_x")), F.col(row) == F.col("_x"), "left")
    out = flags.groupBy(key).agg(F.count("_x").alias("n_extra"), F.count_if(F.col("_x").isNull()).alias("n_ok"))
    return out.withColumn("p_extra", ratio(F.col("n_extra"), F.col("n_extra") + F.col("n_ok")))


@dataclass(frozen=True)
class Speed:
    """The largest speed of an update in metres a second, by its own value or from two positions."""

    own: str
    lat: str
    lon: str
    most: float


def dubious(
    df: DataFrame, key: list[str], t: str, limits: dict[str, float], second: float, least_updates: int, least_duration: float, most_share: float,
    angles: tuple[str, ...] = (), primary: Column | None = None, largest: dict[str, float] | None = None, width: int = WIDTH,
    speed: Speed | None = None, compared: tuple[float, float] | None = None,
) -> DataFrame:
    """Rates of change between consecutive updates against limits, for each target or track.

    limits: column -> largest change in a second; those of `angles` are degrees, whose change is the smaller
    way round. largest: column -> largest value. compared: only updates at least and at most so many
    seconds after the one before are held against limits. speed: an update whose own speed isn't above the
    limit, or that has none, is judged by the speed from the position before (decision Q19: the first one
    counts as such). A target is dubious if it has primary reports only, too few updates, too short a life,
    or too large a share of its updates breaks a limit, in this order.
    """
    carry = dict.fromkeys([t, *limits, *((speed.lat, speed.lon) if speed else ())])
    rows = previous(df, key, t, list(carry), width)
    dt = (F.col(t) - F.col(f"prev.{t}")) / second
    near = F.lit(True) if compared is None else dt.between(*compared)
    bad = {}
    for column, limit in limits.items():
        last = F.col(f"prev.{column}")
        change = min_angle_diff(last, F.col(column)) if column in angles else F.col(column) - last
        bad[column] = F.coalesce((dt > 0) & near & (F.abs(change) / dt > limit), F.lit(False))
    if speed:
        way = F.hypot(*local_offset(F.col(f"prev.{speed.lat}"), F.col(f"prev.{speed.lon}"), F.col(speed.lat), F.col(speed.lon)))
        bad["speed_own"] = F.coalesce(F.col(speed.own) > speed.most, F.lit(False))
        bad["speed_positions"] = ~bad["speed_own"] & F.coalesce((dt > 0) & (way / dt > speed.most), F.lit(False))
    for column, limit in (largest or {}).items():
        bad[f"large_{column}"] = F.coalesce(F.abs(column) > limit, F.lit(False))
    only = F.lit(False) if primary is None else F.coalesce(primary, F.lit(False))
    some = F.count_if(reduce(or_, bad.values(), F.lit(False))).alias("n_dubious")
    out = rows.groupBy(*key).agg(F.count("*").alias("n_updates"), ((F.max(t) - F.min(t)) / second).alias("duration"), F.min(only.cast("int")).alias("_only"), some, *(F.count_if(b).alias(f"n_{c}") for c, b in bad.items()))
    reason = F.when(F.col("_only") == 1, "primary only").when(F.col("n_updates") < least_updates, "few updates").when(F.col("duration") < least_duration, "short").when(F.col("n_dubious") > most_share * F.col("n_updates"), "changes")
    return out.withColumn("reason", reason).withColumn("is_dubious", reason.isNotNull()).drop("_only")


def dubious_tracks(df: DataFrame, key: str, track: str, t: str, gap: int, **rules) -> DataFrame:
    """`dubious` for each session of each track of a target."""
    rows = df.withColumn("_track", F.struct(key, track))
    return dubious(gap_sessions(rows, "_track", t, gap).drop("_track"), [key, track, "session"], t, **rules)


def dubious_ratio(found: DataFrame, by: list[str]) -> DataFrame:
    """Dubious ones of all, and the mean duration of either kind."""
    mean = lambda flag: F.avg(F.when(F.col("is_dubious") == flag, F.col("duration")))
    out = found.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("is_dubious").alias("n_dubious"), mean(True).alias("mean_dubious"), mean(False).alias("mean_other"))
    return out.withColumn("p_dubious", ratio(F.col("n_dubious"), F.col("n")))


def passed_rate(df: DataFrame, by: list[str], value: str, passed: Column) -> DataFrame:
    """Passed and failed of the values that are there, with the accumulator's figures."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count_if(passed).alias("n_passed"), F.count_if(~passed).alias("n_failed"))
    out = counts.join(accumulate(df, by, value), by)
    return out.withColumn("p_passed", ratio(F.col("n_passed"), F.col("n_passed") + F.col("n_failed")))


def radar_view(df: DataFrame, site: tuple[float, float], lat: str, lon: str, prefix: str) -> DataFrame:
    """Range in metres and azimuth in radians of positions as seen from a site."""
    east, north = local_offset(F.lit(site[0]), F.lit(site[1]), F.col(lat), F.col(lon))
    return df.withColumn(f"{prefix}_range", F.hypot(east, north)).withColumn(f"{prefix}_azimuth", F.atan2(east, north))
