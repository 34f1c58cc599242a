"""Predicates over target reports, NULL-aware. Each returns a boolean Column for where()."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the time slices in which windows meet rows: eight days in microseconds.
SLICE = 192 * 3_600_000_000
OPERATORS = {
    "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "LIKE": lambda c, v: c.like(v), "IN": lambda c, v: c.isin(list(v)), "NOT IN": lambda c, v: ~c.isin(list(v)), "IS": lambda c, v: c.eqNullSafe(v), "IS NOT": lambda c, v: ~c.eqNullSafe(v),
}


def any_of(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def all_of(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def compare(column: str, operator: str, value, absolute: bool = False) -> Column:
    """one generic condition. A None among the values of IN also matches null (F4, decision Q1)."""
    c = F.abs(column) if absolute else F.col(column)
    if operator in ("IN", "NOT IN"):
        values = list(value)
        known = OPERATORS[operator](c, [v for v in values if v is not None])
        if operator == "IN":
            return known | c.isNull() if None in values else known
        return known & c.isNotNull() if None in values else known | c.isNull()
    return OPERATORS[operator](c, value)


def values_or_null(column: str, values: Iterable, null: bool = False) -> Column:
    """membership, optionally of nulls too; no values and no null: no rows."""
    values = list(values)
    known = F.col(column).isin(values) if values else F.lit(False)
    return known | F.col(column).isNull() if null else known


def codes(column: str, text: str, base: int) -> Column:
    """a comma-separated list of octal or hexadecimal codes; NULL in it matches null."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    return values_or_null(column, [int(p, base) for p in parts if p.upper() != "NULL"], any(p.upper() == "NULL" for p in parts))


def contains_any(columns: Iterable[str], parts: Iterable[str], null: bool = False) -> Column:
    """an identification contains one of the parts."""
    columns = list(columns)
    found = any_of(F.col(c).contains(p) for c in columns for p in parts)
    return found | all_of(F.col(c).isNull() for c in columns) if null else found


def between(column: str, low, high, null: bool = False) -> Column:
    """closed interval."""
    known = F.col(column).between(low, high)
    return known | F.col(column).isNull() if null else known


def outside_windows(column: str, windows: Iterable[tuple]) -> Column:
    """F8: not in any of the closed windows."""
    return ~any_of(F.col(column).between(a, b) for a, b in windows)


def sources(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key tuple is among the wanted ones; an empty table gives no rows."""
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def primary_only(identities: Iterable[str], detection: str) -> Column:
    """no secondary identity, and a detection that involves the primary radar or an unknown one."""
    return all_of(F.col(c).isNull() for c in identities) & (F.col(detection).isin(1, 3, 6, 7) | F.col(detection).isNull())


def quality_by_version(version: str, bounds: dict[tuple, Column]) -> Column:
    """each group of versions has its own bound; versions of no group don't pass."""
    return any_of(F.col(version).isin(list(group)) & bound for group, bound in bounds.items())


def accuracy_within(x: str, y: str, limit: float) -> Column:
    """F17."""
    return F.hypot(F.col(x).cast("double"), F.col(y).cast("double")) <= limit


def json_has_any(column: str, members: Iterable[int], null: bool = False) -> Column:
    """a JSON array of integers holds one of the members."""
    parsed = F.from_json(column, "array<int>")
    found = any_of(F.coalesce(F.array_contains(parsed, F.lit(m)), F.lit(False)) for m in members)
    return found | F.col(column).isNull() if null else found


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """the name of the first rule that holds, null if none."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def without_windows_of(df: DataFrame, windows: DataFrame, key: str, at: str) -> DataFrame:
    """leaves out rows inside closed windows (key, begin, end) of their own target."""
    # windows meet rows by time slice, so that a target with very many of either stays spread
    slot = lambda c: F.floor(F.col(c) / SLICE)
    w = windows.select(F.col(key).alias("_k"), "begin", "end", F.explode(F.sequence(slot("begin"), slot("end"))).alias("_s"))
    inside = F.col(at).between(F.col("begin"), F.col("end"))
    return df.withColumn("_slot", slot(at)).join(w, (F.col(key) == F.col("_k")) & (F.col("_slot") == F.col("_s")) & inside, "left_anti").drop("_slot")


def without_requirements(results: DataFrame, excluded: DataFrame, key: str, requirement: str) -> DataFrame:
    """results of requirements that aren't excluded for their target."""
    return results.join(excluded.select(key, requirement).distinct(), [key, requirement], "left_anti")


def chain(conditions: list[tuple[str, Column]]) -> Column:
    """conditions joined from left to right, each by its own AND or OR; the first one's is ignored."""
    out = None
    for how, condition in conditions:
        out = condition if out is None else out | condition if how.upper() == "OR" else out & condition
    return F.lit(True) if out is None else out


def of_target(df: DataFrame, column: str, values: Iterable, null: bool = False) -> Column:
    """as values_or_null; a content without the column passes only if nulls are wanted."""
    return values_or_null(column, values, null) if column in df.columns else F.lit(null)


def heights(df: DataFrame, columns: list[str], low: float, high: float, null: bool = False) -> Column:
    """every height column that the content has is in the range, or null where that is wanted."""
    return all_of(between(c, low, high, null) for c in columns if c in df.columns)


def import_filter(df: DataFrame, tod: tuple[str, float, float] | None = None, box: tuple | None = None, height: tuple[str, float, float] | None = None) -> DataFrame:
    """time of day, (lat, lon, south, north, west, east) and height ranges; rows without a value pass."""
    terms = [between(*tod, null=True)] if tod else []
    if box:
        lat, lon, south, north, west, east = box
        terms += [between(lat, south, north, null=True), between(lon, west, east, null=True)]
    return df.where(all_of([*terms, *([between(*height, null=True)] if height else [])]))


def selection_flag(df: DataFrame, selected: DataFrame, row: str) -> DataFrame:
    """a flag for the rows whose number is among the selected ones."""
    marks = selected.select(F.col(row).alias("_sel")).distinct()
    return df.join(marks, F.col(row) == F.col("_sel"), "left").withColumn("selected", F.col("_sel").isNotNull()).drop("_sel")


def enabled(df: DataFrame, known: DataFrame, types: Iterable[str], keys: list[str]) -> DataFrame:
    """rows whose source is of a wanted type and whose source and line are wanted: known(keys..., type, wanted)."""
    return sources(df, known.where(F.col("type").isin(list(types)) & F.col("wanted")), keys)


def on_ground(ground: str, source: str, ground_only: Iterable) -> Column:
    """reports of ground-only sources are on ground whatever they say."""
    return F.when(F.col(source).isin(list(ground_only)), True).otherwise(F.col(ground))


def evaluation_load(contents: dict[str, DataFrame], ref: str, tst: str, t: str, window: tuple, key: str, targets: Iterable | None = None, quality: dict[str, Column] | None = None) -> dict[str, DataFrame]:
    """the two contents of an evaluation within the time window, of the wanted targets, with each one's quality condition."""
    out = {}
    for name in {ref, tst}:
        df = contents[name].where(between(t, *window))
        if targets is not None:
            df = df.where(of_target(df, key, targets))
        out[name] = df.where((quality or {}).get(name, F.lit(True)))
    return out


def target_reasons(
    codes: str, least_updates: int, least_duration: int, primary: str, mode_s: str, mode_c_max: str, duration: str, updates: str,
    code_lists: tuple[Iterable[int | tuple[int, int]], bool] | None = None, least_height: float | None = None, detected: str | None = None, address: str | None = None, addresses: tuple[Iterable[int], bool] | None = None,
) -> Column:
    """why a target isn't used, by the first rule that holds, on its summary; null if it is used.

    In order: short, primary only, Mode A/C only, its codes on (or off) a list, no or too low a height,
    its addresses on (or off) a list, not detected. codes and address name arrays of what a target has: it
    is on a list with any of them. A list is (values, True to leave out those on it); values of codes may
    be pairs, both ends of a range included.
    """

    def within(low: int, high: int):
        return lambda c: c.between(low, high)

    def on_list(column: str, wanted: tuple[Iterable, bool]) -> Column:
        single = [v for v in wanted[0] if not isinstance(v, tuple)]
        terms = [F.arrays_overlap(F.col(column), F.array(*map(F.lit, single)))] if single else []
        terms += [F.exists(column, within(*r)) for r in wanted[0] if isinstance(r, tuple)]
        on = any_of(F.coalesce(t, F.lit(False)) for t in terms)
        return on if wanted[1] else ~on

    rules = [("short", (F.col(updates) < least_updates) | (F.col(duration) < least_duration)), ("primary only", F.col(primary)), ("Mode A/C only", ~F.col(mode_s))]
    if code_lists is not None:
        rules.append(("Mode A code", on_list(codes, code_lists)))
    if least_height is not None:
        rules += [("no Mode C", F.col(mode_c_max).isNull()), ("Mode C too low", F.col(mode_c_max) < least_height)]
    if addresses is not None and address is not None:
        rules.append(("address", on_list(address, addresses)))
    if detected is not None:
        rules.append(("not detected", ~F.col(detected)))
    return first_reason(rules)
