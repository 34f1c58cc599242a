"""Association of reports with targets."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalar import EARTH_RADIUS, haversine
from trackloom.operators.filters import sources
from trackloom.operators.near import nearest, nearest_by_steps, pair_sums
from trackloom.operators.staging import row_numbers, stage
from trackloom.operators.timeline import WIDTH, _over_slices, asof_neighbours, gap_sessions, overlap_share, previous, running

#: Identifications that identify nothing; fixed values.
PLACEHOLDERS = ["00000000", "????????", "        "]


def best_hash_match(users: DataFrame, given: DataFrame, hashes: str, key: str, t: str, past: int, future: int, old: int) -> DataFrame:
    """Each user row lists hashes; the given row with the hash nearest in time, -past to +future, is its match.

    Adds match, dt and dubious (the best is `old` or older); rows without a match keep nulls. Rows meet by
    hash and time bucket, so that a frequent hash is many small keys.
    """
    wide = max(past + future, 1)
    bucket = lambda c: F.floor(c / wide)
    each = users.withColumn("_h", F.explode(F.split(hashes, ";"))).withColumnRenamed(t, "_ut").withColumn("_b", bucket(F.col("_ut")))
    g = given.select(F.col(key).alias("_gh"), F.col(t).alias("_gt"), F.col("id").alias("_gid"), F.explode(F.sequence(bucket(F.col(t) - future), bucket(F.col(t) + past))).alias("_gb"))
    dt = F.col("_gt") - F.col("_ut")
    found = each.join(g, (F.col("_h") == F.col("_gh")) & (F.col("_b") == F.col("_gb")) & dt.between(-past, future))
    best = found.groupBy("id").agg(F.min(F.struct(F.abs(dt).alias("d"), F.col("_gid").alias("match"), dt.alias("dt"))).alias("b"))
    out = users.join(best, "id", "left").withColumn("match", F.col("b.match")).withColumn("dt", F.col("b.dt"))
    return out.withColumn("dubious", F.col("b.d") >= old).drop("b")


def hash_associations(users: DataFrame, given: DataFrame, hashes: str, key: str, t: str, past: int, future: int, old: int, close_past: int, close_future: int, ends: int) -> DataFrame:
    """For each hash that a user row lists: id, hash, match, dt, n_candidates, outcome.

    The match is the given row of that hash nearest in time, -past to +future, the smaller id of two. It
    is "dubious distant" if it is `old` or older, "dubious collision" if it and another one lie within
    close_past and close_future, else "found". Without one the hash is "missing", or "missing at an end" within
    `ends` of the first or last user row.

    Nothing is paired: the nearest come from an as-of alignment, the numbers in a window from a running
    count at its two ends, both along time slices of a hash.
    """
    each = users.select("id", F.col(t).alias("t"), F.explode(F.array_distinct(F.split(hashes, ";"))).alias("hash")).where("hash <> ''")
    g = given.where(F.col(key).isNotNull()).select(F.col(key).alias("hash"), F.col(t).alias("t"), F.col("id").alias("match"))
    near = asof_neighbours(each, g, "hash", "t", ["match"], max(past, future))
    side = lambda name, most: F.when(F.abs(F.col(f"{name}.t") - F.col("t")) <= most, F.struct(F.abs(F.col(f"{name}.t") - F.col("t")).alias("d"), F.col(f"{name}.match").alias("match"), (F.col(f"{name}.t") - F.col("t")).alias("dt")))
    best = near.select("id", "hash", "t", F.array_min(F.array_compact(F.array(side("lo", past), side("hi", future)))).alias("b"))
    # window ends before and after the given rows of their time
    ends_of = {"low": (-past, 0), "high": (future, 2), "close_low": (-close_past, 0), "close_high": (close_future, 2)}
    points = F.array(*(F.struct((F.col("t") + step).alias("at"), F.lit(kind).alias("kind"), F.lit(name).alias("name")) for name, (step, kind) in ends_of.items()))
    probes = each.select("id", "hash", F.explode(points).alias("p")).select("id", "hash", "p.*", F.lit(0).alias("one"))
    every = probes.unionByName(g.select("hash", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("one")), allowMissingColumns=True)
    counted = running(every, ["hash"], "at", "one", "n", max(8 * (past + future), 1), ["kind"]).where("name is not null")
    counts = counted.groupBy("id", "hash").agg(*(F.max(F.when(F.col("name") == k, F.col("n"))).alias(k) for k in ends_of))
    out = best.join(counts, ["id", "hash"])
    span = users.agg(F.min(t).alias("_first"), F.max(t).alias("_last"))  # one row
    out = out.join(F.broadcast(span))
    dt = F.col("b.dt")
    in_close = dt.between(-close_past, close_future) & (F.col("close_high") - F.col("close_low") > 1)
    at_end = (F.col("t") - F.col("_first") <= ends) | (F.col("_last") - F.col("t") <= ends)
    outcome = F.when(F.col("b").isNull(), F.when(at_end, "missing at an end").otherwise("missing")).when(dt <= -old, "dubious distant").when(in_close, "dubious collision").otherwise("found")
    return out.select("id", "hash", F.col("b.match").alias("match"), dt.alias("dt"), (F.col("high") - F.col("low")).cast("long").alias("n_candidates"), outcome.alias("outcome"))


def modes_agree(a: Column, b: Column, c: Column, d: Column, feet: float = 300.0) -> tuple[Column, Column]:
    """K7: same, different or unknown for two Mode A codes, and for two Mode C heights at most `feet` apart."""
    mode_a = F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "same").otherwise("different")
    mode_c = F.when(c.isNull() | d.isNull(), "unknown").when(F.abs(c - d) <= feet, "same").otherwise("different")
    return mode_a, mode_c


def near_pairs(reports: DataFrame, targets: DataFrame, t: str, x: str, y: str, reach_t: int, reach: float, carry: list[str]) -> DataFrame:
    """Pairs of a report and a target row within reach_t and reach: the report's columns, target and the carried columns as other_..., distance.

    The report stands in one cell of time and space twice as wide as the reach, the target row in those
    that its reach touches, two at most along each axis: an equi-join on the cell, which Spark splits
    where a cell is crowded.
    """
    cell = lambda c, w: F.floor(c / (2 * w))
    touched = lambda c, w: F.explode(F.sequence(cell(F.col(c) - w, w), cell(F.col(c) + w, w)))
    left = reports.withColumns({"_ct": cell(F.col(t), reach_t), "_cx": cell(F.col(x), reach), "_cy": cell(F.col(y), reach)})
    right = targets.select("target", F.col(t).alias("other_t"), F.col(x).alias("other_x"), F.col(y).alias("other_y"), *(F.col(c).alias(f"other_{c}") for c in carry), touched(t, reach_t).alias("_ct"))
    right = right.withColumn("_cx", F.explode(F.sequence(cell(F.col("other_x") - reach, reach), cell(F.col("other_x") + reach, reach))))
    right = right.withColumn("_cy", F.explode(F.sequence(cell(F.col("other_y") - reach, reach), cell(F.col("other_y") + reach, reach))))
    pairs = left.join(right, ["_ct", "_cx", "_cy"]).withColumn("distance", F.hypot(F.col("other_x") - F.col(x), F.col("other_y") - F.col(y)))
    return pairs.where((F.abs(F.col("other_t") - F.col(t)) <= reach_t) & (F.col("distance") <= reach)).drop("_ct", "_cx", "_cy")


def nearest_candidates(reports: DataFrame, targets: DataFrame, t: str, x: str, y: str, reach_t: int, reach: float, mode_a: str | None = None, mode_c: str | None = None) -> DataFrame:
    """For each report the target row of the least distance within reach_t and reach: id, target, distance, n_candidates.

    With mode_a and mode_c, target rows whose code is different, or whose height is, aren't candidates.
    """
    return nearest(reports, targets, t, x, y, reach_t, reach, (mode_a, mode_c) if mode_a and mode_c else None)


def distance_class(d_nm: Column) -> Column:
    """K6."""
    return F.when(d_nm > 5, "not ok").when(d_nm > 2, "dubious").when(d_nm < 1, "good").otherwise("acceptable")


def merge_candidates(spans: DataFrame, key: str, by: str, least: float, width: int | None = None) -> DataFrame:
    """Pairs of targets that share an attribute and overlap in time by at least the share `least`.

    Spans meet by time slice, in the first slice of both only, so that no pair comes twice. Slices are as
    wide as the spans are long on average, if no width is given, so that a span is in two or so.
    """
    if width is None:
        width = max(1, int(spans.agg(F.avg(F.col("end") - F.col("begin"))).first()[0] or 1))
    cut = _over_slices(spans.select(key, by, "begin", "end"), "begin", "end", width)
    a, b = cut.alias("a"), cut.alias("b")
    share = overlap_share(F.col("a.begin"), F.col("a.end"), F.col("b.begin"), F.col("b.end"))
    both = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a._slice") == F.col("b._slice")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    first = F.col("a._slice") == F.greatest(F.floor(F.col("a.begin") / width), F.floor(F.col("b.begin") / width))
    pairs = a.join(b, both & first & (F.col("a.begin") < F.col("b.end")) & (F.col("b.begin") < F.col("a.end")))
    return pairs.select(F.col(f"a.{by}").alias(by), F.col(f"a.{key}").alias("one"), F.col(f"b.{key}").alias("two"), share.alias("share")).where(F.col("share") >= least)


def target_pairs(reports: DataFrame, t: str, x: str, y: str, mode_a: str, mode_c: str, reach_t: int, reach: float, least_share: float = 0.1, most_different: float = 0.1, most_not_ok: float = 0.2) -> DataFrame:
    """Pairs of targets that may be one: one, two, n, n_same, n_different, n_not_ok, mean_distance, share, score.

    Reports of two targets that are near in time and space are compared: codes and heights are the same
    or different, the distance has its class (K6). A pair stays with a share of common time of
    least_share and small shares of different codes and large distances. score: compared updates by mean
    distance, five times that where codes agree.
    """
    near, known = pair_sums(reports, t, x, y, mode_a, mode_c, reach_t, reach)
    near = near.where((F.col("n_different") <= most_different * F.col("n")) & (F.col("n_not_ok") <= most_not_ok * F.col("n")))
    spans = stage(known.join(reports.groupBy("target").agg(F.min(t).alias("b"), F.max(t).alias("e")), "target"))
    for side in ("one", "two"):
        of = spans.select(F.col("number").alias(side), F.struct("target", "b", "e").alias(f"_{side}"))
        near = near.join(of, side).drop(side)
    share = overlap_share(F.col("_one.b"), F.col("_one.e"), F.col("_two.b"), F.col("_two.e"))
    first, second = F.col("_one.target"), F.col("_two.target")
    per = near.select(F.least(first, second).alias("one"), F.greatest(first, second).alias("two"), "n", "n_same", "n_different", "n_not_ok", (F.col("total") / F.col("n")).alias("mean_distance"), share.alias("share"))
    per = per.where(F.col("share") >= least_share)
    return per.withColumn("score", F.col("n") / F.greatest("mean_distance", F.lit(1e-6)) * F.when(F.col("n_same") > 0, 5.0).otherwise(1.0))


def best_merges(pairs: DataFrame) -> DataFrame:
    """The pairs that a greedy merge, best score first, takes at once: each the best of both its targets: from_target, into_target.

    Ties go to the smaller targets. What is left may be scored anew after these are merged.
    """
    order = F.struct(-F.col("score"), "one", "two")
    pairs = stage(pairs.select("one", "two", "score"))
    sides = pairs.select(F.col("one").alias("target"), order.alias("o")).unionByName(pairs.select(F.col("two").alias("target"), order.alias("o")))
    best = sides.groupBy("target").agg(F.min("o").alias("best"))
    both = best.groupBy("best.one", "best.two").agg(F.count("*").alias("n")).where("n = 2")
    return both.select(F.col("two").alias("from_target"), F.col("one").alias("into_target"))


def merged(reports: DataFrame, merges: DataFrame) -> DataFrame:
    """reports with the targets that were merged into others renamed."""
    m = merges.select(F.col("from_target").alias("_f"), F.col("into_target").alias("_i"))
    return reports.join(m, F.col("target") == F.col("_f"), "left").withColumn("target", F.coalesce("_i", "target")).drop("_f", "_i")


def identity_targets(reports: DataFrame, address: str, identification: str, track: str, source: str, t: str, gap: int) -> DataFrame:
    """Adds target_key, a text: the target found by address, else identification, else track; null if none.

    An address is a target of its own. An identification leads to the address with which it was first
    seen, a track, while it has no long gap, to the target of its first report that has one; each is a
    target of its own only if it leads nowhere. A placeholder identifies nothing.
    """
    acid = F.when(~F.col(identification).isin(PLACEHOLDERS) & (F.trim(identification) != ""), F.col(identification))
    rows = reports.withColumn("_acid", acid).withColumn("_own", F.concat(F.lit("A"), F.col(address).cast("string")))
    of_acid = rows.where("_acid is not null and _own is not null").groupBy("_acid").agg(F.min(F.struct(t, "_own"))["_own"].alias("_by_acid"))
    rows = rows.join(of_acid, "_acid", "left").withColumn("_own", F.coalesce("_own", "_by_acid", F.concat(F.lit("I"), F.col("_acid"))))
    on_track = gap_sessions(rows.where(F.col(track).isNotNull()).withColumn("_trk", F.concat_ws("/", source, track)), "_trk", t, gap)
    of_track = on_track.where("_own is not null").groupBy("_trk", "session").agg(F.min(F.struct(t, "_own"))["_own"].alias("_by_track"))
    on_track = on_track.join(of_track, ["_trk", "session"], "left")
    on_track = on_track.withColumn("_own", F.coalesce("_own", "_by_track", F.concat(F.lit("T"), F.concat_ws("/", "_trk", "session"))))
    out = on_track.select(*reports.columns, "_own").unionByName(rows.where(F.col(track).isNull()).select(*reports.columns, "_own"))
    return out.withColumnRenamed("_own", "target_key")


def usable_reports(reports: DataFrame, x: str, y: str, source: str, unused: list[str]) -> DataFrame:
    """K2: reports with a position, of the sources in use."""
    return reports.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.col(source).isin(unused))


def associate(reports: DataFrame, columns: dict[str, str], gap: int, reach_t: int, reach: float, rounds: int = 2) -> DataFrame:
    """Id, target_key: by identity first, then by codes and position near known targets, then again near those found.

    columns names t, x, y, mode_a, mode_c, address, identification, track and source. In each round, the
    reports without a target are tried against the reports that have one; after the first, against those
    that the round before gave one, as the others were too far already. What is left keeps a null.
    """
    c = columns
    rows = identity_targets(reports, c["address"], c["identification"], c["track"], c["source"], c["t"], gap)
    rows = stage(rows.select("id", *(c[k] for k in ("t", "x", "y", "mode_a", "mode_c")), "target_key"))
    known = rows.where("target_key is not null").withColumn("target", F.col("target_key"))
    left, every = rows.where("target_key is null"), None
    for _ in range(rounds):
        found = nearest_by_steps(left, known, c["t"], c["x"], c["y"], reach_t, reach, (c["mode_a"], c["mode_c"]))
        every = found if every is None else every.unionByName(found)
        if found.isEmpty():
            break
        known, left = left.join(found, "id"), left.join(found.select("id"), "id", "left_anti")
    if every is None:
        return rows.select("id", "target_key")
    return rows.select("id", "target_key").join(every, "id", "left").select("id", F.coalesce("target_key", "target").alias("target_key"))


def target_numbers(associations: DataFrame, reports: DataFrame, t: str) -> DataFrame:
    """K4: target_key, utn: dense numbers in the order of a target's first report."""
    firsts = associations.where("target_key is not null").join(reports.select("id", t), "id").groupBy("target_key").agg(F.min(t).alias("first"))
    return row_numbers(firsts, [F.col("first"), F.col("target_key")], "utn").select("target_key", "utn")


def slice_bounds(first: int, last: int, width: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, end, written up to) of the slices of a time range: each reads `overlap` more than the next begins with."""
    out, begin = [], first
    while begin <= last:
        out.append((begin, begin + width, min(begin + width - overlap, last + 1) if begin + width - overlap <= last else last + 1))
        begin = out[-1][2]
    return out


def in_slices(reports: DataFrame, t: str, width: int, overlap: int) -> DataFrame:
    """K1: a copy of each report for every slice that reads it: slice, and kept: whether the slice writes its result.

    A slice reads [slice * step, slice * step + width) and writes what lies before its last `overlap`,
    so that each report is written once; step = width - overlap. The slices are groups that run side by side.
    """
    step = width - overlap
    last = F.floor(F.col(t) / step)
    first = F.floor((F.col(t) - width) / step) + 1
    rows = reports.withColumn("slice", F.explode(F.sequence(first, last)))
    return rows.withColumn("kept", F.col("slice") == last)


def write_back(reports: DataFrame, associations: DataFrame, column: str = "target_key") -> DataFrame:
    """Reports with the found target in place of what they had."""
    return reports.drop(column).join(associations.select("id", column), "id", "left")


def active_targets(ref: DataFrame, tst: DataFrame, key: str, wanted: DataFrame, by: list[str]) -> DataFrame:
    """For each target the reports of reference and test, of wanted (source, line) only: key, n_ref, n_tst; either side may be missing."""
    count = lambda df, name: sources(df.where(F.col(key).isNotNull()), wanted, by).groupBy(key).agg(F.count("*").alias(name))
    out = count(ref, "n_ref").join(count(tst, "n_tst"), key, "full_outer")
    return out.select(key, F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_tst", F.lit(0)).alias("n_tst"))


def outliers(df: DataFrame, key: list[str], t: str, x: str, y: str, second: float, most_speed: float, width: int = WIDTH) -> DataFrame:
    """Adds speed from the position before, in units a second, and is_outlier: faster than most_speed both from the one before and to the one after."""
    rows = previous(df, key, t, [t, x, y], width)
    speed = F.hypot(F.col(x) - F.col(f"prev.{x}"), F.col(y) - F.col(f"prev.{y}")) / F.nullif((F.col(t) - F.col(f"prev.{t}")) / second, F.lit(0.0))
    rows = rows.withColumn("speed_before", speed).drop("prev").withColumn("_neg", -F.col(t))
    rows = previous(rows, key, "_neg", ["speed_before"], width).withColumn("_after", F.col("prev.speed_before")).drop("prev", "_neg")
    fast = lambda c: F.coalesce(F.col(c) > most_speed, F.lit(False))
    return rows.withColumn("is_outlier", fast("speed_before") & fast("_after")).drop("_after")


def fixed_transponders(
    reports: DataFrame, transponders: DataFrame, row: str, attributes: dict[str, str], lat: str, lon: str, most: float, code: str, height: str | None = None,
) -> DataFrame:
    """Adds transponder, its height and is_transponder: the first one, by number, that fits all that it states.

    attributes: column of transponders -> column of reports. Each attribute that a transponder has must be
    the report's, and its position, if it has one, at most `most` metres away; one that fails leaves the
    next to be tried. A report without a fitting one but with code 7777 is a transponder of height 0, as
    is one whose transponder has no height. row names a report.

    A transponder is met by an equi-join: by the attributes that it has - the reports offer a key for each
    such set in use - and without any by cells of its surroundings. The table is a site's configuration;
    its side is broadcast only if Spark finds it small enough.
    """
    names = list(attributes)
    at, up = (F.col("lat"), F.col("lon")), F.lit(None).cast("double") if height is None else F.col(height)
    has = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    known = transponders.select(F.col("number").alias("_n"), *names, *at, up.alias("_up")).withColumn("_has", has).withColumn("_placed", at[0].isNotNull() & at[1].isNotNull())
    # as many sets as attributes have subsets
    sets = sorted(r["_has"] for r in known.select("_has").distinct().collect())
    step = most / (math.pi * EARTH_RADIUS / 180)
    columns = max(int(360 / step), 1)
    sine, narrow = math.sin(min(most / EARTH_RADIUS, math.pi / 2)), F.cos(F.radians(at[0]))
    reach = F.when(narrow > sine, F.degrees(F.asin(sine / narrow)) + 1e-9).otherwise(180.0)
    across = lambda x: F.floor((x + 360) * columns / 360).cast("long")
    cell = lambda x, y: F.concat_ws(":", F.floor(x / step).cast("long"), F.pmod(y, F.lit(columns)))
    rows = F.sequence(F.floor((at[0] - step) / step).cast("long"), F.floor((at[0] + step) / step).cast("long"))
    wide = F.sequence(across(at[1] - reach), across(at[1] + reach))
    around = F.array_distinct(F.flatten(F.transform(rows, lambda a: F.transform(wide, lambda b: F.concat_ws(":", a, F.pmod(b, F.lit(columns)))))))
    text = lambda c: F.col(c).cast("string")
    spell = lambda n, of: F.array(F.lit(str(n)), *(text(of(c)) for i, c in enumerate(names) if n >> i & 1))
    stated = reduce(lambda out, n: out.when(F.col("_has") == n, F.array(spell(n, str))), (n for n in sets if n), F.when(F.lit(False), F.array(F.array(F.lit("")))))
    nowhere = F.when(F.col("_placed"), F.transform(around, lambda c: F.array(F.lit("0"), c))).otherwise(F.array(F.array(F.lit("0"), F.lit("any"))))
    known = known.withColumn("_key", F.explode(F.when(F.col("_has") > 0, stated).otherwise(nowhere))).withColumn("_key", F.to_json("_key")).select("_key", "_n", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_up", "_placed")
    offered = [F.when(reduce(and_, (F.col(attributes[c]).isNotNull() for i, c in enumerate(names) if n >> i & 1)), F.to_json(spell(n, attributes.get))) for n in sets if n]
    if 0 in sets:
        offered += [F.to_json(F.array(F.lit("0"), cell(F.col(lat), across(F.col(lon))))), F.to_json(F.array(F.lit("0"), F.lit("any")))]
    met = reports.select(row, F.col(lat).alias("_y"), F.col(lon).alias("_x"), F.explode(F.filter(F.array(F.lit(None).cast("string"), *offered), lambda k: k.isNotNull())).alias("_key")).join(known, "_key")
    met = met.where(~F.col("_placed") | F.coalesce(haversine(F.col("_y"), F.col("_x"), F.col("_lat"), F.col("_lon")) <= most, F.lit(False)))
    first = met.groupBy(row).agg(F.min(F.struct("_n", "_up")).alias("_first"))
    out = reports.join(first, row, "left").withColumn("transponder", F.col("_first._n"))
    one = F.col("transponder").isNotNull() | F.coalesce(F.col(code) == 0o7777, F.lit(False))
    return out.withColumn("is_transponder", one).withColumn("transponder_height", F.when(one, F.coalesce("_first._up", F.lit(0.0)))).drop("_first")


def first_transponder(reports: DataFrame, transponders: DataFrame, code: str, address: str) -> DataFrame:
    """The first transponder, by number, all of whose present attributes equal the report's; code 7777 as a fallback."""
    f = transponders.select(F.col("number").alias("_n"), F.col(code).alias("_c"), F.col(address).alias("_a"))
    by_code, by_address = reports[code] == F.col("_c"), reports[address] == F.col("_a")
    kinds = ((by_code & by_address, "_c is not null and _a is not null"), (by_code, "_c is not null and _a is null"), (by_address, "_c is null and _a is not null"))
    found = None
    for on, which in kinds:
        part = reports.join(f.where(which), on).select("id", "_n")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.min("_n").alias("transponder"))
    return reports.join(best, "id", "left").withColumn("is_transponder", F.col("transponder").isNotNull() | F.coalesce(F.col(code) == 0o7777, F.lit(False)))


def unassociated(reports: DataFrame, associations: DataFrame, by: list[str]) -> DataFrame:
    """Reports with and without a target, by source."""
    known = associations.select("id", F.lit(1).alias("_k"))
    return reports.join(known, "id", "left").groupBy(*by).agg(F.count_if(F.col("_k").isNotNull()).alias("n_assoc"), F.count_if(F.col("_k").isNull()).alias("n_unassoc"))


def category(address: Column, vehicles: list[int], top_height: Column, emitter: Column, identification: Column | None = None, vehicle_names: list[str] | None = None) -> Column:
    """A vehicle by its address or identification, an aircraft by its emitter category or a height of 1000 feet."""
    vehicle = address.isin(vehicles)
    if identification is not None and vehicle_names:
        vehicle = F.coalesce(vehicle, F.lit(False)) | F.coalesce(identification.isin(vehicle_names), F.lit(False))
    return F.when(vehicle, "vehicle").when(emitter.between(1, 5) | (top_height >= 1000), "aircraft").otherwise("unknown")


def latest(df: DataFrame, key: str, t: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(t).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
