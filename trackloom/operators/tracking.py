"""Kalman filtering, smoothing and resampling of target tracks.

Filter and smoother are associative scans: a stretch of a track comes to one element of small matrices,
and elements of neighbouring stretches combine. A track without gaps, however long, is cut into time
slices; each gives its element, the few elements of a track are combined in order, and every slice then
starts from the state that those before it come to, and ends in that which those after it come to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.staging import stage
from trackloom.operators.timeline import WIDTH, gap_sessions, previous

#: A longer time without a report starts the filter anew, in seconds.
RESET = 11.0
#: Of a velocity of which nothing is known, in (m/s)^2.
FIRST = 1e4
#: Width of a slice of a track in seconds: a day, 21,600 reports at one in 4 s.
SLICE = 86_400.0


def motion(dt: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Constant velocity for the state x, vx, y, vy, with white acceleration noise."""
    f, q = _motions(np.array([dt], float), noise)
    return np.kron(np.eye(2), f[0]), np.kron(np.eye(2), q[0])


def _motions(dt: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for one axis and many steps: both axes share their matrices, so that a mean has a column for each."""
    one, nil = np.ones_like(dt), np.zeros_like(dt)
    f = np.stack([one, dt, nil, one], axis=1).reshape(-1, 2, 2)
    q = np.stack([dt**3 / 3, dt**2 / 2, dt**2 / 2, dt], axis=1).reshape(-1, 2, 2) * noise**2
    return f, q


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _inverse(m: np.ndarray) -> np.ndarray:
    det = m[..., 0, 0] * m[..., 1, 1] - m[..., 0, 1] * m[..., 1, 0]
    turned = np.stack([m[..., 1, 1], -m[..., 0, 1], -m[..., 1, 0], m[..., 0, 0]], axis=-1).reshape(m.shape)
    return turned / det[..., None, None]


def after_each(i: tuple, j: tuple) -> tuple:
    """The filter's element of stretches i, then j: (transition, mean, covariance, information vector, information)."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = i, j
    d = _inverse(np.eye(2) + c1 @ j2)
    ad, back = a2 @ d, _t(a1) @ _t(d)
    return ad @ a1, ad @ (b1 + c1 @ e2) + b2, ad @ c1 @ _t(a2) + c2, back @ (e2 - j2 @ b1) + e1, back @ j2 @ a1 + j1


def before_each(j: tuple, i: tuple) -> tuple:
    """The smoother's element of stretches i, then j, of which j was there first: (gain, mean, covariance)."""
    (g1, m1, p1), (g2, m2, p2) = i, j
    return g1 @ g2, g1 @ m2 + m1, g1 @ p2 @ _t(g1) + p1


def scanned(elements: tuple, combine, most: int | None = None) -> tuple:
    """All prefixes, by doubling: the work of each step is a few products of all matrices at once.

    With most, prefixes of so many elements only.
    """
    out, step = tuple(x.copy() for x in elements), 1
    while step < min(len(out[0]), most or len(out[0])):
        new = combine(tuple(x[:-step] for x in out), tuple(x[step:] for x in out))
        for x, y in zip(out, new, strict=True):
            x[step:] = y
        step *= 2
    return out


def _elements(dt: np.ndarray, begins: np.ndarray, z: np.ndarray, r: np.ndarray, noise: float) -> tuple:
    """The filter's element of each report, dt after the one before; at the first report of a track nothing before counts."""
    f, q = _motions(np.where(np.isnan(dt), 0.0, dt), noise)
    gain = q[:, :, :1] / (q[:, :1, :1] + r[:, None, None])
    keep = np.eye(2) - gain @ np.array([[[1.0, 0.0]]])
    at = z[:, None, :]
    weigh = _t(f)[:, :, :1] / (q[:, :1, :1] + r[:, None, None])
    out = [keep @ f, gain @ at, keep @ q, weigh @ at, weigh @ f[:, :1, :]]
    for i in (0, 3, 4):
        out[i][begins] = 0.0
    out[1][begins] = np.stack([z[begins], np.zeros_like(z[begins])], axis=1)
    out[2][begins] = 0.0
    out[2][begins, 0, 0], out[2][begins, 1, 1] = r[begins], FIRST
    return tuple(out)


def _backward(dt: np.ndarray, m: np.ndarray, p: np.ndarray, noise: float) -> tuple:
    """The smoother's elements, dt before the report that follows; one that none follows (NaN) is as it was filtered."""
    last = np.isnan(dt)
    f, q = _motions(np.where(last, 1.0, dt), noise)
    ahead = f @ p @ _t(f) + q
    gain = np.where(last[:, None, None], 0.0, p @ _t(f) @ _inverse(ahead))
    return gain, m - gain @ f @ m, p - gain @ ahead @ _t(gain)


def smooth_each(t: np.ndarray, z: np.ndarray, r: np.ndarray, begins: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed means and covariances of whole tracks that follow each other, at once; begins marks the first report of each.

    A first report passes on nothing of what is before it, and a last one takes nothing of what is after it,
    so that one scan serves all, as far as the longest track is.
    """
    dt = np.where(begins, np.nan, np.diff(t, prepend=t[:1]))
    longest = int(np.diff(np.flatnonzero(np.append(begins, True))).max())
    found = scanned(_elements(dt, begins, z, r, noise), after_each, longest)
    m, p = found[1], found[2]
    own = tuple(x[::-1] for x in _backward(np.append(dt[1:], np.nan), m, p, noise))
    found = scanned(own, before_each, longest)
    return found[1][::-1], found[2][::-1]


def _one(*parts: np.ndarray) -> tuple:
    return tuple(p.reshape(1, 2, 2) for p in parts)


def _joined(a: tuple, b: tuple) -> tuple:
    return tuple(np.concatenate(p) for p in zip(a, b, strict=True))


@dataclass
class Stretch:
    """A slice of a track: times, positions (rows of x, y), variances of measurement, and the time before, NaN at the start of the track."""

    t: np.ndarray
    z: np.ndarray
    r: np.ndarray
    before: float
    noise: float

    def elements(self) -> tuple:
        dt = np.diff(np.concatenate([[self.before], self.t]))
        begins = np.zeros(len(dt), bool)
        begins[0] = np.isnan(self.before)
        return _elements(dt, begins, self.z, self.r, self.noise)

    def filtered(self, state: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        own = self.elements()
        if state is None:
            found = scanned(own, after_each)
            return found[1], found[2]
        nil = np.zeros((2, 2))
        found = scanned(_joined(_one(nil, state[0], state[1], nil, nil), own), after_each)
        return found[1][1:], found[2][1:]

    def backward(self, m: np.ndarray, p: np.ndarray, following: float) -> tuple:
        """The smoother's elements; a report that none follows is as it was filtered."""
        return _backward(np.diff(np.concatenate([self.t, [following]])), m, p, self.noise)

    def smoothed(self, m: np.ndarray, p: np.ndarray, following: float, end: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        own = tuple(x[::-1] for x in self.backward(m, p, following))
        if end is not None:
            own = _joined(_one(np.zeros((2, 2)), *end), own)
        found = scanned(own, before_each)
        skip = end is not None
        return found[1][skip:][::-1], found[2][skip:][::-1]


def smooth(t: np.ndarray, x: np.ndarray, y: np.ndarray, sigma: float | np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Filtered, then backwards smoothed (Rauch-Tung-Striebel) states x, vx, y, vy of a whole track, and the covariances of an axis."""
    s = Stretch(t, np.stack([x, y], axis=1), np.broadcast_to(np.asarray(sigma, float) ** 2, t.shape), np.nan, noise)
    m, p = s.smoothed(*s.filtered(None), np.nan, None)
    return np.stack([m[:, 0, 0], m[:, 1, 0], m[:, 0, 1], m[:, 1, 1]], axis=1), p


_KEYS = ["key", "session", "slice"]


def _stretch(pdf: pd.DataFrame, noise: float) -> tuple[pd.DataFrame, Stretch]:
    pdf = pdf.sort_values(["t", "x", "y"])
    return pdf, Stretch(pdf.t.to_numpy(), pdf[["x", "y"]].to_numpy(), pdf.sigma.to_numpy() ** 2, float(pdf.before.iloc[0]), noise)


def _matrices(values) -> tuple | None:
    return None if values is None or len(values) == 0 else tuple(np.array(values, float).reshape(-1, 2, 2))


def _row(pdf: pd.DataFrame, **more) -> pd.DataFrame:
    return pd.DataFrame({**{k: pdf[k].iloc[:1].to_numpy() for k in _KEYS}, **{k: [v] for k, v in more.items()}})


def _tracks(parts: Iterator[pd.DataFrame], noise: float) -> Iterator[pd.DataFrame]:
    """Smoothed states of whole tracks, sorted by key, session and time: those that end within a part at once, the last one with the next part."""
    waiting = []

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        begins = np.append(True, _turns(pdf))
        m, p = smooth_each(pdf.t.to_numpy(), pdf[["x", "y"]].to_numpy(), pdf.sigma.to_numpy() ** 2, begins, noise)
        return pdf[["key", "session", "t"]].assign(x=m[:, 0, 0], y=m[:, 0, 1], vx=m[:, 1, 0], vy=m[:, 1, 1], stddev=np.sqrt(np.maximum(2 * p[:, 0, 0], 0)))

    for pdf in parts:
        waiting.append(pdf)
        pdf = pd.concat(waiting, ignore_index=True) if len(waiting) > 1 else pdf
        turns = np.flatnonzero(_turns(pdf)) + 1
        if len(turns):
            yield states(pdf.iloc[: turns[-1]])
            waiting = [pdf.iloc[turns[-1] :]]
        else:
            waiting = [pdf]
    if waiting and len(waiting[0]):
        yield states(waiting[0])


def _turns(pdf: pd.DataFrame) -> np.ndarray:
    """Where the row after is of another track."""
    return (pdf.key.to_numpy()[1:] != pdf.key.to_numpy()[:-1]) | (pdf.session.to_numpy()[1:] != pdf.session.to_numpy()[:-1])


def reference_tracks(reports: DataFrame, key: str, seconds: str, x: str, y: str, sigma: float | str = 30.0, noise: float = 3.0, step: float | None = None, width: float = SLICE) -> DataFrame:
    """key, session, t, x, y, vx, vy, stddev of the smoothed tracks, at the reports or every `step` seconds.

    sigma is the deviation of all positions, or the name of a column with that of each. A track is cut
    into slices of `width` seconds: each gives one element of matrices, those of a track are combined in
    order, and each slice is filtered from the state before it and smoothed from the one after it, so that
    no task holds more than a slice and the result doesn't depend on the width.
    """
    micro = reports.withColumn("_us", F.round(F.col(seconds) * 1_000_000).cast("long")).withColumn("_sigma", F.col(sigma) if isinstance(sigma, str) else F.lit(float(sigma)))
    columns = {"key": F.col(key), "session": F.col("session"), "t": F.col(seconds).cast("double"), "x": F.col(x).cast("double"), "y": F.col(y).cast("double"), "sigma": F.col("_sigma").cast("double")}
    rows = gap_sessions(micro, key, "_us", int(RESET * 1_000_000)).select("_us", *(c.alias(n) for n, c in columns.items())).dropna()
    rows = previous(rows, ["key", "session"], "_us", ["t"], int(width * 1_000_000), ["x", "y"])
    rows = rows.select("key", "session", "t", "x", "y", "sigma", F.col("prev.t").alias("before"), F.floor(F.col("_us") / int(width * 1_000_000)).alias("slice"))
    lives = rows.groupBy("key", "session").agg((F.min("slice") == F.max("slice")).alias("whole"))
    rows = stage(rows.join(lives, ["key", "session"]))
    # a track in one slice needs nothing from others
    alone, rows = rows.where("whole"), rows.where("not whole")
    kind = rows.schema["key"].dataType.simpleString()
    head = f"key {kind}, session long, slice long"

    def element(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s = _stretch(pdf, noise)
        return _row(pdf, first=s.t[0], element=np.concatenate([part[-1].ravel() for part in scanned(s.elements(), after_each)]))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each slice the state before it and the time after it."""
        pdf, state, out = pdf.sort_values("slice"), None, []
        for values in pdf.element:
            out.append(None if state is None else np.concatenate([state[1].ravel(), state[2].ravel()]))
            own = _matrices(values)
            state = own if state is None else after_each(state, own)
        return pdf[_KEYS].assign(state=out, following=pdf["first"].shift(-1).astype(float))

    elements = rows.groupBy(*_KEYS).applyInPandas(element, f"{head}, first double, element array<double>")
    begun = stage(elements.groupBy("key", "session").applyInPandas(starts, f"{head}, state array<double>, following double"))

    def back(_, pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf, s = _stretch(pdf, noise)
        b = begin.iloc[0]
        m, p = s.filtered(_matrices(b.state))
        own = scanned(tuple(e[::-1] for e in s.backward(m, p, float(b.following))), before_each)
        return _row(pdf, element=np.concatenate([part[-1].ravel() for part in own]))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each slice the smoothed state of the first report after it."""
        pdf, state, out = pdf.sort_values("slice", ascending=False), None, []
        for values in pdf.element:
            out.append(None if state is None else np.concatenate([state[1].ravel(), state[2].ravel()]))
            own = _matrices(values)
            state = own if state is None else before_each(state, own)
        return pdf[_KEYS].assign(end=out)

    grouped = lambda df: df.groupBy(*_KEYS)
    backs = grouped(rows).cogroup(grouped(begun)).applyInPandas(back, f"{head}, element array<double>")
    ended = backs.groupBy("key", "session").applyInPandas(ends, f"{head}, end array<double>")
    around = stage(begun.join(ended, _KEYS))

    def run(pdf: pd.DataFrame, state: tuple | None = None, end: tuple | None = None, following: float = np.nan) -> pd.DataFrame:
        pdf, s = _stretch(pdf, noise)
        m, p = s.smoothed(*s.filtered(state), following, end)
        t = s.t
        if step is not None:
            if end is not None:
                t, m, p = np.append(t, following), np.concatenate([m, end[0][None]]), np.concatenate([p, end[1][None]])
            low = np.ceil(t[0] / step)
            # a point at the first report of a slice belongs to it
            high = np.floor(t[-1] / step) if end is None else np.ceil(t[-1] / step) - 1
            at = np.arange(low, high + 1) * step if len(t) > 1 else t
        deviation = np.sqrt(np.maximum(2 * p[:, 0, 0], 0))
        if step is None or len(t) == 1:
            out = pd.DataFrame({"t": t, "x": m[:, 0, 0], "y": m[:, 0, 1], "vx": m[:, 1, 0], "vy": m[:, 1, 1], "stddev": deviation})
        else:
            plain = {"vx": np.interp(at, t, m[:, 1, 0]), "vy": np.interp(at, t, m[:, 1, 1]), "stddev": np.interp(at, t, deviation)}
            out = pd.DataFrame({"t": at, "x": blend(at, t, m[:, 0, 0], m[:, 1, 0]), "y": blend(at, t, m[:, 0, 1], m[:, 1, 1])} | plain)
        out.insert(0, "session", pdf.session.iloc[0])
        out.insert(0, "key", pdf.key.iloc[0])
        return out

    def between(_, pdf: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        side = sides.iloc[0]
        return run(pdf, _matrices(side.state), _matrices(side.end), float(side.following))

    schema = f"key {kind}, session long, t double, x double, y double, vx double, vy double, stddev double"
    if step is None:
        ordered = alone.repartition("key", "session").sortWithinPartitions("key", "session", "t", "x", "y").select("key", "session", "t", "x", "y", "sigma")
        return ordered.mapInPandas(lambda parts: _tracks(parts, noise), schema).unionByName(grouped(rows).cogroup(grouped(around)).applyInPandas(between, schema))
    return grouped(alone).applyInPandas(lambda pdf: run(pdf), schema).unionByName(grouped(rows).cogroup(grouped(around)).applyInPandas(between, schema))


def estimated_accuracies(reports: DataFrame, key: str, seconds: str, x: str, y: str, source: str, start: float = 30.0, noise: float = 3.0, rounds: int = 6, width: float = SLICE) -> DataFrame:
    """Source, sigma, n: the deviation of each source's positions, from how far they lie off the tracks fused of all.

    In each round the tracks are smoothed with what is known of the sources, all alike at first; a source's
    variance becomes the mean of its squared residuals plus the variance that the track itself has there
    (the maximisation step of expectation-maximisation), and weighs its reports in the next round.
    """
    rows = reports.select(F.col(key).alias("key"), F.col(seconds).cast("double").alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(source).alias("source")).dropna()
    known = rows.select("source").distinct().withColumn("sigma", F.lit(float(start)))
    for _ in range(rounds):
        weighed = stage(rows.join(known.select("source", "sigma"), "source"))
        tracks = reference_tracks(weighed, "key", "t", "x", "y", "sigma", noise, width=width).select("key", "t", F.col("x").alias("fx"), F.col("y").alias("fy"), (F.col("stddev") * F.col("stddev") / 2).alias("v")).dropDuplicates(["key", "t"])
        known = stage(variance_step(weighed.join(tracks, ["key", "t"]), "source", ("x", "y"), ("fx", "fy"), "v"))
    return known


def variance_step(residuals: DataFrame, source: str, at: tuple[str, str], track: tuple[str, str], variance: str) -> DataFrame:
    """Source, sigma, n: one step of the estimate, from positions and the track's at their times with its variance on an axis."""
    squares = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(at, track, strict=True)), F.lit(0.0)) / 2
    return residuals.groupBy(source).agg(F.sqrt(F.avg(squares + F.col(variance))).alias("sigma"), F.count("*").alias("n"))


def blend(at: np.ndarray, t: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions at other times: the state before carried forward and the one after carried back, each by its nearness."""
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    share = (at - t[i]) / (t[i + 1] - t[i])
    return (1 - share) * (x[i] + v[i] * (at - t[i])) + share * (x[i + 1] - v[i + 1] * (t[i + 1] - at))


def spline_points(df: DataFrame, key: list[str], t: str, columns: list[str], step: int, most_gap: int, width: int = WIDTH) -> DataFrame:
    """Positions every `step` between the reports of a key, where they are at most most_gap apart: key..., at, columns.

    Cubic between two reports, through both, with the slopes that the reports around them give; at an end
    of a track the slope is that of the line. The reports' own places on the grid are among the points.
    """
    rows = previous(df.select(*key, t, *columns), key, t, [t, *columns], width).withColumnRenamed("prev", "before").withColumn("_neg", -F.col(t))
    after = previous(rows.withColumn("_far", F.lit(None).cast("long")), key, "_neg", [t, *columns], width).drop("_far").withColumnRenamed("prev", "after")
    rows = previous(after.withColumn("_next", F.col("after")), key, "_neg", [t, "_next"], width).withColumn("beyond", F.col("prev._next")).drop("prev", "_next", "_neg")
    pairs = rows.where(F.col("after").isNotNull() & (F.col(f"after.{t}") - F.col(t) <= most_gap) & (F.col(f"after.{t}") > F.col(t)))
    first = F.ceil(F.col(t) / step)
    # a point at the second report belongs to the next pair, or to this one if it is the last
    last = F.ceil(F.col(f"after.{t}") / step) - 1
    last = F.when(F.col("beyond").isNull() | (F.col(f"beyond.{t}") - F.col(f"after.{t}") > most_gap), F.floor(F.col(f"after.{t}") / step)).otherwise(last)
    pairs = pairs.where(last >= first).withColumn("_i", F.explode(F.sequence(first, last))).withColumn("at", F.col("_i") * step)
    gap = (F.col(f"after.{t}") - F.col(t)).cast("double")
    s = (F.col("at") - F.col(t)) / gap

    def at(c: str) -> Column:
        line = (F.col(f"after.{c}") - F.col(c)) / gap
        around = lambda one, two: (F.col(f"{two}.{c}" if two else c) - F.col(f"{one}.{c}" if one else c)) / (F.col(f"{two}.{t}" if two else t) - F.col(f"{one}.{t}" if one else t))
        near = lambda side, a, b: F.abs(F.col(a) - F.col(b)) <= most_gap if side else F.lit(True)
        m0 = F.when(F.col("before").isNotNull() & near(1, t, f"before.{t}"), around("before", "after")).otherwise(line) * gap
        m1 = F.when(F.col("beyond").isNotNull() & near(1, f"beyond.{t}", f"after.{t}"), around("", "beyond")).otherwise(line) * gap
        return (2 * s * s * s - 3 * s * s + 1) * F.col(c) + (s * s * s - 2 * s * s + s) * m0 + (3 * s * s - 2 * s * s * s) * F.col(f"after.{c}") + (s * s * s - s * s) * m1

    return pairs.select(*key, "at", *(at(c).alias(f"_{c}") for c in columns)).toDF(*key, "at", *columns)
