import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators.tracking import estimated_accuracies, motion, reference_tracks, variance_step


def sequential(t, x, y, sigma, noise):
    """The filter and the smoother report by report, with four states."""
    h, n = np.eye(4)[[0, 2]], len(t)
    state, cov, ahead, ahead_cov, steps = np.zeros((n, 4)), np.zeros((n, 4, 4)), np.zeros((n, 4)), np.zeros((n, 4, 4)), np.zeros((n, 4, 4))
    state[0], cov[0] = [x[0], 0, y[0], 0], np.diag([sigma[0] ** 2, 1e4] * 2)
    for i in range(1, n):
        f, q = motion(t[i] - t[i - 1], noise)
        steps[i], ahead[i], ahead_cov[i] = f, f @ state[i - 1], f @ cov[i - 1] @ f.T + q
        r = np.eye(2) * sigma[i] ** 2
        gain = ahead_cov[i] @ h.T @ np.linalg.inv(h @ ahead_cov[i] @ h.T + r)
        state[i] = ahead[i] + gain @ (np.array([x[i], y[i]]) - h @ ahead[i])
        keep = np.eye(4) - gain @ h
        cov[i] = keep @ ahead_cov[i] @ keep.T + gain @ r @ gain.T
    for i in range(n - 2, -1, -1):
        back = cov[i] @ steps[i + 1].T @ np.linalg.inv(ahead_cov[i + 1])
        state[i] = state[i] + back @ (state[i + 1] - ahead[i + 1])
        cov[i] = cov[i] + back @ (cov[i + 1] - ahead_cov[i + 1]) @ back.T
    return state, cov


def walks(seed, tracks, n, sigmas):
    """Movers with changing velocity, seen by sources of different accuracy."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(tracks):
        t = np.sort(np.round(np.cumsum(r.uniform(0.3, 3.0, n)), 3))
        v = np.cumsum(r.normal(0, 1.0, (n, 2)) * np.sqrt(np.diff(t, prepend=t[0]))[:, None], axis=0) + r.uniform(-100, 100, 2)
        at = r.uniform(-1e4, 1e4, 2) + np.cumsum(v * np.diff(t, prepend=t[0])[:, None], axis=0)
        s = r.integers(0, len(sigmas), n)
        seen = at + r.normal(0, 1, (n, 2)) * np.array(sigmas)[s][:, None]
        out.append(pd.DataFrame({"k": k, "s": t, "x": seen[:, 0], "y": seen[:, 1], "src": s, "sigma": np.array(sigmas)[s]}))
    return pd.concat(out)


@pytest.mark.parametrize("width", [37.0, 86_400.0])
def test_scans_equal_the_sequential_filter(spark, width):
    rows = walks(1, 3, 300, [20.0, 60.0])
    rows = rows[(rows.k != 1) | (rows.s < 200) | (rows.s > 240)]  # one track has a gap
    got = reference_tracks(spark.createDataFrame(rows), "k", "s", "x", "y", "sigma", 2.0, width=width).toPandas().sort_values(["key", "t"])
    want = []
    for k, own in rows.groupby("k"):
        for _, piece in own.groupby((own.s.diff() > 11).cumsum()):
            s, p = sequential(*(piece[c].to_numpy() for c in ("s", "x", "y", "sigma")), 2.0)
            want.append(np.column_stack([np.full(len(s), k), piece.s, s[:, 0], s[:, 2], s[:, 1], s[:, 3], np.sqrt(p[:, 0, 0] + p[:, 2, 2])]))
    want = np.concatenate(want)
    found = got[["key", "t", "x", "y", "vx", "vy", "stddev"]].to_numpy()
    assert found.shape == want.shape and np.allclose(found, want, rtol=1e-9, atol=1e-7)
    grid = [reference_tracks(spark.createDataFrame(rows), "k", "s", "x", "y", "sigma", 2.0, step=2.0, width=w).toPandas().sort_values(["key", "session", "t"]).reset_index(drop=True) for w in (width, 1e9)]
    pd.testing.assert_frame_equal(grid[0], grid[1], rtol=1e-8)


def test_planted_accuracies_are_found(spark):
    rows = walks(2, 4, 500, [15.0, 40.0, 90.0])
    got = {r.source: r.sigma for r in estimated_accuracies(spark.createDataFrame(rows), "k", "s", "x", "y", "src", noise=1.0, rounds=5, width=400.0).collect()}
    assert all(abs(got[i] / s - 1) < 0.15 for i, s in enumerate((15.0, 40.0, 90.0)))


def test_a_step_of_the_variances(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 0.0, 0.0, 0.5), ("a", 3.0, 0.0, 0.0, 0.0, 1.5), ("b", 1.0, 1.0, 1.0, 1.0, 4.0)], "src string, x double, y double, fx double, fy double, v double")
    got = {r.src: (round(r.sigma**2, 9), r.n) for r in variance_step(df, "src", ("x", "y"), ("fx", "fy"), "v").select("*", F.lit(1)).collect()}
    assert got == {"a": (((1 + 4) / 2 + 0.5 + 9 / 2 + 1.5) / 2, 2), "b": (4.0, 1)}
