"""Saved queries: a view point or command as plain JSON, turned into a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import filters as P


def load(contents: dict[str, DataFrame], spec: dict) -> dict[str, DataFrame]:
    """The contents a spec wants, filtered, cut to its columns.

    spec: {"contents": [...], "columns": {content: [...]}, "filters": [{"column", "operator", "value",
    "absolute", "chain": "AND" or "OR"}], "windows": {"column", "excluded": [[a, b]]}, "where": SQL, "most": rows of a table view}.
    A filter applies to the contents that have its column.
    """
    out = {}
    for name in spec.get("contents", sorted(contents)):
        df = contents[name]
        own = [f for f in spec.get("filters", []) if f["column"] in df.columns]
        df = df.where(P.chain([(f.get("chain", "AND"), P.compare(f["column"], f["operator"], f["value"], f.get("absolute", False))) for f in own]))
        windows = spec.get("windows")
        if windows and windows["column"] in df.columns:
            df = df.where(P.outside_windows(windows["column"], windows["excluded"]))
        if spec.get("where"):
            df = df.where(F.expr(spec["where"]))
        columns = spec.get("columns", {}).get(name)
        df = df.select(*columns) if columns else df
        out[name] = df.limit(spec["most"]) if "most" in spec else df
    return out


def get_targets(reports: DataFrame, key: str, t: str) -> DataFrame:
    """Commands get_utns and get_target_stats: targets with updates and times."""
    return reports.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
