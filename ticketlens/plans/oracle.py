"""Side-by-side check of a registered query against its DuckDB SQL.

Columns are compared by name (sorted), rows order-insensitively, numbers with
a relative tolerance. Used by the tests and by hand while building.
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from ..sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, (str, bytes))):
        seq = v.tolist() if hasattr(v, "tolist") else v
        return tuple(_norm(x) for x in seq)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, repr(round(x, 6)) if isinstance(x, float) else repr(x)) for x in row)


def _close(a, b, rel: float) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(float(a), float(b), rel_tol=rel, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y, rel) for x, y in zip(a, b))
    return a == b


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=_key)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame, rel: float = 1e-9) -> list[str]:
    """Differences as human-readable strings; empty when equal."""
    problems = []
    sc, sr = rows_of(spark_pdf)
    dc, dr = rows_of(duck_pdf)
    if sc != dc:
        problems.append(f"columns differ: spark-only {sorted(set(sc) - set(dc))}, sql-only {sorted(set(dc) - set(sc))}")
        return problems
    if len(sr) != len(dr):
        problems.append(f"row count {len(sr)} vs {len(dr)}")
        return problems
    for a, b in zip(sr, dr):
        if not _close(a, b, rel):
            bad = [(c, x, y) for c, x, y in zip(sc, a, b) if not _close(x, y, rel)]
            problems.append(f"row differs: {bad[:4]}")
            if len(problems) > 3:
                break
    return problems


def run_pair(spark, sf_dir: str, name: str, con=None) -> list[str]:
    from .catalog import load_all

    q = load_all()[name]
    sdf = q.build(spark, sf_dir).toPandas()
    if q.sql is None:
        return []
    con = con or duck(sf_dir)
    ddf = con.execute(q.sql).fetchdf()
    return compare(sdf, ddf)
