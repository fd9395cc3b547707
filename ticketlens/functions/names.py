"""Column-name rules and the bounded distinct-value fetch used by dynamic pivots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dynamic pivot turns each distinct value into a column. The value list is
# fetched before the pivot; above this many values the operator refuses rather
# than silently dropping values.
MAX_PIVOT_VALUES = 2000


def space_safe(value: str) -> str:
    """lower case, spaces -> '_' (project roll-up columns)."""
    return value.lower().replace(" ", "_")


def dummy_safe(value: str) -> str:
    """lower case, spaces and '-' -> '_' (issue-grain one-hot columns)."""
    return value.lower().replace(" ", "_").replace("-", "_")


def file_safe(value: str) -> str:
    """Slashes and * ? : \" < > | -> '_' (file and partition names)."""
    return re.sub(r'[\\/*?:"<>|]', "_", value)


def distinct_values(df: DataFrame, col: str, limit: int = MAX_PIVOT_VALUES) -> list:
    """Sorted distinct non-null values of ``col``; raises if more than ``limit``.

    Runs one aggregation; only the (small) distinct set reaches the driver.
    """
    rows = (df.where(F.col(col).isNotNull()).select(col).distinct()
            .orderBy(col).limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values; not a pivot column")
    return [r[0] for r in rows]
