"""Stand-in inputs shared by the query plans (FIXTURES.md §2).

These only read and reshape driver tables; the operators do the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nested import with_link_counts
from ..operators.project import with_issue_times
from ..sources import tables as T

# Fixed values of the driver tables that the oracle SQL spells out as columns
# (the Spark side fetches them from the data).
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# How the stand-in priorities map onto the derived-feature families.
STANDIN_DERIVED = dict(
    high_tokens=("1-urgent", "2-high"),
    low_tokens=("4-not_specified", "5-low"),
    weights={"1-urgent": 5, "2-high": 4, "3-medium": 3, "4-not_specified": 2, "5-low": 1},
    bug_token="machinery",
)


def issues_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat issues + per-issue time features."""
    return with_issue_times(T.issues(spark, sf_dir))


def issues_tl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat issues + time features + link-direction counts."""
    return with_link_counts(issues_t(spark, sf_dir), T.issue_links(spark, sf_dir))
