"""The lookup side of an equi-join whose other side may hold a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import cut_lineage


def lookup_side(df: DataFrame) -> DataFrame:
    """``df`` (one row per key, an aggregate) as a written table.

    Read back as a plain scan it has a measured size, so Spark decides about a broadcast by its own
    threshold (``spark.sql.autoBroadcastJoinThreshold``, at run time AQE's) without a hint. Above it the side
    reaches the join through a shuffle that the planner inserts, the only kind AQE's skew-join rule
    splits (an aggregate already partitioned on the join key would be joined without one, and a
    hot folder would then sit in one task)."""
    return cut_lineage(df)
