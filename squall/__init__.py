"""squall — Spark-native sensor-event analytics.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and aggregations.  Per-series windows are
split into time blocks and stitched with small carry tables (see
``squall.operators.blocks``) so no series, however long, lands in one task.
"""

from squall.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
