"""Transit feed analytics as Spark jobs.

Every operator takes and returns DataFrames whose rows carry ``feed_id`` and
``snapshot_id``, so one job answers for all feeds, stops, days and snapshots.
"""

FEED = ["feed_id"]
KEY = ["feed_id", "snapshot_id"]
