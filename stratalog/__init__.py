"""An event log on Spark: replay, branches, folds, views, feeds, snapshots and retention as DataFrame operations."""

__version__ = "0.1.0"
