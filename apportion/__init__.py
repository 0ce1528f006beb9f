"""Ambiguous-assignment analytics on Spark.

Observations ("fragments") match one or more targets; the package estimates how
much of the stream belongs to each target and everything around that estimate.
"""

from apportion.config import Options

__all__ = ["Options"]
