"""Panel time series and training data on Spark; see the README for what each module holds."""

from . import functions, operators, plans, sources, streaming

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
