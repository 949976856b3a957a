"""rostercast: daily demand profiling, forecasting and stand-by rostering on Spark."""

__version__ = "0.1.0"
