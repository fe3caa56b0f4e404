"""revcast: revenue forecasting and marketing analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
