"""tierlens: curation, scoring and policy evaluation of line-recognition data on Spark."""

__version__ = "0.1.0"
