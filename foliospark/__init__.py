"""foliospark: document analytics for long, semi-structured reports on Spark DataFrames."""

__version__ = "0.1.0"
