"""Fleet-scale file-integrity and log-audit analytics on Spark DataFrames."""

__version__ = "0.1.0"
