"""Security-log analytics on PySpark: parse, detect, correlate, export; in batch and as a stream."""

__version__ = "0.1.0"
