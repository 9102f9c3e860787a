"""Change-history analytics on Spark: pure DataFrame-to-DataFrame operators."""

__version__ = "0.1.0"
