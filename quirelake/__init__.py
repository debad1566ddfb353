"""Document-structure analytics on Spark: outlines, contents rows, page labels and run reports."""

__version__ = "0.1.0"
