"""Evidence-graded analytics on PySpark: exact figures, model measurements and tested claims."""

__version__ = "0.1.0"
