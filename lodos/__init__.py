"""Text analytics for Turkish (and any other) documents, written for PySpark."""
